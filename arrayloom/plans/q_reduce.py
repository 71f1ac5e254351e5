"""Reductions, scatter-adds, scans, sorts and keyed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrayloom.operators import blocks, reduce, scan, sort
from arrayloom.plans.catalog import query
from arrayloom.sources import vectors
from arrayloom.sources.tables import table

CENTS = "CAST(round(value * 100) AS BIGINT)"
EVENTS = f"(SELECT event_id AS idx, event_type AS k, user_id AS u, {CENTS} AS v FROM events)"
ORDERS = "(SELECT o_orderkey AS idx, o_orderstatus AS s, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders)"


def events(spark, d):
    return vectors.vector(table(spark, d, "events"), "event_id", k="event_type", u="user_id", v=F.round(F.col("value") * 100).cast("long"))


def orders(spark, d):
    return vectors.vector(table(spark, d, "orders"), "o_orderkey", s="o_orderstatus", v=F.round(F.col("o_totalprice") * 100).cast("long"))


@query(f"SELECT CAST(sum(v) AS BIGINT) AS total FROM {EVENTS}")
def reduce_sum(spark, d):
    return events(spark, d).agg(reduce.total(F.col("v"), "bigint").alias("total"))


@query("SELECT round(sum(l_quantity * l_extendedprice), 2) AS dot FROM lineitem")
def inner_product(spark, d):
    return table(spark, d, "lineitem").agg(F.round(reduce.total(F.col("l_quantity") * F.col("l_extendedprice")), 2).alias("dot"))


@query("SELECT count(*) FILTER (WHERE l_quantity > 25) AS n FROM lineitem")
def count_if(spark, d):
    return table(spark, d, "lineitem").agg(reduce.count_if(F.col("l_quantity") > 25).alias("n"))


@query("SELECT min(value) AS lo, max(value) AS hi FROM events")
def reduce_minmax(spark, d):
    return table(spark, d, "events").agg(*reduce.combined(lo=reduce.least(F.col("value")), hi=reduce.greatest(F.col("value"))))


@query(f"SELECT CAST(sum(v) AS BIGINT) AS s, min(v) AS lo, max(v) AS hi, count(*) AS n FROM {EVENTS}")
def reduce_combined(spark, d):
    v = F.col("v")
    return events(spark, d).agg(*reduce.combined(s=reduce.total(v, "bigint"), lo=reduce.least(v, "bigint"), hi=reduce.greatest(v, "bigint"), n=F.count("*")))


@query("SELECT k, round(kahan_sum(x), 3) AS total FROM (SELECT event_type AS k, (value - 25) * 1e8 AS x FROM events) GROUP BY k")
def reduce_sum_kahan(spark, d):
    t = table(spark, d, "events").select(F.col("event_type").alias("k"), ((F.col("value") - 25) * 1e8).alias("x"))
    return reduce.exact_sum(t, F.col("x"), ["k"]).select("k", F.round("total", 3).alias("total"))


@query("SELECT bool_or(value > 200) AS some, bool_or(value < -1) AS none FROM events")
def any_of(spark, d):
    return table(spark, d, "events").agg(*reduce.combined(some=reduce.any_of(F.col("value") > 200), none=reduce.any_of(F.col("value") < -1)))


@query("SELECT bool_and(value >= 0) AS every, bool_and(value > 10) AS part FROM events")
def all_of(spark, d):
    return table(spark, d, "events").agg(*reduce.combined(every=reduce.all_of(F.col("value") >= 0), part=reduce.all_of(F.col("value") > 10)))


@query("""
SELECT 0.0::DOUBLE AS total, 1.7976931348623157e308::DOUBLE AS lo, -1.7976931348623157e308::DOUBLE AS hi, false AS some, true AS every
""")
def reduce_empty_identity(spark, d):
    t, v = table(spark, d, "events").where("value < 0"), F.col("value")
    return t.agg(*reduce.combined(total=reduce.total(v), lo=reduce.least(v), hi=reduce.greatest(v), some=reduce.any_of(v > 0), every=reduce.all_of(v > 0)))


@query("SELECT r.range AS idx, coalesce(n, 0) AS n FROM range(16) r LEFT JOIN (SELECT user_id % 16 AS b, count(*) AS n FROM events GROUP BY 1) ON b = range")
def histogram_scatter_add(spark, d):
    return reduce.histogram(events(spark, d), F.col("u") % 16, 16)


@query(f"""
SELECT u % 8 AS cell, CAST(sum(v) AS BIGINT) AS added, CAST(-sum(v) AS BIGINT) AS subtracted, min(v) AS least, max(v) AS greatest, bit_and(v) AS anded,
       bit_or(v) AS ored, bit_xor(v) AS xored, count(*) AS incremented, max_by(v, idx) AS exchanged
FROM {EVENTS} GROUP BY 1
""")
def atomics_by_cell(spark, d):
    v = F.col("v")
    return events(spark, d).groupBy((F.col("u") % 8).alias("cell")).agg(
        F.sum(v).alias("added"), (-F.sum(v)).alias("subtracted"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.bit_and(v).alias("anded"),
        F.bit_or(v).alias("ored"), F.bit_xor(v).alias("xored"), F.count("*").alias("incremented"), F.max_by("v", "idx").alias("exchanged"),
    )


# scans


@query(f"SELECT idx, CAST(sum(v) OVER (ORDER BY idx) AS BIGINT) AS scan FROM {EVENTS}")
def inclusive_scan(spark, d):
    return scan.inclusive_scan(events(spark, d).select("idx", "v")).select("idx", "scan")


@query(f"SELECT idx, CAST(coalesce(sum(v) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM {EVENTS}")
def exclusive_scan(spark, d):
    return scan.exclusive_scan(events(spark, d).select("idx", "v")).select("idx", "scan")


@query(f"SELECT idx, CAST(1000 + coalesce(sum(v) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM {EVENTS}")
def exclusive_scan_init(spark, d):
    return scan.exclusive_scan(events(spark, d).select("idx", "v"), init=1000).select("idx", "scan")


@query(f"SELECT idx, max(v) OVER (ORDER BY idx) AS hi, bit_xor(v) OVER (ORDER BY idx) AS xored FROM {EVENTS}")
def scan_max(spark, d):
    t = scan.inclusive_scan(events(spark, d).select("idx", "v"), fold=blocks.MAX, out="hi")
    return scan.inclusive_scan(t, fold=blocks.BIT_XOR, out="xored").select("idx", "hi", "xored")


_RUNS = """WITH t AS (SELECT *, {changed} AS c FROM {source} s),
r AS (SELECT *, CAST(sum(CAST(coalesce(c, false) AS INT)) OVER (ORDER BY idx) AS BIGINT) AS run FROM t)"""
_BY_TYPE = _RUNS.format(changed="lag(k) OVER (ORDER BY idx) <> k", source=EVENTS)
_BY_STATUS = _RUNS.format(changed="lag(s) OVER (ORDER BY idx) <> s", source=ORDERS)
_BY_PAIR = _RUNS.format(changed="lag(k) OVER (ORDER BY idx) <> k OR lag(u % 2) OVER (ORDER BY idx) <> u % 2", source=EVENTS)
_SORTED = "(SELECT row_number() OVER (ORDER BY u, idx) - 1 AS idx, CAST(u AS VARCHAR) AS k, v FROM " + EVENTS + ")"


@query(f"{_BY_TYPE} SELECT idx, CAST(sum(v) OVER (PARTITION BY run ORDER BY idx) AS BIGINT) AS scan FROM r")
def inclusive_scan_by_key(spark, d):
    return scan.inclusive_scan_by_key(events(spark, d), ["k"]).select("idx", "scan")


@query(f"{_BY_TYPE} SELECT idx, CAST(5 + coalesce(sum(v) OVER (PARTITION BY run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM r")
def exclusive_scan_by_key(spark, d):
    return scan.exclusive_scan_by_key(events(spark, d), ["k"], init=5).select("idx", "scan")


@query(f"{_BY_PAIR} SELECT idx, CAST(sum(v) OVER (PARTITION BY run ORDER BY idx) AS BIGINT) AS scan FROM r")
def inclusive_scan_by_key_tuple(spark, d):
    t = events(spark, d).withColumn("odd", F.col("u") % 2)
    return scan.inclusive_scan_by_key(t, ["k", "odd"]).select("idx", "scan")


# by adjacent key


@query(f"{_BY_TYPE} SELECT run AS idx, min_by(k, idx) AS k, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM r GROUP BY run")
def reduce_by_key_unsorted(spark, d):
    return reduce.reduce_by_key(events(spark, d), ["k"], total=F.sum("v"), n=F.count("*"))


@query(f"{_BY_STATUS} SELECT run AS idx, min_by(s, idx) AS s, max(v) AS hi FROM r GROUP BY run")
def reduce_by_key_max(spark, d):
    return reduce.reduce_by_key(orders(spark, d), ["s"], hi=F.max("v"))


@query(f"{_BY_PAIR} SELECT run AS idx, min_by(k, idx) AS k, min_by(u % 2, idx) AS odd, CAST(sum(v) AS BIGINT) AS total FROM r GROUP BY run")
def reduce_by_key_tuple(spark, d):
    t = events(spark, d).withColumn("odd", F.col("u") % 2)
    return reduce.reduce_by_key(t, ["k", "odd"], total=F.sum("v"))


@query(f"SELECT dense_rank() OVER (ORDER BY u) - 1 AS idx, u AS k, CAST(total AS BIGINT) AS total FROM (SELECT u, sum(v) AS total FROM {EVENTS} GROUP BY u)")
def reduce_by_key_sorted(spark, d):
    """Sorted first, then reduced by adjacent key."""
    t = sort.sort_by_key(events(spark, d).select("idx", F.col("u").alias("k"), "v"), "k")
    return reduce.reduce_by_key(t, ["k"], total=F.sum("v"))


@query(f"""
{_RUNS.format(changed="abs(lag(v) OVER (ORDER BY idx) - v) > 500", source=EVENTS)}
SELECT run AS idx, min_by(v, idx) AS v, count(*) AS n FROM r GROUP BY run
""")
def reduce_by_key_custom(spark, d):
    """Neighbours count as equal within a distance."""
    return reduce.reduce_by_key(events(spark, d), ["v"], changed=F.abs(F.col("prev_v") - F.col("v")) > 500, n=F.count("*"))


# sorts


@query(f"SELECT row_number() OVER (ORDER BY v) - 1 AS idx, v FROM {ORDERS}")
def sort_keys(spark, d):
    return sort.sort(orders(spark, d), "v")


@query(f"SELECT row_number() OVER (ORDER BY v DESC) - 1 AS idx, v FROM {ORDERS}")
def sort_keys_desc(spark, d):
    return sort.sort(orders(spark, d), "v", descending=True)


@query(f"SELECT row_number() OVER (ORDER BY k, u, v) - 1 AS idx, k, u, v FROM {EVENTS}")
def sort_keys_tuple(spark, d):
    return sort.sort(events(spark, d), "k", "u", "v")


@query(f"SELECT row_number() OVER (ORDER BY s, idx) - 1 AS idx, s, v FROM {ORDERS}")
def sort_by_key(spark, d):
    """Stable: many equal keys keep their order."""
    return sort.sort_by_key(orders(spark, d), "s")


@query(f"SELECT row_number() OVER (ORDER BY k DESC, u, idx) - 1 AS idx, k, u, v FROM {EVENTS}")
def sort_by_key_tuple(spark, d):
    return sort.sort_by_key(events(spark, d), F.col("k").desc(), F.col("u").asc())


@query(f"SELECT row_number() OVER (ORDER BY u % 2, u, idx) - 1 AS idx, u, v FROM {EVENTS}")
def sort_even_first(spark, d):
    """The comparator that puts even keys before odd ones."""
    return sort.sort_by_key(events(spark, d).select("idx", "u", "v"), F.col("u") % 2, F.col("u"))
