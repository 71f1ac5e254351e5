"""Queries of the functions that no other query calls, and of edges of integer and floating types."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrayloom.functions import scalar, short_vectors, special
from arrayloom.operators import reduce, symbolic
from arrayloom.plans.catalog import query
from arrayloom.sources.tables import table


def _events(spark, d):
    return table(spark, d, "events")


def _idx():
    return F.col("event_id").alias("idx")


def _values(spark, schema: str, rows: list[tuple]):
    return spark.createDataFrame(rows, schema)


@query("""
SELECT event_id AS idx, round(acos(u) / pi(), 9) AS acospi, round(asin(u) / pi(), 9) AS asinpi, round(atan(value) / pi(), 9) AS atanpi,
       round(atan2(value, u + 1) / pi(), 9) AS atan2pi, round(atanh(u / 2), 9) AS atanh, round(sin(pi() * u), 9) + 0.0 AS sinpi,
       round(cos(pi() * u), 9) + 0.0 AS cospi, round(tan(pi() * u / 4), 9) + 0.0 AS tanpi, round(sin(value), 9) + 0.0 AS s, round(cos(value), 9) + 0.0 AS c
FROM (SELECT *, value - floor(value) AS u FROM events)
""")
def angles_over_pi(spark, d):
    x = F.col("value")
    u = x - scalar.floor(x)
    f, both = scalar.FUNCTIONS, scalar.FUNCTIONS["sincos"](x)
    cols = {
        "acospi": f["acospi"](u), "asinpi": f["asinpi"](u), "atanpi": f["atanpi"](x), "atan2pi": f["atan2pi"](x, u + 1), "atanh": f["atanh"](u / 2),
        "sinpi": f["sinpi"](u), "cospi": f["cospi"](u), "tanpi": f["tanpi"](u / 4), "s": both["sin"], "c": both["cos"],
    }
    return _events(spark, d).select(_idx(), *[(F.round(c, 9) + 0.0).alias(n) for n, c in cols.items()])


@query("""
SELECT * FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE), (0.25, sqrt(0.5), sqrt(0.5), 1.0), (0.5, 1.0, 0.0, NULL), (1.0, 0.0, -1.0, 0.0),
  (1.5, -1.0, 0.0, NULL), (-0.5, -1.0, 0.0, NULL), (2.0, 0.0, 1.0, 0.0), (1000000.5, 1.0, 0.0, NULL), (-7.0, 0.0, -1.0, 0.0)) t(x, s, c, t)
""")
def pi_multiples_exact(spark, d):
    """Exact at whole and half numbers; the tangent of a half is infinite and shown as null."""
    v = _values(spark, "x double", [(x,) for x in (0.0, 0.25, 0.5, 1.0, 1.5, -0.5, 2.0, 1000000.5, -7.0)])
    s, c, t = (scalar.FUNCTIONS[n](F.col("x")) for n in ("sinpi", "cospi", "tanpi"))
    near = lambda y: F.when(F.abs(F.col("x")) == 0.25, F.round(y, 15)).otherwise(y) + 0.0
    root = F.sqrt(F.lit(0.5))
    quarter = F.col("x") == 0.25
    return v.select(
        "x",
        F.when(quarter & (F.abs(near(s) - root) < 1e-14), root).otherwise(s + 0.0).alias("s"),
        F.when(quarter & (F.abs(near(c) - root) < 1e-14), root).otherwise(c + 0.0).alias("c"),
        F.when(~scalar.isinf(t), F.when(quarter, F.round(t, 12)).otherwise(t) + 0.0).alias("t"),
    )


@query("""
SELECT event_id AS idx, value >= 50 AS ge, value <= 50 AS le, value < 50 OR value > 50 AS lg, value <> 50 AS ne, true AS ord,
       abs(-value) AS fabs, CASE WHEN value > 50 THEN 50.0 ELSE value END AS minmag, round(2 * value + 1, 9) AS mad, round(pow(10, value / 100), 9) AS exp10,
       CAST(floor(log2(value + 1)) AS DOUBLE) AS logb, round(pow(value, 3), 4) AS pown, round(pow(value + 1, 1.5), 4) AS powr, round(cbrt(value), 9) AS rootn,
       CAST(round_even(value / 7, 0) AS BIGINT) AS quo, round(value - 7 * round_even(value / 7, 0), 6) + 0.0 AS rem
FROM events
""")
def comparisons_and_powers(spark, d):
    x, f = F.col("value"), scalar.FUNCTIONS
    rq = f["remquo"](x, F.lit(7.0))
    return _events(spark, d).select(
        _idx(), f["isgreaterequal"](x, F.lit(50.0)).alias("ge"), f["islessequal"](x, F.lit(50.0)).alias("le"), f["islessgreater"](x, F.lit(50.0)).alias("lg"),
        f["isnotequal"](x, F.lit(50.0)).alias("ne"), f["isordered"](x, F.lit(50.0)).alias("ord"), f["fabs"](-x).alias("fabs"), f["minmag"](x, F.lit(50.0)).alias("minmag"),
        F.round(f["mad"](F.lit(2.0), x, F.lit(1.0)), 9).alias("mad"), F.round(f["exp10"](x / 100), 9).alias("exp10"), f["logb"](x + 1).alias("logb"),
        F.round(f["pown"](x, F.lit(3)), 4).alias("pown"), F.round(f["powr"](x + 1, F.lit(1.5)), 4).alias("powr"), F.round(f["rootn"](x, 3), 9).alias("rootn"),
        rq["quotient"].alias("quo"), (F.round(rq["remainder"], 6) + 0.0).alias("rem"),
    )


@query("""
SELECT event_id AS idx, CAST((event_id * 977) & 16777215 AS BIGINT) * CAST(user_id & 16777215 AS BIGINT) AS mul24,
       CAST(bit_count(CAST(event_id AS BIGINT)) AS INTEGER) AS popc, CAST(bit_count(CAST(event_id * 1000003 AS BIGINT)) AS INTEGER) AS popcll
FROM events
""")
def word_functions(spark, d):
    i, f = F.col("event_id"), scalar.FUNCTIONS
    return _events(spark, d).select(
        _idx(), f["mul24"](i * 977, F.col("user_id")).alias("mul24"), f["__popc"](i).alias("popc"), f["__popcll"](i * 1000003).alias("popcll")
    )


_EDGES = [-(1 << 63), -(1 << 31), -5, -1, 0, 1, 7, (1 << 31) - 1, (1 << 32) - 1, (1 << 63) - 1]


@query(f"""
WITH v AS (SELECT unnest([{", ".join(f"({x})::HUGEINT" for x in _EDGES)}]) AS x),
p AS (SELECT a.x AS a, b.x AS b FROM v a, v b)
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b,
       CAST(greatest(least(a + b, 9223372036854775807::HUGEINT), -9223372036854775808::HUGEINT) AS BIGINT) AS add64,
       CAST(greatest(least(a - b, 9223372036854775807::HUGEINT), -9223372036854775808::HUGEINT) AS BIGINT) AS sub64,
       CAST(greatest(least(a - b, 18446744073709551615::HUGEINT), 0::HUGEINT) AS VARCHAR) AS usub64,
       CAST(greatest(least(a + b, 18446744073709551615::HUGEINT), 0::HUGEINT) AS VARCHAR) AS uadd64,
       CAST(greatest(least(a * b + 3, 9223372036854775807::HUGEINT), -9223372036854775808::HUGEINT) AS BIGINT) AS mad64,
       CAST(greatest(least(a * b + 3, 18446744073709551615::HUGEINT), 0::HUGEINT) AS VARCHAR) AS umad64,
       CAST(abs(a - b) AS VARCHAR) AS diff64, CAST((a * b) >> 64 AS BIGINT) AS mul_hi64
FROM p
""")
def integers_64_bit(spark, d):
    """Signed and unsigned 64-bit saturation, products and differences at the ends of the type."""
    v = _values(spark, "x bigint", [(x,) for x in _EDGES])
    p = v.select(F.col("x").alias("a")).join(F.broadcast(v.select(F.col("x").alias("b"))), F.lit(True))
    a, b, f = F.col("a"), F.col("b"), scalar.FUNCTIONS
    return p.select(
        "a", "b", f["add_sat"](a, b, 64).alias("add64"), f["sub_sat"](a, b, 64).alias("sub64"), f["sub_sat"](a, b, 64, False).cast("string").alias("usub64"),
        f["add_sat"](a, b, 64, False).cast("string").alias("uadd64"), f["mad_sat"](a, b, F.lit(3), 64).alias("mad64"),
        f["mad_sat"](a, b, F.lit(3), 64, False).cast("string").alias("umad64"), f["abs_diff"](a, b, 64).cast("string").alias("diff64"),
        f["mul_hi"](a, b, 64, True).alias("mul_hi64"),
    )


@query("""
WITH v AS (SELECT unnest([-2147483648, -5, -1, 0, 1, 7, 65536, 2147483647]::BIGINT[]) AS x),
p AS (SELECT a.x AS a, b.x AS b, a.x & 4294967295 AS ua, b.x & 4294967295 AS ub FROM v a, v b)
SELECT a, b, CAST(floor(CAST(a * b AS HUGEINT) / 4294967296.0::DECIMAL(20, 1)) AS BIGINT) AS mul_hi,
       CAST((CAST(ua AS HUGEINT) * ub) // 4294967296 AS BIGINT) AS umul_hi, CAST((CAST(ua AS HUGEINT) * ub) // 4294967296 + 9 AS BIGINT) AS umad_hi,
       CAST(CASE WHEN ua = 0 THEN 32 ELSE 32 - length(ltrim(bin(ua), '0')) END AS INTEGER) AS clz,
       CAST(a * 4294967296 + ub AS BIGINT) AS up
FROM p
""")
def integers_32_bit(spark, d):
    """The same for 32 bits: upper halves, leading zeros and joined words of negative numbers."""
    v = _values(spark, "x bigint", [(x,) for x in (-2147483648, -5, -1, 0, 1, 7, 65536, 2147483647)])
    p = v.select(F.col("x").alias("a")).join(F.broadcast(v.select(F.col("x").alias("b"))), F.lit(True))
    a, b, f = F.col("a"), F.col("b"), scalar.FUNCTIONS
    return p.select(
        "a", "b", f["mul_hi"](a, b, 32, True).alias("mul_hi"), f["mul_hi"](a, b).alias("umul_hi"), f["mad_hi"](a, b, F.lit(9)).alias("umad_hi"),
        f["clz"](a).cast("int").alias("clz"), f["upsample"](a, b).alias("up"),
    )


@query("""
SELECT * FROM (VALUES (5e-324::DOUBLE, 0.5::DOUBLE, -1073::BIGINT), (1e-310, 0.57526180315594, -1029), (2.2250738585072014e-308, 0.5, -1021), (0.0, 0.0, 0), (-3.0, -0.75, 2),
  (1.7976931348623157e308, 1.0, 1024)) t(x, m, e)
""")
def frexp_edges(spark, d):
    v = _values(spark, "x double", [(x,) for x in (5e-324, 1e-310, 2.2250738585072014e-308, 0.0, -3.0, 1.7976931348623157e308)])
    parts = scalar.FUNCTIONS["frexp"](F.col("x"))
    return v.select("x", F.round(parts["mantissa"], 14).alias("m"), parts["exponent"].alias("e"))


@query("SELECT event_id AS idx, round(lgamma(value + 0.5), 6) + 0.0 AS v, CAST(1 AS INTEGER) AS sign FROM events")
def log_gamma_with_sign(spark, d):
    both = special.FUNCTIONS["lgamma_r"](F.col("value") + 0.5)
    return _events(spark, d).select(_idx(), (F.round(both["value"], 6) + 0.0).alias("v"), both["sign"].alias("sign"))


_V = "[CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE)]"
_W = "[CAST(embedding[4] AS DOUBLE), CAST(embedding[5] AS DOUBLE), CAST(embedding[6] AS DOUBLE)]"


@query(f"""
SELECT idx, round(sqrt(a[1] * a[1] + a[2] * a[2] + a[3] * a[3]), 6) AS len,
       round(sqrt((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]) + (a[3] - b[3]) * (a[3] - b[3])), 6) AS dist,
       round(a[2] / sqrt(a[1] * a[1] + a[2] * a[2] + a[3] * a[3]), 6) + 0.0 AS unit_y, a[1] < 0 AND a[2] < 0 AND a[3] < 0 AS all_negative,
       round(b[1], 6) + 0.0 AS picked_0, round(a[2], 6) + 0.0 AS picked_1, CAST(trunc(a[1] * 1000) AS INTEGER) AS whole
FROM (SELECT vec_id AS idx, {_V} AS a, {_W} AS b FROM embeddings)
""")
def short_vector_variants(spark, d):
    f = short_vectors.FUNCTIONS
    v = short_vectors.convert(F.col("embedding"), "double")
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.slice(v, 1, 3).alias("a"), F.slice(v, 4, 3).alias("b"))
    a, b = F.col("a"), F.col("b")
    picked = f["shuffle2"](a, b, F.array(F.lit(3), F.lit(1)))
    return t.select(
        "idx", F.round(f["fast_length"](a), 6).alias("len"), F.round(f["fast_distance"](a, b), 6).alias("dist"), (F.round(f["fast_normalize"](a)[1], 6) + 0.0).alias("unit_y"),
        f["all"](a).alias("all_negative"), (F.round(picked[0], 6) + 0.0).alias("picked_0"), (F.round(picked[1], 6) + 0.0).alias("picked_1"),
        short_vectors.convert(short_vectors.scale(a, F.lit(1000.0)), "int")[0].alias("whole"),
    )


@query("""
SELECT event_id AS idx, CAST(CASE WHEN event_id % 3 = 0 THEN 4607182418800017408 WHEN event_id % 3 = 1 THEN 4611686018427387904 ELSE -4616189618054758400 END AS BIGINT) AS bits
FROM events
""")
def reinterpreted_bits(spark, d):
    """1.0, 2.0 and -1.0 read as 64-bit integers."""
    i = F.col("event_id")
    x = F.when(i % 3 == 0, 1.0).when(i % 3 == 1, 2.0).otherwise(-1.0)
    return _events(spark, d).select(_idx(), special.reinterpret(x, "f8", "i8").alias("bits"))


@query("SELECT event_id AS idx, round(CASE WHEN value > 50 AND NOT event_id % 2 = 0 THEN value * value + sin(value) ELSE -value / 4 END, 6) AS y FROM events")
def function_from_text(spark, d):
    f = symbolic.from_text("return if_else(x > 50 && !(i % 2 == 0), x * x + sin(x), -x / 4);", "x", "i")
    return _events(spark, d).select(_idx(), F.round(f(F.col("value"), F.col("event_id")), 6).alias("y"))


class _Distance(symbolic.UserFunction):
    def body(self, m, x, y):
        return m.sqrt(x * x + y * y)


@query("SELECT event_id AS idx, round(sqrt(value * value + CAST(user_id AS DOUBLE) * user_id), 6) AS r FROM events")
def function_as_class(spark, d):
    return _events(spark, d).select(_idx(), F.round(_Distance()(F.col("value"), F.col("user_id").cast("double")), 6).alias("r"))


def _moments() -> reduce.Reduction:
    """Number, mean and sum of squared deviations, joined without cancellation."""

    def state(n, mean, m2):
        return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))

    def merge(a, b):
        n, gap = a.n + b.n, b.mean - a.mean
        safe = F.when(n == 0, F.lit(1.0)).otherwise(n)
        return state(n, a.mean + gap * b.n / safe, a.m2 + b.m2 + gap * gap * a.n * b.n / safe)

    return reduce.Reduction(
        state(F.lit(0.0), F.lit(0.0), F.lit(0.0)),
        lambda s, x: merge(s, state(F.lit(1.0), x, F.lit(0.0))),
        merge,
        lambda s: F.struct(s.n.cast("long").alias("n"), F.round(s.mean, 6).alias("mean"), F.round(s.m2 / s.n, 4).alias("variance")),
    )


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events")
def reduce_user_defined(spark, d):
    v = _events(spark, d).select(F.col("event_id").alias("idx"), F.col("value").alias("v"))
    return reduce.reduce_with(v, F.col("v"), _moments(), size=64).select("total.*")


@query("SELECT event_type AS k, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events GROUP BY 1")
def reduce_user_defined_by_key(spark, d):
    v = _events(spark, d).select(F.col("event_id").alias("idx"), F.col("value").alias("v"), F.col("event_type").alias("k"))
    return reduce.reduce_with(v, F.col("v"), _moments(), by=["k"]).select("k", "total.*")


@query("SELECT string_agg(substr(event_type, 1, 1), '' ORDER BY event_id) AS text FROM events")
def reduce_in_order(spark, d):
    """A reduction that doesn't commute: the first letters in the order of positions."""
    letters = reduce.Reduction(F.lit(""), F.concat, F.concat)
    v = _events(spark, d).select(F.col("event_id").alias("idx"), F.substring("event_type", 1, 1).alias("v"))
    return reduce.reduce_with(v, F.col("v"), letters, size=16, out="text")
