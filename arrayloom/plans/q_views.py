"""Permutations, slices, reshapes, gathers, scatters and copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrayloom.operators import views
from arrayloom.operators.views import Range
from arrayloom.plans.catalog import query
from arrayloom.plans.q_reduce import events, orders
from arrayloom.sources import vectors
from arrayloom.sources.tables import table

V = "(SELECT event_id AS idx, user_id AS u, CAST(round(value * 100) AS BIGINT) AS v FROM events)"
#: All positions as a grid of 8 columns, and as a cube of n / 8 x 4 x 2.
G = f"(SELECT idx, v, idx // 8 AS i, idx % 8 AS j, (SELECT CAST(ceil(count(*) / 8) AS BIGINT) FROM events) AS rows FROM {V})"
CUBE = f"(SELECT idx, v, idx // 8 AS i, idx // 2 % 4 AS j, idx % 2 AS k, (SELECT CAST(ceil(count(*) / 8) AS BIGINT) FROM events) AS rows FROM {V})"
B = "(SELECT CAST(vec_id AS BIGINT) AS r, CAST(c.range AS BIGINT) AS c, CAST(embedding[c.range + 1] AS DOUBLE) AS v FROM embeddings, range(64) c)"


def values(spark, d):
    return events(spark, d).select("idx", "v")


def size(spark, d) -> int:
    return table(spark, d, "events").count()


def grid_shape(spark, d) -> list[int]:
    return [-(-size(spark, d) // 8), 8]


def box_shape(spark, d) -> list[int]:
    return [-(-size(spark, d) // 8), 4, 2]


@query(f"SELECT (SELECT count(*) FROM events) - 1 - idx AS idx, v FROM {V}")
def permutation_reverse(spark, d):
    n = table(spark, d, "events").count()
    return views.reversed_(values(spark, d), n)


@query(f"SELECT p.idx, s.v FROM {V} p JOIN {V} s ON s.idx = p.u")
def permutation_gather(spark, d):
    """The values at the positions that a vector names."""
    e = events(spark, d)
    return views.gathered(values(spark, d), e.select("idx", F.col("u").alias("i"))).select("idx", "v")


@query(f"SELECT t.idx, coalesce(w.v, t.v) AS v FROM {V} t LEFT JOIN (SELECT u AS at, -max_by(v, idx) AS v FROM {V} GROUP BY u) w ON w.at = t.idx")
def permutation_write(spark, d):
    e = events(spark, d)
    return views.scattered(values(spark, d), e.select("idx", F.col("u").alias("i")), e.select("idx", (-F.col("v")).alias("v")))


_GATHER = "(SELECT range AS idx, (range * 7919) % 1000 AS i FROM range(100))"


@query(f"SELECT g.idx, s.v FROM {_GATHER} g JOIN {V} s ON s.idx = g.i")
def gather(spark, d):
    index = spark.range(100).select(F.col("id").alias("idx"), ((F.col("id") * 7919) % 1000).alias("i"))
    return views.gathered(values(spark, d), index).select("idx", "v")


@query(f"SELECT t.idx, coalesce(g.idx * 10, t.v) AS v FROM {V} t LEFT JOIN {_GATHER} g ON g.i = t.idx")
def scatter(spark, d):
    index = spark.range(100).select(F.col("id").alias("idx"), ((F.col("id") * 7919) % 1000).alias("i"))
    return views.scattered(values(spark, d), index, index.select("idx", (F.col("idx") * 10).alias("v")))


@query(f"SELECT idx - 100 AS idx, v FROM {V} WHERE idx >= 100 AND idx < 300")
def copy_range(spark, d):
    return vectors.copy_range(values(spark, d), 100, 300)


@query(f"SELECT idx, v FROM {V} WHERE idx = 42")
def element_access(spark, d):
    return vectors.element(values(spark, d), 42)


@query("""
SELECT vec_id * 4 + c.range AS idx, round(CAST(embedding[c.range + 1] AS DOUBLE), 6) + 0.0 AS v FROM embeddings, range(4) c
""")
def reinterpret_components(spark, d):
    """Short vectors of four read as one vector of numbers."""
    t = vectors.vector(table(spark, d, "embeddings"), "vec_id", v=F.slice("embedding", 1, 4).cast("array<double>"))
    return vectors.interleave_components(t).select("idx", (F.round("v", 6) + 0.0).alias("v"))


@query(f"SELECT idx, v AS c0, w AS c1 FROM {V} a JOIN (SELECT idx - (SELECT count(*) // 2 FROM events) AS idx, v AS w FROM {V}) b USING (idx)")
def multivector_copy(spark, d):
    return vectors.split_components(values(spark, d), 2)


@query(f"SELECT (idx - 3) // 5 AS idx, v FROM {V} WHERE idx >= 3 AND idx < 503 AND (idx - 3) % 5 = 0")
def slice_stride(spark, d):
    n = table(spark, d, "events").count()
    return views.sliced(values(spark, d), [n], Range(3, 503, 5))[0]


@query(f"SELECT j AS idx, v FROM {G} WHERE i = 7")
def slice_row(spark, d):
    return views.sliced(values(spark, d), grid_shape(spark, d), 7)[0]


@query(f"SELECT i AS idx, v FROM {G} WHERE j = 5")
def slice_col(spark, d):
    return views.sliced(values(spark, d), grid_shape(spark, d), None, 5)[0]


@query(f"SELECT (i - 2) // 2 * 4 + (j - 1) // 2 AS idx, v FROM {G} WHERE i BETWEEN 2 AND 10 AND i % 2 = 0 AND j % 2 = 1")
def slice_block(spark, d):
    return views.sliced(values(spark, d), grid_shape(spark, d), Range(2, 11, 2), Range(1, 8, 2))[0]


@query(f"SELECT (5 - i) // 2 * 8 + j AS idx, v FROM {G} WHERE i IN (5, 3, 1)")
def slice_negative_stride(spark, d):
    return views.sliced(values(spark, d), grid_shape(spark, d), Range(5, 0, -2))[0]


@query(f"SELECT idx, CASE WHEN i = 3 AND j >= 2 AND j < 6 THEN (j - 2) * 100 ELSE v END AS v FROM {G}")
def slice_assign(spark, d):
    rhs = spark.range(4).select(F.col("id").alias("idx"), (F.col("id") * 100).alias("v"))
    return views.slice_assigned(values(spark, d), grid_shape(spark, d), [3, Range(2, 6)], rhs)


@query(f"SELECT r.range AS idx, v FROM range(10) r JOIN {V} t ON t.idx = 2 + r.range * 3")
def gslice_1d(spark, d):
    return views.gslice(values(spark, d), 2, [10], [3]).select("idx", "v")


@query(f"SELECT r.range AS idx, v FROM range(15) r JOIN {V} t ON t.idx = 100 + r.range // 5 * 32 + r.range % 5 * 2")
def gslice_2d(spark, d):
    return views.gslice(values(spark, d), 100, [3, 5], [32, 2]).select("idx", "v")


@query(f"SELECT j * rows + i AS idx, v FROM {G}")
def transpose(spark, d):
    return views.reshaped(values(spark, d), grid_shape(spark, d)[::-1], [1, 0])


@query(f"SELECT r.range * (SELECT count(*) FROM events) + idx AS idx, v FROM {V}, range(8) r")
def broadcast_rows(spark, d):
    """The vector as a row, repeated as eight."""
    return views.reshaped(values(spark, d), [8, size(spark, d)], [1])


@query(f"SELECT idx * 8 + r.range AS idx, v FROM {V}, range(8) r")
def broadcast_cols(spark, d):
    return views.reshaped(values(spark, d), [size(spark, d), 8], [0])


@query(f"SELECT (k * 4 + j) * rows + i AS idx, v FROM {CUBE}")
def reshape_cube(spark, d):
    """A cube with its axes in reverse order."""
    return views.reshaped(values(spark, d), box_shape(spark, d)[::-1], [2, 1, 0])


@query(f"SELECT i AS idx, CAST(sum(v) AS BIGINT) AS total FROM {G} GROUP BY i")
def reduce_rows(spark, d):
    return views.reduced(values(spark, d), grid_shape(spark, d), [1], total=F.sum("v"))[0]


@query(f"SELECT j AS idx, CAST(sum(v) AS BIGINT) AS total, max(v) AS hi FROM {G} GROUP BY j")
def reduce_cols(spark, d):
    return views.reduced(values(spark, d), grid_shape(spark, d), [0], total=F.sum("v"), hi=F.max("v"))[0]


@query(f"SELECT j AS idx, CAST(sum(v) AS BIGINT) AS total FROM {CUBE} GROUP BY j")
def reduce_multi_dim(spark, d):
    return views.reduced(values(spark, d), box_shape(spark, d), [2, 0], total=F.sum("v"))[0]


@query(f"SELECT CAST(0 AS BIGINT) AS idx, CAST(sum(v) AS BIGINT) AS total FROM {CUBE}")
def reduce_all_dims(spark, d):
    return views.reduced(values(spark, d), box_shape(spark, d), [0, 1, 2], total=F.sum("v"))[0]


@query(f"SELECT CAST(0 AS BIGINT) AS idx, max(total) AS total FROM (SELECT i, CAST(sum(v) AS BIGINT) AS total FROM {CUBE} GROUP BY i)")
def reduce_nested(spark, d):
    inner, shape = views.reduced(values(spark, d), box_shape(spark, d), [1, 2], total=F.sum("v"))
    return views.reduced(inner, shape, [0], total=F.max("total"))[0]


@query(f"SELECT k * 4 + j AS idx, v FROM {CUBE} WHERE i = 2")
def multi_array_transpose_copy(spark, d):
    """A plane of a cube, copied with its axes exchanged."""
    plane, shape = views.sliced(values(spark, d), box_shape(spark, d), 2)
    return views.reshaped(plane, shape[::-1], [1, 0])


@query(f"SELECT idx, CAST(sum(v) OVER () - v AS BIGINT) AS v FROM {V}")
def nbody(spark, d):
    """The sum over all other elements: the total less one's own, no pairs."""
    t = values(spark, d)
    total = t.agg(F.sum("v").alias("total"))
    return t.join(F.broadcast(total)).select("idx", (F.col("total") - F.col("v")).alias("v"))  # one row


@query("SELECT CAST(o_orderkey AS BIGINT) AS idx, o_orderkey * 2 AS v FROM orders")
def vector_from_expression(spark, d):
    return orders(spark, d).select("idx", (F.col("idx") * 2).alias("v"))


@query(f"SELECT idx, v FROM {V} UNION ALL SELECT CAST(n + r.range AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT count(*) AS n FROM events), range(10) r")
def vector_grown(spark, d):
    """New positions hold zero."""
    return vectors.resized(values(spark, d), size(spark, d) + 10)


@query(f"SELECT idx, v FROM {V} WHERE idx < (SELECT count(*) // 2 FROM events)")
def vector_shrunk(spark, d):
    return vectors.resized(values(spark, d), size(spark, d) // 2)


@query(f"SELECT idx, CAST(0 AS BIGINT) AS v FROM {V}")
def vector_cleared(spark, d):
    return vectors.cleared(values(spark, d))


@query(f"SELECT a.idx, b.v AS a, a.v AS b FROM {V} a JOIN (SELECT idx, -v AS v FROM {V}) b USING (idx)")
def vector_swap(spark, d):
    """Two vectors change places: a renaming."""
    v = values(spark, d).select("idx", F.col("v").alias("a"), (-F.col("v")).alias("b"))
    return v.select("idx", F.col("b").alias("a"), F.col("a").alias("b"))


@query(f"""
SELECT idx // 10 AS line, printf('%6d: %s', CAST(idx // 10 * 10 AS INTEGER), string_agg(printf('%12.4g', CAST(v AS DOUBLE)), ' ' ORDER BY idx)) AS text
FROM (SELECT idx, v % 1000 AS v FROM {V}) GROUP BY idx // 10
""")
def vector_printed(spark, d):
    v = values(spark, d).withColumn("v", (F.col("v") % 1000).cast("double"))
    return vectors.text_table(v)


@query("""
SELECT * FROM (VALUES ('column beyond the grid', true), ('grid as it is', false), ('row beyond the grid', true), ('sizes differ', true), ('sizes agree', false)) t(attempt, refused)
""")
def bounds_checked(spark, d):
    """What lies outside of a vector is refused while the plan is built."""
    v, shape = values(spark, d), grid_shape(spark, d)
    half = v.where(F.col("idx") < size(spark, d) // 2)
    attempts = {
        "row beyond the grid": lambda: views.sliced(v, shape, shape[0]),
        "column beyond the grid": lambda: views.sliced(v, shape, None, 8),
        "grid as it is": lambda: views.sliced(v, shape, shape[0] - 1, 7),
        "sizes differ": lambda: vectors.properties(v, half),
        "sizes agree": lambda: vectors.properties(v, v),
    }

    def refused(attempt) -> bool:
        try:
            attempt()
        except (ValueError, IndexError):
            return True
        return False

    return spark.createDataFrame([(k, refused(f)) for k, f in attempts.items()], "attempt string, refused boolean")


@query("SELECT count(*) AS size, CAST(2 AS INTEGER) AS components, 'bigint,double' AS types FROM events")
def expression_properties(spark, d):
    e = table(spark, d, "events")
    a = vectors.vector(e, "event_id", a="user_id")
    b = vectors.vector(e, "event_id", b="value")
    p = vectors.properties(a, b)
    return spark.createDataFrame([(p.size, p.components, ",".join(p.types.values()))], "size bigint, components int, types string")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(2 * value + 1), 4) AS total FROM events GROUP BY 1, 2")
def streaming_windows(spark, d):
    """Events as a stream: a projection, then sums by day and type, batch by batch into a table."""
    from arrayloom.sources.scratch import folder
    from arrayloom.streaming import micro_batches

    at = folder(spark, "stream")
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events[.]parquet")  # a pattern, as the table may be one file
    made = micro_batches.elementwise(stream, y=2 * F.col("value") + 1)
    micro_batches.to_table(made, f"{at}/rows", f"{at}/state")
    rows = spark.read.parquet(f"{at}/rows")
    by_day = micro_batches.windowed_fold(rows, "ts", "1 day", "1 day", ["event_type"], n=F.count("*"), total=F.sum("y"))
    return by_day.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
