"""Sparse products, contractions and stencils."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrayloom.operators import sparse, stencil, tensor
from arrayloom.plans.catalog import query
from arrayloom.plans.q_reduce import events
from arrayloom.plans.q_views import B
from arrayloom.sources import vectors
from arrayloom.sources.tables import table

#: Order x part, with the summed quantity; exact in sums as quantities are whole.
S = "(SELECT l_orderkey AS row, l_partkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY ALL)"
X = "(SELECT p_partkey AS idx, p_retailprice AS v, CAST(p_size AS DOUBLE) AS w FROM part)"
SX = f"(SELECT row, sum(val * v) AS y, sum(val * w) AS z FROM {S} JOIN {X} ON idx = col GROUP BY row)"
ALL_ROWS = f"FROM orders LEFT JOIN {SX} ON row = o_orderkey"


def matrix(spark, d, by="l_partkey"):
    """Parts of a bounded size by the key that the product joins on, which does for the sums too."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    t = t.repartition(sparse.parts(t.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))), by)
    return t.groupBy(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").alias("val"))


def prices(spark, d):
    return vectors.vector(table(spark, d, "part"), "p_partkey", v="p_retailprice", w=F.col("p_size").cast("double"))


def n_orders(spark, d):
    return table(spark, d, "orders").count()


@query(f"SELECT o_orderkey AS idx, round(coalesce(y, 0), 4) AS v {ALL_ROWS}")
def spmv(spark, d):
    return sparse.product(matrix(spark, d), prices(spark, d), n_orders(spark, d)).select("idx", F.round("v", 4).alias("v"))


@query(f"SELECT o_orderkey AS idx, round(o_totalprice - coalesce(y, 0), 4) AS v {ALL_ROWS}")
def spmv_residual(spark, d):
    o = vectors.vector(table(spark, d, "orders"), "o_orderkey", t="o_totalprice")
    y = sparse.product(matrix(spark, d), prices(spark, d), n_orders(spark, d))
    return vectors.aligned(o, y).select("idx", F.round(F.col("t") - F.col("v"), 4).alias("v"))


@query(f"SELECT o_orderkey AS idx, round(o_totalprice + 2 * coalesce(y, 0) - coalesce(y, 0), 4) AS v {ALL_ROWS}")
def spmv_append(spark, d):
    o = vectors.vector(table(spark, d, "orders"), "o_orderkey", t="o_totalprice")
    y = sparse.product(matrix(spark, d), prices(spark, d), n_orders(spark, d))
    return vectors.aligned(o, y).select("idx", F.round(F.col("t") + 2 * F.col("v") - F.col("v"), 4).alias("v"))


@query(f"SELECT o_orderkey AS idx, round(sin(coalesce(z, 0)), 6) + 0.0 AS v {ALL_ROWS}")
def spmv_inline_sin(spark, d):
    y = sparse.product(matrix(spark, d), prices(spark, d), n_orders(spark, d), "w")
    return y.select("idx", (F.round(F.sin("w"), 6) + 0.0).alias("v"))


@query(f"SELECT o_orderkey AS idx, round(coalesce(y, 0), 4) AS v, coalesce(z, 0) AS w {ALL_ROWS}")
def spmm(spark, d):
    """Two vectors in one join."""
    return sparse.product(matrix(spark, d), prices(spark, d), n_orders(spark, d), "v", "w").select("idx", F.round("v", 4).alias("v"), "w")


@query(f"SELECT o_orderkey AS idx FROM orders LEFT JOIN {SX} ON row = o_orderkey WHERE coalesce(z, 0) = 0")
def spmv_empty_rows(spark, d):
    return sparse.product(matrix(spark, d), prices(spark, d), n_orders(spark, d), "w").where("w = 0").select("idx")


@query(f"SELECT p_partkey AS idx, coalesce(sum(val * o_custkey), 0) AS v FROM part LEFT JOIN {S} ON col = p_partkey LEFT JOIN orders ON o_orderkey = row GROUP BY 1")
def spmv_nonsquare(spark, d):
    """The transpose: parts by orders."""
    a = matrix(spark, d, "l_orderkey").select(F.col("col").alias("row"), F.col("row").alias("col"), "val")
    x = vectors.vector(table(spark, d, "orders"), "o_orderkey", v=F.col("o_custkey").cast("double"))
    return sparse.product(a, x, table(spark, d, "part").count())


_N = 16


@query(f"""
WITH g AS (SELECT range AS idx, range // {_N * _N} AS z, range // {_N} % {_N} AS y, range % {_N} AS x, CAST(range % 7 AS DOUBLE) AS v FROM range({_N**3})),
f AS (SELECT *, x IN (0, {_N - 1}) OR y IN (0, {_N - 1}) OR z IN (0, {_N - 1}) AS edge FROM g)
SELECT f.idx, CASE WHEN edge THEN v ELSE 6.0 * v - (SELECT sum(g.v) FROM g WHERE g.idx IN (f.idx - 1, f.idx + 1, f.idx - {_N}, f.idx + {_N}, f.idx - {_N * _N}, f.idx + {_N * _N})) END AS v
FROM f
""")
def spmv_ccsr_poisson(spark, d):
    """Two distinct rows: the identity on the boundary and seven points inside."""
    i = F.col("id")
    at = [i % _N, F.floor(i / _N) % _N, F.floor(i / (_N * _N))]
    edge = F.lit(False)
    for a in at:
        edge = edge | (a == 0) | (a == _N - 1)
    g = spark.range(_N**3).select(i.alias("idx"), F.when(edge, 0).otherwise(1).alias("pattern"), (i % 7).cast("double").alias("v"))
    entries = [(0, 0, 1.0), (1, 0, 6.0)] + [(1, s * k, -1.0) for k in (1, _N, _N * _N) for s in (-1, 1)]
    patterns = spark.createDataFrame(entries, "pattern int, shift bigint, val double")
    return sparse.repeated_rows_product(g.select("idx", "pattern"), patterns, g.select("idx", "v"))


@query(f"SELECT o_orderkey AS idx, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM orders LEFT JOIN (SELECT row, sum(val * w) AS a, sum((val + 1) * 2 * w) AS b FROM {S} JOIN {X} ON idx = col GROUP BY row) ON row = o_orderkey")
def spmv_componentwise(spark, d):
    """Entries and elements of two components, multiplied one by one."""
    a = matrix(spark, d).withColumn("val", F.array(F.col("val"), F.col("val") + 1))
    x = prices(spark, d).select("idx", F.array(F.col("w"), 2 * F.col("w")).alias("v"))
    y = sparse.product(a, x, n_orders(spark, d), ring=sparse.componentwise(2))
    return y.select("idx", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))


_TRI = """(SELECT r.range AS row, r.range + o.range - 1 AS col, CASE WHEN o.range = 1 THEN 2.0 ELSE -1.0 END AS val
FROM range(1024) r, range(3) o WHERE r.range + o.range - 1 BETWEEN 0 AND 1023)"""


def tridiagonal(spark, n=1024):
    o = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    t = spark.range(n).select(F.col("id").alias("row"), o.alias("o")).select("row", (F.col("row") + F.col("o")).alias("col"), "o")
    return t.where(f"col >= 0 and col < {n}").select("row", "col", F.when(F.col("o") == 0, 2.0).otherwise(-1.0).alias("val"))


@query(f"SELECT row AS idx, sum(val * (col % 5) + val * (col % 3))::DOUBLE AS a, sum(val * (col % 5) + val * (col % 3))::DOUBLE AS b FROM {_TRI} GROUP BY row")
def spmv_block2x2(spark, d):
    """Blocks of 2 x 2, every entry of a block equal."""
    a = tridiagonal(spark).withColumn("val", F.array(*[F.col("val")] * 4))
    x = spark.range(1024).select(F.col("id").alias("idx"), F.array((F.col("id") % 5).cast("double"), (F.col("id") % 3).cast("double")).alias("v"))
    y = sparse.product(a, x, 1024, ring=sparse.blocks(2))
    return y.select("idx", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))


@query("SELECT range AS idx, CAST(range - range AS DOUBLE) AS re, CAST(range + range AS DOUBLE) AS im FROM range(64)")
def spmv_complex(spark, d):
    """A diagonal of k + k i times 1 + i."""
    k = F.col("id").cast("double")
    a = spark.range(64).select(F.col("id").alias("row"), F.col("id").alias("col"), F.struct(k.alias("re"), k.alias("im")).alias("val"))
    x = spark.range(64).select(F.col("id").alias("idx"), F.struct(F.lit(1.0).alias("re"), F.lit(1.0).alias("im")).alias("v"))
    return sparse.product(a, x, 64, ring=sparse.complex_()).select("idx", "v.re", "v.im")


@query(f"SELECT row AS idx, sum(val * (col + 1))::DOUBLE AS v FROM {_TRI} GROUP BY row")
def spmv_of_expression(spark, d):
    """A times (x + 1)."""
    x = spark.range(1024).select(F.col("id").alias("idx"), (F.col("id") + 1).cast("double").alias("v"))
    return sparse.product(tridiagonal(spark), x, 1024)


# contractions


def dense(spark, d):
    """All embeddings as a matrix of 64 columns, and its number of rows."""
    t = table(spark, d, "embeddings")
    m = t.select((F.col("vec_id") * 64).alias("at"), F.posexplode("embedding").alias("p", "x"))
    return m.select((F.col("at") + F.col("p")).alias("idx"), F.col("x").cast("double").alias("v")), t.count()


def _rounded(out):
    return out.select("idx", (F.round("v", 6) + 0.0).alias("v"))


@query(f"SELECT a.c * 64 + b.c AS idx, round(sum(a.v * b.v), 6) + 0.0 AS v FROM {B} a JOIN {B} b ON a.r = b.r GROUP BY 1")
def matmul(spark, d):
    """The transpose of M times M: 64 x 64, whatever the number of rows."""
    m, n = dense(spark, d)
    return _rounded(tensor.tensordot(m, [n, 64], m, [n, 64], [(0, 0)])[0])


@query(f"SELECT r AS idx, round(sum(v * (c % 4)), 6) + 0.0 AS v FROM {B} GROUP BY r")
def matvec(spark, d):
    m, n = dense(spark, d)
    x = spark.range(64).select(F.col("id").alias("idx"), (F.col("id") % 4).cast("double").alias("v"))
    return _rounded(tensor.tensordot(m, [n, 64], x, [64], [(1, 0)])[0])


@query(f"SELECT c AS idx, round(sum(v * (r % 4)), 6) + 0.0 AS v FROM {B} GROUP BY c")
def vecmat(spark, d):
    m, n = dense(spark, d)
    x = spark.range(n).select(F.col("id").alias("idx"), (F.col("id") % 4).cast("double").alias("v"))
    return _rounded(tensor.tensordot(x, [n], m, [n, 64], [(0, 0)])[0])


@query(f"""
WITH x AS (SELECT r AS i, c // 8 AS j, c % 8 AS k, v FROM {B})
SELECT x.k * 8 + y.j AS idx, round(sum(x.v * y.v), 6) + 0.0 AS v FROM x JOIN x y ON x.i = y.i AND x.j = y.k GROUP BY 1
""")
def tensordot_2axes(spark, d):
    """Two pairs of axes, one of them crosswise: (0, 0) and (1, 2) of n x 8 x 8."""
    t, n = dense(spark, d)
    return _rounded(tensor.tensordot(t, [n, 8, 8], t, [n, 8, 8], [(0, 0), (1, 2)])[0])


@query(f"SELECT a.c * 64 + b.c AS idx, round(sum(a.v * b.v), 6) + 0.0 AS v FROM {B} a JOIN {B} b ON a.r = b.r GROUP BY 1")
def matmul_reshape(spark, d):
    """The same product by replicating both factors to three axes and reducing one."""
    from arrayloom.operators import views

    m, n = dense(spark, d)
    both = views.met(m.withColumnRenamed("v", "x"), [1, 0], m.withColumnRenamed("v", "y"), [1, 2], [64, n, 64])
    return _rounded(views.reduced(both, [64, n, 64], [1], v=F.sum(F.col("x") * F.col("y")))[0])


# stencils

V = "(SELECT event_id AS idx, CAST(round(value * 100) AS BIGINT) AS v, (SELECT count(*) FROM events) AS n FROM events)"


def _at(k: int) -> str:
    return f"(SELECT o.v FROM {V} o WHERE o.idx = least(greatest(t.idx + ({k}), 0), t.n - 1))"


def _sum(taps, center: int) -> str:
    cases = " ".join(f"WHEN {j} THEN {w}" for j, w in enumerate(taps))
    return f"""SELECT t.idx, sum(o.v * (CASE j.range {cases} END))::DOUBLE AS y FROM {V} t, range({len(taps)}) j
JOIN {V} o ON o.idx = least(greatest(t.idx + j.range - {center}, 0), t.n - 1) GROUP BY t.idx"""


def _events(spark, d):
    return events(spark, d).select("idx", "v"), table(spark, d, "events").count()


@query(f"SELECT idx, round(y / 3, 6) AS y FROM ({_sum([1.0, 1.0, 1.0], 1)})")
def stencil_moving_average(spark, d):
    t, n = _events(spark, d)
    return stencil.convolved(t, [1.0, 1.0, 1.0], 1, n).select("idx", F.round(F.col("y") / 3, 6).alias("y"))


_TAPS = [float((7 * k) % 5 - 2) for k in range(21)]


@query(_sum(_TAPS, 4))
def stencil_convolve(spark, d):
    """21 taps, off centre."""
    t, n = _events(spark, d)
    return stencil.convolved(t, _TAPS, 4, n).select("idx", "y")


@query(f"SELECT idx, v + 42 * y AS y FROM ({_sum([1.0, -2.0, 1.0], 1)}) JOIN {V} USING (idx)")
def stencil_append(spark, d):
    t, n = _events(spark, d)
    return stencil.convolved(t, [1.0, -2.0, 1.0], 1, n).select("idx", (F.col("v") + 42 * F.col("y")).alias("y"))


def _neighbours_sql(expr: str) -> str:
    return f"""WITH t AS (SELECT idx, v, coalesce(lag(v) OVER (ORDER BY idx), v) AS p, coalesce(lead(v) OVER (ORDER BY idx), v) AS n FROM {V})
SELECT idx, {expr} AS y FROM t"""


@query(_neighbours_sql("round(sin(n - v) + sin(v - p), 6) + 0.0"))
def stencil_user_oscillate(spark, d):
    t, n = _events(spark, d)
    f = lambda x: {"y": F.round(F.sin(x[1] - x[0]) + F.sin(x[0] - x[-1]), 6) + 0.0}
    return stencil.neighbours(t, 1, 1, f, n).select("idx", "y")


@query(_neighbours_sql("CAST(v + p * n AS BIGINT)"))
def stencil_user_product(spark, d):
    t, n = _events(spark, d)
    return stencil.neighbours(t, 1, 1, lambda x: {"y": x[0] + x[-1] * x[1]}, n).select("idx", "y")


@query(_neighbours_sql("CAST(n - p AS BIGINT)"))
def manual_stencil(spark, d):
    """Neighbours by clamped position."""
    t, n = _events(spark, d)
    return stencil.neighbours(t, 1, 1, lambda x: {"y": x[1] - x[-1]}, n).select("idx", "y")


@query(f"""
WITH t AS (SELECT idx, v, n, sum(v) OVER (ORDER BY idx ROWS BETWEEN 100 PRECEDING AND 155 FOLLOWING) AS s, min_by(v, idx) OVER () AS a, max_by(v, idx) OVER () AS b FROM {V})
SELECT idx, CAST(s + greatest(0, 100 - idx) * a + greatest(0, idx + 155 - (n - 1)) * b AS DOUBLE) AS y FROM t
""")
def stencil_wide(spark, d):
    """256 equal taps: convolved block by block."""
    t, n = _events(spark, d)
    return stencil.convolved(t, [1.0] * 256, 100, n).select("idx", F.round("y", 0).alias("y"))
