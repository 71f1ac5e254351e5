"""Random numbers, Fourier transforms, splines."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from arrayloom.operators import fourier, rng, splines
from arrayloom.plans.catalog import query
from arrayloom.sources.tables import table

N = 1000
_M = "4294967295"


def _philox2(n: int, seed: str = "7") -> str:
    """The rounds of philox2x32 as a recursive table of n counters."""
    return f"""WITH RECURSIVE p AS (
  SELECT range AS idx, 0 AS r, CAST(range AS UHUGEINT) AS a, CAST({seed} AS UHUGEINT) AS b, CAST({rng.KEY} AS UHUGEINT) AS k FROM range({n})
  UNION ALL
  SELECT idx, r + 1, xor(xor((a * {rng.PHILOX_2X32_MULTIPLIER}) >> 32, k), b), (a * {rng.PHILOX_2X32_MULTIPLIER}) & {_M}, (k + {rng.PHILOX_32_WEYL[0]}) & {_M} FROM p WHERE r < 10)"""


def _philox4(n: int, seed: str = "7") -> str:
    m0, m1 = rng.PHILOX_4X32_MULTIPLIERS
    return f"""WITH RECURSIVE p AS (
  SELECT range AS idx, 0 AS r, CAST(range AS UHUGEINT) AS a, CAST({seed} AS UHUGEINT) AS b, CAST(range AS UHUGEINT) AS c, CAST({seed} AS UHUGEINT) AS d,
         CAST({rng.KEY} AS UHUGEINT) AS k, CAST({rng.KEY} AS UHUGEINT) AS l FROM range({n})
  UNION ALL
  SELECT idx, r + 1, xor(xor((c * {m1}) >> 32, b), k), (c * {m1}) & {_M}, xor(xor((a * {m0}) >> 32, d), l), (a * {m0}) & {_M},
         (k + {rng.PHILOX_32_WEYL[0]}) & {_M}, (l + {rng.PHILOX_32_WEYL[1]}) & {_M} FROM p WHERE r < 10)"""


def _threefry2(n: int, seed: str = "7") -> str:
    turns = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(rng.THREEFRY_2X32_ROTATIONS))
    parity = rng.THREEFRY_32_PARITY ^ rng.KEY ^ rng.KEY
    ks = lambda e: f"CASE ({e}) % 3 WHEN 2 THEN {parity} ELSE {rng.KEY} END"
    return f"""WITH RECURSIVE p AS (
  SELECT range AS idx, 0 AS r, CAST((range + {rng.KEY}) & {_M} AS HUGEINT) AS a, CAST(({seed} + {rng.KEY}) & {_M} AS HUGEINT) AS b FROM range({n})
  UNION ALL
  SELECT idx, r + 1, CASE WHEN r % 4 = 3 THEN (s + {ks("(r + 1) // 4")}) & {_M} ELSE s END,
         CASE WHEN r % 4 = 3 THEN (xor(t, s) + {ks("(r + 1) // 4 + 1")} + (r + 1) // 4) & {_M} ELSE xor(t, s) END
  FROM (SELECT idx, r, (a + b) & {_M} AS s, ((b << w) | (b >> (32 - w))) & {_M} AS t
        FROM (SELECT *, CAST(CASE r % 8 {turns} END AS HUGEINT) AS w FROM p WHERE r < 20)))"""


def _counters(spark, n=N):
    return spark.range(n).withColumnRenamed("id", "idx")


@query(f"{_philox2(N)} SELECT idx, CAST(a AS BIGINT) AS r FROM p WHERE r = 10")
def random_int_philox(spark, d):
    return rng.uniform_int(_counters(spark), 7)


@query(f"{_philox2(N)} SELECT idx, round((CAST(b AS DOUBLE) * 4294967296.0 + CAST(a AS DOUBLE)) / 18446744073709551616.0, 9) AS r FROM p WHERE r = 10")
def random_uniform_philox(spark, d):
    return rng.uniform(_counters(spark), 7).select("idx", F.round("r", 9).alias("r"))


@query(f"{_threefry2(N)} SELECT idx, CAST(a AS BIGINT) AS r FROM p WHERE r = 20")
def random_int_threefry(spark, d):
    return rng.uniform_int(_counters(spark), 7, "threefry")


@query(f"{_threefry2(N)} SELECT idx, round((CAST(b AS DOUBLE) * 4294967296.0 + CAST(a AS DOUBLE)) / 18446744073709551616.0, 9) AS r FROM p WHERE r = 20")
def random_uniform_threefry(spark, d):
    return rng.uniform(_counters(spark), 7, "threefry").select("idx", F.round("r", 9).alias("r"))


_BOX_MULLER = """round(sqrt(-2 * ln((CAST(b AS DOUBLE) * 4294967296.0 + CAST(a AS DOUBLE)) / 18446744073709551616.0))
 * cos(2 * pi() * ((CAST(d AS DOUBLE) * 4294967296.0 + CAST(c AS DOUBLE)) / 18446744073709551616.0)), 6) + 0.0"""


@query(f"{_philox4(N)} SELECT idx, {_BOX_MULLER} AS r FROM p WHERE r = 10")
def random_normal_philox(spark, d):
    return rng.normal(_counters(spark), 7).select("idx", (F.round("r", 6) + 0.0).alias("r"))


@query(f"""
{_philox4(20000, "1")}
SELECT count(*) FILTER (WHERE x * x + y * y <= 1) AS inside, round(4.0 * count(*) FILTER (WHERE x * x + y * y <= 1) / count(*), 9) AS pi
FROM (SELECT (CAST(b AS DOUBLE) * 4294967296.0 + CAST(a AS DOUBLE)) / 18446744073709551616.0 AS x,
             (CAST(d AS DOUBLE) * 4294967296.0 + CAST(c AS DOUBLE)) / 18446744073709551616.0 AS y FROM p WHERE r = 10)
""")
def monte_carlo_pi(spark, d):
    """The share of random points inside the circle; no input at all."""
    t, w = rng.philox(_counters(spark, 20000), [F.col("idx"), F.lit(1)] * 2, [rng.KEY] * 2)
    x, y = (rng._unit(F.col(w[k]), F.col(w[k + 1])) for k in (0, 2))
    inside = F.count_if(x * x + y * y <= 1)
    return t.agg(inside.alias("inside"), F.round(4.0 * inside / F.count("*"), 9).alias("pi"))


# Fourier

#: Longer rows than 64 begin again.
_DFT = """WITH e AS (SELECT vec_id AS id, j.range AS j, CAST(embedding[j.range % 64 + 1] AS DOUBLE) AS x FROM embeddings, range({n}) j),
f AS (SELECT id, k.range AS k, sum(x * cos(2 * pi() * ((j * k.range) % {n}) / {n})) AS re, -sum(x * sin(2 * pi() * ((j * k.range) % {n}) / {n})) AS im
      FROM e, range({n}) k GROUP BY ALL)"""


def _rows(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _long(t):
    z = F.posexplode(F.arrays_zip("re", "im")).alias("k", "z")
    return t.select("id", z).select("id", F.col("k").cast("long").alias("k"), (F.round("z.re", 6) + 0.0).alias("re"), (F.round("z.im", 6) + 0.0).alias("im"))


_ROUNDED = "round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im"


@query(f"{_DFT.format(n=64)} SELECT id, k, {_ROUNDED} FROM f")
def fft_batch(spark, d):
    """One transform of 64 points a row."""
    return _long(fourier.batch(_rows(spark, d), "embedding"))


@query(f"{_DFT.format(n=66)} SELECT id, k, {_ROUNDED} FROM f")
def fft_composite_length(spark, d):
    return _long(fourier.batch(_rows(spark, d).withColumn("embedding", F.concat("embedding", F.slice("embedding", 1, 2))), "embedding"))


@query(f"{_DFT.format(n=67)} SELECT id, k, {_ROUNDED} FROM f")
def fft_prime_length(spark, d):
    return _long(fourier.batch(_rows(spark, d).withColumn("embedding", F.concat("embedding", F.slice("embedding", 1, 3))), "embedding"))


@query(f"{_DFT.format(n=64)} SELECT id, k, {_ROUNDED} FROM f")
def fft_as_join(spark, d):
    """The same as a sum over generated frequencies, all native."""
    j = _rows(spark, d).select("id", F.posexplode("embedding").alias("j", "x")).select("id", "j", F.col("x").cast("double").alias("re"), F.lit(0.0).alias("im"))
    return fourier.as_join(j, "id", 64).select("id", F.col("k").cast("long").alias("k"), (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))


@query("SELECT vec_id AS id, k.range AS k, round(CAST(embedding[k.range + 1] AS DOUBLE), 6) + 0.0 AS re, 0.0::DOUBLE AS im FROM embeddings, range(64) k")
def fft_inverse_roundtrip(spark, d):
    return _long(fourier.batch(fourier.batch(_rows(spark, d), "embedding"), "re", "im", fourier.INVERSE))


def _signal(spark, d):
    t = table(spark, d, "events")
    return t.select(F.col("event_id").alias("idx"), F.col("value").alias("re"), F.lit(0.0).alias("im")), t.count()


def _spectrum(t):
    return t.select("idx", (F.round("re", 3) + 0.0).alias("re"), (F.round("im", 3) + 0.0).alias("im"))


@query("""
WITH n AS (SELECT count(*) AS n FROM events),
w AS (SELECT k.range AS k, cos(2 * pi() * k.range / n) AS c, sin(2 * pi() * k.range / n) AS s FROM n, range(n) k)
SELECT k.range AS idx, round(sum(value * c), 3) + 0.0 AS re, round(-sum(value * s), 3) + 0.0 AS im
FROM (SELECT event_id, value, n FROM n, events) e, range(e.n) k, w WHERE w.k = (event_id * k.range) % n GROUP BY 1
""")
def fft_vector(spark, d):
    """All events as one long vector, in two passes of about the root of its length."""
    t, n = _signal(spark, d)
    return _spectrum(fourier.vector(t, n))


@query("""
WITH m AS (SELECT CAST(ceil(count(*) / 8) AS BIGINT) AS m FROM events),
r AS (SELECT event_id // 8 AS y, kx.range AS kx, sum(value * cos(2 * pi() * ((event_id % 8 * kx.range) % 8) / 8)) AS re, -sum(value * sin(2 * pi() * ((event_id % 8 * kx.range) % 8) / 8)) AS im
      FROM events, range(8) kx GROUP BY 1, 2)
SELECT ky * 8 + kx AS idx, round(sum(re * cos(a) + im * sin(a)), 3) + 0.0 AS re, round(sum(im * cos(a) - re * sin(a)), 3) + 0.0 AS im
FROM (SELECT kx, re, im, k.range AS ky, 2 * pi() * ((y * k.range) % m) / m AS a FROM r, m, range(m) k) GROUP BY 1
""")
def fft_2d(spark, d):
    """All events as a plane of 8 columns."""
    t, n = _signal(spark, d)
    return _spectrum(fourier.grid(t, [-(-n // 8), 8]))


@query("""
WITH e AS (SELECT event_id % 997 AS j, sum(value) AS value FROM events GROUP BY 1)
SELECT k.range AS idx, round(sum(value * cos(2 * pi() * ((j * k.range) % 997) / 997)), 3) + 0.0 AS re,
       round(-sum(value * sin(2 * pi() * ((j * k.range) % 997) / 997)), 3) + 0.0 AS im
FROM e, range(997) k GROUP BY 1
""")
def fft_vector_of_prime_length(spark, d):
    """All events folded to 997 positions, a prime: by convolution of a length of twos."""
    n = 997
    t, _ = _signal(spark, d)
    t = t.groupBy((F.col("idx") % n).alias("idx")).agg(F.sum("re").alias("re"), F.lit(0.0).alias("im"))
    return _spectrum(fourier.vector(t, n))


@query("SELECT range AS idx, round(sin(2 * pi() * range / 64), 6) + 0.0 AS u FROM range(64)")
def fft_poisson(spark, d):
    """-u'' = f on a circle by the convolution theorem; f is chosen so that u is a sine."""
    n, w = 64, 2 * math.pi
    f = spark.range(n).select(F.col("id").alias("idx"), (F.sin(w * F.col("id") / n) * (w * w)).alias("re"), F.lit(0.0).alias("im"))
    g = fourier.vector(f, n)
    k = F.when(F.col("idx") > n // 2, F.col("idx") - n).otherwise(F.col("idx")).cast("double")
    scale = F.when(k == 0, 0.0).otherwise(1.0 / F.when(k == 0, 1.0).otherwise(w * w * k * k))
    u = fourier.vector(g.select("idx", (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im")), n, fourier.INVERSE)
    return u.select("idx", (F.round("re", 6) + 0.0).alias("u"))


# splines

SIX_POINTS = [(0.0, 0.0, 0.2), (0.0, 1.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, -0.2), (0.4, 0.4, -1.0), (0.6, 0.6, 1.0)]


@query("SELECT * FROM (VALUES (0, 0.2), (1, 0.0), (2, 0.0), (3, -0.2), (4, -1.0), (5, 1.0)) t(idx, v)".replace("SELECT *", "SELECT CAST(idx AS BIGINT) AS idx, CAST(v AS DOUBLE) AS v"))
def mba_fit_eval(spark, d):
    """A surface through six points, evaluated where they are."""
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate(SIX_POINTS)], "idx bigint, x double, y double, v double")
    s = splines.fit(pts, ["x", "y"], "v", [-0.01, -0.01], [1.01, 1.01], [2, 2])
    return s.evaluate(pts.select("idx", "x", "y")).select("idx", (F.round("v", 4) + 0.0).alias("v"))


@query()
def mba_diagonal(spark, d):
    """The same surface between the points."""
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate(SIX_POINTS)], "idx bigint, x double, y double, v double")
    s = splines.fit(pts, ["x", "y"], "v", [-0.01, -0.01], [1.01, 1.01], [2, 2])
    t = spark.range(101).select(F.col("id").alias("idx"), (F.col("id") / 100).alias("x"), (F.col("id") / 100).alias("y"))
    return s.evaluate(t).select("idx", F.round("v", 6).alias("v"))
