"""Operators by property and known answers, with blocks small enough to matter."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arrayloom.functions import constants, scalar, short_vectors, special
from arrayloom.operators import blocks, fourier, reduce, rng, scan, sort, splines, stencil, tensor, views
from arrayloom.sources import vectors
from arrayloom.streaming import micro_batches

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def values(df, *names):
    rows = sorted(df.collect(), key=lambda r: r["idx"])
    return [r["idx"] for r in rows], *[[r[n] for r in rows] for n in names]


def test_published_answers_of_the_generators(spark):
    one = spark.range(1)
    for f, n, keys, want in (
        (rng.philox, 2, [0], ["ff1dae59", "6cd10df2"]),
        (rng.philox, 4, [0, 0], ["6627e8d5", "e169c58d", "bc57ac4c", "9b00dbd8"]),
        (rng.threefry, 2, [0, 0], ["6b200159", "99ba4efe"]),
        (rng.threefry, 4, [0, 0, 0, 0], ["b9c8a947", "9fd9debc", "437c2cdd", "649c7fab"]),
    ):
        df, words = f(one, [F.col("id")] * n, keys)
        assert [f"{x:08x}" for x in df.select(*words).first()] == want


def test_random_moments(spark):
    t = spark.range(20_000).withColumnRenamed("id", "idx")
    for g in ("philox", "threefry"):
        m = rng.uniform(t, 3, g).agg(F.avg("r"), F.min("r"), F.max("r")).first()
        assert abs(m[0] - 0.5) < 0.01 and m[1] >= 0 and m[2] <= 1
    m = rng.normal(t, 5, both=True).agg(F.avg("r"), F.stddev("r"), F.avg("r2"), F.corr("r", "r2")).first()
    assert abs(m[0]) < 0.03 and abs(m[1] - 1) < 0.03 and abs(m[2]) < 0.03 and abs(m[3]) < 0.03
    for g, n in (("philox", 2), ("philox", 4), ("threefry", 2), ("threefry", 4)):
        w = rng.words_64(spark.range(50).withColumnRenamed("id", "idx"), 1, n, g).collect()
        assert len({tuple(r["words"]) for r in w}) == 50 and {len(r["words"]) for r in w} == {n}


def test_64_bit_words_known_answers():
    """All counter and key words zero; against Python's integers for others."""
    zero = [np.zeros(1, np.uint64)]
    for f, n, keys, want in (
        (rng._philox_64, 2, 1, ["ca00a0459843d731", "66c24222c9a845b5"]),
        (rng._philox_64, 4, 2, ["16554d9eca36314c", "db20fe9d672d0fdc", "d7e772cee186176b", "7e68b68aec7ba23b"]),
        (rng._threefry_64, 2, 2, ["c2b6e3a8c2c69865", "6f81ed42f350084d"]),
    ):
        assert [f"{int(x[0]):016x}" for x in f(zero * n, [0] * keys)] == want
    for c in (3, (1 << 63) - 1, (1 << 64) - 1):
        hi, lo = rng._mul_64(rng.PHILOX_2X64_MULTIPLIER, np.array([c], np.uint64))
        assert (int(hi[0]) << 64 | int(lo[0])) == c * rng.PHILOX_2X64_MULTIPLIER


def test_exact_sum_of_hard_values(spark):
    import math

    from arrayloom.operators import reduce

    sets = {
        "a": [1e308, 1e308, -1e308, 1.0, -1e308, 5e-324],
        "b": [0.1] * 10 + [1e16, 1.0, -1e16],
        "c": [None, None],
        "d": [math.inf, 1.0],
        "e": [math.inf, -math.inf],
        "f": [1e308, 1e308],
        "g": [5e-324, 5e-324, -0.0],
    }
    df = spark.createDataFrame([(k, v) for k, x in sets.items() for v in x], "k string, v double")
    got = {r["k"]: r["total"] for r in reduce.exact_sum(df, F.col("v"), ["k"]).collect()}
    assert got["a"] == math.fsum([1.0, 5e-324]) and got["b"] == math.fsum(sets["b"]) and got["c"] == 0.0
    assert got["d"] == math.inf and math.isnan(got["e"]) and got["f"] == math.inf and got["g"] == 1e-323
    assert reduce.exact_sum(df.where("k = 'b'"), F.col("v")).first()[0] == math.fsum(sets["b"])


@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60), st.sampled_from([3, 7, 100]))
@FEW
def test_scans_by_block(spark, xs, size):
    df = vectors.from_values(spark, xs, "bigint")
    inc = np.cumsum(xs).tolist()
    assert values(scan.inclusive_scan(df, size=size), "scan")[1] == inc
    assert values(scan.exclusive_scan(df, init=10, size=size), "scan")[1] == [10, *[10 + x for x in inc[:-1]]]
    assert values(scan.inclusive_scan(df, fold=blocks.MIN, size=size), "scan")[1] == np.minimum.accumulate(xs).tolist()


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-9, 9)), min_size=1, max_size=50), st.sampled_from([4, 64]))
@FEW
def test_by_adjacent_key(spark, rows, size):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "idx bigint, k int, v bigint")
    want, runs = [], []
    for i, (k, v) in enumerate(rows):
        new = i == 0 or rows[i - 1][0] != k
        want.append(v if new else want[-1] + v)
        runs = [*runs, [k, v]] if new else [*runs[:-1], [k, runs[-1][1] + v]]
    assert values(scan.inclusive_scan_by_key(df, ["k"], size=size), "scan")[1] == want
    out = reduce.reduce_by_key(df, ["k"], size=size, total=F.sum("v"))
    assert values(out, "k", "total") == (list(range(len(runs))), [r[0] for r in runs], [r[1] for r in runs])


def test_sorts_are_stable_and_dense(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(5), r.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "idx bigint, k int, v double")
    got = values(sort.sort_by_key(df, "k"), "k", "v")
    want = sorted(rows, key=lambda x: x[1])
    assert got == (list(range(500)), [x[1] for x in want], [x[2] for x in want])
    assert sort.sort(df.limit(0), "v").count() == 0


def test_exact_sum(spark):
    xs = [1e16, 1.0, -1e16, 1e-8] * 50 + [math.pi * 10**k for k in range(-20, 20)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(7)
    assert reduce.exact_sum(df, F.col("x")).first()["total"] == math.fsum(xs)


def test_identities_of_nothing(spark):
    none = spark.createDataFrame([], "v double")
    row = none.agg(reduce.total(F.col("v")), reduce.least(F.col("v")), reduce.any_of(F.col("v") > 0), reduce.all_of(F.col("v") > 0)).first()
    assert tuple(row) == (0.0, 1.7976931348623157e308, False, True)


@given(st.data())
@FEW
def test_slices_like_numpy(spark, data):
    dims = data.draw(st.lists(st.integers(1, 6), min_size=1, max_size=3))
    x = np.arange(math.prod(dims)).reshape(dims)
    subs, cuts = [], []
    for d in dims:
        kind = data.draw(st.sampled_from(["all", "one", "range", "down"]))
        a, b = sorted(data.draw(st.tuples(st.integers(0, d - 1), st.integers(0, d - 1))))
        s = data.draw(st.integers(1, 3))
        subs.append({"all": None, "one": a, "range": views.Range(a, b + 1, s), "down": views.Range(b, a - 1, -s)}[kind])
        cuts.append({"all": slice(None), "one": a, "range": slice(a, b + 1, s), "down": slice(b, a - 1 if a else None, -s)}[kind])
    df = vectors.from_values(spark, x.reshape(-1).tolist(), "bigint")
    want = x[tuple(cuts)]
    got, shape = views.sliced(df, dims, *subs)
    assert values(got, "v")[1] == want.reshape(-1).tolist() and shape == list(want.shape)
    marked = x.copy()
    marked[tuple(cuts)] = -1 - np.arange(want.size).reshape(want.shape)
    rhs = vectors.from_values(spark, [-1 - k for k in range(want.size)], "bigint")
    assert values(views.slice_assigned(df, dims, subs, rhs), "v")[1] == marked.reshape(-1).tolist()


def test_slice_bounds(spark):
    df = vectors.from_values(spark, [1.0] * 12)
    with pytest.raises(IndexError):
        views.sliced(df, [3, 4], 3)
    with pytest.raises(IndexError):
        views.sliced(df, [3, 4], views.Range(0, 5))
    with pytest.raises(IndexError):
        views.largest_index(spark.createDataFrame([(0, 12)], "idx bigint, i bigint"), 12)
    with pytest.raises(ValueError):
        vectors.aligned(df, df.limit(3), strict=True)


def test_reshape_and_gslice(spark):
    x = np.arange(24)
    df = vectors.from_values(spark, x.tolist(), "bigint")
    assert values(views.reshaped(df, [4, 3, 2], [2, 1, 0]), "v")[1] == x.reshape(2, 3, 4).T.reshape(-1).tolist()
    wide = np.broadcast_to(x.reshape(1, 24), (3, 24)).reshape(-1).tolist()
    assert values(views.reshaped(df, [3, 24], [1]), "v")[1] == wide
    assert values(views.reshaped(df, [0, 24], [1]), "v")[1] == []
    assert values(views.gslice(df, 23, [3, 2], [-4, -1]), "v")[1] == [23, 22, 19, 18, 15, 14]


def test_tensordot_like_numpy(spark):
    r = np.random.default_rng(1)
    a, b = r.integers(0, 9, (2, 3, 4)).astype(float), r.integers(0, 9, (4, 5, 3)).astype(float)
    fa, fb = (vectors.from_values(spark, x.reshape(-1).tolist()) for x in (a, b))
    out, shape = tensor.tensordot(fa, a.shape, fb, b.shape, [(2, 0), (1, 2)])
    want = np.tensordot(a, b, axes=([2, 1], [0, 2]))
    assert shape == list(want.shape) and values(out, "v")[1] == want.reshape(-1).tolist()
    with pytest.raises(ValueError):
        tensor.tensordot(fa, a.shape, fb, b.shape, [(0, 0)])


@pytest.mark.parametrize(("taps", "center", "n", "size"), [(3, 1, 50, 8), (5, 0, 20, 8), (4, 3, 3, 8), (80, 33, 200, 16), (80, 0, 5, 16)])
def test_convolution(spark, taps, center, n, size):
    r = np.random.default_rng(taps)
    w, x = r.random(taps), r.random(n)
    want = [sum(w[j] * x[min(max(i + j - center, 0), n - 1)] for j in range(taps)) for i in range(n)]
    got = values(stencil.convolved(vectors.from_values(spark, x.tolist()), w.tolist(), center, n, size=size), "y")
    assert got[0] == list(range(n)) and np.allclose(got[1], want)


@pytest.mark.parametrize("n", [1, 7, 64, 97, 360])
def test_vector_transform(spark, n):
    r = np.random.default_rng(n)
    x = r.random(n) + 1j * r.random(n)
    df = spark.createDataFrame([(i, float(v.real), float(v.imag)) for i, v in enumerate(x)], "idx bigint, re double, im double")
    f = fourier.vector(df, n)
    _, re, im = values(f, "re", "im")
    assert np.allclose(np.array(re) + 1j * np.array(im), np.fft.fft(x))
    _, re, im = values(fourier.vector(f, n, fourier.INVERSE), "re", "im")
    assert np.allclose(np.array(re) + 1j * np.array(im), x)


def test_grid_transform_with_a_batch_axis(spark):
    x = np.random.default_rng(2).random((3, 4, 5))
    df = spark.createDataFrame([(i, float(v), 0.0) for i, v in enumerate(x.reshape(-1))], "idx bigint, re double, im double")
    _, re, im = values(fourier.grid(df, x.shape, [fourier.NONE, fourier.FORWARD, fourier.FORWARD]), "re", "im")
    assert np.allclose(np.array(re) + 1j * np.array(im), np.fft.fft2(x).reshape(-1))


def test_spline_goes_through_the_points(spark):
    pts = [(0.0, 0.2), (0.3, -1.0), (0.7, 0.5), (1.0, 0.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "idx bigint, x double, v double")
    s = splines.fit(df, ["x"], "v", [-0.01], [1.01], [2], levels=6)
    assert np.allclose(values(s.evaluate(df.select("idx", "x")), "v")[1], [p[1] for p in pts], atol=1e-3)


def test_scalar_edge_cases(spark):
    rows = [(x, y) for x in (0.0, -0.0, 1.5, -2.5, float("nan"), float("inf"), -float("inf")) for y in (0.0, -3.0, float("nan"))]
    df = spark.createDataFrame(rows, "x double, y double")
    x, y = F.col("x"), F.col("y")
    out = df.select(
        "x", "y", scalar.fdiv(x, y).alias("q"), scalar.log(x).alias("l"), scalar.fmax(x, y).alias("m"), scalar.isless(x, y).alias("s"), scalar.trunc(x).alias("t"),
        scalar.signbit(x).alias("b"), scalar.isunordered(x, y).alias("u"),
    ).collect()
    eq = lambda a, b: (math.isnan(a) and math.isnan(b)) or a == b
    with np.errstate(all="ignore"):
        for r in out:
            a, b = np.float64(r["x"]), np.float64(r["y"])
            assert eq(r["q"], a / b) and eq(r["l"], np.log(a)) and eq(r["m"], np.fmax(a, b)) and r["s"] == bool(a < b)
            assert eq(r["t"], np.trunc(a)) and r["b"] == bool(np.signbit(a)) and r["u"] == bool(np.isnan(a) or np.isnan(b))


def test_frexp_and_powers_of_two(spark):
    xs = [1.0, 0.5, 8.0, 7.999999999, 3.1, -12.5, 1e300, 1e-300]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalar.frexp(F.col("x")).alias("f")).collect():
        assert (r["f"]["mantissa"], r["f"]["exponent"]) == math.frexp(r["x"])


def test_every_named_function_runs(spark):
    df = spark.createDataFrame([(0.5, 0.25, 3, 5)], "x double, y double, a bigint, b bigint")
    x, y, a, b = (F.col(c) for c in "xyab")
    integers = "abs_diff add_sat sub_sat mad24 mad_hi mad_sat mul24 mul_hi hadd rhadd bitselect clz popcount __popc __popcll rotate upsample".split()
    arity = {"add_sat": 2, "sub_sat": 2, "rotate": None, "clz": 1}
    import inspect

    cols = []
    for name, f in scalar.FUNCTIONS.items():
        pool = [a, b, a] if name in integers else [y, x, x]
        if name == "rotate":
            cols.append(f(a, 3))
        elif name in ("rootn",):
            cols.append(f(x, 3))
        elif name in ("ldexp", "pown"):
            cols.append(f(x, a))
        elif name == "nan":
            cols.append(f())
        elif name == "acosh":
            cols.append(f(x + 1))
        else:
            try:
                n = arity.get(name) or len([p for p in inspect.signature(f).parameters.values() if p.default is p.empty and p.kind != p.VAR_POSITIONAL]) or (2 if name == "atan2pi" else 1)
            except (TypeError, ValueError):
                n = 1
            cols.append(f(*pool[:n]))
    for name, f in special.FUNCTIONS.items():
        cols.append(f(x, y) if name == "nextafter" else f(x))
    v = F.array(x, y, x)
    for name, f in short_vectors.FUNCTIONS.items():
        m = F.array(F.lit(0), F.lit(2))
        cols.append(f(v, v, m) if name == "shuffle2" else f(v, m) if name == "shuffle" else f(v, v) if name in ("cross", "distance", "dot", "fast_distance") else f(v))
    assert len(df.select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()) == len(cols)
    assert len(constants.VALUES) == 65
    assert df.select(special.reinterpret(x, "f8", "i8").alias("r")).first()["r"] == 0x3FE0000000000000


def test_vector_helpers(spark):
    df = vectors.from_values(spark, [float(k) for k in range(25)])
    assert vectors.to_values(vectors.copy_range(df, 5, 8, 2)) == [5.0, 6.0, 7.0]
    assert values(vectors.resized(df, 3), "v")[1] == [0.0, 1.0, 2.0] and vectors.resized(df, 30).count() == 30
    assert set(vectors.to_values(vectors.cleared(df))) == {0.0}
    assert len(vectors.text_lines(df)) == 3
    parts = vectors.split_components(vectors.from_values(spark, [float(k) for k in range(6)]), 2)
    assert values(parts, "c0", "c1")[1:] == ([0.0, 1.0, 2.0], [3.0, 4.0, 5.0])
    assert vectors.to_values(vectors.joined_components(parts, ["c0", "c1"], 3)) == [float(k) for k in range(6)]
    assert values(views.scattered(df, spark.createDataFrame([(0, 1), (1, 1), (2, 3)], "idx bigint, i bigint"), vectors.from_values(spark, [7.0, 8.0, 9.0])), "v")[1][:4] == [0.0, 8.0, 2.0, 9.0]


def test_streaming(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    micro_batches.to_table(micro_batches.elementwise(stream, y=F.col("value") * 2), out, str(tmp_path / "c"))
    assert spark.read.parquet(out).count() == spark.read.parquet(source).count()
    folded = micro_batches.windowed_fold(stream, "ts", "1 day", "30 days", ["event_type"], n=F.count("*"))
    q = folded.writeStream.outputMode("complete").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("folded").agg(F.sum("n")).first()[0] == spark.read.parquet(source).count()
