"""Fourier transforms: batches of rows, whole vectors, N-D grids, and as a join.

One numpy transform runs in one task, so a long vector is cut in two passes of
about the square root of its length (four-step form). A length whose parts are
far apart, like a prime, goes by a convolution with a chirp (Bluestein) over a length
of twos, whose parts are near. N-D grids take a pass for each axis. Forward transforms are unscaled, inverse ones divide by the length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.operators.views import digits

FORWARD, INVERSE, NONE = "forward", "inverse", "none"


def _transform(x: np.ndarray, direction: str) -> np.ndarray:
    return np.fft.fft(x, axis=-1) if direction == FORWARD else np.fft.ifft(x, axis=-1)


def batch(df: DataFrame, re: str, im: str | None = None, direction: str = FORWARD) -> DataFrame:
    """The transform of every row's array: columns re and im replace the input's.

    Rows may have different lengths; real input has no ``im`` column.
    """
    keep = [c for c in df.columns if c not in (re, im)]
    rows = df.select(*keep, F.col(re).cast("array<double>").alias("re"), *([F.col(im).cast("array<double>").alias("im")] if im else []))
    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.select(*keep).dtypes], "re array<double>", "im array<double>"])

    def run(batches):
        for b in batches:
            a = b.column(len(keep))
            values = a.values.to_numpy(zero_copy_only=False)[a.offsets[0].as_py() :].astype(complex)
            if im:
                c = b.column(len(keep) + 1)
                values = values[: len(c.flatten())] + 1j * c.flatten().to_numpy(zero_copy_only=False)
            n = np.diff(a.offsets.to_numpy())
            if len(n) and (n == n[0]).all():
                out = _transform(values[: n.sum()].reshape(len(n), -1), direction).reshape(-1) if n[0] else values[:0]
            else:
                cuts = np.concatenate([[0], np.cumsum(n)])
                out = np.concatenate([_transform(values[i:j], direction) if j > i else values[:0] for i, j in zip(cuts[:-1], cuts[1:], strict=True)] or [values[:0]])
            at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            parts = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(p))) for p in (out.real, out.imag)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *parts], names=[*keep, "re", "im"])

    return rows.mapInArrow(run, schema)


def _pass(df: DataFrame, group: Column, place: Column, length: int, direction: str) -> DataFrame:
    """Transforms over ``place`` inside each ``group``: (g, k, re, im)."""

    def one(t: pa.Table) -> pa.Table:
        x = np.zeros(length, complex)
        p = t["p"].to_numpy()
        x[p] = t["re"].to_numpy() + 1j * t["im"].to_numpy()
        y = _transform(x, direction)
        return pa.table({"g": pa.array(np.full(length, t["g"][0].as_py())), "k": pa.array(np.arange(length)), "re": y.real, "im": y.imag})

    rows = df.select(group.cast("long").alias("g"), place.cast("long").alias("p"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    return rows.groupBy("g").applyInArrow(one, "g bigint, k bigint, re double, im double")


def _times(re: Column, im: Column, angle: Column) -> list[Column]:
    """(re + i im) turned by an angle."""
    c, s = F.cos(angle), F.sin(angle)
    return [(re * c - im * s).alias("re"), (re * s + im * c).alias("im")]


def _chirped(df: DataFrame, n: int, direction: str) -> DataFrame:
    """Bluestein: j k = (j^2 + k^2 - (k - j)^2) / 2 makes the transform a convolution of any length of at least 2 n - 1."""
    m = 1 << (2 * n - 1).bit_length()
    sign = -1 if direction == FORWARD else 1

    def chirp(at: Column, turn: int) -> Column:
        # the square modulo 2 n, by halves of the position so that no product passes a bigint
        at = at.cast("long")
        high, low = F.floor(at / 32768).cast("long"), at % 32768
        square = ((high * high % (2 * n)) * 32768 % (2 * n) * 32768 + 2 * (high * low % (2 * n)) * 32768 + low * low) % (2 * n)
        return F.lit(turn * math.pi / n) * square

    idx = F.col("idx")
    a = df.select("idx", *_times(F.col("re").cast("double"), F.col("im").cast("double"), chirp(idx, sign)))
    k = df.sparkSession.range(m).select(F.col("id").alias("idx"), F.least(F.col("id"), F.lit(m) - F.col("id")).alias("far"))
    b = k.where(F.col("far") < n).select("idx", *_times(F.lit(1.0), F.lit(0.0), chirp(F.col("far"), -sign)))
    fa = vector(a, m).select("idx", F.col("re").alias("ar"), F.col("im").alias("ai"))
    fb = vector(b, m).select("idx", F.col("re").alias("br"), F.col("im").alias("bi"))
    product = fa.join(fb, "idx").select(
        "idx", (F.col("ar") * F.col("br") - F.col("ai") * F.col("bi")).alias("re"), (F.col("ar") * F.col("bi") + F.col("ai") * F.col("br")).alias("im")
    )
    c = vector(product, m, INVERSE).where(idx < n)
    scale = 1.0 if direction == FORWARD else 1.0 / n
    return c.select("idx", *_times(F.col("re") * scale, F.col("im") * scale, chirp(idx, sign)))


#: Lengths that one task transforms whole; the larger of two parts may be so many times the smaller.
WHOLE, APART = 1 << 8, 64


def vector(df: DataFrame, n: int, direction: str = FORWARD) -> DataFrame:
    """The transform of one vector (idx, re, im) of n positions; missing ones are zeros."""
    if n <= WHOLE:
        return _pass(df, F.lit(0), F.col("idx"), n, direction).select(F.col("k").alias("idx"), "re", "im")
    n1 = max(d for d in range(1, math.isqrt(n) + 1) if n % d == 0)
    n2 = n // n1
    if n2 > APART * n1:
        return _chirped(df, n, direction)
    first = _pass(df, F.col("idx") % n2, F.floor(F.col("idx") / n2), n1, direction)
    angle = (-1 if direction == FORWARD else 1) * 2 * math.pi / n * ((F.col("g") * F.col("k")) % n)
    turned = first.select(
        "g", "k", (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)).alias("re"), (F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)).alias("im")
    )
    second = _pass(turned, F.col("k"), F.col("g"), n2, direction)
    return second.select((F.col("g") + F.col("k") * n1).alias("idx"), "re", "im")


def grid(df: DataFrame, dims: Sequence[int], directions: Sequence[str] | str = FORWARD) -> DataFrame:
    """An N-D transform of (idx, re, im); an axis whose direction is NONE is a batch."""
    ways = [directions] * len(dims) if isinstance(directions, str) else list(directions)
    for axis, way in enumerate(ways):
        if way == NONE:
            continue
        own = digits(F.col("idx"), dims)[axis]
        stride = math.prod(dims[axis + 1 :])
        rest = F.col("idx") - own * stride
        df = _pass(df, rest, own, dims[axis], way).select((F.col("g") + F.col("k") * stride).alias("idx"), "re", "im")
    return df


def as_join(df: DataFrame, key: str, n: int, direction: str = FORWARD) -> DataFrame:
    """The transforms of short vectors (key, j, re, im) as a sum over generated k.

    n rows for each element, so for short vectors only; all native.
    """
    sign = -1 if direction == FORWARD else 1
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    angle = F.lit(sign * 2 * math.pi / n) * ((F.col("j") * F.col("k")) % n)
    scale = 1.0 if direction == FORWARD else 1.0 / n
    wide = df.select(key, "j", "re", "im", k.alias("k")).select(key, "k", "re", "im", F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    return wide.groupBy(key, "k").agg(
        (F.sum(F.col("re") * F.col("c") - F.col("im") * F.col("s")) * scale).alias("re"), (F.sum(F.col("re") * F.col("s") + F.col("im") * F.col("c")) * scale).alias("im")
    )
