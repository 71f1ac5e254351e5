"""Stencils: weighted or free functions of a position's neighbours, edges repeated."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.operators.blocks import BLOCK, with_neighbours

#: Taps beyond which a block is convolved as a whole instead of by window columns.
WIDE = 64


def _padded(df: DataFrame, n: int, before: int, after: int) -> DataFrame:
    """The first and last value repeated outside of the ends."""
    lo = F.when(F.col("idx") == 0, F.lit(-before)).otherwise(F.lit(0))
    hi = F.when(F.col("idx") == n - 1, F.lit(after)).otherwise(F.lit(0))
    return df.withColumn("__p", F.explode(F.sequence(lo, hi))).select(
        *[(F.col("idx") + F.col("__p")).alias("idx") if c == "idx" else F.col(c) for c in df.columns], (F.col("__p") == 0).alias("__real")
    )


def neighbours(df: DataFrame, before: int, after: int, f: Callable[[dict[int, Column]], dict[str, Column]], n: int, value: str = "v", size: int = BLOCK) -> DataFrame:
    """``df`` with the columns that ``f`` makes of {-before: ..., 0: ..., after: ...}."""
    w = Window.partitionBy("block").orderBy("idx")
    wide = with_neighbours(_padded(df, n, before, after), before, after, size)
    x = F.col(value)
    at = {k: F.lag(x, -k).over(w) if k < 0 else F.lead(x, k).over(w) if k > 0 else x for k in range(-before, after + 1)}
    wide = wide.select("*", *[c.alias(f"__x{k + before}") for k, c in at.items()]).where("own and __real")
    made = f({k: F.col(f"__x{k + before}") for k in at})
    return wide.select(*df.columns, *[c.alias(name) for name, c in made.items()])


def convolved(df: DataFrame, taps: Sequence[float], center: int, n: int, value: str = "v", out: str = "y", size: int = BLOCK) -> DataFrame:
    """y[i] = sum of taps[j] * v[i + j - center], positions clamped to 0 .. n - 1."""
    before, after = center, len(taps) - 1 - center
    if len(taps) <= WIDE:

        def weighted(x):
            total = F.lit(taps[0]) * x[-center]
            for j in range(1, len(taps)):
                total = total + F.lit(taps[j]) * x[j - center]
            return {out: total}

        return neighbours(df, before, after, weighted, n, value, size)
    size = max(size, len(taps))  # else every row would go to many blocks
    kernel = np.asarray(taps, float)[::-1]
    rows = with_neighbours(_padded(df.select("idx", F.col(value).cast("double").alias("v")), n, before, after), before, after, size)

    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        idx, v = t["idx"].to_numpy(), t["v"].to_numpy()
        if len(v) < len(kernel):
            return pa.table({"idx": pa.array([], pa.int64()), out: pa.array([], pa.float64())})
        # idx has no gaps, so what is complete inside the block is its own rows
        y = np.convolve(v, kernel, "valid")
        at = idx[before : before + len(y)]
        mine = (t["own"].to_numpy() & t["__real"].to_numpy())[before : before + len(y)]
        return pa.table({"idx": at[mine], out: y[mine]})

    return rows.groupBy("block").applyInArrow(block, f"idx bigint, {out} double")
