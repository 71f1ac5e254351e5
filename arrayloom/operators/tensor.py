"""Contractions of dense arrays (idx, v) with shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.operators.views import digits, flat


def tensordot(a: DataFrame, a_dims: Sequence[int], b: DataFrame, b_dims: Sequence[int], pairs: Sequence[tuple[int, int]]) -> tuple[DataFrame, list[int]]:
    """Sum over the paired axes; free axes of a, then of b. Pairs in any order."""
    for i, j in pairs:
        if a_dims[i] != b_dims[j]:
            raise ValueError(f"axes {i} and {j} have {a_dims[i]} and {b_dims[j]} positions")
    common = [a_dims[i] for i, _ in pairs]
    free_a = [k for k in range(len(a_dims)) if k not in {i for i, _ in pairs}]
    free_b = [k for k in range(len(b_dims)) if k not in {j for _, j in pairs}]
    da, db = digits(F.col("idx"), a_dims), digits(F.col("idx"), b_dims)
    left = a.select(flat([da[i] for i, _ in pairs], common).alias("k"), flat([da[i] for i in free_a], [a_dims[i] for i in free_a]).alias("p"), F.col("v").alias("x"))
    right = b.select(flat([db[j] for _, j in pairs], common).alias("k"), flat([db[j] for j in free_b], [b_dims[j] for j in free_b]).alias("q"), F.col("v").alias("y"))
    shape = [a_dims[i] for i in free_a] + [b_dims[j] for j in free_b]
    width = 1
    for j in free_b:
        width *= b_dims[j]
    out = left.join(right, "k").groupBy((F.col("p") * width + F.col("q")).alias("idx")).agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    return out, shape or [1]
