"""Index algebra: permutations, slices, reshapes, gathers and scatters.

Views that are affine in the position are arithmetic on ``idx`` (a filter and
a projection); only general indices join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """start, start + stride, ... before ``stop``; a negative stride goes down."""

    start: int
    stop: int
    stride: int = 1

    def __len__(self) -> int:
        return (abs(self.stop - self.start) + abs(self.stride) - 1) // abs(self.stride)


def strides(dims: Sequence[int]) -> list[int]:
    """Row-major: the last dimension is the fastest."""
    return [prod(dims[k + 1 :]) for k in range(len(dims))]


def digits(idx: Column, dims: Sequence[int]) -> list[Column]:
    return [F.floor(idx / s) % d for s, d in zip(strides(dims), dims, strict=True)]


def flat(parts: Sequence[Column], dims: Sequence[int]) -> Column:
    at = F.lit(0).cast("long")
    for p, s in zip(parts, strides(dims), strict=True):
        at = at + p * s
    return at


def _subscripts(dims: Sequence[int], subs: Sequence) -> list:
    if len(subs) > len(dims):
        raise IndexError(f"{len(subs)} subscripts for {len(dims)} dimensions")
    full = [*subs, *[None] * (len(dims) - len(subs))]
    out = []
    for s, d in zip(full, dims, strict=True):
        r = Range(0, d) if s is None else Range(s, s + 1) if isinstance(s, int) else s
        ends = (r.start, r.start + (len(r) - 1) * r.stride)
        if len(r) and not (0 <= min(ends) and max(ends) < d):
            raise IndexError(f"{r} in a dimension of {d}")
        out.append((r, isinstance(s, int)))
    return out


def _in_slice(idx: Column, dims: Sequence[int], subs: Sequence) -> tuple[Column, Column, list[int]]:
    """Is the position in the slice, its position there, and the slice's shape."""
    where, parts, shape = F.lit(True), [], []
    for i, (r, single) in zip(digits(idx, dims), _subscripts(dims, subs), strict=True):
        away = (i - r.start) * (1 if r.stride > 0 else -1)
        k = F.call_function("div", away, F.lit(abs(r.stride)))
        where = where & (away >= 0) & (away % abs(r.stride) == 0) & (k < len(r))
        if not single:
            parts.append(k)
            shape.append(len(r))
    return where, flat(parts, shape), shape


def sliced(df: DataFrame, dims: Sequence[int], *subs) -> tuple[DataFrame, list[int]]:
    """A slice and its shape; a subscript is an int, a Range or None for all."""
    where, at, shape = _in_slice(F.col("idx"), dims, subs)
    return df.where(where).withColumn("idx", at), shape


def slice_assigned(df: DataFrame, dims: Sequence[int], subs: Sequence, rhs: DataFrame, value: str = "v") -> DataFrame:
    """``df`` with the slice replaced by the vector ``rhs`` in the slice's order."""
    where, at, _ = _in_slice(F.col("idx"), dims, subs)
    new = rhs.select(F.col("idx").alias("__at"), F.col(value).alias("__new"), F.lit(True).alias("__hit"))
    out = df.withColumn("__at", F.when(where, at)).join(new, "__at", "left")
    return out.withColumn(value, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(value))).select(df.columns)


def gslice(df: DataFrame, start: int, lengths: Sequence[int], steps: Sequence[int]) -> DataFrame:
    """Position i_0, i_1, ... of the result is ``start`` + the sum of i_k * steps[k]; steps may be 0 or negative."""
    out = df.sparkSession.range(prod(lengths)).withColumnRenamed("id", "idx")
    at = F.lit(start).cast("long")
    for i, s in zip(digits(F.col("idx"), lengths), steps, strict=True):
        at = at + i * s
    return gathered(df, out.withColumn("i", at))


def gathered(df: DataFrame, index: DataFrame) -> DataFrame:
    """out[idx] = df[i] for ``index`` (idx, i); repeats allowed."""
    return index.select("idx", F.col("i").alias("__i")).join(df.withColumnRenamed("idx", "__i"), "__i").drop("__i")


def scattered(df: DataFrame, index: DataFrame, source: DataFrame, value: str = "v") -> DataFrame:
    """df[i] = source[idx] for ``index`` (idx, i); of equal targets the largest idx wins."""
    sent = index.join(source.select("idx", F.col(value).alias("__new")), "idx").groupBy("i").agg(F.max_by(F.struct("__new"), "idx").alias("__got"))
    out = df.join(sent.withColumnRenamed("i", "idx"), "idx", "left")
    new = F.when(F.col("__got").isNotNull(), F.col("__got.__new")).otherwise(F.col(value))
    return out.select(*[new.alias(c) if c == value else F.col(c) for c in df.columns])


def permuted(df: DataFrame, to: Callable[[Column], Column]) -> DataFrame:
    """An affine permutation, given as where position idx goes."""
    return df.withColumn("idx", to(F.col("idx")).cast("long"))


def reversed_(df: DataFrame, n: int) -> DataFrame:
    return permuted(df, lambda i: n - 1 - i)


def largest_index(index: DataFrame, size: int) -> None:
    """Raise IndexError if some index is outside of ``size`` positions."""
    r = index.agg(F.min("i"), F.max("i")).first()
    if r[0] is not None and (r[0] < 0 or r[1] >= size):
        raise IndexError(f"indices {r[0]} .. {r[1]} for {size} positions")


def reshaped(df: DataFrame, dims: Sequence[int], source: Sequence[int]) -> DataFrame:
    """Shape ``dims`` from a vector of shape [dims[k] for k in source].

    Dimensions missing in ``source`` are replicated, by a generator for each.
    """
    own = digits(F.col("idx"), [dims[k] for k in source])
    out = df.select("*", *[d.alias(f"__d{k}") for k, d in zip(source, own, strict=True)])
    for k in range(len(dims)):
        if k not in source:
            if not dims[k]:
                return df.where(F.lit(False))
            out = out.withColumn(f"__d{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dims[k] - 1).cast("long"))))
    at = flat([F.col(f"__d{k}") for k in range(len(dims))], dims)
    return out.select(*[at.alias(c) if c == "idx" else F.col(c) for c in df.columns])


def reduced(df: DataFrame, dims: Sequence[int], axes: Sequence[int], **aggregates: Column) -> tuple[DataFrame, list[int]]:
    """Aggregates over some axes; the rest, row-major, is the new position."""
    keep = [k for k in range(len(dims)) if k not in set(axes)]
    d = digits(F.col("idx"), dims)
    shape = [dims[k] for k in keep]
    grouped = df.groupBy(flat([d[k] for k in keep], shape).alias("idx"))
    return grouped.agg(*[a.alias(n) for n, a in aggregates.items()]), shape or [1]


def met(a: DataFrame, a_source: Sequence[int], b: DataFrame, b_source: Sequence[int], dims: Sequence[int]) -> DataFrame:
    """The columns of ``reshaped(a, dims, a_source)`` and ``reshaped(b, dims, b_source)`` by position.

    Neither is replicated before they meet: the join is by the dimensions that
    both have, and each replica is a pair that it gives, so only the sources'
    own rows are shuffled. Dimensions that neither has come from a generator.
    """
    common = [k for k in range(len(dims)) if k in a_source and k in b_source]

    def side(df: DataFrame, source: Sequence[int], gives: Sequence[int]) -> DataFrame:
        own = dict(zip(source, digits(F.col("idx"), [dims[k] for k in source]), strict=True))
        key = flat([own[k] for k in common], [dims[k] for k in common]).alias("__k")
        return df.select(key, *[own[k].alias(f"__d{k}") for k in gives], *[c for c in df.columns if c != "idx"])

    left, right = side(a, a_source, a_source), side(b, b_source, [k for k in b_source if k not in common])
    # what follows takes far longer than these rows are large, so its tasks aren't to be merged by size
    left = left.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), *["__k"] * bool(common))
    out = left.join(right, "__k") if common else left.crossJoin(right.drop("__k"))
    at = flat([F.col(f"__d{k}") if k in a_source or k in b_source else F.lit(0) for k in range(len(dims))], dims).alias("idx")
    values = [c for df in (a, b) for c in df.columns if c != "idx"]
    out = out.select(at, *values)
    missing = [k for k in range(len(dims)) if k not in a_source and k not in b_source]
    for k in missing:
        if not dims[k]:
            return out.where(F.lit(False))
        step = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dims[k] - 1).cast("long"))).alias("__p")
        out = out.select("idx", *values, step).select((F.col("idx") + F.col("__p") * strides(dims)[k]).alias("idx"), *values)
    return out
