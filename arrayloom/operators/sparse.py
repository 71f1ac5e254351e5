"""Sparse matrices as (row, col, val) tables, and their products with vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Entries or rows of a part, so that what a task holds doesn't grow with the matrix.
PART = 1 << 19


def parts(n: int, least: int) -> int:
    """In how many parts n entries or rows are held."""
    return max(least, -(-n // PART))


@dataclass(frozen=True)
class Semiring:
    """What a product and a sum are for the element type; ``add`` aggregates."""

    mul: Callable[[Column, Column], Column]
    add: Callable[[Column], Column]
    zero: Column


def real() -> Semiring:
    return Semiring(lambda a, b: a * b, F.sum, F.lit(0.0))


def complex_() -> Semiring:
    """struct(re, im) elements."""

    def mul(a: Column, b: Column) -> Column:
        return F.struct((a.re * b.re - a.im * b.im).alias("re"), (a.re * b.im + a.im * b.re).alias("im"))

    def pair(re, im) -> Column:
        return F.struct(re.alias("re"), im.alias("im"))

    return Semiring(mul, lambda x: pair(F.sum(x.re), F.sum(x.im)), pair(F.lit(0.0), F.lit(0.0)))


def componentwise(n: int) -> Semiring:
    """Arrays of n numbers, multiplied element by element."""
    return Semiring(
        lambda a, b: F.array(*[a[k] * b[k] for k in range(n)]), lambda x: F.array(*[F.sum(x[k]) for k in range(n)]), F.array(*[F.lit(0.0)] * n)
    )


def blocks(n: int) -> Semiring:
    """n x n row-major blocks in the matrix, n-vectors in the vector."""
    return Semiring(
        lambda a, x: F.array(*[sum((a[r * n + c] * x[c] for c in range(1, n)), a[r * n] * x[0]) for r in range(n)]),
        lambda x: F.array(*[F.sum(x[k]) for k in range(n)]),
        F.array(*[F.lit(0.0)] * n),
    )


def product(a: DataFrame, x: DataFrame, n_rows: int, *values: str, ring: Semiring | None = None) -> DataFrame:
    """A x for each value column of ``x``: one join for all, zero for empty rows.

    The join and the sum by row are equi-joins and a partial aggregate; a
    long row is summed where it is read before it is shuffled.
    """
    ring = ring or real()
    names = values or ("v",)
    joined = a.join(x.select(F.col("idx").alias("col"), *[F.col(c).alias(f"__{c}") for c in names]), "col")
    terms = joined.select("row", *[ring.mul(F.col("val"), F.col(f"__{c}")).alias(c) for c in names])
    # a zero for every row, so that empty ones are there without one more join
    spark = a.sparkSession
    zeros = spark.range(0, n_rows, 1, parts(n_rows, spark.sparkContext.defaultParallelism)).select("id", *[ring.zero.alias(c) for c in names])
    return terms.union(zeros).groupBy(F.col("row").alias("idx")).agg(*[ring.add(F.col(c)).alias(c) for c in names])


def repeated_rows_product(rows: DataFrame, patterns: DataFrame, x: DataFrame) -> DataFrame:
    """The product with a matrix of few distinct rows.

    ``rows`` (idx, pattern) names the row of every position and ``patterns``
    (pattern, shift, val) holds them, columns relative to the diagonal.
    """
    entries = rows.join(patterns, "pattern").select(F.col("idx").alias("row"), (F.col("idx") + F.col("shift")).alias("col"), "val")
    terms = entries.join(x.select(F.col("idx").alias("col"), "v"), "col").select("row", (F.col("val") * F.col("v")).alias("v"))
    return terms.union(rows.select("idx", F.lit(0.0))).groupBy(F.col("row").alias("idx")).agg(F.sum("v").alias("v"))
