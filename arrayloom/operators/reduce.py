"""Reductions: whole vectors, by adjacent key, by dimension, and scatter-adds."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from arrayloom.operators.blocks import BLOCK, runs

#: Value of an empty MIN or MAX: the limit of the type.
LIMITS = {
    "double": (-1.7976931348623157e308, 1.7976931348623157e308),
    "bigint": (-(1 << 63), (1 << 63) - 1),
    "int": (-(1 << 31), (1 << 31) - 1),
}


def total(x: Column, kind: str = "double") -> Column:
    """The sum; 0 of nothing."""
    return F.coalesce(F.sum(x.cast(kind)), F.lit(0).cast(kind))


def least(x: Column, kind: str = "double") -> Column:
    return F.coalesce(F.min(x.cast(kind)), F.lit(LIMITS[kind][1]).cast(kind))


def greatest(x: Column, kind: str = "double") -> Column:
    return F.coalesce(F.max(x.cast(kind)), F.lit(LIMITS[kind][0]).cast(kind))


def count_if(x: Column) -> Column:
    return F.count_if(x)


def combined(**aggregates: Column) -> list[Column]:
    """Several reductions in one pass."""
    return [a.alias(n) for n, a in aggregates.items()]


def any_of(x: Column) -> Column:
    return F.coalesce(F.bool_or(x), F.lit(False))


def all_of(x: Column) -> Column:
    return F.coalesce(F.bool_and(x), F.lit(True))


#: A mantissa of 53 bits is summed in three pieces of 18 bits, exactly for up to 2 ** 44 rows.
_PIECE = 18
_LEAST = -1126  # exponent of the last bit of the smallest number


def exact_sum(df: DataFrame, x: Column, by: Sequence[str] = (), out: str = "total") -> DataFrame:
    """Sums rounded once: the correctly rounded sum of all values, in whatever order.

    Every value becomes its exponent and three whole pieces of its mantissa, which
    Spark sums by key and exponent, so a key has some 2,000 rows at most before
    its sum is rounded. Nulls count as nothing; infinities and NaN as usual.
    """
    names = list(by)
    rows = df.select(*names, x.cast("double").alias("__x"))
    made = ["__e int", "__a bigint", "__b bigint", "__c bigint", "__odd double"]
    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.select(*names).dtypes], *made])

    def cut(batches):
        for batch in batches:
            v = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(float)
            v = np.where(np.asarray(batch.column(len(names)).is_null()), 0.0, v)
            odd = ~np.isfinite(v)
            m, e = np.frexp(np.where(odd, 0.0, v))
            whole = (m * 2.0**53).astype(np.int64)
            mask = (1 << _PIECE) - 1
            pieces = [whole >> 2 * _PIECE, whole >> _PIECE & mask, whole & mask]
            columns = [pa.array(e.astype(np.int32)), *map(pa.array, pieces), pa.array(np.where(odd, v, 0.0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], names=[*names, *[c.split()[0] for c in made]])

    parts = rows.mapInArrow(cut, schema)
    summed = parts.groupBy(*names, "__e").agg(*[F.sum(c).alias(c) for c in ("__a", "__b", "__c", "__odd")])
    each = F.collect_list(F.struct("__e", "__a", "__b", "__c"))  # one entry an exponent
    return summed.groupBy(*names).agg(each.alias("__parts"), F.sum("__odd").alias("__odd")).select(
        *names, F.when(F.col("__odd") != 0, F.col("__odd")).otherwise(_rounded()("__parts")).alias(out)
    )


def _rounded():
    @pandas_udf(DoubleType())
    def rounded(parts: pd.Series) -> pd.Series:
        def one(entries) -> float:
            total = sum(((p["__a"] << 2 * _PIECE) + (p["__b"] << _PIECE) + p["__c"]) << p["__e"] - 53 - _LEAST for p in entries)
            try:
                return total / (1 << -_LEAST)  # rounds once
            except OverflowError:
                return math.inf if total > 0 else -math.inf

        return pd.Series([one(p) for p in parts], index=parts.index, dtype=float)

    return rounded


@dataclass(frozen=True)
class Reduction:
    """A reduction of one's own: a state begins as ``initial``, takes values by ``step``, and joins a later state by ``merge``.

    ``merge`` must be associative, and ``initial`` its identity; the order of
    positions is kept, so it needn't commute. All are Catalyst expressions.
    """

    initial: Column
    step: Callable[[Column, Column], Column]
    merge: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] = lambda state: state


def reduce_with(df: DataFrame, value: Column, kind: Reduction, by: Sequence[str] = (), *, idx: str = "idx", size: int = 1 << 12, out: str = "total") -> DataFrame:
    """One's own reduction over positions, for each key of ``by``.

    Every ``size`` positions are folded where they meet, then every ``size``
    states, and so on: no task holds more than ``size`` rows of one fold at once.
    """
    last = df.agg(F.max(idx)).first()[0]

    def folded(t: DataFrame, f: Callable, place: Column) -> DataFrame:
        keys = [*by, place.alias("__at")]
        ordered = F.array_sort(F.collect_list(F.struct(F.col("__place"), F.col("__item"))))
        return t.groupBy(*keys).agg(F.aggregate(ordered, kind.initial, lambda s, x: f(s, x["__item"])).alias("__item")).withColumnRenamed("__at", "__place")

    t = folded(df.select(*by, F.col(idx).alias("__place"), value.alias("__item")), kind.step, F.floor(F.col("__place") / size).cast("long"))
    blocks = 0 if last is None else last // size
    while blocks:
        t = folded(t, kind.merge, F.floor(F.col("__place") / size).cast("long"))
        blocks //= size
    if last is None and not by:
        t = df.sparkSession.range(1).select(kind.initial.alias("__item"))
    return t.select(*by, kind.finish(F.col("__item")).alias(out))


def reduce_by_key(df: DataFrame, keys: Sequence[str], size: int = BLOCK, changed: Column | None = None, **aggregates: Column) -> DataFrame:
    """One row for each run of equal adjacent keys: idx (number of the run), keys, aggregates."""
    first = [F.min_by(k, "idx").alias(k) for k in keys]
    return runs(df, keys, size, changed).groupBy("run").agg(*first, *combined(**aggregates)).withColumnRenamed("run", "idx")


def scatter_fold(df: DataFrame, target: Column, n: int, fold: Callable[[Column], Column], value: Column, empty=0, out: str = "v") -> DataFrame:
    """All targets 0 .. n - 1 with the fold of what is sent to them."""
    sent = df.groupBy(target.cast("long").alias("idx")).agg(fold(value).alias(out))
    cells = df.sparkSession.range(n).select(F.col("id").alias("idx"))
    return cells.join(sent, "idx", "left").select("idx", F.coalesce(out, F.lit(empty)).alias(out))


def histogram(df: DataFrame, bin_: Column, n: int) -> DataFrame:
    return scatter_fold(df, bin_, n, F.sum, F.lit(1).cast("long"), 0, "n")


def last_written(df: DataFrame, target: Column, value: str = "v") -> DataFrame:
    """What an exchange leaves in a cell: the value of the largest idx."""
    return df.groupBy(target.cast("long").alias("cell")).agg(F.max_by(value, "idx").alias(value)).withColumnRenamed("cell", "idx")
