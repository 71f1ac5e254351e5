"""Vectors as DataFrames: a dense 0-based position ``idx`` and value columns.

Vectors that travel together are columns of one DataFrame; nothing is joined
until positions change.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.sources.scratch import stored


def vector(df: DataFrame, idx: str, **values) -> DataFrame:
    """(idx, values...) from a table with a dense key column."""
    cols = {k: (v if isinstance(v, Column) else F.col(v)) for k, v in values.items()}
    return df.select(F.col(idx).cast("long").alias("idx"), *[v.alias(k) for k, v in cols.items()])


def from_values(spark: SparkSession, values: Sequence, kind: str = "double", name: str = "v") -> DataFrame:
    """A vector of values on the driver."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"idx bigint, {name} {kind}")


def to_values(df: DataFrame, name: str = "v") -> list:
    """The values of a vector on the driver, in order."""
    return [r[0] for r in df.orderBy("idx").select(name).collect()]


def element_index(spark: SparkSession, length: int, offset: int = 0) -> DataFrame:
    """(idx, i): a sized vector of its own positions, shifted by ``offset``."""
    return spark.range(length).select(F.col("id").alias("idx"), (F.col("id") + offset).alias("i"))


def element(df: DataFrame, i: int) -> DataFrame:
    return df.where(F.col("idx") == i)


def copy_range(df: DataFrame, begin: int, end: int, to: int = 0) -> DataFrame:
    """Positions begin .. end - 1, moved to ``to`` and on."""
    return df.where((F.col("idx") >= begin) & (F.col("idx") < end)).withColumn("idx", F.col("idx") - begin + to)


def cleared(df: DataFrame) -> DataFrame:
    return df.select("idx", *[F.lit(0).cast(t).alias(c) for c, t in df.dtypes if c != "idx"])


def resized(df: DataFrame, n: int) -> DataFrame:
    """The first n positions; new ones hold zero."""
    old = df.where(F.col("idx") < n)
    size = df.count()
    if size >= n:
        return old
    return old.unionByName(cleared(df.sparkSession.range(size, n).select(F.col("id").alias("idx"), *[F.lit(0).cast(t).alias(c) for c, t in df.dtypes if c != "idx"])))


def interleave_components(df: DataFrame, value: str = "v") -> DataFrame:
    """The components of short vectors as one longer vector."""
    return df.select("idx", F.size(value).alias("k"), F.posexplode(value).alias("p", "v")).select(
        (F.col("idx") * F.col("k") + F.col("p")).alias("idx"), "v"
    )


def split_components(df: DataFrame, n: int, value: str = "v", prefix: str = "c") -> DataFrame:
    """A vector of n contiguous parts of equal size as n components."""
    size = df.count() // n
    part = F.col("idx") % size
    return df.groupBy(part.alias("idx")).agg(
        *[F.max(F.when(F.floor(F.col("idx") / size) == k, F.col(value))).alias(f"{prefix}{k}") for k in range(n)]
    )


def joined_components(df: DataFrame, components: Iterable[str], size: int) -> DataFrame:
    """Components laid one after the other in one vector."""
    names = list(components)
    each = F.posexplode(F.array(*names)).alias("p", "v")
    return df.select("idx", each).select((F.col("p") * F.lit(size) + F.col("idx")).alias("idx"), "v")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with a dense ``pos`` by ``order``, which should be a total order.

    One range shuffle; a place is its partition's offset, from the partition
    sizes (one row a partition), plus its place in the sorted partition. No
    window over all rows.
    """
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spread = df.repartitionByRange(int(n), *order).sortWithinPartitions(*order)
    placed = stored(spread.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = sizes.select(
        "__part", (F.sum("n").over(_by_part()) - F.col("n")).alias("__before")
    )
    within = F.col("__at") - F.shiftleft(part, 33)
    return placed.withColumn("__part", part).join(before, "__part").withColumn("pos", within + F.col("__before")).drop("__at", "__part", "__before")


def _by_part():
    from pyspark.sql import Window

    return Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)


@dataclass(frozen=True)
class Properties:
    """What an expression over vectors knows of itself: positions, components and their types."""

    size: int
    types: dict[str, str]

    @property
    def components(self) -> int:
        return len(self.types)


def properties(*vectors: DataFrame) -> Properties:
    """Of vectors in one expression: sizes must agree, but a vector of one position fits any."""
    sizes = [v.count() for v in vectors]
    large = {n for n in sizes if n != 1}
    if len(large) > 1:
        raise ValueError(f"vectors of {' and '.join(map(str, sorted(large)))} positions")
    types = {c: t for v in vectors for c, t in v.dtypes if c != "idx"}
    return Properties(max(sizes, default=0), types)


def same_size(a: DataFrame, b: DataFrame) -> None:
    """Raise ValueError unless both have as many positions."""
    m, n = a.count(), b.count()
    if m != n:
        raise ValueError(f"vectors of {m} and {n} positions")


def aligned(a: DataFrame, b: DataFrame, strict: bool = False) -> DataFrame:
    """Two vectors as columns of one DataFrame, by position."""
    if strict:
        same_size(a, b)
    return a.join(b, "idx")


def text_table(df: DataFrame, value: str = "v", per_line: int = 10) -> DataFrame:
    """(line, text): a vector as text, ``per_line`` values a line, each line with its first position.

    Lines are made where their values are; nothing comes to the driver. Missing
    values are left out, and a line of nothing else is null.
    """
    line = F.floor(F.col("idx") / per_line).alias("line")
    rows = df.groupBy(line).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.col(value).alias("x")))), lambda p: p.x).alias("x"))

    def run(batches):
        for batch in batches:
            lines = batch.column(0).to_pylist()
            given = ([v for v in x if v is not None] for x in batch.column(1).to_pylist())
            texts = [f"{k * per_line:6d}: " + " ".join(f"{v:12.4g}" for v in x) if x else None for k, x in zip(lines, given, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array(texts, pa.string())], names=["line", "text"])

    return rows.mapInArrow(run, "line bigint, text string")


def text_lines(df: DataFrame, value: str = "v", per_line: int = 10) -> list[str]:
    """The lines of a short vector on the driver, in order."""
    return [r["text"] for r in text_table(df, value, per_line).orderBy("line").collect()]
