"""What the corpus operators share: shared scratch tables and word rules."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls from tab to carriage return.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir.

    Where the setting is absent, a session on one machine (local master, as in
    tests) gets a temporary folder; on a cluster that is an error, as executors
    would write to their own disks.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="arrayloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class _Open(list):
    """The open lists of ``gathered``. They stay on the driver: what is sent to executors has none."""

    def __reduce__(self):
        return _Open, ()


_gathering: list[list[Scratch]] = _Open()


class Scratch:
    """Tables written once to the shared folder, so that later jobs read them
    rather than compute them again and a lost executor costs no lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        if _gathering:
            _gathering[-1].append(self)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        at = f"{self.base}/{self.n}-{name}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(at)
        back = self.spark.read.schema(df.schema).parquet(at)
        back.scratch_path = at
        return back

    def _delete(self, at: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that no later plan reads."""
        for t in tables:
            self._delete(t.scratch_path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all written tables but these, and let shuffles go that no plan needs."""
        kept = {t.scratch_path.rsplit("/", 1)[1] for t in tables}
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(path) if fs.exists(path) else []:
            if status.getPath().getName() not in kept:
                fs.delete(status.getPath(), True)
        sweep(self.spark)

    def release(self) -> None:
        """Delete all its tables; plans that read them must have run."""
        self._delete(self.base)


@contextmanager
def gathered() -> Iterator[list[Scratch]]:
    """The Scratch objects that are made meanwhile, for who knows when their tables have been read."""
    _gathering.append([])
    try:
        yield _gathering[-1]
    finally:
        _gathering.pop()


def sweep(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that are gone; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bits of a membership sketch: 1 MB, at most 131072 rows when it is broadcast.
SKETCH_BITS = 1 << 23


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SKETCH_BITS))


def _sketched(df: DataFrame, key: str, members: DataFrame, how: str) -> tuple[DataFrame, Column]:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _slot(F.col(key)).bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright(_slot(F.col(key)), 6)
    bits = members.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    joined = df.withColumn("__word", word).join(F.broadcast(bits), "__word", how)
    return joined, F.coalesce(F.col("__bits").bitwiseAND(bit), F.lit(0).cast("long")) != 0


def maybe_among(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key may be one of ``members``; none that is is lost.

    A sketch of SKETCH_BITS bits is broadcast, whatever the members' number, so
    that most other rows needn't be shuffled to the exact join that follows.
    """
    joined, hit = _sketched(df, key, members, "inner")
    return joined.where(hit).select(*[F.col(f"`{c}`") for c in df.columns])


def surely_not_among(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """The other rows, null keys included."""
    joined, hit = _sketched(df, key, members, "left")
    return joined.where(~hit).select(*[F.col(f"`{c}`") for c in df.columns])


def let(value: Column, f) -> Column:
    """f(value), with value computed once even where f uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), "")
