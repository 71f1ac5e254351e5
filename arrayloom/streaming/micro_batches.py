"""The element-wise and keyed operators on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elementwise(stream: DataFrame, **columns: Column) -> DataFrame:
    """A projection: stateless, so it runs on a stream as on a table."""
    return stream.select("*", *[c.alias(n) for n, c in columns.items()])


def windowed_fold(stream: DataFrame, time: str, width: str, late: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates by event-time window and keys; state older than ``late`` is dropped."""
    w = F.window(F.col(time), width)
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()]).select(F.col("w.start").alias("start"), *keys, *aggregates)


def to_table(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None):
    """Run what has arrived, batch by batch, into Parquet; the finished query."""

    def write(batch: DataFrame, number: int) -> None:
        out = each(batch) if each else batch
        # a batch that is repeated after a failure replaces its own folder
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
