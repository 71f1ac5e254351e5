"""Stable sorts: positions by keys, payloads along."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.sources.vectors import ranked


def sort_by_key(df: DataFrame, *keys: Column | str, values: Sequence[str] | None = None) -> DataFrame:
    """The vector in the order of ``keys`` (columns, ``.desc()`` for descending).

    A comparator other than less or greater is given as the tuple of keys that
    it compares, say parity before value. Equal keys keep their order.
    """
    names = [c for c in df.columns if c != "idx"] if values is None else list(values)
    order = [F.col(k) if isinstance(k, str) else k for k in keys]
    return ranked(df, *order, F.col("idx")).select(F.col("pos").alias("idx"), *names)


def sort(df: DataFrame, *names: str, descending: bool = False) -> DataFrame:
    """Keys alone, in order."""
    order = [F.col(n).desc() if descending else F.col(n).asc() for n in names]
    return sort_by_key(df, *order, values=names)
