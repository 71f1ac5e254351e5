"""Prefix scans, plain and by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.operators.blocks import BLOCK, SUM, Fold, keyed, running


def inclusive_scan(df: DataFrame, value: str = "v", fold: Fold = SUM, out: str = "scan", size: int = BLOCK) -> DataFrame:
    return running(df, F.col(value), fold, out=out, size=size)


def exclusive_scan(df: DataFrame, value: str = "v", fold: Fold = SUM, init=None, out: str = "scan", size: int = BLOCK) -> DataFrame:
    return running(df, F.col(value), fold, exclusive=True, init=init, out=out, size=size)


def inclusive_scan_by_key(
    df: DataFrame, keys: Sequence[str], value: str = "v", fold: Fold = SUM, out: str = "scan", size: int = BLOCK, changed: Column | None = None
) -> DataFrame:
    """The scan starts anew wherever adjacent keys differ."""
    return keyed(df, keys, F.col(value), fold, out=out, run="__run", size=size, changed=changed).drop("__run")


def exclusive_scan_by_key(
    df: DataFrame, keys: Sequence[str], value: str = "v", fold: Fold = SUM, init=None, out: str = "scan", size: int = BLOCK, changed: Column | None = None
) -> DataFrame:
    return keyed(df, keys, F.col(value), fold, exclusive=True, init=init, out=out, run="__run", size=size, changed=changed).drop("__run")
