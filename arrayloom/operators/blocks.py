"""Positions cut into blocks: running totals and neighbours without a global window."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions to a block: what one task sorts, and the divisor of the totals' number.
BLOCK = 1 << 14


@dataclass(frozen=True)
class Fold:
    """An associative operator: its aggregate, its combination and its identity."""

    agg: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    identity: object


SUM = Fold(F.sum, lambda a, b: a + b, 0)
MIN = Fold(F.min, lambda a, b: F.least(a, b), None)
MAX = Fold(F.max, lambda a, b: F.greatest(a, b), None)
BIT_AND = Fold(F.bit_and, lambda a, b: a.bitwiseAND(b), -1)
BIT_OR = Fold(F.bit_or, lambda a, b: a.bitwiseOR(b), 0)
BIT_XOR = Fold(F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0)
PRODUCT = Fold(F.product, lambda a, b: a * b, 1.0)


def block_of(idx: Column, size: int = BLOCK) -> Column:
    return F.floor(idx / size)


def _joined(fold: Fold, carry: Column, mine: Column) -> Column:
    return F.when(carry.isNull(), mine).when(mine.isNull(), carry).otherwise(fold.combine(carry, mine))


def _started(fold: Fold, got: Column, exclusive: bool, init) -> Column:
    """An exclusive scan begins with ``init`` or the identity."""
    start = fold.identity if exclusive and init is None else init if exclusive else None
    if start is None:
        return got
    return F.when(got.isNull(), F.lit(start)).otherwise(got if init is None else fold.combine(F.lit(init), got))


def _carried(totals: DataFrame, fold: Fold, by: Sequence[str], size: int) -> DataFrame:
    """by, __block and __carry, the fold of __t over the earlier blocks.

    In two levels: inside every ``size`` blocks, and over the totals of these,
    which are a ``size ** 2``-th of the rows.
    """
    high = totals.withColumn("__high", block_of(F.col("__block"), size))
    before = (Window.unboundedPreceding, -1)
    near = high.withColumn("__near", fold.agg("__t").over(Window.partitionBy(*by, "__high").orderBy("__block").rowsBetween(*before)))
    tops = high.groupBy(*by, "__high").agg(fold.agg("__t").alias("__u"))
    order = Window.partitionBy(*by).orderBy("__high") if by else Window.orderBy("__high")
    above = tops.select(*by, "__high", fold.agg("__u").over(order.rowsBetween(*before)).alias("__above"))
    return near.join(above, [*by, "__high"]).select(*by, "__block", _joined(fold, F.col("__above"), F.col("__near")).alias("__carry"))


def running(
    df: DataFrame,
    value: Column,
    fold: Fold = SUM,
    *,
    by: Sequence[str] = (),
    exclusive: bool = False,
    init=None,
    out: str = "scan",
    size: int = BLOCK,
) -> DataFrame:
    """``df`` with the running fold of ``value`` over idx, inside the keys ``by``.

    A window inside every block, one total a block (combined before they are
    shuffled), the totals carried in two levels, and a join back on the block. A
    long run of one key is cut into blocks like any other.
    """
    keys = [*by, "__block"]
    d = df.withColumn("__block", block_of(F.col("idx"), size)).withColumn("__v", value)
    inside = Window.partitionBy(*keys).orderBy("idx")
    own = fold.agg("__v").over(inside.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0))
    totals = d.groupBy(*keys).agg(fold.agg("__v").alias("__t"))
    joined = d.withColumn("__own", own).join(_carried(totals, fold, by, size), keys)
    got = _started(fold, _joined(fold, F.col("__carry"), F.col("__own")), exclusive, init)
    return joined.withColumn(out, got).drop("__block", "__v", "__own", "__carry")


def with_neighbours(df: DataFrame, before: int, after: int, size: int = BLOCK) -> DataFrame:
    """Rows copied to every block within reach: adds block and own (is it home there?).

    Only rows next to a block's edge are copied, so a following window by
    block sees ``before`` earlier and ``after`` later positions of every row.
    """
    home = block_of(F.col("idx"), size)
    lo = block_of(F.col("idx") - after, size)
    hi = block_of(F.col("idx") + before, size)
    return df.withColumn("block", F.explode(F.sequence(lo, hi))).withColumn("own", F.col("block") == home)


def shifted(df: DataFrame, values: dict[str, tuple[Column, int]], size: int = BLOCK) -> DataFrame:
    """``df`` with columns name = value at position idx + shift (null outside)."""
    before = max([0, *[-s for _, s in values.values()]])
    after = max([0, *[s for _, s in values.values()]])
    w = Window.partitionBy("block").orderBy("idx")
    wide = with_neighbours(df, before, after, size)
    cols = {n: F.lag(v, -s).over(w) if s < 0 else F.lead(v, s).over(w) if s else v for n, (v, s) in values.items()}
    return wide.select("*", *[c.alias(n) for n, c in cols.items()]).where("own").drop("block", "own")


def keyed(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | None = None,
    fold: Fold = SUM,
    *,
    exclusive: bool = False,
    init=None,
    out: str = "scan",
    run: str = "run",
    size: int = BLOCK,
    changed: Column | None = None,
) -> DataFrame:
    """``df`` with ``run``, the 0-based number of its run of equal adjacent keys, and the running fold inside it.

    Rows are shuffled once, by block, with the row before each block: where runs
    begin, their numbers in the block and their folds are windows over that.
    Blocks have the number of runs that begin in them and the fold of the last one;
    what comes into a block is the fold of these since a run last began. Without
    ``value`` only the number is made. ``changed`` replaces inequality; it sees
    the earlier keys as ``prev_<key>``.
    """
    wide = with_neighbours(df.withColumn("__here", F.lit(True)), 1, 0, size)
    w = Window.partitionBy("block").orderBy("idx")
    earlier = [F.lag(k).over(w).alias(f"prev_{k}") for k in keys]
    wide = wide.select("*", F.lag("__here").over(w).alias("__any"), *earlier).where("own")
    if changed is None:
        changed = F.lit(False)
        for k in keys:
            changed = changed | ~F.col(k).eqNullSafe(F.col(f"prev_{k}"))
    begins = (F.col("__any").isNotNull() & changed).cast("long")
    rows = wide.withColumn("__v", F.lit(None).cast("long") if value is None else value).withColumn("__begins", begins)
    rows = rows.withColumn("__local", F.sum("__begins").over(w)).drop("own", "__here", "__any", "__begins", *[f"prev_{k}" for k in keys])
    inside = Window.partitionBy("block", "__local").orderBy("idx")
    parts = rows.groupBy("block", "__local").agg(fold.agg("__v").alias("__t"))  # where it stands already: by block
    ends = parts.groupBy("block").agg(F.max("__local").alias("begun"), F.max_by("__t", "__local").alias("tail"))
    ends = running(ends.withColumnRenamed("block", "idx"), F.col("begun"), SUM, exclusive=True, out="base", size=size)
    if value is not None:
        ends = running(ends, (F.col("begun") > 0).cast("long"), SUM, out="stretch", size=size)
        ends = running(ends, F.col("tail"), fold, by=["stretch"], out="inward", size=size)
        into = ends.select((F.col("idx") + 1).alias("idx"), F.col("inward").alias("__carry"))
        ends = ends.select("idx", "base").join(into, "idx", "left")
    else:
        ends = ends.select("idx", "base", F.lit(None).alias("__carry"))
    joined = rows.withColumn("__own", fold.agg("__v").over(inside.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)))
    joined = joined.join(ends.select(F.col("idx").alias("block"), "base", "__carry"), "block")
    if value is not None:
        here = F.when(F.col("__local") == 0, F.col("__carry"))
        joined = joined.withColumn(out, _started(fold, _joined(fold, here, F.col("__own")), exclusive, init))
    return joined.withColumn(run, F.col("base") + F.col("__local")).drop("block", "__v", "__local", "__own", "__carry", "base")


def runs(df: DataFrame, keys: Sequence[str], size: int = BLOCK, changed: Column | None = None) -> DataFrame:
    """``df`` with ``run``: the 0-based number of its run of equal adjacent keys."""
    return keyed(df, keys, size=size, changed=changed)
