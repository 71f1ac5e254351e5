"""The corpus pipeline: five stages, each written as Parquet and read again.

Every stage works on all rows that the one before has kept. Defined cases, for
all stages: a null or empty text fails the base rules and goes in the first; rows
with equal id and text share their verdicts, and the near-duplicate stage keeps
the rows of the document that stands for its class; a null doc_id stays null and is nobody's
copy; columns other than doc_id and text pass through, whatever their names,
and n_chars follows the text where it is there; an empty table passes as an
empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.llm import decontaminate, lines, minhash, packing, quality
from arrayloom.llm.common import WORD_SPLIT, Scratch, gathered, sweep
from arrayloom.sources.tables import table


#: Tables that the last stage of a run reads, by application, thread and input.
_left: dict[tuple, list[Scratch]] = {}


def _stage(f: Callable) -> Callable:
    """A stage's own tables go when the next stage of the run begins: its output has been written by then."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        at = (spark.sparkContext.applicationId, get_ident(), sf_dir)
        for scratch in _left.pop(at, []):
            scratch.release()
        sweep(spark)
        with gathered() as _left[at]:
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-supervision rules keep."""
    return quality.keep_good(docs)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another line stands for; one that has
    lost all its words goes."""
    names = ("line_dedup n_lines", "line_dedup n_gone")
    out = lines.dedup_lines(docs, counts=names)
    gone = F.col(names[1])
    no_words = F.regexp_replace(F.coalesce("text", F.lit("")), WORD_SPLIT, "") == ""
    out = out.where(~no_words | (gone == 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(gone > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return minhash.keep_one(docs)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids; one row a piece."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pack", pack),
]

#: EM, SimHash and tokenizing aren't SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
