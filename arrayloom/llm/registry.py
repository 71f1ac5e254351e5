"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arrayloom.llm import chat, decontaminate, html, lines, minhash, packing, passages, quality, shards, surrogates
from arrayloom.llm.common import Scratch
from arrayloom.sources.tables import table


def op1_keyed_surrogates(spark, d):
    """All documents with surrogates for personal data and secrets."""
    return surrogates.replace_entities(table(spark, d, "documents"), key=b"a key for the synthetic tables")


def op2_compact_windows(spark, d):
    """Every passage of 50 words or more that near-repeats in another document."""
    return passages.repeated_passages(table(spark, d, "documents"))


def op3_size_tiered_compaction(spark, d):
    """All documents in eight arrivals, read back from the compacted store."""
    store = shards.ShardStore(spark, Scratch(spark, "store").base)
    shards.ingest(table(spark, d, "documents"), store)
    return store.read().select(
        "doc_id",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.col("_metadata.file_name").alias("shard"),
        F.col("_metadata.file_size").alias("shard_bytes"),
    )


def op4_minhash_inverted_join(spark, d):
    """Near-duplicate classes of all documents: 3-word shingles, 85 %."""
    return minhash.near_duplicates(table(spark, d, "documents"), shingle=3, percent=85)


def op5_simhash_decontamination(spark, d):
    """Documents and the benchmark items that they hold."""
    return decontaminate.find(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op6_fuzzy_lines(spark, d):
    """Every document without the lines that another line stands for."""
    out = lines.dedup_lines(table(spark, d, "documents"))
    return out.select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_gone").alias("n_gone"))


def op7_html_main_text(spark, d):
    """Main text of every page."""
    return html.extract(table(spark, d, "pages"))


def op8_sum_of_squares_packing(spark, d):
    """All documents in windows of 2048 ids; one row a piece."""
    return packing.pack(table(spark, d, "documents"))


def op9_chat_formatting(spark, d):
    """All conversations, and one whose texts say control strings."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digest(chat.format_conversations(turns.unionByName(own)))


def op10_quality_votes(spark, d):
    """Counts, posterior and verdict of every document."""
    return quality.score(table(spark, d, "documents"))


_QUERIES = [
    op1_keyed_surrogates,
    op2_compact_windows,
    op3_size_tiered_compaction,
    op4_minhash_inverted_join,
    op5_simhash_decontamination,
    op6_fuzzy_lines,
    op7_html_main_text,
    op8_sum_of_squares_packing,
    op9_chat_formatting,
    op10_quality_votes,
]

#: The near-duplicate classes by all pairs with a common shingle. Texts aren't
#: cut; at large scale factors this takes long.
_OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.x = d.doc_id
"""

_ORACLES: dict[str, str] = {"op4_minhash_inverted_join": _OP4}


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    return dict(_ORACLES)
