"""Near-duplicate documents by an inverted join over signature coordinates.

Every distinct shingle set has a signature of 64 minimum hashes. It is posted
under its coordinate-value pairs. Two sets of the wanted similarity agree in at
least ``least`` coordinates, but for a chance of about 1e-10, so they share one
among the ``64 - least + 1`` rarest values of either: the prefix, and the only
values that are posted. A value that one set alone holds costs no posting.
Lists are linked by leaders (``graph.link_lists``), members of one component
skipped; the collisions of a pair are counted over whole signatures, and what
is above the threshold is confirmed on the full sets, made anew from the texts.
Equal sets are one node by 128 bits of their name: of two sets that agree in the
first 64 only, one is left alone.

Defined cases: a text without words, or null, is linked with nothing; a text
with fewer words than a shingle is one shingle as a whole; equal sets are one
node, so copies cost no pairs; rows with one doc_id count as one document; a
null doc_id gets a null component and stays; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm import graph
from arrayloom.llm.common import Scratch, maybe_among, surely_not_among
from arrayloom.llm.wordhash import WordHasher, as_long, chunks, distinct, mix, shingles, utf8

COORDINATES = 64


@lru_cache
def least_matches(percent: int, k: int = COORDINATES, risk: float = 1e-10) -> int:
    """The most matches that sets of this similarity reach but for ``risk``."""
    p, below = percent / 100, 0.0
    for t in range(k + 1):
        below += comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > risk:
            return max(1, t)
    return k


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set; the first is never 0 but for no members."""
    if not len(s):
        return 0, 0
    x = int(s.sum(dtype=np.uint64)) ^ int(np.bitwise_xor.reduce(s)) * 0x9E3779B97F4A7C15 ^ len(s)
    y = int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    one, two = as_long(mix(np.array([x & (1 << 64) - 1, y], np.uint64))).tolist()
    return one or 1, two


_ODD = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The coordinates, a row for each of some sets that aren't empty."""
    sign = np.zeros((len(sets), COORDINATES), np.uint64)
    if len(sets):
        flat = np.concatenate(sets)
        first = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
        for c in range(COORDINATES):
            sign[:, c] = np.minimum.reduceat(flat * _ODD[c], first)
        sign = mix(sign + np.arange(COORDINATES, dtype=np.uint64))
    return sign


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), key and key2 (of the set; null if empty) and signature."""
    schema = "doc_id bigint, n bigint, key bigint, key2 bigint, signature array<bigint>"

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for lo, hi in chunks(offsets):
                h, at = hasher.words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                s, at = shingles(h, at, k)
                sets = distinct(s, at)
                some = np.array([len(x) > 0 for x in sets], dtype=bool)
                n = np.array([len(x) for x in sets], np.int64)
                keys = np.array([set_key(x) for x in sets], np.int64).reshape(-1, 2)
                sign = signatures([x for x in sets if len(x)])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(some) * COORDINATES]).astype(np.int32)), pa.array(as_long(sign.reshape(-1)))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), *(pa.array(keys[:, i], mask=~some) for i in (0, 1)), lists],
                    names=["doc_id", "n", "key", "key2", "signature"],
                )

    return docs.mapInArrow(run, schema)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """The number of common values of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    ``texts`` (key, text) has a text of each node. Pairs arrive sorted by b, so
    a leader's set is made once.
    """
    left = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        hasher = WordHasher()
        last, of_last = None, None
        for batch in batches:
            hits = []
            bs = batch.column(1).to_pylist()
            raw, offsets = utf8(batch.column(2))
            sets = []
            for lo, hi in chunks(offsets):
                h, at = hasher.words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                sets += distinct(*shingles(h, at, k))
            raw, offsets = utf8(batch.column(3))
            for i, b in enumerate(bs):
                if b != last:
                    one = raw[offsets[i] : offsets[i + 1]]
                    h, at = hasher.words(one, np.array([0, len(one)]))
                    last, of_last = b, distinct(*shingles(h, at, k))[0]
                common = shared(sets[i], of_last)
                hits.append(common > 0 and 100 * common >= percent * (len(sets[i]) + len(of_last) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hits, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def confirm_blocks(blocks: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The links between heads and other rows of each block, by signature and then full sets."""
    least = least_matches(percent)
    rows = blocks.join(texts.withColumnRenamed("key", "node"), "node").select("cluster", "x", "y", "head", "node", "label", "text")

    def run(t: pa.Table) -> pa.Table:
        hasher = WordHasher()
        sets: list[np.ndarray] = []
        for part in t["text"].chunks:
            raw, offsets = utf8(part)
            for lo, hi in chunks(offsets):
                h, at = hasher.words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                sets += distinct(*shingles(h, at, k))
        sign, n = signatures(sets), np.array([len(x) for x in sets])
        head, label, node = t["head"].to_numpy(), t["label"].to_numpy(), t["node"].to_pylist()
        rest = np.flatnonzero(~head)
        pairs = []
        for i in np.flatnonzero(head):
            matches = (sign[rest] == sign[i]).sum(axis=1)
            fits = (matches >= least) & (label[rest] != label[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))
            pairs += [(-int(matches[j]), int(i), int(rest[j])) for j in np.flatnonzero(fits)]

        def same(i: int, j: int) -> bool:
            common = shared(sets[i], sets[j])
            return 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common)

        found = graph.linked(label.tolist(), [p[1:] for p in sorted(pairs)], same)
        return pa.table({"a": pa.array([node[i] for i, _ in found], pa.int64()), "b": pa.array([node[j] for _, j in found], pa.int64())})

    return rows.groupBy("cluster", "x", "y").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 5,
    percent: int = 80,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id).

    Texts are linked when 100 * |intersection| >= percent * |union| of their
    ``shingle``-word sets, letters A-Z in lower case.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    sketched = scratch.save(sketches(rows, shingle), "sketches")
    of_node = sketched.where("key is not null and doc_id is not null").groupBy("key").agg(
        F.min(F.struct("key2", "doc_id", "n", "signature")).alias("first")
    )
    of_node = of_node.select("key", "first.key2", F.col("first.doc_id").alias("least"), "first.n", "first.signature")
    nodes = scratch.save(of_node, "nodes")
    least = least_matches(percent)
    prefix = COORDINATES - least + 1

    # values that several sets hold, and of these the rarest of each set
    values = nodes.select(F.col("key").alias("node"), F.explode("signature").alias("key"))
    common = scratch.save(values.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "values")
    posted = maybe_among(values, "key", common).join(common, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "key"))).alias("v"))
    alone = COORDINATES - F.size("v")
    posted = posted.where(alone < prefix).select("node", F.explode(F.slice("v", F.lit(1), prefix - alone)).alias("v"))
    postings = scratch.save(posted.select(F.col("v.key").alias("key"), "node"), "postings")

    # the texts of the nodes that are posted at all
    chosen = scratch.save(nodes.join(postings.select(F.col("node").alias("key")).distinct(), "key", "left_semi").select("key", F.col("least").alias("doc_id"), "n", "signature"), "chosen")
    ids = chosen.select("doc_id").distinct()
    again = sketches_keys(maybe_among(rows, "doc_id", ids).join(ids, "doc_id", "left_semi"), shingle)
    texts = scratch.save(again.join(chosen.select("key", "doc_id"), ["key", "doc_id"], "left_semi").dropDuplicates(["key"]).select("key", "text"), "texts")
    sizes = chosen.select("key", "n", "signature")

    def check(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sizes.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa")), "a")
        right = left.join(sizes.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb")), "b")
        matches = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (matches >= least)
        return confirm(scratch.save(right.where(fits).select("a", "b"), "pairs"), texts, shingle, percent)

    label = graph.link_lists(
        postings,
        nodes.select(F.col("key").alias("node"), (F.col("n") * 16).alias("size")),
        check,
        lambda blocks: confirm_blocks(blocks, texts, shingle, percent),
        scratch,
        spare=True,
    )
    member = nodes.join(label.select(F.col("node").alias("key"), "label"), "key", "left").select(
        "key", "key2", "least", F.coalesce("label", "key").alias("label")
    )
    member = scratch.save(member, "members")
    lowest = member.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = scratch.save(member.join(lowest, "label").select("key", "key2", "component_id"), "classes")
    scratch.keep_only(sketched, classes)
    out = sketched.select("doc_id", "n", "key", "key2").join(classes, ["key", "key2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def sketches_keys(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text and the key of its set."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            keys = []
            for lo, hi in chunks(offsets):
                h, at = hasher.words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                keys += [set_key(x)[0] for x in distinct(*shingles(h, at, k))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], names=["doc_id", "text", "key"])

    return docs.mapInArrow(run, "doc_id bigint, text string, key bigint")


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose document stands for its class.

    Rows travel as one column, so that no name can clash; those whose document
    is in no class of several, by a sketch, aren't shuffled.
    """
    gone = near_duplicates(docs, id_column=id_column, **options).where("not kept").select(F.col("doc_id").alias("id")).distinct()
    gone = Scratch(docs.sparkSession, "minhash-gone").save(gone, "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_column}`").cast("long").alias("id"))
    kept = surely_not_among(rows, "id", gone).unionAll(maybe_among(rows, "id", gone).join(gone, "id", "left_anti").select("row", "id"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
