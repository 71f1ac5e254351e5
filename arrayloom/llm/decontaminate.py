"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a document that is as long as a benchmark item, in words, has a
SimHash, the bitwise majority of its words' hashes. Fingerprints within
``RADIUS`` bits of an item's are found by comparison with all items of that size,
which misses none of them; RADIUS is wide, so that windows of the wanted
similarity are seldom beyond it. A document shorter than an item is compared
with it as a whole, whatever the fingerprints. What is found is verified on the windows'
5-word shingles: the sum of smaller counts over the sum of larger counts, each
shingle weighted by the bytes of its words. As that similarity is zero without
a common shingle, only windows that hold a shingle of an item of their size are
fingerprinted.

Words are compared without ASCII punctuation and case. Items go out in
blocks of at most ``BLOCK_BYTES`` of text, one pass over the documents a block;
a pass is narrow: nothing is shuffled.

Defined cases: null or empty texts have no windows; an item with fewer than
five words matches where its whole sequence occurs; an item without words
matches nothing; repeated documents and items are each reported; a null id
stays null; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm.wordhash import ByteRules, WordHasher, chunks, sequences, shingles, utf8

RADIUS = 24
K = 5
BLOCK_BYTES = 8 << 20
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MATCHES = "doc_id bigint, item_id bigint, start bigint, n_words bigint, similarity double, distance bigint"


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).reshape(-1)


def simhashes(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The fingerprints of the n-word windows that begin at ``starts``."""
    lo = int(starts.min())
    sums = np.zeros((int(starts.max()) + n - lo + 1, 64), np.int32)
    np.cumsum(_bits(np.ascontiguousarray(h[lo : lo + len(sums) - 1])), axis=0, out=sums[1:])
    return _pack(2 * (sums[starts - lo + n] - sums[starts - lo]) > n)


def weighted(h: np.ndarray, sizes: np.ndarray) -> Counter:
    """shingle -> (bytes of its words) times its count, by one of each."""
    s, _ = shingles(h, np.array([0, len(h)]), K)
    total = np.concatenate([[0], np.cumsum(sizes)])
    k = min(K, len(h))
    bytes_ = total[k:] - total[: len(total) - k]
    found: Counter = Counter()
    for x, b in zip(s.tolist(), bytes_.tolist(), strict=True):
        found[x, b] += 1
    return found


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) * s[1] for s, n in a.items() if s in b)
    every = sum(n * s[1] for s, n in a.items()) + sum(n * s[1] for s, n in b.items()) - both
    return both / every if every else 0.0


class ItemIndex:
    """The items of a block, in lower case: shingles, fingerprints, their tables."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.hasher = WordHasher(ByteRules(drop=PUNCTUATION))
        self.ids, self.counts, self.n = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        sign, by_shingle = [], {}
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            h, sizes, _ = self.hasher.sized_words(raw, np.array([0, len(raw)]))
            if not len(h):
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.n.append(len(h))
            self.counts.append(weighted(h, sizes))
            sign.append(simhashes(h, np.array([0]), len(h))[0])
            if len(h) < K:
                self.short.setdefault(len(h), {}).setdefault(next(iter(self.counts[k]))[0], []).append(k)
                continue
            for s in {s for s, _ in self.counts[k]}:
                by_shingle.setdefault(s, set()).add(len(h))
        self.n = np.array(self.n, np.int64)
        self.sign = np.array(sign, np.uint64)
        self.anchors = np.array(sorted(by_shingle), np.uint64)
        self.sizes_of = [sorted(by_shingle[s]) for s in self.anchors.tolist()]
        self.bits = max(16, (16 * len(self.anchors)).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.anchors >> np.uint64(64 - self.bits)] = True
        self.weight = [sum(c * s[1] for s, c in x.items()) for x in self.counts]
        self.of_size = {n: np.flatnonzero(self.n == n) for n in np.unique(self.n).tolist()}

    def near(self, prints: np.ndarray, n: int) -> list[tuple[int, int, int]]:
        """(window, item, distance) of items of n words within RADIUS of ``prints``."""
        items = self.of_size.get(n, np.zeros(0, np.int64))
        found = []
        for part in range(0, len(items), 256):
            some = items[part : part + 256]
            away = np.bitwise_count(prints[:, None] ^ self.sign[some])
            w, c = np.nonzero(away <= RADIUS)
            found += zip(w.tolist(), some[c].tolist(), away[w, c].tolist(), strict=True)
        return sorted(found)

    def matches(self, h: np.ndarray, sizes: np.ndarray, hits: np.ndarray, s: np.ndarray, percent: int) -> dict[int, tuple]:
        """item -> (similarity, start, distance, words), the best window of one document.

        ``hits`` are the places among its shingles ``s`` that may be anchors.
        """
        best: dict[int, tuple] = {}
        spans: dict[int, list[np.ndarray]] = {}
        longer: set[int] = set()
        at = np.searchsorted(self.anchors, s[hits])
        for p, a in zip(hits.tolist(), at.tolist(), strict=True):
            if a < len(self.anchors) and self.anchors[a] == s[p]:
                for n in self.sizes_of[a]:
                    if n <= len(h):
                        spans.setdefault(n, []).append((max(0, p - n + K), min(p, len(h) - n)))
                    else:
                        longer.add(n)
        if longer:
            whole = weighted(h, sizes)
            total = sum(c * s[1] for s, c in whole.items())
            sign = simhashes(h, np.array([0]), len(h))[0]
            for i in (i for n in longer for i in self.of_size[n].tolist() if 100 * total >= percent * self.weight[i]):
                x = similarity(whole, self.counts[i])
                if 100 * x >= percent:
                    best[i] = (x, 0, int(np.bitwise_count(sign ^ self.sign[i])), len(h))
        for n, ranges in spans.items():
            inside = np.zeros(len(h) + 2, np.int32)
            for lo, hi in ranges:
                inside[lo] += 1
                inside[hi + 1] -= 1
            starts = np.flatnonzero(np.cumsum(inside) > 0)
            # in runs without gaps, so that fingerprints take memory for the words they are made of alone
            near = np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1)
            for part in (p for run in near for p in np.array_split(run, len(run) // 4096 + 1)):
                counted: dict[int, Counter] = {}
                for w, i, d in self.near(simhashes(h, part, n), n):
                    at_word = int(part[w])
                    if w not in counted:
                        counted[w] = weighted(h[at_word : at_word + n], sizes[at_word : at_word + n])
                    x = similarity(counted[w], self.counts[i])
                    if 100 * x >= percent and (i not in best or (x, -at_word) > (best[i][0], -best[i][1])):
                        best[i] = (x, at_word, d, n)
        for n, items in self.short.items():
            found = sequences(h, n)
            for p in np.flatnonzero(np.isin(found, np.array(sorted(items), np.uint64))):
                for i in items[int(found[p])]:
                    best.setdefault(i, (1.0, int(p), 0, n))
        return best

    def scan(self, column: pa.Array, percent: int):
        """(row, matches) of the rows of a string column that have any."""
        raw, offsets = utf8(column)
        for lo, hi in chunks(offsets):
            h, sizes, at = self.hasher.sized_words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            s, s_at = shingles(h, at, K)
            maybe = np.flatnonzero(self.seen[s >> np.uint64(64 - self.bits)]) if len(self.anchors) else np.zeros(0, np.int64)
            rows = np.searchsorted(s_at, maybe, side="right") - 1
            cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
            for r in range(hi - lo) if self.short else np.unique(rows):
                hits = maybe[cuts[r] : cuts[r + 1]] - s_at[r]
                words = slice(at[r], at[r + 1])
                if found := self.matches(h[words], sizes[words], hits, s[s_at[r] : s_at[r + 1]], percent):
                    yield lo + int(r), found


def item_blocks(items: DataFrame, id_column: str, text_column: str):
    """The items as driver lists, each of at most about BLOCK_BYTES of text."""
    rows = items.select(F.col(id_column).cast("long").alias("i"), F.lower(F.coalesce(F.col(text_column), F.lit(""))).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    n = int(total // BLOCK_BYTES) + 1
    for b in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()]


def find(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    percent: int = 80,
) -> DataFrame:
    """One row for each document and item that it holds: the best window."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.lower(F.coalesce(F.col(text_column), F.lit(""))).alias("text"))
    out = None
    for block in item_blocks(items, item_id, item_text):

        def run(batches, block=block):
            index = ItemIndex(block)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [
                    (ids[r], index.ids[i], start, n, x, d)
                    for r, best in index.scan(batch.column(1), percent)
                    for i, (x, start, d, n) in sorted(best.items())
                ]
                columns = zip(*found, strict=True) if found else [[]] * 6
                kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in MATCHES.split(", ")]
                )

        part = rows.mapInArrow(run, MATCHES)
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, *, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that hold no item, with its columns."""
    for block in item_blocks(items, item_id, item_text):

        def run(batches, block=block):
            index = ItemIndex(block)
            for batch in batches:
                texts = batch.column(batch.num_columns - 1)
                good = np.ones(batch.num_rows, bool)
                good[[r for r, _ in index.scan(texts, percent)]] = False
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(good))

        whole = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.lower(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))).alias("__text"))
        docs = whole.mapInArrow(run, docs.schema)
    return docs
