"""Sum-of-squares online packing of token sequences into fixed windows.

Every document becomes its token ids and a closing id. Whole windows are cut
off first; what remains is placed online into the fill level that keeps the
sum of squared counts of partially filled windows smallest (the rule of
Csirik, Johnson, Kenyon et al.). Levels are one integer array, so a placement
is a few vector operations, whatever the number of windows.

At most ``MAX_OPEN`` windows are open. Where the rule asks for one more, and the
rest of a document fits into none, the document is cut: its next ids close
an open window, of those whose closing leaves the smallest sum the fullest, and
what remains is placed by the rule again. So placement itself closes windows.

Each task packs its own input rows and nothing is shuffled. When a task ends,
the emptiest of the few windows still open fill up the fullest, and what is left
is cut into power-of-two windows, which need no padding.

Defined cases: a null or empty text is the closing id alone; a null doc_id
stays null; repeated rows are packed once for each row; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, "
    "doc_tokens bigint, sequence_id bigint, offset bigint"
)
#: Open windows of a task. More of them cut fewer documents, but leave more windows to the task's last step.
MAX_OPEN = 8

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts go to the slower library, whose time doesn't hang on their form.
FAST_CHARS = 1 << 20


def _byte_ranks(file: str) -> dict[bytes, int] | None:
    """bytes -> id if the file is a plain byte-level BPE whose ids are in merge order."""
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None
    # printable characters stand for themselves, the other bytes for 256, 257, ...
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    if any(vocab.get(m.replace(" ", "")) != 256 + i for i, m in enumerate(merges)):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()}


class TextEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The ids are those of the ``tokenizers`` library for the vocabulary file. A
    plain byte-level BPE is evaluated by ``tiktoken`` over the same ranks,
    which gives the same ids several times faster; texts with the string of a
    special token, and other kinds of vocabulary, go to ``tokenizers``.
    """

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = _byte_ranks(path)
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or len(text) > FAST_CHARS or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.asarray(array("I", ids), dtype="<u4").tobytes()


class SumOfSquaresPacker:
    """Packs byte strings of ids into windows; yields rows of SCHEMA."""

    def __init__(self, capacity: int, first_id: int, max_open: int = MAX_OPEN):
        self.c, self.next_id, self.max_open = capacity, first_id, max_open
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}  # fill level -> windows, each a list of pieces
        self.n_open = 0
        self.rows: list[tuple] = []

    def _close(self, window: list) -> None:
        at = 0
        for doc, start, ids, total in window:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def level_for(self, n: int) -> int:
        """The fill level (0: a new window) that n ids go to."""
        c, levels = self.c, self.levels
        cost = 2 * (levels[n:] - levels[: c + 1 - n] + 1)
        cost[0] -= 1
        cost[-1] -= 1
        usable = levels[: c + 1 - n] > 0
        usable[0] = True
        cost[~usable] = np.iinfo(np.int64).max
        return c - n - int(np.argmin(cost[::-1]))  # of equals the fullest

    def _take(self, level: int) -> list:
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _level_under_bound(self, n: int) -> int | None:
        """As level_for, but without a new window; none if n ids fit nowhere."""
        usable = [h for h, w in self.open.items() if w and h + n <= self.c]
        if not usable:
            return None

        def after(h: int) -> int:
            return (0 if h + n == self.c else 2 * int(self.levels[h + n]) + 1) - 2 * int(self.levels[h]) + 1

        return min(usable, key=lambda h: (after(h), -h))

    def add(self, doc, ids: bytes) -> None:
        c, total = self.c, len(ids) // 4
        start = total // c * c
        for at in range(0, start, c):
            self._close([(doc, at, ids[4 * at : 4 * (at + c)], total)])
        while start < total:
            n = total - start
            at = self.level_for(n)
            if not at and self.n_open >= self.max_open:
                at = self._level_under_bound(n)
            if at is None:  # cut: the next ids close a window
                at = max((h for h, w in self.open.items() if w), key=lambda h: (self.levels[h], h))
                n = c - at
            window = self._take(at) if at else []
            window.append((doc, start, ids[4 * start : 4 * (start + n)], total))
            start += n
            if at + n == c:
                self._close(window)
                continue
            self.open.setdefault(at + n, []).append(window)
            self.levels[at + n] += 1
            self.n_open += 1

    def flush(self) -> None:
        """Close all windows: the ids of the emptiest fill up the fullest, and the last is cut into powers of two."""
        left = deque(w for h in sorted(self.open, reverse=True) for w in self.open[h])
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        loose: deque[tuple] = deque()  # the pieces of the window that is being taken apart

        def move(window: list, room: int) -> int:
            """Up to ``room`` ids from the loose pieces; what is still missing."""
            while room and loose:
                doc, start, ids, total = loose.popleft()
                take = min(len(ids) // 4, room)
                window.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    loose.appendleft((doc, start + take, ids[4 * take :], total))
                room -= take
            return room

        while left:
            window = left.popleft()
            room = self.c - sum(len(p[2]) // 4 for p in window)
            while (room := move(window, room)) and left:
                loose.extend(left.pop())
            if room:
                loose = deque(window)
            else:
                self._close(window)
        rest = sum(len(p[2]) // 4 for p in loose)
        for size in (1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1):
            window = []
            move(window, size)
            self._close(window)


def pack(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """Pack whole texts into windows of at most ``capacity`` ids.

    One row a piece: doc_id, start (ids of the document before it), length,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers),
    doc_tokens, sequence_id and offset in the window.
    """
    end = int(end_id).to_bytes(4, "little")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        encoder = TextEncoder(tokenizer_path)
        packer = SumOfSquaresPacker(capacity, TaskContext.get().partitionId() << 36)

        def out():
            rows, packer.rows = packer.rows, []
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, encoder.encode(text.as_py() or "") + end)
                if len(packer.rows) >= 10_000:
                    yield out()
        packer.flush()
        yield out()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
