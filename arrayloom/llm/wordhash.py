"""Word and shingle hashes of whole text columns, by numpy over Arrow buffers.

A text's words are the runs of bytes between the six ASCII white-space
characters. A word's hash is a polynomial over its bytes modulo 2 ** 64, taken
as a difference of running sums, and then mixed; so all words of a column
cost a few vector operations and no Python object.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from arrayloom.llm.common import SPACES

#: Bytes worked on at a time, for the processor's cache and the worker's memory.
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SEED = 20_240_229


class ByteRules:
    """What becomes of each byte: its value (0: passed over), and white space."""

    def __init__(self, lower: bool = True, drop: str = ""):
        values = np.random.Generator(np.random.PCG64(SEED)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        if lower:
            values[65:91] = values[97:123]
        self.space = np.zeros(256, dtype=bool)
        for c in SPACES:
            self.space[ord(c)] = True
        self.dropped = np.zeros(256, dtype=bool)
        for c in drop:
            self.dropped[ord(c)] = True
        self.any_dropped = bool(drop)
        self.values = values


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column without nulls."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = BLOCK):
    """(first, last + 1) row ranges of about ``size`` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class WordHasher:
    def __init__(self, rules: ByteRules | None = None):
        self.rules = rules or ByteRules()
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, BLOCK + 4096)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                t = np.full(n, base, np.uint64)
                t[0] = 1
                setattr(self, name, np.cumprod(t, dtype=np.uint64))

    def _block(self, raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, hashes and sizes of the words of ``raw``; a word ends at ``breaks`` too."""
        r = self.rules
        inside = ~r.space[raw]
        if r.any_dropped:
            counted = inside & ~r.dropped[raw]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        cut = breaks[(breaks > 0) & (breaks < len(raw))]
        starts[cut] = inside[cut]
        first = np.flatnonzero(starts)
        if not len(first):
            return first, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._powers(len(raw) + 1)
        weight = r.values[raw]
        weight[~inside] = 0
        at = None
        if r.any_dropped:
            weight[~counted] = 0
            # positions without the bytes passed over, so that they leave no trace
            at = np.cumsum(counted) - counted
            weight *= self.up[at]
        else:
            weight *= self.up[: len(raw)]
        total = np.cumsum(weight, dtype=np.uint64)
        before = np.where(first > 0, total[first - 1], np.uint64(0))
        after = np.append(before[1:], total[-1])
        h = (after - before) * (self.down[at[first]] if at is not None else self.down[first])
        sizes = np.add.reduceat((counted if r.any_dropped else inside).astype(np.int64), first)
        if r.any_dropped:
            some = sizes > 0
            first, h, sizes = first[some], h[some], sizes[some]
        return first, mix(h), sizes

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, and the n + 1 word offsets of the rows."""
        h, _, at = self.sized_words(raw, offsets)
        return h, at

    def sized_words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``words``, with the number of counted bytes of each word."""
        if len(raw) <= 2 * BLOCK:
            first, h, sizes = self._block(raw, offsets)
        else:  # a very long row: block by block, cut at white space
            parts, lo = [], 0
            while lo < len(raw):
                hi = min(len(raw), lo + BLOCK)
                if hi < len(raw):
                    seen = np.flatnonzero(self.rules.space[raw[lo:hi]])
                    while not len(seen) and hi < len(raw):
                        hi = min(len(raw), hi + BLOCK)
                        seen = np.flatnonzero(self.rules.space[raw[lo:hi]])
                    if hi < len(raw) and len(seen):
                        hi = lo + int(seen[-1]) + 1
                f, x, z = self._block(raw[lo:hi], offsets - lo)
                parts.append((f + lo, x, z))
                lo = hi
            first = np.concatenate([p[0] for p in parts])
            h = np.concatenate([p[1] for p in parts])
            sizes = np.concatenate([p[2] for p in parts])
        return h, sizes, np.searchsorted(first, offsets).astype(np.int64)


_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows as texts that consist of these words alone."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out += h[j : j + m] * _FACTORS[j]
    return mix(out)


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows in row order, and the rows' n + 1 offsets.

    A row with fewer words, but at least one, has its whole sequence as one.
    """
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(count)])
    if not out_at[-1]:
        return np.zeros(0, np.uint64), out_at
    m = max(0, len(h) - k + 1)
    combined = np.zeros(m, np.uint64)
    for j in range(k):
        combined += h[j : j + m] * _FACTORS[j]
    combined = mix(combined)
    # where each output comes from: its row's first word plus its place in the row
    row = np.repeat(np.arange(len(n)), count)
    source = at[row] + np.arange(out_at[-1]) - out_at[row]
    if m:
        out = combined[np.minimum(source, m - 1)]
    else:
        out = np.zeros(out_at[-1], np.uint64)
    for i in np.flatnonzero((n > 0) & (n < k)):
        out[out_at[i]] = sequences(h[at[i] : at[i + 1]], int(n[i]))[0]
    return out, out_at


def distinct(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each row."""
    return [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
