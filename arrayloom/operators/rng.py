"""Counter-based random numbers as column expressions: Philox and Threefry.

A word is an unsigned 32-bit number held in a bigint; products are taken by
halves of 16 bits, so nothing overflows. Each round is a projection of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.functions.scalar import mul_hi, rotate, shl, shr_unsigned

#: Fixed values of the published generators.
PHILOX_2X32_MULTIPLIER = 0xD256D193
PHILOX_4X32_MULTIPLIERS = (0xD2511F53, 0xCD9E8D57)
PHILOX_32_WEYL = (0x9E3779B9, 0xBB67AE85)
PHILOX_2X64_MULTIPLIER = 0xD2B74407B1CE6E93
PHILOX_4X64_MULTIPLIERS = (0xD2E7470EE14C6C93, 0xCA5A826395121157)
PHILOX_64_WEYL = (0x9E3779B97F4A7C15, 0xBB67AE8584CAA73B)
THREEFRY_32_PARITY = 0x1BD11BDA
THREEFRY_2X32_ROTATIONS = (13, 15, 26, 6, 17, 29, 16, 24)
THREEFRY_64_PARITY = 0x1BD11BDAA9FC1A22
THREEFRY_2X64_ROTATIONS = (16, 42, 12, 31, 16, 32, 24, 21)
THREEFRY_4X64_ROTATIONS = ((14, 16), (52, 57), (23, 40), (5, 37), (25, 33), (46, 12), (58, 22), (32, 32))
THREEFRY_4X32_ROTATIONS = ((10, 26), (11, 21), (13, 27), (23, 5), (6, 20), (17, 11), (25, 10), (18, 20))
#: Key words of all streams.
KEY = 0x12345678

_M32 = (1 << 32) - 1


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_M32))


def _mul_lo(a: Column, m: int) -> Column:
    """The lower 32 bits of the product."""
    a0, a1 = a.bitwiseAND(F.lit(0xFFFF)), shr_unsigned(a, 16)
    return _low(a0 * m + shl((a1 * m).bitwiseAND(F.lit(0xFFFF)), 16))


def _step(df: DataFrame, words: list[str], new: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in words]
    return df.select(*rest, *[x.alias(w) for w, x in zip(words, new, strict=True)])


def _seeded(df: DataFrame, counters: list[Column], words: list[str]) -> DataFrame:
    return df.select("*", *[_low(c.cast("long")).alias(w) for c, w in zip(counters, words, strict=True)])


def philox(df: DataFrame, counters: list[Column], keys: list[int], rounds: int = 10) -> tuple[DataFrame, list[str]]:
    """``df`` with 2 or 4 random words of as many counters; the words' names."""
    n = len(counters)
    words = [f"__w{k}" for k in range(n)]
    d = _seeded(df, counters, words)
    k = list(keys)
    for _ in range(rounds):
        w = [F.col(x) for x in words]
        if n == 2:
            m = PHILOX_2X32_MULTIPLIER
            new = [mul_hi(w[0], m).bitwiseXOR(F.lit(k[0])).bitwiseXOR(w[1]), _mul_lo(w[0], m)]
        else:
            m0, m1 = PHILOX_4X32_MULTIPLIERS
            new = [
                mul_hi(w[2], m1).bitwiseXOR(w[1]).bitwiseXOR(F.lit(k[0])), _mul_lo(w[2], m1),
                mul_hi(w[0], m0).bitwiseXOR(w[3]).bitwiseXOR(F.lit(k[1])), _mul_lo(w[0], m0),
            ]
        d = _step(d, words, new)
        k = [(x + y) & _M32 for x, y in zip(k, PHILOX_32_WEYL)]
    return d, words


def threefry(df: DataFrame, counters: list[Column], keys: list[int], rounds: int = 20) -> tuple[DataFrame, list[str]]:
    """As ``philox``. With four words, rounds mix (0, 1) and (2, 3) alone, and
    the two rotations change places in every odd round."""
    n = len(counters)
    words = [f"__w{k}" for k in range(n)]
    parity = THREEFRY_32_PARITY
    for k in keys:
        parity ^= k
    ks = [*keys, parity]
    d = _seeded(df, counters, words)
    d = _step(d, words, [_low(F.col(w) + ks[i]) for i, w in enumerate(words)])
    for r in range(rounds):
        new = []
        for p in range(0, n, 2):
            a, b = F.col(words[p]), F.col(words[p + 1])
            turn = THREEFRY_2X32_ROTATIONS[r % 8] if n == 2 else THREEFRY_4X32_ROTATIONS[r % 8][(p // 2 + r) % 2]
            s = _low(a + b)
            new += [s, rotate(b, turn).bitwiseXOR(s)]
        d = _step(d, words, new)
        if r % 4 == 3:
            i = (r + 1) // 4
            more = [ks[(i + j) % (n + 1)] + (i if j == n - 1 else 0) for j in range(n)]
            d = _step(d, words, [_low(F.col(w) + m) for w, m in zip(words, more, strict=True)])
    return d, words


GENERATORS = {"philox": philox, "threefry": threefry}


def _words(df: DataFrame, generator: str, seed: int, n: int, counter: str) -> tuple[DataFrame, list[str]]:
    c, s = F.col(counter), F.lit(seed)
    return GENERATORS[generator](df, [c, s] * (n // 2), [KEY] * (n // 2 if generator == "philox" else n))


def _as(d: DataFrame, words: list[str], **made: Column) -> DataFrame:
    return d.select("*", *[c.alias(k) for k, c in made.items()]).drop(*words)


def uniform_int(df: DataFrame, seed: int = 0, generator: str = "philox", counter: str = "idx", out: str = "r") -> DataFrame:
    """Unsigned 32-bit integers over the full range."""
    d, w = _words(df, generator, seed, 2, counter)
    return _as(d, w, **{out: F.col(w[0])})


def uniform_float(df: DataFrame, seed: int = 0, generator: str = "philox", counter: str = "idx", out: str = "r") -> DataFrame:
    d, w = _words(df, generator, seed, 2, counter)
    return _as(d, w, **{out: (F.col(w[0]).cast("double") / 4294967296.0).cast("float")})


def _unit(lo: Column, hi: Column) -> Column:
    return (hi.cast("double") * 4294967296.0 + lo.cast("double")) / 18446744073709551616.0


def uniform(df: DataFrame, seed: int = 0, generator: str = "philox", counter: str = "idx", out: str = "r") -> DataFrame:
    """Doubles in [0, 1]."""
    d, w = _words(df, generator, seed, 2, counter)
    return _as(d, w, **{out: _unit(F.col(w[0]), F.col(w[1]))})


def normal(df: DataFrame, seed: int = 0, generator: str = "philox", counter: str = "idx", out: str = "r", both: bool = False) -> DataFrame:
    """Standard normal doubles by Box and Muller; ``both`` gives the sine branch too."""
    d, w = _words(df, generator, seed, 4, counter)
    u, v = _unit(F.col(w[0]), F.col(w[1])), _unit(F.col(w[2]), F.col(w[3]))
    r = F.sqrt(-2 * F.log(F.greatest(u, F.lit(5e-324))))
    made = {out: r * F.cos(2 * math.pi * v)}
    if both:
        made[f"{out}2"] = r * F.sin(2 * math.pi * v)
    return _as(d, w, **made)


_M64 = (1 << 64) - 1


def _mul_64(c: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper and the lower 64 bits of products, by halves of 32 bits."""
    low, up = np.uint64(0xFFFFFFFF), np.uint64(32)
    c0, c1 = np.uint64(c & 0xFFFFFFFF), np.uint64(c >> 32)
    x0, x1 = x & low, x >> up
    middle = c1 * x0 + (c0 * x0 >> up)
    other = c0 * x1 + (middle & low)
    return c1 * x1 + (middle >> up) + (other >> up), x * np.uint64(c)


def _philox_64(w: list[np.ndarray], k: list[int], rounds: int = 10) -> list[np.ndarray]:
    for _ in range(rounds):
        keys = [np.uint64(x) for x in k]
        if len(w) == 2:
            hi, lo = _mul_64(PHILOX_2X64_MULTIPLIER, w[0])
            w = [hi ^ keys[0] ^ w[1], lo]
        else:
            (p_hi, p_lo), (q_hi, q_lo) = _mul_64(PHILOX_4X64_MULTIPLIERS[0], w[0]), _mul_64(PHILOX_4X64_MULTIPLIERS[1], w[2])
            w = [q_hi ^ w[1] ^ keys[0], q_lo, p_hi ^ w[3] ^ keys[1], p_lo]
        k = [(x + y) & _M64 for x, y in zip(k, PHILOX_64_WEYL)]
    return w


def _threefry_64(w: list[np.ndarray], k: list[int], rounds: int = 20) -> list[np.ndarray]:
    n, parity = len(w), THREEFRY_64_PARITY
    for x in k:
        parity ^= x
    ks = [*k, parity]
    w = [x + np.uint64(y) for x, y in zip(w, ks)]
    for r in range(rounds):
        for p in range(0, n, 2):
            t = THREEFRY_2X64_ROTATIONS[r % 8] if n == 2 else THREEFRY_4X64_ROTATIONS[r % 8][(p // 2 + r) % 2]
            w[p] = w[p] + w[p + 1]
            w[p + 1] = (w[p + 1] << np.uint64(t) | w[p + 1] >> np.uint64(64 - t)) ^ w[p]
        if r % 4 == 3:
            i = (r + 1) // 4
            w = [x + np.uint64((ks[(i + j) % (n + 1)] + (i if j == n - 1 else 0)) & _M64) for j, x in enumerate(w)]
    return w


def words_64(df: DataFrame, seed: int = 0, n: int = 2, generator: str = "philox", counter: str = "idx", out: str = "words") -> DataFrame:
    """2 or 4 words of 64 bits (as signed bigints), by vectors of unsigned integers in Arrow batches."""
    f, keys = (_philox_64, n // 2) if generator == "philox" else (_threefry_64, n)

    def run(batches):
        for b in batches:
            c = b.column(counter).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            w = f([c, np.full(len(c), seed & _M64, np.uint64)] * (n // 2), [KEY] * keys)
            flat = np.stack(w, axis=1).reshape(-1).view(np.int64) if len(c) else np.zeros(0, np.int64)
            yield b.append_column(out, pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * n), pa.array(flat)))

    return df.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], f"`{out}` array<bigint>"]))
