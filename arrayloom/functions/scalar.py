"""Scalar functions with the arithmetic of C on columns.

Everything is a Catalyst expression. Where Spark raises (ANSI mode) or gives
NULL and C gives a value, the guards are here and nowhere else: zero divisors,
logarithms, NaN comparisons, truncating integer division. Integer functions
take ``bits``, the width of the C type, as Spark has no unsigned types.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _fn(name: str, *args) -> Column:
    return F.call_function(name, *[_c(a) for a in args])


# operators


def truth(x: Column) -> Column:
    """A comparison as the number 0 or 1."""
    return x.cast("long")


def logical_not(x) -> Column:
    return _c(x) == 0


def idiv(a, b) -> Column:
    """Integer division, towards zero, as a bigint."""
    return _fn("div", a, b)


def fdiv(x, y) -> Column:
    """Division of doubles with IEEE results for a zero divisor."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(NAN)).otherwise(F.signum(x) * F.when(signbit(y), F.lit(-INF)).otherwise(F.lit(INF)))
    return F.when(y == 0, by_zero).otherwise(_fn("try_divide", x, y))


def mod(a, b) -> Column:
    return _c(a) % _c(b)


def shl(a, n) -> Column:
    return _fn("shiftleft", a, n)


def shr(a, n) -> Column:
    return _fn("shiftright", a, n)


def shr_unsigned(a, n) -> Column:
    return _fn("shiftrightunsigned", a, n)


def if_else(c, a, b) -> Column:
    return F.when(c, _c(a)).otherwise(_c(b))


# NaN-aware comparisons: false where an operand is NaN


def isnan(x) -> Column:
    """Null for null, as in SQL, where Spark says false."""
    return F.when(_c(x).isNotNull(), F.isnan(x))


def _ordered(x, y) -> Column:
    return ~F.isnan(x) & ~F.isnan(y)


def isequal(x, y) -> Column:
    return (_c(x) == _c(y)) & ~F.isnan(x)


def isnotequal(x, y) -> Column:
    return ~isequal(x, y)


def isgreater(x, y) -> Column:
    return (_c(x) > _c(y)) & _ordered(x, y)


def isgreaterequal(x, y) -> Column:
    return (_c(x) >= _c(y)) & _ordered(x, y)


def isless(x, y) -> Column:
    return (_c(x) < _c(y)) & _ordered(x, y)


def islessequal(x, y) -> Column:
    return (_c(x) <= _c(y)) & _ordered(x, y)


def islessgreater(x, y) -> Column:
    return (_c(x) != _c(y)) & _ordered(x, y)


def isordered(x, y) -> Column:
    return _ordered(x, y)


def isunordered(x, y) -> Column:
    return isnan(x) | isnan(y)


def isfinite(x) -> Column:
    return ~F.isnan(x) & (F.abs(x) != INF)


def isinf(x) -> Column:
    return F.abs(x) == INF


def isnormal(x) -> Column:
    return isfinite(x) & (F.abs(x) >= 2.2250738585072014e-308)


def signbit(x) -> Column:
    return F.startswith(_c(x).cast("double").cast("string"), F.lit("-"))


# logarithms: -inf at zero, NaN below


def _log(f: Callable, zero: float = 0.0) -> Callable:
    return lambda x: F.when(_c(x) > zero, f(x)).when(_c(x) == zero, F.lit(-INF)).when(_c(x) < zero, F.lit(NAN))


log, log2, log10, log1p = _log(F.log), _log(F.log2), _log(F.log10), _log(F.log1p, -1.0)


# rounding and parts


def ceil(x) -> Column:
    return -floor(-_c(x))


def floor(x) -> Column:
    """Floor of a double as a double, also where it is beyond a bigint."""
    x = _c(x).cast("double")
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def trunc(x) -> Column:
    return F.when(_c(x) < 0, ceil(x)).otherwise(floor(x))


def rint(x) -> Column:
    return F.rint(x)


def round_(x) -> Column:
    """Half away from zero."""
    return F.signum(x) * floor(F.abs(x) + 0.5)


def round_to(x, digits: int) -> Column:
    """So many decimals by arithmetic on doubles, as C programs round.

    The product with the power of ten is rounded too, so numbers beyond the
    precision may change by their last bit, which ``F.round`` (decimal) leaves.
    """
    power = 10.0**digits
    scaled = _c(x).cast("double") * power
    return F.when(F.abs(scaled) < INF, F.round(scaled, 0) / power).otherwise(x)


def fract(x) -> Column:
    """struct(fraction, whole)."""
    return F.struct((_c(x) - floor(x)).alias("fraction"), floor(x).alias("whole"))


def modf(x) -> Column:
    return F.struct((_c(x) - trunc(x)).alias("fraction"), trunc(x).alias("whole"))


def ilogb(x) -> Column:
    a = F.abs(_c(x).cast("double"))
    guess = F.floor(F.log2(a))
    # the logarithm may be one off next to a power of two
    return F.when(F.pow(F.lit(2.0), guess) > a, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= a, guess + 1).otherwise(guess)


def logb(x) -> Column:
    return ilogb(x).cast("double")


def frexp(x) -> Column:
    """struct(mantissa in [0.5, 1), exponent); zeros, NaN and infinities have exponent 0."""
    x = _c(x).cast("double")
    tiny = F.abs(x) < 2.2250738585072014e-308  # scaled up, as the power of two below would overflow
    y = F.when(tiny, x * 2.0**54).otherwise(x)
    odd = (x == 0) | ~isfinite(x)
    e = F.when(odd, F.lit(0).cast("long")).otherwise(ilogb(y) + 1)
    mantissa = F.when(odd, x).otherwise(y * F.pow(F.lit(2.0), -e))
    return F.struct(mantissa.alias("mantissa"), F.when(tiny & ~odd, e - 54).otherwise(e).alias("exponent"))


def ldexp(x, n) -> Column:
    return _c(x) * F.pow(F.lit(2.0), _c(n))


def remainder(x, y) -> Column:
    return _c(x) - _c(y) * F.rint(fdiv(x, y))


def remquo(x, y) -> Column:
    return F.struct(remainder(x, y).alias("remainder"), F.rint(fdiv(x, y)).cast("long").alias("quotient"))


def sincos(x) -> Column:
    return F.struct(F.sin(x).alias("sin"), F.cos(x).alias("cos"))


# least, greatest, blending


def _both(x, y, value: Column) -> Column:
    return F.when(_c(x).isNotNull() & _c(y).isNotNull(), value)


def fmax(x, y) -> Column:
    """The larger; a NaN gives way to the other, but a null is the result."""
    return _both(x, y, F.greatest(F.nanvl(x, y), F.nanvl(y, x)))


def fmin(x, y) -> Column:
    return _both(x, y, F.least(F.nanvl(x, y), F.nanvl(y, x)))


def maxmag(x, y) -> Column:
    return F.when(F.abs(x) > F.abs(y), x).when(F.abs(y) > F.abs(x), y).otherwise(fmax(x, y))


def minmag(x, y) -> Column:
    return F.when(F.abs(x) < F.abs(y), x).when(F.abs(y) < F.abs(x), y).otherwise(fmin(x, y))


def fdim(x, y) -> Column:
    return F.when(_c(x) > _c(y), _c(x) - _c(y)).otherwise(F.lit(0.0))


def clamp(x, lo, hi) -> Column:
    return F.least(F.greatest(_c(x), _c(lo)), _c(hi))


def mix(x, y, a) -> Column:
    return _c(x) + (_c(y) - _c(x)) * _c(a)


def step(edge, x) -> Column:
    return F.when(_c(x) < _c(edge), F.lit(0.0)).otherwise(F.lit(1.0))


def smoothstep(a, b, x) -> Column:
    t = clamp(fdiv(_c(x) - _c(a), _c(b) - _c(a)), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def copysign(x, y) -> Column:
    return F.when(signbit(y), -F.abs(x)).otherwise(F.abs(x))


def select(a, b, c) -> Column:
    return F.when(_c(c) != 0, b).otherwise(a)


def fma(x, y, z) -> Column:
    """x * y + z with two roundings."""
    return _c(x) * _c(y) + _c(z)


def nan(_payload=None) -> Column:
    return F.lit(NAN)


# powers


def rsqrt(x) -> Column:
    return fdiv(1.0, F.sqrt(x))


def rootn(x, n: int) -> Column:
    r = F.pow(F.abs(x), F.lit(1.0 / n))
    return F.signum(x) * r if n % 2 else F.when(_c(x) < 0, F.lit(NAN)).otherwise(r)


def _over_pi(f: Callable) -> Callable:
    return lambda *x: f(*x) / math.pi


def sinpi(x) -> Column:
    """sin(pi x), with the argument reduced first: exact at whole and half numbers."""
    x = _c(x).cast("double")
    r = x - 2 * floor((x + 1) / 2)  # in [-1, 1)
    r = F.when(F.abs(r) > 0.5, F.signum(r) * (1 - F.abs(r))).otherwise(r)
    return F.sin(r * math.pi)


def cospi(x) -> Column:
    x = _c(x).cast("double")
    r = x - 2 * floor(x / 2)  # in [0, 2)
    return -F.sin((0.5 - F.abs(r - 1)) * math.pi)


def tanpi(x) -> Column:
    return fdiv(sinpi(x), cospi(x))


# integers of a given width


def _limits(bits: int, signed: bool) -> tuple[int, int]:
    return (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)


def _wide(x, bits: int) -> Column:
    return _c(x).cast("decimal(38,0)" if bits > 32 else "long")


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def _saturated(x: Column, bits: int, signed: bool) -> Column:
    lo, hi = _limits(bits, signed)
    if bits <= 32:
        return F.least(F.greatest(x, F.lit(lo).cast("long")), F.lit(hi).cast("long"))
    x = F.least(F.greatest(x, _whole(lo)), _whole(hi))
    return x.cast("long" if signed else "decimal(20,0)")


def add_sat(a, b, bits: int = 32, signed: bool = True) -> Column:
    """a + b inside the type; unsigned 64-bit numbers are decimals."""
    return _saturated(_wide(a, bits) + _wide(b, bits), bits, signed)


def sub_sat(a, b, bits: int = 32, signed: bool = True) -> Column:
    return _saturated(_wide(a, bits) - _wide(b, bits), bits, signed)


def mad_sat(a, b, c, bits: int = 32, signed: bool = True) -> Column:
    a, b, c = (_c(x).cast("decimal(20,0)") for x in (a, b, c))
    lo, hi = _limits(bits, signed)
    # a product beyond 38 digits is beyond any type
    far = F.when((a < 0) == (b < 0), _whole(hi)).otherwise(_whole(lo))
    sum_ = _fn("try_add", _fn("try_multiply", a, b), c).cast("decimal(38,0)")
    given = a.isNotNull() & b.isNotNull() & c.isNotNull()
    out = F.least(F.greatest(F.coalesce(sum_, far), _whole(lo)), _whole(hi)).cast("long" if signed or bits <= 32 else "decimal(20,0)")
    return F.when(given, out)


def abs_diff(a, b, bits: int = 32) -> Column:
    """|a - b|, of 64-bit numbers as a decimal."""
    if bits <= 32:
        return F.abs(_c(a).cast("long") - _c(b).cast("long"))
    return F.abs(_c(a).cast("decimal(20,0)") - _c(b).cast("decimal(20,0)")).cast("decimal(20,0)")


def hadd(a, b) -> Column:
    """floor((a + b) / 2) without a carry."""
    return shr(a, 1) + shr(b, 1) + _c(a).bitwiseAND(_c(b)).bitwiseAND(1)


def rhadd(a, b) -> Column:
    return shr(a, 1) + shr(b, 1) + _c(a).bitwiseOR(_c(b)).bitwiseAND(1)


def _mask(bits: int) -> Column:
    return F.lit((1 << bits) - 1)


def mul24(a, b) -> Column:
    return _c(a).cast("long").bitwiseAND(_mask(24)) * _c(b).cast("long").bitwiseAND(_mask(24))


def mad24(a, b, c) -> Column:
    return mul24(a, b) + _c(c).cast("long")


def _halves(x: Column, half: Column) -> tuple[Column, Column]:
    """floor(x / half) and the rest, of whole decimals."""
    low = F.pmod(x, half).cast("decimal(38,0)")
    return _fn("div", x - low, half).cast("decimal(20,0)"), low.cast("decimal(20,0)")


def mul_hi(a, b, bits: int = 32, signed: bool = False) -> Column:
    """The upper half of the product of two numbers of so many bits (32 or 64).

    Unsigned 32-bit numbers are held as bigints, and are multiplied by halves of
    16 bits, so that nothing exceeds 2 ** 49; unsigned 64-bit ones are decimals.
    """
    if bits == 32:
        a, b = _c(a).cast("long"), _c(b).cast("long")
        if signed:
            return shr(a * b, 32)
        a, b = a.bitwiseAND(_mask(32)), b.bitwiseAND(_mask(32))
        a0, a1 = a.bitwiseAND(_mask(16)), shr_unsigned(a, 16)
        low = a0 * b
        return shr_unsigned(a1 * b + shr_unsigned(low, 16), 16)
    half = _whole(1 << 32)
    (a1, a0), (b1, b0) = (_halves(_c(x).cast("decimal(20,0)"), half) for x in (a, b))
    carry, _ = _halves((a0 * b0).cast("decimal(38,0)"), half)
    middle, _ = _halves((a1 * b0 + a0 * b1 + carry).cast("decimal(38,0)"), half)
    return ((a1 * b1).cast("decimal(38,0)") + middle).cast("long" if signed else "decimal(20,0)")


def mad_hi(a, b, c, bits: int = 32, signed: bool = False) -> Column:
    c = _c(c).cast("long" if bits == 32 or signed else "decimal(20,0)")
    return mul_hi(a, b, bits, signed) + c


def clz(x, bits: int = 32) -> Column:
    """Leading zeros of a number in so many bits, negative ones by two's complement."""
    x = _c(x).cast("long")
    x = x if bits == 64 else x.bitwiseAND(_mask(bits))
    return F.when(x == 0, F.lit(bits)).otherwise(F.lit(bits) - F.length(F.bin(x)))


def popcount(x) -> Column:
    return F.bit_count(x)


def bitselect(a, b, c) -> Column:
    return _c(a).bitwiseAND(F.bitwise_not(c)).bitwiseOR(_c(b).bitwiseAND(c))


def rotate(x, n: int, bits: int = 32) -> Column:
    """Left rotation of an unsigned number of so many bits (at most 32)."""
    x = _c(x).cast("long")
    n %= bits
    return shl(x, n).bitwiseAND(_mask(bits)).bitwiseOR(shr_unsigned(x, bits - n)) if n else x


def upsample(hi, lo, bits: int = 32) -> Column:
    return shl(_c(hi).cast("long"), bits).bitwiseOR(_c(lo).cast("long").bitwiseAND(_mask(bits)))


#: name -> function of columns. The special functions that Spark lacks are in
#: ``special``, those of short vectors in ``short_vectors``.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "abs_diff": abs_diff, "acos": F.acos, "acosh": F.acosh, "acospi": _over_pi(F.acos), "add_sat": add_sat,
    "asin": F.asin, "asinh": F.asinh, "asinpi": _over_pi(F.asin), "atan": F.atan, "atan2": F.atan2, "atan2pi": _over_pi(F.atan2),
    "atanh": F.atanh, "atanpi": _over_pi(F.atan), "bitselect": bitselect, "cbrt": F.cbrt, "ceil": ceil, "clamp": clamp, "clz": clz,
    "copysign": copysign, "cos": F.cos, "cosh": F.cosh, "cospi": cospi, "degrees": F.degrees, "exp": F.exp,
    "exp10": lambda x: F.pow(F.lit(10.0), _c(x)), "exp2": lambda x: F.pow(F.lit(2.0), _c(x)), "expm1": F.expm1, "fabs": F.abs,
    "fdim": fdim, "floor": floor, "fma": fma, "fmax": fmax, "fmin": fmin, "fmod": mod, "fract": fract, "frexp": frexp, "hadd": hadd,
    "hypot": F.hypot, "ilogb": ilogb, "isequal": isequal, "isfinite": isfinite, "isgreater": isgreater,
    "isgreaterequal": isgreaterequal, "isinf": isinf, "isless": isless, "islessequal": islessequal, "islessgreater": islessgreater,
    "isnan": isnan, "isnormal": isnormal, "isnotequal": isnotequal, "isordered": isordered, "isunordered": isunordered,
    "ldexp": ldexp, "log": log, "log10": log10, "log1p": log1p, "log2": log2, "logb": logb, "mad": fma, "mad24": mad24,
    "mad_hi": mad_hi, "mad_sat": mad_sat, "max": fmax, "maxmag": maxmag, "min": fmin, "minmag": minmag, "mix": mix, "modf": modf,
    "mul24": mul24, "mul_hi": mul_hi, "nan": nan, "__popc": popcount, "__popcll": popcount, "popcount": popcount, "pow": F.pow,
    "pown": F.pow, "powr": F.pow, "radians": F.radians, "remainder": remainder, "remquo": remquo, "rhadd": rhadd, "rint": rint,
    "rootn": rootn, "rotate": rotate, "round": round_, "rsqrt": rsqrt, "select": select, "sign": F.signum, "signbit": signbit,
    "sin": F.sin, "sincos": sincos, "sinh": F.sinh, "sinpi": sinpi, "smoothstep": smoothstep, "sqrt": F.sqrt, "step": step,
    "sub_sat": sub_sat, "tan": F.tan, "tanh": F.tanh, "tanpi": tanpi, "trunc": trunc, "upsample": upsample,
}
