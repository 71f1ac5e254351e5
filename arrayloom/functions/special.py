"""Functions that Spark lacks, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType


#: The series' and the continued fraction's terms; below the bound between them the series has converged.
TERMS, FRACTION_FROM = 120, 2.0
#: The coefficients of Lanczos' approximation for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def erf(x: np.ndarray) -> np.ndarray:
    """The series of positive terms near zero, one minus the complement beyond."""
    a = np.abs(x)
    near = np.minimum(a, FRACTION_FROM)
    term = near * 2 / math.sqrt(math.pi) * np.exp(-near * near)
    total = term.copy()
    for k in range(1, TERMS):
        term = term * (2 * near * near / (2 * k + 1))
        total += term
    return np.copysign(np.where(a <= FRACTION_FROM, np.minimum(total, 1.0), 1 - _upper(a)), x)


def _upper(a: np.ndarray) -> np.ndarray:
    """erfc of numbers from FRACTION_FROM on, by its continued fraction from the inside out."""
    a = np.maximum(a, FRACTION_FROM)
    f = a.copy()
    for k in range(TERMS, 0, -1):
        f = a + k / 2 / f
    return np.exp(-a * a) / (f * math.sqrt(math.pi))


def erfc(x: np.ndarray) -> np.ndarray:
    return np.where(x > FRACTION_FROM, _upper(x), 1 - erf(np.minimum(x, FRACTION_FROM)))


def _log_gamma_up(x: np.ndarray) -> np.ndarray:
    """log(gamma(x)) for x of at least 0.5."""
    y = x - 1
    total = np.full_like(y, LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (y + k)
    t = y + 7.5
    return np.where(np.isinf(x), np.inf, 0.5 * math.log(2 * math.pi) + (y + 0.5) * np.log(t) - t + np.log(total))


def _sin_pi(x: np.ndarray) -> np.ndarray:
    """sin(pi x), with the whole part taken away first."""
    r = np.mod(x, 2.0)
    r = np.where(r > 1, r - 2, r)
    r = np.where(np.abs(r) > 0.5, np.sign(r) * (1 - np.abs(r)), r)
    return np.sin(math.pi * r)


def _at_pole(x: np.ndarray) -> np.ndarray:
    return (x <= 0) & (x == np.floor(x))


def lgamma(x: np.ndarray) -> np.ndarray:
    up = _log_gamma_up(np.where(x < 0.5, 1 - x, x))
    low = math.log(math.pi) - np.log(np.abs(_sin_pi(x))) - up
    return np.where(_at_pole(x) | np.isinf(x), np.inf, np.where(x < 0.5, low, up))


def gamma_sign(x: np.ndarray) -> np.ndarray:
    return np.where((x < 0) & (np.mod(np.floor(x), 2) != 0), -1, 1)


def tgamma(x: np.ndarray) -> np.ndarray:
    """Exact factorials at whole numbers; NaN at the poles below zero, an infinity of zero's sign at zero."""
    found = gamma_sign(x) * np.exp(lgamma(x))
    whole = (x > 0) & (x == np.floor(x)) & (x <= 171)
    found = np.where(whole, _FACTORIALS[np.where(whole, x, 1).astype(np.int64)], found)
    found = np.where(_at_pole(x) | (x == -np.inf), np.nan, found)
    return np.where(x == 0, np.copysign(np.inf, x), found)


_FACTORIALS = np.array([1.0, *(float(math.factorial(k)) for k in range(171))])


def _column(f: Callable[[np.ndarray], np.ndarray]):
    @pandas_udf(DoubleType())
    def of(x: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(f(x.to_numpy(float)), index=x.index)

    return of


@pandas_udf(StructType().add("value", DoubleType()).add("sign", IntegerType()))
def _lgamma_r(x: pd.Series) -> pd.DataFrame:
    v = x.to_numpy(float)
    with np.errstate(all="ignore"):
        return pd.DataFrame({"value": lgamma(v), "sign": gamma_sign(v).astype(np.int32)})


@pandas_udf(DoubleType())
def _nextafter(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(x.to_numpy(float), y.to_numpy(float)), index=x.index)


def _power_of_two(x: float) -> float:
    try:
        return math.pow(2.0, x)
    except OverflowError:
        return math.inf


@arrow_udf(DoubleType())
def exp2(x: pa.Array) -> pa.Array:
    """2 ** x by the C library, whose last bit is right where the JVM's power may be one off."""
    return pa.array([None if v is None else _power_of_two(v) for v in x.to_pylist()], pa.float64())


def reinterpret(x: Column, source: str, target: str) -> Column:
    """The bits of a number read as another type, by numpy type names of one width."""
    kinds = {"f8": DoubleType(), "f4": FloatType(), "i8": LongType(), "i4": IntegerType(), "i2": ShortType(), "i1": ByteType()}

    @pandas_udf(kinds[target])
    def of(v: pd.Series) -> pd.Series:
        return pd.Series(v.to_numpy(source).view(target), index=v.index)

    return of(x)


FUNCTIONS = {
    "erf": _column(erf), "erfc": _column(erfc), "lgamma": _column(lgamma), "lgamma_r": _lgamma_r, "tgamma": _column(tgamma),
    "nextafter": _nextafter,
}
