"""Named mathematical constants as literal columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_PHI = (1 + math.sqrt(5)) / 2
#: Not reached by the functions of ``math``.
_EULER = 0.5772156649015328606
_CATALAN = 0.9159655941772190151
_GLAISHER = 1.2824271291006226369
_KHINCHIN = 2.6854520010653064453
_ZETA_3 = 1.2020569031595942854
_EXTREME_VALUE_SKEWNESS = 1.1395470994046486575
_RAYLEIGH_SKEWNESS = 0.6311106578189371382
_RAYLEIGH_KURTOSIS = 3.2450893006876380628

VALUES: dict[str, float] = {
    "pi": math.pi,
    "root_pi": math.sqrt(math.pi),
    "root_half_pi": math.sqrt(math.pi / 2),
    "root_two_pi": math.sqrt(2 * math.pi),
    "root_ln_four": math.sqrt(math.log(4)),
    "e": math.e,
    "half": 0.5,
    "euler": _EULER,
    "root_two": math.sqrt(2),
    "ln_two": math.log(2),
    "ln_ln_two": math.log(math.log(2)),
    "third": 1 / 3,
    "twothirds": 2 / 3,
    "two_thirds": 2 / 3,
    "pi_minus_three": math.pi - 3,
    "four_minus_pi": 4 - math.pi,
    "two_pi": 2 * math.pi,
    "half_root_two": math.sqrt(2) / 2,
    "exp_minus_half": math.exp(-0.5),
    "one_div_two_pi": 1 / (2 * math.pi),
    "catalan": _CATALAN,
    "cbrt_pi": math.cbrt(math.pi),
    "cosh_one": math.cosh(1),
    "cos_one": math.cos(1),
    "degree": math.pi / 180,
    "e_pow_pi": math.e**math.pi,
    "euler_sqr": _EULER**2,
    "extreme_value_skewness": _EXTREME_VALUE_SKEWNESS,
    "four_thirds_pi": 4 * math.pi / 3,
    "glaisher": _GLAISHER,
    "half_pi": math.pi / 2,
    "khinchin": _KHINCHIN,
    "ln_phi": math.log(_PHI),
    "ln_ten": math.log(10),
    "log10_e": math.log10(math.e),
    "one_div_cbrt_pi": 1 / math.cbrt(math.pi),
    "one_div_euler": 1 / _EULER,
    "one_div_ln_phi": 1 / math.log(_PHI),
    "one_div_log10_e": math.log(10),
    "one_div_root_pi": 1 / math.sqrt(math.pi),
    "one_div_root_two": 1 / math.sqrt(2),
    "one_div_root_two_pi": 1 / math.sqrt(2 * math.pi),
    "phi": _PHI,
    "pi_cubed": math.pi**3,
    "pi_pow_e": math.pi**math.e,
    "pi_sqr": math.pi**2,
    "pi_sqr_div_six": math.pi**2 / 6,
    "radian": 180 / math.pi,
    "rayleigh_kurtosis": _RAYLEIGH_KURTOSIS,
    "rayleigh_kurtosis_excess": _RAYLEIGH_KURTOSIS - 3,
    "rayleigh_skewness": _RAYLEIGH_SKEWNESS,
    "root_e": math.sqrt(math.e),
    "root_one_div_pi": math.sqrt(1 / math.pi),
    "root_three": math.sqrt(3),
    "root_two_div_pi": math.sqrt(2 / math.pi),
    "sinh_one": math.sinh(1),
    "sin_one": math.sin(1),
    "sixth_pi": math.pi / 6,
    "third_pi": math.pi / 3,
    "three_quarters": 0.75,
    "three_quarters_pi": 0.75 * math.pi,
    "two_div_pi": 2 / math.pi,
    "two_thirds_pi": 2 * math.pi / 3,
    "zeta_three": _ZETA_3,
    "zeta_two": math.pi**2 / 6,
}


def constant(name: str) -> Column:
    return F.lit(VALUES[name])


def define_constant(name: str, value: float) -> Column:
    """A user's own constant, from now on known by its name."""
    VALUES[name] = value
    return F.lit(value)
