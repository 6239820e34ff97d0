"""Column functions that Spark lacks."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Terms of the series for the normal distribution; exact to double precision for |z| <= 6.
TERMS = 120


def normal_cdf(z: Column) -> Column:
    """Phi(z) by the all-positive series of erf in Horner's form, which Spark compiles; |z| is clipped at 6."""
    x = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), z)) / F.lit(math.sqrt(2.0))
    factors = [1.0]
    for n in range(1, TERMS + 1):
        factors.append(factors[-1] * 2 / (2 * n + 1))
    series = F.lit(factors[-1])
    for c in factors[-2::-1]:
        series = series * (x * x) + c
    return 0.5 + F.exp(-x * x) * x * series / F.lit(math.sqrt(math.pi))


def ewma_of(values: Column, span: int) -> Column:
    """Last value of the exponentially weighted mean of an array: y0 = x0, y = a x + (1 - a) y; empty: 0."""
    a = 2.0 / (span + 1)
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.aggregate(rest, F.get(values, F.lit(0)).cast("double"), lambda y, x: x * a + y * (1 - a)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def quotient(a: Column, b: Column) -> Column:
    """a / b in floating-point arithmetic: a zero divisor gives an infinity, 0 / 0 NaN."""
    return F.when(b == 0, a.cast("double") * F.lit(math.inf)).otherwise(F.try_divide(a, b))


def rounded(x: Column, digits: int) -> Column:
    """Halves away from zero, in floating-point arithmetic as C and DuckDB do it: the scaled number is rounded. Spark's own
    ``round`` goes by the shortest decimal that denotes x, which may be a half where the scaled number isn't. What overflows stays."""
    scale = F.lit(10.0**digits)
    y = x * scale
    out = F.when(F.abs(y - F.rint(y)) == 0.5, y + F.signum(y) * 0.5).otherwise(F.rint(y)) / scale
    return F.when(F.abs(out) < math.inf, out).otherwise(x)


def log(x: Column) -> Column:
    """Natural logarithm, minus infinity at 0; null below."""
    return F.when(x == 0, F.lit(-math.inf)).otherwise(F.ln(x))


def running(keys: list[str], *order: str) -> WindowSpec:
    """All rows up to the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def ordered(keys: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def log_uniform(a: float, b: float, u: Column) -> Column:
    """Inverse of the log-uniform distribution on [a, b] at u in [0, 1)."""
    if not 0 < a < b:
        raise ValueError("0 < a < b is needed")
    return F.lit(a) * F.pow(F.lit(b / a), u)


def log_uniform_at(a: float, b: float, u: float) -> float:
    """``log_uniform`` of one number."""
    if not 0 < a < b:
        raise ValueError("0 < a < b is needed")
    return a * (b / a) ** u


def log_uniform_cdf(x: Column, a: float, b: float) -> Column:
    if not 0 < a < b:
        raise ValueError("0 < a < b is needed")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.ln(x / a) / F.lit(math.log(b / a))))
