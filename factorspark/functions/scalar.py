"""Elementwise column functions. NULL means missing; none of them returns NaN or an infinity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guards of the protected math and the tail of the harmonic series.
DIV_GUARD = 0.001
EXP_LIMIT = 100.0
POWER_LIMIT = 1e6
EULER_GAMMA = 0.57721566490153286060651209


def clean(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def absolute(x: Column) -> Column:
    return F.abs(x)


def sign(x: Column) -> Column:
    return F.signum(x)


def log(x: Column) -> Column:
    return F.ln(x)


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    return a - b


def mul(a: Column, b: Column) -> Column:
    return a * b


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def power(a: Column, b: Column) -> Column:
    return clean(F.pow(a, b))


def greater(a: Column, b: Column) -> Column:
    """The larger of two values; missing when either is."""
    return both(a, b, F.greatest(a, b))


def less(a: Column, b: Column) -> Column:
    return both(a, b, F.least(a, b))


def sqrt_floor(x: Column) -> Column:
    return F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))


# --- protected math ------------------------------------------------------------------------------


def protected_div(a: Column, b: Column) -> Column:
    return both(a, b, F.when(F.abs(b) > DIV_GUARD, F.try_divide(a, b)).otherwise(F.lit(1.0)))


def protected_sqrt(x: Column) -> Column:
    return F.sqrt(F.abs(x))


def protected_log(x: Column) -> Column:
    return F.when(F.abs(x) > DIV_GUARD, F.ln(F.abs(x))).when(x.isNotNull(), F.lit(0.0))


def protected_inv(x: Column) -> Column:
    return F.when(F.abs(x) > DIV_GUARD, F.try_divide(F.lit(1.0), x)).when(x.isNotNull(), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def protected_sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + protected_expneg(x))


def exp(x: Column) -> Column:
    return clean(F.exp(x))


def protected_exp(x: Column) -> Column:
    return F.when(x < EXP_LIMIT, F.exp(x)).when(x.isNotNull(), F.lit(0.0))


def expneg(x: Column) -> Column:
    return clean(F.exp(-x))


def protected_expneg(x: Column) -> Column:
    return F.when(x > -EXP_LIMIT, F.exp(-x)).when(x.isNotNull(), F.lit(0.0))


def nth_power(x: Column, n: int) -> Column:
    return F.pow(x, F.lit(float(n)))


def protected_nth_power(x: Column, n: int) -> Column:
    return F.when(F.abs(x) < POWER_LIMIT, nth_power(x, n)).when(x.isNotNull(), F.lit(0.0))


def log_abs(x: Column) -> Column:
    return F.ln(F.abs(x))


def inverse(x: Column) -> Column:
    return F.try_divide(F.lit(1.0), x)


def harmonic_series(x: Column) -> Column:
    """The asymptotic expansion of the harmonic number."""
    inv = F.try_divide(F.lit(1.0), x)
    return (
        F.lit(EULER_GAMMA)
        + F.ln(x)
        + inv / 2.0
        - F.pow(inv, F.lit(2.0)) / 12.0
        + F.pow(inv, F.lit(4.0)) / 120.0
    )


HARMONIC_TERMS = 256  # from here on the expansion is exact to the last digit


def harmonic_exact(x: Column) -> Column:
    """H(n) for whole n: the sum itself while it is short, else the expansion, so a row never makes a long array."""
    n = F.when(F.abs(x) < 2.0**53, x).cast("long")
    short = F.least(F.greatest(n, F.lit(1)), F.lit(HARMONIC_TERMS))
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), short), F.lit(0.0), lambda s, i: s + F.lit(1.0) / i)
    return F.when(x >= HARMONIC_TERMS, harmonic_series(x)).when(n >= 1, total).when(n == 0, F.lit(0.0))


def harmonic(x: Column, all_integers: Column | None = None) -> Column:
    """H(x). ``all_integers`` says whether the whole column is integral; by default each row decides for itself."""
    exact = (x == F.floor(x)) if all_integers is None else all_integers
    return F.when(exact, harmonic_exact(x)).otherwise(harmonic_series(x))


def polynomial(xs: Sequence[Column], exponents: Sequence[Sequence[int]], coefficients: Sequence[float]) -> Column:
    """sum_j c_j * prod_i x_i ** e_ij"""
    total = F.lit(0.0)
    for powers, c in zip(exponents, coefficients, strict=True):
        term = F.lit(float(c))
        for x, e in zip(xs, powers, strict=True):
            if e:
                term = term * F.pow(x, F.lit(float(e)))
        total = total + term
    return total
