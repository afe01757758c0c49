"""Log-gamma, incomplete gamma and beta functions and the complementary error function as Column expressions (JVM side).

Null arguments give null, and so do arguments outside a function's domain. Series and continued fractions take a number of
terms that grows with the root of the larger parameter, as that is how fast they converge, and not with a sample's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exact import _col
from .genotypes import let

# Lanczos coefficients for g = 7 and 9 terms.
_LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]
_G = 7.0
#: Terms beyond the root's share, and terms for each root: enough for a relative 1e-12 (tests compare with exact sums).
TERMS, PER_ROOT = 60, 12.0
#: What a denominator of zero is taken for.
TINY = 1e-300


def _doubles(*values: Column | str) -> Column:
    return F.struct(*[_col(v).cast("double").alias(f"v{n}") for n, v in enumerate(values)])


def _log_gamma(x: Column) -> Column:
    total = F.lit(_LANCZOS[0])
    for n, c in enumerate(_LANCZOS[1:]):
        total = total + F.lit(c) / (x + n)
    t = x + (_G - 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.ln(t) - t + F.ln(total)


def log_gamma(x: Column | str) -> Column:
    """The natural logarithm of the gamma function of x > 0."""
    return let(_col(x).cast("double"), lambda x: F.when(x > 0, _log_gamma(x)))


def log_choose(n: Column | str, k: Column | str) -> Column:
    """The natural logarithm of how many ways there are to choose k of n."""
    return let(_doubles(n, k), lambda v: F.when((v["v1"] >= 0) & (v["v1"] <= v["v0"]), _log_gamma(v["v0"] + 1) - _log_gamma(v["v1"] + 1) - _log_gamma(v["v0"] - v["v1"] + 1)))


def _terms(size: Column) -> Column:
    return F.sequence(F.lit(1), (F.lit(TERMS) + F.lit(PER_ROOT) * F.sqrt(size)).cast("int"))


def _off_zero(x: Column) -> Column:
    return let(x, lambda x: F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x))


def _fraction(terms: Column, first: Column, step: Callable[[Column], tuple[Column, Column]]) -> Column:
    """A continued fraction 1 / (first + a1 / (b1 + a2 / (b2 + ...))) by Lentz's method; step gives (a, b) of a term's number."""
    start = F.struct(F.lit(1 / TINY).alias("c"), (F.lit(1.0) / _off_zero(first)).alias("d"), (F.lit(1.0) / _off_zero(first)).alias("h"))

    def go(s: Column, i: Column) -> Column:
        a, b = step(i.cast("double"))
        both = F.struct(_off_zero(b + a / s["c"]).alias("c"), (F.lit(1.0) / _off_zero(a * s["d"] + b)).alias("d"))
        return let(both, lambda v: F.struct(v["c"].alias("c"), v["d"].alias("d"), (s["h"] * v["c"] * v["d"]).alias("h")))

    return F.aggregate(terms, start, go, lambda s: s["h"])


def _gamma(a: Column, x: Column, upper: bool) -> Column:
    scale = F.exp(a * F.ln(x) - x - _log_gamma(a))
    start = F.struct((F.lit(1.0) / a).alias("term"), (F.lit(1.0) / a).alias("all"))

    def add(s: Column, i: Column) -> Column:
        return let(s["term"] * x / (a + i), lambda term: F.struct(term.alias("term"), (s["all"] + term).alias("all")))

    below = scale * F.aggregate(_terms(a), start, add, lambda s: s["all"])
    above = scale * _fraction(_terms(a), x + 1 - a, lambda i: (i * (a - i), x + 1 - a + 2 * i))
    one = F.lit(1.0)
    inner = F.when(x < a + 1, one - below if upper else below).otherwise(above if upper else one - above)
    return F.when((a > 0) & (x == 0), F.lit(1.0 if upper else 0.0)).when((a > 0) & (x > 0), inner)


def gamma_p(a: Column | str, x: Column | str) -> Column:
    """The regularised lower incomplete gamma function of a > 0 and x >= 0: the chance of a or more events of a mean of x."""
    return let(_doubles(a, x), lambda v: _gamma(v["v0"], v["v1"], upper=False))


def gamma_q(a: Column | str, x: Column | str) -> Column:
    """The regularised upper incomplete gamma function, accurate where it is small."""
    return let(_doubles(a, x), lambda v: _gamma(v["v0"], v["v1"], upper=True))


def erfc(x: Column | str) -> Column:
    """The complementary error function."""
    half = F.lit(0.5)
    return let(_col(x).cast("double"), lambda x: F.when(x >= 0, _gamma(half, x * x, upper=True)).otherwise(F.lit(1.0) + _gamma(half, x * x, upper=False)))


def chi_square_tail(x: Column | str, freedom: Column | str) -> Column:
    """The chance of a chi-square statistic of x or more."""
    return gamma_q(_col(freedom).cast("double") / 2, _col(x).cast("double") / 2)


def _beta(a: Column, b: Column, x: Column) -> Column:
    """The fraction converges fast where x < (a + 1) / (a + b + 2)."""
    scale = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.ln(x) + b * F.ln(F.lit(1.0) - x))

    def step(i: Column) -> tuple[Column, Column]:
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(i % 2 == 0, even).otherwise(odd), F.lit(1.0)

    return scale / a * _fraction(_terms(F.greatest(a, b)), F.lit(1.0), step)


def beta_i(a: Column | str, b: Column | str, x: Column | str) -> Column:
    """The regularised incomplete beta function of a, b > 0 and 0 <= x <= 1: the chance of a or more hits in a + b - 1 tries of chance x."""

    def inner(v: Column) -> Column:
        a, b, x = v["v0"], v["v1"], v["v2"]
        near = x < (a + 1) / (a + b + 2)
        # the other side of the same integral
        turned = F.struct(F.when(near, a).otherwise(b).alias("a"), F.when(near, b).otherwise(a).alias("b"), F.when(near, x).otherwise(F.lit(1.0) - x).alias("x"), near.alias("near"))
        value = let(turned, lambda t: let(_beta(t["a"], t["b"], t["x"]), lambda p: F.when(t["near"], p).otherwise(F.lit(1.0) - p)))
        return F.when((a > 0) & (b > 0), F.when(x == 0, F.lit(0.0)).when(x == 1, F.lit(1.0)).when((x > 0) & (x < 1), value))

    return let(_doubles(a, b, x), inner)
