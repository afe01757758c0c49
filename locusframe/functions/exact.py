"""Exact tests and probabilities as Column expressions (JVM side), with plain Python twins for single values."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .genotypes import let

#: Two probabilities within this factor count as tied.
TIE = 1e-7


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _add(s: Column, p: Column) -> Column:
    """Sums (all, and those no likelier than the observed 1) with the next probability."""
    return let(p, lambda p: F.struct(p.alias("p"), (s["all"] + p).alias("all"), (s["tail"] + F.when(p <= F.lit(1 + TIE), p).otherwise(F.lit(0.0))).alias("tail")))


def _walk(n: Column, step: Callable[[Column, Column], Column]) -> Column:
    zero = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("all"), F.lit(0.0).alias("tail"))
    return let(n, lambda n: F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), zero, step))


def _share(up: Column, down: Column) -> Column:
    both = F.struct(up.alias("u"), down.alias("d"))
    return let(both, lambda s: F.least(F.lit(1.0), (s["u"]["tail"] + s["d"]["tail"] + 1) / (s["u"]["all"] + s["d"]["all"] + 1)))


def hwe(het: Column | str, hom1: Column | str, hom2: Column | str) -> Column:
    """Exact Hardy-Weinberg p-value of diploid biallelic genotype counts; 1 where nothing was called.

    Probabilities are taken relative to the observed heterozygote count and walked outwards in steps of two, so that no
    factorial is needed; an overflow means that the observed count is impossibly far out, and gives 0.
    """
    counts = F.struct(*[F.coalesce(_col(c), F.lit(0)).cast("double").alias(n) for c, n in ((het, "h"), (hom1, "a"), (hom2, "b"))])

    def p_value(t: Column) -> Column:
        h, a, b = t["h"], t["a"], t["b"]

        def higher(s: Column, i: Column) -> Column:
            k = i.cast("double")  # the k-th step: h + 2k heterozygotes after it
            return _add(s, s["p"] * F.lit(4.0) * (a - k + 1) * (b - k + 1) / ((h + 2 * k) * (h + 2 * k - 1)))

        def lower(s: Column, i: Column) -> Column:
            k = i.cast("double")
            return _add(s, s["p"] * (h - 2 * k + 2) * (h - 2 * k + 1) / (F.lit(4.0) * (a + k) * (b + k)))

        return _share(_walk(F.least(a, b).cast("int"), higher), _walk(F.floor(h / 2).cast("int"), lower))

    return let(counts, p_value)


def fisher(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    """Two-sided p-value of Fisher's exact test of the table [a b; c d]."""
    counts = F.struct(*[F.coalesce(_col(x), F.lit(0)).cast("double").alias(n) for x, n in ((a, "a"), (b, "b"), (c, "c"), (d, "d"))])

    def p_value(t: Column) -> Column:
        a, b, c, d = (t[x] for x in "abcd")

        def higher(s: Column, i: Column) -> Column:
            k = i.cast("double")
            return _add(s, s["p"] * (b - k + 1) * (c - k + 1) / ((a + k) * (d + k)))

        def lower(s: Column, i: Column) -> Column:
            k = i.cast("double")
            return _add(s, s["p"] * (a - k + 1) * (d - k + 1) / ((b + k) * (c + k)))

        return _share(_walk(F.least(b, c).cast("int"), higher), _walk(F.least(a, d).cast("int"), lower))

    return let(counts, p_value)


def phred(p: Column) -> Column:
    return F.abs(F.lit(-10.0) * F.log10(p))


def hwe_value(het: int, hom1: int, hom2: int) -> float:
    """As hwe, by enumeration with log-gamma."""
    n, rare = het + hom1 + hom2, 2 * min(hom1, hom2) + het
    if n == 0:
        return 1.0

    def log_p(h: int) -> float:
        r = (rare - h) // 2
        return h * math.log(2) - math.lgamma(h + 1) - math.lgamma(r + 1) - math.lgamma(n - h - r + 1)

    every = [log_p(h) for h in range(rare % 2, rare + 1, 2)]
    top, own = max(every), log_p(het)
    return min(1.0, math.fsum(math.exp(x - top) for x in every if x <= own + TIE) / math.fsum(math.exp(x - top) for x in every))


def fisher_value(a: int, b: int, c: int, d: int) -> float:
    """As fisher, by enumeration with log-gamma."""
    r, s, n = a + b, a + c, a + b + c + d

    def log_p(x: int) -> float:
        return -sum(math.lgamma(v + 1) for v in (x, r - x, s - x, n - r - s + x))

    every = [log_p(x) for x in range(max(0, r + s - n), min(r, s) + 1)]
    top, own = max(every), log_p(a)
    return min(1.0, math.fsum(math.exp(x - top) for x in every if x <= own + TIE) / math.fsum(math.exp(x - top) for x in every))


def g_format(x: float | None) -> str:
    """C's %g of a single-precision value; a dot where missing."""
    return "." if x is None or x != x else f"{x:g}"
