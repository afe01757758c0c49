"""Genotype counts of one site as Column expressions over its ``alleles`` and ``gt`` (no shuffle, no Python).

``gt`` is an array over samples of struct(a, p): allele numbers in VCF terms (-1 missing, 0 REF, 1.. ALT) and, for each,
whether the separator before it was a phased one. A sample may have fewer alleles than the site's ploidy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

GT_TYPE = "array<struct<a:array<int>,p:array<boolean>>>"


def _gt(gt: Column | str) -> Column:
    return F.coalesce(F.col(gt) if isinstance(gt, str) else gt, F.array().cast(GT_TYPE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once for each row, however often body names it, also where a filter is moved."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def flat(gt: Column | str = "gt") -> Column:
    """All allele numbers of a site."""
    return F.flatten(_gt(gt)["a"])


def count_of(values: Column, k: Column | int) -> Column:
    """How many values equal k: a built-in removal is many times faster than a lambda on each value."""
    return F.size(values) - F.size(F.array_remove(values, k))


def allele_counts(gt: Column | str = "gt", alleles: Column | str = "alleles") -> Column:
    """Called alleles by number, REF first."""
    n = F.size(F.col(alleles) if isinstance(alleles, str) else alleles)
    return let(flat(gt), lambda values: F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: count_of(values, k)))


def _ploidy(g: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(g["a"], F.size)), F.lit(0))


def ploidy(gt: Column | str = "gt") -> Column:
    return _ploidy(_gt(gt))


def position_counts(gt: Column | str = "gt", alleles: Column | str = "alleles") -> Column:
    """Called alleles by haplotype position, then allele number: position-major, REF first."""
    n = F.greatest(F.size(F.col(alleles) if isinstance(alleles, str) else alleles), F.lit(1))

    def all_of(g: Column) -> Column:
        def at(j: Column) -> Column:
            own = F.transform(g["a"], lambda x: F.get(x, j))  # null where a sample has fewer
            return let(own, lambda o: F.transform(F.sequence(F.lit(0), n - 1), lambda k: count_of(o, k)))

        def by_position(p: Column) -> Column:
            return F.when(p > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(p, F.lit(1)) - 1), at))).otherwise(F.array().cast("array<int>"))

        return let(_ploidy(g), by_position)

    return let(_gt(gt), all_of)


def missing_alleles(gt: Column | str = "gt") -> Column:
    return count_of(flat(gt), -1)


def absent_alleles(gt: Column | str = "gt") -> Column:
    """Slots that samples of lower ploidy lack."""
    return let(_gt(gt), lambda g: (F.size(g) * _ploidy(g) - F.size(F.flatten(g["a"]))).cast("int"))


def genotype_count(first: int, second: int, gt: Column | str = "gt") -> Column:
    """Diploid genotypes with these alleles in this order."""
    return count_of(_gt(gt)["a"], F.array(F.lit(first), F.lit(second)))


def genotype_table(gt: Column | str = "gt") -> Column:
    """(a0, a1, n) of every ordered diploid genotype that occurs, missing ones included, in order."""
    pairs = F.filter(_gt(gt)["a"], lambda x: F.size(x) == 2)
    return let(pairs, lambda g: F.transform(F.array_sort(F.array_distinct(g)), lambda d: F.struct(F.get(d, F.lit(0)).alias("a0"), F.get(d, F.lit(1)).alias("a1"), count_of(g, d).alias("n"))))


def phases(gt: Column | str = "gt") -> Column:
    """Of called genotypes with two alleles or more: whether the last separator is a phased one."""
    called = F.filter(_gt(gt), lambda g: (F.size(g["a"]) > 1) & F.exists(g["a"], lambda x: x >= 0))
    return F.transform(called, lambda g: F.element_at(g["p"], -1))


def all_phased(gt: Column | str = "gt") -> Column:
    """Every called genotype is phased (so where none is called)."""
    return F.forall(phases(gt), lambda p: p)


def mixed_phasing(gt: Column | str = "gt") -> Column:
    return let(phases(gt), lambda x: F.exists(x, lambda p: p) & F.exists(x, lambda p: ~p))


def mixed_ploidy(gt: Column | str = "gt") -> Column:
    """Some sample has fewer alleles than the site's ploidy."""
    return let(F.transform(_gt(gt)["a"], F.size), lambda sizes: F.coalesce(F.array_min(sizes) < F.array_max(sizes), F.lit(False)))


def af(ac: Column) -> Column:
    """Frequencies of counts; all 0 where nothing was called."""

    def shares(c: Column) -> Column:
        return let(F.aggregate(c, F.lit(0), lambda s, x: s + x), lambda total: F.transform(c, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)).cast("double")))

    return let(ac, shares)


def diploid_codes(gt: Column | str = "gt") -> Column:
    """Of each sample: 0, 1 or 2 for how many ALT1 a diploid call of REF and ALT1 has, else -1."""

    def code(g: Column) -> Column:
        x, y = F.get(g["a"], F.lit(0)), F.get(g["a"], F.lit(1))
        return F.when((F.size(g["a"]) == 2) & x.between(0, 1) & y.between(0, 1), x + y).otherwise(F.lit(-1))

    return F.transform(_gt(gt), code)
