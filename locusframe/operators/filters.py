"""Row predicates as Columns over the variants DataFrame.

A predicate is (name, comparator, value); several are joined by AND, cheap ones first, so that codegen's short circuit
skips regular expressions and genotype work. Missing values fail every comparison.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotypes as G

_NUMERIC: dict[str, Callable[[Any, Any], Column]] = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
#: Comparators of text: order compares lengths, equality the text; a pattern is searched for anywhere.
_TEXT: dict[str, Callable[[Column, Any], Column]] = {k: (lambda f: lambda c, v: f(F.length(c), F.length(F.lit(v))))(f) for k, f in _NUMERIC.items() if k not in ("==", "!=")} | {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "regex": lambda c, v: c.rlike(v),
}


def compare(c: Column, comparator: str, value: Any) -> Column:
    table = _TEXT if isinstance(value, str) else _NUMERIC
    if comparator not in table:
        raise ValueError(f"comparator {comparator!r} does not fit {value!r}")
    return F.coalesce(table[comparator](c, value), F.lit(False))


def _alts() -> Column:
    return F.slice(F.col("alleles"), 2, F.greatest(F.size("alleles") - 1, F.lit(0)))


def _alt_counts() -> Column:
    return F.slice(G.allele_counts(), 2, F.greatest(F.size("alleles") - 1, F.lit(0)))


def _alt_frequencies() -> Column:
    return F.slice(G.af(G.allele_counts()), 2, F.greatest(F.size("alleles") - 1, F.lit(0)))


def alt_alleles(comparator: str, n: int) -> Column:
    """Number of ALT alleles."""
    return compare(F.size("alleles") - 1, comparator, n)


def quality(comparator: str, q: float) -> Column:
    """QUAL; a missing one (null or NaN) fails."""
    return ~F.coalesce(F.isnan("qual"), F.lit(True)) & F.col("qual").isNotNull() & compare(F.col("qual"), comparator, q)


def ref_allele(comparator: str, v: str) -> Column:
    return compare(F.get(F.col("alleles"), F.lit(0)), comparator, v)


def alt_allele(comparator: str, v: str) -> Column:
    """Any ALT allele."""
    return F.exists(_alts(), lambda x: compare(x, comparator, v))


def name(comparator: str, v: str) -> Column:
    return compare(F.col("id"), comparator, v)


def alt_count(comparator: str, n: int) -> Column:
    """Any ALT allele's count."""
    return F.exists(_alt_counts(), lambda x: compare(x, comparator, n))


def alt_frequency(comparator: str, f: float) -> Column:
    """Any ALT allele's frequency, each by itself."""
    return F.exists(_alt_frequencies(), lambda x: compare(x, comparator, f))


def known(yes: bool = True) -> Column:
    return F.col("id").isNotNull() if yes else F.col("id").isNull()


def phased(yes: bool = True) -> Column:
    """All called genotypes are phased, or not all."""
    return G.all_phased() if yes else ~G.all_phased()


def mixed_phasing(yes: bool = True) -> Column:
    return G.mixed_phasing() if yes else ~G.mixed_phasing()


def mixed_ploidy(yes: bool = True) -> Column:
    return G.mixed_ploidy() if yes else ~G.mixed_ploidy()


def uncalled(yes: bool = True) -> Column:
    """Any missing allele, or none."""
    return G.missing_alleles() > 0 if yes else G.missing_alleles() == 0


def unseen_alt(yes: bool = True) -> Column:
    """Any ALT allele without a call, or any with one."""
    return F.exists(_alt_counts(), (lambda x: x == 0) if yes else (lambda x: x != 0))


def site_ploidy(comparator: str, n: int) -> Column:
    return compare(G.ploidy(), comparator, n)


def filter_value(v: str) -> Column:
    """The FILTER column lists this value."""
    return F.coalesce(F.array_contains("filters", v), F.lit(False))


def info_field(field: str, comparator: str, v: Any) -> Column:
    """A scalar INFO field."""
    return compare(F.col(f"info.`{field}`"), comparator, v)


def variant_type(kind: str) -> Column:
    """Any ALT allele of this class (see operators.annotate)."""
    from .annotate import variant_class

    return F.exists(_alts(), lambda x: variant_class(F.get(F.col("alleles"), F.lit(0)), x) == kind)


#: Predicate builders by name, and how dear each is to evaluate: scalars, array tests, patterns, genotypes.
PREDICATES: dict[str, tuple[Callable[..., Column], int]] = {
    "alt_alleles": (alt_alleles, 0), "quality": (quality, 0), "known": (known, 0), "filter_value": (filter_value, 1), "info_field": (info_field, 1), "variant_type": (variant_type, 3),
    "ref_allele": (ref_allele, 2), "alt_allele": (alt_allele, 2), "name": (name, 2), "phased": (phased, 4), "mixed_phasing": (mixed_phasing, 4), "mixed_ploidy": (mixed_ploidy, 4),
    "uncalled": (uncalled, 4), "unseen_alt": (unseen_alt, 5), "alt_count": (alt_count, 5), "alt_frequency": (alt_frequency, 5), "site_ploidy": (site_ploidy, 4),
}


@dataclass
class Filters:
    """A conjunction of predicates."""

    parts: list[tuple[int, Column]] = field(default_factory=list)

    def add(self, predicate: str, *args: Any) -> Filters:
        if predicate not in PREDICATES:
            raise ValueError(f"unknown predicate: {predicate!r}")
        build, cost = PREDICATES[predicate]
        self.parts.append((cost, build(*args)))
        return self

    def column(self) -> Column:
        return reduce(operator.and_, (c for _, c in sorted(self.parts, key=lambda p: p[0])), F.lit(True))


def where(df: DataFrame, predicates: Iterable[tuple]) -> DataFrame:
    """Rows that pass all of (name, arguments...)."""
    f = Filters()
    for p in predicates:
        f.add(*p)
    return df.where(f.column())


def keep_samples(df: DataFrame, numbers: list[int]) -> DataFrame:
    """All rows, with the genotypes and per-sample values of these samples only, in this order."""
    from .annotate import numbers_of

    own = numbers_of(numbers)
    take = lambda c: F.transform(own, lambda i: F.get(c, i))
    out = df.withColumn("gt", F.when(F.col("gt").isNotNull(), take(F.col("gt")))).drop("gt_runs")
    if "fmt" in df.columns:
        names = df.schema["fmt"].dataType.names
        out = out.withColumn("fmt", F.struct(*[F.when(F.col(f"fmt.`{n}`").isNotNull(), take(F.col(f"fmt.`{n}`"))).alias(n) for n in names]))
    return out
