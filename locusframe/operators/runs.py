"""Counts from run-length genotypes: a site's neighbouring samples with equal calls are one run.

``gt_runs`` is an array of struct(e, a, p): the number of samples up to the run's end, and their call. What annotations count
depends on calls and how many samples have them, so that a run is looked at once, whatever its length. A group's share of
a run is the difference of two prefix sums over its membership, one list for each group in the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotypes import count_of, let

#: The column that holds runs, beside or in place of ``gt``.
RUNS = "gt_runs"
TYPE = "array<struct<e:int,a:array<int>,p:array<boolean>>>"


def pack(gt: str = "gt") -> Column:
    """Runs of a genotype array, found in one walk; null where it is null."""
    g = F.col(gt)
    last = F.filter(F.sequence(F.lit(0), F.greatest(F.size(g) - 1, F.lit(0))), lambda i: (i == F.size(g) - 1) | ~F.get(g, i).eqNullSafe(F.get(g, i + 1)))
    made = F.transform(last, lambda i: F.struct((i + 1).alias("e"), F.get(g, i)["a"].alias("a"), F.get(g, i)["p"].alias("p")))
    return F.when(g.isNotNull(), F.when(F.size(g) > 0, made).otherwise(F.array().cast(TYPE)))


def expand(runs: str = RUNS) -> Column:
    """One call for each sample again."""
    one = lambda r, i: F.array_repeat(F.struct(r["a"].alias("a"), r["p"].alias("p")), r["e"] - _before(F.col(runs), i))
    return F.when(F.col(runs).isNotNull(), F.flatten(F.transform(runs, one)))


def _before(runs: Column, i: Column) -> Column:
    return F.coalesce(F.get(runs, i - 1)["e"], F.lit(0))


def prefix_sums(numbers: Sequence[int], samples: int) -> Column:
    """How many of the numbers are below 0, 1, ... samples, as one literal. Repeated numbers count once, as in a set."""
    own, total, out = set(numbers), 0, [0]
    for i in range(samples):
        total += i in own
        out.append(total)
    return F.split(F.lit(",".join(map(str, out))), ",").cast("array<int>")


def weights(runs: Column, members: Column | None = None) -> Column:
    """How many samples each run has, or how many of a group's members by their prefix sums."""
    if members is None:
        return F.transform(runs, lambda r, i: r["e"] - _before(runs, i))
    return F.transform(runs, lambda r, i: F.get(members, r["e"]) - F.get(members, _before(runs, i)))


def _sum(runs: Column, own: Column, part: Callable[[Column], Column]) -> Column:
    """Over runs, how many samples there are times what part says of their alleles."""
    return F.aggregate(F.zip_with(runs, own, lambda r, n: n * part(r["a"])), F.lit(0), lambda s, x: s + x)


def counts(own: Column, names: Sequence[str], runs: str = RUNS, alleles: str = "alleles") -> dict[str, Column]:
    """The named helper counts of ``annotate``, of samples weighted by own, a column that is there already."""
    r, n = F.coalesce(F.col(runs), F.array().cast(TYPE)), F.greatest(F.size(alleles), F.lit(1))
    each = F.sequence(F.lit(0), n - 1)
    ploidy = F.coalesce(F.array_max(F.zip_with(r, own, lambda x, w: F.when(w > 0, F.size(x["a"])))), F.lit(0))
    at = lambda a, j, k: F.coalesce((F.get(a, j) == k).cast("int"), F.lit(0))
    by_position = lambda p: F.when(p > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(p, F.lit(1)) - 1), lambda j: F.transform(each, lambda k: _sum(r, own, lambda a: at(a, j, k)))))).otherwise(F.array().cast("array<int>"))
    pair = lambda x, y: _sum(r, own, lambda a: (a == F.array(F.lit(x), F.lit(y))).cast("int"))
    made: dict[str, Callable[[], Column]] = {
        "ac": lambda: F.transform(each, lambda k: _sum(r, own, lambda a: count_of(a, k))), "npm": lambda: _sum(r, own, lambda a: count_of(a, F.lit(-1))), "pl": lambda: ploidy,
        "acp": lambda: let(ploidy, by_position), "rr": lambda: pair(0, 0), "aa": lambda: pair(1, 1), "ra": lambda: pair(0, 1) + pair(1, 0),
    }
    return {x: made[x]() for x in names}


def calls(runs: str = RUNS) -> Column:
    """The call of each run, as genotypes of as many samples."""
    return F.transform(runs, lambda r: F.struct(r["a"].alias("a"), r["p"].alias("p")))


def samples(df: DataFrame) -> int:
    """How many samples the runs cover: the same at every site that has any, so that one is looked at."""
    first = df.where(F.size(RUNS) > 0).select(F.element_at(RUNS, -1)["e"]).first()
    return first[0] if first else 0


def with_runs(df: DataFrame) -> DataFrame:
    """Genotypes as runs, in place of ``gt``."""
    return df.withColumn(RUNS, pack()).drop("gt")
