"""Genotype annotation of each site, for all samples or groups of them, with F-statistics over groups.

Everything is an expression over the site's own arrays: no shuffle, and Catalyst drops what is not selected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact
from ..functions import genotypes as G
from . import runs

#: Annotations by name, in the order in which they are added.
TAGS = ["AC", "AF", "AN", "NM", "NPM", "HWE_P", "AC_P", "FS_A", "F_PIC", "HET", "MULTI_ALLELIC", "VT"]
GROUP_TAGS = ["NM", "NPM", "AN", "HWE_P", "AC", "AF", "AC_P", "F_PIC", "HET", "MULTI_ALLELIC"]
FSTATS = ["FIS", "FST", "FIT"]
#: Definitions of the added fields: Number, Type, Description.
DEFINITIONS = {
    "AC": ("R", "Integer", "Called alleles, REF first"),
    "AF": ("R", "Float", "Allele frequencies, REF first"),
    "AN": ("1", "Integer", "Called and missing alleles"),
    "NM": ("1", "Integer", "Called alleles"),
    "NPM": ("1", "Integer", "Missing alleles"),
    "HWE_P": ("1", "Float", "Exact Hardy-Weinberg p-value"),
    "AC_P": (".", "Integer", "Called alleles by haplotype position, REF first"),
    "FS_A": (".", "Float", "PHRED-scaled two-sided Fisher strand bias of alleles"),
    "F_PIC": ("1", "Float", "Inbreeding coefficient from heterozygosity"),
    "HET": ("1", "Float", "Share of heterozygous genotypes"),
    "MULTI_ALLELIC": ("0", "Flag", "More than one ALT allele"),
    "VT": ("A", "String", "Class of each ALT allele"),
    "FIS": ("1", "Float", "Inbreeding within groups"),
    "FST": ("1", "Float", "Fixation between groups"),
    "FIT": ("1", "Float", "Inbreeding in all groups"),
}


#: What each annotation is made of; the rest is not built.
_NEEDS = {"AC": ["ac"], "AF": ["ac"], "AN": ["ac", "npm"], "NM": ["ac"], "NPM": ["npm"], "HWE_P": ["pl", "rr", "aa", "ra"], "AC_P": ["acp"], "FS_A": ["pl", "acp"], "F_PIC": ["pl", "rr", "aa", "ra"], "HET": ["pl", "rr", "aa", "ra"]}


def _counts(df: DataFrame, gt: Column | str, prefix: str, tags: Iterable[str], members: Column | None = None) -> DataFrame:
    """Helper columns that the annotations share, computed once; from runs where there are any (members: a group's prefix sums)."""
    if runs.RUNS in df.columns:
        needed = sorted({x for t in tags for x in _NEEDS.get(t, [])})
        if not needed:
            return df
        out = df.withColumn(f"{prefix}w", runs.weights(F.coalesce(F.col(runs.RUNS), F.array().cast(runs.TYPE)), members))
        return out.withColumns({f"{prefix}{n}": c for n, c in runs.counts(F.col(f"{prefix}w"), needed).items()})
    build: dict[str, Callable[[], Column]] = {
        "ac": lambda: G.allele_counts(gt), "npm": lambda: G.missing_alleles(gt), "pl": lambda: G.ploidy(gt), "acp": lambda: G.position_counts(gt), "rr": lambda: G.genotype_count(0, 0, gt),
        "aa": lambda: G.genotype_count(1, 1, gt), "ra": lambda: G.genotype_count(0, 1, gt) + G.genotype_count(1, 0, gt),
    }
    needed = {x for t in tags for x in _NEEDS.get(t, [])}
    return df.withColumns({f"{prefix}{n}": make() for n, make in build.items() if n in needed}) if needed else df


def variant_class(ref: Column, alt: Column) -> Column:
    """SNV, MNP, INDEL, CLUMPED (a longer change that also changes length), SV or UNKNOWN of one ALT allele."""
    plain = r"^[ACGTNacgtn]+$"
    return (
        F.when(alt.rlike(r"^<.*>$") | alt.rlike(r"[\[\]]"), F.lit("SV"))
        .when(~ref.rlike(plain) | ~alt.rlike(plain), F.lit("UNKNOWN"))
        .when((F.length(ref) == 1) & (F.length(alt) == 1), F.lit("SNP"))
        .when(F.length(ref) == F.length(alt), F.lit("MNP"))
        .when(alt.startswith(ref) | ref.startswith(alt), F.lit("INDEL"))
        .otherwise(F.lit("CLUMPED"))
    )


def _expression(prefix: str, tag: str) -> Column:
    ac, npm, acp, rr, aa, ra, pl = (f"{prefix}{x}" for x in ("ac", "npm", "acp", "rr", "aa", "ra", "pl"))
    add = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    if tag == "AC":
        return F.col(ac)
    if tag == "AF":
        return G.af(F.col(ac))
    if tag == "AN":
        return add(ac) + F.col(npm)
    if tag == "NM":
        return add(ac)
    if tag == "NPM":
        return F.col(npm)
    if tag == "AC_P":
        return F.col(acp)
    n_alleles = F.size("alleles")
    if tag == "MULTI_ALLELIC":
        return n_alleles > 2
    if tag == "VT":
        return F.transform(F.slice(F.col("alleles"), 2, F.greatest(n_alleles - 1, F.lit(0))), lambda x: variant_class(F.get(F.col("alleles"), F.lit(0)), x))
    diploid = F.col(pl) == 2
    if tag == "HWE_P":
        return F.when(diploid & (n_alleles == 2), exact.hwe(F.col(ra), F.col(rr), F.col(aa))).otherwise(F.lit(-1.0))
    if tag == "FS_A":

        def bias(t: Column) -> Column:
            """Of the counts by position and allele, and of their sums at the first and second position."""

            def one(i: Column) -> Column:
                fwd, rev = F.get(t["c"], i), F.get(t["c"], n_alleles + i)
                return exact.phred(exact.fisher(fwd, rev, t["f"] - fwd, t["r"] - rev))

            return F.transform(F.sequence(F.lit(0), F.when(n_alleles == 2, F.lit(0)).otherwise(n_alleles - 1)), one)

        strands = F.struct(F.col(acp).alias("c"), add(F.slice(acp, F.lit(1), n_alleles)).alias("f"), add(F.slice(acp, n_alleles + 1, n_alleles)).alias("r"))
        return F.when(diploid, G.let(strands, bias))
    n_gt = F.col(rr) + F.col(ra) + F.col(aa)
    het = F.when(n_gt > 0, F.col(ra) / n_gt).otherwise(F.lit(0.0))
    if tag == "HET":
        return F.when(diploid, het)
    p = F.when(n_gt > 0, (2 * F.col(rr) + F.col(ra)) / (2 * n_gt)).otherwise(F.lit(0.0))
    expected = 2 * p * (1 - p)
    return F.when(diploid, F.when(expected > 0, (expected - het) / expected).otherwise(F.lit(0.0)))  # F_PIC


#: Under the documents' naming, these tags hold what others hold in the code's.
_DOCS = {"NM": "NPM", "AN": "NM"}


def annotate(df: DataFrame, tags: Iterable[str] = TAGS, naming: str = "code", into: str | None = "info") -> DataFrame:
    """Add annotations to the info struct (into="info") or as columns of their own (into=None).

    A tag that is there already is overwritten in place; a new one is appended, also to info_keys. naming="code": NM
    called, NPM missing, AN both; naming="docs": NM missing, AN called. HWE_P is -1 unless the site is diploid and
    biallelic; F_PIC, HET and FS_A are null unless it is diploid, and look at REF and the first ALT at multi-allelic sites.
    """
    tags = list(tags)
    if unknown := [t for t in tags if t not in TAGS]:
        raise ValueError(f"unknown annotations: {unknown}")
    meant = {t: _DOCS.get(t, t) if naming == "docs" else t for t in tags}
    out = _counts(df, "gt", "__", meant.values())
    helpers = [c for c in out.columns if c not in df.columns]
    values = {t: _expression("__", own) for t, own in meant.items()}
    return (out.withColumns(values) if into is None else _upsert(out, values, into)).drop(*helpers)


def _upsert(df: DataFrame, values: Mapping[str, Column], into: str) -> DataFrame:
    """Set fields of the info struct and their keys: flags only where true, nulls not at all."""
    names = [f.name for f in df.schema[into].dataType.fields] if into in df.columns else []
    fields = [values[n].alias(n) if n in values else F.col(f"`{into}`.`{n}`").alias(n) for n in names]
    fields += [v.alias(t) for t, v in values.items() if t not in names]
    keys = F.coalesce(F.col("info_keys"), F.array().cast("array<string>")) if "info_keys" in df.columns else F.array().cast("array<string>")
    out = df.withColumn(into, F.struct(*fields))
    kinds = {f.name: f.dataType for f in out.schema[into].dataType.fields}
    shown = [F.when(F.col(f"{into}.`{t}`") if isinstance(kinds[t], T.BooleanType) else F.col(f"{into}.`{t}`").isNotNull(), F.lit(t)) for t in values]
    new = F.filter(F.array(*shown), lambda t: t.isNotNull() & ~F.array_contains(keys, t))
    return out.withColumn("info_keys", F.concat(keys, new))


def members(samples: Sequence[str], groups: Iterable[tuple[str, str]]) -> dict[str, list[int]]:
    """Sample numbers by group, groups in order of first sight; a sample may be in several; unknown samples are left out."""
    at = {s: i for i, s in enumerate(samples)}
    out: dict[str, list[int]] = {}
    for sample, group in groups:
        if sample in at:
            out.setdefault(group, []).append(at[sample])
    return out


def numbers_of(numbers: Sequence[int]) -> Column:
    """Sample numbers as one literal: a plan with a literal for each of many thousand samples takes long to make."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>") if numbers else F.array().cast("array<int>")


def _of(numbers: Sequence[int]) -> Column:
    """The calls of some samples; none at a site without genotypes, which then counts none, as for all samples."""
    return F.array_compact(F.transform(numbers_of(numbers), lambda i: F.get(F.col("gt"), i)))


def annotate_groups(df: DataFrame, groups: Mapping[str, Sequence[int]], tags: Iterable[str] = GROUP_TAGS, into: str | None = "info") -> DataFrame:
    """The same annotations for each group of sample numbers, as ``<group>_<tag>``, at every site."""
    tags = list(tags)
    values: dict[str, Column] = {}
    out, helpers = df, []
    packed = runs.RUNS in df.columns
    n_samples = runs.samples(df) if packed else 0
    for n, (group, numbers) in enumerate(groups.items()):
        prefix = f"__{n}_"
        if packed:
            out = out.withColumn(f"{prefix}m", runs.prefix_sums(numbers, n_samples))
            out = _counts(out, "gt", prefix, tags, F.col(f"{prefix}m"))
        else:
            out = out.withColumn(f"{prefix}gt", _of(numbers))
            out = _counts(out, f"{prefix}gt", prefix, tags)
        helpers += [c for c in out.columns if c.startswith(prefix)]
        values |= {f"{group}_{t}": _expression(prefix, t) for t in tags}
    if into is None:
        return out.withColumns(values).drop(*helpers)
    return _upsert(out, values, into).drop(*helpers)


def f_statistics(df: DataFrame, groups: Mapping[str, Sequence[int]], into: str | None = "info") -> DataFrame:
    """FIS, FST and FIT over groups at diploid biallelic sites, null elsewhere.

    Of groups with genotypes: observed and expected heterozygosity weighted by genotypes, and that of the pooled allele
    frequencies. A sample in several groups counts in each. A value with denominator 0 is 0.
    """
    packed = runs.RUNS in df.columns
    n_samples = runs.samples(df) if packed else 0
    per_group = F.array(*[runs.prefix_sums(numbers, n_samples) if packed else numbers_of(numbers) for numbers in groups.values()])
    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("n", "h", "e", "r", "a")])

    def add(codes: Column):
        def one(s: Column, numbers: Column) -> Column:
            def counted(own: Column) -> Column:
                rr, ra, aa = (G.count_of(own, F.lit(k)).cast("double") for k in (0, 1, 2))
                return F.struct(rr.alias("rr"), ra.alias("ra"), aa.alias("aa"))

            def summed(c: Column) -> Column:
                n = c["rr"] + c["ra"] + c["aa"]
                p, q = 2 * c["rr"] + c["ra"], 2 * c["aa"] + c["ra"]
                more = F.struct((s["n"] + n).alias("n"), (s["h"] + c["ra"]).alias("h"), (s["e"] + 2 * (p / (2 * n)) * (q / (2 * n)) * n).alias("e"), (s["r"] + p).alias("r"), (s["a"] + q).alias("a"))
                return F.when(n > 0, more).otherwise(s)

            def of_runs(w: Column) -> Column:
                of = lambda k: F.aggregate(F.zip_with(codes, w, lambda c, n: F.when(c == k, n).otherwise(0)), F.lit(0), lambda t, x: t + x).cast("double")
                return F.struct(of(0).alias("rr"), of(1).alias("ra"), of(2).alias("aa"))

            if packed:  # one code for each run, as many members as its prefix sums say
                return G.let(G.let(runs.weights(F.col(runs.RUNS), numbers), of_runs), summed)
            return G.let(G.let(F.transform(numbers, lambda i: F.get(codes, i)), counted), summed)

        return one

    def ratios(s: Column) -> Column:
        hi, hs, ht = s["h"] / s["n"], s["e"] / s["n"], 2 * (s["r"] / (2 * s["n"])) * (s["a"] / (2 * s["n"]))
        ratio = lambda top, below: F.when(below != 0, top / below).otherwise(F.lit(0.0))
        return F.when(s["n"] > 0, F.struct(ratio(hs - hi, hs).alias("FIS"), ratio(ht - hs, ht).alias("FST"), ratio(ht - hi, ht).alias("FIT")))

    # n above 0 means that some call has two alleles of the two there are; a longer one makes the site no diploid one
    whole = G.let(G.diploid_codes(runs.calls() if packed else "gt"), lambda codes: G.let(F.aggregate(per_group, zero, add(codes)), ratios))
    out = df.withColumn("__f", F.when((F.size("alleles") == 2) & (G.ploidy(runs.calls() if packed else "gt") == 2), whole))
    values = {x: F.col(f"__f.{x}") for x in FSTATS}
    if into is None:
        return out.withColumns(values).drop("__f")
    return _upsert(out, values, into).drop("__f")
