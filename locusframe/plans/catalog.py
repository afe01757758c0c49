"""Named queries over the derived variant tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotypes as G
from ..functions import special
from ..functions import text as X
from ..operators import annotate, blocks, filters, integrity, regions, samples, slicing
from . import derived, filed

Query = Callable[[SparkSession, str], DataFrame]

# SQL: one row per haplotype, allele counts of a site, ordered diploid genotype counts
_H = ", h as (select site_id, sample_id, a0 as a, 0 as p from fx_calls union all select site_id, sample_id, a1, 1 from fx_calls where a1 is not null)"
_C = (
    ", c as (select site_id, cast(sum(case when a >= 0 then 1 else 0 end) as bigint) nm, cast(sum(case when a = -1 then 1 else 0 end) as bigint) npm, "
    "cast(sum(case when a = 0 then 1 else 0 end) as bigint) ac0, cast(sum(case when a = 1 then 1 else 0 end) as bigint) ac1, cast(sum(case when a = 2 then 1 else 0 end) as bigint) ac2 from h group by site_id)"
)
_G = (
    ", g as (select site_id, cast(sum(case when a0 = 0 and a1 = 0 then 1 else 0 end) as bigint) rr, cast(sum(case when a0 = 1 and a1 = 1 then 1 else 0 end) as bigint) aa, "
    "cast(sum(case when (a0 = 0 and a1 = 1) or (a0 = 1 and a1 = 0) then 1 else 0 end) as bigint) ra, cast(max(case when a1 is null then 1 else 2 end) as int) pl from fx_calls group by site_id)"
)
_HC = derived.CTE + _H + _C
_AF = "case when c.nm = 0 then 0 else cast(c.ac{0} as double) / c.nm end"
# HWE and Fisher by summing the probabilities of all tables
_HWE = (
    ", b as (select *, het + h1 + h2 as n, 2 * least(h1, h2) + het as r from t), "
    "k as (select id, het, n, r, k.k as k, (r - k.k) // 2 as hr, n - k.k - (r - k.k) // 2 as hc from b, unnest(range(0, r + 1)) as k(k) where (k.k % 2) = (r % 2)), "
    "p as (select *, exp(k * ln(2) - lgamma(k + 1) - lgamma(hr + 1) - lgamma(hc + 1) + lgamma(n + 1) + lgamma(r + 1) + lgamma(2 * n - r + 1) - lgamma(2 * n + 1)) as p from k), "
    "o as (select id, p as po from p where k = het), "
    "w as (select id, least(1.0, sum(case when p.p <= po * (1 + 1e-7) then p.p else 0 end)) as v from p join o using (id) group by id)"
)
_FISHER = (
    ", x as (select *, a + b + c + d n, a + b r1, a + c c1, x.x xx from t, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) as x(x)), "
    "p as (select *, exp(lgamma(r1 + 1) - lgamma(xx + 1) - lgamma(r1 - xx + 1) + lgamma(n - r1 + 1) - lgamma(c1 - xx + 1) - lgamma(n - r1 - c1 + xx + 1) - lgamma(n + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1)) p from x), "
    "o as (select id, p po from p where xx = a), "
    "w as (select id, abs(-10 * log10(least(1.0, sum(case when p.p <= po * (1 + 1e-7) then p.p else 0 end)))) as v from p join o using (id) group by id)"
)
_CLASS = (
    ", al as (select site_id, 0 as k, ref as x, ref from fx_sites union all select site_id, 1, alt1, ref from fx_sites union all select site_id, 2, alt2, ref from fx_sites where alt2 is not null), "
    "cl as (select site_id, k, case when length(ref) = 1 and length(x) = 1 then case x when 'A' then 0 when 'T' then 1 when 'G' then 2 when 'C' then 3 else 4 end "
    "when k = 0 then 4 when length(x) > length(ref) then 7 when length(x) < length(ref) then 8 else 4 end as code, case when k > 0 then length(x) - length(ref) else 0 end as size from al), "
    "nz as (select c.*, case when exists (select 1 from fx_calls d where d.site_id = c.site_id and d.a1 is not null) then 2 else 1 end as pl from fx_calls c where not (a0 = 0 and (a1 is null or a1 = 0))), "
    "cv as (select nz.site_id, nz.sample_id, nz.a0 as a from nz union all select nz.site_id, nz.sample_id, case when a1 is null then -2 else a1 end from nz where a1 is not null or pl = 2), "
    "v as (select cv.sample_id, r.code as ref, case when cv.a = -1 then 5 when cv.a = -2 then 6 else q.code end as code, case when cv.a >= 0 then q.size else 0 end as size "
    "from cv join cl r on r.site_id = cv.site_id and r.k = 0 left join cl q on q.site_id = cv.site_id and q.k = cv.a)"
)
_SINGLE = ", sg as (select site_id, min(sample_id) as sample_id from h where a > 0 group by site_id having count(*) = 1)"


def _site(df: DataFrame, *more: Column | str) -> DataFrame:
    return df.select("site_id", "contig", "pos", *more)


def _alt(k: int) -> Column:
    return F.get(F.col("alleles"), F.lit(k))


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def _q(build: Callable[[DataFrame], DataFrame], genotypes: bool = True) -> Query:
    return lambda spark, sf_dir: build((derived.variants if genotypes else derived.sites)(spark, sf_dir))


_MULTI = ["chr1:1-20000", "chr2:5e3-9e3", "chr3", "chr1:15000-30000", "chr5:9000-2000"]


def _many() -> list[regions.Interval]:
    """More intervals than are written into a predicate."""
    return [regions.Interval(f"chr{i % 5 + 1}", i * 400, i * 400 + 99) for i in range(150)]


_INDEL = "case when length(ref) > 1 then 'INDEL' when length(alt1) > 1 then 'INDEL' else 'SNP' end"


#: Digests of blocks, and one level of a tree with eight nodes under each above another.
_DIGESTS = ", l0 as (select c, seq, seq as node, block_id, sha256(string_agg(coalesce(v, ''), chr(10) order by pos)) as digest from (select seq, block_id, pos, 'id' as c, id as v from b union all select seq, block_id, pos, 'pos', cast(pos as varchar) from b) group by 1, 2, 3, 4)"
_UP = ", l{j} as (select c, node // 8 as node, sha256(string_agg(digest, chr(10) order by node)) as digest from l{i} group by 1, node // 8)"


def _entries() -> dict[str, tuple]:
    e: dict[str, tuple] = {}

    def add(name: str, build: Callable[[DataFrame], DataFrame], sql: str, genotypes: bool = True) -> None:
        e[name] = (_q(build, genotypes), sql, build, genotypes)

    def predicate(name: str, *p: tuple, sql: str, genotypes: bool) -> None:
        add(name, lambda d: _site(filters.where(d, p)), sql, genotypes)

    add(
        "region_af_annotated",
        lambda d: annotate.annotate(filters.where(regions.filter_regions(d, ["chr3:1-200000"]), [("alt_frequency", ">", 0.1)]), ["NM", "NPM", "AC", "AF"], into=None).select(
            "contig", "pos", _alt(0).alias("ref"), _alt(1).alias("alt1"), F.col("NM").cast("bigint").alias("nm"), F.col("NPM").cast("bigint").alias("npm"), F.get("AC", F.lit(1)).cast("bigint").alias("ac1"), _r(F.get("AF", F.lit(1))).alias("af1")
        ),
        _HC + f" select s.contig, s.pos, s.ref, s.alt1, c.nm, c.npm, c.ac1, round({_AF.format(1)}, 6) as af1 from fx_sites s join c on s.site_id = c.site_id where s.contig = 'chr3' and s.pos between 1 and 200000 and ({_AF.format(1)} > 0.1 or {_AF.format(2)} > 0.1)",
    )
    add(
        "field_slice",
        lambda d: slicing.apply(d, slicing.parse(["chrom; POS;ref", "QUAL"], [], [])).select("contig", "pos", "id", _alt(0).alias("ref"), _alt(1).alias("alt1"), "qual"),
        derived.CTE + " select contig, pos, cast(null as varchar) as id, ref, '.' as alt1, qual from fx_sites",
        False,
    )
    add("region_single", lambda d: _site(regions.filter_regions(d, ["chr2:500-9000"])), derived.CTE + " select site_id, contig, pos from fx_sites where contig = 'chr2' and pos between 500 and 9000", False)
    add("region_contig", lambda d: _site(regions.filter_regions(d, ["chr4"])), derived.CTE + " select site_id, contig, pos from fx_sites where contig = 'chr4'", False)
    add(
        "region_multi",
        lambda d: _site(regions.filter_regions(d, _MULTI)),
        derived.CTE + " select site_id, contig, pos from fx_sites where (contig = 'chr1' and pos between 1 and 30000) or (contig = 'chr2' and pos between 5000 and 9000) or contig = 'chr3' or (contig = 'chr5' and pos between 2000 and 9000)",
        False,
    )
    add(
        "region_multi_semi",
        lambda d: _site(regions.filter_regions(d, _many())),
        derived.CTE + " select site_id, contig, pos from fx_sites s where exists (select 1 from range(150) r(i) where s.contig = 'chr' || cast(r.i % 5 + 1 as varchar) and s.pos between r.i * 400 and r.i * 400 + 99)",
        False,
    )
    add(
        "region_span",
        lambda d: _site(regions.filter_regions(d, ["chr1:1312-1312", "chr2:122"], overlap="span")),
        derived.CTE + " select site_id, contig, pos from fx_sites where (contig = 'chr1' and pos <= 1312 and pos + greatest(length(ref), length(alt1)) - 1 >= 1312) or (contig = 'chr2' and pos <= 122 and pos + greatest(length(ref), length(alt1)) - 1 >= 122)",
        False,
    )
    reaching = lambda d: d.withColumn("info", F.struct((F.col("pos") + F.expr("shiftleft(1L, cast(site_id % 24 as int))")).alias("END")))
    add(
        "region_span_classes",
        lambda d: _site(regions.filter_regions(reaching(d), _many(), overlap="span")),
        derived.CTE + " select site_id, contig, pos from fx_sites s where exists (select 1 from range(150) r(i) where s.contig = 'chr' || cast(r.i % 5 + 1 as varchar) and s.pos <= r.i * 400 + 99 and s.pos + (1::bigint << (site_id % 24)) >= r.i * 400)",
        False,
    )
    add("record_end", lambda d: _site(regions.with_end(d), "end_pos"), derived.CTE + " select site_id, contig, pos, pos + greatest(length(ref), length(alt1)) - 1 as end_pos from fx_sites", False)

    every = derived.CTE + " select site_id, contig, pos from fx_sites s where "
    by_call = _HC + " select s.site_id, s.contig, s.pos from fx_sites s join c on c.site_id = s.site_id where "
    predicate("filter_quality", ("quality", ">", 100), ("quality", "<=", 300), sql=every + "qual > 100 and qual <= 300", genotypes=False)
    predicate("filter_alt_count", ("alt_alleles", ">", 1), sql=every + "alt2 is not null", genotypes=False)
    predicate("filter_ref_regex", ("ref_allele", "regex", "^[AC]T"), sql=every + "regexp_matches(ref, '^[AC]T')", genotypes=False)
    predicate("filter_alleles_regex", ("ref_allele", "regex", "^A"), ("alt_allele", "regex", "C"), sql=every + "regexp_matches(ref, '^A') and (regexp_matches(alt1, 'C') or coalesce(regexp_matches(alt2, 'C'), false))", genotypes=False)
    predicate("filter_name_regex", ("name", "regex", "7$"), sql=every + "id is not null and regexp_matches(id, '7$')", genotypes=False)
    predicate("filter_name_length", ("name", ">", "rs123"), sql=every + "id is not null and length(id) > 5", genotypes=False)
    predicate("filter_known", ("known",), sql=every + "id is not null", genotypes=False)
    predicate("filter_novel", ("known", False), sql=every + "id is null", genotypes=False)
    predicate("filter_value", ("filter_value", "F"), sql=every + "flt = 'F'", genotypes=False)
    predicate("filter_variant_type", ("variant_type", "INDEL"), sql=every + f"{_INDEL} = 'INDEL'", genotypes=False)
    predicate("filter_ac_any", ("alt_count", ">", 4), sql=by_call + "(c.ac1 > 4 or (s.alt2 is not null and c.ac2 > 4))", genotypes=True)
    predicate("filter_ac_max", ("alt_count", "<=", 1), sql=by_call + "(c.ac1 <= 1 or (s.alt2 is not null and c.ac2 <= 1))", genotypes=True)
    predicate("filter_af_any", ("alt_frequency", ">", 0.6), sql=by_call + f"({_AF.format(1)} > 0.6 or {_AF.format(2)} > 0.6)", genotypes=True)
    predicate("filter_missing", ("uncalled",), sql=by_call + "c.npm > 0", genotypes=True)
    predicate("filter_complete", ("uncalled", False), sql=by_call + "c.npm = 0", genotypes=True)
    predicate("filter_unseen_alt", ("unseen_alt",), sql=by_call + "(c.ac1 = 0 or (s.alt2 is not null and c.ac2 = 0))", genotypes=True)
    predicate("filter_seen_alt", ("unseen_alt", False), sql=by_call + "(c.ac1 <> 0 or (s.alt2 is not null and c.ac2 <> 0))", genotypes=True)
    phase = derived.CTE + ", ph as (select site_id, coalesce(sum(case when phased then 1 else 0 end), 0) as y, coalesce(sum(case when phased then 0 else 1 end), 0) as n from fx_calls where a1 is not null and (a0 >= 0 or a1 >= 0) group by site_id) select s.site_id, s.contig, s.pos from fx_sites s left join ph on ph.site_id = s.site_id where "
    predicate("filter_phased", ("phased",), sql=phase + "coalesce(ph.n, 0) = 0", genotypes=True)
    predicate("filter_unphased", ("phased", False), sql=phase + "coalesce(ph.n, 0) > 0", genotypes=True)
    predicate("filter_mixed_phase", ("mixed_phasing",), sql=phase + "coalesce(ph.n, 0) > 0 and coalesce(ph.y, 0) > 0", genotypes=True)
    ploidy = derived.CTE + ", pl as (select site_id, max(case when a1 is null then 1 else 2 end) as hi, min(case when a1 is null then 1 else 2 end) as lo from fx_calls group by site_id) select s.site_id, s.contig, s.pos from fx_sites s join pl on pl.site_id = s.site_id where "
    predicate("filter_mixed_ploidy", ("mixed_ploidy",), sql=ploidy + "pl.hi > pl.lo", genotypes=True)
    predicate("filter_site_ploidy", ("site_ploidy", "==", 2), sql=ploidy + "pl.hi = 2", genotypes=True)
    predicate("filter_conjunction", ("quality", ">", 50), ("alt_alleles", "<=", 1), ("known",), ("alt_frequency", "<=", 0.3), sql=by_call + f"s.qual > 50 and s.alt2 is null and s.id is not null and {_AF.format(1)} <= 0.3", genotypes=True)

    big = lambda c: F.col(c).cast("bigint").alias(c.lower())
    at = lambda c, i: F.get(c, F.lit(i)).cast("bigint")
    add(
        "annotate_counts",
        lambda d: _site(annotate.annotate(d, ["AC", "AN", "NM", "NPM"], into=None), big("AN"), big("NM"), big("NPM"), at("AC", 0).alias("ac0"), at("AC", 1).alias("ac1"), at("AC", 2).alias("ac2")),
        _HC + " select s.site_id, s.contig, s.pos, c.nm + c.npm as an, c.nm, c.npm, c.ac0, c.ac1, case when s.alt2 is not null then c.ac2 end as ac2 from fx_sites s join c on c.site_id = s.site_id",
    )
    add(
        "annotate_docs_naming",
        lambda d: _site(annotate.annotate(d, ["AN", "NM"], naming="docs", into=None), big("AN"), big("NM")),
        _HC + " select s.site_id, s.contig, s.pos, c.nm as an, c.npm as nm from fx_sites s join c on c.site_id = s.site_id",
    )
    add(
        "annotate_af",
        lambda d: _site(annotate.annotate(d, ["AF", "MULTI_ALLELIC"], into=None), _r(F.get("AF", F.lit(0))).alias("af0"), _r(F.get("AF", F.lit(1))).alias("af1"), _r(F.get("AF", F.lit(2))).alias("af2"), F.col("MULTI_ALLELIC").alias("multi")),
        _HC + f" select s.site_id, s.contig, s.pos, round({_AF.format(0)}, 6) as af0, round({_AF.format(1)}, 6) as af1, case when s.alt2 is not null then round({_AF.format(2)}, 6) end as af2, s.alt2 is not null as multi from fx_sites s join c on c.site_id = s.site_id",
    )
    het = "case when g.rr + g.ra + g.aa > 0 then cast(g.ra as double) / (g.rr + g.ra + g.aa) else 0 end"
    p = "case when g.rr + g.ra + g.aa > 0 then cast(2 * g.rr + g.ra as double) / (2 * (g.rr + g.ra + g.aa)) else 0 end"
    add(
        "annotate_het_fpic",
        lambda d: _site(annotate.annotate(d, ["HET", "F_PIC"], into=None), _r(F.col("HET")).alias("het"), _r(F.col("F_PIC")).alias("f_pic")),
        derived.CTE + _G + f", y as (select site_id, pl, {het} as het, 2 * ({p}) * (1 - ({p})) as ex from g) select s.site_id, s.contig, s.pos, case when y.pl = 2 then round(y.het, 6) end as het, case when y.pl = 2 then round(case when y.ex > 0 then (y.ex - y.het) / y.ex else 0 end, 6) end as f_pic from fx_sites s join y on y.site_id = s.site_id",
    )
    strand = "cast(sum(case when p = {0} and a = {1} then 1 else 0 end) as bigint)"
    add(
        "annotate_strand_counts",
        lambda d: _site(annotate.annotate(d.where(F.size("alleles") == 2), ["AC_P"], into=None), *[F.coalesce(at("AC_P", 2 * j + k), F.lit(0)).cast("bigint").alias(f"p{j}{k}") for j in (0, 1) for k in (0, 1)]),
        derived.CTE + _H + f" select s.site_id, s.contig, s.pos, {strand.format(0, 0)} as p00, {strand.format(0, 1)} as p01, {strand.format(1, 0)} as p10, {strand.format(1, 1)} as p11 from fx_sites s join h on h.site_id = s.site_id where s.alt2 is null group by s.site_id, s.contig, s.pos",
    )
    add(
        "annotate_hwe",
        lambda d: _site(annotate.annotate(d, ["HWE_P"], into=None), _r(F.col("HWE_P"), 5).alias("hwe_p")),
        derived.CTE + _G + ", t as (select g.site_id as id, g.ra as het, g.rr as h1, g.aa as h2 from g join fx_sites s on s.site_id = g.site_id where s.alt2 is null and g.pl = 2)" + _HWE + " select s.site_id, s.contig, s.pos, round(coalesce(w.v, -1.0), 5) as hwe_p from fx_sites s left join w on w.id = s.site_id",
    )
    add(
        "allele_tails",
        lambda d: _site(
            d.withColumns({"k": G.count_of(G.flat(), 1), "n": F.size(G.flat()) - G.missing_alleles()}), _r(special.log_choose("n", "k")).alias("log_choose"),
            _r(special.beta_i("k", F.col("n") - F.col("k") + 1, F.lit(1 / 3))).alias("binomial_tail"), _r(special.gamma_p("k", F.col("n") / 4)).alias("poisson_tail"),
        ),
        _HC + ", w as (select c.site_id, sum(exp(lgamma(nm + 1) - lgamma(j + 1) - lgamma(nm - j + 1) + j * ln(1 / 3.0) + (nm - j) * ln(2 / 3.0))) as b from c, unnest(range(ac1, nm + 1)) as j(j) where ac1 > 0 group by c.site_id)"
        ", v as (select c.site_id, 1 - sum(exp(j * ln(nm / 4.0) - nm / 4.0 - lgamma(j + 1))) as p from c, unnest(range(0, ac1)) as j(j) where ac1 > 0 group by c.site_id)"
        " select s.site_id, s.contig, s.pos, round(lgamma(nm + 1) - case when ac1 < 2 then 0 else lgamma(ac1 + 1) end - case when nm - ac1 < 2 then 0 else lgamma(nm - ac1 + 1) end, 6) as log_choose, round(w.b, 6) as binomial_tail, round(v.p, 6) as poisson_tail"
        " from fx_sites s join c on c.site_id = s.site_id left join w on w.site_id = s.site_id left join v on v.site_id = s.site_id",
    )
    add(
        "annotate_fisher",
        lambda d: _site(annotate.annotate(d.where(F.size("alleles") == 2), ["FS_A"], into=None), _r(F.get("FS_A", F.lit(0)), 3).alias("fs_a")),
        derived.CTE + _H + f", t as (select h.site_id as id, {strand.format(0, 0)} as a, {strand.format(1, 0)} as b, {strand.format(0, 1)} as c, {strand.format(1, 1)} as d from h join fx_sites s on s.site_id = h.site_id where s.alt2 is null group by h.site_id)" + _FISHER + ", pl as (select site_id, max(case when a1 is null then 1 else 2 end) as hi from fx_calls group by site_id) select s.site_id, s.contig, s.pos, case when pl.hi = 2 then round(w.v, 3) end as fs_a from fx_sites s left join w on w.id = s.site_id join pl on pl.site_id = s.site_id where s.alt2 is null",
    )
    add("annotate_variant_class", lambda d: _site(d, annotate.variant_class(_alt(0), _alt(1)).alias("vt")), derived.CTE + f" select site_id, contig, pos, {_INDEL} as vt from fx_sites", False)
    add(
        "genotype_counts",
        lambda d: d.select("site_id", F.inline(G.genotype_table())).select("site_id", F.col("a0").cast("bigint").alias("a0"), F.col("a1").cast("bigint").alias("a1"), F.col("n").cast("bigint").alias("n")),
        derived.CTE + " select site_id, a0, a1, cast(count(*) as bigint) as n from fx_calls where a1 is not null group by site_id, a0, a1",
    )
    add(
        "genotype_flags",
        lambda d: _site(d, G.ploidy().cast("bigint").alias("ploidy"), G.absent_alleles().cast("bigint").alias("absent"), G.mixed_phasing().alias("mixed_phase"), (F.size("alleles") == 2).alias("biallelic"), F.forall("alleles", lambda x: F.length(x) == 1).alias("all_snv")),
        derived.CTE + ", f as (select site_id, cast(max(case when a1 is null then 1 else 2 end) as bigint) as ploidy, cast(7 * max(case when a1 is null then 1 else 2 end) - sum(case when a1 is null then 1 else 2 end) as bigint) as absent, coalesce(bool_or(case when a1 is not null and (a0 >= 0 or a1 >= 0) then phased end), false) and coalesce(bool_or(case when a1 is not null and (a0 >= 0 or a1 >= 0) then not phased end), false) as mixed_phase from fx_calls group by site_id) "
        "select s.site_id, s.contig, s.pos, f.ploidy, f.absent, f.mixed_phase, s.alt2 is null as biallelic, length(s.ref) = 1 and length(s.alt1) = 1 and coalesce(length(s.alt2) = 1, true) as all_snv from fx_sites s join f on f.site_id = s.site_id",
    )
    add(
        "sample_calls",
        lambda d: d.select("site_id", F.posexplode("gt").alias("i", "g")).select("site_id", F.col("i").cast("bigint").alias("sample_id"), F.get("g.a", F.lit(0)).cast("bigint").alias("a0"), F.get("g.a", F.lit(1)).cast("bigint").alias("a1")),
        derived.CTE + " select site_id, sample_id, a0, a1 from fx_calls",
    )
    add(
        "sample_subset",
        lambda d: _site(annotate.annotate(filters.keep_samples(d, [5, 1]), ["NM", "NPM"], into=None), big("NM"), big("NPM")),
        derived.CTE + _H + " select s.site_id, s.contig, s.pos, cast(sum(case when h.a >= 0 then 1 else 0 end) as bigint) as nm, cast(sum(case when h.a = -1 then 1 else 0 end) as bigint) as npm from fx_sites s join h on h.site_id = s.site_id where h.sample_id in (1, 5) group by s.site_id, s.contig, s.pos",
    )

    def long_groups(d: DataFrame, tags: list[str], columns: Callable[[str], list[Column]]) -> DataFrame:
        a = annotate.annotate_groups(d, derived.GROUPS, tags, into=None)
        rows = F.array(*[F.struct(F.lit(g).alias("grp"), *columns(g)) for g in derived.GROUPS])
        return a.select("site_id", F.inline(rows))

    add(
        "group_counts",
        lambda d: long_groups(d, ["NM", "NPM", "AN", "AC"], lambda g: [F.col(f"{g}_NM").cast("bigint").alias("nm"), F.col(f"{g}_NPM").cast("bigint").alias("npm"), F.col(f"{g}_AN").cast("bigint").alias("an"), at(f"{g}_AC", 0).alias("ac0"), at(f"{g}_AC", 1).alias("ac1")]),
        derived.CTE + _H + " select h.site_id, f.grp, cast(sum(case when a >= 0 then 1 else 0 end) as bigint) as nm, cast(sum(case when a = -1 then 1 else 0 end) as bigint) as npm, cast(count(*) as bigint) as an, cast(sum(case when a = 0 then 1 else 0 end) as bigint) as ac0, cast(sum(case when a = 1 then 1 else 0 end) as bigint) as ac1 from h join fx_groups f on f.sample_id = h.sample_id group by h.site_id, f.grp",
    )
    gg = derived.CTE + ", g as (select c.site_id, f.grp, cast(sum(case when a0 = 0 and a1 = 0 then 1 else 0 end) as bigint) rr, cast(sum(case when a0 = 1 and a1 = 1 then 1 else 0 end) as bigint) aa, cast(sum(case when (a0 = 0 and a1 = 1) or (a0 = 1 and a1 = 0) then 1 else 0 end) as bigint) ra, max(case when a1 is null then 1 else 2 end) pl from fx_calls c join fx_groups f on c.sample_id = f.sample_id group by c.site_id, f.grp)"
    add(
        "group_het_fpic",
        lambda d: long_groups(d, ["HET", "F_PIC"], lambda g: [_r(F.col(f"{g}_HET")).alias("het"), _r(F.col(f"{g}_F_PIC")).alias("f_pic")]),
        gg + f", y as (select site_id, grp, pl, {het} as het, 2 * ({p}) * (1 - ({p})) as ex from g) select site_id, grp, case when pl = 2 then round(het, 6) end as het, case when pl = 2 then round(case when ex > 0 then (ex - het) / ex else 0 end, 6) end as f_pic from y",
    )
    add(
        "group_hwe",
        lambda d: long_groups(d.where(F.size("alleles") == 2), ["HWE_P"], lambda g: [_r(F.col(f"{g}_HWE_P"), 5).alias("hwe_p")]),
        gg + ", t as (select site_id || g.grp as id, g.ra as het, g.rr as h1, g.aa as h2 from g where pl = 2)" + _HWE + " select g.site_id, g.grp, round(coalesce(w.v, -1.0), 5) as hwe_p from g join fx_sites s on s.site_id = g.site_id left join w on w.id = g.site_id || g.grp where s.alt2 is null",
    )
    add(
        "group_af",
        lambda d: long_groups(d, ["AF"], lambda g: [_r(F.get(f"{g}_AF", F.lit(1))).alias("af1")]),
        derived.CTE + _H + " select h.site_id, f.grp, round(case when sum(case when a >= 0 then 1 else 0 end) = 0 then 0 else cast(sum(case when a = 1 then 1 else 0 end) as double) / sum(case when a >= 0 then 1 else 0 end) end, 6) as af1 from h join fx_groups f on f.sample_id = h.sample_id group by h.site_id, f.grp",
    )
    add(
        "group_fstats",
        lambda d: annotate.f_statistics(d, derived.GROUPS, into=None).where("FIS is not null").select("site_id", *[_r(F.col(x)).alias(x.lower()) for x in annotate.FSTATS]),
        derived.CTE + ", g as (select c.site_id, f.grp, cast(sum(case when a0 = 0 and a1 = 0 then 1 else 0 end) as double) rr, cast(sum(case when a0 = 1 and a1 = 1 then 1 else 0 end) as double) aa, cast(sum(case when (a0 = 0 and a1 = 1) or (a0 = 1 and a1 = 0) then 1 else 0 end) as double) het from fx_calls c join fx_groups f on c.sample_id = f.sample_id join fx_sites s on s.site_id = c.site_id where s.alt2 is null group by c.site_id, f.grp), "
        "n as (select *, rr + aa + het as n from g where rr + aa + het > 0), "
        "x as (select site_id, sum(n) nn, sum(het) hh, sum(2 * ((2 * rr + het) / (2 * n)) * ((2 * aa + het) / (2 * n)) * n) es, sum(rr) rr, sum(aa) aa from n group by site_id), "
        "y as (select site_id, hh / nn hi, es / nn hs, 2 * ((2 * rr + hh) / (2 * nn)) * ((2 * aa + hh) / (2 * nn)) ht from x) "
        "select site_id, round(case when hs <> 0 then (hs - hi) / hs else 0 end, 6) fis, round(case when ht <> 0 then (ht - hs) / ht else 0 end, 6) fst, round(case when ht <> 0 then (ht - hi) / ht else 0 end, 6) fit from y",
    )
    n = lambda test: f"cast(sum(case when {test} then 1 else 0 end) as bigint)"
    add(
        "site_summary",
        samples.site_summary,
        _HC + f" select cast(count(*) as bigint) as n_records, {n('alt2 is null')} as n_biallelic, {n('alt2 is not null')} as n_multi_allele, {n('alt2 is not null and length(ref) = 1 and length(alt1) = 1')} as n_multi_allele_snp, {n('length(alt1) > length(ref)')} as n_ins, {n('length(alt1) < length(ref)')} as n_del, {n('c.ac1 + c.ac2 = 0')} as n_no_alts, {n('c.ac1 + c.ac2 = 1')} as n_singleton, {n('length(ref) = 1 and length(alt1) = 1')} as n_snp, cast(0 as bigint) as n_mnp, cast(0 as bigint) as n_other from fx_sites s join c on c.site_id = s.site_id",
    )
    add("alt_histogram", samples.alt_histogram, derived.CTE + " select cast(case when alt2 is null then 1 else 2 end as int) as n_alts, cast(count(*) as bigint) as n from fx_sites group by 1", False)
    conv = derived.CTE + _CLASS
    add("conversion_matrix", lambda d: samples.conversions(d), conv + " select sample_id, cast(ref as int) as ref, cast(code as int) as code, cast(count(*) as bigint) as n from v group by 1, 2, 3")
    add("indel_spectrum", samples.indel_spectrum, conv + " select sample_id, cast(case when size >= 0 then 2 * size else -2 * size - 1 end as int) as slot, cast(count(*) as bigint) as n from v where code in (7, 8) group by 1, 2")
    add("sample_singletons", samples.singletons, derived.CTE + _H + _SINGLE + " select sample_id, cast(count(*) as bigint) as n_singleton from sg group by 1")
    ts = "(ref = 0 and code = 2) or (ref = 2 and code = 0) or (ref = 1 and code = 3) or (ref = 3 and code = 1)"
    tstv = conv + _H + _SINGLE + f", q as (select sample_id, {n(ts)} as n_ts, {n(f'ref < 4 and code < 4 and ref <> code and not ({ts})')} as n_tv, {n('code = 7')} as n_ins, {n('code = 8')} as n_del from v group by 1) select q.sample_id, n_ts, n_tv, round(case when n_tv > 0 then cast(n_ts as double) / n_tv else 0 end, 6) as ts_tv, n_ins, n_del, coalesce(z.n, 0) as n_singleton from q left join (select sample_id, cast(count(*) as bigint) as n from sg group by 1) z on z.sample_id = q.sample_id"
    add(
        "sample_tstv",
        lambda d: samples.sample_summary(d).withColumn("ts_tv", _r(F.col("ts_tv"))),
        tstv,
    )
    kinds = "map<string,struct<n_ts:bigint,n_tv:bigint,ts_tv:double,n_ins:bigint,n_del:bigint,n_singleton:bigint>>"
    add(
        "stats_json_samples",
        lambda d: samples.to_json(d, [f"s{i}" for i in range(derived.N_SAMPLES)]).select(F.explode(F.from_json(F.get_json_object("value", "$.PSI"), kinds)).alias("name", "s")).select("name", "s.*").withColumn("ts_tv", _r(F.col("ts_tv"))),
        f"select 's' || cast(sample_id as varchar) as name, n_ts, n_tv, ts_tv, n_ins, n_del, n_singleton from ({tstv})",
    )
    add(
        "stats_json_sites",
        lambda d: samples.to_json(d, [f"s{i}" for i in range(derived.N_SAMPLES)]).select(F.from_json(F.get_json_object("value", "$.VI"), "n_samples bigint, n_records bigint, n_biallelic bigint, n_alts array<bigint>").alias("s")).select("s.n_samples", "s.n_records", "s.n_biallelic", F.get("s.n_alts", F.lit(2)).alias("two_alts")),
        derived.CTE + f" select cast({derived.N_SAMPLES} as bigint) as n_samples, cast(count(*) as bigint) as n_records, cast(count(*) filter (alt2 is null) as bigint) as n_biallelic, cast(count(*) filter (alt2 is not null) as bigint) as two_alts from fx_sites",
    )
    add(
        "block_digest",
        lambda d: integrity.block_digest(d, ["id", "pos"], 256, n_variants=100, n_bases=50_000).select("seq", "block_id", "column", "sha256"),
        derived.blocks_sql(100, 50_000) + _DIGESTS + " select seq, block_id, c as \"column\", digest as sha256 from l0",
        False,
    )
    add(
        "block_digest_sizes",
        lambda d: integrity.block_digest(d, ["id", "pos"], n_variants=100, n_bases=50_000).groupBy("column").agg(F.count(F.lit(1)).alias("n_blocks"), F.countDistinct("sha512").alias("n_digests"), F.max(F.length("sha512")).cast("bigint").alias("letters")),
        derived.blocks_sql(100, 50_000) + "select c as \"column\", cast(count(distinct block_id) as bigint) as n_blocks, cast(count(distinct block_id) as bigint) as n_digests, cast(128 as bigint) as letters from b, (values ('id'), ('pos')) t(c) group by c",
        False,
    )
    add(
        "column_sha256",
        lambda d: integrity.column_digests(d, ["id", "pos"], 256, fan=8, n_variants=100, n_bases=50_000),
        derived.blocks_sql(100, 50_000) + _DIGESTS + "".join(_UP.format(i=i, j=i + 1) for i in range(6))
        + " select c as \"column\", (select count(*) from l0 x where x.c = r.c) as n_blocks, digest as sha256 from ("
        + " union all ".join(f"select {i} as level, c, node, digest from l{i} where (select count(distinct node) from l{i}) = 1" for i in range(7)) + ") r qualify row_number() over (partition by c order by level) = 1",
        False,
    )
    gt = lambda c: f"case when {c}.a0 = -1 then '.' else cast({c}.a0 as varchar) end || case when {c}.a1 is null then '' else case when {c}.phased then '|' else '/' end || case when {c}.a1 = -1 then '.' else cast({c}.a1 as varchar) end end"

    def vcf_lines(d: DataFrame) -> DataFrame:
        from ..sources import sinks

        return sinks.vcf_lines(d.drop("info", "info_keys", "fmt").withColumn("format_keys", F.array(F.lit("GT")))).select("site_id", "value")

    add(
        "vcf_lines",
        vcf_lines,
        derived.CTE + f", t as (select c.site_id, string_agg({gt('c')}, chr(9) order by c.sample_id) as g from fx_calls c group by c.site_id) select s.site_id, s.contig || chr(9) || cast(s.pos as varchar) || chr(9) || coalesce(s.id, '.') || chr(9) || s.ref || chr(9) || s.alt1 || coalesce(',' || s.alt2, '') || chr(9) || coalesce(cast(cast(s.qual as bigint) as varchar), '.') || chr(9) || s.flt || chr(9) || '.' || chr(9) || 'GT' || chr(9) || t.g as value from fx_sites s join t on t.site_id = s.site_id",
    )
    add(
        "block_index",
        lambda d: blocks.block_index(d, 100, 50_000, chunk=1000).select("seq", "contig", "block_id", "n_variants", "min_pos", "max_pos"),
        derived.blocks_sql(100, 50_000) + "select seq, contig, block_id, cast(count(*) as bigint) as n_variants, min(pos) as min_pos, max(pos) as max_pos from b group by 1, 2, 3",
        False,
    )
    num = lambda c: f"cast(sum(('0x' || substr(md5(case when {c} is null then 'n:' else 'v:' || cast({c} as varchar) end), 1, 15))::bigint) as varchar)"
    add(
        "column_digest",
        lambda d: integrity.column_digest(d, ["contig", "pos", "id"]),
        derived.CTE + " " + " union all ".join(f"select '{c}' as \"column\", cast(count(*) as bigint) as n, {num(c)} as digest from fx_sites" for c in ("contig", "pos", "id")),
        False,
    )
    key = {"id": b"0123456789abcdef0123456789abcdef", "alleles": b"fedcba9876543210fedcba9876543210"}
    add(
        "encrypt_round_trip",
        lambda d: _site(integrity.decrypt(integrity.encrypt(d, key), key, {"id": "string", "alleles": "array<string>"}), "id", _alt(0).alias("ref"), _alt(1).alias("alt1"), _alt(2).alias("alt2")),
        derived.CTE + " select site_id, contig, pos, id, ref, alt1, alt2 from fx_sites",
        False,
    )
    add(
        "genotype_runs",
        lambda d: d.select("site_id", integrity.genotype_runs().alias("r")).select("site_id", F.size("r").cast("bigint").alias("n_runs"), F.aggregate("r", F.lit(0), lambda s, x: s + x["n"]).cast("bigint").alias("n_samples")),
        derived.CTE + ", z as (select site_id, sample_id, a0, a1, case when a1 is null then false else phased end as ph from fx_calls), y as (select *, lag(sample_id) over w as l, lag(a0) over w as l0, lag(a1) over w as l1, lag(ph) over w as lp from z window w as (partition by site_id order by sample_id)) select site_id, cast(sum(case when l is null or a0 <> l0 or a1 is distinct from l1 or ph <> lp then 1 else 0 end) as bigint) as n_runs, cast(count(*) as bigint) as n_samples from y group by site_id",
    )
    add(
        "text_helpers",
        lambda d: d.select("site_id", F.size(X.split_tokens(F.concat(F.coalesce("id", F.lit("")), F.lit(";;"), F.col("contig")), ";")).cast("bigint").alias("n"), F.get(X.split_last(F.concat(F.col("contig"), F.lit(":"), F.col("pos").cast("string")), ":"), F.lit(1)).alias("tail")),
        derived.CTE + " select site_id, cast(case when id is null then 1 else 2 end as bigint) as n, cast(pos as varchar) as tail from fx_sites",
        False,
    )
    return e


def builds() -> dict[str, tuple[Callable[[DataFrame], DataFrame], bool]]:
    """The queries over derived tables as functions of any variants, and whether they look at genotypes."""
    return {k: (v[2], v[3]) for k, v in _entries().items()}


#: Queries over genotypes that are registered a second time, over a store of runs.
OVER_RUNS = ["annotate_counts", "annotate_hwe", "annotate_fisher", "group_counts", "group_fstats", "vcf_lines", "sample_tstv"]


def _over_runs() -> dict[str, tuple[Query, str]]:
    own = _entries()
    return {f"runs_{k}": ((lambda spark, sf_dir, build=own[k][2]: build(filed.stored(spark, sf_dir, "runs"))), own[k][1]) for k in OVER_RUNS}


def queries() -> dict[str, Query]:
    out = {k: v[0] for k, v in _entries().items()} | {k: v[0] for k, v in filed.entries().items()} | {k: v[0] for k, v in _over_runs().items()}
    out["column_sha512"] = _q(lambda d: integrity.column_sha512(d, ["id", "pos"]), False)
    out["stats_json"] = _q(lambda d: samples.to_json(d, [f"s{i}" for i in range(derived.N_SAMPLES)]))
    return out


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _entries().items()} | {k: v[1] for k, v in filed.entries().items()} | {k: v[1] for k, v in _over_runs().items()}
