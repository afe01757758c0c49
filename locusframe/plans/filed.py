"""Queries that go through files: the derived variants, with INFO and FORMAT fields, are written and read back.

Each form of the files is written once for each session and input; the queries differ only in what they read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotypes as G
from ..operators import annotate, blocks
from ..sources import bcf, sinks, store, vcf
from ..sources.header import Header
from . import derived
from .query import VariantQuery

SAMPLES = [f"s{i}" for i in range(derived.N_SAMPLES)]
HEADER = [
    "##fileformat=VCFv4.2",
    *[f"##contig=<ID=chr{i},length=2000000000>" for i in range(1, 6)],
    '##FILTER=<ID=F,Description="Finished">',
    '##FILTER=<ID=O,Description="Open">',
    '##FILTER=<ID=P,Description="Pending">',
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">',
    '##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">',
    '##INFO=<ID=SC,Number=A,Type=Float,Description="Scores of ALT alleles">',
    '##INFO=<ID=TX,Number=1,Type=String,Description="Text">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth of the sample">',
    '##FORMAT=<ID=GQ,Number=1,Type=Float,Description="Quality of the sample">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(SAMPLES),
]


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived variants (first seven lines of each order as calls) with INFO and FORMAT fields made from their numbers."""
    d = derived.variants(spark, sf_dir)
    k = F.col("site_id")
    score = lambda i: ((k + i) % 9 / 4).cast("float")
    scores = F.when(F.size("alleles") > 2, F.array(score(1), score(2))).otherwise(F.array(score(1)))
    each = F.sequence(F.lit(0), F.lit(derived.N_SAMPLES - 1))
    info = F.struct((k % 97).cast("int").alias("DP"), (k % 3 == 0).alias("DB"), scores.alias("SC"), F.when(k % 10 != 0, F.concat(F.lit("t"), (k % 7).cast("string"))).alias("TX"))
    fmt = F.struct(
        F.transform(each, lambda i: ((k + i) % 50).cast("int")).alias("DP"),
        F.transform(each, lambda i: F.when((k + i) % 5 != 0, (k * 3 + i) % 9 / 2).cast("float")).alias("GQ"),
    )
    keys = F.filter(F.array(F.lit("DP"), F.when(k % 3 == 0, F.lit("DB")), F.lit("SC"), F.when(k % 10 != 0, F.lit("TX"))), lambda x: x.isNotNull())
    return d.select("site_id", "contig", "pos", "id", "alleles", F.col("qual").cast("float").alias("qual"), "filters", info.alias("info"), keys.alias("info_keys"), F.array(F.lit("GT"), F.lit("DP"), F.lit("GQ")).alias("format_keys"), fmt.alias("fmt"), "gt")


_WRITTEN: dict[tuple[str, str, str], str] = {}


def _base(spark: SparkSession) -> str:
    """The shared folder that the session names; in local mode, without one, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or tempfile.mkdtemp(prefix="locusframe-")).rstrip("/")


def written(spark: SparkSession, sf_dir: str, form: str) -> str:
    """Path of the derived variants as vcf, vcf.gz, vcf.bgz, bcf, store, runs (a store of runs) or locked (a store with two encrypted columns)."""
    key = (spark.sparkContext.applicationId, sf_dir, form)
    if key not in _WRITTEN:
        path = f"{_base(spark)}/derived-{uuid.uuid4().hex}.{form}"
        header, df = Header.parse(HEADER), full(spark, sf_dir)
        if form in ("store", "runs"):
            store.write_store(df, header, path, runs=form == "runs")
        elif form == "locked":
            store.write_store(df.drop("site_id"), header, path, keys=KEYS)
        else:
            VariantQuery(df.drop("site_id"), header).save(path, form, index=form in ("vcf.bgz", "bcf"))
        _WRITTEN[key] = path
    return _WRITTEN[key]


KEYS = {"id": bytes(range(32)), "info": bytes(range(32, 64))}


def opened(spark: SparkSession, sf_dir: str, form: str) -> VariantQuery:
    path = written(spark, sf_dir, form)
    if form == "locked":
        return VariantQuery(*store.read_store(spark, path, KEYS))
    return VariantQuery.open(spark, path)


def in_ranges(spark: SparkSession, path: str, kind: str, split: int = 1 << 16) -> DataFrame:
    """The variants of blocked files in ranges of few bytes, so that each file is cut many times."""
    read = bcf.read_bcf if kind == "bcf" else vcf.read_vcf
    return read(spark, path, split=split)[0]


def stored(spark: SparkSession, sf_dir: str, form: str = "store") -> DataFrame:
    """The derived variants from a store (form: runs, one of runs), site numbers included: what a user's queries run on."""
    return store.read_store(spark, written(spark, sf_dir, form))[0]


def _whole(d: DataFrame) -> DataFrame:
    """Every part of a record, flat."""
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    call = G.let(F.col("gt"), lambda g: F.array_join(F.transform(g, sinks._gt_text), ","))
    return d.select(
        "contig", "pos", "id", at("alleles", 0).alias("ref"), at("alleles", 1).alias("alt1"), at("alleles", 2).alias("alt2"), F.col("qual").cast("double").alias("qual"), at("filters", 0).alias("flt"),
        F.col("info.DP").cast("bigint").alias("dp"), F.coalesce("info.DB", F.lit(False)).alias("db"), at("info.SC", 0).cast("double").alias("sc1"), at("info.SC", 1).cast("double").alias("sc2"), F.col("info.TX").alias("tx"),
        F.array_join("info_keys", ",").alias("keys"), F.array_join(F.transform("fmt.DP", lambda x: x.cast("string")), ",").alias("dps"),
        F.array_join(F.transform("fmt.GQ", lambda x: F.coalesce((x * 2).cast("int").cast("string"), F.lit("."))), ",").alias("gqs"), call.alias("calls"),
    )


_GT = "case when c.a0 = -1 then '.' else cast(c.a0 as varchar) end || case when c.a1 is null then '' else case when c.phased then '|' else '/' end || case when c.a1 = -1 then '.' else cast(c.a1 as varchar) end end"
_FULL = (
    derived.CTE + f", k as (select c.site_id, string_agg({_GT}, ',' order by c.sample_id) as calls, string_agg(cast((c.site_id + c.sample_id) % 50 as varchar), ',' order by c.sample_id) as dps, "
    "string_agg(case when (c.site_id + c.sample_id) % 5 = 0 then '.' else cast((c.site_id * 3 + c.sample_id) % 9 as varchar) end, ',' order by c.sample_id) as gqs from fx_calls c group by c.site_id), "
    "w as (select s.site_id, s.contig, s.pos, s.id, s.ref, s.alt1, s.alt2, s.qual, s.flt, s.site_id % 97 as dp, s.site_id % 3 = 0 as db, ((s.site_id + 1) % 9) / 4.0::double as sc1, case when s.alt2 is not null then ((s.site_id + 2) % 9) / 4.0::double end as sc2, "
    "case when s.site_id % 10 <> 0 then 't' || cast(s.site_id % 7 as varchar) end as tx, 'DP' || case when s.site_id % 3 = 0 then ',DB' else '' end || ',SC' || case when s.site_id % 10 <> 0 then ',TX' else '' end as keys, k.dps, k.gqs, k.calls "
    "from fx_sites s join k on k.site_id = s.site_id) "
)
_WHOLE_SQL = _FULL + "select contig, pos, id, ref, alt1, alt2, qual, flt, dp, db, sc1, sc2, tx, keys, dps, gqs, calls from w"


def entries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    e: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}

    def add(name: str, form: str, build: Callable[[VariantQuery], DataFrame], sql: str) -> None:
        e[name] = (lambda spark, sf_dir: build(opened(spark, sf_dir, form))), sql

    for name, form in (("vcf_round_trip", "vcf"), ("vcf_gz_round_trip", "vcf.gz"), ("vcf_bgz_round_trip", "vcf.bgz"), ("bcf_round_trip", "bcf"), ("store_round_trip", "store"), ("runs_round_trip", "runs"), ("encrypted_store", "locked")):
        add(name, form, lambda q: _whole(q.df), _WHOLE_SQL)
    for name, form, kind in (("vcf_bgz_ranges", "vcf.bgz", "text"), ("bcf_ranges", "bcf", "bcf")):
        e[name] = (lambda spark, sf_dir, form=form, kind=kind: _whole(in_ranges(spark, written(spark, sf_dir, form), kind))), _WHOLE_SQL
    for name, form, overlap in (("vcf_bgz_region", "vcf.bgz", "start"), ("bcf_region", "bcf", "start"), ("vcf_bgz_region_span", "vcf.bgz", "span"), ("bcf_region_span", "bcf", "span")):
        first, last = ("pos", "pos + greatest(length(ref), length(alt1), coalesce(length(alt2), 1)) - 1") if overlap == "span" else ("pos", "pos")
        sql = _FULL + f"select contig, pos, ref, calls from w where (contig = 'chr3' and {first} <= 200000) or (contig = 'chr1' and {last} >= 661 and {first} <= 90000)"
        e[name] = (lambda spark, sf_dir, form=form, overlap=overlap: _whole(VariantQuery.open(spark, written(spark, sf_dir, form), regions=["chr3:1-200000", "chr1:661-90000"], overlap=overlap).df).select("contig", "pos", "ref", "calls")), sql
    add("store_region", "store", lambda q: _whole(q.regions("chr3:1-200000", "chr1:40-90").df).select("contig", "pos", "ref", "calls"), _FULL + "select contig, pos, ref, calls from w where (contig = 'chr3' and pos <= 200000) or (contig = 'chr1' and pos between 40 and 90)")
    add("store_fields", "store", lambda q: q.fields("CHROM;POS;INFO=DP,TX").df.select("contig", "pos", F.col("info.DP").cast("bigint").alias("dp"), F.col("info.TX").alias("tx"), F.array_join("info_keys", ",").alias("keys")), _FULL + "select contig, pos, dp, tx, 'DP' || case when tx is not null then ',TX' else '' end as keys from w")
    add("info_fields", "vcf", lambda q: q.fields("CHROM;POS;INFO").df.select("contig", "pos", F.col("info.DP").cast("bigint").alias("dp"), F.coalesce("info.DB", F.lit(False)).alias("db"), F.size("info.SC").cast("bigint").alias("n"), F.col("info.TX").alias("tx")), _FULL + "select contig, pos, dp, db, cast(case when alt2 is null then 1 else 2 end as bigint) as n, tx from w")
    add(
        "format_fields",
        "vcf",
        lambda q: q.fields("CHROM;POS;FORMAT=DP,GQ").df.select("contig", "pos", F.posexplode(F.arrays_zip(F.col("fmt.DP").alias("dp"), F.col("fmt.GQ").alias("gq"))).alias("i", "x")).select("contig", "pos", F.col("i").cast("bigint").alias("sample_id"), F.col("x.dp").cast("bigint").alias("dp"), F.col("x.gq").cast("double").alias("gq")),
        derived.CTE + "select s.contig, s.pos, c.sample_id, (c.site_id + c.sample_id) % 50 as dp, case when (c.site_id + c.sample_id) % 5 <> 0 then ((c.site_id * 3 + c.sample_id) % 9) / 2.0::double end as gq from fx_calls c join fx_sites s on s.site_id = c.site_id",
    )
    add("filter_info", "vcf", lambda q: q.where(("info_field", "DP", ">", 50), ("info_field", "TX", "==", "t3")).df.select("contig", "pos", F.col("info.DP").cast("bigint").alias("dp")), _FULL + "select contig, pos, dp from w where dp > 50 and tx = 't3'")
    add("filter_sets", "vcf.gz", lambda q: q.where(("filter_value", "O")).df.select("contig", "pos", F.array_join("filters", ";").alias("flt")), _FULL + "select contig, pos, flt from w where flt = 'O'")
    add("sites_only", "vcf", lambda q: _columns(q.sites()), _FULL + "select contig, pos, false as has_genotypes from w")
    add("sample_names", "vcf", lambda q: q.samples("s5", "s1").df.select("contig", "pos", F.array_join(F.transform("gt", sinks._gt_text), ",").alias("calls"), F.array_join("fmt.DP", ",").alias("dps")), _FULL + "select contig, pos, split_part(calls, ',', 6) || ',' || split_part(calls, ',', 2) as calls, split_part(dps, ',', 6) || ',' || split_part(dps, ',', 2) as dps from w")
    add("site_ploidy_read", "vcf", lambda q: q.df.select("contig", "pos", F.col("ploidy").cast("bigint").alias("ploidy")), derived.CTE + "select s.contig, s.pos, cast(max(case when c.a1 is null then 1 else 2 end) as bigint) as ploidy from fx_calls c join fx_sites s on s.site_id = c.site_id group by s.contig, s.pos")
    counts = derived.CTE + ", h as (select site_id, a0 as a from fx_calls union all select site_id, a1 from fx_calls where a1 is not null), c as (select site_id, cast(sum(case when a >= 0 then 1 else 0 end) as bigint) nm, cast(sum(case when a = 1 then 1 else 0 end) as bigint) ac1 from h group by site_id) "
    add("upsert_info", "vcf", lambda q: _upserted(q), counts + "select s.contig, s.pos, c.nm, c.ac1, c.nm % 4 as dp, cast(2 + case when s.site_id % 3 = 0 then 1 else 0 end + case when s.site_id % 10 <> 0 then 1 else 0 end + 2 as bigint) as n_keys from fx_sites s join c on c.site_id = s.site_id")
    add(
        "group_file",
        "store",
        lambda q: _by_group(q),
        derived.CTE + "select s.contig, s.pos, f.grp, cast(sum(case when c.a0 >= 0 then 1 else 0 end + case when c.a1 >= 0 then 1 else 0 end) as bigint) as nm from fx_calls c join fx_groups f on f.sample_id = c.sample_id join fx_sites s on s.site_id = c.site_id group by s.contig, s.pos, f.grp",
    )
    fields = [("INFO", "DP", "1", "Integer"), ("INFO", "DB", "0", "Flag"), ("INFO", "SC", "A", "Float"), ("INFO", "TX", "1", "String"), ("FORMAT", "GT", "1", "String"), ("FORMAT", "DP", "1", "Integer"), ("FORMAT", "GQ", "1", "Float")]
    fields += [("FILTER", x, "", "") for x in "FOP"] + [("contig", f"chr{i}", "2000000000", "") for i in range(1, 6)] + [("sample", x, "", "") for x in SAMPLES] + [("INFO", "AC", "R", "Integer"), ("INFO", "MULTI_ALLELIC", "0", "Flag")]
    counted = {("INFO", "DB"): "site_id % 3 = 0", ("INFO", "TX"): "site_id % 10 <> 0", ("INFO", "MULTI_ALLELIC"): "alt2 is not null"}
    counted |= {("FILTER", x): f"flt = '{x}'" for x in "FOP"} | {("contig", f"chr{i}"): f"contig = 'chr{i}'" for i in range(1, 6)}
    add("header_definitions", "vcf", lambda q: definitions(q.annotate(["AC", "MULTI_ALLELIC"])), derived.CTE + " union all ".join(f"select '{k}' as kind, '{n}' as name, '{x}' as number, '{t}' as type, cast(count(*) as bigint) as n from fx_sites where {counted.get((k, n), 'true')}" for k, n, x, t in fields))
    add("block_access", "store", lambda q: blocks.read_block(q.df, "chr2:1", 100, 50_000).select("contig", "pos", "id"), derived.blocks_sql(100, 50_000) + "select contig, pos, id from b where block_id = 'chr2:1'")
    add("block_rows", "store", lambda q: blocks.blocks(q.df, 40, 20_000).select("contig", "pos", "seq", "block_id"), derived.blocks_sql(40, 20_000) + "select contig, pos, seq, block_id from b")
    add("file_lines", "vcf", lambda q: q.df.sparkSession.read.text(_path(q)).groupBy(F.startswith("value", F.lit("#")).alias("head")).agg(F.count(F.lit(1)).alias("n")), derived.CTE + f"select false as head, cast(count(*) as bigint) as n from fx_sites union all select true, cast({len(HEADER)} as bigint)")
    return e


def _path(q: VariantQuery) -> str:
    return q.df.inputFiles()[0].rsplit("/", 1)[0]


def _columns(q: VariantQuery) -> DataFrame:
    return q.df.select("contig", "pos", F.lit(bool({"gt", "fmt", "format_keys"} & set(q.df.columns))).alias("has_genotypes"))


def _upserted(q: VariantQuery) -> DataFrame:
    """Annotations beside the fields of the file, and one of the file's own replaced."""
    d = annotate.annotate(q.df, ["NM", "AC"])
    d = annotate._upsert(d, {"DP": (F.col("info.NM") % 4).cast("int")}, "info")
    return d.select("contig", "pos", F.col("info.NM").cast("bigint").alias("nm"), F.get("info.AC", F.lit(1)).cast("bigint").alias("ac1"), F.col("info.DP").cast("bigint").alias("dp"), F.size("info_keys").cast("bigint").alias("n_keys"))


def _by_group(q: VariantQuery) -> DataFrame:
    spark = q.df.sparkSession
    key = (spark.sparkContext.applicationId, "", "groups")
    if key not in _WRITTEN:
        path = f"{_base(spark)}/groups-{uuid.uuid4().hex}"
        rows = [(i, "\t".join([SAMPLES[i], *[g for g, own in derived.GROUPS.items() if i in own]])) for i in range(derived.N_SAMPLES)]
        spark.createDataFrame(rows, "i int, value string").coalesce(1).select("value").write.text(path)
        _WRITTEN[key] = path
    a = q.annotate_groups(_WRITTEN[key], ["NM"], f_statistics=False).df
    return a.select("contig", "pos", F.inline(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(f"info.{g}_NM").cast("bigint").alias("nm")) for g in derived.GROUPS])))


def definitions(q: VariantQuery) -> DataFrame:
    """(kind, name, number, type) of all that a header declares, and n, how many records hold it. What records hold without a
    declaration has a row as well, its number and type null."""
    h, df = q.header, q.df
    rows = [("INFO", f.id, f.number, f.type) for f in h.info.values()] + [("FORMAT", f.id, f.number, f.type) for f in h.formats.values()]
    rows += [("FILTER", x, "", "") for x in h.filters] + [("contig", c, str(n), "") for c, n in h.contigs.items()] + [("sample", s, "", "") for s in h.samples]
    declared = df.sparkSession.createDataFrame(rows, "kind string, name string, number string, type string")
    item = lambda kind, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    one = F.array(F.struct(F.lit("contig").alias("kind"), F.col("contig").alias("name")))
    held = df.select(F.inline(F.concat(one, item("FILTER", "filters"), item("INFO", "info_keys"), item("FORMAT", "format_keys")))).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
    # records by how many samples they have: a row for each such number, one where a file is sound
    wide = df.groupBy(F.coalesce(F.size("gt"), F.lit(0)).alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()
    samples = df.sparkSession.createDataFrame([("sample", s, sum(r.n for r in wide if r.w > i)) for i, s in enumerate(h.samples)], "kind string, name string, n bigint")
    return declared.join(held.unionByName(samples), ["kind", "name"], "full").select("kind", "name", "number", "type", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
