"""Files: blocked gzip, BCF, encrypted stores, plans that read little."""

import gzip

import time
import warnings
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from locusframe.operators import annotate, integrity, regions
from locusframe.plans import catalog, filed
from locusframe.plans.query import VariantQuery
from locusframe.sources import bcf, blocked, store, vcf
from locusframe.sources.header import Header

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
LINES = [
    "##fileformat=VCFv4.2", "##contig=<ID=chr1,length=1000>", "##contig=<ID=chr2>", '##FILTER=<ID=q10,Description="x">', '##FILTER=<ID=s50,Description="x">',
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="">', '##INFO=<ID=AF,Number=A,Type=Float,Description="">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="">', '##INFO=<ID=END,Number=1,Type=Integer,Description="">',
    '##INFO=<ID=TX,Number=.,Type=String,Description="">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="">', '##FORMAT=<ID=GL,Number=G,Type=Float,Description="">',
    '##FORMAT=<ID=NT,Number=1,Type=String,Description="">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc",
]
BODY = [
    "chr1\t1\t.\tA\tT\t.\t.\t.\tGT\t0/1\t1|1\t.",
    "chr1\t5\trs1\tAC\tA,ACC\t29.5\tPASS\tDP=300;AF=0.1,.;DB\tGT:AD:GL:NT\t0/2:1,2,3:-1.5,0,.:x\t./.:.:.:.\t1|0/2:70000,.,1:1,2,3,4:long text",
    "chr1\t9\t.\tG\t<DEL>\t1e+06\tq10;s50\tEND=200;TX=a,b\tGT:NT\t0:y\t1:.\t.:zz",
    "chr2\t3\t.\tN\t.\t0.0001\tPASS\tDP=-40000\tAD\t1\t2\t3",
]


def test_blocks_are_gzip():
    raw = bytes(range(256)) * 3000 + zlib.compress(b"x" * 10) * 9000
    made = b"".join(blocked.blocks([raw[:100], raw[100:]])) + blocked.END
    assert gzip.decompress(made) == raw and b"".join(bcf.inflate(made)) == raw
    assert b"".join(bcf.inflate(gzip.compress(raw) + gzip.compress(b"more"))) == raw + b"more" and b"".join(bcf.inflate(b"plain")) == b"plain"


def test_inflating_takes_linear_time():
    raw = bytes(1 << 16) * 16
    one = b"".join(blocked.blocks([raw]))

    def took(n):
        began = time.time()
        assert sum(map(len, bcf.inflate(one * n))) == n * len(raw)
        return time.time() - began

    took(5)
    assert took(160) < 20 * took(20) + 1


def test_bcf_of_every_kind_of_value(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("\n".join([*LINES, *BODY]) + "\n")
    q = VariantQuery.open(spark, str(tmp_path / "a.vcf"))
    q.save(str(tmp_path / "b.bcf"), "bcf")
    assert all(p.name.startswith("part-") for p in (tmp_path / "b.bcf").iterdir())
    again = VariantQuery.open(spark, str(tmp_path / "b.bcf"))
    assert again.header.samples == ["a", "b", "c"]
    again.save(str(tmp_path / "c.vcf"), "vcf.bgz")
    parts = sorted((tmp_path / "c.vcf").iterdir())
    text = b"".join(gzip.decompress(p.read_bytes()) for p in parts).decode()
    assert gzip.decompress(b"".join(p.read_bytes() for p in parts)).decode() == text
    q.save(str(tmp_path / "d"), "vcf")
    plain = "".join(p.read_text() for p in sorted((tmp_path / "d").glob("part-*")))
    assert text == plain
    rows = [x for x in text.splitlines() if not x.startswith("#")]
    assert [x.split("\t")[:8] for x in rows] == [x.split("\t")[:8] for x in BODY] and rows[0] == BODY[0] and rows[2] == BODY[2]
    with pytest.raises(ValueError, match="exists"):
        q.save(str(tmp_path / "b.bcf"), "bcf")


def test_dictionary_numbers():
    names, contigs = blocked.dictionaries(["##contig=<ID=c2,length=5,IDX=4>", "##contig=<ID=c3>", '##INFO=<ID=A,Number=1,Type=Integer,Description="",IDX=7>', "##FORMAT=<ID=A,Number=1>", "##FILTER=<ID=f>", "##FILTER=<ID=PASS>"])
    assert names == {0: "PASS", 7: "A", 8: "f"} and contigs == {4: "c2", 5: "c3"}


def test_encrypted_store(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("\n".join([*LINES, *BODY]) + "\n")
    q = VariantQuery.open(spark, str(tmp_path / "a.vcf"))
    keys = integrity.keychain_from_json(integrity.keychain_to_json(integrity.new_keychain(["info", "id"])))
    q.save(str(tmp_path / "s"), "store", command="x", keys=keys)
    locked = VariantQuery.open(spark, str(tmp_path / "s"))
    assert dict(locked.df.dtypes)["info"] == "binary" and any("settings=" in x and '"version"' in x for x in locked.header.lines)
    opened = VariantQuery.open(spark, str(tmp_path / "s"), keys)
    assert sorted(map(str, opened.df.select("pos", "id", "info").collect())) == sorted(map(str, q.df.select("pos", "id", "info").collect()))
    some = {"id": bytes(32), "info": keys["info"]}
    with pytest.raises(Exception, match="AES"):
        VariantQuery.open(spark, str(tmp_path / "s"), some).df.collect()
    wrong = store.read_store(spark, str(tmp_path / "s"), some, on_error="null")[0]
    assert {r.id for r in wrong.collect()} == {None} and wrong.where("info.DP = 300").count() == 1
    for df in (opened.df, integrity.encrypt(q.df, keys)):
        df.collect()
        plan = df._jdf.queryExecution().toString()
        for k in keys.values():
            assert k.hex() not in plan.lower() and str(bytearray(k)) not in plan and " ".join(f"{x:02X}" for x in k[:6]) not in plan
    with pytest.raises(ValueError, match="encrypted"):
        store.write_store(q.df, q.header, str(tmp_path / "t"), keys={"pos": bytes(32)})


@needs_data
def test_region_reads_one_contig_and_prunes_row_groups(spark):
    df = regions.filter_regions(filed.stored(spark, DATA), ["chr3:1-200"])
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(contig" in plan and "GreaterThanOrEqual(pos,1), LessThanOrEqual(pos,200)" in plan
    annotated = annotate.annotate(df, ["NM", "AC"], into=None).select("contig", "pos", "NM", "AC")
    plan = annotated._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "info" not in plan.split("ReadSchema")[1].split("\n")[0]


@needs_data
def test_queries_give_the_same_over_the_store(spark):
    for name in ("annotate_counts", "annotate_hwe", "group_fstats", "filter_af_any"):
        build, _ = catalog.builds()[name]
        mine, theirs = build(filed.stored(spark, DATA)), catalog.queries()[name](spark, DATA)
        assert sorted(map(str, mine.collect())) == sorted(map(str, theirs.collect())), name


def test_plans_of_many_samples(spark):
    n = 50_000
    df = spark.range(3).select(F.lit("chr1").alias("contig"), F.col("id").alias("pos"), F.array(F.lit("A"), F.lit("T")).alias("alleles"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.array((i % 2).cast("int"), F.lit(0)).alias("a"), F.array(F.lit(False), F.lit(False)).alias("p"))).alias("gt"))
    began = time.time()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        out = annotate.annotate_groups(df, {"x": list(range(0, n, 2)), "y": list(range(1, n, 2))}, ["NM", "AC", "AF"], into=None).select("pos", "x_AC", "y_AC").collect()
    assert {tuple(r.x_AC) + tuple(r.y_AC) for r in out} == {(n, 0, n // 2, n // 2)} and time.time() - began < 30


def test_runs_of_many(spark):
    df = spark.createDataFrame([([([0, 0], [False, False])] * 3 + [([0, None], [False, True]), ([0, None], [False, True])],), ([],), (None,)], "gt array<struct<a:array<int>,p:array<boolean>>>")
    runs = [r.r for r in df.select(integrity.genotype_runs().alias("r")).collect()]
    assert [x.n for x in runs[0]] == [3, 2] and [list(x.a) for x in runs[0]] == [[0, 0], [0, None]] and runs[1:] == [[], []]
    began = time.time()
    long = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(39_999)), lambda i: F.struct(F.array((i % 2).cast("int")).alias("a"), F.array(F.lit(False)).alias("p"))).alias("gt"))
    assert long.select(F.size(integrity.genotype_runs())).first()[0] == 40_000 and time.time() - began < 10


def test_digests_do_not_overflow(spark):
    df = spark.range(1000).select(F.lit("chr1").alias("contig"), (F.col("id") + 1).alias("pos"), F.array(F.lit("A")).alias("alleles"), "id")
    (d,) = integrity.column_digest(df.withColumn("x", F.lit("same")), ["x"]).collect()
    assert int(d.digest) % 1000 == 0 and int(d.digest) > 1000 * 2**50
    a = {r.column: r.sha512 for r in integrity.column_sha512(df, ["id", "pos"], n_variants=100).collect()}
    b = {r.column: r.sha512 for r in integrity.column_sha512(df.repartition(7).orderBy(F.desc("pos")), ["id", "pos"], n_variants=100).collect()}
    assert a == b and len(a["id"]) == 128 and a["id"] != a["pos"]


def test_header_is_read_from_the_first_blocks():
    text = "\n".join(LINES)
    raw = b"BCF\x02\x02" + (len(text) + 1).to_bytes(4, "little") + text.encode() + b"\0" + bytes(1 << 20)
    read = []

    def pieces():
        for p in bcf.inflate(b"".join(blocked.blocks([raw]))):
            read.append(len(p))
            yield p

    assert Header.parse(bcf.header_text(bcf.Stream(pieces())).split("\n")).samples == ["a", "b", "c"] and len(read) == 1



def test_header_begins_with_the_first_file_by_name(spark, tmp_path):
    folder = tmp_path / "a b[1].vcf"
    folder.mkdir()
    (folder / "part-00000").write_text("")
    (folder / "part-00001").write_text("\n".join(LINES[:4]) + "\n")
    (folder / "part-00002").write_text("\n".join([*LINES[4:], BODY[0]]) + "\n")
    (folder / "part-00003").write_text("\n".join(BODY[1:] * 400) + "\n")
    df, header = vcf.read_vcf(spark, str(tmp_path / "a b?1?.vcf"))
    assert header.text() == LINES and df.count() == 1 + 3 * 400
    many = [f"##contig=<ID=c{i}>" for i in range(700)]
    (tmp_path / "many.vcf").write_text("\n".join([LINES[0], *many, LINES[-1]]) + "\n")
    assert vcf.read_header(spark, str(tmp_path / "many.vcf")).text() == [LINES[0], *many, LINES[-1]]
    (tmp_path / "none.vcf").write_text("\n".join(BODY) + "\n")
    with pytest.raises(ValueError, match="no column line"):
        vcf.read_vcf(spark, str(tmp_path / "none.vcf"))


def test_bcf_makes_each_line_once(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("\n".join([*LINES, *[f"chr{i % 2 + 1}\t{i * 7 % 1000 + 1}\t.\tA\tT\t.\t.\t.\tGT\t0/1\t1|1\t." for i in range(999)]]) + "\n")
    q = VariantQuery.open(spark, str(tmp_path / "a.vcf"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def named(pos):
        seen.add(1)
        return f"rs{pos}"

    VariantQuery(q.df.withColumn("id", named("pos")), q.header).save(str(tmp_path / "b.bcf"), "bcf")
    assert seen.value == 999
    parts = sorted((tmp_path / "b.bcf").glob("part-*"))
    rows = [x.split("\t")[:3] for p in parts for x in bcf.lines(p.read_bytes())]
    assert len(rows) == 999 and rows == sorted(rows, key=lambda r: (r[0], int(r[1]))) and {f"rs{r[1]}" == r[2] for r in rows} == {True}


@pytest.fixture(scope="module")
def in_many_files(spark):
    """The derived variants written in many files of which the first is not the largest."""
    own = pytest.MonkeyPatch()
    own.setattr(filed, "_WRITTEN", {})
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 400)
    try:
        for form in ("vcf", "vcf.gz"):
            sizes = [p.stat().st_size for p in sorted(Path(filed.written(spark, DATA, form)).glob("part-*"))]
            assert len(sizes) > 2 and sizes[0] < max(sizes)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    yield
    own.undo()


@needs_data
@pytest.mark.parametrize("name", ["file_lines", "filter_info", "filter_sets", "format_fields", "header_definitions", "info_fields", "sample_names", "sites_only", "site_ploidy_read", "upsert_info", "vcf_gz_round_trip", "vcf_round_trip"])
def test_queries_over_many_files(spark, in_many_files, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    theirs = con.execute(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert mine and mine == sorted(theirs, key=repr)
