import gzip
import struct
import warnings

import pytest
from pyspark.sql import functions as F

from locusframe.operators import annotate, filters, integrity, regions, slicing
from locusframe.plans import cli
from locusframe.plans.query import VariantQuery
from locusframe.sources import bcf, groups, sinks, store, vcf
from locusframe.sources.header import Field, Header

# Counts of genotypes and most INFO values follow a published example record of 36 samples.
GTS = ["0/0"] * 15 + ["0/1"] * 6 + ["1/1"] * 2 + ["./."] * 13
HEAD = [
    "##fileformat=VCFv4.2",
    '##FILTER=<ID=q10,Description="low">',
    '##FILTER=<ID=s50,Description="half">',
    '##INFO=<ID=AC,Number=A,Type=Integer,Description="counts">',
    '##INFO=<ID=AF,Number=A,Type=Float,Description="frequencies">',
    '##INFO=<ID=AN,Number=1,Type=Integer,Description="total">',
    '##INFO=<ID=MQ,Number=1,Type=Float,Description="mapping, quality">',
    '##INFO=<ID=DB,Number=0,Type=Flag,Description="known">',
    '##INFO=<ID=NOTE,Number=.,Type=String,Description="text">',
    '##INFO=<ID=END,Number=1,Type=Integer,Description="end">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="genotype">',
    '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="depths">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="depth">',
    '##FORMAT=<ID=GL,Number=G,Type=Float,Description="likelihoods">',
    '##FORMAT=<ID=FT,Number=1,Type=String,Description="filter">',
    "##contig=<ID=c1,length=5000>",
    "##contig=<ID=c2>",
]


def small(samples):
    return [*HEAD, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(samples)]


BODY = [
    "c1\t1\t.\tA\tT\t525.07\tPASS\tAC=10;AF=0.217;AN=46;MQ=31.05\tGT:AD:DP\t0/0:1,0:1\t1|1:0,2:.\t./.:0,0:0",
    "c1\t672\trs1\tA\tC,G\t.\tq10;s50\tDB;AF=0.1,.;NOTE=x,y\tGT:DP:FT\t0/1:3:PASS\t1|2:4:q10\t.|.:.:.",
    "c1\t673\trs22\tG\t.\t30\t.\t.\tGT\t0\t.\t0/1",
    "c1\t1500\t.\tACGT\t<DEL>\t1e-05\t.\tEND=1700\tGT:GL\t0/1/1:-0.5,-1,-2.25\t0/0/0:.\t./././.:-1e-10",
    "c2\t1501\t.\tA\tAT\t12\tPASS\tMQ=.\tDP\t3\t4\t.",
    "c2\t1600\tn\tC\tT\t99\tPASS\tDB\tGT\t0|0\t0|1\t1|1",
]


@pytest.fixture(scope="module")
def vcf_file(tmp_path_factory):
    p = tmp_path_factory.mktemp("vcf") / "a.vcf"
    p.write_text("\n".join([*small(["s1", "s2", "s3"]), *BODY]) + "\n")
    return str(p)


@pytest.fixture(scope="module")
def query(spark, vcf_file):
    return VariantQuery.open(spark, vcf_file)


def lines(q):
    return [r.value for r in sinks.vcf_lines(q.df).orderBy("contig", "pos").select("value").collect()]


def test_round_trip_is_byte_exact(query, vcf_file, spark, tmp_path):
    assert lines(query) == BODY
    out = str(tmp_path / "out")
    query.save(out, "vcf")
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == open(vcf_file).read()
    query.save(str(tmp_path / "z"), "vcf.gz", with_header=False)
    assert "".join(gzip.open(p, "rt").read() for p in sorted((tmp_path / "z").glob("part-*"))) == "\n".join(BODY) + "\n"
    query.save(str(tmp_path / "store"))
    again = VariantQuery.open(spark, str(tmp_path / "store"))
    assert lines(again) == BODY and again.header == query.header
    report = {r.column: r for r in store.storage_report(spark, str(tmp_path / "store")).collect()}
    assert report["pos"].n_values == len(BODY)


def test_typed_columns(query):
    rows = query.df.orderBy("contig", "pos").collect()
    assert rows[0].info.AC == [10] and rows[0].info.AN == 46 and rows[0].qual == pytest.approx(525.07, rel=1e-6)
    assert rows[1].info.DB is True and rows[1].info.AF[1] is None and rows[1].info.NOTE == ["x", "y"] and rows[1].qual is None
    assert rows[1].filters == ["q10", "s50"] and rows[2].filters is None and rows[2].alleles == ["G", "."]
    assert rows[4].gt is None and rows[4].fmt.DP == [3, 4, None] and rows[3].ploidy == 4
    assert [g.a for g in rows[1].gt] == [[0, 1], [1, 2], [-1, -1]] and [g.p for g in rows[1].gt] == [[False, False], [False, True], [False, True]]
    assert rows[0].fmt.AD == [[1, 0], [0, 2], [0, 0]] and rows[0].fmt.GL is None


def test_predicates(query):
    keep = lambda *p: [r.pos for r in query.where(*p).df.orderBy("contig", "pos").collect()]
    assert keep(("quality", ">", 30)) == [1, 1600] and keep(("known", False)) == [1, 1500, 1501]
    assert keep(("alt_alleles", ">", 1)) == [672] and keep(("name", "regex", "2$")) == [673]
    assert keep(("filter_value", "s50")) == [672] and keep(("info_field", "AN", ">", 40)) == [1]
    assert keep(("mixed_ploidy",)) == [673, 1500] and keep(("mixed_phasing",)) == [1, 672]
    assert keep(("uncalled",)) == [1, 672, 673, 1500] and keep(("variant_type", "SV")) == [1500]
    assert keep(("alt_frequency", ">", 0.4), ("quality", ">", 0.0)) == [1, 1600]
    with pytest.raises(ValueError):
        keep(("quality", "regex", 3))
    with pytest.raises(ValueError):
        keep(("nothing", 1))


def test_regions(query):
    keep = lambda *r, **k: [x.pos for x in query.regions(*r, **k).df.orderBy("contig", "pos").collect()]
    assert keep("c1") == [1, 672, 673, 1500] and keep("c1:672") == [672] and keep("c1:1500-672") == [672, 673, 1500]
    assert keep("c1:1-672", "c2:1.6e3") == [1, 672, 1600] and keep("c1 : 1e3 - 2e3") == [1500]
    assert keep("c1:1600", overlap="span") == [1500] and keep("c1:1600") == []
    for bad in ("c1:", "c1:a-b", "c9", "c1:1-2-3"):
        with pytest.raises(ValueError):
            keep(bad)
    assert regions.merge(regions.parse_regions(["c1:5-9", "c1:10-12", "c1:1-2", "c2", "c2:4"])) == [regions.Interval("c2"), regions.Interval("c1", 1, 2), regions.Interval("c1", 5, 12)]


def test_many_regions_equal_few(spark, query):
    many = [f"c1:{i * 3 + 1}-{i * 3 + 2}" for i in range(600)]
    for overlap in ("start", "span"):
        got = sorted(r.pos for r in query.regions(*many, overlap=overlap).df.collect())
        rows = regions.with_end(query.df, "e").where("contig = 'c1'").collect()
        want = sorted(r.pos for r in rows if any(a <= (r.e if overlap == "span" else r.pos) and r.pos <= a + 1 for a in range(1, 1801, 3)))
        assert got == want


def test_long_records_by_class(spark):
    import random

    r = random.Random(4)
    rows = [("c1", r.randrange(1, 3_000_000), r.choice([0, 1, 2, 3, 16383, 16384, 16385, 70_000, 2_500_000])) for _ in range(1500)]
    df = spark.createDataFrame([(c, p, ["A", "C"], (p + n,)) for c, p, n in rows], "contig string, pos bigint, alleles array<string>, info struct<END:bigint>")
    many = [regions.Interval("c1", a, a + 40) for a in range(5, 3_000_000, 21_001)]
    assert len(many) > regions.INLINE
    got = regions.filter_regions(df, many, overlap="span")
    want = [(p, p + n) for _, p, n in rows if any(p <= i.high and max(p + n, p) >= i.low for i in many)]
    assert sorted((x.pos, x.info.END) for x in got.collect()) == sorted(want) and len(want) < 1500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan  # no pass for the longest record


def test_slicing(query):
    assert lines(query.sites().fields("INFO=AC"))[0] == "c1\t1\t.\t.\t.\t.\tPASS\tAC=10"
    assert lines(query.sites().fields("info=AF,AC;ref", "Alt"))[0] == "c1\t1\t.\tA\tT\t.\tPASS\tAF=0.217;AC=10"
    assert lines(query.fields("chrom;pos;ref;alt;info;format=dp,ad"))[0] == "c1\t1\t.\tA\tT\t.\tPASS\tAC=10;AF=0.217;AN=46;MQ=31.05\tDP:AD\t1:1,0\t.:0,2\t0:0,0"
    assert lines(query.fields("FORMAT=GT"))[1].split("\t")[8:] == ["GT", "0/1", "1|2", ".|."]
    for bad in ("INFO=ac", "FORMAT=XX", "NOTHING", "REF=1"):
        with pytest.raises(ValueError):
            query.fields(bad)
    plan = query.fields("INFO=AC").df._jdf.queryExecution().optimizedPlan().toString()
    assert "NOTE" not in plan


def test_annotation_of_documented_counts(spark):
    text = [*small([f"s{i}" for i in range(36)]), "c1\t672\t.\tA\tT\t5\t.\tAC=9\tGT\t" + "\t".join(GTS)]
    header = Header.parse(text)
    q = VariantQuery(vcf.parse_lines(spark.createDataFrame([(text[-1],)], "value string"), header), header).annotate()
    r = q.df.first()
    assert r.info.AC == [36, 10] and r.info.AN == 72 and r.info.NM == 46 and r.info.NPM == 26
    assert r.info.AF == pytest.approx([0.782609, 0.217391], abs=1e-6) and r.info.AC_P == [21, 2, 15, 8]
    assert r.info.HWE_P == pytest.approx(0.2507196, abs=1e-6) and r.info.HET == pytest.approx(0.260870, abs=1e-6)
    assert r.info.F_PIC == pytest.approx(0.233333, abs=1e-6) and r.info.FS_A[0] == pytest.approx(11.509126, abs=1e-5)
    assert r.info_keys == ["AC", "AF", "AN", "NM", "NPM", "HWE_P", "AC_P", "FS_A", "F_PIC", "HET", "VT"] and r.info.VT == ["SNP"]
    one = q.df.select(F.struct("info.AC").alias("info"), "alleles", "gt")
    all_ = {"all": list(range(36))}
    g = annotate.annotate_groups(one, all_, ["AC", "HWE_P", "HET"], into=None).first()
    assert g.all_AC == [36, 10] and g.all_HWE_P == pytest.approx(0.2507196, abs=1e-6)
    f = annotate.f_statistics(one, {"a": list(range(18)), "b": list(range(18, 36))}, into=None).first()
    assert (1 - f.FIT) == pytest.approx((1 - f.FIS) * (1 - f.FST))


def test_groups(spark, query, tmp_path):
    p = tmp_path / "g.tsv"
    p.write_text("s1\tA\tB\ns3\tA\nnobody\tC\n")
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        got = groups.members(groups.read_groups(spark, str(p)), query.header)
    assert got == {"A": [0, 2], "B": [0]} and any("nobody" in str(x.message) for x in w)
    r = query.annotate_groups(got, ["AC", "NM"]).df.orderBy("contig", "pos").collect()
    assert r[0].info.A_AC == [2, 0] and r[0].info.B_NM == 2 and "FST" in r[5].info_keys
    p.write_text("s1\n")
    with pytest.raises(ValueError):
        groups.read_groups(spark, str(p))


def test_header_errors():
    with pytest.raises(ValueError, match="twice"):
        Header.parse([*HEAD, HEAD[-1], "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"])
    with pytest.raises(ValueError, match="twice"):
        Header.parse(small(["a", "a"]))
    with pytest.raises(ValueError):
        Header.parse(HEAD)
    with pytest.raises(ValueError):
        Header.parse(['##FORMAT=<ID=X,Number=0,Type=Flag,Description="">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"])
    h = Header.parse(small(["a"]))
    assert h.info["MQ"] == Field("MQ", "1", "Float", "mapping, quality") and h.contigs["c2"] == 2**31 - 1
    assert Header.from_json(h.to_json()) == h


def test_position_check(spark):
    h = Header.parse(small(["a"]))
    bad = spark.createDataFrame([("c1\t5001\t.\tA\tT\t.\t.\t.",)], "value string")
    with pytest.raises(Exception, match="beyond its contig"):
        vcf.parse_lines(bad, h).collect()
    assert vcf.parse_lines(bad, h, check_positions=False).count() == 1


def test_encryption(spark, query):
    keys = integrity.new_keychain(["id", "alleles", "info_keys"])
    assert integrity.keychain_from_json(integrity.keychain_to_json(keys)) == keys == integrity.merge_keychains(keys, dict(keys))
    with pytest.raises(ValueError):
        integrity.merge_keychains(keys, integrity.new_keychain(["id"]))
    types = {"id": "string", "alleles": "array<string>", "info_keys": "array<string>"}
    src = query.df.select("pos", *types)
    hidden = integrity.encrypt(src, keys)
    back = integrity.decrypt(hidden, keys, types)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, src.collect()), key=repr)
    others = integrity.new_keychain(list(types))
    wrong = integrity.decrypt(hidden, others, types, on_error="null").collect()
    assert all(r.id is None and r.alleles is None for r in wrong)
    with pytest.raises(Exception, match="AES"):
        integrity.decrypt(hidden, others, types).collect()
    moved = hidden.withColumn("pos", hidden["pos"] + 1)  # a ciphertext in another row
    assert all(r.alleles is None for r in integrity.decrypt(moved, keys, types, "null").collect())
    same = {c: keys["id"] for c in ("id", "alleles")}
    swapped = integrity.encrypt(src, same).selectExpr("pos", "alleles as id", "id as alleles", "info_keys")
    assert all(r.id is None for r in integrity.decrypt(swapped, same, types, "null").collect())
    with pytest.raises(ValueError, match="on_error"):
        integrity.decrypt(hidden, keys, types, "ignore")


def test_runs_and_subset(query):
    d = query.df.where("gt is not null")
    r = d.withColumn("r", integrity.genotype_runs()).withColumn("back", integrity.expand_runs("r"))
    assert all(x.back == x.gt for x in r.collect())
    s = query.samples("s3", "s1")
    assert lines(s)[0].endswith("GT:AD:DP\t./.:0,0:0\t0/0:1,0:1")
    with pytest.raises(ValueError):
        query.samples("zz")


def test_digests_ignore_order_and_partitions(query):
    a = integrity.column_digest(query.df, ["pos", "id"]).collect()
    assert a == integrity.column_digest(query.df.repartition(7).orderBy(F.desc("pos")), ["pos", "id"]).collect()
    b = integrity.block_digest(query.df, ["id"], n_variants=2).orderBy("block_id").collect()
    assert b == integrity.block_digest(query.df.repartition(5), ["id"], n_variants=2).orderBy("block_id").collect() and len(b) == 3


def test_command_line(spark, vcf_file, tmp_path, capsys):
    out = str(tmp_path / "s")
    assert cli.main(["import", "-i", vcf_file, "-o", out], spark) == 0
    capsys.readouterr()
    cli.main(["view", "-i", out, "-G", "-H", "-r", "c1:1-672", "--min-quality", "10"], spark)
    assert capsys.readouterr().out == "\t".join(BODY[0].split("\t")[:8]) + "\n"
    cli.main(["view", "-i", out, "-H", "-X", "-f", "INFO=AC", "--known", "-r", "c2"], spark)
    assert "AC=3,3" in capsys.readouterr().out
    cli.main(["stats", "-i", out], spark)
    assert '"PSI"' in capsys.readouterr().out
    locked, keys = str(tmp_path / "locked"), str(tmp_path / "keys.json")
    assert cli.main(["import", "-i", vcf_file, "-o", locked, "-e", "id,info", "-k", keys], spark) == 0
    for form in ("bcf", "vcf.bgz"):
        written = str(tmp_path / f"w.{form}")
        cli.main(["view", "-i", locked, "-k", keys, "-O", form, "-o", written, "--write-index"], spark)
        capsys.readouterr()
        cli.main(["view", "-i", written, "-H", "-r", "c1:1-672"], spark)
        assert capsys.readouterr().out == "".join(x + "\n" for x in BODY if x.startswith("c1\t") and int(x.split("\t")[1]) <= 672)
        cli.main(["view", "-i", written, "-H", "-G", "--info", "AN>=1", "--ploidy", "=2"], spark)
        assert all("AN=" in x for x in capsys.readouterr().out.splitlines())
    with pytest.raises(FileExistsError):
        cli.main(["import", "-i", vcf_file, "-o", str(tmp_path / "again"), "-e", "id", "-k", keys], spark)
    with pytest.raises(ValueError, match="comparison"):
        cli.main(["view", "-i", out, "--info", "AN"], spark)


def bcf_bytes():
    """A BCF file with two records, written out by hand after the format's specification."""
    text = ("\n".join(small(["s1", "s2"])) + "\n").encode() + b"\0"

    def typed(kind, values):
        letter = {1: "b", 2: "h", 5: "f"}.get(kind)
        body = values if kind == 7 else b"".join(v if isinstance(v, bytes) else struct.pack("<" + letter, v) for v in values)
        return bytes([min(len(values), 15) << 4 | kind]) + (bytes([0x11, len(values)]) if len(values) >= 15 else b"") + body

    # numbers: PASS 0, q10 1, s50 2, AC 3, AF 4, AN 5, MQ 6, DB 7, NOTE 8, END 9, GT 10, AD 11, DP 12
    def record(chrom, pos, qual, name, alleles, flt, info, fmt):
        shared = struct.pack("<iii", chrom, pos, 1) + qual + struct.pack("<II", len(info) | len(alleles) << 16, 2 | len(fmt) << 24)
        shared += typed(7, name) + b"".join(typed(7, a) for a in alleles) + typed(1, flt) + b"".join(typed(1, [k]) + v for k, v in info)
        own = b"".join(typed(1, [k]) + bytes([n << 4 | kind]) + data for k, kind, n, data in fmt)
        return struct.pack("<II", len(shared), len(own)) + shared + own

    a = record(0, 671, struct.pack("<f", 525.07), b"rs1", [b"A", b"T", b"G" * 20], [1, 2], [(3, typed(2, [300, -32768])), (7, b"\0"), (6, typed(5, [31.05]))], [(10, 1, 2, bytes([2, 5, 0, 129])), (11, 1, 3, bytes([1, 0, 128, 7, 129, 129]))])
    b = record(1, 0, struct.pack("<I", 0x7F800001), b"", [b"C"], [], [], [])
    return b"BCF\x02\x02" + struct.pack("<I", len(text)) + text + a + b


def test_bcf(spark, tmp_path):
    raw = bcf_bytes()
    want = ["c1\t672\trs1\tA\tT,GGGGGGGGGGGGGGGGGGGG\t525.07\tq10;s50\tAC=300,.;DB;MQ=31.05\tGT:AD\t0|1:1,0,.\t.:7", "c2\t1\t.\tC\t.\t.\t.\t."]
    assert list(bcf.lines(raw)) == want
    blocked = gzip.compress(raw[:200]) + gzip.compress(raw[200:])
    assert list(bcf.lines(blocked)) == want
    (tmp_path / "a.bcf").write_bytes(blocked)
    q = VariantQuery.open(spark, str(tmp_path / "a.bcf"))
    assert q.df.count() == 2 and q.header.samples == ["s1", "s2"]


def test_predicate_order_is_by_cost(spark):
    f = filters.Filters().add("alt_count", ">", 1).add("quality", ">", 3)
    assert sorted(c for c, _ in f.parts) == [0, 5] and slicing.Slice.sites().genotypes is False
    f.column()
