"""Ranges of BGZF files at every cut, and regions by index."""

import gzip
import io
import random
import struct
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from locusframe.operators import regions
from locusframe.plans.query import VariantQuery
from locusframe.sources import bcf, bgzf, blocked, csi
from locusframe.sources.header import Header

HEAD = [
    "##fileformat=VCFv4.2", "##contig=<ID=chr1,length=600000000>", "##contig=<ID=chr2,length=100000>", "##contig=<ID=none,length=5>", '##FILTER=<ID=q,Description="x">',
    '##INFO=<ID=END,Number=1,Type=Integer,Description="">', '##INFO=<ID=TX,Number=1,Type=String,Description="">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb",
]


def body(n=400, seed=1, far=0.1):
    r = random.Random(seed)
    out = []
    for contig, most in (("chr1", 590_000_000), ("chr2", 90_000)):
        for pos in sorted(r.randrange(1, most) for _ in range(n // 2)):
            end = f"END={min(pos + r.choice([10, 5000, 2_000_000]), most)}" if r.random() < far else "."
            ref, alt = r.choice(["A", "ACGT" * r.randrange(1, 9)]), r.choice(["C", "G,ACGTACGT" * 1, "<DEL>"])
            out.append(f"{contig}\t{pos}\trs{r.randrange(10**r.randrange(1, 9))}\t{ref}\t{alt}\t.\tq\t{end}{';TX=' + 'x' * r.randrange(300) if r.random() < 0.05 and end != '.' else ''}\tGT\t0/1\t{r.choice(['.', '1|1'])}")
    return out


def write(path: Path, lines, kind="text", size=700):
    """A file of blocks of ``size`` bytes, with its index."""
    if kind == "bcf":
        h = Header.parse(HEAD)
        numbered = blocked.dictionaries(h.text())[1]
        pieces, contigs = blocked.bcf_records(h)(iter(lines)), [numbered[i] for i in range(len(numbered))]
    else:
        pieces, contigs = blocked.text_lines(iter([*HEAD, *lines])), None
    with path.open("wb") as out:
        index = blocked.write_blocked(out, pieces, 6, contigs, size)
    Path(f"{path}.csi").write_bytes(b"".join(blocked.blocks([index])) + blocked.END)
    return index


def ranges(path, split, kind="text", **options):
    import json

    return bgzf.Reader({"kind": kind, "files": json.dumps([str(path)]), "split": str(split), **options})


def read(path, split, kind="text", **options):
    own = ranges(path, split, kind, **options)
    parts = own.partitions()
    return [x for p in parts for b in own.read(p) for x in b.column(0).to_pylist()], len(parts)


def test_lines_are_read_once_at_every_cut(tmp_path):
    lines = body(60)
    for size in (37, 61, 150, 65280):
        write(tmp_path / "a.vcf.gz", lines, size=size)
        whole = gzip.decompress((tmp_path / "a.vcf.gz").read_bytes()).decode().split("\n")[:-1]
        assert whole == [*HEAD, *lines]
        n = (tmp_path / "a.vcf.gz").stat().st_size
        for split in [*range(1, 120, 7), 500, 3000, n - 1, n, n + 1, 10 * n]:
            got, parts = read(tmp_path / "a.vcf.gz", split)
            assert got == whole and (3 * split >= 2 * n or parts > 1), (size, split)


@pytest.mark.parametrize("text", ["", "\n", "a", "a\nb", "a\n\n\nb\n", "x" * 5000, "x" * 5000 + "\n" + "y" * 5000, "ab\n" * 999, "\n" * 300])
def test_odd_texts(tmp_path, text):
    raw = text.encode()
    for size in (1, 3, 64):
        if len(raw) / size > 2000:
            continue
        (tmp_path / "a.gz").write_bytes(b"".join(blocked.blocks([raw], size=size)) + blocked.END)
        for split in (10, 29, 100, 10**6):
            got = read(tmp_path / "a.gz", split)[0]
            assert "\n".join(got) == text.removesuffix("\n"), (size, split)


def test_empty_blocks_and_line_feeds_at_block_ends(tmp_path):
    pieces = [b"one\n", b"", b"two\n", b"thr", b"ee\n", b"", b"", b"four"]
    (tmp_path / "a.gz").write_bytes(b"".join(map(blocked.pack, pieces)) + blocked.END)
    for split in range(1, 200, 3):
        assert read(tmp_path / "a.gz", split)[0] == ["one", "two", "three", "four"]


def test_bytes_that_look_like_blocks(tmp_path):
    inner = b"".join(map(blocked.pack, [b"false\n" * 3, b"lines\n" * 4])) + blocked.END
    (tmp_path / "a.gz").write_bytes(b"".join(blocked.pack(x, 0) for x in [b"one\n", b"two" + inner.replace(b"\n", b"\t") + b"\n", b"three\n"]) + blocked.END)
    whole = gzip.decompress((tmp_path / "a.gz").read_bytes())
    f, size = bgzf.open_file(str(tmp_path / "a.gz"))
    true = [o for o, _ in bgzf.Blocks(f, size, 0)]
    wrong = 0
    for cut in range(1, size):
        own = [bgzf.Range(str(tmp_path / "a.gz"), 0, cut), bgzf.Range(str(tmp_path / "a.gz"), cut, size)]
        if bgzf.first_block(f, size, cut) in (*true, size):
            assert b"".join(x for r in own for x in bgzf.text_lines(r, [0])) == whole
        else:  # the range before sees that the next one would begin within a block
            wrong += 1
            with pytest.raises(ValueError, match="unsplit"):
                list(bgzf.text_lines(own[0], [0]))
    assert wrong
    damaged = bytearray((tmp_path / "a.gz").read_bytes())
    damaged[30] ^= 1
    (tmp_path / "b.gz").write_bytes(damaged)
    with pytest.raises((ValueError, bgzf.zlib.error)):
        read(tmp_path / "b.gz", 10**6)


def test_records_are_read_once_at_every_cut(tmp_path):
    lines = body(80)
    for size in (53, 400, 65280):
        write(tmp_path / "a.bcf", lines, "bcf", size)
        n = (tmp_path / "a.bcf").stat().st_size
        assert list(bcf.lines((tmp_path / "a.bcf").read_bytes())) == lines
        for split in [*range(60, 1500, 131), 3000, n, 10 * n]:
            got, parts = read(tmp_path / "a.bcf", split, "bcf")
            assert got == lines and (3 * split >= 2 * n or parts > 1), (size, split)
    (tmp_path / "plain.bcf").write_bytes(gzip.decompress((tmp_path / "a.bcf").read_bytes()))
    (tmp_path / "gz.bcf").write_bytes(gzip.compress(gzip.decompress((tmp_path / "a.bcf").read_bytes())))
    assert read(tmp_path / "plain.bcf", 100, "bcf") == (lines, 1) == read(tmp_path / "gz.bcf", 100, "bcf")


def inside(line, region):
    contig, low, high = region
    c, begin, end = blocked.place_of(line)
    return c == contig and (low is None or (end >= low and begin < high))


@pytest.mark.parametrize("kind", ["text", "bcf"])
def test_regions_by_index(tmp_path, kind):
    import json

    lines = body(1200)
    path = tmp_path / ("a.vcf.gz" if kind == "text" else "a.bcf")
    write(path, lines, kind)
    wanted = [[("chr1", 1_000_000, 9_000_000)], [("chr2", 80_000, 80_500)], [("chr1", 5, 5)], [("chr2", None, None)], [("none", 1, 5)], [("chr1", 200_000_000, 200_000_000), ("chr2", 1, 2000)], [("chr1", 1, 2**31)]]
    for own in wanted:
        for split in (900, 10**7):
            reader = ranges(path, split, kind, regions=json.dumps(own), overlap="span")
            got = Counter(x for p in reader.partitions() for b in reader.read(p) for x in b.column(0).to_pylist() if not x.startswith("#"))
            must = Counter(x for x in lines if any(inside(x, r) for r in own))
            assert not must - got and not got - Counter(lines)
    # records that reach far are in large bins, which every region asks for; without them few blocks are inflated
    write(path, body(4000, far=0), kind)
    total = sum(1 for _ in bgzf.Blocks(*bgzf.open_file(str(path)), 0))
    for own in wanted[:3]:
        seen = [0]
        for p in ranges(path, 10**7, kind, regions=json.dumps(own), overlap="span").partitions():
            list((bgzf.text_lines if kind == "text" else bgzf.bcf_lines)(p, seen))
        assert seen[0] < (0.05 if own[0][0] == "chr1" else 0.15) * total, (own, seen, total)  # chr2 has six of the smallest bins only
    # an index by others need not reach to the last base of an ALT allele: spans are then searched without it
    Path(f"{path}.csi").write_bytes(b"".join(blocked.blocks([gzip.decompress(Path(f"{path}.csi").read_bytes()).replace(csi.SPANS, bytes(len(csi.SPANS)))])) + blocked.END)
    assert ranges(path, 10**7, kind, regions=json.dumps([("none", 1, 5)]), overlap="span").partitions() and not ranges(path, 10**7, kind, regions=json.dumps([("none", 1, 5)])).partitions()


def test_bins():
    assert [csi.depth_for(x) for x in (1, 1 << 29, (1 << 29) + 1, 2**31 - 1)] == [5, 5, 6, 6]
    r = random.Random(7)
    for _ in range(300):
        a, b = (sorted(r.sample(range(1 << 29), 2)) for _ in range(2))
        own = csi.bin_of(*a, 5)
        over = any(own in x for x in csi.bins_over(*b, 5))
        assert over or a[1] <= b[0] or b[1] <= a[0]
    assert csi.bin_of(0, 1, 5) == 4681 and csi.bin_of(0, 1 << 29, 5) == 0  # fixed values of the format


def as_tbi(index: bytes) -> bytes:
    """A TBI of what a CSI of five levels holds, its linear part made of the bins of the lowest level."""
    own = csi.parse(index)
    names = b"".join(n.encode() + b"\0" for n in own.names)
    out = csi.TBI + struct.pack("<8i", len(own.bins), 2, 1, 2, 0, 35, 0, len(names)) + names
    for bins in own.bins:
        out += struct.pack("<i", len(bins) + 1)
        for b, (_, stretches) in bins.items():
            out += struct.pack("<Ii", b, len(stretches)) + b"".join(struct.pack("<QQ", *s) for s in stretches)
        out += struct.pack("<IiQQQQ", 37450, 2, 0, 0, 1, 1)  # counts, not records
        linear = [0] * 7000
        for b, (least, _) in bins.items():
            if b >= csi.first_bin(5):
                linear[b - csi.first_bin(5)] = least
        out += struct.pack("<i", len(linear)) + struct.pack(f"<{len(linear)}Q", *linear)
    return out


def test_older_indexes(tmp_path):
    lines = [x for x in body(600) if x.startswith("chr2")]
    with (tmp_path / "a.vcf.gz").open("wb") as out:
        index = blocked.write_blocked(out, blocked.text_lines(iter([*HEAD, *lines])), 5, None, 300)
    tbi = as_tbi(index)
    (tmp_path / "a.vcf.gz.tbi").write_bytes(b"".join(blocked.blocks([tbi])) + blocked.END)
    assert csi.parse(tbi).names == ["chr2"]
    import json

    got = read(tmp_path / "a.vcf.gz", 10**6, regions=json.dumps([("chr2", 30_000, 40_000)]))[0]
    must = [x for x in lines if 30_000 <= int(x.split("\t")[1]) <= 40_000]
    assert must and not set(must) - set(got) and len(got) < len(lines) / 2


def test_through_spark(spark, tmp_path):
    lines = body(1000)
    (tmp_path / "t.vcf").write_text("\n".join([*HEAD, *lines]) + "\n")
    q = VariantQuery.open(spark, str(tmp_path / "t.vcf"))
    for form in ("vcf.bgz", "bcf"):
        out = str(tmp_path / f"out.{form}")
        q.save(out, form, index=True)
        names = sorted(p.name for p in Path(out).iterdir())
        assert len(names) == 2 * sum(n.endswith(".csi") for n in names) and not any(n.startswith("_part") for n in names)
        assert VariantQuery.open(spark, out).df.exceptAll(q.df).isEmpty() and q.df.count() == VariantQuery.open(spark, out).df.count()
        for own, overlap in ((["chr1:1e6-9e6", "chr2:500-900"], "start"), (["chr1:50000000-90000000"], "span"), (["chr2"], "span")):
            there = regions.filter_regions(q.df, own, overlap=overlap)
            got = VariantQuery.open(spark, out, regions=own, overlap=overlap).df
            assert got.exceptAll(there).isEmpty() and there.exceptAll(got).isEmpty() and there.count() > 0
        kind = "bcf" if form == "bcf" else "text"
        files = bgzf.files_of(spark, out)
        cut = bgzf.load(spark, files, kind, split=2000)
        assert cut.rdd.getNumPartitions() > len(files) and cut.where("value not like '#%'").count() == len(lines)
        all_blocks = bgzf.load(spark, files, kind, what="blocks").agg(F.sum("blocks")).first()[0]
        assert bgzf.load(spark, files, kind, regions=[("none", 1, 5)], what="blocks").count() == 0 and all_blocks > 0
    one = tmp_path / "one.vcf.gz"
    write(one, lines)
    assert VariantQuery.open(spark, str(one), regions=["chr2:1-50000"]).df.count() == sum(x.startswith("chr2") and int(x.split("\t")[1]) <= 50000 for x in lines)
    plain = tmp_path / "p.vcf.gz"
    plain.write_bytes(gzip.compress("\n".join([*HEAD, *lines, ""]).encode()))
    assert VariantQuery.open(spark, str(plain), regions=["chr2:1-50000"]).df.count() == VariantQuery.open(spark, str(one), regions=["chr2:1-50000"]).df.count()
    with pytest.raises(ValueError, match="unknown contig"):
        VariantQuery.open(spark, str(one), regions=["chrZ"])
    assert io.BytesIO(one.read_bytes()).read(2) == b"\x1f\x8b"


def test_small_ranges_share_tasks(spark, tmp_path):
    lines = body(3000)
    for kind in ("text", "bcf"):
        folder = tmp_path / kind
        folder.mkdir()
        for i, own in enumerate((lines[:1000], lines[1000:])):
            write(folder / f"part-{i}.{kind}", own, kind)
        files = bgzf.files_of(spark, str(folder))
        apart = sum(len(ranges(f.removeprefix("file:"), 100, kind).partitions()) for f in files)
        cut = bgzf.load(spark, files, kind, split=100)
        assert apart > 500 and 16 <= cut.rdd.getNumPartitions() <= 40
        assert sorted(r.value for r in cut.where("value not like '#%'").collect()) == sorted(lines)
        assert bgzf.load(spark, files, kind, split=100, what="blocks").count() == apart
    own = [bgzf.Range("a", i, i + n) for i, n in ((0, 5), (5, 50), (55, 1), (56, 4), (60, 20), (80, 0))]
    made = bgzf.together(own, 10)
    assert [r for g in made for r in g.ranges] == own and [len(g.ranges) for g in made] == [1, 1, 2, 1, 1]
    assert [len(g.ranges) for g in bgzf.together(own, 1)] == [6 - 1, 1] and bgzf.together([], 4) == []
    wide = [bgzf.Range("a", i * bgzf.SPLIT // 2, (i + 1) * bgzf.SPLIT // 2) for i in range(9)]
    assert [len(g.ranges) for g in bgzf.together(wide, 2)] == [2, 2, 2, 2, 1]


def test_records_of_many_different_values():
    head = [
        *HEAD[:-1], '##INFO=<ID=N,Number=.,Type=Integer,Description="">', '##INFO=<ID=X,Number=.,Type=Float,Description="">', '##INFO=<ID=FL,Number=0,Type=Flag,Description="">',
        '##FORMAT=<ID=AD,Number=.,Type=Integer,Description="">', '##FORMAT=<ID=GL,Number=.,Type=Float,Description="">', '##FORMAT=<ID=TX,Number=1,Type=String,Description="">', HEAD[-1],
    ]
    r = random.Random(3)
    number = lambda: r.choice([".", str(r.randrange(-120, 128)), str(r.randrange(-32760, 32768)), str(r.randrange(-(2**31) + 8, 2**31))])
    real = lambda: r.choice([".", f"{r.random():g}", f"{r.random() * 10 ** r.randrange(-9, 9):g}", "0", "-1.5"])
    several = lambda one, most=3: ",".join(one() for _ in range(r.randrange(1, most)))
    call = lambda: r.choice([".", "0", "0/1", "1|0", "./.", f"{r.randrange(200)}|{r.randrange(70)}", "0/1|1"])
    lines = []
    for i in range(20_000):
        info = ";".join(x for x in (f"N={several(number, 20 if i % 7 else 3)}", f"X={several(real)}", "FL" if i % 2 else "", f"TX={'y' * r.randrange(1, 90)}{i}") if x)
        samples = [":".join((call(), several(number), several(real), r.choice([".", "z" * r.randrange(1, 20)]))) for _ in range(2)]
        lines.append("\t".join(("chr1", str(i + 1), r.choice([".", f"rs{i}"]), "A" * r.randrange(1, 20), r.choice([".", "C", "G,TT"]), real(), r.choice([".", "q", "PASS"]), info, "GT:AD:GL:TX", *samples)))
    lines.append("chr1\t30000\t.\tA\tC\t.\t.\t.\tGT:AD:GL:TX\t0/1\t1")  # fields left out at the end
    h = Header.parse(head)
    pieces = [raw for raw, _ in blocked.bcf_records(h)(iter(lines))]
    whole = list(bcf.lines(b"".join(pieces)))
    assert whole[:-1] == lines[:-1] and whole[-1] == lines[-1].replace("0/1\t1", "0/1:.:.:.\t1:.:.:.")
    decode = bcf.decoder("\n".join(h.text()))[0]
    with pytest.raises(ValueError, match="beyond"):
        decode(pieces[-1][:-1])
    with pytest.raises(ValueError, match="beyond 32 bits"):
        list(blocked.bcf_records(h)(iter([lines[0].replace("\tGT:AD:GL:TX", "\tAD").rsplit("\t", 2)[0] + f"\t1\t{2**31}"])))
