"""VCF text (plain or gzip) as the variants DataFrame; lines are split and typed in expressions, Python reads the header only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import genotypes as G
from ..operators.regions import Interval, filter_regions, merge, parse_region
from .header import Field, Header

#: What a path may hold that would be taken for a pattern.
_GLOB = re.compile(r"[\\*?\[\]{}]")


def read_header(spark: SparkSession, path: str, files: Sequence[str] | None = None) -> Header:
    """From the first lines of the files by name, up to the column line; more are read only while they are header lines.

    Read as one, a path begins with its largest file, which need not be the one that the header begins.
    """
    from . import bgzf

    head: list[str] = []
    for file in bgzf.files_of(spark, path) if files is None else files:
        lines = spark.read.text(_GLOB.sub(r"\\\g<0>", file))
        n = 500
        while True:
            own = [r.value for r in lines.take(n)]
            seen = any(x.startswith("#") and not x.startswith("##") for x in own)
            if seen or len(own) < n or any(not x.startswith("#") for x in own):
                break
            n *= 10
        head += own
        if seen:
            break
    return Header.parse(head)


def _value(c: Column, f: Field) -> Column:
    """A field's text as its type; a dot is missing, what does not parse is null."""
    one = lambda x: F.when(x != ".", x if f.type in ("String", "Character") else x.try_cast("int" if f.type == "Integer" else "float"))
    if f.type == "Flag":
        return c.isNotNull()
    return one(c) if f.scalar() else F.transform(F.split(c, ","), one)


def _info(items: Column, f: Field) -> Column:
    own = F.get(F.filter(items, lambda x: F.substring_index(x, "=", 1) == f.id), F.lit(0))
    if f.type == "Flag":
        return _value(own, f)
    return _value(F.when(F.instr(own, "=") > 0, F.substring(own, F.lit(len(f.id) + 2), F.length(own))), f)


def _sample(samples: Column | str, keys: Column, f: Field) -> Column:
    """A field of samples that are split already."""
    at = F.array_position(keys, f.id)
    # a sample may leave out fields at its end: those are missing
    return F.when(at > 0, F.transform(samples, lambda s: _value(F.get(s, at.cast("int") - 1), f)))


def genotype(text: Column) -> Column:
    """struct(a, p) of a GT value."""
    alleles = F.transform(F.split(F.translate(text, "|", "/"), "/"), lambda x: F.when(x == ".", F.lit(-1)).otherwise(F.coalesce(x.try_cast("int"), F.lit(-1))))
    marks = F.filter(F.split(F.translate(text, "0123456789.", ""), ""), lambda x: (x == "/") | (x == "|"))
    return F.struct(alleles.alias("a"), F.concat(F.array(F.lit(False)), F.transform(marks, lambda x: x == "|")).alias("p"))


def parse_lines(lines: DataFrame, header: Header, check_positions: bool = True) -> DataFrame:
    """The variants of body lines (one column). Header lines among them, as several files have, are left out.

    With check_positions, a position beyond its contig's length, or a contig that was not declared, is an error.
    """
    v = F.col(lines.columns[0])
    # header lines have no fields, so that no expression that is moved before the filter stumbles over them
    is_body = ~v.startswith("#") & (v != "")
    body = lines.where(is_body).select(F.when(is_body, F.split(v, "\t", -1)).alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    dot = lambda c: F.when(c != ".", c)
    pos = at(1).try_cast("bigint")
    if check_positions and header.contigs:
        lengths = F.create_map(*[F.lit(x) for c, n in header.contigs.items() for x in (c, n)])
        bad = at(0).isNotNull() & ~F.coalesce(pos <= F.try_element_at(lengths, at(0)), F.lit(False))
        message = F.concat(F.lit("position beyond its contig or contig not declared: "), at(0), F.lit(":"), F.coalesce(at(1), F.lit("")))
        pos = F.when(bad, F.raise_error(message).cast(T.LongType())).otherwise(pos)
    base = body.select(
        at(0).alias("contig"), pos.alias("pos"), dot(at(2)).alias("id"), F.concat(F.array(at(3)), F.split(at(4), ",")).alias("alleles"), at(5).try_cast("float").alias("qual"),
        F.when(at(6) != ".", F.split(at(6), ";")).alias("filters"), F.when(at(7) != ".", F.filter(F.split(at(7), ";"), lambda x: x != "")).alias("i"), F.when(dot(at(8)).isNotNull(), F.split(at(8), ":")).alias("format_keys"),
        F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))).alias("s"),
    )
    # each sample is split once for all of its fields
    base = base.withColumn("ss", F.transform("s", lambda x: F.split(x, ":")))
    qual = F.when(~F.isnan("qual"), F.col("qual"))
    info = [_info(F.col("i"), f).alias(f.id) for f in header.info.values()]
    fmt = [_sample("ss", F.col("format_keys"), f).alias(f.id) for f in header.formats.values() if f.id != "GT"]
    gt = F.when(F.get("format_keys", F.lit(0)) == "GT", F.transform("s", lambda x: genotype(F.substring_index(x, ":", 1))))
    out = base.select(
        "contig", "pos", "id", "alleles", qual.alias("qual"), "filters", *([F.struct(*info).alias("info")] if info else []), F.transform("i", lambda x: F.substring_index(x, "=", 1)).alias("info_keys"),
        "format_keys", *([F.struct(*fmt).alias("fmt")] if fmt else []), gt.alias("gt"),
    )
    return out.withColumn("ploidy", F.when(F.col("gt").isNotNull(), G.ploidy()))


def wanted_regions(regions: Sequence[str | Interval], header: Header) -> list[Interval] | None:
    """Merged intervals, None for no regions; contigs that the header does not declare are errors."""
    return merge([r if isinstance(r, Interval) else parse_region(r, header.contigs or None) for r in regions]) or None


def read_vcf(spark: SparkSession, path: str, check_positions: bool = True, regions: Sequence[str | Interval] = (), overlap: str = "start", split: int | None = None) -> tuple[DataFrame, Header]:
    """(variants, header) of a VCF file, a glob or a folder of files with the same header.

    BGZF files are read in ranges of ``split`` compressed bytes, other gzip files by one task each. regions: only rows in any
    of them; where an index lies beside a BGZF file, only its blocks with such rows are inflated.
    """
    from . import bgzf

    files = bgzf.files_of(spark, path)
    zipped = [f for f in files if f.endswith((".gz", ".bgz"))]
    if zipped and len(zipped) == len(files) and all(map(bgzf.is_blocked, zipped)):
        header = bgzf.text_header(files[0])
        wanted = wanted_regions(regions, header)
        lines = bgzf.load(spark, files, "text", split or bgzf.SPLIT, wanted and [(i.contig, i.low, i.high) for i in wanted], overlap)
    else:
        header = read_header(spark, path, files)
        wanted = wanted_regions(regions, header)
        lines = spark.read.text(path)
    rows = parse_lines(lines, header, check_positions)
    return (filter_regions(rows, wanted, overlap=overlap) if wanted else rows), header
