"""Command line: ``python -m locusframe import | view | stats``."""

from __future__ import annotations

import argparse
import os
import re
import shlex
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators import annotate, integrity
from ..sources import sinks, store
from .query import VariantQuery

#: Options of view that are predicates: flag, predicate, its fixed arguments, type of the value or None.
PREDICATES = [
    ("--alleles-min", "alt_alleles", (">",), int), ("--alleles-max", "alt_alleles", ("<=",), int), ("--min-quality", "quality", (">",), float), ("--max-quality", "quality", ("<=",), float),
    ("--ref-match", "ref_allele", ("regex",), str), ("--alt-match", "alt_allele", ("regex",), str), ("--name-match", "name", ("regex",), str), ("--ac-min", "alt_count", (">",), int),
    ("--ac-max", "alt_count", ("<=",), int), ("--af-min", "alt_frequency", (">",), float), ("--af-max", "alt_frequency", ("<=",), float), ("--known", "known", (True,), None), ("--novel", "known", (False,), None),
    ("--phased", "phased", (True,), None), ("--exclude-phased", "phased", (False,), None), ("--mixed-phase", "mixed_phasing", (True,), None), ("--exclude-mixed-phase", "mixed_phasing", (False,), None),
    ("--mixed-ploidy", "mixed_ploidy", (True,), None), ("--exclude-mixed-ploidy", "mixed_ploidy", (False,), None), ("--uncalled", "uncalled", (True,), None), ("--exclude-uncalled", "uncalled", (False,), None),
    ("--unseen-alt", "unseen_alt", (True,), None), ("--exclude-unseen-alt", "unseen_alt", (False,), None), ("--filter-value", "filter_value", (), str), ("--type", "variant_type", (), str),
]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="locusframe")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("import", "view", "stats"):
        p = sub.add_parser(name)
        p.add_argument("-i", "--input", required=True)
        p.add_argument("-o", "--output", required=name == "import")
        p.add_argument("-k", "--keys", help="keychain file of encrypted columns; import -e writes it")
        if name == "import":
            p.add_argument("--rows", type=int, default=store.ROWS, help="rows of a file at most")
            p.add_argument("--level", type=int, default=6, help="zstd level")
            p.add_argument("--runs", action="store_true", help="genotypes as runs of samples with equal calls")
            p.add_argument("--no-position-check", action="store_true")
            p.add_argument("-e", "--encrypt", help="columns to encrypt, comma-separated, with new keys that go to the file of --keys")
        if name == "view":
            p.add_argument("-O", "--output-format", choices=["store", "vcf", "vcf.gz", "vcf.bgz", "bcf"], default="vcf")
            p.add_argument("--write-index", action="store_true", help="CSI files beside vcf.bgz and bcf output")
            p.add_argument("-f", "--fields", action="append", default=[])
            p.add_argument("-r", "--region", action="append", default=[])
            p.add_argument("--overlap", choices=["start", "span"], default="start", help="what of a record must be in a region")
            p.add_argument("--info", action="append", default=[], help="INFO field, comparator and value, such as DP>50")
            p.add_argument("--ploidy", action="append", default=[], help="comparator and number, such as >=2")
            p.add_argument("-G", "--drop-format", action="store_true")
            p.add_argument("-H", "--no-header", action="store_true")
            p.add_argument("--header-only", action="store_true")
            p.add_argument("-X", "--annotate", action="store_true")
            p.add_argument("-b", "--groups")
            p.add_argument("--samples")
            for flag, _, _, kind in PREDICATES:
                p.add_argument(flag, **({"action": "store_true"} if kind is None else {"type": kind}))
    return top


_COMPARISON = re.compile(r"\s*([\w.]*)\s*(<=|>=|==|!=|<|>|=)\s*(.+?)\s*")


def comparison(text: str) -> tuple[str, str, float | str]:
    """(name, comparator, value) of text such as ``DP>50``; values that are numbers are taken as such."""
    m = _COMPARISON.fullmatch(text)
    if not m:
        raise ValueError(f"not a comparison: {text!r}")
    value: float | str = m[3]
    for kind in (int, float):
        try:
            value = kind(m[3])
            break
        except ValueError:
            pass
    return m[1], "==" if m[2] == "=" else m[2], value


def view(q: VariantQuery, a: argparse.Namespace) -> VariantQuery:
    """The query that the options of view ask for."""
    wanted = [("info_field", *comparison(x)) for x in a.info] + [("site_ploidy", *comparison(x)[1:]) for x in a.ploidy]
    for flag, predicate, fixed, kind in PREDICATES:
        value = getattr(a, flag[2:].replace("-", "_"))
        if value is not None and value is not False:
            wanted.append((predicate, *fixed, *([] if kind is None else [value])))
    q = q.where(*wanted)
    if a.samples:
        q = q.samples(*a.samples.split(","))
    if a.annotate:
        if a.groups:
            q = q.annotate_groups(a.groups)
        q = q.annotate()
    if a.fields:
        return q.fields(*a.fields, *([f"INFO={','.join(annotate.TAGS)}"] if a.annotate else []))
    return q.sites() if a.drop_format else q


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("locusframe").getOrCreate()
    command = shlex.join(["locusframe", *argv])
    if a.command == "import" and a.encrypt and not a.keys:
        raise ValueError("--encrypt needs a file for the new keys: --keys")
    keys = integrity.keychain_from_json(Path(a.keys).read_text()) if a.keys and not getattr(a, "encrypt", None) else None
    q = VariantQuery.open(spark, a.input, keys, getattr(a, "region", []), getattr(a, "overlap", "start"), not getattr(a, "no_position_check", False))
    if a.command == "import":
        q.header.provenance(f"command={command}")
        if a.encrypt:
            keys = integrity.new_keychain(a.encrypt.split(","))
            with open(os.open(a.keys, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
                f.write(integrity.keychain_to_json(keys))
        store.write_store(q.df, q.header, a.output, a.rows, a.level, keys if a.encrypt else None, a.runs)
    elif a.command == "stats":
        if a.output:  # a line a sample
            q.stats_lines().write.text(a.output)
        else:
            print(q.stats_json().first().value)
    elif a.header_only:
        print("\n".join(q.header.text()))
    else:
        q = view(q, a)
        if a.output:
            q.save(a.output, a.output_format, not a.no_header, command, index=a.write_index)
        else:
            if not a.no_header:
                print("\n".join(q.header.text("gt" in q.df.columns or "fmt" in q.df.columns)))
            for r in sinks.vcf_lines(q.df).orderBy(sinks._order(q.header), "contig", "pos").select("value").toLocalIterator():
                print(r.value)
    return 0
