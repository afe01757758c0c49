"""Column slicing: field strings such as ``INFO=AC,AF;REF;FORMAT=DP`` become a projection."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords and their other spellings.
CORE = {"CONTIG": "contig", "CHROM": "contig", "CHROMOSOME": "contig", "POS": "pos", "POSITION": "pos", "REF": "ref", "REFERENCE": "ref", "ALT": "alt", "ALTERNATE": "alt", "QUAL": "qual", "QUALITY": "qual", "NAME": "id", "NAMES": "id", "FILTER": "filters", "FILTERS": "filters"}


@dataclass
class Slice:
    """What to keep. info and format: None for none, ["*"] for all in stored order, else names in the order asked for."""

    core: list[str] = field(default_factory=list)
    info: list[str] | None = None
    format: list[str] | None = None
    genotypes: bool = False

    @classmethod
    def all(cls) -> Slice:
        return cls(["contig", "pos", "id", "ref", "alt", "qual", "filters"], ["*"], ["*"], True)

    @classmethod
    def sites(cls) -> Slice:
        """Everything but what samples have."""
        return cls(["contig", "pos", "id", "ref", "alt", "qual", "filters"], ["*"], None, False)


def _add(into: list[str], names: Iterable[str]) -> list[str]:
    return [*into, *(n for n in dict.fromkeys(names) if n not in into)]


def parse(fields: Iterable[str], info: Iterable[str], formats: Iterable[str]) -> Slice:
    """Field strings against the header's INFO and FORMAT names; unknown names and keywords are errors.

    Keywords in any case; INFO names as declared; FORMAT names are upper-cased first. GT and GENOTYPES mean the genotypes.
    FILTER is kept unless other core columns alone are asked for, and contig and pos always are.
    """
    known_info, known_format = set(info), set(formats)
    out = Slice(["contig", "pos"])
    for text in fields:
        for token in filter(None, text.replace(" ", "").split(";")):
            head, has, rest = token.partition("=")
            word = head.upper()
            if word == "INFO":
                names = [n for n in rest.split(",") if n] if has else ["*"]
                if bad := [n for n in names if n != "*" and n not in known_info]:
                    raise ValueError(f"unknown INFO field: {bad[0]!r}")
                out.info = _add(out.info or [], names)
            elif word == "FORMAT":
                names = [n.upper() for n in rest.split(",") if n] if has else ["*"]
                if "*" in names or "GT" in names or "GENOTYPES" in names:
                    out.genotypes = True
                names = [n for n in names if n not in ("GT", "GENOTYPES")]
                if bad := [n for n in names if n != "*" and n not in known_format]:
                    raise ValueError(f"unknown FORMAT field: {bad[0]!r}")
                out.format = _add(out.format or [], names)
            elif not has and word in CORE:
                out.core = _add(out.core, [CORE[word]])
            else:
                raise ValueError(f"unknown pattern: {token!r}")
    return out


def apply(df: DataFrame, s: Slice) -> DataFrame:
    """The variants DataFrame with what is not asked for set to null (so that sinks print a dot) or left out.

    Only the asked-for leaves of info and fmt are referenced, so that the scan reads no others.
    """
    out: list[Column] = [F.col("contig"), F.col("pos")]
    out.append((F.col("id") if "id" in s.core else F.lit(None).cast("string")).alias("id"))
    if "ref" in s.core or "alt" in s.core:
        ref = F.get(F.col("alleles"), F.lit(0)) if "ref" in s.core else F.lit(".")
        alts = F.slice(F.col("alleles"), 2, F.greatest(F.size("alleles") - 1, F.lit(0))) if "alt" in s.core else F.array(F.lit("."))
        out.append((F.col("alleles") if {"ref", "alt"} <= set(s.core) else F.concat(F.array(ref), alts)).alias("alleles"))
    else:
        out.append(F.array(F.lit("."), F.lit(".")).alias("alleles"))
    out.append((F.col("qual") if "qual" in s.core else F.lit(None).cast("float")).alias("qual"))
    out.append(F.col("filters"))
    for struct, keys, wanted in (("info", "info_keys", s.info), ("fmt", "format_keys", s.format)):
        if struct not in df.columns:
            continue
        stored = df.schema[struct].dataType.names
        names = [] if wanted is None else [n for w in wanted for n in (stored if w == "*" else [w])]
        names = list(dict.fromkeys(names))
        if names:
            out.append(F.struct(*[F.col(f"{struct}.`{n}`") for n in names]).alias(struct))
        allowed = [*(["GT"] if struct == "fmt" and s.genotypes else []), *names]
        order = F.array(*[F.lit(n) for n in allowed]).cast("array<string>")
        if wanted is not None and "*" in wanted:
            kept = F.filter(keys, lambda k: F.array_contains(order, k))
        else:
            kept = F.filter(order, lambda k: F.array_contains(F.col(keys), k))
        # keys is named once only: a second use would keep the projection that parses all fields from being merged with this one
        out.append(kept.alias(keys))
    if s.genotypes and "gt" in df.columns:
        out.append(F.col("gt"))
    return df.select(*out)
