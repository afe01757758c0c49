"""Fluent queries over variants: every step only extends the logical plan."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from copy import deepcopy
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .. import VERSION
from ..operators import annotate as annotation
from ..operators import filters, regions, samples, slicing
from ..sources import groups as group_files
from ..sources import sinks, store, vcf
from ..sources.header import Field, Header


class VariantQuery:
    """A variants DataFrame with its header. Each method returns a new query."""

    def __init__(self, df: DataFrame, header: Header) -> None:
        self.df, self.header = df, header

    @classmethod
    def open(cls, spark: SparkSession, path: str, keys: Mapping[str, bytes] | None = None, regions: Sequence[str] = (), overlap: str = "start", check_positions: bool = True) -> VariantQuery:
        """A store (keys: those of its encrypted columns), or VCF or BCF by its name.

        regions: as in ``regions``, but known to the reader: of indexed files, only what can hold such rows is read.
        """
        bare = path.rstrip("/")
        if bare.endswith(".bcf"):
            from ..sources import bcf

            return cls(*bcf.read_bcf(spark, path, check_positions, regions, overlap))
        if bare.endswith((".vcf", ".vcf.gz", ".vcf.bgz")):
            return cls(*vcf.read_vcf(spark, path, check_positions, regions, overlap))
        return cls(*store.read_store(spark, path, keys)).regions(*regions, overlap=overlap)

    def _with(self, df: DataFrame, fields: Mapping[str, tuple[str, str, str]] = {}) -> VariantQuery:  # noqa: B006
        header = deepcopy(self.header) if fields else self.header
        for name, (number, kind, description) in fields.items():
            header.define("INFO", Field(name, number, kind, description))
        return VariantQuery(df, header)

    def regions(self, *texts: str, overlap: str = "start") -> VariantQuery:
        known = self.header.contigs or None
        return self._with(regions.filter_regions(self.df, list(texts), known, overlap)) if texts else self

    def where(self, *predicates: tuple) -> VariantQuery:
        return self._with(filters.where(self.df, predicates)) if predicates else self

    def fields(self, *texts: str) -> VariantQuery:
        if not texts:
            return self
        return self._with(slicing.apply(self.df, slicing.parse(texts, self.header.info, [f for f in self.header.formats if f != "GT"])))

    def sites(self) -> VariantQuery:
        """Without genotypes and per-sample values."""
        return self._with(self.df.drop("gt", "gt_runs", "fmt", "format_keys"))

    def samples(self, *names: str) -> VariantQuery:
        at = {s: i for i, s in enumerate(self.header.samples)}
        if unknown := [n for n in names if n not in at]:
            raise ValueError(f"unknown sample: {unknown[0]!r}")
        header = deepcopy(self.header)
        header.samples = list(names)
        return VariantQuery(filters.keep_samples(self.df, [at[n] for n in names]), header)

    def annotate(self, tags: Iterable[str] = annotation.TAGS, naming: str = "code") -> VariantQuery:
        tags = list(tags)
        return self._with(annotation.annotate(self.df, tags, naming), {t: annotation.DEFINITIONS[t] for t in tags})

    def annotate_groups(self, groups: Mapping[str, Sequence[int]] | str, tags: Iterable[str] = annotation.GROUP_TAGS, f_statistics: bool = True) -> VariantQuery:
        """groups: sample numbers by name, or the path of a group file."""
        tags = list(tags)
        if isinstance(groups, str):
            groups = group_files.members(group_files.read_groups(self.df.sparkSession, groups), self.header)
        out = annotation.annotate_groups(self.df, groups, tags)
        fields = {f"{g}_{t}": annotation.DEFINITIONS[t] for g in groups for t in tags}
        if f_statistics:
            out = annotation.f_statistics(out, groups)
            fields |= {t: annotation.DEFINITIONS[t] for t in annotation.FSTATS}
        return self._with(out, fields)

    def transform(self, fn: Callable[..., DataFrame], *args: Any) -> VariantQuery:
        return self._with(fn(self.df, *args))

    def stats_json(self) -> DataFrame:
        return samples.to_json(self.df, self.header.samples)

    def stats_lines(self) -> DataFrame:
        return samples.json_lines(self.df, self.header.samples)

    def save(self, path: str, format: str = "store", with_header: bool = True, command: str | None = None, keys: Mapping[str, bytes] | None = None, index: bool = False, runs: bool = False) -> None:
        """format: store (keys: columns to encrypt; runs: genotypes as runs), vcf, vcf.gz, vcf.bgz or bcf (index: CSI files beside these two). The header records the command, if given,
        with the versions of this package and of Spark."""
        header = deepcopy(self.header)
        if command:
            header.provenance(f"command={command}")
            header.provenance(f"settings={json.dumps({'version': VERSION, 'spark': self.df.sparkSession.version, 'format': format, 'encrypted': sorted(keys or ())}, sort_keys=True)}")
        genotypes = bool({"gt", "fmt"} & set(self.df.columns))
        if format == "store":
            store.write_store(self.df, header, path, keys=keys, runs=runs)
        elif format in ("vcf", "vcf.gz", "vcf.bgz"):
            sinks.write_vcf(self.df, header, path, {"vcf.gz": "gzip", "vcf.bgz": "bgzf"}.get(format), with_header, genotypes, index)
        elif format == "bcf":
            sinks.write_bcf(self.df, header, path, genotypes, index)
        else:
            raise ValueError(f"unknown format: {format!r}")
