"""Group files: a sample and one or more group names on each line, separated by tabs."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .header import Header


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(sample, grp, line, place), one row for each name."""
    parts = spark.read.text(path).where("value <> ''").select(F.monotonically_increasing_id().alias("line"), F.split("value", "\t").alias("f"))
    if bad := parts.where("size(f) < 2").first():
        raise ValueError(f"a line of a group file has no group: {bad.f}")
    return parts.select(F.get("f", F.lit(0)).alias("sample"), "line", F.posexplode(F.slice("f", 2, F.size("f"))).alias("place", "grp")).where("grp <> ''")


def members(groups: DataFrame, header: Header) -> dict[str, list[int]]:
    """Sample numbers by group, in order of first sight; samples that the header lacks are warned about and left out.

    A group file has at most one line for each sample of the header that counts, so it fits the driver as the header does.
    """
    at = {s: i for i, s in enumerate(header.samples)}
    out: dict[str, list[int]] = {}
    for r in groups.orderBy("line", "place").toLocalIterator():
        if r.sample not in at:
            warnings.warn(f"unknown sample in group file: {r.sample}", stacklevel=2)
        elif at[r.sample] not in out.setdefault(r.grp, []):
            out[r.grp].append(at[r.sample])
    return {g: n for g, n in out.items() if n}
