"""Genomic interval search: region strings, and the rows that start in or overlap any of them.

Positions are 1-based and both ends are inclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"\d+(?:\.\d+)?(?:[eE]\d)?"
_REGION = re.compile(rf"(?P<contig>[A-Za-z0-9\-_]+)(?::(?P<a>{_NUMBER})(?:-(?P<b>{_NUMBER}))?)?")
#: Up to this number of intervals the predicate is an OR that reaches the scan; beyond, a semi join by bins.
INLINE = 100
#: Cells that all intervals together may be spread over in that join, and the longest class of records, as a power of 2.
BINS, CLASSES = 100_000, 40


@dataclass(frozen=True, order=True)
class Interval:
    contig: str
    low: int | None = None
    high: int | None = None


def parse_region(text: str, contigs: Iterable[str] | None = None) -> Interval:
    """``chr``, ``chr:pos`` or ``chr:a-b``; numbers may be written like 10e6; swapped ends are put in order."""
    squeezed = re.sub(r"\s+", "", text)
    m = _REGION.fullmatch(squeezed)
    if not m:
        raise ValueError(f"not a region: {text!r}")
    if contigs is not None and m["contig"] not in set(contigs):
        raise ValueError(f"unknown contig: {m['contig']!r}")
    if m["a"] is None:
        return Interval(m["contig"])
    a = int(float(m["a"]))
    b = a if m["b"] is None else int(float(m["b"]))
    return Interval(m["contig"], min(a, b), max(a, b))


def parse_regions(texts: Iterable[str], contigs: Iterable[str] | None = None) -> list[Interval]:
    known = None if contigs is None else set(contigs)
    return [parse_region(t, known) for t in texts]


def merge(intervals: Iterable[Interval]) -> list[Interval]:
    """Sorted, with overlapping and adjoining ones made one; whole contigs absorb all of theirs."""
    whole = {i.contig for i in intervals if i.low is None}
    out: list[Interval] = [Interval(c) for c in sorted(whole)]
    last: Interval | None = None
    for i in sorted((i for i in intervals if i.contig not in whole), key=lambda i: (i.contig, i.low, i.high)):
        if last and i.contig == last.contig and i.low <= last.high + 1:
            last = Interval(i.contig, last.low, max(last.high, i.high))
            out[-1] = last
        else:
            last = i
            out.append(i)
    return out


def end_position() -> Column:
    """Last base a record covers: info.END where there is one, else POS and the longest plain allele."""
    longest = F.array_max(F.transform(F.filter("alleles", lambda x: x.rlike("^[ATGC]+$")), F.length))
    return (F.col("pos") + F.greatest(F.coalesce(longest, F.lit(1)), F.lit(1)) - 1).cast("bigint")


def with_end(df: DataFrame, name: str = "end_pos") -> DataFrame:
    end = end_position()
    if "info" in df.columns and "END" in getattr(df.schema["info"].dataType, "names", []):
        kind = df.select("info.END").dtypes[0][1]
        own = F.get(F.col("info.END"), F.lit(0)) if kind.startswith("array") else F.col("info.END")
        end = F.coalesce(own.cast("bigint"), end)
    return df.withColumn(name, end)


def _inside(i: Interval, first: Column, last: Column) -> Column:
    own = F.col("contig") == i.contig
    return own if i.low is None else own & (last >= i.low) & (first <= i.high)


def filter_regions(df: DataFrame, regions: Sequence[str | Interval], contigs: Iterable[str] | None = None, overlap: str = "start") -> DataFrame:
    """Rows in any of the regions, each once. overlap="start" tests POS, "span" the bases from POS to the record's end."""
    if overlap not in ("start", "span"):
        raise ValueError(f"overlap is start or span, not {overlap!r}")
    wanted = merge([r if isinstance(r, Interval) else parse_region(r, contigs) for r in regions])
    src = with_end(df, "__end") if overlap == "span" else df
    first, last = F.col("pos"), F.col("__end" if overlap == "span" else "pos")
    if not wanted:
        return df
    if len(wanted) <= INLINE:
        return src.where(reduce(lambda a, b: a | b, (_inside(i, first, last) for i in wanted))).drop("__end")
    whole = [i.contig for i in wanted if i.low is None]
    rest = [i for i in wanted if i.low is not None]
    # a row is met by the cell of its start alone, so that the join can be a semi join that gives it once. Records are told
    # apart by the power of 2 that their length needs: intervals reach back by that, in cells of that width, for each class
    # of its own, so that one long record widens nothing for the others
    least = max(14, (sum(i.high - i.low + 1 for i in rest) // BINS).bit_length())
    shift = lambda c, k: F.call_function("shiftright", c, k)
    rows = [(i.contig, i.low, i.high) for i in rest]
    bins = df.sparkSession.createDataFrame(rows, "r_contig string, r_low bigint, r_high bigint")
    bins = bins.withColumn("r_class", F.explode(F.array(*[F.lit(k) for k in (range(least, CLASSES + 1) if overlap == "span" else [least])])))
    back = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("r_class")) if overlap == "span" else F.lit(0)
    bins = bins.withColumn("r_cell", F.explode(F.sequence(shift(F.greatest(F.col("r_low") - back, F.lit(0).cast("bigint")), F.col("r_class")), shift(F.col("r_high"), F.col("r_class")))))
    own = F.least(F.greatest(F.lit(least), F.ceil(F.log2((last - first + 1).cast("double"))).cast("int")), F.lit(CLASSES))
    met = src.withColumn("__class", own).withColumn("__cell", shift(F.col("pos"), F.col("__class")))
    on = (F.col("contig") == F.col("r_contig")) & (F.col("__class") == F.col("r_class")) & (F.col("__cell") == F.col("r_cell")) & (last >= F.col("r_low")) & (first <= F.col("r_high"))
    hit = met.join(bins, on, "left_semi").drop("__class", "__cell", "__end")
    return hit if not whole else hit.unionByName(src.where(F.col("contig").isin(whole)).drop("__end"))
