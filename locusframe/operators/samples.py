"""Site counters and per-sample statistics: conversions, transitions, insertions, deletions, singletons, indel sizes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotypes as G
from ..session import ship

# Allele classes, in the order of the rows and columns of the conversion matrix.
CLASSES = ["A", "T", "G", "C", "unknown", "missing", "absent", "insertion", "deletion"]
UNKNOWN, MISSING, ABSENT, INSERTION, DELETION = 4, 5, 6, 7, 8
#: Longest indel that is told apart, and slots of the histogram of ALT alleles.
LONGEST, SLOTS = 255, 32


def _base(c: Column) -> Column:
    return F.when(c == "A", 0).when(c == "T", 1).when(c == "G", 2).when(c == "C", 3).otherwise(UNKNOWN)


def allele_classes(alleles: str = "alleles") -> Column:
    """struct(code, size) of each allele, REF first; null where REF is one letter outside of ATGC.

    size: how much longer (or, below 0, shorter) than REF an insertion or deletion is, cut to LONGEST.
    """
    a = F.col(alleles)
    ref = F.get(a, F.lit(0))

    def one(x: Column) -> Column:
        plain = x.rlike("^[ATGC]+$")
        more = F.length(x) - F.length(ref)
        code = (
            F.when((F.length(ref) == 1) & (F.length(x) == 1), _base(x))
            .when(plain & (more > 0), INSERTION)
            .when(plain & (more < 0) & (F.length(ref) > 1), DELETION)
            .otherwise(UNKNOWN)
        )
        size = F.when((code == INSERTION) | (code == DELETION), F.greatest(F.lit(-LONGEST), F.least(F.lit(LONGEST), more))).otherwise(0)
        return F.struct(code.cast("int").alias("code"), size.cast("int").alias("size"))

    first = F.struct(F.when(F.length(ref) == 1, _base(ref)).otherwise(UNKNOWN).cast("int").alias("code"), F.lit(0).alias("size"))
    rest = F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), one)
    return F.when((F.length(ref) > 1) | ref.isin("A", "T", "G", "C"), F.concat(F.array(first), rest))


def site_summary(df: DataFrame) -> DataFrame:
    """One row of counters over all sites."""
    c = df.select("alleles", allele_classes().alias("cl"), G.allele_counts().alias("ac"))
    c = c.withColumn("alt_calls", F.aggregate(F.slice("ac", 2, F.greatest(F.size("ac") - 1, F.lit(0))), F.lit(0), lambda s, x: s + x))
    has = lambda code: F.coalesce(F.exists("cl", lambda x: x["code"] == code), F.lit(False))
    usable = F.col("cl").isNotNull()
    single = F.forall("alleles", lambda x: F.length(x) == 1)
    kind = lambda test: F.coalesce(F.exists(F.slice("alleles", 2, F.greatest(F.size("alleles") - 1, F.lit(0))), test), F.lit(False))
    ref = F.get(F.col("alleles"), F.lit(0))
    plain = "^[ATGC]+$"
    return c.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(F.size("alleles") == 2).alias("n_biallelic"),
        F.count_if(F.size("alleles") > 2).alias("n_multi_allele"),
        F.count_if((F.size("alleles") > 2) & single).alias("n_multi_allele_snp"),
        F.count_if(has(INSERTION)).alias("n_ins"),
        F.count_if(has(DELETION)).alias("n_del"),
        F.count_if(usable & (F.col("alt_calls") == 0)).alias("n_no_alts"),
        F.count_if(usable & (F.col("alt_calls") == 1)).alias("n_singleton"),
        F.count_if(kind(lambda x: (F.length(ref) == 1) & (F.length(x) == 1) & x.rlike(plain) & ref.rlike(plain))).alias("n_snp"),
        F.count_if(kind(lambda x: (F.length(ref) > 1) & (F.length(x) == F.length(ref)) & x.rlike(plain) & ref.rlike(plain))).alias("n_mnp"),
        F.count_if(kind(lambda x: ~x.rlike(plain) | ~ref.rlike(plain))).alias("n_other"),
    )


def alt_histogram(df: DataFrame) -> DataFrame:
    """(n_alts, n) of sites by ALT alleles, the last slot for all that have more."""
    return df.groupBy(F.least(F.size("alleles") - 1, F.lit(SLOTS - 1)).alias("n_alts")).agg(F.count(F.lit(1)).alias("n"))


# Cells of a sample's counts: conversions by REF class and class, then indels by zig-zag number of their size, then singletons.
SIDE = len(CLASSES)
SIZES = SIDE * SIDE
SINGLETON = SIZES + 2 * LONGEST + 1
CELLS = SINGLETON + 1
#: Indel calls that a task holds before equal ones are counted.
HELD = 1 << 20


class Counts:
    """What one task adds up: conversions of every sample as one dense array, indels by size as counted keys."""

    def __init__(self) -> None:
        self.samples = 0
        self.dense = np.zeros((0, SIZES + 1), np.int64)  # the last column counts singletons
        self.keys, self.sums, self.new, self.n_new = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def grow(self, samples: int) -> None:
        if samples > self.samples:
            self.dense = np.vstack([self.dense, np.zeros((samples - self.samples, SIZES + 1), np.int64)])
            self.samples = samples

    def fold(self) -> None:
        own, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.new]), return_counts=True)
        keys, at = np.unique(np.concatenate([self.keys, own]), return_inverse=True)
        self.sums = np.bincount(at, np.concatenate([self.sums, n]), len(keys)).astype(np.int64)
        self.keys, self.new, self.n_new = keys, [], 0

    def add(self, calls: np.ndarray, sample: np.ndarray, site: np.ndarray, classes: np.ndarray, sizes: np.ndarray, first: np.ndarray, n_alleles: np.ndarray, samples: int) -> None:
        """calls: allele numbers (-1 missing, -2 absent) of calls that are not all REF, slot by slot; classes and sizes of the
        alleles of all sites, those of a site from its ``first`` on."""
        self.grow(samples)
        at = first[site][:, None] + np.clip(calls, 0, n_alleles[site][:, None] - 1)
        known = (calls >= 0) & (calls < n_alleles[site][:, None])
        code = np.where(calls == -1, MISSING, np.where(calls == -2, ABSENT, np.where(known, classes[at], UNKNOWN)))
        cell = classes[first[site]][:, None] * SIDE + code
        whose = np.broadcast_to(sample[:, None], calls.shape)
        keys = (whose * SIZES + cell).ravel()
        if self.samples * SIZES <= 4 * len(keys):
            self.dense[:, :SIZES] += np.bincount(keys, minlength=self.samples * SIZES).reshape(self.samples, SIZES)
        else:
            keys, n = np.unique(keys, return_counts=True)
            self.dense[keys // SIZES, keys % SIZES] += n
        indel = (code == INSERTION) | (code == DELETION)
        if indel.any():
            size = sizes[at][indel]
            self.new.append(whose[indel] * CELLS + SIZES + np.where(size >= 0, 2 * size, -2 * size - 1))
            self.n_new += len(size)
            if self.n_new > HELD:
                self.fold()
        alts = (calls > 0).sum(1)
        per_site = np.bincount(site, alts, len(first))
        single = (alts == 1) & (per_site[site] == 1)
        np.add.at(self.dense[:, SIZES], sample[single], 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sample, cell, n) of what is not zero."""
        self.fold()
        sample, cell = np.nonzero(self.dense)
        n = self.dense[sample, cell]
        return np.r_[sample, self.keys // CELLS], np.r_[np.where(cell == SIZES, SINGLETON, cell), self.keys % CELLS], np.r_[n, self.sums]


def _places(counts: np.ndarray) -> np.ndarray:
    """0, 1 ... for each of the counts in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = Counts()
    ints = lambda c, k: np.asarray(k(c), np.int64)
    for b in batches:
        flat, lens, ploidy, n_calls, classes, sizes = (b.column(i) for i in range(6))
        if not len(flat):
            continue
        values, length = ints(flat, lambda c: c.flatten()), ints(flat, lambda c: c.value_lengths())
        ploidy, n = ints(ploidy, lambda c: c), ints(n_calls, lambda c: c)
        n_alleles = ints(classes, lambda c: c.value_lengths())
        first = np.cumsum(n_alleles) - n_alleles
        begins = np.cumsum(length) - length
        even = np.asarray(lens.is_null())
        own_lens = ints(lens, lambda c: c.flatten())  # of the sites with calls of several lengths
        lens_at = np.cumsum(np.where(even, 0, n)) - np.where(even, 0, n)
        codes, lengths = ints(classes, lambda c: c.flatten()), ints(sizes, lambda c: c.flatten())
        for p in np.unique(ploidy[length > 0]):
            for alike in (True, False):
                sites = np.flatnonzero((even == alike) & (ploidy == p) & (length > 0))
                if not len(sites):
                    continue
                site = np.repeat(sites, n[sites])
                place = _places(n[sites])
                if alike:  # each call has p alleles
                    calls = values[(begins[site] + place * p)[:, None] + np.arange(p)]
                else:
                    size = own_lens[np.repeat(lens_at[sites], n[sites]) + place]
                    calls = np.full((len(site), p), -2, np.int64)
                    calls[np.repeat(np.arange(len(site)), size), _places(size)] = values[np.repeat(begins[sites], length[sites]) + _places(length[sites])]
                kept = np.flatnonzero(((calls != 0) & (calls != -2)).any(1))
                if len(kept):
                    own.add(calls[kept], place[kept], site[kept], codes, lengths, first, n_alleles, int(place[kept].max()) + 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in own.rows()], ["sample_id", "cell", "n"])


def sample_cells(df: DataFrame) -> DataFrame:
    """(sample_id, cell, n): all that is counted of samples, from one scan and one exchange.

    Each task adds its sites up in arrays, as large as the number of samples asks, whatever the number of sites; only their
    cells that are not zero are exchanged, by sample, so that what follows by sample needs no other exchange.
    """
    ship(df.sparkSession)
    flat = F.flatten(F.col("gt.a"))
    ploidy, n = G.ploidy(), F.size("gt")
    lens = F.when(F.size(flat) != ploidy * n, F.transform("gt", lambda g: F.size(g["a"])))
    cl = F.col("cl")
    src = df.select("gt", allele_classes().alias("cl")).where("cl is not null and gt is not null")
    made = src.select(flat.alias("v"), lens.alias("lens"), ploidy.alias("p"), n.alias("n"), cl["code"].alias("code"), cl["size"].alias("size")).mapInArrow(_accumulate, "sample_id bigint, cell bigint, n bigint")
    return made.repartition("sample_id").groupBy("sample_id", "cell").agg(F.sum("n").alias("n"))


def conversions(df: DataFrame) -> DataFrame:
    """(sample_id, ref, code, n): how often each sample has an allele of a class at sites of a REF class. Calls of REF alone do
    not count; absent slots do, as absent."""
    own = sample_cells(df).where(F.col("cell") < SIZES)
    return own.select("sample_id", F.floor(F.col("cell") / SIDE).cast("int").alias("ref"), (F.col("cell") % SIDE).cast("int").alias("code"), "n")


def indel_spectrum(df: DataFrame) -> DataFrame:
    """(sample_id, slot, n): insertions and deletions by zig-zag number of their size."""
    own = sample_cells(df).where(F.col("cell").between(SIZES, SINGLETON - 1))
    return own.select("sample_id", (F.col("cell") - SIZES).cast("int").alias("slot"), "n")


def singletons(df: DataFrame) -> DataFrame:
    """(sample_id, n_singleton): the only carrier of the only ALT allele of a site."""
    return sample_cells(df).where(F.col("cell") == SINGLETON).select("sample_id", F.col("n").alias("n_singleton"))


def _sums() -> list[Column]:
    """Ts, Tv, their ratio, insertions, deletions and singletons of a sample's cells."""
    ref, code, n = F.floor(F.col("cell") / SIDE), F.col("cell") % SIDE, F.col("n")
    pair = lambda a, b: (ref == a) & (code == b)
    transition = pair(0, 2) | pair(2, 0) | pair(1, 3) | pair(3, 1)
    change = (ref < 4) & (code < 4) & (ref != code)
    total = lambda test: F.coalesce(F.sum(F.when(test & (F.col("cell") < SIZES), n)), F.lit(0)).cast("bigint")
    ts, tv = total(transition), total(change & ~transition)
    single = F.coalesce(F.sum(F.when(F.col("cell") == SINGLETON, n)), F.lit(0)).cast("bigint")
    return [ts.alias("n_ts"), tv.alias("n_tv"), F.when(tv > 0, ts / tv).otherwise(F.lit(0.0)).alias("ts_tv"), total(code == INSERTION).alias("n_ins"), total(code == DELETION).alias("n_del"), single.alias("n_singleton")]


def sample_summary(df: DataFrame) -> DataFrame:
    """(sample_id, n_ts, n_tv, ts_tv, n_ins, n_del, n_singleton) of every sample with a call that is not REF."""
    return sample_cells(df).groupBy("sample_id").agg(*_sums())


def sample_rows(df: DataFrame, samples: Sequence[str]) -> DataFrame:
    """(name, n_ts, n_tv, ts_tv, n_ins, n_del, n_singleton, conv, in_dist, del_dist): a row for each sample, zeros for one
    without any call that is not REF. One scan and one exchange of counts."""
    listed = df.sparkSession.createDataFrame(list(enumerate(samples)), "sample_id bigint, listed string")
    own = sample_cells(df).groupBy("sample_id").agg(*_sums(), F.collect_list(F.struct("cell", "n")).alias("own"))
    per = listed.join(own, "sample_id", "full")
    # all cells in their order: those that are there, and zeros for the others
    there = F.coalesce("own", F.array().cast("array<struct<cell:bigint,n:bigint>>"))
    missing = F.transform(F.array_except(F.sequence(F.lit(0).cast("bigint"), F.lit(CELLS - 1).cast("bigint")), there["cell"]), lambda c: F.struct(c.alias("cell"), F.lit(0).cast("bigint").alias("n")))
    per = per.withColumn("all", F.array_sort(F.concat(there, missing)))
    per = per.withColumn("all", F.col("all.n"))
    sizes = F.sequence(F.lit(1), F.lit(LONGEST))
    return per.select(
        F.coalesce("listed", F.col("sample_id").cast("string")).alias("name"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_ts", "n_tv", "ts_tv", "n_ins", "n_del", "n_singleton")],
        F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda i: F.slice("all", i * SIDE + 1, SIDE)).alias("conv"),
        F.transform(sizes, lambda k: F.get("all", SIZES + 2 * k)).alias("in_dist"),
        F.transform(sizes, lambda k: F.get("all", SIZES + 2 * k - 1)).alias("del_dist"),
    )


def _sites(df: DataFrame, samples: Sequence[str]) -> DataFrame:
    """One row, VI: site counters and the histogram of ALT alleles."""
    histogram = alt_histogram(df).agg(F.map_from_entries(F.collect_list(F.struct("n_alts", "n"))).alias("m"))  # SLOTS rows at most
    alts = histogram.select(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("n_alts"))
    vi = site_summary(df).crossJoin(alts)  # one row each
    return vi.select(F.struct(F.lit(len(samples)).alias("n_samples"), "*").alias("VI"))


def json_lines(df: DataFrame, samples: Sequence[str]) -> DataFrame:
    """``value``: a line with the site counters, {"VI": ...}, and a line for each sample, {"sample": name, ...}."""
    own = sample_rows(df, samples)
    lines = own.select(F.to_json(F.struct(F.col("name").alias("sample"), *[c for c in own.columns if c != "name"])).alias("value"))
    return _sites(df, samples).select(F.to_json(F.struct("VI")).alias("value")).unionByName(lines)


def to_json(df: DataFrame, samples: Sequence[str]) -> DataFrame:
    """One row, ``value``: {"VI": site counters, "PSI": {sample: its statistics}}. It is as large as the number of samples asks;
    ``json_lines`` gives the same a line a sample."""
    own = sample_rows(df, samples)
    per = own.select("name", F.struct(*[c for c in own.columns if c != "name"]).alias("s"))
    psi = per.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "s")))).alias("PSI"))
    return _sites(df, samples).crossJoin(psi).select(F.to_json(F.struct("VI", "PSI")).alias("value"))
