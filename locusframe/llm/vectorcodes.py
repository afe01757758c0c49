"""Product codes of vectors with exact integer k-means, searched through segment-mean lower bounds.

Let x and c be a part and an entry, cut into blocks. Of each block, b times the squared difference of the means plus the
squared difference of the residual norms (the norms of what is left when the mean is taken away) is at most the squared
distance. Coarse blocks (the whole part) are tried on all entries, ever finer ones on those that are left; what the
bounds cannot rule out gets its exact integer distance, so that codes never depend on the bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, map_batches, materialize, pick

#: Components are held within this bound (values within 262,144): distances of up to 512 components then fit into 64 bits.
BOUND = 1 << 26
#: Cells (rows times entries, or times components) that are worked on at once.
CELLS = 1 << 20
#: Relative slack that covers the rounding of bounds in double precision.
SLACK = 1e-11


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor a value that is not finite."""
    odd = [F.coalesce(F.array_contains(vector, F.lit(float(x)).cast("float")), F.lit(False)) for x in ("nan", "inf", "-inf")]
    return vector.isNotNull() & (F.size(F.array_compact(vector)) == F.size(vector)) & ~(odd[0] | odd[1] | odd[2])


def integers(column: pa.Array, length: int) -> np.ndarray:
    """floor(256 * x) of each row of a list column, zeros up to length behind shorter rows."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.clip(np.floor(np.asarray(column.flatten(), np.float64) * 256.0), -BOUND, BOUND).astype(np.int64)
    if len(sizes) and sizes.min() == length:
        return flat.reshape(len(sizes), length)
    out = np.zeros((len(sizes), length), np.int64)
    out[np.arange(length) < sizes[:, None]] = flat
    return out


def levels(width: int) -> list[np.ndarray]:
    """Where blocks begin, from one block to blocks of two components; blocks of one would be the distance itself."""
    return [np.unique(np.linspace(0, width, n, endpoint=False).astype(np.int64)) for n in (1 << i for i in range(width.bit_length())) if n == 1 or 2 * n <= width]


def outline(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The means and the residual norms of the blocks of each row."""
    sizes = np.diff(np.r_[starts, x.shape[1]])
    mean = np.add.reduceat(x, starts, axis=1) / sizes
    rest = x - np.repeat(mean, sizes, axis=1)
    return mean, np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))


def _apart(x: np.ndarray, c: np.ndarray, rows: np.ndarray, ents: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of chosen pairs; x and c have a component in each row, which is gathered at a time."""
    out = None
    for j in range(len(x)):
        d = x[j].take(rows)
        d -= c[j].take(ents)
        d *= d
        if weights is not None:
            d *= weights[j]
        out = d if out is None else np.add(out, d, out=out)
    return out


class Book:
    """The entries of one part position, with the outlines of their blocks at each level."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries, self.width = entries, entries.shape[1]
        self.columns = np.ascontiguousarray(entries.T)
        self.levels = levels(self.width)
        self.sizes = [np.diff(np.r_[s, self.width]) for s in self.levels]
        self.outlines = [tuple(np.ascontiguousarray(o.T) for o in outline(entries, s)) for s in self.levels]
        self.norms = (entries.astype(np.float64) ** 2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each row (the lower index of equals), its squared distance, and how many exact distances it took."""
        if not self.width or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
        n, columns = len(x), np.ascontiguousarray(x.T)
        mine = np.arange(n)
        # room for rounding: a share of the norms, the largest of the entries' for all
        slack = SLACK * ((x.astype(np.float64) ** 2).sum(1) + self.norms.max())
        (mean,), (rest,) = (o.T for o in outline(x, self.levels[0]))
        (theirs,), (their_rest,) = self.outlines[0]
        bound = np.subtract.outer(mean, theirs)
        bound *= bound
        bound *= self.width
        more = np.subtract.outer(rest, their_rest)
        more *= more
        bound += more
        best = _apart(columns, self.columns, mine, bound.argmin(1))
        rows, ents = np.divmod(np.flatnonzero(bound <= (best + slack)[:, None]), len(self.entries))
        for level in range(1, len(self.levels)):
            mean, rest = (np.ascontiguousarray(o.T) for o in outline(x, self.levels[level]))
            theirs, their_rest = self.outlines[level]
            bound = _apart(mean, theirs, rows, ents, self.sizes[level]) + _apart(rest, their_rest, rows, ents)
            # the entry that now looks nearest gives each row a closer distance to beat
            best = np.minimum(best, _apart(columns, self.columns, mine, ents[_least(bound, rows)[0]]))
            left = np.flatnonzero(bound <= (best + slack).take(rows))
            rows, ents = rows.take(left), ents.take(left)
        exact = _apart(columns, self.columns, rows, ents)
        at, least = _least(exact, rows)
        return ents[at], least, len(rows)


def _least(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's least value first stands, and that value; rows are sorted and each has a value."""
    at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    least = np.minimum.reduceat(values, at)
    hits = np.flatnonzero(values == np.repeat(least, np.diff(np.r_[at, len(rows)])))
    of = rows.take(hits)
    return hits[np.r_[True, of[1:] != of[:-1]]], least


class Codebooks:
    """entries: integers by part position, entry and position within the part; at most parts * size * width of them."""

    def __init__(self, entries: np.ndarray, length: int) -> None:
        self.entries, self.length = entries, length
        self.books = [Book(e) for e in entries]

    def parts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """A list column's rows as integers (rows, parts, width), in slices of bounded cells."""
        k, (parts, size, width) = 0, self.entries.shape
        step = max(1, CELLS // max(size, parts * width))
        while k < len(column):
            x = integers(column.slice(k, step), self.length)
            padded = np.zeros((len(x), parts * width), np.int64)
            padded[:, : self.length] = x
            yield padded.reshape(len(x), parts, width)
            k += step

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _sums(df: DataFrame, books: Codebooks, vector: str) -> DataFrame:
    """(part, entry, place, sum, count) of one assignment: summed up by each task, so that a task gives a codebook's rows at most."""
    held = df.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        parts, size, width = own.entries.shape
        sums, counts = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for b in batches:
            for x in own.parts(b.column(0)):
                for p, book in enumerate(own.books):
                    code, _, _ = book.nearest(x[:, p])
                    counts[p] += np.bincount(code, minlength=size)
                    order = np.argsort(code, kind="stable")
                    used, at = np.unique(code[order], return_index=True)
                    if width:
                        sums[p, used] += np.add.reduceat(x[order, p], at, axis=0)
        p, e = np.nonzero(counts)
        cols = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), sums[p, e].ravel(), np.repeat(counts[p, e], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["part", "entry", "place", "sum", "count"])

    made = map_batches(df.select(vector), run, "part bigint, entry bigint, place bigint, sum bigint, count bigint")
    return made.groupBy("part", "entry", "place").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))


def fit(df: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, key: str = "vec_id", vector: str = "embedding") -> Codebooks | None:
    """Codebooks by k-means: the vectors of the ``size`` smallest keys begin, then ``rounds`` of assigning all vectors and
    replacing each entry by the floor of its parts' mean; unused entries stay.

    Only codebooks, whose size is bounded by ``size`` vectors, come to the driver. Vectors that are not ``finite`` take no
    part. Shorter vectors count as ending in zeros, and lengths that ``parts`` does not divide too. Null keys come last among
    the smallest, equal keys in the order of their vectors. Fewer than ``size`` vectors give so many entries; none gives None.
    """
    src = pick(df, key, vector)
    kept = src.where(finite(F.col(vector)))
    length = kept.agg(F.max(F.size(vector))).first()[0]
    if length is None:
        return None
    begin = kept.orderBy(F.col(key).asc_nulls_last(), F.col(vector)).limit(size).select(vector).collect()
    width = -(-length // parts)
    first = np.zeros((len(begin), parts * width), np.int64)
    first[:, :length] = integers(pa.array([r[0] for r in begin], pa.list_(pa.float64())), length)
    entries = np.ascontiguousarray(first.reshape(len(begin), parts, width).transpose(1, 0, 2))
    for _ in range(rounds if width else 0):
        entries = entries.copy()
        for r in _sums(kept, Codebooks(entries, length), vector).collect():
            entries[r["part"], r["entry"], r["place"]] = r["sum"] // r["count"]
    return Codebooks(entries, length)


def encode(df: DataFrame, books: Codebooks | None, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, code, error) of every finite vector: entry numbers in order of parts, two hex digits each (four beyond 256
    entries), and the squared distance to them.

    Vectors longer than those that the codebooks were fitted on are refused by an error.
    """
    src = pick(df, key, label, vector)
    kinds = [f.dataType.simpleString() for f in src.schema]
    schema = f"`{key}` {kinds[0]}, `{label}` {kinds[1]}, code string, error bigint"
    if books is None:
        return df.sparkSession.createDataFrame([], schema)
    held = df.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        parts, size, _ = own.entries.shape
        for b in batches:
            codes, errors = [], []
            for x in own.parts(b.column(2)):
                code = np.zeros((len(x), parts), np.uint8 if size <= 256 else ">u2")
                error = np.zeros(len(x), np.int64)
                for p, book in enumerate(own.books):
                    code[:, p], least, _ = book.nearest(x[:, p])
                    error += least
                codes += [c.tobytes().hex() for c in code]
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.string()), pa.array(np.concatenate([*errors, np.zeros(0, np.int64)]))], [key, label, "code", "error"])

    return map_batches(src.where(finite(F.col(vector))), run, schema)


def compress(df: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every finite vector, with codebooks fitted on all of them.

    label_error: the errors summed over all vectors with the same label, null being one. Vectors that are null or hold a null
    or a value that is not finite give no row; other edge cases as in ``fit``. Components beyond BOUND count as BOUND.
    Repeated rows give repeated rows; an empty table gives none; other columns, whatever their names, are ignored.
    """
    books = fit(df, parts, size, rounds, key, vector)
    codes, _ = materialize(encode(df, books, key, vector, label).toDF("key", "label", "code", "error"), "vector-codes")
    totals, _ = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "vector-labels")
    digest = F.lit(books.digest() if books else "")
    return beside(codes, totals, "label", "n").select(F.col("key").alias(key), "code", "error", "label_error", digest.alias("codebooks_sha256"))
