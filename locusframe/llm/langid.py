"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone. A trigram's vector binds its letters'
vectors, rotated by two, one and no places, by multiplication; a text's vector bundles (adds) those of its trigrams; a
language's prototype bundles its training texts. The prediction is the prototype of the highest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_batches, pick

DIMENSIONS = 1024
SEED = 20_240_601
#: Distinct labels that are learned at most: those of most texts. What is broadcast is bounded by this.
MAX_LANGUAGES = 1024
#: Letters whose vectors a worker holds (DIMENSIONS bytes each) before it starts anew; trigrams bound together.
HELD, TOGETHER = 60_000, 4096
#: A product of counts and vectors is made where at least one in so many counts is not zero.
SPARSE = 32
#: Letters of text whose trigrams are counted together.
CHARS = 400_000
#: In a filtering stage: texts whose best cosine is under this are in no learned language.
LEAST_SCORE = 0.15

_POINTS = 0x110000


def _letters() -> np.ndarray:
    """Lower-case letter of each code point, or 0 (a gap) where it is no letter."""
    out = np.zeros(_POINTS, np.int32)
    for c in range(_POINTS):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letters()
    return _LETTERS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, text number) of every trigram with a letter; a trigram packs three letters, 21 bits each, 0 for gaps.

    Gaps in a row count as one; a text begins and ends with a gap.
    """
    every = letters("\n" + "\n".join(texts) + "\n")
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    number = np.searchsorted(ends, np.arange(len(every)) - 1, side="right")
    keep = np.r_[True, (every[1:] != 0) | (every[:-1] != 0)]
    every, number = every[keep].astype(np.int64), number[keep]
    if len(every) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = every[:-2] << 42 | every[1:-1] << 21 | every[2:]
    use = every[1:-1] != 0
    return code[use], number[1:-1][use]


class Space:
    """Vectors of letters, made when needed, and of what is bound and bundled from them."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.rows = np.zeros(1 << 21, np.int32)  # by letter, its row of the table, or 0
        self._start_anew()

    def _start_anew(self) -> None:
        self.rows[:] = 0
        self.known = 1
        self.table = np.zeros((256, self.dimensions), np.int8)

    def letter(self, c: int) -> np.ndarray:
        return (np.random.default_rng([self.seed, c]).integers(0, 2, self.dimensions, np.int8) * 2 - 1).astype(np.int8)

    def _learn(self, letters_: np.ndarray) -> None:
        new = np.unique(letters_[self.rows[letters_] == 0])
        if self.known + len(new) > HELD:
            self._start_anew()
            new = np.unique(letters_)
        if self.known + len(new) > len(self.table):
            more = max(2 * len(self.table), self.known + len(new))
            self.table = np.concatenate([self.table, np.zeros((more - len(self.table), self.dimensions), np.int8)])
        for c in new.tolist():
            self.table[self.known] = self.letter(c)
            self.rows[c] = self.known
            self.known += 1

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of at most TOGETHER trigrams, int8."""
        three = [codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]
        self._learn(np.concatenate(three))
        first, second, third = (self.table[self.rows[c]] for c in three)
        third[:, 2:] *= first[:, :-2]
        third[:, :2] *= first[:, -2:]
        third[:, 1:] *= second[:, :-1]
        third[:, :1] *= second[:, -1:]
        return third

    def bundle(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(first text's number, vectors of some texts, one row each) until all are done.

        Memory is that of CHARS letters and TOGETHER vectors, whatever the alphabet: trigrams that many texts share are
        bundled as a product of counts and vectors, those that few have one by one.
        """
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= CHARS) and b - a < 256:
                size += len(texts[b])
                b += 1
            out = np.zeros((b - a, self.dimensions), np.float32)
            for code, number in _parts(texts[a:b], size):
                self._add(out, code, number)
            yield a, out
            a = b

    def _add(self, out: np.ndarray, code: np.ndarray, number: np.ndarray) -> None:
        distinct, which = np.unique(code, return_inverse=True)
        pair, times = np.unique(which * len(out) + number, return_counts=True)
        which, number = pair // len(out), pair % len(out)
        for c in range(0, len(distinct), TOGETHER):
            lo, hi = np.searchsorted(which, [c, c + TOGETHER])
            part = distinct[c : c + TOGETHER]
            if (hi - lo) * SPARSE >= len(out) * len(part):
                counts = np.zeros((len(out), len(part)), np.float32)
                counts[number[lo:hi], which[lo:hi] - c] = times[lo:hi]
                out += counts @ self.of(part).astype(np.float32)
                continue
            order = lo + np.argsort(number[lo:hi], kind="stable")
            for d in range(0, len(order), TOGETHER):
                own = order[d : d + TOGETHER]
                v = self.of(distinct[which[own]]).astype(np.float32)
                v *= times[own, None]
                starts = np.flatnonzero(np.r_[True, np.diff(number[own]) != 0])
                out[number[own][starts]] += np.add.reduceat(v, starts, axis=0)


def _parts(texts: list[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Trigrams of the texts; those of one that is longer than CHARS come in parts that overlap by what a trigram needs."""
    if size <= CHARS or len(texts) > 1:
        yield trigrams(texts)
        return
    every = letters("\n" + texts[0] + "\n")
    every = every[np.r_[True, (every[1:] != 0) | (every[:-1] != 0)]]
    for a in range(0, max(0, len(every) - 2), CHARS):
        part = every[a : a + CHARS + 2].astype(np.int64)
        code = (part[:-2] << 42 | part[1:-1] << 21 | part[2:])[part[1:-1] != 0]
        yield code, np.zeros(len(code), np.int64)


_SPACE: Space | None = None


def space() -> Space:
    """One for each worker process."""
    global _SPACE
    if _SPACE is None:
        _SPACE = Space()
    return _SPACE


def held_out(key: Column) -> Column:
    """The contract's fold: rows that are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def frequent(labels: DataFrame, most: int | None = None) -> list[str] | None:
    """The labels of most rows, if there are more than ``most``; else None. One column is read, its counts stay in Spark."""
    most = MAX_LANGUAGES if most is None else most
    counts = labels.toDF("l").where("l is not null").groupBy("l").count()
    top = counts.orderBy(F.desc("count"), "l").limit(most + 1).collect()
    return [r.l for r in top[:most]] if len(top) > most else None


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language from all rows that have a text and a language.

    Each task bundles its texts by language; the sums of tasks are added up by (language, dimension) in Spark. At most
    MAX_LANGUAGES x DIMENSIONS numbers come to the driver: of more labels, those of most rows are learned (of equally
    many, those that sort first). Null texts and labels are left out, letterless ones add nothing.
    """
    src = pick(rows, text, lang).toDF("t", "l").where("t is not null and l is not null")
    names = frequent(src.select("l"))
    if names is not None:
        src = src.where(F.col("l").isin(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list[str]] = {}
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(g, []).append(t)
            for g, texts in by.items():
                held = sums.setdefault(g, np.zeros(DIMENSIONS))
                for a in range(0, len(texts), 64):
                    # a bundle of texts is the bundle of their trigrams, whichever text they are in
                    for _, v in space().bundle(["\n".join(texts[a : a + 64])]):
                        held += v.sum(0, dtype=np.float64)
        for g, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(v.astype(np.int64))], ["l", "d", "v"])

    added = map_batches(src, run, "l string, d int, v bigint").groupBy("l", "d").agg(F.sum("v").alias("v"))
    got = added.toArrow()
    out: dict[str, np.ndarray] = {}
    for g, d, v in zip(*(got.column(n).to_pylist() for n in ("l", "d", "v")), strict=True):
        out.setdefault(g, np.zeros(DIMENSIONS, np.float64))[d] = v
    return {g: v for g, v in sorted(out.items()) if v.any()}


class Profiles:
    def __init__(self, prototypes: dict[str, np.ndarray]) -> None:
        self.names = list(prototypes)
        self.matrix = np.array([v / np.linalg.norm(v) for v in prototypes.values()], np.float64).reshape(len(self.names), DIMENSIONS)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and cosines, cut to 0 to 1; ``und`` and 0 without a letter or without a learned language."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.names:
            return names, scores
        for a, v in space().bundle([t or "" for t in texts]):
            v = v.astype(np.float64)
            size = np.linalg.norm(v, axis=1)
            # equal texts score alike in whatever company: products of other shapes differ in the last digits
            cosine = ((v @ self.matrix.T) / np.maximum(size, 1e-9)[:, None]).round(9)
            best = cosine.argmax(1)
            for n in np.flatnonzero(size > 0).tolist():
                names[a + n] = self.names[best[n]]
                scores[a + n] = float(min(1.0, max(0.0, cosine[n, best[n]])))
        return names, scores


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every whole text.

    ``und`` with score 0 for null or letterless texts (empty ones too) and where nothing was learned; ties go to the
    name that sorts first; repeated rows each get a row; texts of any length are read whole; null keys are kept; an empty
    table gives none; other columns, whatever their names, are ignored.
    """
    src = pick(df, key, text)
    shared = df.sparkSession.sparkContext.broadcast(Profiles(prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [key, "lang_pred", "score"])

    return map_batches(src, run, f"`{key}` {src.schema[0].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """Whole rows of docs whose text is in a learned language with a cosine of at least ``least``.

    Learned from all labelled rows; ``und`` (null, empty and letterless texts) goes, and so does all where nothing is
    labelled. Nothing is rejected for disagreeing with its label, which is no input. Repeated rows stay or go together;
    texts of any length are read whole; columns pass through, whatever their names; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(fit(docs, text, lang)))

    def keep(batches: Iterator[list[list]]) -> Iterator[list[bool]]:
        for (texts,) in batches:
            names, scores = shared.value.predict(texts)
            yield [n != "und" and s >= least for n, s in zip(names, scores, strict=True)]

    return keep_rows(docs, (text,), keep)
