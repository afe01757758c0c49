"""Quality rules: base counts, then perplexity under a modified Kneser-Ney n-gram model with bands for each language.

The n-grams are of ORDER letters over a folded alphabet of SYMBOLS signs, so that the model has at most SYMBOLS ** ORDER
entries however large the corpus is: that is the proven bound of what is broadcast. Spark counts the n-grams of all
texts; the model keeps one sorted array of hashes for each order, with log-probabilities and back-off weights beside it.
One model serves all languages, so that a text in two of them is no surprise; the bands are each language's own.

Bands come from the perplexities, by letter and by word, of all documents that have enough words, for each language and
class of length: median plus or minus a multiple of a robust deviation. Junk that a corpus holds much of would be no
surprise either, so model and bands are fitted anew, ROUNDS times, on the documents within narrower bands.

Languages are the values of the language column. A text without one takes the language that its hyperdimensional profile
is nearest to; those that are near to none share one more set of bands.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import langid
from .common import keep_rows, map_batches, pick

ORDER = 4
#: The signs of the folded alphabet after the 26 letters; the last seven are the symbols of the base rules.
SIGNS = ["digit", "space", "newline", ".", ",", "!?", "other", "#", "*", "$", "%", "&", "|", "<>"]
SYMBOLS = 26 + len(SIGNS)
NEWLINE = 26 + SIGNS.index("newline")
#: Distinct values of the language column that have bands of their own at most: those of most texts.
MAX_LANGUAGES = langid.MAX_LANGUAGES
#: The language of texts that have no label and are in no learned language.
REST = None
#: A band of fewer documents takes at least the median deviation of larger bands of its length, as its own says little.
FEW = 20
#: Histogram cells, in bits by letter and by word; the least deviation that is taken for each.
CELLS, LEAST = (0.005, 0.025), (0.01, 0.08)
#: Deviations from the median below and above which a document is rejected, and is left out of the next fit.
LOWER, UPPER, TRIM, ROUNDS = 6.0, 6.0, 3.0, 2
MIN_WORDS = 50
#: Texts whose n-grams are made at once.
TEXTS = 400
_SYMBOL_BYTES = b"#*$%&|<>"


def _fold() -> np.ndarray:
    table = np.full(0x3000, 26 + SIGNS.index("other"), np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        base = unicodedata.normalize("NFKD", ch)[:1].lower()
        if "a" <= base <= "z":
            table[c] = ord(base) - 97
        elif ch.isalpha():
            table[c] = c % 26
        elif ch.isdigit():
            table[c] = 26 + SIGNS.index("digit")
        elif ch == "\n":
            table[c] = NEWLINE
        elif ch.isspace():
            table[c] = 26 + SIGNS.index("space")
    for sign in SIGNS[3:]:
        for ch in sign if sign != "other" else "":
            table[ord(ch)] = 26 + SIGNS.index(sign)
    return table


#: By code point below 2^16; those from 0x3000 on are spread over the letters.
FOLD = np.r_[_fold(), np.arange(0x3000, 0x10000) % 26].astype(np.int32)


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if int(points.max(initial=0)) < len(FOLD):
        return FOLD[points]
    return np.where(points < len(FOLD), FOLD[np.minimum(points, len(FOLD) - 1)], (points % 26).astype(np.int32))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram number that ends at every letter of every text, each text begun by newlines, and where texts begin."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = ORDER - 1
    every = symbols("".join("\n" * pad + t for t in texts))
    code = every[pad:].copy()
    for back in range(1, ORDER):
        code += every[pad - back : len(every) - back] * SYMBOLS**back
    begins = np.r_[0, np.cumsum(sizes + pad)][:-1]
    own = np.ones(len(code), bool)
    for p in range(pad):  # the positions of the next text's padding
        at = begins[1:] - pad + p
        own[at] = False
    return code[own], np.r_[0, np.cumsum(sizes)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of n-gram numbers (the finaliser of splitmix64)."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@dataclass
class HashArray:
    """Values by n-gram number: hashes in order, values beside them."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, numbers: np.ndarray, values: np.ndarray) -> HashArray:
        h = mix(numbers)
        order = np.argsort(h)
        return cls(h[order], values[order].astype(np.float32))

    def get(self, numbers: np.ndarray) -> np.ndarray:
        """The values, NaN where there is none."""
        if not len(self.keys):
            return np.full(len(numbers), np.nan, np.float32)
        h = mix(numbers)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.values[at], np.float32(np.nan))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more; plain fallbacks where counts of counts are 0."""
    n = [max(1, int((counts == k).sum())) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.1), 0.95 * k) for k, x in enumerate(d, 1))])


class Model:
    """Interpolated modified Kneser-Ney model."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        size = SYMBOLS
        level = np.zeros(size**ORDER, np.int64)
        level[codes] = counts
        levels = [level]  # from the highest order down: counts, then continuation counts
        for _ in range(ORDER - 1):
            levels.append((levels[-1].reshape(size, -1) > 0).sum(0))
        lower = np.full(1, 1.0 / size)
        self.probs: list[HashArray] = []
        self.backs: list[HashArray] = []
        for c in reversed(levels):
            c = c.reshape(-1, size)
            d = _discounts(c)
            total = c.sum(1)
            cut = d[np.minimum(c, 3)]
            with np.errstate(divide="ignore", invalid="ignore"):
                back = np.where(total > 0, cut.sum(1) / total, 1.0)
                own = np.where(total[:, None] > 0, (c - cut) / np.maximum(total, 1)[:, None], 0.0)
            shorter = np.broadcast_to(lower, (len(c) // max(1, len(lower) // size) if len(lower) >= size else len(c), min(len(lower), size))) if len(lower) < size else np.tile(lower.reshape(-1, size), (len(c) // (len(lower) // size), 1))
            p = own + back[:, None] * shorter
            seen = np.flatnonzero(c.reshape(-1) > 0)
            self.probs.append(HashArray.of(seen, np.log2(p.reshape(-1)[seen])))
            contexts = np.flatnonzero(total > 0)
            self.backs.append(HashArray.of(contexts, np.log2(back[contexts])))
            lower = p.reshape(-1)

    def log2(self, codes: np.ndarray) -> np.ndarray:
        """log2 of the probability of the last letter of each n-gram after the others."""
        out = np.zeros(len(codes), np.float64)
        open_ = np.arange(len(codes))
        for order in range(ORDER, 0, -1):
            own = codes[open_] % SYMBOLS**order
            v = self.probs[order - 1].get(own)
            hit = ~np.isnan(v)
            out[open_[hit]] += v[hit]
            open_, own = open_[~hit], own[~hit]
            if not len(open_):
                return out
            b = self.backs[order - 1].get(own // SYMBOLS)
            out[open_] += np.where(np.isnan(b), 0.0, b)
        out[open_] -= np.log2(SYMBOLS)
        return out


@dataclass
class Scorer:
    """The model, and (median, deviation) of bits by letter and by word for each (language, length class)."""

    model: Model
    bands: dict[tuple[str | None, int], tuple[tuple[float, float], tuple[float, float]]] = field(default_factory=dict)
    profiles: langid.Profiles = field(default_factory=lambda: langid.Profiles({}))
    #: Where the column has more values than have bands: those that do. The others count as no label.
    known: frozenset[str] | None = None

    def languages(self, labels: list[str | None], texts: list[str]) -> list[str | None]:
        """The labels, and for null the predicted language or REST."""
        out = list(labels) if self.known is None else [v if v in self.known else None for v in labels]
        at = [n for n, v in enumerate(out) if v is None]
        names, scores = self.profiles.predict([texts[n] for n in at]) if at else ([], [])
        for n, name, score in zip(at, names, scores, strict=True):
            out[n] = name if score >= langid.LEAST_SCORE else REST
        return out

    def bits(self, texts: list[str]) -> np.ndarray:
        """Bits of each whole text; 0 for an empty one."""
        out = np.zeros(len(texts))
        table = np.zeros(SYMBOLS**ORDER, np.float32)
        at = [n for n, t in enumerate(texts) if t]
        for a in range(0, len(at), TEXTS):
            part = at[a : a + TEXTS]
            code, ends = grams([texts[n] for n in part])
            present = np.flatnonzero(np.bincount(code, minlength=len(table)))
            table[present] = self.model.log2(present)
            out[part] = -np.add.reduceat(table[code], ends[:-1], dtype=np.float64)
        return out

    def within(self, rates: tuple[float, float], language: str | None, n_words: int, low: float = LOWER, high: float = UPPER) -> bool:
        """Whether the bits by letter and by word are inside the bands; where there is no band, everything is."""
        bands = self.bands.get((language, length_class(n_words)), ())
        return all(m - low * d <= x <= m + high * d for x, (m, d) in zip(rates, bands, strict=False))


def length_class(n_words: int) -> int:
    """Documents of like length: 50 to 63 words, then by doubling up to 1024 and more."""
    return min(max(n_words, 1), 1024).bit_length()


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, sum(raw.count(b) for b in _SYMBOL_BYTES), 0, 0
    white = len(raw) - sum(map(len, words))
    symbols_ = sum(map(raw.count, _SYMBOL_BYTES))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        seen: dict[bytes, int] = {}
        ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, n)
        # windows as numbers: pairs first, so that no product passes 2^63
        _, pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
        _, which, count = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        twice = count[which] >= 2
        if twice.any():
            hit = np.zeros(n, bool)
            for k in range(3):
                hit[k : n - 2 + k] |= twice
            repeat = int(hit.sum())
    return n, len(text) - white, symbols_, dup, repeat


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 50 * n_words


def _rates(texts: list[str], scorer: Scorer, n_words: list[int]) -> list[tuple[float, float]]:
    return [(x / max(1, len(t)), x / max(1, n)) for x, t, n in zip(scorer.bits(texts).tolist(), texts, n_words, strict=True)]


def _n_words(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass").split())


def count_grams(src: DataFrame, scorer: Scorer | None) -> DataFrame:
    """(code, n) over all whole texts of (text, lang), from the second fit on of those within narrower bands."""
    shared = src.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SYMBOLS**ORDER, np.int64)
        before: Scorer | None = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            if before is not None:
                n, whole = list(map(_n_words, texts)), texts
                rates = _rates(texts, before, n)
                texts = [t for t, r, g, x in zip(texts, rates, before.languages(b.column(1).to_pylist(), whole), n, strict=True) if x >= MIN_WORDS and before.within(r, g, x, TRIM, TRIM)]
            texts = [t for t in texts if t]
            for a in range(0, len(texts), TEXTS):
                held += np.bincount(grams(texts[a : a + TEXTS])[0], minlength=len(held))
        code = np.flatnonzero(held)
        for a in range(0, len(code), 100_000):
            part = code[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(held[part])], ["code", "n"])

    return map_batches(src, run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def fit_model(src: DataFrame, scorer: Scorer | None) -> Scorer:
    """What comes to the driver has at most SYMBOLS ** ORDER rows of 12 bytes, whatever the input."""
    rows = count_grams(src, scorer).toArrow()
    return Scorer(Model(rows.column("code").to_numpy(), rows.column("n").to_numpy()))


def fit_bands(src: DataFrame, scorer: Scorer) -> Scorer:
    """Adds bands from the bits by letter and by word of all documents that have enough words."""
    shared = src.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            langs = shared.value.languages(b.column(1).to_pylist(), texts)
            n = list(map(_n_words, texts))
            rates = _rates(texts, shared.value, n)
            rows = [(langs[i], length_class(n[i]), kind, int(rates[i][kind] / CELLS[kind])) for i in range(len(n)) if n[i] >= MIN_WORDS for kind in (0, 1)]
            lang, length, kind, cell = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), *(pa.array(x, pa.int32()) for x in (length, kind, cell))], ["lang", "length", "kind", "cell"])

    cells = map_batches(src, run, "lang string, length int, kind int, cell int").groupBy("lang", "length", "kind", "cell").agg(F.count(F.lit(1)).alias("n"))
    # at most (MAX_LANGUAGES + 1) x 6 classes x 2 x some hundred cells, whatever the input
    got = cells.toArrow().sort_by([(c, "ascending") for c in ("lang", "length", "kind", "cell")])
    lang, length, kind = got.column("lang").to_pylist(), got.column("length").to_pylist(), got.column("kind").to_pylist()
    cell, n = got.column("cell").to_numpy(), got.column("n").to_numpy()
    own = list(zip(lang, length, kind, strict=True))
    begins = [i for i in range(len(own)) if not i or own[i] != own[i - 1]]
    found: dict[tuple[str | None, int, int], tuple[float, float]] = {}
    many: dict[tuple[int, int], list[float]] = {}
    few = []
    for a, z in zip(begins, [*begins[1:], len(own)], strict=False):
        found[own[a]] = robust(cell[a:z], n[a:z], own[a][2])
        if n[a:z].sum() < FEW:
            few.append(own[a])
        elif own[a][0] is not REST:
            many.setdefault(own[a][1:], []).append(found[own[a]][1])
    for k in few:
        middle, deviation = found[k]
        found[k] = middle, max(deviation, *(float(np.median(many[x])) for x in [k[1:]] if x in many), 0.0)
    for g, size, _ in found:
        scorer.bands[g, size] = found[g, size, 0], found[g, size, 1]
    return scorer


def robust(cells: np.ndarray, n: np.ndarray, kind: int) -> tuple[float, float]:
    """Median and 1.4826 times the median absolute deviation of a histogram."""

    def half(v: np.ndarray) -> float:
        order = np.argsort(v)
        total = np.cumsum(n[order])
        return float(v[order][np.searchsorted(total, total[-1] / 2)])

    values = (cells + 0.5) * CELLS[kind]
    middle = half(values)
    return middle, max(LEAST[kind], 1.4826 * half(np.abs(values - middle)))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rounds: int = ROUNDS) -> Scorer:
    src = pick(docs, text, lang)
    names = langid.frequent(src.toDF("t", "l").select("l"), MAX_LANGUAGES)
    known = None if names is None else frozenset(names)
    some_null = names is not None or not src.toDF("t", "l").where("l is null").isEmpty()
    profiles = langid.Profiles(langid.fit(docs, text, lang) if some_null else {})
    scorer = None
    for _ in range(1 + rounds):
        scorer = fit_model(src, scorer)
        scorer.profiles, scorer.known = profiles, known
        scorer = fit_bands(src, scorer)
    return scorer


def judge(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Base counts, perplexity (by letter) and verdict of each row.

    Null or empty texts have no words and fail the base rules; repeated rows get equal verdicts; where a language and
    class of length has no band (an empty table, a value never seen) the method rejects nothing; a rate on a band's edge is
    inside it; texts of any length are read whole; null keys are kept; other columns, whatever their names, are ignored.
    """
    src = pick(docs, key, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            langs = shared.value.languages(b.column(2).to_pylist(), texts)
            rows = [base_counts(t) for t in texts]
            base = [failed(r[0], r[4]) for r in rows]
            rates = _rates(texts, shared.value, [r[0] for r in rows])
            kept = [not f and shared.value.within(x, g, r[0]) for f, x, g, r in zip(base, rates, langs, rows, strict=True)]
            counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(base, pa.bool_()), pa.array(kept, pa.bool_()), pa.array([2.0 ** x[0] for x in rates])], [key, *names, "base_failed", "kept", "perplexity"])

    kind = src.schema[0].dataType.simpleString()
    return map_batches(src, run, f"`{key}` {kind}, {', '.join(f'{n} bigint' for n in names)}, base_failed boolean, kept boolean, perplexity double")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Whole rows of docs that the rules keep; all columns as they are, whatever their names.

    Null and empty texts go, as they have no words; repeated rows stay or go together; texts of any length are judged
    whole; an empty table stays empty; null labels are judged by the language that the text is nearest to.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text, lang))

    def keep(batches: Iterator[list[list]]) -> Iterator[list[bool]]:
        for texts, langs in batches:
            texts = [t or "" for t in texts]
            langs = shared.value.languages(langs, texts)
            rows = [base_counts(t) for t in texts]
            rates = _rates(texts, shared.value, [r[0] for r in rows])
            yield [not failed(r[0], r[4]) and shared.value.within(x, g, r[0]) for r, x, g in zip(rows, rates, langs, strict=True)]

    return keep_rows(docs, (text, lang), keep)
