"""Hidden Markov language model with exact sequence likelihoods.

Symbols are the HEAD most frequent words, the end, and CLASSES classes of all other words by their last letters; a word
of a class has its add-half share of the class. States are trained by Baum-Welch: each task adds up expected counts over
segments of its texts, Spark sums them by symbol, the driver turns at most (HEAD + CLASSES + 1) x STATES sums into the
next model. The scaled forward recursion then gives the likelihood of each whole text.

Word counts of any number stay in a Spark table: a text's rare words meet their counts in a join by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, materialize, pick

STATES, HEAD, CLASSES = 10, 65_536, 1024
#: Rounds of Baum-Welch, each over all training texts.
ROUNDS = 14
#: Words in a training segment, and in the segments or texts that are worked on together.
SEGMENT, TOGETHER = 128, 200_000
#: Training segments in step: few enough that what is known of their states stays in a core's cache.
WIDTH = 512
#: Symbols whose expected counts are one row on their way from the tasks.
BLOCK = 1024
#: Weight, in words, of the unigram distribution in each state's emissions, and of each transition.
PRIOR, PRIOR_MOVE = 200.0, 1.0
#: Bytes of symbols (four a word) that are scored together.
SCORED_BYTES = 16 << 20
#: Words a task gathers before it counts them and passes the counts on.
COUNTED = 2_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The table of CRC-32, by byte.
_CRC = np.array([zlib.crc32(bytes([c ^ 255])) ^ 0xFF000000 for c in range(256)], np.uint32)
#: The end of a text; no word holds a space.
END = b" "


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and where each text's begin, with their number at the end.

    A-Z are lower-cased and texts split at 0x20 and 0x09-0x0D only; null has no words.
    """
    if not len(texts):
        return pa.array([], pa.binary()), np.zeros(1, np.int64)
    texts = texts.fill_null("").cast(pa.large_binary())
    where = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[where[0] : where[-1]]
    where = where - where[0]
    data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    inner = (data != 32) & (data - np.uint8(9) > 4)  # below 9 it wraps around
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    starts = where[where < len(data)]  # words end with their text
    first[starts] = inner[starts]
    begins = np.searchsorted(np.flatnonzero(first), where)
    offsets = np.append(np.flatnonzero(first[inner]), np.count_nonzero(inner))
    return _binary(offsets, data[inner]), begins


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.array(offsets, pa.int32()).buffers()[1], pa.py_buffer(data)])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def count_words(texts: DataFrame) -> DataFrame:
    """(w, n) of every token of the one column of texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = ends = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = pa.chunked_array(held, pa.binary()).value_counts()
            held.clear()
            for a in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays(found[a : a + 50_000].flatten(), ["w", "n"])

        for b in batches:
            own, _ = split(b.column(0))
            held.append(own)
            size, ends = size + len(own), ends + b.num_rows
            if size > COUNTED:
                yield from flush()
                size = 0
        yield from flush()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], ["w", "n"])

    return map_batches(texts, run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def _class(w: bytes) -> int:
    return zlib.crc32(w[-3:]) % CLASSES


def _classes(own: pa.Array) -> np.ndarray:
    """_class of each word of an array."""
    ends = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]
    data = np.frombuffer(own.buffers()[2] or b"", np.uint8)
    sizes, ends = np.diff(ends), ends[1:]
    crc = np.full(len(own), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        at = np.flatnonzero(sizes >= back)
        crc[at] = _CRC[(crc[at] ^ data[ends[at] - back]) & 255] ^ (crc[at] >> 8)
    return ((crc ^ 0xFFFFFFFF) % CLASSES).astype(np.int32)


@dataclass
class Lexicon:
    """Counts of the head words, and of each class its words' count and number. Bounded by HEAD and CLASSES."""

    head: dict[bytes, int]
    counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    distinct: int

    def __post_init__(self) -> None:
        per_symbol = np.r_[self.counts, self.class_tokens].astype(np.float64)
        self.unigram = (per_symbol + 0.5) / (per_symbol.sum() + 0.5 * len(per_symbol))
        self.head_log = np.log10(self.counts + 0.5)
        self.class_log = np.log10(self.class_tokens + 0.5 * (self.class_words + 1.0))
        self.base_log = float(np.log10(self.tokens + 0.5 * (self.distinct + 1.0)))
        self.known = pa.array(list(self.head), pa.binary())  # by symbol

    def encode(self, text: str | None) -> tuple[np.ndarray, dict[bytes, int]]:
        """encode_all of one text, its other words as a dictionary."""
        ids, _, rare = self.encode_all(pa.array([text], pa.string()))
        return ids, {r["w"]: r["m"] for r in rare[0].as_py()}

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The symbols of whole texts with their ends, one after the other; where each text's begin, with their number
        at the end; and for each text its words of no head symbol with their counts."""
        own, begins = split(texts)
        coded = own.dictionary_encode()
        distinct, code = coded.dictionary, coded.indices.to_numpy()
        symbol = pc.index_in(distinct, value_set=self.known).fill_null(-1).to_numpy()
        beyond = symbol < 0
        symbol = np.where(beyond, _classes(distinct) + len(self.head), symbol).astype(np.int32)
        where = begins + np.arange(len(begins))
        ids = np.full(where[-1], self.head[END], np.int32)
        inside = np.ones(len(ids), bool)
        inside[where[1:] - 1] = False
        ids[inside] = symbol[code]
        at = np.flatnonzero(beyond[code])
        row = np.searchsorted(begins, at, "right") - 1
        pair, m = np.unique(row * len(distinct) + code[at], return_counts=True)
        row, which = np.divmod(pair, max(len(distinct), 1))
        rare = pa.StructArray.from_arrays([distinct.take(pa.array(which)), pa.array(m, pa.int32())], ["w", "m"])
        return ids, where, pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(begins))), pa.int32()), rare)


def fit_lexicon(counts: DataFrame) -> Lexicon:
    """The head is all words from a count on, chosen so that at most HEAD words reach it; the end is always in it."""
    cell = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(F.log(F.col("n") / 4096.0) * 100)).cast("int")
    rows = counts.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("least")).orderBy(F.desc("cell")).collect()  # a few thousand cells
    distinct, tokens, reach, least = sum(r.words for r in rows), sum(r.tokens for r in rows), 0, None
    for r in rows:
        reach += r.words
        if reach > HEAD:
            break
        least = r.least
    end = F.lit(bytearray(END))
    in_head = (F.col("n") >= F.lit(least if least is not None else 1 << 62)) | (F.col("w") == end)
    top = counts.where(in_head).collect()  # at most HEAD + 1 words
    top.sort(key=lambda r: (bytes(r.w) != END, -r.n, bytes(r.w)))
    if not top:
        head, number = {END: 0}, np.zeros(1)
    else:
        head, number = {bytes(r.w): i for i, r in enumerate(top)}, np.array([r.n for r in top], np.float64)
    group = (F.crc32(F.substring(F.col("w"), -3, 3)) % CLASSES).cast("int")
    # words shorter than three bytes are their own ending
    group = F.when(F.length("w") >= 3, group).otherwise((F.crc32("w") % CLASSES).cast("int"))
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.where(~in_head).groupBy(group.alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        class_tokens[r.c], class_words[r.c] = r.n, r.v
    return Lexicon(head, number, class_tokens, class_words, tokens, distinct)


@dataclass
class Model:
    """start: two distributions, for the beginning of a text and of a later segment; emit: symbols x states."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    _rows: np.ndarray | None = field(default=None, repr=False, compare=False)

    def rows(self) -> np.ndarray:
        """Emissions by symbol, in single precision: those of one symbol are read together."""
        if self._rows is None:
            self._rows = np.ascontiguousarray(self.emit, np.float32)
        return self._rows

    @classmethod
    def first(cls, lexicon: Lexicon, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        emit = lexicon.unigram[:, None] * rng.gamma(2.0, 0.5, (len(lexicon.unigram), STATES))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
        return cls(np.full((2, STATES), 1 / STATES), move, emit / emit.sum(0))

    @classmethod
    def from_counts(cls, lexicon: Lexicon, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        start, move = start + 1.0, move + PRIOR_MOVE
        emit = emit + PRIOR * lexicon.unigram[:, None]
        return cls(start / start.sum(1, keepdims=True), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Counts:
    """Expected counts of one round."""

    def __init__(self, symbols: int) -> None:
        self.start, self.move, self.emit = np.zeros((2, STATES)), np.zeros((STATES, STATES)), np.zeros((STATES, symbols)).T  # a state's are together
        self.seen, self.posterior, self.size = np.empty(TOGETHER, np.intp), np.empty((STATES, TOGETHER), np.float32), 0
        self.held = np.empty((2, SEGMENT * STATES * WIDTH), np.float32)

    def add(self, model: Model, texts: list[np.ndarray]) -> None:
        """Baum-Welch over the segments of texts, many segments in step."""
        segments = [(t[a : a + SEGMENT], a > 0) for t in texts for a in range(0, len(t), SEGMENT)]
        segments.sort(key=lambda s: -len(s[0]))
        for a in range(0, len(segments), WIDTH):
            some = segments[a : a + WIDTH]
            if self.size + len(some) * len(some[0][0]) > TOGETHER:
                self._settle()
            self._some(model, [s for s, _ in some], np.array([int(later) for _, later in some]))
        self._settle()

    def _some(self, model: Model, segments: list[np.ndarray], later: np.ndarray) -> None:
        """States are rows here, so that every step works on long contiguous rows, one column a segment."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))  # falling
        steps, n = int(sizes[0]), len(segments)
        here = slice(self.size, self.size + steps * n)
        self.size = here.stop
        seq = self.seen[here].reshape(steps, n)
        seq[...] = 0
        seq.T[np.arange(steps) < sizes[:, None]] = np.concatenate(segments)
        live = np.searchsorted(-sizes, -np.arange(steps), side="left").tolist()  # segments longer than t
        move, ones = model.move.astype(np.float32), np.ones(STATES, np.float32)
        turned = np.ascontiguousarray(move.T)
        alpha, emit = self.held[:, : steps * STATES * n].reshape(2, steps, STATES, n)
        gamma, emits, scale = self.posterior[:, here].reshape(STATES, steps, n), model.rows(), np.empty((steps, n), np.float32)
        taken = np.empty((n, STATES), np.float32)
        for t in range(steps):
            k = live[t]
            x, own = alpha[t, :, :k], scale[t, :k]
            if t:
                np.matmul(turned, alpha[t - 1, :, :k], out=x)
            else:
                x[...] = model.start.T.astype(np.float32).take(later[:k], axis=1)
            emit[t] = emits.take(seq[t], axis=0, out=taken, mode="clip").T  # no symbol is out of bounds
            x *= emit[t, :, :k]
            np.matmul(ones, x, out=own)
            x /= own
        beta = np.ones((STATES, n), np.float32)
        for t in range(steps - 1, -1, -1):
            k = live[t]
            own, back = beta[:, :k], emit[t, :, :k]
            np.multiply(alpha[t, :, :k], own, out=gamma[:, t, :k])  # the posteriors, which sum to one
            back *= own  # in place of the emissions
            back /= scale[t, :k]
            np.matmul(move, back, out=own)
            if k < n:  # none beyond an end
                alpha[t, :, k:] = emit[t, :, k:] = gamma[:, t, k:] = 0
        for kind in (0, 1):
            self.start[kind] += gamma[:, 0, later == kind].sum(1, dtype=np.float64)
        self.move += model.move * np.matmul(alpha[:-1], emit[1:].transpose(0, 2, 1)).sum(0, dtype=np.float64)

    def _settle(self) -> None:
        """Add the posteriors at hand to those of their symbols."""
        for s in range(STATES):
            self.emit[:, s] += np.bincount(self.seen[: self.size], self.posterior[s, : self.size], len(self.emit))
        self.size = 0


def log10_likelihood(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Of each whole sequence of symbols, by the scaled forward recursion; sequences of like length go in step."""
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    emits, turned, ones = np.ascontiguousarray(model.emit), np.ascontiguousarray(model.move.T), np.ones(STATES)
    a = 0
    while a < len(order):
        b, total = a, 0
        while b < len(order) and (b == a or total + len(texts[order[b]]) <= 4 * TOGETHER):
            total += len(texts[order[b]])
            b += 1
        group = order[a:b]
        sizes = np.fromiter((len(texts[i]) for i in group), np.int64, len(group))
        flat = np.concatenate([texts[i] for i in group])
        begins = np.r_[0, np.cumsum(sizes)[:-1]]
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left").tolist()
        total_log, alpha = np.zeros(len(group)), np.zeros((STATES, 0))
        for t in range(int(sizes[0])):
            k = live[t]
            x = turned @ alpha[:, :k] if t else np.repeat(model.start[0][:, None], k, 1)
            x *= emits.take(flat[begins[:k] + t], axis=0).T
            s = ones @ x
            alpha = x
            alpha /= s
            total_log[:k] += np.log10(s)
        out[group] = total_log
        a = b
    return out


_CODED = "rid bigint, k {kind}, held_out boolean, n bigint, ids binary, rare array<struct<w:binary,m:int>>"


def _encode(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(rid, k, held_out, n, ids, rare) of (k, t, held_out): symbols and rare words of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, where, rare = shared.value.encode_all(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(np.diff(where), pa.int64()), _binary(4 * where, ids), rare], ["rid", "k", "held_out", "n", "ids", "rare"])

    src = docs.select(F.monotonically_increasing_id().alias("rid"), "k", "t", "held_out")
    return map_batches(src, run, _CODED.format(kind=docs.schema["k"].dataType.simpleString()))


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in column.to_pylist()]


def _blocks(number: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array([x.tobytes() for x in sums], pa.binary())], ["b", "sums"])


def train(coded: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the rows that are not held out."""
    spark = coded.sparkSession
    # a task sends sums for all symbols that it met, however much it read: no more tasks than two for each core
    training = coded.where("not held_out").select("ids").coalesce(2 * spark.sparkContext.defaultParallelism)
    model = Model.first(lexicon)
    symbols = len(lexicon.unigram)
    for _ in range(rounds if lexicon.tokens else 0):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c, held, size = Counts(symbols), [], 0
            for b in batches:
                for t in _ids(b.column(0)):
                    held.append(t)
                    size += len(t)
                    if size >= 4 * TOGETHER:
                        c.add(shared.value, held)
                        held, size = [], 0
            c.add(shared.value, held)
            # starts and moves go before the symbols
            rows = np.concatenate([c.start, c.move, c.emit]).astype(np.float32)
            blocks = [(a // BLOCK, rows[a : a + BLOCK]) for a in range(0, len(rows), BLOCK) if rows[a : a + BLOCK].any()]
            yield _blocks([n for n, _ in blocks], [x for _, x in blocks])

        def add(parts: pa.Table) -> pa.Table:
            """Sums of one block from all tasks."""
            total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in parts.column("sums").to_pylist())
            return pa.Table.from_batches([_blocks(parts.column("b").to_pylist()[:1], [total])])

        added = map_batches(training, run, "b int, sums binary").groupBy("b").applyInArrow(add, "b int, sums binary")
        rows = np.zeros((2 + STATES + symbols, STATES))
        for r in added.collect():  # one row for each BLOCK of symbols
            own = np.frombuffer(r.sums, np.float64).reshape(-1, STATES)
            rows[r.b * BLOCK : r.b * BLOCK + len(own)] = own
        model = Model.from_counts(lexicon, rows[:2], rows[2 : 2 + STATES], rows[2 + STATES :])
        shared.unpersist()
        # Spark drops the shuffle files of a plan when the JVM has collected it: else those of all rounds would pile up
        spark._jvm.System.gc()
    return model


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", fold: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    A null or empty text is its end alone; one of any length is scored whole; words of equal count are in the head, or out
    of it, together. Without training rows every count is 0, the base score is 0 and the model is
    uniform over its symbols. Rows with a null key are trained on; repeated rows count and score each; other columns are
    ignored. Scores may differ in the last digits from run to run, as sums of floats do.
    """
    src = pick(docs, key, text).toDF("k", "t")
    src = src.withColumn("held_out", held_out(F.col("k")) if fold is None else fold)
    counts, _ = materialize(count_words(src.where("not held_out").select("t")), "hmm-counts")
    lexicon = fit_lexicon(counts)
    coded, _ = materialize(_encode(src, lexicon), "hmm-coded")
    model = train(coded, lexicon, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, hmm = shared.value
        heads = len(lex.head)
        some: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            """Scores of the texts at hand: the more of them, the more of like length go in step."""
            b = pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            ids = _ids(b.column(4))
            likelihood = log10_likelihood(hmm, ids)
            head_log, known = [], []
            for i, t in enumerate(ids):
                rare = t >= heads
                head_log.append(float(lex.head_log[t[~rare]].sum()))
                known.append(int((~rare).sum()) if lex.tokens else 0)
                likelihood[i] -= lex.class_log[t[rare] - heads].sum()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(head_log), pa.array(known, pa.int64()), pa.array(likelihood)], ["rid", "k", "held_out", "n", "head_log", "known", "likelihood"])

        for b in batches:
            if not b.num_rows:
                continue
            some.append(b)
            size += b.column(4).nbytes
            if size >= SCORED_BYTES:
                yield from flush()
                some, size = [], 0
        if some:
            yield from flush()

    kind = src.schema["k"].dataType.simpleString()
    scored = map_batches(coded.select("rid", "k", "held_out", "n", "ids"), run, f"rid bigint, k {kind}, held_out boolean, n bigint, head_log double, known bigint, likelihood double")
    rare = coded.select("rid", F.inline("rare"))
    met = rare.join(counts, "w", "left").groupBy("rid").agg(
        F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("rare_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("rare_known")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(met, "rid", "left").select(
        F.col("k").alias(key), "held_out", F.col("n").alias("n_tokens"), (F.col("known") + zero("rare_known")).cast(T.LongType()).alias("n_known"), F.lit(lexicon.tokens).cast("bigint").alias("train_tokens"),
        (F.col("head_log") + zero("rare_log") - F.col("n") * F.lit(lexicon.base_log)).alias("base_score"), (F.col("likelihood") + zero("rare_log")).alias("score"),
    )
