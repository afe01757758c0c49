"""Benchmark decontamination with one FM-index per training shard.

A shard is a bounded run of whole documents within a task. Its words become numbers; a stretch of words that no test
phrase holds, or that is shorter than the shortest phrase, cannot overlap an occurrence and is stored as one separator.
The index is the Burrows-Wheeler transform of that sequence in a wavelet matrix (a wavelet tree, level by level) with
rank directories, and the suffix positions sampled at every stretch's start and at each SAMPLE-th word. All phrases are
searched backwards at once; occurrences are located by walking to a sampled position, and their spans are merged.

The test phrases are a stated query set: they are broadcast in blocks of bounded size, each block passing over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete, map_batches, materialize, pick

#: Lower-cases A-Z and turns every byte that is in no word into a space.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SAMPLE = 8
#: Bytes of text in a shard (one larger document is a shard of its own), and of test texts in a block.
SHARD_BYTES, BLOCK_BYTES = 24 << 20, 1 << 20


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_WORD).split()


class Bits:
    """A bit vector with a rank directory."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class Wavelet:
    """Wavelet matrix of a sequence of numbers under 2^depth."""

    def __init__(self, seq: np.ndarray, depth: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(depth - 1, -1, -1):
            bit = ((seq >> shift) & 1).astype(np.uint8)
            zeros = int(len(bit) - bit.sum())
            self.levels.append((shift, Bits(bit), zeros))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            ri, rs = bits.rank(i), bits.rank(start)
            i, start = np.where(one, zeros + ri, i - ri), np.where(one, zeros + rs, start - rs)
        return i - start

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before."""
        out, start = np.zeros_like(i), np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            ri, rs = bits.rank(i), bits.rank(start)
            one = bits.rank(i + 1) > ri
            out |= one.astype(np.int64) << shift
            i, start = np.where(one, zeros + ri, i - ri), np.where(one, zeros + rs, start - rs)
        return out, i - start


def suffix_array(seq: np.ndarray, separators: int) -> np.ndarray:
    """Of numbers over 0 and separators 0, each separator less than the next one: by prefix doubling."""
    n = len(seq)
    rank = np.where(seq == 0, np.cumsum(seq == 0) - 1, seq + separators - 1).astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (max(n, int(rank.max()) + 1) + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Of the stretches of a shard: seq holds words (over 0), each stretch ended by a 0."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        zeros = int((seq == 0).sum())
        order = suffix_array(seq, zeros)
        before = np.r_[0, seq[:-1]]
        counts = np.bincount(seq, minlength=symbols + 1)
        self.first = np.r_[0, np.cumsum(counts)[:-1]]
        self.wavelet = Wavelet(before[order], max(1, int(symbols).bit_length()))
        sampled = (order % SAMPLE == 0) | (before[order] == 0)
        self.sampled = Bits(sampled.astype(np.uint8))
        self.positions, self.n = order[sampled], len(seq)

    def search(self, phrases: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, given one per row with its words at the right end."""
        lo, hi = np.zeros(len(lens), np.int64), np.full(len(lens), self.n, np.int64)
        live = np.arange(len(lens))
        for back in range(1, phrases.shape[1] + 1):
            live = live[(lens[live] >= back) & (hi[live] > lo[live])]
            if not len(live):
                break
            c = phrases[live, -back]
            both = self.wavelet.rank(np.r_[c, c], np.r_[lo[live], hi[live]])
            lo[live], hi[live] = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row's suffix."""
        out, steps, open_, at = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows
        while len(open_):
            done = self.sampled.rank(at + 1) > self.sampled.rank(at)
            out[open_[done]] = self.positions[self.sampled.rank(at[done])] + steps
            open_, at = open_[~done], at[~done]
            if len(at):
                c, r = self.wavelet.at(at)
                at = self.first[c] + r
            steps += 1
        return out


class Phrases:
    """The windows of a block of test items."""

    def __init__(self, items: list[tuple[str, str | None]], size: int) -> None:
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for n, (_, text) in enumerate(items):
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            for a in range(max(1, len(w) - size + 1) if w else 0):
                found.setdefault(tuple(w[a : a + size]), set()).add(n)
        self.windows = np.zeros((len(found), size), np.int64)
        self.lens = np.fromiter(map(len, found), np.int64, len(found))
        for row, w in enumerate(found):
            self.windows[row, size - len(w) :] = w
        self.items = [sorted(x) for x in found.values()]
        self.shortest = int(self.lens.min(initial=size))

    def hits(self, docs: list[np.ndarray]) -> list[tuple[list[int], set[int]]]:
        """For each document (its words' numbers, 0 for others): merged spans [start, end, ...] in words, and items."""
        out: list[tuple[list[int], set[int]]] = [([], set()) for _ in docs]
        if not docs or not len(self.lens):
            return out
        sizes = np.fromiter(map(len, docs), np.int64, len(docs)) + 1  # each document ends with a word of no phrase
        begins = np.r_[0, np.cumsum(sizes)]
        every = np.zeros(begins[-1], np.int32)
        for b, d in zip(begins.tolist(), docs, strict=False):
            every[b : b + len(d)] = d
        inside = every > 0
        edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return out
        span = ends - starts + 1  # with the separator that follows
        to = np.cumsum(span)
        source = np.arange(to[-1]) - np.repeat(to - span - starts, span)
        seq = every[source].astype(np.int64)
        index = FMIndex(seq, len(self.vocabulary))
        lo, hi = index.search(self.windows, self.lens)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
        begin = source[index.locate(rows)]
        doc = np.searchsorted(begins, begin, side="right") - 1
        for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
            out[d][1].update(self.items[w])
        order = np.argsort(begin, kind="stable")
        a, b = begin[order], (begin + self.lens[which])[order]
        if len(a):
            far = np.maximum.accumulate(b)
            new = np.r_[True, a[1:] > far[:-1]]
            s, e = a[new], np.r_[far[:-1][new[1:]], far[-1]]
            for d, x, y in zip((np.searchsorted(begins, s, side="right") - 1).tolist(), s.tolist(), e.tolist(), strict=True):
                out[d][0].extend((x - int(begins[d]), y - int(begins[d])))
        return out

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, list[int], set[int]]]:
        """(words, spans, items) of each text, shard by shard."""
        get, a = self.vocabulary.get, 0
        while a < len(texts):
            docs, size = [], 0
            while a < len(texts) and (not docs or size + len(texts[a] or "") <= SHARD_BYTES):
                size += len(texts[a] or "")
                w = words(texts[a])
                docs.append(np.fromiter([get(x, 0) for x in w], np.int32, len(w)))
                a += 1
            for d, (spans, items) in zip(docs, self.hits(docs), strict=True):
                yield len(d), spans, items


def merged(old: list[int], new: list[int]) -> list[int]:
    if not old or not new:
        return old or new
    out: list[int] = []
    for s, e in sorted([*zip(old[::2], old[1::2], strict=True), *zip(new[::2], new[1::2], strict=True)]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def blocks(items: DataFrame, size: int, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """The test items in blocks of about block_bytes of text each, never all at once; items of equal id and text are one.
    A null id is named ``null``. One item longer than a block is a block with whatever shares its hash."""
    src = pick(items, key, text).toDF("i", "t").select(F.coalesce(F.col("i").cast("string"), F.lit("null")).alias("i"), "t").distinct()
    total = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = total // block_bytes + 1
    for b in range(n):
        part = src if n == 1 else src.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield Phrases([(r.i, r.t) for r in part.collect()], size)


def mark(docs: DataFrame, items: DataFrame, size: int = 10, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_words, spans, items): merged spans [start, end, start, ...] of hit words, and the ids of the items hit.

    A null or empty text has no words and no hits; items without words have no windows; an empty table of items hits
    nothing; repeated items count once by id; repeated documents each get a row; other columns are ignored.
    """
    spark = docs.sparkSession
    src = pick(docs, key, text)
    kind = src.schema[0].dataType
    out = src.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<int>").alias("s"), F.array().cast("array<string>").alias("i"))
    schema = T.StructType([T.StructField("k", kind), T.StructField("t", T.StringType()), T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.IntegerType())), T.StructField("i", T.ArrayType(T.StringType()))])
    more = blocks(items, size, block_bytes=block_bytes)
    phrases: Phrases | None = next(more)
    while phrases is not None:
        shared = spark.sparkContext.broadcast(phrases)
        phrases = next(more, None)
        last = phrases is None

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            p = shared.value
            for b in batches:
                n, spans, ids = [], [], []
                old = zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)
                for (count, s, i), (s0, i0) in zip(p.scan(b.column(1).to_pylist()), old, strict=True):
                    n.append(count)
                    spans.append(merged(s0, s))
                    ids.append(sorted({*i0, *(p.ids[x] for x in i)}))
                t = pa.nulls(len(n), pa.string()) if last else b.column(1)
                yield pa.RecordBatch.from_arrays([b.column(0), t, pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))], ["k", "t", "n", "s", "i"])

        out = map_batches(out, run, schema)
    return out.select(F.col("k").alias(key), F.col("n").alias("n_words"), F.col("s").alias("spans"), F.col("i").alias("items"))


def contract(marked: DataFrame) -> DataFrame:
    n_hit = F.expr("cast(aggregate(sequence(0, size(spans) div 2), 0, (a, j) -> a + if(2 * j < size(spans), spans[2 * j + 1] - spans[2 * j], 0)) as bigint)")
    n_hit = F.when(F.size("spans") == 0, F.lit(0).cast("bigint")).otherwise(n_hit)
    return marked.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")).cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def cut(text: str, spans: list[int]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8")
    at = [m.span() for m in _WORDS.finditer(raw.translate(_WORD))]
    out, end = [], 0
    for s, e in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[end : at[s][0]])
        end = at[e - 1][1]
    return b"".join([*out, raw[end:]]).decode("utf-8")


def _cut_clean(p: Phrases, texts: list[str | None]) -> tuple[list[str | None], set[int]]:
    """Texts without windows, and the numbers of those left without a word."""
    texts, gone = list(texts), set()
    hit = {n: s for n, (_, s, _) in enumerate(p.scan(texts)) if s}
    while hit:
        for n, s in hit.items():
            texts[n] = cut(texts[n], s)
            if not words(texts[n]):
                gone.add(n)
        again = [n for n in hit if n not in gone]
        hit = {n: s for n, (_, s, _) in zip(again, p.scan([texts[n] for n in again]), strict=True) if s}
    return texts, gone


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text", length: str = "n_chars", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Whole rows of docs with every occurrence of a window cut out of the text.

    Cutting goes on until no window occurs (a cut can bring words together): within a pass for one block of items, and
    over passes for all blocks, where there is more than one, until a round cuts nothing. Where a cut leaves no word, the
    row goes. An integer column ``length`` is set to the new number of characters. Clean rows stay as they are, also
    those of null or empty text; repeated rows are cut alike and all stay; texts of any length are searched whole; null
    keys, and columns of any name, pass through; an empty table of items, or of docs, changes nothing.
    """
    spark, names = docs.sparkSession, docs.columns
    at_text = names.index(text)
    at_length = names.index(length) if length in names and isinstance(docs.schema[names.index(length)].dataType, T.LongType | T.IntegerType) else None
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("cut", F.lit(False))
    schema = plain.schema

    def one_pass(src: DataFrame, phrases: Phrases) -> DataFrame:
        shared = spark.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                old = b.column(at_text).to_pylist()
                texts, gone = _cut_clean(shared.value, old)
                changed = [n for n, (t, o) in enumerate(zip(texts, old, strict=True)) if t != o]
                if not changed:
                    yield b
                    continue
                columns = list(b.columns)
                columns[at_text] = pa.array(texts, b.column(at_text).type)
                marks = b.column(len(columns) - 1).to_pylist()
                lengths = b.column(at_length).to_pylist() if at_length is not None else []
                for n in changed:
                    marks[n] = True
                    if lengths:
                        lengths[n] = len(texts[n])
                columns[-1] = pa.array(marks, pa.bool_())
                if lengths:
                    columns[at_length] = pa.array(lengths, b.column(at_length).type)
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(pa.array([n not in gone for n in range(len(texts))]))

        return map_batches(src, run, schema)

    last = None
    while True:
        n = 0
        for phrases in blocks(items, size, block_bytes=block_bytes):
            plain = one_pass(plain, phrases)
            n += 1
        if n == 1:
            return plain.drop("cut").toDF(*names)
        plain, path = materialize(plain, "decontam-round")
        if last is not None:
            delete(spark, last)
        last = path
        if plain.where("cut").isEmpty():
            return plain.drop("cut").toDF(*names)
        plain = plain.withColumn("cut", F.lit(False))
