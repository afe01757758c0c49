"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Every leaf of the tree holds ``rank * width + position`` of the pair that starts there, so that the root is the
lowest-ranked and, among equals, the leftmost mergeable pair. A merge changes three leaves and their ancestors. Short
pre-tokens are merged many at a time (one tree per row of an array); long ones one at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pick

#: Fixed value: the pre-tokenisation pattern that byte-level vocabularies of this family define.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1) << 62
#: Widest tree that is merged row-wise with others; longer pre-tokens get a tree of their own.
ROWWISE = 64
#: Pre-tokens remembered by a Python worker before its memory of them starts anew.
REMEMBER = 200_000
#: Cells of the trees that are merged together, and characters that are split at once.
CELLS, CHARS = 1 << 18, 2_000_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one byte-level vocabulary file. A few megabytes; ``load`` refuses files beyond ``limit`` bytes."""

    def __init__(self, spec: dict) -> None:
        model, letters = spec["model"], byte_letters()
        ids = model["vocab"]
        back = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.base = np.array([ids[letters[b]] for b in range(256)], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.r_[True, np.diff(keys[order]) != 0]
        self.keys, self.ranks = keys[order][first], order[first].astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.by_pair = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    @classmethod
    def load(cls, path: str, limit: int = 64 << 20) -> Vocabulary:
        with open(path, "rb") as f:
            raw = f.read(limit + 1)
        if len(raw) > limit:
            raise ValueError(f"vocabulary file over {limit} bytes: {path}")
        return cls(json.loads(raw))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1; an id of -1 is in no pair."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """The ids, packed as little-endian 32-bit integers, of words of at most ``width`` (a power of 2) bytes."""
        m = len(words)
        sizes = np.fromiter(map(len, words), np.int64, m)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(m, width)
        cols = np.arange(width)
        sym = np.where(cols < sizes[:, None], self.base[raw], -1)
        nxt = np.where(cols + 1 < sizes[:, None], cols + 1, -1)
        prv = np.broadcast_to(cols - 1, (m, width)).copy()
        tree = np.full((m, 2 * width), NONE)
        rank = self.rank(sym[:, :-1], sym[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(rank >= 0, rank * width + cols[:-1], NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            i, r = root % width, root // width
            j = nxt[rows, i]
            k, p, new = nxt[rows, j], prv[rows, i], self.made[r]
            sym[rows, i], sym[rows, j], nxt[rows, i] = new, -1, k
            has = k >= 0
            prv[rows[has], k[has]] = i[has]
            right = np.where(has, sym[rows, k], -1)  # k = -1 reads a cell that the mask then hides
            left = np.where(p >= 0, sym[rows, p], -1)
            r1, r0 = self.rank(new, right), self.rank(left, new)
            tree[rows, width + j] = NONE
            tree[rows, width + i] = np.where(r1 >= 0, r1 * width + i, NONE)
            own = p >= 0
            tree[rows[own], width + p[own]] = np.where(r0 >= 0, r0 * width + p, NONE)[own]
            node = np.stack([width + i, width + j, width + np.where(own, p, i)])
            while node[0, 0] > 1:
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            rows = rows[tree[rows, 1] < NONE]
        kept = sym >= 0
        packed, ends = sym[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(1)) * 4
        starts = np.r_[0, ends[:-1]]
        return [packed[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def merge_one(self, word: bytes) -> bytes:
        """As merge_rows, for one word of any length."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        none, by_pair, made = int(NONE), self.by_pair, self.made
        sym = [int(x) for x in self.base[np.frombuffer(word, np.uint8)]]
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (r := by_pair.get(sym[i] << 32 | sym[i + 1])) is not None:
                tree[width + i] = r * width + i
        for x in range(width - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])

        def put(leaf: int, left: int, right: int) -> None:
            r = by_pair.get(left << 32 | right) if left >= 0 <= right else None
            x = width + leaf
            tree[x] = none if r is None else r * width + leaf
            while x > 1:
                x >>= 1
                a, b = tree[2 * x], tree[2 * x + 1]
                tree[x] = a if a < b else b

        while tree[1] < none:
            r, i = divmod(tree[1], width)
            j = nxt[i]
            k, p = nxt[j], prv[i]
            sym[i], sym[j], nxt[i] = int(made[r]), -1, k
            put(j, -1, -1)
            put(i, sym[i], sym[k] if k >= 0 else -1)
            if k >= 0:
                prv[k] = i
            if p >= 0:
                put(p, sym[p], sym[i])
        return np.array([s for s in sym if s >= 0], "<u4").tobytes()

    def merge_all(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8")
            width = 1 << max(1, (len(raw) - 1).bit_length())
            if width > ROWWISE:
                out[w] = self.merge_one(raw)
            else:
                groups.setdefault(width, []).append((w, raw))
        for width, own in groups.items():
            step = max(1, CELLS // (2 * width))
            for a in range(0, len(own), step):
                part = own[a : a + step]
                out.update(zip((w for w, _ in part), self.merge_rows([raw for _, raw in part], width), strict=True))
        return out


class Encoder:
    """Encodes texts with a vocabulary, remembering a bounded number of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.split = regex.compile(PRETOKEN).findall
        self.known: dict[str, bytes] = {}
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None

    def tokens(self, text: str) -> list[str]:
        """Pre-tokens; special tokens are cut out first and stay whole."""
        if self.specials is None or not self.specials.search(text):
            return self.split(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*self.split(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.split(text[at:])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= CHARS):
                size += len(texts[b])
                b += 1
            split = [self.tokens(t) for t in texts[a:b]]
            if len(self.known) > REMEMBER:
                self.known.clear()
            if not self.known:
                # a pre-token never equals a special token: those hold both letters and other characters
                self.known.update({t: np.array([i], "<u4").tobytes() for t, i in self.v.special.items()})
            new: set[str] = set()
            for toks in split:
                new.update(toks)
            self.known.update(self.v.merge_all([w for w in new if w not in self.known]))
            get = self.known.__getitem__
            for toks in split:
                yield b"".join(map(get, toks))
            a = b

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.v.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


#: One encoder per worker process and vocabulary, so that pre-tokens are remembered from task to task.
_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(shared.value)
    return _ENCODERS[shared.id]


class _Shared:
    """A broadcast vocabulary with a stable identity on the workers."""

    def __init__(self, spark, vocabulary: Vocabulary) -> None:
        self.held = spark.sparkContext.broadcast(vocabulary)
        self.id = self.held._jbroadcast.id()

    def __reduce__(self):
        return _restored, (self.held, self.id)

    @property
    def value(self) -> Vocabulary:
        return self.held.value


def _restored(held, number: int):
    out = _Shared.__new__(_Shared)
    out.held, out.id = held, number
    return out


def encode(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary): the token ids of each whole text as packed little-endian unsigned 32-bit integers.

    A null text counts as empty; empty texts give no ids; repeated rows give repeated rows; other columns are ignored.
    """
    shared = _Shared(df.sparkSession, vocabulary)
    src = pick(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared)
        for b in batches:
            ids = list(coder.encode([t or "" for t in b.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], [key, "ids"])

    return map_batches(src, run, f"`{key}` {src.schema[0].dataType.simpleString()}, ids binary")


def decode(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded): ids as made by encode, and the text they stand for, special tokens included.

    No ids, or null, give an empty text; bytes that are no UTF-8 become replacement characters; an empty table gives none.
    """
    shared = _Shared(df.sparkSession, vocabulary)
    src = pick(df, key, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared)
        for b in batches:
            texts = [coder.decode(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], [key, ids, "decoded"])

    return map_batches(src, run, f"`{key}` {src.schema[0].dataType.simpleString()}, `{ids}` binary, decoded string")


def round_trip(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): encode, then decode of the ids, in one pass, so that a task needs one Python worker."""
    shared = _Shared(df.sparkSession, vocabulary)
    src = pick(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared)
        for b in batches:
            ids = list(coder.encode([t or "" for t in b.column(1).to_pylist()]))
            texts = [coder.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], [key, "ids", "decoded"])

    return map_batches(src, run, f"`{key}` {src.schema[0].dataType.simpleString()}, ids binary, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """The contract's digest columns of encoded and decoded documents."""
    return coded.select(
        "doc_id",
        F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
