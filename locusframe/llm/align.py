"""Alignment of two tokenizers' tokens of the same text by the byte offsets at which both end.

Python runs the two tokenizers and lays their tokens side by side (numpy, over all texts of a batch at once): offsets that are
ends on both sides cut a text into groups, and the last tokens of a group, which end together, are linked. Spark counts the
links of the whole corpus and gives each row the counts of its own. As linked tokens end at the same byte, the shorter
one's bytes end the longer one's: the vocabularies alone bound how many different pairs there can be
(``Pair.most_links``), whatever the corpus.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.genotypes import let
from .bpe import PRETOKEN, Vocabulary
from .common import map_batches, materialize, pick

#: A single space that has no white space on either side. No token of either vocabulary reaches over its left side, so that
#: long texts can be tokenised in parts, each with a space before it.
_SEAM = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a part, and of the texts whose tokens travel together.
PART, AT_ONCE = 100_000, 1_000_000
#: Most rows of pair counts that are broadcast; vocabularies that allow more are joined by shuffle.
BROADCAST = 4_000_000


class Pair:
    """A byte-level BPE vocabulary file (A) and a sentence-piece model with byte fallback (B), as bytes of bounded size."""

    def __init__(self, path_a: str, path_b: str, limit: int = 64 << 20) -> None:
        self.raw = []
        for path in (path_a, path_b):
            with open(path, "rb") as f:
                self.raw.append(f.read(limit + 1))
            if len(self.raw[-1]) > limit:
                raise ValueError(f"vocabulary file over {limit} bytes: {path}")

    def tokenizers(self) -> Tokenizers:
        return Tokenizers(*self.raw)

    def most_links(self) -> int:
        """How many pairs of an A and a B token end alike, one being the other's end: no more can ever be linked."""
        t = self.tokenizers()
        a, b = Counter(t.bytes_a), Counter(t.bytes_b)
        ends = lambda x, start: (x[i:] for i in range(start, len(x)))
        return sum(n * sum(b[y] for y in ends(x, 0)) for x, n in a.items()) + sum(n * sum(a[y] for y in ends(x, 1)) for x, n in b.items())


class Tokenizers:
    """Both tokenizers of a Pair, loaded, with the bytes that each id stands for."""

    def __init__(self, raw_a: bytes, raw_b: bytes) -> None:
        import sentencepiece

        vocabulary = Vocabulary(json.loads(raw_a))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=raw_b)
        self.bytes_a = vocabulary.bytes
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.encode_a = self._fast(vocabulary) or self._plain(raw_a)
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int32, len(x)) for x in (self.bytes_a, self.bytes_b))
        #: Holds any link, which is ``a * B's vocabulary size + b``.
        self.link = np.int32 if len(self.bytes_a) * len(self.bytes_b) < 1 << 31 else np.int64
        # ids as decimals, with what follows them: A's within and at the end of a group, B's within, at the end, and in the last group
        shown = [f"{i}{after}".encode() for n, after in ((len(self.bytes_a), ","), (len(self.bytes_a), "|"), *((len(self.bytes_b), x) for x in (",", ";", ""))) for i in range(n)]
        self.shown_size = np.fromiter(map(len, shown), np.int64, len(shown))
        self.shown = np.array(shown).view(np.uint8).reshape(len(shown), -1)
        #: No piece holds a space after another character, so that no merge reaches over a seam.
        self.seams = not any(" " in p.decode("utf-8", "replace").lstrip(" ") for p in self.bytes_b)

    @staticmethod
    def _fast(vocabulary: Vocabulary) -> Callable[[str], list[int]] | None:
        """Where ids rise with the merges, they are ranks, and a rank encoder gives the same ids several times faster."""
        own = {b: i for i, b in enumerate(vocabulary.bytes) if i not in set(vocabulary.special.values())}
        if not (np.diff(vocabulary.made) > 0).all() or len(own) != 256 + len(vocabulary.made) or vocabulary.base.max() > vocabulary.made.min():
            return None
        import tiktoken

        return tiktoken.Encoding("pair", pat_str=PRETOKEN, mergeable_ranks=own, special_tokens={}).encode_ordinary

    @staticmethod
    def _plain(raw: bytes) -> Callable[[str], list[int]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(raw.decode())
        own.encode_special_tokens = True
        own.no_truncation()
        own.no_padding()
        return lambda text: own.encode(text, add_special_tokens=False).ids

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def parts(self, text: str) -> list[str]:
        """The text in parts of about PART characters, cut before single spaces, which are dropped."""
        if len(text) <= PART or not self.seams:
            return [text]
        out, at = [], 0
        while len(text) - at > PART and (m := _SEAM.search(text, at + PART)):
            out.append(text[at : m.start()])
            at = m.end()
        return [*out, text[at:]]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids by A and by B of the text with a space before it; none of either where the tokens' bytes are not the text's."""
        ids_a: list[int] = []
        ids_b: list[int] = []
        for part in self.parts(text) if text else ():
            ids_a += self.encode_a(" " + part)
            ids_b += self.b.encode(part)
        raw = (" " + text).encode() if text else b""
        if not b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b)):
            ids_a, ids_b = [], []
        return np.array(ids_a, np.int32), np.array(ids_b, np.int32)


#: One pair of tokenizers per worker process.
_LOADED: dict[int, Tokenizers] = {}


def _loaded(held) -> Tokenizers:
    number = hash(held.value[0]) ^ hash(held.value[1])
    if number not in _LOADED:
        _LOADED.clear()
        _LOADED[number] = Tokenizers(*held.value)
    return _LOADED[number]


class Aligned:
    """The tokens of some texts by both tokenizers, laid side by side; the columns of ``align`` as Arrow arrays.

    The tokens of all texts stand in one array a side. Both sides give back the same bytes, so that offsets counted over all the
    texts agree at every border, and no group reaches over one.
    """

    def __init__(self, both: Tokenizers, ids: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.both = both
        self.ids = [np.concatenate([x[side] for x in ids]) for side in (0, 1)]
        self.at = [np.cumsum([0, *[len(x[side]) for x in ids]]) for side in (0, 1)]
        self.ends = [np.cumsum(size[x], dtype=np.int64) for size, x in zip((both.size_a, both.size_b), self.ids, strict=True)]
        n = int(self.ends[0][-1]) if len(self.ends[0]) else 0
        #: For each token whether it closes a group: whether a token of the other side ends with it.
        self.closes = [self._among(self.ends[0], self.ends[1], n), self._among(self.ends[1], self.ends[0], n)]

    @staticmethod
    def _among(ends: np.ndarray, others: np.ndarray, n: int) -> np.ndarray:
        found = np.zeros(n + 1, bool)
        found[others] = True
        return found[ends]

    def _lists(self, flat: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
        kind = pa.from_numpy_dtype(flat.dtype)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)).cast(pa.list_(pa.field("element", kind, nullable=False)))

    def _tokens(self, side: int) -> pa.ListArray:
        return self._lists(self.ids[side], self.at[side])

    def _marks(self, side: int) -> pa.ListArray:
        at, ends = self.at[side], self.ends[side]
        before = np.repeat(np.r_[0, ends][at[:-1]], np.diff(at))
        return self._lists((2 * (ends - before) + self.closes[side]).astype(np.int32), at)

    def _links(self) -> pa.ListArray:
        a, b = (ids[closes].astype(self.both.link) for ids, closes in zip(self.ids, self.closes, strict=True))
        return self._lists(a * self.both.link(len(self.both.bytes_b)) + b, np.r_[0, np.cumsum(self.closes[0])][self.at[0]])

    def _spelled(self) -> pa.BinaryArray:
        (a, b), (closes_a, closes_b), at = self.ids, self.closes, self.at
        n_a, n_b = len(self.both.bytes_a), len(self.both.bytes_b)
        # a token's place: those of its own side before it, and those of the other in the groups before (for B: also in its own)
        places_a = np.arange(len(a)) + np.r_[0, np.flatnonzero(closes_b) + 1][np.cumsum(closes_a) - closes_a]
        places_b = np.arange(len(b)) + (np.flatnonzero(closes_a) + 1)[np.cumsum(closes_b) - closes_b]
        last = np.zeros(len(b), bool)
        last[at[1][1:][np.diff(at[1]) > 0] - 1] = True
        rows = np.empty(len(a) + len(b), np.int64)
        rows[places_a] = a + n_a * closes_a
        rows[places_b] = 2 * n_a + b + n_b * (closes_b.astype(np.int64) + last)
        ends = np.r_[0, np.cumsum(self.both.shown_size[rows])][at[0] + at[1]]
        if ends[-1] >= 1 << 31:
            raise ValueError(f"{ends[-1]} bytes of groups: more than a binary value of Spark holds")
        flat = self.both.shown[rows].tobytes().translate(None, b"\0")
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])

    def column(self, name: str) -> pa.Array:
        return {
            "a": lambda: self._tokens(0), "a_marks": lambda: self._marks(0), "b": lambda: self._tokens(1), "b_marks": lambda: self._marks(1),
            "n_a": lambda: pa.array(np.diff(self.at[0])), "n_b": lambda: pa.array(np.diff(self.at[1])), "links": self._links, "spelled": self._spelled,
        }[name]()


def align(df: DataFrame, pair: Pair, key: str = "doc_id", text: str = "text", give: tuple[str, ...] = ("a", "a_marks", "b", "b_marks", "links")) -> DataFrame:
    """(key, a, a_marks, b, b_marks, links) for each row: the ids by both tokenizers; for each token twice the byte offset at
    which it ends, one more where a token of the other ends as well, which closes a group; and the pairs of ids that end together.

    links: array of ``a * B's vocabulary size + b`` in order of the text. ``groups`` spells the groups out. Texts that are
    null, empty or not given back by both tokenizers' tokens have empty arrays. Repeated rows give repeated rows; an empty
    table gives none; other columns, whatever their names, are ignored. Long texts are tokenised in parts; a text without any
    single space is one part, whatever its length.

    give: the columns to be made beside the key, as Spark cannot leave out what a task of Python makes. There are also n_a and
    n_b, the numbers of tokens, and spelled, the groups as ``spelled()`` gives them, in ASCII bytes.
    """
    held = df.sparkSession.sparkContext.broadcast(pair.raw)
    src = pick(df, key, text)
    kinds = dict.fromkeys(("a", "a_marks", "b", "b_marks"), T.ArrayType(T.IntegerType(), False)) | dict.fromkeys(("n_a", "n_b"), T.LongType())
    kinds |= {"links": T.ArrayType(T.IntegerType() if pair.tokenizers().link is np.int32 else T.LongType(), False), "spelled": T.BinaryType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _loaded(held)
        for b in batches:
            texts = b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, n = at, 0
                while to < len(texts) and (to == at or n + len(texts[to] or "") <= AT_ONCE):
                    n += len(texts[to] or "")
                    to += 1
                found = Aligned(both, list(map(both.encode, texts[at:to])))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), *map(found.column, give)], [key, *give])
                at = to

    return map_batches(src, run, T.StructType([T.StructField(key, src.schema[0].dataType), *[T.StructField(c, kinds[c]) for c in give]]))


def groups() -> Column:
    """The groups of a row of ``align`` as an array of struct(a, b), arrays of ids."""
    places = lambda c: F.concat(F.array(F.lit(0)), F.array_remove(F.transform(c, lambda x, i: (x % 2) * (i + 1)), 0))

    def one(at: Column, g: Column) -> Column:
        own = lambda x, c: F.slice(x, F.get(at[c], g - 1) + 1, F.get(at[c], g) - F.get(at[c], g - 1)).alias(x)
        return F.struct(own("a", "a_at"), own("b", "b_at"))

    # bound first: Catalyst must not put the places into every call
    bound = F.struct(places("a_marks").alias("a_at"), places("b_marks").alias("b_at"))
    made = let(bound, lambda at: F.transform(F.sequence(F.lit(1), F.size(at["a_at"]) - 1), lambda g: one(at, g)))
    return F.when(F.size("a_marks") > 0, made).otherwise(F.array())


def spelled() -> Column:
    """The groups of a row of ``align`` as text: ``a1,a2|b1;a3|b2,b3``. The tokens of each side are joined once, groups told apart
    by their mark, so that no group is sliced out. ``align`` can give the same as a column, without a lambda for each token."""
    joined = lambda c: F.array_join(F.zip_with(c, f"{c}_marks", lambda x, m: F.concat(x.cast("string"), F.when(m % 2 == 1, ";").otherwise(","))), "")
    side = lambda c: F.split(F.rtrim(joined(c), F.lit(";")), ";")
    return F.array_join(F.zip_with(side("a"), side("b"), lambda x, y: F.concat(x, F.lit("|"), y)), ";")


def pair_counts(linked: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): how many links hold each pair, and whether that is the most of any pair with its B id."""
    counts, _ = materialize(linked.select(F.explode("links").alias("pair")).select(F.col("pair").cast("bigint")).groupBy("pair").agg(F.count(F.lit(1)).alias("count")), "align-pairs")
    most = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("count").alias("most"))
    return counts.join(most, F.col("pair") % size_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def score(df: DataFrame, pair: Pair, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row, by counts over all rows.

    Edge cases as in ``align``; such a row has zeros and an empty digest.
    """
    size = pair.tokenizers().b.get_piece_size()
    linked = F.size("links").cast("bigint")
    rows = align(df, pair, key, text, ("n_a", "n_b", "links", "spelled")).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), "links", "n_a", "n_b", linked.alias("n_groups"), linked.alias("n_links"),
        F.when(F.col("n_a") > 0, F.sha2("spelled", 256)).otherwise(F.lit("")).alias("groups_sha256"),
    )
    rows, _ = materialize(rows, "align-links")
    counts = pair_counts(rows, size)
    counts = F.broadcast(counts) if pair.most_links() <= BROADCAST else counts
    sums = rows.select("row", F.explode("links").alias("pair")).withColumn("pair", F.col("pair").cast("bigint")).join(counts, "pair").groupBy("row").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return rows.drop("links").join(sums, "row", "left").select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
