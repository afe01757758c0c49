"""Digests of columns and blocks, and encryption of columns."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotypes import GT_TYPE, let
from .blocks import blocks, kept


def column_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, digest): rows, and as text the sum of the first 60 bits of the values' MD5, for each column.

    The order of rows does not matter, and no number of rows overflows the decimal sum. Values are taken as Spark prints
    them; null counts as the empty text with a mark before it.
    """
    one = lambda c: F.concat(F.when(F.col(c).isNull(), F.lit("n:")).otherwise(F.lit("v:")), F.coalesce(F.col(c).cast("string"), F.lit("")))
    number = lambda c: F.conv(F.substring(F.md5(one(c).cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(number(c)), F.lit(0)).cast("string").alias(f"d{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n"), F.col(f"d{i}").alias("digest")) for i, c in enumerate(columns)])
    return sums.select(F.inline(rows))


def _digest(values: Column, bits: int) -> Column:
    return F.sha2(F.array_join(values, "\n").cast("binary"), bits)


def block_digest(df: DataFrame, columns: Sequence[str], bits: int = 512, **sizes: int) -> DataFrame:
    """(seq, block_id, column, sha<bits>) over a block's values in position order; a block's rows are bounded by its definition."""
    b = blocks(df, **sizes)
    out = b.groupBy("seq", "block_id").agg(*[F.array_sort(F.collect_list(F.struct("pos", F.col("alleles").cast("string").alias("o"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")))).alias(f"l{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), _digest(F.transform(f"l{i}", lambda x: x["v"]), bits).alias(f"sha{bits}")) for i, c in enumerate(columns)])
    return out.select("seq", "block_id", F.inline(rows))


def digest_tree(df: DataFrame, columns: Sequence[str], bits: int = 512, fan: int = 256, **sizes: int) -> DataFrame:
    """(column, level, node, digest): level 0 has the digests of blocks by seq, and each node above that of at most ``fan``
    below it, joined by line feeds in their order; the last level has one node for each column.

    No list is longer than ``fan``, however many blocks there are.
    """
    level = kept(block_digest(df, columns, bits, **sizes).select("column", F.lit(0).alias("level"), F.col("seq").alias("node"), F.col(f"sha{bits}").alias("digest")), "digest-level")
    tree, last = level, level.agg(F.max("node")).first()[0]
    while last:
        up = level.groupBy("column", (F.col("level") + 1).alias("level"), F.floor(F.col("node") / fan).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("own"))
        level = kept(up.select("column", "level", F.col("parent").alias("node"), _digest(F.transform("own", lambda x: x["digest"]), bits).alias("digest")), "digest-level")
        tree, last = tree.unionByName(level), last // fan
    return tree


def column_digests(df: DataFrame, columns: Sequence[str], bits: int = 512, fan: int = 256, **sizes: int) -> DataFrame:
    """(column, n_blocks, sha<bits>): the root of each column's ``digest_tree``."""
    tree = digest_tree(df, columns, bits, fan, **sizes)
    top = F.max_by("digest", "level").alias(f"sha{bits}")
    return tree.groupBy("column").agg(F.count_if(F.col("level") == 0).alias("n_blocks"), top)


def column_sha512(df: DataFrame, columns: Sequence[str], **sizes: int) -> DataFrame:
    """(column, n_blocks, sha512) of each column, as ``column_digests``."""
    return column_digests(df, columns, **sizes)


def digest_proof(tree: DataFrame, column: str, seq: int, fan: int = 256) -> list[tuple[int, list[str]]]:
    """For each level but the last: the place of the block's node among its siblings, and their digests, at most fan of them.

    Whoever trusts the root can check one block by them (``proves``), without any other block.
    """
    own = tree.where((F.col("column") == column) & (F.floor(F.col("node") / fan) == F.floor(F.lit(seq) / F.pow(F.lit(float(fan)), F.col("level") + 1))))
    rows = own.groupBy("level").agg(F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("own")).orderBy("level").collect()
    return [(seq // fan**r.level % fan, [x.digest for x in r.own]) for r in rows[:-1]]


def proves(proof: Sequence[tuple[int, Sequence[str]]], digest: str, root: str) -> bool:
    """Whether a block's digest is part of a root. A block that is the only one is its own root."""
    bits = {64: "sha256", 128: "sha512"}[len(root)]
    for place, siblings in proof:
        if place >= len(siblings) or siblings[place] != digest:
            return False
        digest = hashlib.new(bits, "\n".join(siblings).encode()).hexdigest()
    return digest == root


def changed_blocks(a: DataFrame, b: DataFrame, fan: int = 256) -> DataFrame:
    """(column, seq) of the blocks in which two trees of equal shape differ, found from the roots down: below equal nodes nothing is looked at."""
    top = max(t.agg(F.max("level")).first()[0] or 0 for t in (a, b))
    found = None
    for level in range(top, -1, -1):
        x, y = (t.where(F.col("level") == level).select("column", "node", F.col("digest").alias(n)) for t, n in ((a, "a"), (b, "b")))
        if found is not None:
            above = found.withColumnRenamed("node", "parent")
            x, y = (t.join(above, (t["column"] == above["column"]) & (F.floor(t["node"] / fan) == above["parent"]), "left_semi") for t in (x, y))
        found = kept(x.join(y, ["column", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("column", "node"), "digest-changed")
    return found.withColumnRenamed("node", "seq")


def new_keychain(columns: Sequence[str]) -> dict[str, bytes]:
    """A fresh 256-bit key for each column."""
    return {c: os.urandom(32) for c in columns}


def merge_keychains(*chains: Mapping[str, bytes]) -> dict[str, bytes]:
    """All keys together; two different keys for a column are an error."""
    out: dict[str, bytes] = {}
    for chain in chains:
        for c, k in chain.items():
            if out.setdefault(c, k) != k:
                raise ValueError(f"two keys for column {c!r}")
    return out


def keychain_to_json(keys: Mapping[str, bytes]) -> str:
    return json.dumps({c: k.hex() for c, k in keys.items()})


def keychain_from_json(text: str) -> dict[str, bytes]:
    return {c: bytes.fromhex(k) for c, k in json.loads(text).items()}


def _keys(df: DataFrame, keys: Mapping[str, bytes]) -> dict[str, Column]:
    """Keys as scalar subqueries over a table of one row: plans, and what logs them, show that there is one, not its value."""
    table = df.sparkSession.createDataFrame([tuple(map(bytearray, keys.values()))], ", ".join(f"k{i} binary" for i in range(len(keys))))
    return {c: table.select(f"k{i}").scalar() for i, c in enumerate(keys)}


#: Columns that ciphertexts are bound to, where a table has them in the clear.
BIND = ("contig", "pos")


def _bound(df: DataFrame, column: str, keys: Mapping[str, bytes]) -> Column:
    """What a ciphertext is authenticated with: its column, and the row's place. Moved elsewhere it cannot be read."""
    return F.concat_ws("\x1f", F.lit(column), *[F.col(c).cast("string") for c in BIND if c in df.columns and c not in keys])


def encrypt(df: DataFrame, keys: Mapping[str, bytes]) -> DataFrame:
    """Columns replaced by AES-256-GCM ciphertexts of their JSON texts, each value with a fresh vector and bound to its column,
    contig and position; null stays null. Whoever decrypts needs those columns as they were."""
    wrap = lambda c: F.to_json(F.struct(F.col(c).alias("v"))).cast("binary")
    own = _keys(df, keys)
    locked = lambda c: F.aes_encrypt(wrap(c), own[c], F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), _bound(df, c, keys).cast("binary"))
    return df.withColumns({c: F.when(F.col(c).isNotNull(), locked(c)) for c in keys})


def decrypt(df: DataFrame, keys: Mapping[str, bytes], types: Mapping[str, str], on_error: str = "raise") -> DataFrame:
    """Columns made by encrypt as they were. A wrong key, damaged data, or a ciphertext of another column or place is an error;
    with on_error="null" its value is null."""
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error is raise or null, not {on_error!r}")
    own = _keys(df, keys)
    open_ = F.aes_decrypt if on_error == "raise" else F.try_aes_decrypt
    opened = lambda c: open_(F.col(c), own[c], F.lit("GCM"), F.lit("DEFAULT"), _bound(df, c, keys).cast("binary"))
    return df.withColumns({c: F.from_json(F.when(F.col(c).isNotNull(), opened(c)).cast("string"), f"v {types[c]}")["v"] for c in keys})


def genotype_runs(gt: str = "gt") -> Column:
    """Run-length form: struct(n, a, p) for neighbouring samples with equal calls. One walk finds where runs begin."""
    g = F.coalesce(F.col(gt), F.array().cast(GT_TYPE))
    places = F.sequence(F.lit(0), F.greatest(F.size(g) - 1, F.lit(0)))
    starts = F.when(F.size(g) > 0, F.filter(places, lambda i: (i == 0) | ~F.get(g, i).eqNullSafe(F.get(g, F.greatest(i - 1, F.lit(0)))))).otherwise(F.array().cast("array<int>"))

    def run(s: Column) -> Column:
        return F.transform(s, lambda i, k: F.struct((F.coalesce(F.get(s, k + 1), F.size(g)) - i).alias("n"), F.get(g, i)["a"].alias("a"), F.get(g, i)["p"].alias("p")))

    return let(starts, run)


def expand_runs(runs: str) -> Column:
    """One call for each sample again."""
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(F.struct(r["a"].alias("a"), r["p"].alias("p")), r["n"])))
