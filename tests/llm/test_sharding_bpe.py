import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from locusframe.llm import bpe, sharding

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

ODD = ["", None, " ", "a" * 300, "<|endoftext|>x <|endoftext|>  y", "日本語  テスト\n\n x", "é" * 70 + " 's'll don't", "\x00\x1c \t x", "ab" * 400, "😀😀 1234567890" * 9, "tie tie", "tie tie", "x y   z  "]


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_and_slots(spark):
    rows = [(i, f"text {i}") for i in range(3000)] + [(None, None), (7, "text 7"), (7, "other"), (-5, ""), (2**63 - 1, "é")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, shard int, TEXT string")
    got = sharding.shard(df, 40, pieces=4).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode()), "key") for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        key = 42 if r.doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)
        assert (r.shard, r.grown_shard) == (jump(key, 40), jump(key, 41)) and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 0.5 < sum(r.grown_shard == 40 for r in got) / (len(got) / 41) < 1.6
    assert sharding.shard(df.limit(0)).count() == 0


def test_rows_repeated_whole_are_spread(spark):
    rows = [(i, f"text {i}") for i in range(50)] + [(11, "hot")] * 500 + [(None, None)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1, 7, 4096):
        got = sharding.shard(df, 4, pieces=8, most=most).collect()
        assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
        for s in range(4):
            own = sorted(r.slot for r in got if r.shard == s)
            assert own == list(range(len(own)))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(P.path("byte_bpe_50k.json"))


def test_bpe_equals_library(spark, vocabulary):
    lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    random.seed(3)
    texts = ODD + ["".join(random.choice("abcdeé ßX.,'\n#|01") for _ in range(random.randrange(200))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = df.withColumn("ids", df["text"]).withColumn("decoded", df["text"])
    for r in bpe.round_trip(df, vocabulary).collect():
        t = texts[r.doc_id] or ""
        ids = lib.encode(t, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == ids
        assert r.decoded == lib.decode(ids, skip_special_tokens=False) == t
    d = {r.doc_id: r for r in bpe.digests(bpe.round_trip(df, vocabulary)).collect()}
    t = texts[4]
    assert d[4].ids_sha256 == hashlib.sha256(struct.pack(f"<{d[4].n_tokens}I", *lib.encode(t, add_special_tokens=False).ids)).hexdigest()
    assert d[4].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and d[0].n_tokens == d[1].n_tokens == 0
    assert bpe.round_trip(df.limit(0), vocabulary).count() == 0


def test_one_tree_equals_rows_of_trees(vocabulary):
    random.seed(5)
    words = [bytes(random.choice(b"abcdehinorst ") for _ in range(random.randrange(1, 65))) for _ in range(400)]
    assert vocabulary.merge_rows(words, 64) == [vocabulary.merge_one(w) for w in words]


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 5)
    monkeypatch.setattr(bpe, "CHARS", 30)
    texts = ["one two three four five six <|endoftext|>", "seven eight nine ten", "one two"] * 3
    a, b = bpe.Encoder(vocabulary), [next(iter(bpe.Encoder(vocabulary).encode([t]))) for t in texts]
    assert list(a.encode(texts)) == b


def test_file_size_is_checked(tmp_path):
    (tmp_path / "v.json").write_text("x" * 100)
    with pytest.raises(ValueError):
        bpe.Vocabulary.load(str(tmp_path / "v.json"), limit=50)
