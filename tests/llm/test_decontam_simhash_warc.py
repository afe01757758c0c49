import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from locusframe.llm import decontam, simhash, warc

P = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_hits(docs, items, size):
    windows = defaultdict(set)
    for i, t in items:
        w = P.findall(low(t))
        for a in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[a : a + size])].add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, ids = P.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    ids |= windows[k]
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_hits_against_brute_force(spark, monkeypatch, block):
    rng = random.Random(1)
    monkeypatch.setattr(decontam, "SHARD_BYTES", 400)
    words = ["a", "B", "é", "d1", "x"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "-\n"]) for _ in range(n))
    items = [(i, text(rng.randrange(1, 9))) for i in range(25)] + [(90, None), (91, " .. "), (92, "zz yy"), (92, "zz yy"), (None, "qq")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(80)] + [(500, None), (501, ""), (502, "!!"), (503, "ZZ yy qq"), (503, "ZZ yy qq"), (None, "zz yy zz yy"), (504, items[3][1])]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(map(tuple, decontam.contract(decontam.mark(d, b, size=4, block_bytes=block)).collect()))
    assert got == brute_hits(docs, items, 4)
    assert sum(r.contaminated for r in decontam.contract(decontam.mark(d, b.limit(0), size=4)).collect()) == 0
    assert decontam.mark(d.limit(0), b).count() == 0
    clean = decontam.decontaminate(d.withColumn("n_chars", F.length("text").cast("long")), b, size=4, block_bytes=block)
    rows = clean.collect()
    assert all(not x[5] for x in brute_hits([(r.doc_id, r.text) for r in rows], items, 4))
    assert all(r.n_chars == len(r.text or "") or r.text is None for r in rows) and clean.columns == ["doc_id", "text", "n_words", "n_chars"]
    untouched = {i for (i, *_, bad) in brute_hits(docs, items, 4) if not bad}
    assert untouched <= {r.doc_id for r in rows}


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(2)
    runs = [rng.integers(1, 4, rng.integers(1, 40)) for _ in range(30)]
    seq = np.concatenate([np.r_[r, 0] for r in runs])
    index = decontam.FMIndex(seq, 3)
    text = "".join(map(str, seq.tolist()))
    for n in range(1, 7):
        for _ in range(30):
            p = rng.integers(1, 4, n)
            lo, hi = index.search(np.concatenate([np.zeros(8 - n, np.int64), p])[None], np.array([n]))
            want = [m.start() for m in re.finditer(f"(?={''.join(map(str, p))})", text)]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_cut():
    assert decontam.cut("One, two three-four five", [1, 3]) == "One, -four five" and decontam.cut("é x", [0, 2]) == ""
    assert decontam.merged([0, 3, 8, 9], [2, 5, 9, 12]) == [0, 5, 8, 12]


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    every = list(prints)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {f: root(f) for f in every}


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(200)) for _ in range(12)]
    texts = base + [re.sub(r"\S+$", f"z{i}", base[i % 12]) for i in range(36)] + [None, "", " \t", "A b", "a b", "a b c", "é\x1c x y z"]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (None, texts[1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = simhash.contract(simhash.near_duplicates(df)).collect()
    comp = brute_components({brute_print(t) for _, t in rows})
    least = {}
    for i, t in rows:
        r = comp[brute_print(t)]
        if i is not None:
            least[r] = min(least.get(r, i), i)
    assert Counter(map(tuple, got)) == Counter((i, f"{brute_print(t):016x}", least[comp[brute_print(t)]]) for i, t in rows)
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.near_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 32_768])
def test_links_join_all_near_fingerprints(spark, block):
    """Dense balls, chains and lone points; with tiny blocks, buckets are cut and compared block by block."""
    rng = random.Random(4)
    prints = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(40):
            f = c
            for b in rng.sample(range(64), rng.randrange(0, 4)):
                f ^= 1 << b
            prints.add(f)
    f = rng.getrandbits(64)
    for _ in range(20):  # a chain of steps of three bits
        for b in rng.sample(range(64), 3):
            f ^= 1 << b
        prints.add(f)
    prints |= {rng.getrandbits(64) for _ in range(50)} | {0, 2**64 - 1, 7}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block)
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(links)[0].collect()}
    want = brute_components(prints)
    mine, theirs = defaultdict(set), defaultdict(set)
    for x in prints:
        mine[roots.get(x, x)].add(x)
        theirs[want[x]].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    for r in links.collect():
        assert 0 < (r.a % 2**64 ^ r.b % 2**64).bit_count() <= 3


def expect(pages):
    groups, out = defaultdict(list), []
    for i, h in pages:
        groups[(h or "").encode()].append(i)
    for h, ids in groups.items():
        first = max((i for i in ids if i is not None), default=None)
        for i in ids:
            again = len(h) >= 1000 and i != first
            out.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", first if again else None))
    return Counter(out)


@pytest.mark.parametrize("few", [100_000, 0])
def test_archives(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW", few)
    big = "x\r\n\r\nWARC/1.1\r\n\r\n" * 100
    odd = [(1, "u\r\nX: y", "a"), (2, None, big), (3, "", big), (3, "", big), (None, "z", big), (7, "q", None), (8, "q", ""), (9, "q", "\n" * 1500), (10, "é", "\n" * 1500), (11, "é", "é " * 700), (12, "w", "\n" * 999), (13, "w", "\n" * 999)]
    df = spark.createDataFrame([(*r, 5) for r in odd], "page_id long, url string, html string, SIZE int")
    assert Counter(map(tuple, warc.round_trip(df).collect())) == expect([(i, h) for i, _, h in odd])
    assert warc.round_trip(df.limit(0)).count() == 0


def test_revisits_without_response_stay(spark):
    found = spark.createDataFrame([("1", "response", "a", "", 5), ("2", "revisit", "a", "1", 0), ("3", "revisit", "b", "9", 0)], "id string, type string, digest string, refers string, size bigint")
    assert {tuple(r) for r in warc.resolve(found).collect()} == {(1, 5, "a", "response", None), (2, 5, "a", "revisit", 1), (3, None, "b", "revisit", 9)}


def test_damaged_archives_are_refused():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert [b for _, b in warc.records(iter([head[:9], head[9:]]))] == [b"abcd"]
    for bad in (head[:-6], b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.records(iter([bad])))
