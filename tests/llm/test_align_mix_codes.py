"""Tokenizer alignment, mixing and vector codes against plain loops over small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import align, mixing, vectorcodes
from locusframe.llm.queries import tokenizer_path

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def pair():
    return align.Pair(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "The quick brown fox jumps over the lazy dog.", "", None, " ", "  two  spaces ", "tab\tand\nline\r\n", "ein Ärgernis für Größe",
    "汉字 und 😀 emoji 👩‍👩‍👧", "▁x is not given back", "<s> </s> <|endoftext|> <unk> <0x41>", "a", "ﬁ ① é", "x" * 3000, "naïve café " * 40, "\x00\x01 control",
]


def aligned(pair, texts):
    """Groups, links and their counts by a walk over the bytes of each text."""
    t = pair.tokenizers()
    plain, found = t._plain(pair.raw[0]), []
    for text in texts:
        groups, links = [], []
        if text:
            ids_a, ids_b = plain(" " + text), t.b.encode(text)
            if b"".join(t.bytes_a[i] for i in ids_a) == b"".join(t.bytes_b[i] for i in ids_b) == (" " + text).encode():
                i = j = end_a = end_b = 0
                a, b = [], []
                while i < len(ids_a) or j < len(ids_b):
                    if end_a <= end_b:
                        a.append(ids_a[i])
                        end_a, i = end_a + len(t.bytes_a[ids_a[i]]), i + 1
                    else:
                        b.append(ids_b[j])
                        end_b, j = end_b + len(t.bytes_b[ids_b[j]]), j + 1
                    if end_a == end_b:
                        groups.append((a, b))
                        links.append((a[-1], b[-1]))
                        a, b = [], []
        found.append((groups, links))
    count = Counter(x for _, links in found for x in links)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for groups, links in found:
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sums = sum(count[x] for x in links)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sums, hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out, max(count.values())


def test_alignment_is_that_of_a_walk_over_bytes(spark, pair):
    rows = [(i, t, "z", 1) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, Text string, a int")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        got = sorted(map(tuple, align.score(df, pair).collect()))
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    theirs, _ = aligned(pair, TEXTS)
    assert got == [(i, *x) for i, x in enumerate(theirs)]
    assert {got[i][7] for i in (2, 3, 9)} == {""} and got[10][4] > 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_alignment_of_the_documents(spark, pair):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    theirs, _ = aligned(pair, [r.text for r in rows])
    assert sorted(map(tuple, align.score(df, pair).collect())) == sorted((r.doc_id, *x) for r, x in zip(rows, theirs, strict=True))


def test_groups_spelled_out(spark, pair):
    df = align.align(spark.createDataFrame([(1, "a stitch in time"), (2, "")], "doc_id bigint, text string"), pair)
    one, none = df.select(align.groups().alias("g"), align.spelled().alias("s")).collect()
    assert one.s == ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in one.g) and len(one.g) >= 4
    assert none.g == [] and not none.s.strip("|")


def test_groups_are_spelled_as_array_functions_do(spark, pair):
    df = spark.createDataFrame([*enumerate([*TEXTS, *TEXTS[::-1], "", "last"]), (99, None)], "doc_id bigint, text string").coalesce(1)
    columns = ("n_a", "n_b", "spelled", "a", "a_marks", "b", "b_marks", "links")
    rows = align.align(df, pair, give=columns).select("*", align.spelled().alias("s"), F.size(align.groups()).alias("n")).collect()
    assert len(rows) == 2 * len(TEXTS) + 3 and sum(r.n > 1 for r in rows) > 10
    for r in rows:
        assert (r.n_a, r.n_b, len(r.links)) == (len(r.a), len(r.b), r.n)
        assert r.spelled.decode() == (r.s if r.n_a else "")


def test_texts_of_a_batch_are_aligned_as_alone(pair):
    t = pair.tokenizers()
    columns = ("n_a", "n_b", "spelled", "a", "a_marks", "b", "b_marks", "links")
    for link in (np.int32, np.int64):  # the other is for larger vocabularies
        t.link = link
        for texts in ([*TEXTS, *TEXTS[::-1], "", "last"], [None, ""], ["one"]):
            ids = [t.encode(x) for x in texts]
            whole, own = align.Aligned(t, ids), [align.Aligned(t, [x]) for x in ids]
            for c in columns:
                assert whole.column(c).to_pylist() == [x.column(c).to_pylist()[0] for x in own]
            assert whole.column("links").type.value_type.bit_width == 8 * link().itemsize


def test_no_lambda_is_run_for_each_token(spark, pair, monkeypatch):
    plans = []
    monkeypatch.setattr(align, "materialize", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), (df, ""))[1])
    align.score(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), pair)
    assert len(plans) == 2 and "MapInArrow" in plans[0] and not any(x in p for p in plans for x in ("lambda", "array_intersect", "array_except", "sort_array"))


def test_long_texts_are_tokenised_alike_in_parts(pair, monkeypatch):
    t = pair.tokenizers()
    text = "Some words, 12 34 and don't stop;  here é ist 汉字 und so weiter ▁ \u2003x  y\n z" * 60
    for own in (text, text.replace("▁", "")):
        whole = [x.tolist() for x in t.encode(own)]
        monkeypatch.setattr(align, "PART", 50)
        assert len(t.parts(own)) > 20 and " ".join(t.parts(own)) == own
        assert [x.tolist() for x in t.encode(own)] == whole
        monkeypatch.undo()
    assert whole[0] and t.parts("x" * 500_000) == ["x" * 500_000]


def test_rank_encoder_is_the_tokenizers_library(pair):
    t = pair.tokenizers()
    plain = t._plain(pair.raw[0])
    for text in TEXTS:
        assert t.encode_a(" " + (text or "")) == plain(" " + (text or ""))


def test_alignment_of_nothing_and_its_bound(spark, pair):
    assert align.score(spark.createDataFrame([], "doc_id bigint, text string"), pair).collect() == []
    t = pair.tokenizers()
    assert align.Pair.most_links(pair) < align.BROADCAST
    same = [(x, y) for x in t.bytes_a[1000:1200] for y in t.bytes_b[300:600] if x.endswith(y) or y.endswith(x)]
    assert same and len(same) <= pair.most_links()


# mixing


def seated(votes, most, seats):
    """Sainte-Laguë by one highest quotient after another."""
    given = [0] * len(votes)
    for _ in range(min(seats, sum(most))):
        i = max((i for i in range(len(votes)) if given[i] < most[i]), key=lambda i: (votes[i] / (2 * given[i] + 1), -i))
        given[i] += 1
    return given


def test_apportionment_is_by_highest_quotients():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 12))
        votes = rng.integers(0, 40, n) * int(rng.integers(1, 500))
        most = rng.integers(0, 60, n)
        for seats in (0, 1, n, int(rng.integers(0, 300))):
            assert mixing.apportion(votes, most, seats).tolist() == seated(votes.tolist(), most.tolist(), seats)


def shared(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing what is above the most again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, w = total - sum(fixed.values()), sum(weigh[s] for s in names if s not in fixed)
        now = {s: fixed[s] if s in fixed else left * weigh[s] / w for s in names}
        above = [s for s in names if s not in fixed and now[s] > most * sizes[s]]
        if not above:
            return now
        fixed |= {s: most * sizes[s] for s in above}


def mixed(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, Size int, shard int")
    return mixing.mix(df, **how).collect()


def check_mix(rows, got, block):
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target = shared(dict(sizes))
    took = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size and math.isclose(r.target, target[r.source], rel_tol=1e-12)
        took[r.source] += r.taken
    for s in sizes:
        assert abs(took[s] - target[s]) <= block + 0.01 * target[s], (s, took[s], target[s], sizes[s])
    assert sorted(map(repr, ((r.doc_id, r.source, r.size) for r in got))) == sorted(map(repr, ((d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s, *_ in rows)))


def rows_of(n=400):
    rng = np.random.default_rng(3)
    names = ["a", "ä", "Z", "hot", "hot", "hot", "tiny", None, "🙂", "￿"]
    rows = [(i, "w " * int(rng.integers(0, 300)), names[i % len(names)], 1, 2) for i in range(n)]
    rows = [(i, ("one two" if s == "tiny" else t), s, a, b) for i, t, s, a, b in rows]
    return [*rows, (None, "x y z", "a", 1, 1), (7, None, "a", 1, 1), (8, "", "none", 1, 1), (9, " \t\n", "none", 1, 1), *[(500, "same words here", "hot", 1, 1)] * 50]


def test_mix_meets_its_targets(spark):
    rows = rows_of()
    check_mix(rows, mixed(spark, rows, block=8), 8)


def test_mix_over_many_shards_and_lots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 600)
    monkeypatch.setattr(mixing, "LOT", 7)
    rows = rows_of()
    got = mixed(spark, rows, block=8)
    assert len({r.shard for r in got if r.source == "hot"}) > 5
    check_mix(rows, got, 8 * 40)  # half a block for each of the shards at most
    again = mixed(spark, rows[::-1], block=8)
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    other = mixed(spark, rows, block=8, seed=1)
    assert sorted(map(repr, got)) != sorted(map(repr, other))
    for shard in {r.shard for r in got if r.source == "hot"}:  # a shard gives its quota of blocks
        own = [r for r in got if r.source == "hot" and r.shard == shard]
        words, blocks, quota = sum(r.size for r in own), own[0].blocks, own[0].quota
        assert abs(sum(r.taken for r in own) - quota * words / max(blocks, 1)) <= max(blocks, 1)


def test_targets_of_few_and_many_sources(spark):
    for sizes in ({"a": 0}, {None: 5}, {"a": 1, "b": 1000, "c": 3, "d": 0, "e": 7, "f": 90}, {f"s{i:03}": (i * 37) % 101 for i in range(150)}):
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size bigint, lots bigint").repartition(3)
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        theirs = shared(sizes)
        assert got.keys() == theirs.keys() and all(math.isclose(got[s], theirs[s], rel_tol=1e-12) for s in got)


def test_mix_of_nothing(spark):
    assert mixed(spark, []) == []
    assert [(r.size, r.taken, r.target) for r in mixed(spark, [(1, None, None, 1, 1)])] == [(0, 0, 0.0)]


# vector codes


def coded(vectors, labels, parts=16, size=64, rounds=2):
    """Codes by comparing all integers; vectors of one length, in order of their ids."""
    x = [[math.floor(256 * v) for v in row] for row in vectors]
    w = len(x[0]) // parts
    cut = [[row[p * w : p * w + w] for p in range(parts)] for row in x]
    books = [[row[p] for row in cut[:size]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    near = lambda p, a: min((far(a, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for row in cut:
                own[near(p, row[p])[1]].append(row[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else b for e, b in enumerate(books[p])]
    found = [[near(p, row[p]) for p in range(parts)] for row in cut]
    error = [sum(d for d, _ in f) for f in found]
    total = defaultdict(int)
    for e, lab in zip(error, labels, strict=True):
        total[lab] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return [("".join(f"{e:02x}" for _, e in f), err, total[lab], digest) for f, err, lab in zip(found, error, labels, strict=True)]


def test_codes_are_those_of_all_distances(spark):
    rng = np.random.default_rng(2)
    vectors = np.round(rng.normal(size=(180, 48)), 1).astype(np.float32)  # rounded: ties and empty entries
    vectors[5] = vectors[4]
    vectors[100:130] = vectors[3]
    labels = [None if i % 5 == 0 else i % 3 for i in range(180)]
    bad = [(1000, None, 1, 0), (1001, [1.0, None] * 24, 1, 0), (1002, [float("nan")] * 48, 1, 0), (1003, [float("inf")] * 48, 1, 0), (1004, [-float("inf")] * 48, None, 0)]
    rows = [(i, v.tolist(), lab, 9) for i, (v, lab) in enumerate(zip(vectors, labels, strict=True))]
    df = spark.createDataFrame([*bad, *rows], "vec_id bigint, embedding array<float>, label int, code int").repartition(5)
    got = sorted(map(tuple, vectorcodes.compress(df).collect()))
    assert got == [(i, *x) for i, x in enumerate(coded(vectors.astype(float).tolist(), labels))]


def test_bounds_rule_out_entries_and_never_the_nearest():
    rng = np.random.default_rng(4)
    for width, scale in ((1, 50), (4, 200), (5, 3), (12, 1000), (32, vectorcodes.BOUND // 2)):
        entries, x = (rng.integers(-scale, scale + 1, (n, width)) for n in (64, 300))
        x[:64] = entries[::-1]
        entries[9] = entries[3]
        code, least, tried = vectorcodes.Book(entries).nearest(x)
        far = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        assert code.tolist() == far.argmin(1).tolist() and least.tolist() == far.min(1).tolist()
        assert tried < len(x) * 64 * (0.5 if width < 6 else 1)  # wide parts without any structure are the hard case
    book = vectorcodes.Book(entries)
    for level, starts in enumerate(book.levels):  # each bound is below the distance, finer ones nearer to it
        mean, rest = vectorcodes.outline(x, starts)
        bound = (book.sizes[level] * (mean[:, None] - book.outlines[level][0].T) ** 2 + (rest[:, None] - book.outlines[level][1].T) ** 2).sum(2)
        assert (bound <= far * (1 + 1e-9)).all()


def test_odd_vectors(spark):
    kind = "vec_id bigint, embedding array<double>, label string"
    run = lambda rows: sorted(map(tuple, vectorcodes.compress(spark.createDataFrame(rows, kind)).collect()), key=repr)
    assert run([]) == [] and run([(1, None, "a")]) == []
    one = run([(1, [0.5] * 16, None), (1, [0.5] * 16, None)])
    assert [x[:4] for x in one] == [(1, "00" * 16, 0, 0)] * 2
    short = run([(1, [0.25] * 20, "a"), (2, [0.25], "a"), (None, [], "b")])  # 20 components: 16 parts of 2, zeros behind
    assert [x[1] for x in short] == ["00" * 16, "01" * 10 + "00" * 6, "02" + "01" * 9 + "00" * 6]
    assert all(x[2] == 0 for x in short)
    huge = run([(1, [1e300] + [0.0] * 15, "a"), (2, [-1e300] + [0.0] * 15, "a"), (3, [1e9] + [0.0] * 15, None)])
    assert [x[2] for x in huge] == [0, 0, 0] and huge[0][1][:2] == huge[2][1][:2] != huge[1][1][:2]


def test_labels_held_by_many_rows(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit("x")).otherwise(F.col("id").cast("string")).alias("g"))
    from locusframe.llm.common import beside

    totals = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    got = beside(rows, totals, "g", "n", share=10)
    assert got.count() == 5000 and got.where("n != case when g is null then 1667 when g = 'x' then 1667 else 1 end").count() == 0
