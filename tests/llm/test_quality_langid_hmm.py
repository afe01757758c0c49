import tracemalloc
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusframe.llm import hmm, langid, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(t):
    w = WORD.findall(t or "")
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(rep)


def prose(rng, n, syllables):
    words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    return " ".join(rng.choice(words) + (".\n" if rng.random() < 0.05 else "") for _ in range(n))


EN, FR = ["th", "er", "on", "an", "re", "in"], ["eau", "ou", "ée", "lle", "qui", "ç"]


def test_base_counts():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a b c a b c", "x\nx\n\ny\n x\n", "é ü # $ | <>\x0b\x0c\x1c b", "a b " * 40] + [prose(rng, 80, ["a", "b"]) for _ in range(20)]
    for t in texts:
        assert quality.base_counts(t) == brute_base(t), repr(t)


def test_model_is_a_distribution():
    rng = random.Random(2)
    code, _ = quality.grams([prose(rng, 500, EN), "", prose(rng, 50, FR)])
    n = np.bincount(code, minlength=quality.SYMBOLS**quality.ORDER)
    seen = np.flatnonzero(n)
    model = quality.Model(seen, n[seen])
    for context in [*(seen[:5] // quality.SYMBOLS).tolist(), 0, 777, quality.SYMBOLS**3 - 1]:
        total = np.exp2(model.log2(context * quality.SYMBOLS + np.arange(quality.SYMBOLS))).sum()
        assert total == pytest.approx(1, abs=1e-5)
    empty = quality.Model(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert empty.log2(np.array([0, 5])) == pytest.approx(-math.log2(quality.SYMBOLS))


def test_grams_do_not_cross_texts():
    texts = ["abc", "", "d", "éf\n"]
    code, ends = quality.grams(texts)
    for i, t in enumerate(texts):
        own, _ = quality.grams([t])
        assert code[ends[i] : ends[i + 1]].tolist() == own.tolist() and len(own) == len(t)


def test_quality_of_rows(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 120, EN), "en") for i in range(150)] + [(200 + i, prose(rng, 120, FR), "fr") for i in range(100)]
    junk = [(900 + i, " ".join(w + "%%%$#" for w in rows[i][1].split()), "en") for i in range(4)]
    odd = [(1000, None, None), (1001, "", "en"), (1002, "a b c " * 50, "en"), (1003, "few words", "xx"), (None, rows[0][1], "en")]
    df = spark.createDataFrame(rows + junk + odd, "doc_id long, text string, lang string").select("*", F.lit(1).alias("kept"), F.lit("x").alias("TEXT"))
    scorer = quality.fit(df)
    got = {r.doc_id: r for r in quality.judge(df, scorer).collect()}
    for i, t, _ in rows + junk + odd:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert not any(got[i].kept for i, *_ in junk) and not got[1000].kept and got[1002].base_failed
    clean = [i for i, *_ in rows if not got[i].base_failed]
    assert clean and sum(got[i].kept for i in clean) >= 0.97 * len(clean)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()) == sorted((i is None, i or 0) for i, r in got.items() if r.kept)
    empty = df.limit(0)
    assert quality.judge(empty, quality.fit(empty)).count() == 0


def test_quality_bands_of_any_language(spark, monkeypatch):
    rng = random.Random(8)
    pl = ["szcz", "wzy", "prz", "kow", "źdź", "ły"]
    rows = [(i, prose(rng, 120, ["la", "to", "re", "ni", "co", "sa"]), "it") for i in range(200)] + [(300 + i, prose(rng, 120, pl), "pl") for i in range(40)]
    rows += [(400 + i, prose(rng, 120, pl), None) for i in range(20)] + [(500 + i, prose(rng, 120, EN), "en") for i in range(2)]
    junk = [(900 + i, " ".join(w + "%%%$#" for w in rows[200 + i][1].split()), "pl" if i % 2 else None) for i in range(4)]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judge(df, quality.fit(df)).collect()}
    for low, high in ((0, 200), (300, 340), (400, 420), (500, 502)):
        clean = [i for i in range(low, high) if not got[i].base_failed]
        assert clean and sum(got[i].kept for i in clean) >= 0.9 * len(clean), low
    assert not any(got[i].kept for i, *_ in junk)
    plain = df.withColumn("lang", F.lit(None).cast("string"))
    assert quality.fit(plain).bands.keys() == {(quality.REST, quality.length_class(120))}
    monkeypatch.setattr(quality, "MAX_LANGUAGES", 2)
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    assert {g for g, _ in quality.fit(df).bands} <= {"it", "pl", quality.REST}  # the rest count as unlabelled


def test_language_vectors_of_many_letters():
    """Random Chinese characters: nearly all trigrams differ, and memory must not be texts times trigrams."""
    rng = random.Random(3)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1500)) for _ in range(100)]
    s = langid.Space()
    langid.letters("a")
    tracemalloc.start()
    got = np.concatenate([v for _, v in s.bundle(texts)])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300 << 20
    one = langid.Space()
    assert all(np.array_equal(next(one.bundle([texts[i]]))[1][0], got[i]) for i in (0, 57, 99))


def test_labels_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat", "en"), ("the dog", "en"), ("der hund", "de"), ("le chat", "fr"), ("x", None), (None, "fr"), ("der", "de")])], "doc_id long, text string, lang string")
    assert set(langid.fit(df)) == {"de", "en"}


def test_language_vectors_add_up():
    s = langid.Space(64)
    texts = ["ab c", "", "Ab, C!", "日本 x", None or "12 3"]
    got = {a + i: v[i] for a, v in s.bundle(texts) for i in range(len(v))}
    for n, t in enumerate(texts):
        code, _ = langid.trigrams([t])
        want = sum((np.roll(s.letter(c >> 42), 2).astype(int) * np.roll(s.letter(c >> 21 & 0x1FFFFF), 1) * s.letter(c & 0x1FFFFF) for c in code.tolist()), np.zeros(64))
        assert got[n].tolist() == list(want)
    assert got[0].tolist() == got[2].tolist() and not got[4].any()


def test_language_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 30, EN if i % 2 else FR), "en" if i % 2 else "fr") for i in range(200)] + [(500, None, "en"), (501, "12 34", "fr"), (502, "", None), (503, prose(rng, 30, EN), None), (None, "the", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    p = langid.fit(df.where(~langid.held_out(df["doc_id"])))
    assert list(p) == ["en", "fr"]
    got = {r.doc_id: r for r in langid.predict(df, p).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows[:200]) and all(0 <= r.score <= 1 for r in got.values())
    assert got[500].lang_pred == got[501].lang_pred == got[502].lang_pred == "und" and got[503].lang_pred == "en"
    fold = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out(df["doc_id"]).alias("h")).collect()}
    assert all(fold[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows if i is not None) and fold[None] is False
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {500, 501, 502}.isdisjoint({r.doc_id for r in kept.collect()})
    assert langid.fit(df.limit(0)) == {} and [r.lang_pred for r in langid.predict(df.limit(2), {}).collect()] == ["und", "und"]


def test_forward_and_counts_against_all_paths():
    rng = np.random.default_rng(1)
    k = hmm.STATES
    m = hmm.Model(rng.dirichlet(np.ones(k), 2), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(6), k).T)
    texts = [np.array(x, np.int32) for x in ([1, 2, 5], [0], [3, 3, 1, 4, 0])]
    for t, got in zip(texts, hmm.log10_likelihood(m, texts), strict=True):
        a = m.start[0] * m.emit[t[0]]
        for s in t[1:]:
            a = (a @ m.move) * m.emit[s]
        assert got == pytest.approx(math.log10(a.sum()), abs=1e-9)
    c = hmm.Counts(6)
    c.add(m, texts)
    assert c.emit.sum(1) == pytest.approx(np.bincount(np.concatenate(texts), minlength=6)) and c.move.sum() == pytest.approx(6) and c.start[0].sum() == pytest.approx(3)
    t = texts[0]  # posteriors by enumeration
    want = np.zeros((6, k))
    total = 0.0
    for p in np.ndindex(k, k, k):
        w = m.start[0][p[0]] * m.emit[t[0], p[0]] * m.move[p[0], p[1]] * m.emit[t[1], p[1]] * m.move[p[1], p[2]] * m.emit[t[2], p[2]]
        total += w
        for s, x in zip(t, p, strict=True):
            want[s, x] += w
    one = hmm.Counts(6)
    one.add(m, [t])
    assert one.emit == pytest.approx(want / total)


@pytest.mark.parametrize("head", [12, 100_000])
def test_language_model(spark, monkeypatch, head):
    monkeypatch.setattr(hmm, "HEAD", head)
    monkeypatch.setattr(hmm, "SCORED_BYTES", 2000)
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(1, 300), EN if i % 2 else FR)) for i in range(120)] + [(900, None), (901, ""), (902, "Unseen WORDS é"), (5, "the the"), (None, "the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tok = lambda t: [*WORD.findall(low(t)), " "]
    ho = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not ho(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    got = Counter()
    better = total = 0
    result = hmm.score(df).collect()
    for r in result:
        got[(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))] += 1
        assert math.isfinite(r.score) and r.score < 0
        if r.held_out and r.n_tokens > 50:
            better += r.score > r.base_score
            total += 1
    want = Counter((i, ho(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t)), 6)) for i, t in rows)
    assert got == want and better >= 0.8 * total > 0
    assert hmm.score(df.limit(0)).count() == 0


def test_language_model_sums_to_one(spark, monkeypatch):
    """The end alone, and one word of any class or none before it: probabilities of all texts of up to one word."""
    monkeypatch.setattr(hmm, "HEAD", 3)
    monkeypatch.setattr(hmm, "CLASSES", 4)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d", "a b e", "a f", "g h"] * 4)], "doc_id long, text string")
    counts = hmm.count_words(df.select("text"))
    lex = hmm.fit_lexicon(counts)
    m = hmm.Model.first(lex)
    step = m.start[0] @ m.emit.T
    rare = [w for w in "abcdefgh" if w.encode() not in lex.head]
    c = {r.w.decode(): r.n for r in counts.collect()}
    total = sum(step[i] for i in lex.head.values())
    for k in range(4):
        own = sum(c[w] + 0.5 for w in rare if hmm._class(w.encode()) == k)
        total += step[len(lex.head) + k] * (own + 0.5) / 10 ** lex.class_log[k]
    assert total == pytest.approx(1)


def test_every_round_sees_every_text(spark):
    """More texts than any sample: the model is that of Baum-Welch over all of them, from the first round on."""
    rng = random.Random(9)
    df = spark.createDataFrame([(i, prose(rng, 5, EN)) for i in range(3200)], "k long, t string").withColumn("held_out", F.lit(False))
    lex = hmm.fit_lexicon(hmm.count_words(df.select("t")))
    want = hmm.Model.first(lex)
    texts = [lex.encode(r.t)[0] for r in df.collect()]
    for _ in range(3):
        c = hmm.Counts(len(lex.unigram))
        c.add(want, texts)
        want = hmm.Model.from_counts(lex, c.start, c.move, c.emit)
    got = hmm.train(hmm._encode(df, lex), lex, 3)
    assert got.emit == pytest.approx(want.emit, rel=1e-3, abs=1e-9) and got.move == pytest.approx(want.move, rel=1e-3)


def test_words_and_symbols_of_many_texts():
    """Whole batches against one word after the other: nulls, ends without white space, slices, words of one to four bytes."""
    rng = random.Random(12)
    texts = ["skipped x", None, "", " \t\n", "Ab", "cd", "é\x0bÉ\x00 a\x1cb　c\x85", None, "a", " a", "日本 語 Z", "a b " * 300] + ["".join(rng.choice("aB é語\n\t.") for _ in range(rng.randrange(200))) for _ in range(200)]
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    own = [(t or "").encode().translate(lower).split() for t in texts][1:]
    for column in (pa.array(texts)[1:], pa.array(texts, pa.large_string())[1:]):
        found, begins = hmm.split(column)
        assert [found[a:b].to_pylist() for a, b in zip(begins, begins[1:], strict=False)] == own
        head = {hmm.END: 0, b"a": 1, b"\xe9".decode("latin1").encode(): 2}
        lex = hmm.Lexicon(head, np.ones(3), np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES), 3, 3)
        ids, where, rare = lex.encode_all(column)
        for i, words in enumerate(own):
            want = [head[w] if w in head else 3 + zlib.crc32(w[-3:]) % hmm.CLASSES for w in [*words, hmm.END]]
            assert ids[where[i] : where[i + 1]].tolist() == want
            assert {r["w"]: r["m"] for r in rare[i].as_py()} == Counter(w for w in words if w not in head)
            assert len(rare[i]) == len({w for w in words if w not in head})
    for none in (pa.array([], pa.string()), pa.array([None], pa.string())):
        found, begins = hmm.split(none)
        assert len(found) == 0 and begins.tolist() == [0] * (len(none) + 1)
        assert lex.encode_all(none)[0].tolist() == [0] * len(none)


def test_rounds_exchange_blocks_of_sums(spark, monkeypatch):
    """A task of a round sends a row for each BLOCK of symbols, not one for each symbol."""
    rng = random.Random(13)
    df = spark.createDataFrame([(i, prose(rng, 60, EN)) for i in range(400)], "k long, t string").withColumn("held_out", F.lit(False)).repartition(4)
    lex = hmm.fit_lexicon(hmm.count_words(df.select("t")))
    sent = []
    real = hmm.map_batches
    monkeypatch.setattr(hmm, "map_batches", lambda *a: sent.append(real(*a)) or sent[-1])
    model = hmm.train(hmm._encode(df, lex), lex, 1)
    symbols = len(model.emit)
    assert symbols > len(lex.head) > 100
    assert 0 < sent[-1].count() <= sent[-1].rdd.getNumPartitions() * (1 + (symbols + 2 + hmm.STATES) // hmm.BLOCK)
