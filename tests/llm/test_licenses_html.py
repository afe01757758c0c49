import random
import re
import time
from html.parser import HTMLParser

import pytest

from locusframe.llm import htmltext, licenses


def found(text):
    return [(f.license, text[f.start : f.end]) for f in licenses.scanner().scan(text)]


def test_variants_are_told_apart():
    assert found("Licensed under CC BY 4.0.") == [("CC-BY-4.0", "Licensed under CC BY 4.0")]
    assert found("Licensed under CC BY-NC 4.0.") == [("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0")]
    assert found("This work is licensed under the GNU General Public License, version 3.")[0][0] == "GPL-3.0-only"
    assert found("it is licensed under the GNU General Public License,\n version 2 or later, see file")[0][0] == "GPL-2.0-or-later"
    assert found("SPDX-License-Identifier: MIT")[0][0] == "MIT"
    assert [x for x, _ in found("Licensed under the MIT License. Released under CC BY-SA 4.0.")] == ["MIT", "CC-BY-SA-4.0"]


def test_only_exact_wordings_count():
    for t in (None, "", "under the bridge", "licensed under mitigations", "Licensed under the Apache License, Version 3.0.", "a licence to thrill"):
        assert licenses.scanner().scan(t) == []


def test_whole_long_texts(spark):
    filler = "lorem ipsum " * 4000
    text = filler + "\nReleased under the MIT License.\n" + filler + "Licensed under the Apache License, Version 2.0. " + filler
    assert [x for x, _ in found(text)] == ["MIT", "Apache-2.0"]
    body = "Permission is hereby granted, free\nof charge, to any person obtaining a copy of this software and\nassociated documentation files (the"
    assert found("x\n" + body)[0][0] == "MIT"
    df = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, None, 0), (None, "License: MPL-2.0", 0)], "doc_id long, text string, license int")
    rows = licenses.scan(df).collect()
    assert sorted((r.doc_id is None, r.license) for r in rows) == sorted([(False, "MIT"), (False, "Apache-2.0")] * 2 + [(True, "MPL-2.0")])
    assert all(r.size_with < r.size_alone for r in rows) and licenses.scan(df.limit(0)).count() == 0


def test_short_notices_in_varied_prose():
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    for size in (500, 1000, 2500, 5000):
        half = lambda: " ".join(rng.choice(pool) for _ in range(size // 14))
        for notice in ("This tool is released under the MIT License.", "It is licensed under MIT.", "License: MIT", "It is released under\nthe MIT License."):
            assert [x for x, _ in found(f"{half()}. {notice} {half()}")] == ["MIT"], (size, notice)


def test_second_notice_that_wraps():
    assert [x for x, _ in found("Licensed under the MIT License or under the terms of the\nApache License, Version 2.0")] == ["MIT", "Apache-2.0"]
    assert [x for x, _ in found("Licensed under the MIT License\nReleased under the ISC License\nText.")] == ["MIT", "ISC"]
    assert [x for x, _ in found("Licensed under the GNU General Public License, version 2\nor later. License: MIT")] == ["GPL-2.0-or-later", "MIT"]


GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "


def test_notices_of_the_gnu_family():
    assert found(GPL + "either version 2 of the License, or\n(at your option) any later version.")[0][0] == "GPL-2.0-or-later"
    assert found(GPL + "version 2 of the License.")[0][0] == "GPL-2.0-only"
    assert found(GPL.replace("General", "Lesser General").replace("program", "library") + "either version 2.1 of the License, or (at your option) any later version.")[0][0] == "LGPL-2.1-or-later"
    assert found(GPL.replace("General", "Affero General") + "either version 3 of the License, or (at your option) any later version.")[0][0] == "AGPL-3.0-or-later"
    assert found(GPL + "version 4 of the License.") == []


def test_texts_and_their_differences():
    two, three = licenses.TEXTS["BSD-2-Clause"][0], licenses.TEXTS["BSD-3-Clause"][0]
    for text, name in ((two, "BSD-2-Clause"), (three, "BSD-3-Clause"), (licenses.TEXTS["MIT-0"][0], "MIT-0"), (licenses.TEXTS["0BSD"][0], "0BSD"), (licenses.TEXTS["ISC"][1], "ISC")):
        (f,) = licenses.scanner().scan(f"Copyright 2020 Someone\n\n{text}\n\nand prose")
        assert (f.license, f.differences) == (name, []) and f.rival != name and f.rival_differences > 10
    (f,) = licenses.scanner().scan(three.replace("Neither", "3. Neither").replace("the copyright holder nor", "Someone nor"))
    assert (f.license, f.differences) == ("BSD-3-Clause", ["+3", "-the", "-copyright", "holder>someone"])
    (f,) = licenses.scanner().scan(licenses.TEXTS["MIT"][1].replace("is furnished", "was furnished"))
    assert (f.license, f.differences) == ("MIT", ["is>was"])
    assert [x for x, _ in found(two.split(" are permitted")[0] + " are permitted provided that the following conditions are met")] == ["BSD"]


def test_two_licenses_under_one_opening():
    for text in ("Licensed under MIT or Apache-2.0", "SPDX-License-Identifier: MIT OR Apache-2.0", "License: MIT/Apache-2.0", "Licensed under either of the MIT License or the Apache License, Version 2.0, at your option"):
        assert [x for x, _ in found(text)] == ["MIT", "Apache-2.0"], text
    assert [x for x, _ in found("Licensed under MIT. Apache-2.0 is another")] == ["MIT"]
    assert found("it is licensed under" + " " * 1500 + "the MIT License")[0][0] == "MIT"


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_against_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        a, b = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))], [rng.randrange(1, 5) for _ in range(rng.randrange(0, 14))]
        row = licenses.distances(licenses.np.array(a), licenses.np.array(b, licenses.np.int64))
        assert row.tolist() == [min(edit(a, b[s:e]) for s in range(e + 1)) for e in range(len(b) + 1)]
        pairs = licenses.align(a, b)
        assert [i for i, _ in pairs if i >= 0] == list(range(len(a))) and sum(i < 0 or j < 0 or a[i] != b[j] for i, j in pairs) == row[-1]


def test_ranking_leaves_out_no_better_wording():
    """What the scanner takes, going down its ranking, is what aligning all wordings with the whole text gives."""
    s, rng = licenses.scanner(), random.Random(9)
    every = [(t, w) for t in s.templates for w in t.wordings]
    for n in range(40):
        _, w = rng.choice(every if n % 2 else [x for x in every if 10 <= len(x[1].ids) < 90])
        words = licenses.tokens(w.text)
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["2", "3", "the", "zebra", "software", "later"])
        words = ["some", "prose", *words, "more", "prose"]
        nets = [(len(x.ids) - got[0], t.license) for t, x in every if (got := s.confirm(x, licenses.np.array([s.vocabulary.get(y, 0) for y in words], licenses.np.int64)))]
        hit = s.scan(" ".join(words))
        assert bool(hit) == bool(nets)
        if nets:
            assert max(len(licenses.tokens(f.wording)) - len(f.differences) for f in hit) == max(nets)[0]
            assert {f.license for f in hit} & {name for net, name in nets if net == max(nets)[0]}


@pytest.fixture(scope="module")
def tree():
    return htmltext.train()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="menu-open">
<header><h1>The Site</h1></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="ad">Buy this now, it is good for you today.</div><div class="cookie-banner">We use cookies on this site.</div>
<article><header><h1>Head &amp; line</h1></header><p>First <b>para</b>graph,&nbsp;with <a href="x>y">a link</a> in
 it.<p>Short.<br>Two.<aside>Aside text that is long enough to be taken for a paragraph of the article itself.</aside><p title="a > b">Unclosed &lt;i&gt; end &am
<div id="newsletter-form">Sign up<form><input><button>Go</button>Mail</form></div></article>
<section id="comments"><p>Nice article, I read all of it with joy and want more of the same soon, please.</p></section>
<footer>&copy; 2020 The Site</footer></body></html>"""


def test_page(tree):
    assert htmltext.main_text(PAGE, tree) == "Head & line First paragraph, with a link in it. Short. Two. Unclosed <i> end &am"


def test_broken_pages_do_not_fail(tree):
    rng = random.Random(1)
    for n in range(0, len(PAGE), 3):
        htmltext.main_text(PAGE[:n], tree)
        htmltext.main_text(PAGE[n:], tree)
    for _ in range(50):
        htmltext.main_text("".join(rng.sample(PAGE, len(PAGE))), tree)
    for t in (None, "", "<", "</", "<a href=\"x", "<!-- x", "<script>x", "a < b", "<>", "</ p>"):
        htmltext.main_text(t, tree)
    assert htmltext.main_text("<article>" + "<b>" * 5000 + "deep" + "</i>" * 5000, tree) == "deep"
    assert htmltext.main_text("<article>" + '<a "' * 3000 + "x</article>", tree) is not None


def test_structure_decides(tree):
    long = "word " * 60
    for wrap in ("<nav>{}</nav>", "<footer>{}</footer>", "<aside>{}</aside>", "<form>{}</form>", '<div class="comments">{}</div>', '<div id="sidebar">{}</div>', '<div class="notice">{}</div>', '<div role="navigation">{}</div>', "<div hidden>{}</div>"):
        for inner in ("<p>" + long + "</p>", '<a href="x">link</a>', "<p>short</p>"):
            page = f"<article><p>{long}</p>{wrap.format(inner)}<p>{long}</p></article>"
            assert htmltext.main_text(page, tree) == " ".join([*long.split(), *long.split()]), (wrap, inner)
    assert htmltext.main_text(f"<body><p>{long}</p></body>", tree) == long.strip()


HELD_OUT = """
<nav><a href=x>{1}</a></nav><div>{11}</div><article><h1 data-main>{9}</h1><p data-main>{33}</p><p data-main>{2}</p><h3 data-main>{4}</h3><p data-main>{81}</p><div class="ad-slot">{17}</div><p data-main>{26}</p></article><footer>{14}</footer>
<div class="site-header"><a href=x>{3}</a></div><div class="article-body" data-main><p>{64}</p><p>{19}</p><p>{140}</p></div><div class="related-links"><a href=x>{5}</a><a href=x>{8}</a></div><div class="footer">{20}</div>
<div id="top"><a href=x>{1}</a> <a href=x>{1}</a> <a href=x>{2}</a></div><h1 data-main>{7}</h1><p data-main>{52}</p><p data-main>{47}</p><p data-main>{13}</p><ul><li><a href=x>{6}</a><li><a href=x>{7}</a></ul>
<main><h1 data-main>{4}</h1><p data-main>{72}</p><ol><li data-main>{8}<li data-main>{21}</ol><aside><p>{44}</p></aside><p data-main>{16}</p><section id="comments"><h2>{1}</h2><p>{28}</p></section></main>
<article><p data-main>{95}</p><p data-main>{5}</p><p data-main>{41} <a href=x>{4}</a></p><div class="cookie-notice"><p>{16}</p></div></article><div class="comment-thread"><p>{36}</p><p>{50}</p></div>
"""


def test_held_out_fragments(tree):
    """Fragments that are not in the table: the share of blocks that the tree puts right."""
    right = []
    for page in htmltext.fragments(HELD_OUT):
        labels, own = [b.main for b in htmltext.blocks(page)], htmltext.blocks(page, tree.weights)
        right += [htmltext.is_main(tree.tree, row) == main for main, row in zip(labels, htmltext.features(own), strict=True)]
    assert len(right) > 70 and sum(right) / len(right) >= 0.95, sum(right) / len(right)


def test_tree_looks_at_neighbours(tree):
    def used(node):
        return set() if node.feature < 0 else {htmltext.FEATURES[node.feature]} | used(node.low) | used(node.high)

    assert used(tree.tree) & {"words_before", "words_after", "density_before", "density_after", "share_of_before", "share_of_after"} and "link_density" in used(tree.tree)
    long = "word " * 40
    for name in ("share-price-report", "post-comments-off", "wordlist", "unknown"):
        assert htmltext.main_text(f'<article class="{name}"><p>{long}</p></article>', tree) == long.strip(), name
    # equal blocks that differ in their neighbours alone
    link = '<p><a href="x">a b</a></p>'
    assert htmltext.main_text(f"<article><p>{long}</p>{link * 3}<p>{long}</p></article>", tree) == f"{long}{long}".strip()


def test_pages_without_semantic_tags(spark, tree):
    """With plain containers in place of article, nav and footer, and without names, words and links must tell as much."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    right, turned = [], 0
    for page in pages:
        truth = [b.inside for b in htmltext.blocks(page, tree.weights)]
        bare = re.sub(r"<(/?)(article|nav|footer)\b[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", page))
        rows = htmltext.features(htmltext.blocks(bare, tree.weights))
        verdicts = [htmltext.is_main(tree.tree, row) for row in rows]
        right += [v == t for v, t in zip(verdicts, truth, strict=True)]
        turned += sum(v != htmltext.is_main(tree.tree, (*row[:2], *[0] * 6, *row[8:])) for v, row in zip(verdicts, rows, strict=True))
    assert sum(right) / len(right) >= 0.98 and turned > len(pages), (sum(right) / len(right), turned)


def test_names_of_the_whole_page_do_not_count(tree):
    a, b = "word " * 80, "text " * 60
    for name in ("post-comments-off", "comments-page", "price-notice", "related-article", "has-sidebar", "with-ads", "menu-open", "cookie-recipe", "banner-story"):
        for inner in (f"<p>{a}</p><p>{b}</p>", f'<div class="comments"><p>short</p></div><p>{a}</p><p>{b}</p>', f"<div>{a}</div><div>{b}</div>"):
            assert htmltext.main_text(f'<div class="{name}">{inner}</div>', tree) == f"{a}{b}".strip(), (name, inner)
    # a named part of a page does
    assert htmltext.main_text(f'<div><p>{a}</p><p>{b}</p></div><div class="comments"><p>{a}</p></div>', tree) == f"{a}{b}".strip()


def test_lone_blocks(tree):
    for n in (20, 40, 140, 1000):
        w = " ".join(["word"] * n)
        for page in (w, f"<div>{w}</div>", f"<p>{w}</p>", f"<article>{w}</article>", f"<div><h1>a b</h1><div>{w}</div></div>", f"<article><p>a b</p><div>{w}</div></article>", f"<main><div>{w}</div></main><footer>x</footer>"):
            assert htmltext.main_text(page, tree).replace("a b ", "") == w, page


class Twin(HTMLParser):
    """Text, words and linked words of the blocks of a well-formed page, by another parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.linked, self.link, self.skip = [], [], 0, 0, 0
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        if words := "".join(self.parts).split():
            self.out.append((" ".join(words), len(words), self.linked))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag not in htmltext.INLINE:
            self.end()
        self.link += tag == "a"
        self.skip += tag in htmltext.RAW

    def handle_endtag(self, tag):
        if tag != "br" and tag not in htmltext.INLINE:
            self.end()
        self.link -= tag == "a"
        self.skip -= tag in htmltext.RAW

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)
            self.linked += len(data.split()) * bool(self.link)


def test_blocks_against_another_parser():
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "b&amp;c", "&lt;x&gt;", "d&nbsp;e", "caf\u00e9", "1"])

    def piece(depth):
        kind = rng.choice(["text", "a", "b", "div", "section", "h2", "script", "comment", "br"]) if depth else "text"
        text = " ".join(word() for _ in range(rng.randrange(1, 6)))
        if kind == "text":
            return f" {text} "
        if kind == "comment":
            return f"<!-- <p>{text}</p> -->"
        if kind == "br":
            return "<br/>"
        if kind == "script":
            return f"<script>var a = '<p>{text}';</script>"
        inner = f" {text} " if kind in ("a", "b") else "".join(piece(depth - 1) for _ in range(rng.randrange(0, 4)))
        return f"<{kind} title='x > y' class=\"k{rng.randrange(9)}\">{inner}</{kind}>"

    for _ in range(300):
        page = "".join(piece(4) for _ in range(rng.randrange(1, 6)))
        assert [(b.text, b.words, b.linked) for b in htmltext.blocks(page, {})] == Twin(page).out, page


def test_long_markup_is_read_once(tree):
    began = time.time()
    for page in ("<div " + "x" * 1_000_000 + "><p>end", "<div " + 'x="' * 200_000 + "><p>end", "<div class=a>" * 60_000 + "end", "<a href='" * 100_000, "<p title=" + "=" * 500_000 + ">end", "<" * 300_000, "&amp" * 200_000):
        htmltext.main_text(page, tree)
    assert time.time() - began < 8


def test_frame(spark, tree):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x")], "page_id long, url string, html string, TEXT string")
    rows = htmltext.extract(df).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in rows if r.text == ""] == [(2, None, 0), (None, "v", 0)] and rows[0] == rows[1] and rows[0].n_chars == len(rows[0].text)
    assert htmltext.extract(df.limit(0)).count() == 0
