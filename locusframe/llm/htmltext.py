"""Main text of web pages: flat text blocks, classified by a decision tree over word counts and link densities.

A page is cut into blocks at block-level tags. A block's features are the words and link density of itself, of the block
before and of the block after, their quotients, the role of the tags that it stands in (article, aside, heading,
paragraph), and what its elements are named. The tree is grown, once on the driver, from the labelled page fragments
below, words and links being asked first where they tell nearly as much as tags; where a page says by its tags what is
the article these decide, and elsewhere the neighbours do. What a word of a class or id weighs is learned from the
fragments too; a word that they do not show weighs nothing, nor does the name of an element that holds most of a page.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, pick

# HTML element names, and values of the role attribute, by what they stand for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
#: Elements whose text is never the article's.
ASIDE = frozenset("nav footer aside form menu dialog select button option noscript template iframe object svg math canvas audio video head fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
ARTICLE = frozenset("article main".split())
CLOSES = {"li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}
#: Elements that hold running text; in others, text stands directly in a container.
PARAGRAPH = frozenset("p li dd dt td th pre blockquote figcaption caption".split())
_ATTRIBUTE = re.compile(r"[^\s=/>]+")
_EQUALS = re.compile(r"\s*=\s*")
_PLAIN = re.compile(r"[^\s>]*")
_GAP = re.compile(r"[\s/]*")
_TOKENS = re.compile(r"[^a-z]+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    inside: bool
    aside: bool
    heading: bool
    paragraph: bool
    #: (number of the element on the page, what its name weighs) of each open element whose name weighs less than 0.
    named: tuple[tuple[int, float], ...] = ()
    #: Only where labelled fragments are read: words of the names of all open elements, and whether one is marked as main text.
    names: tuple[frozenset[str], ...] = ()
    main: bool = False


def attributes(page: str, at: int, unclosed: set[str]) -> tuple[dict[str, str], int]:
    """The attributes of a tag from after its name on, and where the tag ends (-1: nowhere). Every character is read once.

    A quoted value may hold the sign that ends a tag. Quotes that no later quote closes are plain characters.
    """
    out: dict[str, str] = {}
    n = len(page)
    while True:
        at = _GAP.match(page, at).end()
        if at >= n:
            return out, -1
        if page[at] == ">":
            return out, at
        m = _ATTRIBUTE.match(page, at)
        if not m:  # a stray equals sign
            at += 1
            continue
        name, at = m[0].lower(), m.end()
        value = ""
        if eq := _EQUALS.match(page, at):
            at = eq.end()
            quote = page[at : at + 1]
            shut = page.find(quote, at + 1) if quote in ("'", '"') and quote not in unclosed else -1
            if shut >= 0:
                value, at = page[at + 1 : shut], shut + 1
            else:
                if quote in ("'", '"'):
                    unclosed.add(quote)
                m = _PLAIN.match(page, at)
                value, at = m[0], m.end()
        out.setdefault(name, value)


def name_words(attrs: dict[str, str]) -> frozenset[str]:
    """The words of an element's class and id."""
    text = " ".join(attrs[a] for a in ("class", "id") if attrs.get(a))
    return frozenset(w for w in _TOKENS.split(_CAMEL.sub(r"\1 \2", text).lower()) if w) if text else frozenset()


def blocks(page: str, weights: dict[str, float] | None = None) -> list[Block]:
    """The page's text blocks in order. Unclosed tags, quotes and comments are closed where a browser closes them, roughly.

    weights: what each word of an element's names weighs; without them the words themselves are kept, for labelled pages.
    """
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    # state of the elements that are open: (name, and what all of these were before)
    stack: list[tuple] = []
    open_: dict[str, int] = {}
    inside = aside = link = heading = paragraph = main = False
    named, names = (), ()
    at, n = 0, len(page)
    unclosed: set[str] = set()

    def add(piece: str) -> None:
        nonlocal linked
        if "&" in piece:
            piece = html.unescape(piece)
        parts.append(piece)
        if link:
            linked += len(piece.split())

    def flush() -> None:
        nonlocal linked
        words = "".join(parts).split()
        if words:
            out.append(Block(" ".join(words), len(words), min(linked, len(words)), inside, aside, heading, paragraph, named, names, main))
        parts.clear()
        linked = 0

    def close(name: str) -> None:
        nonlocal inside, aside, link, heading, paragraph, named, names, main
        while True:
            own, inside, aside, link, heading, paragraph, named, names, main = stack.pop()
            open_[own] -= 1
            if own == name:
                return

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if nxt in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        ending = nxt == "/"
        m = _NAME.match(page, lt + 1 + ending)
        if not m:
            if ending:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                add("<")
                at = lt + 1
            continue
        name = m[0].lower()
        attrs, end = attributes(page, m.end(), unclosed)
        if end < 0:
            break
        at = end + 1
        if name == "br" or name not in INLINE:
            if name == "br":
                parts.append(" ")
            else:
                flush()
        if ending:
            if open_.get(name):
                close(name)
            continue
        if name in RAW:
            done = _RAW_END[name].search(page, at)
            gt = page.find(">", done.end()) if done else -1
            at = n if gt < 0 else gt + 1
            continue
        if name in VOID:
            continue
        if name not in INLINE and open_.get("p"):
            close("p")
        if (same := CLOSES.get(name)) and open_.get(same) and stack and stack[-1][0] == same:
            close(same)
        stack.append((name, inside, aside, link, heading, paragraph, named, names, main))
        open_[name] = open_.get(name, 0) + 1
        if name in ARTICLE or attrs.get("role") == "main":
            inside = True
            if name == "main":  # whatever the elements around it are called
                aside, named = False, ()
        elif name in ASIDE or name == "header" and not inside or attrs.get("role", "").lower() in ROLES:
            aside = True
        elif name == "a":
            link = True
        elif len(name) == 2 and name[0] == "h" and name[1] in "123456":
            heading = True
        if name not in INLINE:
            paragraph = name in PARAGRAPH
        if attrs:
            if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(attrs.get("style", "")):
                aside = True
            # names of the page, or of the article, as a whole describe its layout or state
            if name not in ("html", "body", *ARTICLE) and (words := name_words(attrs)):
                if weights is None:
                    names = (*names, words)
                elif (weight := sum(weights.get(w, 0.0) for w in words)) < 0:
                    named = (*named, (lt, weight))
            main = main or "data-main" in attrs and weights is None
    flush()
    return out


#: A block's features in order: TEXTUAL ones by words and links, then those by tags and names. Neighbours are 0 words at a page's ends.
TEXTUAL = 8
FEATURES = ["words", "link_density", "words_before", "density_before", "words_after", "density_after", "share_of_before", "share_of_after", "in_article", "beside_article", "in_aside", "is_heading", "in_paragraph", "named"]
#: What a word of a name weighs at most; the labelled pages are read in these sizes.
MOST_NAMED, SIZES = 3.0, (1.0, 0.4)
#: An element that holds over this share of a page's running words is the page, whatever it is called.
WHOLE_PAGE = 0.75
#: A split by a textual feature is taken where it gains at least this share of what the best split gains.
FAVOUR = 0.8
# The labelled table: fragments of pages, written and labelled by hand for this module; {n} stands for n words, data-main
# marks main text.
LABELLED = """
<header><a href=x>{2}</a></header><nav><ul><li><a href=x>{1}</a><li><a href=x>{2}</a><li><a href=x>{1}</a></ul></nav><div class="ad">{9}</div><article><h1 data-main>{8}</h1><p data-main>{70}</p><p data-main>{4}</p><p data-main>{55} <a href=x>{3}</a></p><p data-main>{20}</p></article><footer>{9}</footer>
<nav><a href=x>{1}</a> <a href=x>{1}</a></nav><article><h1 data-main>{6}</h1><p class="meta" data-main>{5}</p><p data-main>{120}</p><h2 data-main>{3}</h2><p data-main>{60}</p><ul><li data-main>{6}<li data-main>{14}<li data-main>{2}</ul><div class="ad">{12}</div><p data-main>{90}</p><aside>{40}</aside><p data-main>{35}</p></article><footer><p>{12}</p><p><a href=x>{2}</a></p></footer>
<div id="menu"><a href=x>{1}</a> <a href=x>{1}</a> <a href=x>{2}</a></div><div class="post-content" data-main><p>{80}</p><p>{45}</p><p>{3}</p><p>{60}</p></div><div class="comments"><h3>{1}</h3><div class="comment"><p>{40}</p></div><div class="comment"><p>{25}</p></div></div><div id="footer">{10}</div>
<div class="header"><a href=x>{2}</a></div><div class="content"><h1 data-main>{7}</h1><p data-main>{50}</p><p data-main>{75}</p><div class="related"><ul><li><a href=x>{8}</a><li><a href=x>{11}</a></ul></div><p data-main>{40}</p></div><div class="sidebar"><p>{30}</p><a href=x>{4}</a></div>
<div class="cookie-banner">{14} <a href=x>{2}</a></div><main><h1 data-main>{5}</h1><p data-main>{65}</p><p data-main>{12}</p><div class="newsletter-form">{8}</div><p data-main>{90}</p></main><div class="footer-links"><a href=x>{1}</a> <a href=x>{1}</a></div>
<article><header><h1 data-main>{9}</h1><p data-main>{4} <a href=x>{2}</a></p></header><p data-main>{100}</p><blockquote data-main>{25}</blockquote><table><tr><td data-main>{2}<td data-main>{1}<tr><td data-main>{3}<td data-main>{1}</table><p data-main>{55}</p><div class="share-buttons"><a href=x>{1}</a> <a href=x>{1}</a></div><section class="comments"><h3>{2}</h3><p>{30}</p><p>{22}</p></section></article>
<p><a href=x>{1}</a> <a href=x>{1}</a> <a href=x>{1}</a></p><h1 data-main>{6}</h1><p data-main>{40}</p><p data-main>{85} <a href=x>{4}</a> {20}</p><p data-main>{15}</p><p data-main>{60}</p><p><a href=x>{2}</a> <a href=x>{3}</a></p><p>{4} <a href=x>{2}</a></p>
<table><tr><td><a href=x>{1}</a><br><a href=x>{2}</a><br><a href=x>{1}</a><td data-main><p>{70}</p><p>{50}</p><p>{30}</p></table><p><a href=x>{3}</a></p>
<div class="topbar">{4}</div><div role="navigation"><a href=x>{1}</a></div><article class="story"><h1 data-main>{10}</h1><p data-main>{1}</p><p data-main>{130}</p><p data-main>{2}</p><div class="advert">{20}</div><p data-main>{45}</p></article><div class="comment-list"><p>{50}</p><p>{35}</p></div>
<nav>{3}</nav><article><h1 data-main>{4}</h1><p data-main>{1}</p></article><footer>{6}</footer>
<article><h1 data-main>{3}</h1><p data-main>{8}</p><p data-main>{5}</p></article><footer>{12} <a href=x>{1}</a></footer>
<article><h1 data-main>{7}</h1><p data-main><a href=x>{9}</a></p><p data-main>{40}</p><ul><li><a href=x>{4}</a><li><a href=x>{5}</a><li><a href=x>{4}</a></ul></article>
<article><p data-main>{60}</p><ul><li data-main><a href=x>{2}</a> {9}<li data-main><a href=x>{1}</a> {12}</ul><p data-main>{40}</p><p><a href=x>{2}</a></p><p><a href=x>{3}</a></p><p><a href=x>{2}</a></p></article>
<div class="share-price" data-main><p>{45}</p><p>{60}</p></div><div class="notice">{18}</div><div class="related-posts"><a href=x>{7}</a> <a href=x>{6}</a></div>
<div class="post" data-main><h2>{5}</h2><p>{35}</p><p>{50}</p></div><div class="sidebar"><div class="widget"><h4>{2}</h4><a href=x>{3}</a> <a href=x>{2}</a></div><div class="widget"><p>{20}</p></div></div><form>{4}</form>
<div class="banner">{10}</div><article><h2 data-main>{4}</h2><p data-main>{28}</p><pre data-main>{30}</pre><p data-main>{18}</p><div class="sponsored"><p>{30}</p></div><p data-main>{70}</p><form><p>{12}</p></form><div class="subscribe">{9}</div></article><div class="copyright">{8}</div>
<div class="wrapper"><div class="breadcrumbs"><a href=x>{1}</a> {1} <a href=x>{2}</a></div><h1 data-main>{6}</h1><div class="text" data-main>{90}</div><div class="text" data-main>{55}</div><div class="ads">{16}</div><div class="text" data-main>{8}</div><div class="pagination"><a href=x>{1}</a> <a href=x>{1}</a></div></div>
<div class="main-content" data-main><p>{110}</p><p>{6}</p><p>{85}</p></div><div id="comments"><p>{60}</p><p>{15}</p><p>{44}</p></div><div class="disclaimer">{22}</div>
<article data-main><p>{25}</p><p>{2}</p><p>{3}</p><p>{1}</p><p>{40}</p></article><section id="comments"><p>{24}</p></section><div class="notices"><p>{15}</p></div>
<article><h1 data-main>{5}</h1><div data-main>{60}</div><div data-main>{8}</div><div data-main>{33}</div><div class="cookie-notice">{13}</div><div class="sidebar-box">{30}</div></article>
<div class="popup">{15}</div><div class="entry"><p data-main>{55}</p><p data-main>{62}</p><div class="social-share"><a href=x>{1}</a></div></div><div id="sidebar"><p>{45}</p><ul><li><a href=x>{4}</a></ul></div><div id="respond">{12}</div>
<header>{12}</header><article><p data-main>{48}</p><div class="promo">{25}</div><div class="newsletter"><p>{16}</p></div><p data-main>{52}</p><div class="comments-section"><p>{38}</p></div></article><aside><p>{60}</p></aside>
<div class="menu-bar"><ul><li><a href=x>{1}</a><li><a href=x>{1}</a></ul></div><p data-main>{38}</p><p data-main>{41}</p><p data-main>{5}</p><p data-main>{30}</p><p>{3}</p><p><a href=x>{1}</a></p>
<article><section class="section" data-main><h2>{3}</h2><p>{22}</p><p>{31}</p></section><div class="box list" data-main><p>{24}</p><p>{28}</p></div><section class="section intro" data-main><p>{26}</p></section></article>
<article><p data-main>{35}</p><p data-main>{29}</p><p data-main>{44}</p><p data-main>{21}</p><p data-main>{116}</p><p data-main>{25}</p><p data-main>{17}</p><p data-main>{12}</p><p data-main>{27}</p><p data-main>{9}</p></article>
<div class="author links" data-main><p>{33}</p><p>{52}</p></div><div class="form bar" data-main><p>{47}</p></div><div class="buttons social posts" data-main><p>{39}</p></div>
<div>{14}</div><p>{30}</p><article><h1 data-main>{6}</h1><p data-main>{48}</p><p data-main>{7}</p></article><p>{22}</p><div>{60}</div><p>{3}</p>
<p>{12}</p><main><p data-main>{58}</p><p data-main>{36}</p></main><div>{25}</div><p>{70}</p><div>{9}</div>
<ul><li><a href=x>{2}</a><li><a href=x>{1}</a><li><a href=x>{3}</a></ul><div data-main>{100}</div><div data-main>{75}</div><ul><li><a href=x>{9}</a><li><a href=x>{12}</a></ul>
<article><p data-main>{62}</p><a href=x>{1}</a><p data-main>{58}</p><a href=x>{2}</a><p data-main>{7}</p><nav><a href=x>{1}</a></nav><p data-main>{66}</p></article><p><a href=x>{1}</a></p>
<article><h1 data-main>{12}</h1><p data-main>{5}</p><nav><p>{1}</p></nav><p data-main>{61}</p><footer><p>{58}</p></footer><p data-main>{64}</p><aside>{1}</aside><p data-main>{57}</p><div class="comments"><a href=x>{1}</a></div></article>
<nav><ul><li><a href=x>{1}</a><li><a href=x>{1}</a></ul></nav><div>{8}</div><article><h1 data-main>{11}</h1><p data-main>{24}</p></article><footer>{11}</footer>
<nav><a href=x>{1}</a></nav><div>{24}</div><div>{7}</div><article><p data-main>{2}</p><p data-main>{1}</p></article><div>{45}</div>
<nav><p>{70}</p></nav><h1 data-main>{8}</h1><p data-main>{66}</p><aside><p>{64}</p></aside><p data-main>{59}</p><p data-main>{1}</p><form><p>{1}</p></form><p data-main>{63}</p><footer><p>{55}</p></footer>
<div><a href=x>{2}</a></div><p data-main>{48}</p><div><a href=x>{1}</a></div><p data-main>{52}</p><div><a href=x>{3}</a></div>
<article><p data-main>{150}</p><p data-main>{240}</p><p data-main>{180}</p></article><div>{160}</div><div class="comments"><p>{140}</p></div>
<ul><li><a href=x>{1}</a><li><a href=x>{2}</a></ul><div>{9}</div><h1 data-main>{11}</h1><p data-main>{45}</p><p data-main>{70}</p><p data-main>{12}</p><div>{11}</div>
<ul><li><a href=x>{1}</a><li><a href=x>{1}</a></ul><div>{19}</div><h1 data-main>{7}</h1><p data-main>{22}</p><div>{16}</div>
<div><a href=x>{1}</a> <a href=x>{1}</a></div><div>{6}</div><h1 data-main>{12}</h1><p data-main>{160}</p><p data-main>{230}</p><p data-main>{90}</p><div>{8}</div>
<div><a href=x>{2}</a></div><div>{28}</div><h2 data-main>{9}</h2><p data-main>{6}</p><p data-main>{130}</p><p data-main>{5}</p><div>{24}</div>
<ul><li><a href=x>{3}</a><li><a href=x>{1}</a></ul><div>{12}</div><h1 data-main>{3}</h1><p data-main>{2}</p><div>{13}</div>
<div>{15}</div><h1 data-main>{6}</h1><div data-main>{85}</div><div data-main>{60}</div><div data-main>{35}</div><div>{5}</div>
<ul><li><a href=x>{1}</a></ul><h1 data-main>{8}</h1><p data-main>{33}</p><ul><li data-main>{12}<li data-main>{7}</ul><p data-main>{14}</p>
<div data-main>{60}</div>
<div data-main>{3}</div>
<article data-main>{70}</article>
<article data-main>{6}</article>
<main data-main>{25}</main>
<div data-main>{90}</div><div data-main>{48}</div>
<div data-main><h1>{8}</h1><div>{66}</div></div>
<h1 data-main>{2}</h1><div data-main>{190}</div><div data-main>{130}</div>
<article data-main><p>{40}</p><div>{36}</div></article>
<article data-main><h1>{5}</h1><p>{75}</p><div>{9}</div></article><footer>{8}</footer>
<article data-main><div>{25}</div><div>{30}</div><div>{4}</div></article>
<nav><a href=x>{2}</a></nav><article data-main><h1>{7}</h1><div>{80}</div></article>
<article data-main><h1>{4}</h1><p>{20}</p><section>{12}</section></article>
"""


@dataclass
class Node:
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None
    main: bool = False


@dataclass
class Classifier:
    tree: Node
    weights: dict[str, float] = field(default_factory=dict)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, favour: float = FAVOUR) -> Node:
    """A classification tree by Gini impurity; of equal splits the first feature's least limit, of equal halves main text.

    Words and links come before tags and names: the best textual split is taken unless it gains less than favour of the
    best split of all.
    """
    share = y.mean()
    node = Node(main=bool(share >= 0.5))
    if depth == 0 or share in (0.0, 1.0):
        return node
    whole = share * (1 - share) * len(y)
    # by kind (textual or not): gain, feature, limit
    found = [(1e-12, -1, 0.0), (1e-12, -1, 0.0)]
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        for i in np.flatnonzero(np.diff(v)):
            left, right = i + 1, len(y) - i - 1
            a, b = ones[i], ones[-1] - ones[i]
            gain = whole - a * (left - a) / left - b * (right - b) / right
            if gain > found[f >= TEXTUAL][0] + 1e-12:
                found[f >= TEXTUAL] = gain, f, float((v[i] + v[i + 1]) / 2)
    gain, node.feature, node.limit = found[0] if found[0][0] >= favour * found[1][0] else found[1]
    if node.feature >= 0:
        low = x[:, node.feature] < node.limit
        node.low, node.high = grow(x[low], y[low], depth - 1, favour), grow(x[~low], y[~low], depth - 1, favour)
    return node


def fragments(table: str, sizes: tuple[float, ...] = SIZES) -> list[str]:
    return [re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * math.ceil(int(m[1]) * size)), line) for line in table.strip().split("\n") for size in sizes]  # noqa: B023


def train(table: str = LABELLED) -> Classifier:
    pages = fragments(table)
    labelled = [b for p in pages for b in blocks(p)]
    counts: dict[str, list[int]] = {}
    for b in labelled:
        for w in frozenset().union(*b.names):
            counts.setdefault(w, [0, 0])[b.main] += 1
    share = math.log((sum(b.main for b in labelled) + 1) / (sum(not b.main for b in labelled) + 1))
    weights = {w: max(-MOST_NAMED, min(0.0, math.log((yes + 0.5) / (no + 0.5)) - share)) for w, (no, yes) in counts.items()}
    weights |= {w: 1.0 for w, (no, yes) in counts.items() if yes > no}
    rows = [f for p in pages for f in features(blocks(p, weights))]
    return Classifier(grow(np.array(rows, np.float64), np.array([b.main for b in labelled], np.float64)), weights)


def features(own: list[Block]) -> list[tuple]:
    """The features of a page's blocks. Names count unless their element holds most of the page's words that run outside links and asides."""
    density = lambda x: x.linked / x.words if x else 0.0
    article = any(b.inside for b in own)
    running, held = 0, {}
    for b in own:
        if not b.aside:
            running += b.words - b.linked
            for element, _ in b.named:
                held[element] = held.get(element, 0) + b.words - b.linked
    out = []
    for n, b in enumerate(own):
        before, after = own[n - 1] if n else None, own[n + 1] if n + 1 < len(own) else None
        w0, w1 = before.words if before else 0, after.words if after else 0
        named = min((w for element, w in b.named if held.get(element, 0) <= WHOLE_PAGE * running), default=0.0)
        out.append((b.words, density(b), w0, density(before), w1, density(after), b.words / (b.words + w0), b.words / (b.words + w1), b.inside, article and not b.inside, b.aside, b.heading, b.paragraph, named))
    return out


def is_main(tree: Node, row: tuple) -> bool:
    while tree.feature >= 0:
        tree = tree.low if row[tree.feature] < tree.limit else tree.high
    return tree.main


def main_text(page: str | None, by: Classifier) -> str:
    own = blocks(page or "", by.weights)
    return " ".join(b.text for b, row in zip(own, features(own), strict=True) if is_main(by.tree, row))


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every whole page.

    A null or empty page, or one without main text, has an empty text and 0 characters; null keys and URLs are kept;
    repeated rows each get a row; a page is read once from end to end, however long; markup may be broken or cut off
    anywhere; an empty table gives none; other columns, whatever their names, are ignored.
    """
    src = pick(df, key, url, page)
    shared = df.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, shared.value) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [key, url, "text", "n_chars"])

    kinds = [f.dataType.simpleString() for f in src.schema]
    return map_batches(src, run, f"`{key}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars bigint")
