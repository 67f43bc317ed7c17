"""Main text of web pages by boosted trees over DOM nodes, decoded top-down consistently.

A page becomes a tree of its block elements (and of inline ones with a class, id, role or itemprop). Each node has features of
its subtree (text, link and tag density, punctuation), of its attribute tokens and its ancestors', of depth, and of its place
among its siblings. An attribute token counts by the log-odds that nodes with it are the article's, learned from the training
pages; a token never seen there counts nothing. Gradient-boosted trees give the odds that a node's text is the article's. They
are trained on pages that `synthetic_page` writes, whose main parts are known, in many layouts: with telling tags, with telling
classes, with classes that tell nothing, with neither. Token weights and trees are fitted on different pages.

Decoding: every node is kept or dropped, and what stands in a dropped node is dropped. The labelling with the greatest
likelihood under that rule is found by dynamic programming from the leaves, so a choice for an ancestor and one for its
descendant can't contradict each other.

No text at all have: scripts, styles, titles, frames and fields (`RAW`, read up to their own end tag, as HTML does), and
templates, drawings, media and choices (`DROP`, subtrees that end with their end tag or their parent, at the latest where the
next block starts if they have no end tag). `noscript`, `object` and `math` are left to the trees.

Text: character references are decoded, white space in a block is one space, blocks are trimmed and joined by two line ends in
page order; nothing else is dropped and nothing is capped. Null and empty pages give "", an empty table gives an empty one, and
equal rows equal results. Text without any markup is one block and kept. Unclosed and misnested tags end as the HTML rules for
paragraphs, list items, cells and formatting say; the work is linear in the page at any depth. Other columns pass, null or not;
a column named as the result (`text`, and in the query `n_chars`) is replaced, and nothing else.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import ship
from .tokens import slices

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = set("script style title textarea iframe noframes noembed".split())
DROP = set("template svg select datalist canvas audio video".split())
#: Their content never meets what is around them.
SEALED = set("template svg".split())
BLOCK = set(
    "address article aside blockquote body button caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li listing main menu nav noscript object ol option optgroup p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph.
PARAGRAPH_ENDS = BLOCK - set("button body caption colgroup html noscript object option optgroup tbody td tfoot th thead tr legend frameset".split())
#: A start tag of the key ends open elements of the first list, up to the nearest one of the second.
TABLE = ("table",)
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "table", "td", "th")), "dt": (("dt", "dd"), ("dl", "table", "td", "th")), "dd": (("dt", "dd"), ("dl", "table", "td", "th")),
    "td": (("td", "th", "caption"), TABLE), "th": (("td", "th", "caption"), TABLE), "tr": (("tr", "td", "th", "caption"), TABLE), "button": (("button",), ("table", "td", "th")),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), TABLE)),
}
PARTS = set("table thead tbody tfoot tr td th caption".split())
WALLS = ("table", "td", "th", "caption")

TAGS = {
    **dict.fromkeys(["p", "blockquote", "pre"], 0), **dict.fromkeys(HEADINGS, 1), **dict.fromkeys("li dt dd ul ol dl menu".split(), 2), **dict.fromkeys("div section span center".split(), 3),
    **dict.fromkeys(["article", "main"], 4), "nav": 5, "header": 6, "footer": 7, "aside": 8, **dict.fromkeys("form fieldset button label legend dialog".split(), 9),
    **dict.fromkeys("table thead tbody tfoot tr td th caption".split(), 10), **dict.fromkeys(["figure", "figcaption"], 11), **dict.fromkeys(["noscript", "object"], 12),
}
N_TAGS = 14
N_BASE = 17
N_FEATURES = N_BASE + 5 + 2 * N_TAGS


class Dom:
    """Nodes in page order, as parallel lists; blocks are lists of (node, text)."""

    def __init__(self):
        self.parent, self.tag, self.attrs, self.depth = [-1], ["#root"], [()], [0]
        self.blocks: list[list[tuple[int, str]]] = []
        self.links: list[int] = [0]


def attribute_tokens(raw: str) -> tuple[str, ...]:
    """The words of class, id, role and itemprop, in lower case."""
    if "=" not in raw:
        return ()
    return tuple({t.lower() for value in ATTRIBUTE.findall(raw) for t in PIECES.findall(value)})


def read_tags(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of every tag; what RAW elements hold lies between the start and the end of theirs."""
    out, at, n, absent = [], 0, len(page), set()
    while m := TOKEN.search(page, at):
        start, at = m.span()
        name = (m[2] or "").lower()
        closing = m[1] == "/"
        if name in RAW and not closing:
            end = None if name in absent else re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            if end:
                at = end.end()
            else:  # never closed: code to the end of the page, other text to the next tag
                absent.add(name)
                at = n if name in ("script", "style") else page.find("<", at) % (n + 1)
        out.append((start, at, name, closing, m[3] or ""))
    return out


def drop_ends(tags: list) -> dict[int, int]:
    """Place of a DROP element's start tag -> place of its end tag, where it has one."""
    ends, waiting = {}, {x: [] for x in DROP}
    for i, (_, _, name, closing, _) in enumerate(tags):
        if name in DROP:
            if not closing:
                waiting[name].append(i)
            elif waiting[name]:
                ends[waiting[name].pop()] = i
    return ends


class Builder:
    """The open elements of a page while it is read. Every element is opened and ended once, so the work is linear."""

    def __init__(self):
        self.d = Dom()
        self.names: list[str | None] = ["#root"]
        self.nodes = [0]
        self.places: dict[str, list[int]] = {}  # name -> places of its open elements
        self.blocks_open: list[int] = []
        self.dropped: list[int] = []
        self.loose: list[int] = []  # dropped ones without an end tag
        self.block: list[tuple[int, str]] = []

    def last(self, names) -> int:
        return max((p[-1] for x in names if (p := self.places.get(x))), default=0)

    def flush(self) -> None:
        if self.block:
            self.d.blocks.append(self.block)
            self.block = []

    def text(self, raw: str) -> None:
        if raw and not self.dropped and (self.block or not raw.isspace()):
            node = self.nodes[-1]
            self.block.append((node, _html.unescape(raw) if "&" in raw else raw))
            if self.places.get("a"):
                self.d.links[node] += len(raw)

    def end_from(self, i: int) -> None:
        while len(self.names) > i:
            name = self.names.pop()
            self.nodes.pop()
            if name is not None:
                self.places[name].pop()
        for s in (self.blocks_open, self.dropped, self.loose):
            while s and s[-1] >= i:
                s.pop()

    def end_open(self, names, stops) -> None:
        stop = self.last(stops)
        if found := [p[-1] for x in names if (p := self.places.get(x)) and p[-1] > stop]:
            self.end_from(min(found))

    def end(self, name: str) -> None:
        at = self.places.get(name)
        if not at:
            return
        i = at[-1]
        if name not in BLOCK:
            if self.blocks_open and self.blocks_open[-1] > i and name not in DROP:  # formatting that a block outlives
                self.names[i] = None
                at.pop()
            else:
                self.end_from(i)
        elif self.last(TABLE if name in PARTS else WALLS) <= i:
            self.end_from(i)

    def start(self, name: str, raw: str, closed: bool) -> None:
        is_block = name in BLOCK
        if is_block:
            if self.loose and name not in ("option", "optgroup"):
                self.end_from(self.loose[0])
            if not self.dropped:
                self.flush()
            if name in PARAGRAPH_ENDS:
                self.end_open(("p",), (*WALLS, "button", "object"))
            if name in ENDS:
                self.end_open(*ENDS[name])
            if name in HEADINGS and self.names[-1] in HEADINGS:
                self.end_from(len(self.names) - 1)
        elif name == "a":
            self.end("a")
        if name in VOID or name in RAW:
            return
        if not is_block and raw.endswith("/") and name not in KNOWN_INLINE:
            return
        node, tokens = self.nodes[-1], attribute_tokens(raw)
        if not self.dropped and name not in DROP and (is_block or tokens):
            d = self.d
            d.parent.append(node)
            d.tag.append(name)
            d.attrs.append(tokens)
            d.depth.append(len(self.names))
            d.links.append(0)
            node = len(d.tag) - 1
        i = len(self.names)
        self.names.append(name)
        self.nodes.append(node)
        self.places.setdefault(name, []).append(i)
        if is_block:
            self.blocks_open.append(i)
        if name in DROP:
            self.dropped.append(i)
            if not closed:
                self.loose.append(i)


#: Elements that a slash at the end of their start tag doesn't close.
KNOWN_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt s samp small span strike strong sub sup time tt u var".split()) | DROP


def parse(page: str) -> Dom:
    tags = read_tags(page)
    ends = drop_ends(tags)
    b, at, i = Builder(), 0, 0
    while i < len(tags):
        start, end, name, closing, raw = tags[i]
        if start > at:
            b.text(page[at:start])
        at = end
        if name == "br":
            b.text(" ")
        elif closing:
            if name in BLOCK and not b.dropped:
                b.flush()
            b.end(name)
        elif name in SEALED and i in ends:
            i = ends[i]
            at = tags[i][1]
        elif name:
            b.start(name, raw, i in ends)
        i += 1
    b.text(page[at:])
    b.flush()
    return b.d


def node_features(d: Dom, weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(features, subtree text length) of every node."""
    n = len(d.tag)
    own, punct, words, blocks, first = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, np.inf)
    seen = 0
    for b in d.blocks:
        blocks[b[0][0]] += 1
        for node, t in b:
            own[node] += len(t)
            words[node] += t.count(" ") + 1
            punct[node] += t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count(";")
            first[node] = min(first[node], seen)
            seen += len(t)
    parent = d.parent
    sums = np.stack([own, np.array(d.links, float), punct, words, blocks, np.ones(n), *(np.array([float(t == x) for t in d.tag]) for x in ("p", "li", "h1"))], 1)
    kids, rank, same = [0] * n, [0] * n, [Counter() for _ in range(n)]
    for i in range(1, n):
        p = parent[i]
        rank[i] = kids[p]
        kids[p] += 1
        same[p][d.tag[i]] += 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        sums[p] += sums[i]
        if first[i] < first[p]:
            first[p] = first[i]
    text, link, pun, wor, blo, size, paragraphs, items, heads = sums.T
    total = max(text[0], 1.0)
    x = np.zeros((n, N_FEATURES), np.float32)
    up = np.array(parent)
    up[0] = 0
    kids = np.array(kids, float)
    first[np.isinf(first)] = total
    x[:, 0] = np.log1p(d.depth)
    x[:, 1] = np.log1p(text)
    x[:, 2] = link / np.maximum(text, 1)
    x[:, 3] = np.log1p(own)
    x[:, 4] = pun / np.maximum(wor, 1)
    x[:, 5] = kids
    x[:, 6] = np.log1p(paragraphs)
    x[:, 7] = text / total
    x[:, 8] = text / np.maximum(text[up], 1)
    x[:, 9] = first / total
    x[:, 10] = [same[parent[i]][d.tag[i]] if i else 0 for i in range(n)]
    x[:, 11] = np.array(rank) / np.maximum(kids[up], 1)
    x[:, 12] = np.log1p(text / np.maximum(blo, 1))
    x[:, 13] = items / np.maximum(size, 1)
    x[:, 14] = size / np.maximum(text, 1) * 100
    x[:, 15] = link[up] / np.maximum(text[up], 1)
    x[:, 16] = heads
    o = N_BASE
    for i in range(n):
        if w := [weights[t] for t in d.attrs[i] if t in weights]:
            x[i, o : o + 3] = sum(w), min(w), max(w)
    x[np.arange(n), o + 5 + np.array([TAGS.get(t, N_TAGS - 1) for t in d.tag])] = 1
    a = o + 5 + N_TAGS
    for i in range(1, n):  # what any ancestor has
        p = parent[i]
        x[i, o + 3] = min(x[p, o + 3], x[p, o + 1])
        x[i, o + 4] = max(x[p, o + 4], x[p, o + 2])
        np.maximum(x[p, a:], x[p, o + 5 : a], out=x[i, a:])
    return x, text


def keep(d: Dom, margin: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The likeliest keep / drop labels in which nothing is kept under a dropped node."""
    n = len(margin)
    if n == 1:
        return np.ones(1, bool)
    cost_keep = np.logaddexp(0, -margin)  # - log p(keep)
    cost_drop = np.logaddexp(0, margin)
    cost_keep[text == 0] = cost_drop[text == 0] = 0
    cost_keep[0] = cost_drop[0] = 0
    keep_, drop_ = cost_keep.copy(), cost_drop.copy()
    for i in range(n - 1, 0, -1):
        p = d.parent[i]
        keep_[p] += min(keep_[i], drop_[i])
        drop_[p] += drop_[i]
    out = np.zeros(n, bool)
    out[0] = True
    for i in range(1, n):
        out[i] = out[d.parent[i]] and keep_[i] <= drop_[i]
    return out


def blocks_of(d: Dom, kept: np.ndarray) -> str:
    out = []
    for b in d.blocks:
        t = " ".join("".join([t for node, t in b if kept[node]]).split())
        if t:
            out.append(t)
    return "\n\n".join(out)


class Extractor:
    def __init__(self, model: Boosted, weights: dict[str, float]):
        self.model, self.weights = model, weights

    def __call__(self, pages: list[str]) -> list[str]:
        doms = [parse(p) for p in pages]
        feats = [node_features(d, self.weights) for d in doms]
        margin = self.model.margin(np.concatenate([f for f, _ in feats])) if feats else np.zeros(0)
        out, at = [], 0
        for d, (f, text) in zip(doms, feats, strict=True):
            out.append(blocks_of(d, keep(d, margin[at : at + len(f)], text)))
            at += len(f)
        return out


# --- training pages -------------------------------------------------------------------------------------------------------

MAIN, REST = "\ue000", "\ue001"  # marks of known text, taken out before training

#: What pages commonly call their parts. The model sees these words only as it sees any other: by the nodes that carry them.
NAMES = {
    "comments": "comment comments reply replies disqus respond discussion responses thread feedback", "nav": "nav navigation menu navbar breadcrumb breadcrumbs crumbs pagination pager tabs toc skip links topnav mainmenu",
    "ad": "ad ads advert advertisement adbox banner sponsor sponsored promo promotion outbrain taboola dfp commercial adslot", "footer": "footer foot copyright colophon legal bottom contentinfo imprint",
    "top": "header head masthead topbar top logo branding banner site", "side": "sidebar side aside rail widget widgets column secondary complementary tertiary",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay dialog toast message paywall", "form": "form login signin signup subscribe newsletter search contact register",
    "share": "share sharing social facebook twitter follow like likes buttons", "related": "related recommended more popular trending recent similar also further",
    "body": "content main body text story prose maincontent primary page copy", "article": "article post entry blog news single hentry story feature", "meta": "meta byline author date tags tag category info timestamp published",
}
#: Words of layout, which tell nothing.
LAYOUT = "row col md lg wrapper wrap container inner outer box clearfix block section module grid flex item group left right center wide full clear panel region view".split()


def synthetic_page(r: random.Random) -> str:
    """A page whose text carries MAIN or REST marks. Layout, markup and lengths are drawn from `r`."""
    style = r.choice(["tags", "tags", "classes", "both", "plain", "dull"])
    syllables = [a + b for a in r.sample("bcdfghklmnprstvw", 10) for b in r.sample("aeiouéüñ", 5)]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.choice([1, 1, 2, 2, 3])))
    some = lambda p: r.random() < p

    def words(mark: str, lo: int, hi: int) -> str:
        return mark + " ".join(word() for _ in range(r.randint(lo, hi)))

    def sentences(mark: str, lo: int, hi: int) -> str:
        out = []
        for _ in range(r.randint(lo, hi)):
            s = [word() + ("," if some(0.1) else "") for _ in range(r.randint(2, 18))]
            out.append(" ".join(s).capitalize().rstrip(",") + r.choice("...!?"))
        return mark + " ".join(out)

    def dull() -> str:
        return r.choice([r.choice(LAYOUT), f"{r.choice(LAYOUT)}-{r.randint(1, 12)}", word(), f"{r.choice(LAYOUT)} {word()}"])

    def wrap(tag: str, part: str, inner: str, telling: bool = False) -> str:
        """An element of that kind; in plain and dull pages only parts that nothing else tells apart have a telling name."""
        t = tag if style in ("tags", "both") else "div"
        name = r.choice(NAMES[part].split()) + r.choice(["", "", "-box", "_wrap", " clear", f"-{word()}"])
        tells = t in ("nav", "footer", "aside", "article", "main")
        if style in ("classes", "both") or t == "div" and style == "tags" or telling and not tells and (style != "dull" or some(0.7)):
            return f'<{t} {r.choice(["class", "class", "id"])}="{name}">{inner}</{t}>'
        return f'<{t} class="{dull()}">{inner}</{t}>' if style == "dull" else f"<{t}>{inner}</{t}>"

    def link_list(k: int) -> str:
        items = [f'<li><a href="/{word()}">{words(REST, 1, 4)}</a></li>' for _ in range(k)]
        return f"<ul>{''.join(items)}</ul>" if some(0.8) else " | ".join(i[4:-5] for i in items)

    def linked() -> str:
        """A paragraph of the article in which a link stands, before, inside or after its words."""
        link = f'<a href="/{word()}">{words("", 1, 6)}</a>'
        return r.choice([f"<p>{words(MAIN, 1, 3).capitalize()}: {link}{r.choice(['', '.'])}</p>", f"<p>{sentences(MAIN, 1, 2)} {link} {sentences('', 1, 2)}</p>", f"<p>{MAIN}{link} {sentences('', 1, 2)}</p>", f"<p>{sentences(MAIN, 1, 1)} {link}, {link}.</p>"])

    def article() -> str:
        parts = [f"<h1>{words(MAIN, 2, 12)}</h1>"] if some(0.7) else []
        if some(0.25):  # who wrote it and when: part of the article
            parts.append(wrap(r.choice(["div", "p"]), "meta", f"{MAIN}{word()} {word()}, {r.randint(1, 28)}.{r.randint(1, 12)}.20{r.randint(10, 25)}", True))
        if parts and some(0.2):
            parts = [f"<header{r.choice(['', ' class=entry-header'])}>{''.join(parts)}</header>"]
        for _ in range(r.choice([1, 1, 1, 2, 3, 4, 6, 8, 12, 16])):
            k = r.random()
            if k < 0.62:
                parts.append(f"<p>{sentences(MAIN, 1, r.choice([1, 1, 2, 5, 9]))}</p>")
            elif k < 0.68:
                parts.append(f"<p><b>{sentences(MAIN, 1, 3)}<br><p>{sentences(MAIN, 1, 4)}</p>")
            elif k < 0.74:
                parts.append(f"<h2>{words(MAIN, 1, 6)}</h2>")
            elif k < 0.79:
                parts.append("<ul>" + "".join(f"<li>{words(MAIN, 2, 14)}" + r.choice(["", "</li>"]) for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.82:
                parts.append(f"<blockquote>{sentences(MAIN, 1, 3)}</blockquote>")
            elif k < 0.85:
                parts.append("<table>" + "".join(f"<tr><td>{words(MAIN, 1, 4)}</td><td>{words(MAIN, 1, 4)}</td></tr>" for _ in range(r.randint(2, 6))) + "</table>")
            elif k < 0.95:
                parts.append(linked())
            elif k < 0.97:
                parts.append(f"<noscript><p>{words(MAIN, 3, 12)}</p></noscript>" if some(0.3) else f"<div>{sentences(MAIN, 1, 3)}</div>")
            else:
                parts.append(f"<figure><img src=x><figcaption>{words(MAIN, 3, 12)}</figcaption></figure>")
        if some(0.25):
            parts.insert(r.randint(0, len(parts)), wrap("div", "ad", r.choice([words(REST, 1, 6), f"<p>{sentences(REST, 1, 3)}</p>"]), True))
        if some(0.25):
            parts.append(wrap("div", r.choice(["share", "related"]), link_list(r.randint(2, 5)), True))
        body = "".join(parts)
        k = r.random()
        if k < 0.55:
            return wrap(r.choice(["article", "article", "main"]), r.choice(["body", "article"]), body)
        if k < 0.85:
            return f"<div{r.choice(['', ' class=' + word(), f' class=\"{dull()}\"', ' class=' + r.choice(NAMES['body'].split())])}>{body}</div>"
        return body

    def comments() -> str:
        one = lambda: f'<div class="{r.choice(["comment", "reply", word()])}"><b>{REST}{word()}</b><p>{sentences(REST, 1, 4)}</p></div>'
        return wrap("section", "comments", f"<h3>{words(REST, 1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 6))), True)

    before, after = [], []
    if some(0.8):
        before.append(wrap("nav", "nav", link_list(r.randint(3, 10))))
    if some(0.5):
        before.insert(0, wrap("header", "top", f"<div>{words(REST, 1, 4)}</div>" + (f"<p>{sentences(REST, 1, 1)}</p>" if some(0.4) else "") + (link_list(4) if some(0.4) else "")))
    if some(0.5):
        before.append(wrap("div", "ad", r.choice([sentences(REST, 1, 4), f"<p>{sentences(REST, 1, 2)}</p>", words(REST, 2, 8)]), True))
    if some(0.3):
        (before if some(0.5) else after).append(wrap("div", "notice", f"<p>{sentences(REST, 1, 3)}</p><button>{words(REST, 1, 2)}</button>", True))
    if some(0.15):
        (before if some(0.5) else after).append(f"<noscript>{r.choice(['', '<p>'])}{sentences(REST, 1, 2)}</noscript>")
    if some(0.3):
        (before if some(0.3) else after).append(wrap("aside", "side", f"<h3>{words(REST, 1, 3)}</h3>" + r.choice([link_list(r.randint(3, 8)), f"<p>{sentences(REST, 1, 4)}</p>"]), True))
    if some(0.3):
        after.append(f"<form><label>{words(REST, 1, 3)}</label><input name=q><p>{sentences(REST, 1, 2)}</p><button>{words(REST, 1, 1)}</button></form>")
    if some(0.35):
        after.append(comments())
    if some(0.3):
        after.append(wrap("div", "related", f"<h3>{words(REST, 1, 3)}</h3>" + link_list(r.randint(2, 6)), True))
    if some(0.85):
        after.append(wrap("footer", "footer", r.choice([f"{REST}&copy; {word()} &middot; {sentences('', 1, 3)}", f"{REST}&copy; {word()}", f"<p>{sentences(REST, 1, 2)}</p>" + link_list(3), words(REST, 1, 8)]), style != "tags" or some(0.5)))
    if some(0.15):  # nothing but the article
        before, after = [], []
    inner = "".join(before) + article() + "".join(after)
    if some(0.3):
        inner = f'<div class="{r.choice(["page", "wrapper", "container", "site content", dull()])}">{inner}</div>'
    if some(0.15):  # a fragment
        return inner
    return f"<html><head><title>{word()}</title></head><body>{inner}</body></html>"


def labelled_page(page: str) -> tuple[Dom, np.ndarray, np.ndarray]:
    """A page without its marks, and the lengths of main and other text in every node."""
    d = parse(page)
    main, rest, mode = np.zeros(len(d.tag)), np.zeros(len(d.tag)), MAIN
    for b in range(len(d.blocks)):
        clean = []
        for node, t in d.blocks[b]:
            for mark in (MAIN, REST):
                if mark in t:
                    mode, t = mark, t.replace(mark, "")
            (main if mode == MAIN else rest)[node] += len(t)
            clean.append((node, t))
        d.blocks[b] = clean
    for i in range(len(d.tag) - 1, 0, -1):
        main[d.parent[i]] += main[i]
        rest[d.parent[i]] += rest[i]
    return d, main, rest


def token_weights(pages: list[tuple[Dom, np.ndarray, np.ndarray]], least: int = 4) -> dict[str, float]:
    """Log-odds that a node with the token is the article's, for tokens on `least` nodes; less for rarer ones."""
    yes, no = Counter(), Counter()
    for d, main, rest in pages:
        for i in range(1, len(d.tag)):
            if main[i] + rest[i] > 0:
                (yes if main[i] > rest[i] else no).update(d.attrs[i])
    odds = math.log((sum(yes.values()) + 1) / (sum(no.values()) + 1))
    return {t: round(math.log((yes[t] + 1) / (no[t] + 1)) - odds, 6) for t in sorted(yes | no) if yes[t] + no[t] >= least}


@lru_cache(2)
def train(pages: int = 1000, seed: int = 7) -> Extractor:
    """The model: the same at every call with the same arguments."""
    r, xs, ys = random.Random(seed), [], []
    weights = token_weights([labelled_page(synthetic_page(r)) for _ in range(pages)])
    for _ in range(pages):
        d, main, rest = labelled_page(synthetic_page(r))
        x, text = node_features(d, weights)
        use = (text > 0) & ((main == 0) | (rest <= 0.5 * main)) & (np.arange(len(text)) > 0)
        xs.append(x[use])
        ys.append((main > rest)[use])
    return Extractor(Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float)), weights)


def extract(pages: DataFrame, extractor: Extractor | None = None, html_col: str = "html", name: str = "text") -> DataFrame:
    """All rows and columns with the main text."""
    ship(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(extractor or train())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = sent.value
        for b in batches:
            out: list[str] = []
            for part in slices(["" if t is None else t for t in b]):
                out += e(part)
            yield pd.Series(out, dtype=object)

    return pages.drop(name).withColumn(name, run(F.col(html_col)))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_html_extract": op7_html_extract}
