"""Main text of web pages: boosted trees over DOM-node features and hierarchical decoding.

Every block element of a page is a node with features: its tag, tokens of its class, id and
role, text density and link density of its subtree, depth, its place among its siblings, what
its ancestors say. Boosted trees give the log odds that the node belongs to the article or
holds it. Decoding then picks, for the whole tree at once, the labels of greatest likelihood
under one rule: below a rejected node all is rejected. So no text is kept inside a menu, and
a container is kept if what it holds is. Text is kept where its own node is.

The trees are fitted on pages made here, by layout rules with random words, names and
nesting: a bounded, deterministic sample (``TRAINING_PAGES``), independent of the corpus.

Defined results: null and empty pages give empty text; scripts, styles, templates and
comments are never text; what SVG, MathML and media elements hold is text of the node around
them, and `/>` closes within SVG and MathML; unclosed or crossed tags are repaired as browsers do for blocks; a
tag cut off by the end of the page is dropped; repeated rows are treated alike; pages of
any length are read whole. An empty table gives an empty one; only the id, the url and the page
are read, so other columns may have any name.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from limnos.llm.gbt import BoostedTrees

TRAINING_PAGES = 900
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*'|["'<])*?)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

#: Element names by kind, fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title noscript template iframe textarea".split())
#: Elements that stand within text and hold it without a node of their own, so that one left open ends with its parent.
EMBEDDED = frozenset("svg math object canvas audio video".split())
#: What SVG and MathML hold besides visible text.
UNSEEN = frozenset("annotation annotation-xml desc metadata".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: What an opening tag closes first, and the elements that stop the search.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

KINDS = ("article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6 hgroup", "li dt dd", "ul ol dl menu", "nav", "header", "footer", "aside", "form fieldset button select option input legend dialog", "table tr td th tbody thead caption", "blockquote pre figure figcaption address details", "body html")
#: Tokens of class, id and role by what they tend to mean, a lexicon of common usage.
HINTS = (
    "article content contents entry main post story text body page prose blog news",
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip",
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion promoted affiliate outbrain taboola",
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall message",
    "comment comments respond reply replies discussion disqus thread reviews feedback",
    "share sharing social related recommended recommendations popular trending more tags widget sidebar side aside rail complementary",
    "footer foot bottom copyright legal colophon contentinfo header masthead top banner logo",
    "form login search searchbox signin register input button",
)
_KIND = {tag: k for k, tags in enumerate(KINDS) for tag in tags.split()}
_HINT: dict[str, list[int]] = {}
for _k, _words in enumerate(HINTS):
    for _w in _words.split():
        _HINT.setdefault(_w, []).append(_k)
#: Elements that end SVG and MathML left open.
_HTML = CLOSES_P | VOID | frozenset(_KIND) | frozenset(IMPLIED) | frozenset(("html", "head"))
_BAD_TAGS = frozenset("nav footer aside form header button select".split())
N_FEATURES = len(KINDS) + len(HINTS) + 20


class Page:
    """Nodes and pieces of text of one page, in page order."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.hints = ["#"], [-1], [0]
        self.tags_inside, self.links = [0], [0]
        #: (node, text), or None where a block begins or ends
        self.pieces: list[tuple[int, str] | None] = []
        self._parse(html)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        hints = 0
        if attributes and "=" in attributes:
            for _, value in _ATTRIBUTE.findall(attributes):
                for token in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                    for k in _HINT.get(token, ()):
                        hints |= 1 << k
        self.tag.append(tag)
        self.parent.append(parent)
        self.hints.append(hints)
        self.tags_inside.append(0)
        self.links.append(0)
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        stack, pieces, at, link = [0], self.pieces, 0, False
        foreign = ""
        search, tags = _TOKEN.search, self.tag
        while True:
            m = search(html, at)
            start = m.start() if m else len(html)
            if start > at:
                text = html[at:start]
                if "&" in text:
                    text = unescape(text)
                pieces.append((stack[-1], text))
                if link:
                    self.links[stack[-1]] += len(text.strip())
            if m is None:
                return
            at = m.end()
            end, tag = m[1], m[2]
            if tag:
                tag = tag.lower()
                if m[0][-1] != ">":  # cut off by the end of the page
                    return
                if foreign and tag in _HTML:
                    foreign = ""
                closed = (foreign or tag in ("svg", "math")) and m[0].endswith("/>")
                if foreign and tag in UNSEEN and not closed:
                    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                    at = close.end() if close else at
                elif tag in EMBEDDED or (foreign and (closed or tag not in RAW)):
                    self.tags_inside[stack[-1]] += 1
                    if tag in ("svg", "math") and not closed and not foreign:
                        foreign = tag
                    if tag != "math" and foreign != "math":
                        pieces.append(None)
                elif tag in RAW:
                    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                    at = close.end() if close else len(html)
                elif tag in INLINE:
                    self.tags_inside[stack[-1]] += 1
                    link = True if tag == "a" else link
                elif tag in VOID:
                    pieces.append(None)
                elif tag not in ("html", "head"):
                    pieces.append(None)
                    link = False
                    if tag in CLOSES_P and len(stack) > 1 and tags[stack[-1]] == "p":
                        stack.pop()
                    if tag in IMPLIED:
                        closes, stops = IMPLIED[tag]
                        for k in range(len(stack) - 1, 0, -1):
                            if tags[stack[k]] in closes:
                                del stack[k:]
                                break
                            if tags[stack[k]] in stops:
                                break
                    stack.append(self._open(tag, m[3], stack[-1]))
            elif end:
                end = end.lower()
                if end == "a":
                    link = False
                elif end in EMBEDDED or (foreign and end not in _HTML):
                    if end != "math" and foreign != "math":
                        pieces.append(None)
                    foreign = "" if end == foreign else foreign
                elif end not in INLINE and end not in VOID:
                    foreign = ""
                    pieces.append(None)
                    link = False
                    for k in range(len(stack) - 1, 0, -1):
                        if tags[stack[k]] == end:
                            del stack[k:]
                            break

    def features(self) -> np.ndarray:
        n = len(self.tag)
        chars, words, stops = [0] * n, [0] * n, [0] * n
        for piece in self.pieces:
            if piece:
                node, text = piece
                k = len(text.split())
                if k:
                    chars[node] += len(text)
                    words[node] += k
                    stops[node] += text.count(".") + text.count("!") + text.count("?") + text.count(",")
        own_words = list(words)
        links, inner, blocks = list(self.links), [1 + t for t in self.tags_inside], [int(w > 0) for w in words]
        parent = self.parent
        for k in range(n - 1, 0, -1):
            p = parent[k]
            chars[p] += chars[k]
            words[p] += words[k]
            stops[p] += stops[k]
            links[p] += links[k]
            inner[p] += inner[k]
            blocks[p] += blocks[k]
        depth, above, bad = [0] * n, [0] * n, [0] * n
        order, count, same, lead = [0] * n, [0] * n, [0] * n, [0] * n
        seen_same: dict[tuple[int, str], int] = {}
        before = [0] * n
        total = 0
        for k in range(1, n):
            p = parent[k]
            depth[k] = depth[p] + 1
            above[k] = above[p] | self.hints[p]
            bad[k] = bad[p] + (self.tag[p] in _BAD_TAGS)
            order[k] = count[p]
            count[p] += 1
            key = (p, self.tag[k])
            same[k] = seen_same.get(key, 0)
            seen_same[key] = same[k] + 1
            before[k] = lead[p]
            lead[p] += chars[k]
            total += 1
        f = np.zeros((n, N_FEATURES), np.float32)
        kinds = np.array([_KIND.get(t, -1) for t in self.tag])
        known = np.flatnonzero(kinds >= 0)
        f[known, kinds[known]] = 1
        c, hints, above_ = len(KINDS), np.array(self.hints), np.array(above)
        for k in range(len(HINTS)):
            f[:, c + k] = (hints >> k) & 1
        c += len(HINTS)
        p = np.maximum(np.array(parent), 0)
        chars_, words_, inner_, links_, blocks_ = (np.array(v, float) for v in (chars, words, inner, links, blocks))
        f[:, c] = above_ & 1
        f[:, c + 1] = (above_ >> 1) > 0
        f[:, c + 2] = bad
        f[:, c + 3] = depth
        f[:, c + 4] = np.log1p(chars_)
        f[:, c + 5] = np.log1p(words_)
        f[:, c + 6] = links_ / np.maximum(chars_, 1)
        f[:, c + 7] = np.array(stops) / np.maximum(words_, 1)
        f[:, c + 8] = chars_ / inner_
        f[:, c + 9] = words_ / np.maximum(blocks_, 1)
        f[:, c + 10] = np.log1p(inner_)
        f[:, c + 11] = order
        f[:, c + 12] = np.array(count)[p]
        f[:, c + 13] = same
        f[:, c + 14] = chars_ / np.maximum(chars_[p], 1)
        f[:, c + 15] = chars_ / max(chars_[0], 1)
        f[:, c + 16] = np.array(before) / np.maximum(chars_[p], 1)
        f[:, c + 17] = np.log1p(np.array(own_words))
        f[:, c + 18] = f[p, c + 6]
        f[:, c + 19] = f[p, c + 9]
        return f

    def decode(self, odds: np.ndarray) -> list[bool]:
        """Labels of greatest likelihood such that below a rejected node all is rejected."""
        n = len(self.tag)
        yes, no = (-np.logaddexp(0, -odds)).tolist(), (-np.logaddexp(0, odds)).tolist()
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            yes[p] += max(yes[k], no[k])
            no[p] += no[k]
        keep = [True] * n
        for k in range(1, n):
            keep[k] = keep[self.parent[k]] and yes[k] >= no[k]
        return keep

    def text(self, keep: list[bool]) -> str:
        parts: list[str] = []
        for piece in self.pieces:
            if piece is None:
                parts.append(" ")
            elif keep[piece[0]]:
                parts.append(piece[1])
            else:
                parts.append(" ")
        return " ".join("".join(parts).split())


class _Maker:
    """Random pages with a label on every block element, as the attribute `y`."""

    def __init__(self, rng: random.Random) -> None:
        self.rng = rng

    def words(self, n: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice("aeiounrstlhdmcp") for _ in range(r.randint(1, 9))) for _ in range(n))

    def sentence(self) -> str:
        return ", ".join(self.words(self.rng.randint(1, 9)) for _ in range(self.rng.randint(1, 3))).capitalize() + self.rng.choice("....?!")

    def named(self, tags: str, names: str, y: int) -> tuple[str, str]:
        r = self.rng
        tag = r.choice(tags.split())
        attribute = r.choice(["", f' class="{r.choice(names.split())}"', f' id="{r.choice(names.split())}"', f' class="{self.words(1)} {r.choice(names.split())}-{self.words(1)}"', f' class="{self.words(1)}"']) if tag == "div" or r.random() < 0.4 else ""
        if tag in ("div", "section", "ul", "p") and y == 0 and r.random() < 0.85:
            attribute = f' class="{r.choice(names.split())}"'
        return f'<{tag} y="{y}"{attribute}>', f"</{tag}>"

    def paragraph(self, y: int = 1) -> str:
        r = self.rng
        inner = " ".join(self.sentence() for _ in range(r.choice([1, 1, 2, 3, 6, 12])))
        if y and r.random() < 0.03:  # very long ones
            inner = " ".join([inner] * r.choice([10, 50, 200, 1000]))
        if r.random() < 0.2:
            inner = f"<b>{inner}" + r.choice(["</b>", "<br>", "<br>"])
        elif r.random() < 0.15:
            inner += f' <a href="x">{self.words(2)}</a> {self.words(3)}.'
        return f'<p y="{y}">{inner}' + ("</p>" if r.random() < 0.85 else "")

    def items(self, n: int, y: int, link: bool) -> str:
        return "".join(f'<li y="{y}">' + (f'<a href="/x">{self.words(self.rng.randint(1, 4))}</a>' if link else self.sentence()) + self.rng.choice(["</li>", "</li>", ""]) for _ in range(n))

    def menu(self) -> str:
        r = self.rng
        a, z = self.named("nav nav div header", "nav menu navbar navigation breadcrumbs top", 0)
        inner = f'<ul y="0">{self.items(r.randint(2, 9), 0, True)}</ul>' if r.random() < 0.7 else " ".join(f'<a href="/">{self.words(1)}</a>' for _ in range(r.randint(2, 8)))
        return a + inner + z

    def noise(self, kinds: str) -> str:
        r = self.rng
        kind = r.choice(kinds.split())
        short = " ".join(self.sentence() for _ in range(r.choice([1, 1, 2])))
        if kind == "menu":
            return self.menu()
        if kind == "ad":
            a, z = self.named("div div aside section p", "ad ads advert advertisement banner sponsored promo", 0)
            return a + (f'<p y="0">{short}</p>' if r.random() < 0.3 and not a.startswith("<p") else short) + z
        if kind == "side":
            a, z = self.named("aside aside div", "sidebar related widget recommended popular", 0)
            return f'{a}<h3 y="0">{self.words(2)}</h3>' + (f'<ul y="0">{self.items(r.randint(2, 7), 0, True)}</ul>' if r.random() < 0.6 else self.paragraph(0)) + z
        if kind == "notice":
            a, z = self.named("div div section", "cookie consent notice newsletter popup subscribe gdpr alert", 0)
            return f'{a}<p y="0">{short}</p>' + r.choice(["", f'<button y="0">{self.words(1)}</button>']) + z
        if kind == "form":
            return f'<form y="0"><label>{self.words(2)}</label><input><select y="0"><option y="0">{self.words(1)}<option y="0">{self.words(1)}</select><button y="0">{self.words(1)}</button></form>'
        if kind == "comments":
            a, z = self.named("section div div", "comments comment discussion replies respond", 0)
            return f'{a}<h3 y="0">{self.words(2)}</h3>' + "".join(f'<div y="0" class="comment">{self.paragraph(0)}</div>' for _ in range(r.randint(1, 5))) + z
        if kind == "share":
            a, z = self.named("div div ul", "share social sharing tags", 0)
            return a + " ".join(f'<a href="/">{self.words(1)}</a>' for _ in range(r.randint(2, 5))) + z
        if kind == "header":
            a, z = self.named("header header div", "header masthead top banner logo", 0)
            return a + r.choice([f'<h2 y="0">{self.words(2)}</h2>', f"{self.words(3)}", self.sentence()]) + r.choice(["", self.menu()]) + z
        a, z = self.named("footer footer div", "footer foot bottom copyright colophon", 0)
        return a + r.choice(["&copy; " + self.words(2) + " &middot; " + short, f'<p y="0">&copy; {short}</p>', f'<ul y="0">{self.items(3, 0, True)}</ul>', short]) + z

    def article(self) -> str:
        r = self.rng
        a, z = self.named("article article article main div section", "content article post entry story main-content text", 1)
        if a.startswith(("<div", "<section")) and r.random() < 0.7:
            a = a.replace(">", ' class="post content">', 1) if "class" not in a else a
        out = r.choice([f'<h1 y="1">{self.words(r.randint(2, 9))}</h1>', f'<h1 y="1">{self.sentence()}</h1>', ""])
        for _ in range(r.choice([0, 1, 2, 4, 8, 20, 40])):
            x = r.random()
            if x < 0.72:
                out += self.paragraph()
            elif x < 0.80:
                out += f'<h2 y="1">{self.words(r.randint(1, 6))}</h2>'
            elif x < 0.86:
                out += f'<ul y="1">{self.items(r.randint(1, 6), 1, False)}</ul>'
            elif x < 0.89:
                out += f'<blockquote y="1">{r.choice([self.sentence(), self.paragraph()])}</blockquote>'
            elif x < 0.91:
                out += f'<table y="1"><tr y="1"><td y="1">{self.words(2)}<td y="1">{self.words(1)}</tr></table>'
            elif x < 0.94:
                out += f'<div y="1">{self.sentence()}</div>'
            else:
                out += self.noise("ad ad share notice side form")
        if not out or r.random() < 0.3:
            out += self.paragraph()
        return a + out + z

    def page(self) -> str:
        r = self.rng
        top = "".join(self.noise("menu menu header ad notice form") for _ in range(r.choice([0, 1, 1, 2, 3])))
        end = "".join(self.noise("footer footer side ad comments notice share menu") for _ in range(r.choice([0, 1, 1, 2, 3])))
        body = self.article()
        if r.random() < 0.35:
            body = f'<div y="1"{r.choice(["", " class=wrapper", " id=page", " class=container"])}>' + r.choice(["", self.noise("side menu ad")]) + body + r.choice(["", self.noise("side comments share")]) + "</div>"
        return f'<html><head><title>{self.words(3)}</title></head><body y="1">{top}{body}{end}</body></html>'


@lru_cache(1)
def fitted(pages: int = TRAINING_PAGES, seed: int = 7) -> BoostedTrees:
    maker = _Maker(random.Random(seed))
    label = re.compile(r'\by="([01])"')
    x, y = [], []
    for _ in range(pages):
        html = maker.page()
        page = Page(html)
        labels = [int(v) for v in label.findall(html)]
        assert len(labels) == len(page.tag) - 1
        f = page.features()
        x.append(f[1:])
        y += labels
    return BoostedTrees().fit(np.concatenate(x), np.array(y, float))


def main_texts(htmls: list[str], model: BoostedTrees) -> list[str]:
    """Main text of each page; features of many pages go through the trees together."""
    out: list[str] = []
    lo = 0
    while lo < len(htmls):
        hi, size = lo, 0
        while hi < len(htmls) and (hi == lo or size < 1 << 20):
            size += len(htmls[hi])
            hi += 1
        pages = [Page(h) for h in htmls[lo:hi]]
        odds = model.decision(np.concatenate([p.features() for p in pages]))
        at = 0
        for page in pages:
            n = len(page.tag)
            out.append(page.text(page.decode(odds[at : at + n])))
            at += n
        lo = hi
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars. The trees are fitted once, on the driver, and are a few kilobytes."""
    model = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = main_texts([h or "" for h in part.column(2).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
