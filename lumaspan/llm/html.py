"""Operator 4, main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page is read into a tree (unclosed and stray tags are mended; comments, scripts, styles and the head hold no text). Each
block element gets features: its tag, tokens of its and its ancestors' class, id and role (hashed), depth, sibling
statistics, and densities of its subtree (text to markup, text in links, paragraphs, share of the page's text). Boosted
regression trees give the log odds that a node belongs to the article. Decoding picks the set of nodes of largest total
log odds among those where a node is in only if all its ancestors are, by one pass up and one pass down the tree, so no
chosen node stands in a rejected one. The texts of the chosen nodes, block by block, are the result.

The trees are fitted, in the driver and with a fixed seed, on ``TRAIN_PAGES`` pages that ``sample_page`` makes up with known
labels; no page of the input takes part.

Null, empty and tagless html: null and empty give an empty text, a page without tags its text. Very long and broken pages are
handled whole, by loops whose time grows with the page's length: a < that no > follows is text, a quote without its match an
ordinary character. Formulas, pictures' texts and fallback texts are text like other. Repeated rows are extracted each; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumaspan.llm.common import pages

TRAIN_PAGES = 800
TREES, DEPTH, RATE, BINS = 70, 4, 0.3, 32
HASHED = 512

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTR = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
RAW_END = {t: re.compile("</" + t, re.I | re.A) for t in RAW}
SILENT = frozenset("head script style title template textarea select iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input "
    "object canvas audio video svg g tspan math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics annotation".split()
)
CLOSED_BY_BLOCK = frozenset(["p"])
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table html body div article section".split())
GROUPS = {t: k for k, names in enumerate((
    "nav menu", "header", "footer", "aside", "form fieldset button", "article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd",
    "table thead tbody tfoot tr td th", "blockquote pre", "figure figcaption", "html body",
)) for t in names.split()}
NUMERIC = 16


class Tags:
    """The tags of a page from left to right, in time linear in its length. A quote without its match is an ordinary character;
    if the page ends inside quotes that swallow a tag's end, quotes count no more."""

    def __init__(self, html: str):
        self.html, self.last, self.quotes = html, {c: html.rfind(c) for c in "\"'>"}, True

    def end(self, pos: int) -> int:
        """Where the tag ends whose attributes start here."""
        at = pos
        while self.quotes:
            m = STOP.search(self.html, at)
            if not m:
                self.quotes = False
            elif m[0] == ">":
                return m.end()
            else:
                at = self.html.find(m[0], m.end()) + 1 if m.start() < self.last[m[0]] else m.end()
        return self.html.find(">", pos) + 1

    def next(self, pos: int) -> tuple[int, int, str, bool, str] | None:
        """Start, end, name, whether it is an end tag, attributes; comments and declarations have no name."""
        html = self.html
        while (at := html.find("<", pos)) >= 0:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(html), "", False, ""
            if at > self.last[">"]:
                return None
            if html[at + 1] in "!?":
                return at, html.find(">", at) + 1, "", False, ""
            m = NAME.match(html, at + 1)
            if m and m.end() <= self.last[">"]:
                end = self.end(m.end())
                return at, end, m[1].lower(), html[at + 1] == "/", html[m.end() : end - 1]
            pos = at + 1
        return None


class Page:
    """Nodes of a page in document order: tag, parent, depth, tokens, own text; and its text pieces."""

    def __init__(self, html: str):
        self.tag, self.parent, self.depth, self.tokens = ["html"], [-1], [0], [()]
        self.size, self.links, self.at, self.end = [0], [0], [0], [len(html)]
        self.pieces: list[tuple[int, int, str]] = []  # (block number, node, text)
        stack, inline, block, silent, pos, n = [0], [], 0, 0, 0, len(html)
        tags, opened, within = Tags(html), Counter(["html"]), Counter()  # open blocks and inline elements by name

        def close(k: int, at: int) -> int:
            """Closes the blocks from the k-th on; returns how many of them were silent."""
            for x in stack[k:]:
                self.end[x] = at
                opened[self.tag[x]] -= 1
            mute = sum(self.tag[x] in SILENT for x in stack[k:])
            del stack[k:]
            inline.clear()
            within.clear()
            return mute

        while pos < n:
            found = tags.next(pos)
            start, after, name, ends, attrs = found or (n, n, "", False, "")
            if start > pos and not silent:
                self._text(html[pos:start], stack[-1], block, within["a"] > 0)
            if not found:
                break
            pos = after
            if not name:
                continue
            if ends:
                if name in INLINE:
                    while within[name]:  # what was opened after it ends as well
                        within[inline[-1]] -= 1
                        if inline.pop() == name:
                            break
                    continue
                block += 1
                if opened[name] and (k := next((k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == name), 0)):
                    silent -= close(k, start)
                continue
            if name in INLINE:
                if name == "br":
                    if not silent:
                        self._text(" ", stack[-1], block, False)
                elif name not in VOID and not attrs.endswith("/"):
                    inline.append(name)
                    within[name] += 1
                continue
            block += 1
            if name in VOID:
                continue
            if name in ("html", "body") and opened[name]:
                continue
            closes = CLOSED_BY_BLOCK
            if name in SAME:
                closes = SAME[name]
            k = len(stack) - 1
            while k > 0 and (opened["p"] or any(opened[x] for x in closes)) and self.tag[stack[k]] not in SCOPE:
                if self.tag[stack[k]] in closes or self.tag[stack[k]] == "p":
                    silent -= close(k, start)
                k -= 1
            said = ATTR.findall(attrs)
            tokens = tuple(t for a in said for t in re.split(r"[^a-z]+", a.lower()) if t) if said else ()
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.tokens.append(tokens)
            self.size.append(0)
            self.links.append(0)
            self.at.append(start)
            self.end.append(n)
            if name in RAW:
                shut = RAW_END[name].search(html, pos)
                pos = (html.find(">", shut.end()) + 1 or n) if shut else n
                if name not in SILENT and not silent:
                    self._text(html[after : shut.start() if shut else n], len(self.tag) - 1, block, False)
                self.end[-1] = pos
                block += 1
                continue
            stack.append(len(self.tag) - 1)
            opened[name] += 1
            silent += name in SILENT

    def _text(self, text: str, node: int, block: int, link: bool) -> None:
        if "&" in text:
            text = unescape(text)
        self.pieces.append((block, node, text))
        k = len(text) if not text.isspace() else 0
        self.size[node] += k
        if link:
            self.links[node] += k

    def features(self) -> tuple[list[list[int]], list[list[int]]]:
        """Small numbers for each node, and the hashed columns that are set."""
        n = len(self.tag)
        text, links, paras, below, kids = self.size[:], self.links[:], [t == "p" for t in self.tag], [1] * n, [0] * n
        place, same = [0] * n, {}
        for v in range(1, n):
            p = self.parent[v]
            place[v] = kids[p]
            kids[p] += 1
            same[p, self.tag[v]] = same.get((p, self.tag[v]), 0) + 1
        for v in range(n - 1, 0, -1):
            p = self.parent[v]
            text[p] += text[v]
            links[p] += links[v]
            paras[p] += paras[v]
            below[p] += below[v]
        whole = max(1, text[0])
        inside = [0] * n
        ancestors: list[tuple] = [()] * n
        log = lambda x: min(BINS - 1, int(2 * (x + 1).bit_length()) - (x & 1 == 0) if x < 1 << 40 else BINS - 1)
        rows, sets = [], []
        for v in range(n):
            p = self.parent[v]
            g = GROUPS.get(self.tag[v], 16)
            if p >= 0:
                inside[v] = inside[p] | (1 << GROUPS.get(self.tag[p], 16))
                ancestors[v] = ancestors[p] + self.tokens[p] if len(ancestors[p]) < 64 else ancestors[p]
            span = max(1, self.end[v] - self.at[v])
            rows.append([
                min(BINS - 1, self.depth[v]), log(text[v]), min(31, 31 * text[v] // span), min(31, 31 * links[v] // max(1, text[v])),
                min(31, paras[v]), log(below[v]), min(31, kids[p]) if p >= 0 else 0, min(31, 31 * place[v] // max(1, kids[p])) if p >= 0 else 0,
                min(31, 31 * same.get((p, self.tag[v]), 1) // max(1, kids[p])) if p >= 0 else 31, 31 * text[v] // whole,
                log(text[p]) if p >= 0 else 31, min(31, len(self.tokens[v])), min(31, kids[v]), min(31, 31 * text[v] // max(1, text[p])) if p >= 0 else 31,
                log(text[v] // max(1, paras[v])), 0,
            ])
            on = [NUMERIC + g, *(NUMERIC + 17 + k for k in range(16) if inside[v] >> k & 1)]
            base = NUMERIC + 34
            on += [base + token_column(t) for t in self.tokens[v]]
            on += [base + HASHED + token_column(t) for t in ancestors[v]]
            sets.append(on)
        return rows, sets

    def decode(self, odds: list[float]) -> list[bool]:
        """The consistent choice of largest total log odds; roots are in."""
        n = len(self.tag)
        gain = [0.0 if self.tag[v] in ("html", "body") else odds[v] for v in range(n)]
        for v in range(n - 1, 0, -1):
            if gain[v] > 0:
                gain[self.parent[v]] += gain[v]
        chosen = [True] * n
        for v in range(1, n):
            chosen[v] = chosen[self.parent[v]] and (gain[v] > 0 or self.tag[v] in ("html", "body"))
        return chosen

    def text(self, chosen: list[bool]) -> str:
        blocks, last, own = [], -1, []
        for block, node, text in self.pieces:
            if not chosen[node]:
                continue
            if block != last:
                blocks.append(own := [])
                last = block
            own.append(text)
        return "\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


@functools.lru_cache(maxsize=10_000)
def token_column(token: str) -> int:
    return zlib.crc32(token.encode()) % HASHED


WIDTH = NUMERIC + 34 + 2 * HASHED


def matrix(found: list[tuple[list[list[int]], list[list[int]]]]) -> np.ndarray:
    rows = [r for f, _ in found for r in f]
    x = np.zeros((len(rows), WIDTH), np.uint8)
    if rows:
        x[:, :NUMERIC] = np.array(rows, np.uint8)
        sets = [s for _, f in found for s in f]
        x[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.fromiter((k for s in sets for k in s), np.int64)] = 1
    return x


class Boosted:
    """Log odds by boosted trees of fixed depth on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, width = x.shape
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        f = np.full(n, self.base)
        flat = x[:, :NUMERIC].astype(np.int64) + np.arange(NUMERIC) * BINS
        used = np.flatnonzero(x[:, NUMERIC:].any(axis=0))
        flags, rows = x[:, NUMERIC + used].astype(np.float32), np.arange(n)
        self.trees = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, BINS, np.int64)
            node = np.zeros(n, np.int64)
            for level in range(DEPTH):
                k = 1 << level
                cell, own = (flat + (node * NUMERIC * BINS)[:, None]).ravel(), np.zeros((k, n), np.float32)
                gs, hs = (np.bincount(cell, np.repeat(w, NUMERIC), k * NUMERIC * BINS).reshape(k, NUMERIC, BINS).cumsum(axis=2) for w in (g, h))
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gains = []
                for left_g, left_h in [(gs, hs), (gt - self._sums(own, node, rows, g, flags), ht - self._sums(own, node, rows, h, flags))]:
                    gain = left_g**2 / (left_h + 1) + (gt - left_g) ** 2 / (ht - left_h + 1) - gt**2 / (ht + 1)
                    gain[(left_h < 1) | (ht - left_h < 1)] = 0
                    gains.append(gain)
                gain = np.zeros((k, width, BINS))
                gain[:, :NUMERIC], gain[:, NUMERIC + used, :1] = gains
                best = gain.reshape(k, -1).argmax(axis=1)
                for j in range(k):
                    if gain.reshape(k, -1)[j, best[j]] > 1e-6:
                        feature[k - 1 + j], cut[k - 1 + j] = divmod(int(best[j]), BINS)
                at = k - 1 + node
                node = 2 * node + (x[np.arange(n), feature[at]] > cut[at])
            leaf = RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
            f += leaf[node]
            self.trees.append((feature, cut, leaf))

    @staticmethod
    def _sums(own: np.ndarray, node: np.ndarray, rows: np.ndarray, w: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """For each node, the sum of w over its rows that have the flag."""
        own[node, rows] = w
        return (own @ flags).astype(np.float64)[:, :, None]

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out


@functools.lru_cache(maxsize=1)
def made_up_words(count: int = 4000, seed: int = 5) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join("aeiounrstlmdk"[k] for k in rng.integers(13, size=int(rng.integers(2, 9)))) for _ in range(count)]


def sample_page(rng: np.random.Generator) -> tuple[str, list[tuple[int, int]]]:
    """A made-up page and the spans of its html that are not main text."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    pool = made_up_words()
    word = lambda: pool[int(rng.integers(len(pool)))]
    words = lambda a, b: " ".join(pool[k] for k in rng.integers(len(pool), size=int(rng.integers(a, b))))
    para = lambda a=15, b=120: words(a, b).capitalize() + "."
    html, out = [], []
    names = [word() for _ in range(6)]  # this site's own class names, which say nothing

    def plain(p: float = 0.4) -> str:
        return pick(f' class="{pick(*names)}"', f' id="{word()}"', f' class="{pick(*names)} {word()}"') if rng.random() < p else ""

    def add(text: str, main: bool = True) -> None:
        if not main:
            at = sum(map(len, html))
            out.append((at, at + len(text)))
        html.append(text)

    def attr(*tokens: str) -> str:
        t = pick(*tokens)
        t = pick(t, t, f"site-{t}", f"{t}-box", f"{t} {word()}", f"{pick(*names)} {t}", f"{t}-{word()}")
        return pick(f' class="{t}"', f' id="{t}"', f" class='{t}'")

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(k))

    def junk(kind: str) -> str:
        p = lambda: f"<p>{para(4, 60)}</p>"
        many = lambda: "".join(p() for _ in range(int(rng.integers(1, 5))))
        k = int(rng.integers(3, 12))
        if kind == "nav":
            inner = f"<ul>{links(k)}</ul>"
            return pick(f"<nav>{inner}</nav>", f"<nav{attr('menu', 'nav')}>{inner}</nav>", f"<div{attr('menu', 'nav', 'navigation', 'navbar', 'breadcrumb', 'breadcrumbs', 'topbar', 'toolbar')}>{pick(inner, words(2, 9))}</div>", f"<ul{attr('menu', 'nav', 'breadcrumb', 'pagination', 'links')}>{links(k)}</ul>", f'<div role="navigation">{inner}</div>')
        if kind == "header":
            inner = pick(f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 9)}</p>", f"<div>{words(1, 5)}</div><ul>{links(4)}</ul>", words(2, 8))
            return pick(f"<header>{inner}</header>", f"<header{attr('header', 'masthead', 'banner')}>{inner}</header>", f"<div{attr('header', 'masthead', 'banner', 'logo', 'top')}>{inner}</div>", f'<div role="banner">{inner}</div>')
        if kind == "footer":
            inner = pick(f"&copy; {words(3, 20)}", p(), f"<ul>{links(4)}</ul>{p()}", f"<div>{words(4, 30)}</div>")
            return pick(f"<footer>{inner}</footer>", f"<footer{attr('footer', 'bottom')}>{inner}</footer>", f"<div{attr('footer', 'copyright', 'legal', 'colophon', 'disclaimer')}>{inner}</div>", f'<div role="contentinfo">{inner}</div>')
        if kind == "side":
            inner = pick(f"<h3>{words(1, 4)}</h3><ul>{links(k)}</ul>", many(), f"<h2>{words(1, 4)}</h2>{many()}")
            return pick(f"<aside>{inner}</aside>", f"<aside{attr('sidebar', 'related')}>{inner}</aside>", f"<div{attr('sidebar', 'side', 'widget', 'related', 'recommended', 'popular', 'trending', 'sidebar', 'more')}>{inner}</div>", f'<div role="complementary">{inner}</div>', f"<section{attr('related', 'widget', 'sidebar')}>{inner}</section>")
        if kind == "ad":
            inner = pick(words(3, 40) + ".", p(), f'<a href="/x">{words(2, 9)}</a>')
            return f"<{(t := pick('div', 'div', 'div', 'section', 'aside', 'p'))}{attr('ad', 'ads', 'advert', 'advertisement', 'sponsor', 'sponsored', 'promo', 'promotion', 'banner', 'adsense', 'ad')}>{inner if t != 'p' else words(3, 30)}</{t}>"
        if kind == "notice":
            inner = pick(words(5, 40) + ".", p(), f"{p()}<button>{word()}</button>")
            return pick(f"<div{attr('cookie', 'cookies', 'consent', 'notice', 'alert', 'gdpr', 'popup', 'modal', 'overlay', 'newsletter', 'subscribe', 'signup', 'paywall', 'message', 'warning')}>{inner}</div>", f'<div role="{pick("alert", "dialog", "status")}">{inner}</div>', f"<section{attr('cookie', 'notice', 'newsletter')}>{inner}</section>")
        if kind == "form":
            inner = f"<label>{words(1, 4)}</label><input name=q>{pick('', p())}<button>{word()}</button>"
            return pick(f"<form>{inner}</form>", f"<form{attr('search', 'login', 'contact', 'subscribe')}>{inner}</form>", f"<div{attr('search', 'login', 'form')}>{inner}</div>")
        if kind == "share":
            return f"<div{attr('share', 'social', 'sharing', 'buttons', 'tags', 'meta', 'byline')}>{pick(words(1, 6), f'<ul>{links(4)}</ul>')}</div>"
        one = lambda: pick(f"<div{attr('comment', 'reply')}><p>{para(5, 90)}</p></div>", f"<li><p>{para(5, 90)}</p></li>", f"<p>{para(5, 90)}</p>", f"<article{attr('comment')}><h4>{words(1, 3)}</h4><p>{para(5, 90)}</p></article>")
        body = "".join(one() for _ in range(int(rng.integers(1, 9))))
        return pick(f"<section{attr('comments', 'comment', 'discussion', 'responses', 'replies', 'disqus', 'reviews')}><h2>{words(1, 3)}</h2>{body}</section>", f"<div{attr('comments', 'comment', 'discussion', 'replies', 'disqus', 'respond')}>{body}</div>", f"<ol{attr('comments', 'comment')}>{body}</ol>", f"<div{attr('comments', 'comment')}><ul>{body}</ul></div>")

    def content(k: int) -> None:
        for _ in range(k):
            add(pick(
                f"<p{plain()}>{para()}</p>", f"<p>{para()}</p>", f"<p{plain()}>{para(2, 12)}</p>", f"<p{plain()}>{para()}", f"<h2{plain()}>{words(1, 8)}</h2>", f"<p>{para(8, 40)} <a href='/x'>{words(1, 5)}</a> {para(5, 30)}</p>",
                "<ul>" + "".join(f"<li>{words(1, 25)}</li>" for _ in range(int(rng.integers(1, 7)))) + "</ul>", f"<blockquote><p>{para()}</p></blockquote>", f"<blockquote>{para()}</blockquote>", f"<pre>{words(3, 50)}</pre>",
                "<table>" + "".join(f"<tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr>" for _ in range(int(rng.integers(1, 5)))) + "</table>", f"<figure><figcaption>{words(2, 20)}</figcaption></figure>", f"<section{plain()}><h3>{words(1, 6)}</h3><p>{para()}</p></section>", f"<div{plain()}>{para()}</div>", f"<div{plain()}><p>{para()}</p><p>{para()}</p></div>", f"<section{plain()}><p>{para()}</p></section>", f"<div{plain()}><p>{para()}</p></div>", f"<div{plain()}><p{plain()}>{para()}</p></div>", f"<h3>{words(1, 6)}</h3>"))
            if rng.random() < 0.08:
                add(junk(pick("ad", "share", "notice", "side", "form")), False)

    add(f"<!DOCTYPE html><html><head><title>x</title></head><body{plain()}>")
    wrap = pick("", "", f"<div{attr('page', 'wrapper', 'container', 'layout', 'site')}>", f"<div{plain(1)}>")
    inner = pick("", "", f"<div{plain(1)}>", f"<div{attr('row', 'columns', 'grid', 'outer', 'inner', 'wrap')}>")
    add(wrap)
    for _ in range(int(rng.integers(0, 5))):
        add(junk(pick("nav", "nav", "header", "ad", "notice", "form", "side", "share")), False)
    add(inner)
    open_, close = pick((f"<article{plain()}>", "</article>"), (f"<article{plain()}>", "</article>"), (f"<article{attr('post', 'hentry', 'entry', 'content', 'story')}>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), *((f"<{t}{attr('content', 'article', 'post', 'entry', 'main', 'story', 'text', 'body')}>", f"</{t}>") for t in ("div", "div", "article", "section")), ("<div>", "</div>"))
    add(open_)
    if rng.random() < 0.75:
        add(f"<h1>{words(2, 12)}</h1>")
    content(int(pick(0, 1, 1, 2, 3, 5, 8, 14)))
    if rng.random() < 0.2:
        add(junk(pick("share", "comments", "side", "footer")), False)
    add(close)
    if inner:
        if rng.random() < 0.6:
            add(junk(pick("side", "side", "ad", "nav", "comments")), False)
        add("</div>")
    for _ in range(int(rng.integers(0, 5))):
        add(junk(pick("comments", "comments", "footer", "footer", "side", "ad", "notice", "form", "nav", "share")), False)
    add("</div>" if wrap else "")
    add("</body></html>")
    return "".join(html), out


@functools.lru_cache(maxsize=1)
def trained(count: int = TRAIN_PAGES, seed: int = 4) -> Boosted:
    rng, found, labels = np.random.default_rng(seed), [], []
    for _ in range(count):
        html, out = sample_page(rng)
        page = Page(html)
        found.append(page.features())
        starts = np.array([a for a, _ in out] or [-1])
        ends = np.array([b for _, b in out] or [-1])
        labels += [not bool(((starts <= a) & (a < ends)).any()) for a in page.at]
    return Boosted(matrix(found), np.array(labels, float))


def main_texts(htmls: list[str | None], model: Boosted) -> list[str]:
    read = [Page(h or "") for h in htmls]
    found = [p.features() for p in read]
    odds = model.odds(matrix(found)).tolist()
    out, at = [], 0
    for p in read:
        out.append(p.text(p.decode(odds[at : at + len(p.tag)])))
        at += len(p.tag)
    return out


def extract(frame: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html", batch: int = 200) -> DataFrame:
    """Per row: ``keep``, text, n_chars."""
    model = trained()

    def run(batches):
        for rows in batches:
            column = rows.column(html).to_pylist()
            texts = [t for i in range(0, len(column), batch) for t in main_texts(column[i : i + batch], model)]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keep)
    return frame.select(*keep, html).mapInArrow(run, f"{kinds}, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(pages(spark, sf_dir))
