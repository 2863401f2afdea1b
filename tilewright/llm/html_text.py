"""Main text of web pages: a linear-chain conditional random field over the leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices

#: Elements that flow inside a line, that have no end tag, and whose content is no text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split()) | frozenset(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe canvas textarea title annotation annotation-xml".split())
#: Start tags that end an open element of these names first.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div main nav aside footer header form body blockquote td th".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)(?:>|\Z)|[^<]+|<""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")


def leaf_blocks(source: str) -> list[tuple[str, tuple[str, ...], float]]:
    """Blocks of a page in order: (text, what its ancestors' tags and class words say, share of the text inside links).

    An open element holds what it and all around it say, of the names in GROUPS; open elements are counted by name. So a
    page takes time in proportion to its length, however deep it is.
    """
    stack: list[tuple[str, frozenset[str]]] = []
    opened: Counter[str] = Counter()
    out: list[tuple[str, frozenset[str], float]] = []
    held: list[str] = []
    linked = 0
    none: frozenset[str] = frozenset()
    path = none

    def flush():
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((text, path, min(1.0, linked / len(text))))
            held.clear()
        linked = 0

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.match(source, at)
        at = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                if not held:
                    path = stack[-1][1] if stack else none
                text = html.unescape(piece) if "&" in piece else piece
                held.append(text)
                if opened["a"]:
                    linked += len(text.strip())
            continue
        name = name.lower()
        if m[1]:
            if name not in INLINE:
                flush()
            if opened[name]:
                while (last := stack.pop()[0]) != name:
                    opened[last] -= 1
                opened[name] -= 1
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if name == "br":
            held.append(" ")
        if name not in INLINE:
            flush()
        for shut in CLOSES.get(name, ()):
            if not opened[shut]:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == shut:
                    opened.subtract(n for n, _ in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES:
                    break
        if name not in VOID and not m[3].endswith("/"):
            words = [w for a, b, c in _NAMES.findall(m[3]) for w in _PARTS.findall((a or b or c).lower())] if "=" in m[3] else []
            told = {x for x in (f"<{name}>", *(f".{w}" for w in words)) if x in _GROUP_OF}
            around = stack[-1][1] if stack else none
            stack.append((name, around if told <= around else around | told))
            opened[name] += 1
    flush()
    return out


#: What an ancestor's tag, or words of its class, id or role, say; features are these, not single names.
GROUPS = {
    "main": "<article> <main> .article .post .content .entry .story .main .body".split(),
    "menu": "<nav> <menu> .nav .menu .navigation .navbar .breadcrumb .breadcrumbs .tabs .pagination".split(),
    "head": "<header> .header .masthead .banner .topbar".split(),
    "foot": "<footer> .footer .contentinfo .colophon .copyright".split(),
    "side": "<aside> .sidebar .side .complementary .related .widget .recommended .promo .share .social .tags".split(),
    "advert": ".ad .ads .advert .advertisement .sponsor .sponsored .promoted".split(),
    "notice": ".cookie .cookies .notice .consent .gdpr .alert .popup .modal .newsletter .subscribe".split(),
    "form": "<form> <button> <select> <fieldset> .form .search .login".split(),
    "comments": ".comment .comments .reply .replies .discussion .responses .disqus".split(),
    "list": "<li> <ul> <ol>".split(),
    "paragraph": "<p> <blockquote> <pre>".split(),
    "heading": "<h1> <h2> <h3> <h4> <h5> <h6>".split(),
    "table": "<table>".split(),
}
_GROUP_OF = {x: g for g, names in GROUPS.items() for x in names}
GROUP_NAMES = list(GROUPS)
TEXT = ("short", "middling", "long", "links", "stop", "rights", "first", "last", "bias")
WIDTH = len(GROUPS) + len(TEXT)


def describe(blocks: list[tuple[str, frozenset[str], float]]) -> np.ndarray:
    """Features of a page's blocks, a row of WIDTH for each."""
    x = np.zeros((len(blocks), WIDTH))
    base = len(GROUPS)
    for i, (text, path, links) in enumerate(blocks):
        for name in path:
            if (g := _GROUP_OF.get(name)) is not None:
                x[i, GROUP_NAMES.index(g)] = 1.0
        n = len(text)
        x[i, base : base + len(TEXT)] = (n < 25, 25 <= n < 100, n >= 100, links > 0.5, text[-1] in ".!?", "©" in text, i == 0, i == len(blocks) - 1, 1)
    return x


class Chain:
    """A linear-chain conditional random field with two labels (0 other, 1 main text)."""

    def __init__(self):
        self.emit, self.move = np.zeros((WIDTH, 2)), np.zeros((2, 2))

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 12, rate: float = 0.5, decay: float = 1e-3) -> Chain:
        """Conditional likelihood by adaptive gradient steps, a page each."""
        seen = [np.full_like(self.emit, 1e-6), np.full_like(self.move, 1e-6)]
        for _ in range(rounds):
            for x, y in pages:
                if not len(y):
                    continue
                single, pair = self._expect(x)
                single[np.arange(len(y)), y] -= 1
                np.subtract.at(pair, (y[:-1], y[1:]), 1)
                for w, g, s in ((self.emit, x.T @ single, seen[0]), (self.move, pair, seen[1])):
                    g = g + decay * w
                    s += g * g
                    w -= rate * g / np.sqrt(s)
        return self

    def _expect(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = x @ self.emit
        n = len(e)
        a, b = e.copy(), np.zeros_like(e)
        for i in range(1, n):
            a[i] += np.logaddexp(a[i - 1, 0] + self.move[0], a[i - 1, 1] + self.move[1])
        for i in range(n - 2, -1, -1):
            v = e[i + 1] + b[i + 1]
            b[i] = np.logaddexp(self.move[:, 0] + v[0], self.move[:, 1] + v[1])
        z = np.logaddexp(a[-1, 0], a[-1, 1])
        pair = np.zeros((2, 2))
        if n > 1:
            pair = np.exp(a[:-1, :, None] + self.move[None] + (e + b)[1:, None, :] - z).sum(0)
        return np.exp(a + b - z), pair

    def decode(self, x: np.ndarray) -> list[int]:
        e = (x @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        if not e:
            return []
        s0, s1 = e[0]
        back = []
        for e0, e1 in e[1:]:
            f0, f1 = s1 + m10 > s0 + m00, s1 + m11 > s0 + m01
            s0, s1 = (s1 + m10 if f0 else s0 + m00) + e0, (s1 + m11 if f1 else s0 + m01) + e1
            back.append((f0, f1))
        label = int(s1 > s0)
        out = [label]
        for f in reversed(back):
            label = int(f[label])
            out.append(label)
        return out[::-1]


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """An invented page and the label of each of its blocks."""
    parts, labels = [], []

    def words(least: int, most: int) -> str:
        return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(least, most)))

    def add(markup: str, label: int, n: int = 1):
        parts.append(markup)
        labels.extend([label] * n)

    def menu():
        n = rng.randint(2, 9)
        items = "".join(f'<li><a href="/x">{words(1, 2)}</a></li>' for _ in range(n))
        add(rng.choice(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul class="navigation">{}</ul>', '<header><ul>{}</ul></header>']).format(items), 0, n)

    def beside():
        name = rng.choice(["ad", "sidebar", "cookie-notice", "newsletter", "related", "share", "advert", "banner", "promo"])
        tag = rng.choice(["div", "aside", "section"])
        add(f'<{tag} class="{name}"><p>{words(1, 25)}.</p></{tag}>', 0)

    def form():
        add(f"<form><label>{words(1, 4)}</label><button>{words(1, 2)}</button></form>", 0, 2)

    if rng.random() < 0.9:
        menu()
    if rng.random() < 0.3:
        add(f"<header><h1>{words(1, 4)}</h1></header>", 0)
    for _ in range(rng.randint(0, 2)):
        beside()
    open_, close = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div class="post">', "</div>"), ("<main><article>", "</article></main>")])
    parts.append(open_)
    if rng.random() < 0.9:
        add(f"<h1>{words(2, 12)}</h1>", 1)
    for _ in range(rng.randint(1, 14)):
        kind = rng.random()
        if kind < 0.75:
            add(f"<p>{words(1, 80)}.</p>", 1)
        elif kind < 0.82:
            add(f"<h2>{words(1, 8)}</h2>", 1)
        elif kind < 0.9:
            n = rng.randint(2, 5)
            add("<ul>" + "".join(f"<li>{words(2, 20)}</li>" for _ in range(n)) + "</ul>", 1, n)
        elif kind < 0.95:
            add(f"<blockquote>{words(5, 40)}.</blockquote>", 1)
        else:
            beside()
    parts.append(close)
    for _ in range(rng.randint(0, 2)):
        rng.choice([beside, form])()
    if rng.random() < 0.4:
        n = rng.randint(1, 5)
        items = "".join(f"<p>{words(2, 40)}.</p>" for _ in range(n))
        add(rng.choice(['<section class="comments">{}</section>', '<div id="comments">{}</div>', '<ol class="comment-list">{}</ol>']).format(items), 0, n)
    if rng.random() < 0.9:
        add(rng.choice(["<footer>&copy; {}</footer>", '<div class="footer"><p>&copy; {}</p></div>', "<footer><p>{}</p></footer>"]).format(words(2, 20)), 0)
    return f"<html><body>{''.join(parts)}</body></html>", labels


@cache
def trained(pages: int = 300, seed: int = 7) -> Chain:
    """The field fitted to invented labelled pages."""
    rng = random.Random(seed)
    data = []
    for _ in range(pages):
        source, labels = labelled_page(rng)
        blocks = leaf_blocks(source)
        if len(blocks) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(blocks)} blocks: {source}")
        data.append((describe(blocks), np.array(labels)))
    return Chain().fit(data)


def main_text(source: str, chain: Chain) -> str:
    blocks = leaf_blocks(source)
    return "\n".join(b[0] for b, keep in zip(blocks, chain.decode(describe(blocks)), strict=True) if keep)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """Rows (page_id, url, text, n_chars): each page's main text, its blocks joined by line feeds.

    The field sees a block's ancestors (tags, words of class, id and role) and its text (length, links, ending); it is
    fitted on the driver to a few hundred invented labelled pages, or given as `chain`. Every page is read whole.

    Null or empty html, or no main block: text empty, n_chars 0. Broken markup: elements end where HTML would end them.
    Very long or deep pages: one pass, in proportion
    to their length. Repeated rows: each for itself. Empty tables: empty. Other columns are left out.
    """
    prepare(pages.sparkSession)
    chain = chain or trained()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x, chain) if x else "" for x in part.column(2).to_pylist()]
                counts = pa.array([len(t) for t in texts], pa.int64())
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), counts], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
