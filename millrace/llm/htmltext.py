"""HTML extraction: main text by a tree-structured graphical model over the DOM.

A page's block elements form a tree of binary variables, content or not. Unary potentials are log-linear in what the
element is and holds (tag, words of its class, id and role, length of its own text, share of links); pair
potentials connect each element with its parent. Sum-product messages go up and down the tree once, which gives exact
marginals; the text of elements with a content marginal above a half is the page's main text. Weights and
pair potentials are trained by gradient ascent on the conditional likelihood of labelled pages; these are built
here by rule (``labelled_pages``), as the tables have none. All pages of a batch are one forest, worked level by level in numpy.

Blocks are bounded by block elements and line breaks; inside one, character references are decoded and white space becomes
one space; blocks are joined by line ends, in page order.

Defined results: null and empty html give an empty text; markup that is cut off or nested wrongly is read as far as it goes
(scripts, styles and comments without an end reach to the page's end). A quote opens an attribute's value only after ``=``; one
that is never closed is part of an unquoted value, so that it swallows no text. Text in ``math`` and ``svg`` is text as any other;
what stands in an ``object``, ``canvas``, ``audio``, ``video`` or ``iframe`` is shown only where that fails, and goes. Ties of the marginal count as not content; equal
rows get equal results; pages are read whole; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of elements, and the words of class, id and role that tell what a part of a page is for.
TAGS = (
    "html body head article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset table thead tbody "
    "tfoot tr td th caption blockquote pre figure figcaption address details summary dialog menu button select option label legend center hgroup search"
).split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(["br", "hr"])
RAW = frozenset("script style noscript template title textarea iframe object canvas audio video".split())
HINTS = {
    "advert": "ad ads adv advert advertisement adsense adslot sponsor sponsored promo promotion banner outbrain taboola dfp",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager topbar toolbar tabs toc",
    "footer": "footer foot copyright legal contentinfo imprint colophon",
    "header": "header masthead logo branding sitename",
    "sidebar": "sidebar side aside related recommended widget rail complementary popular trending teaser tags",
    "comment": "comment comments commentlist reply replies discussion disqus respond reader feedback",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription paywall signup dialog warning disclaimer message",
    "share": "share sharing social follow twitter facebook login search form",
    "content": "article content post entry story body main text page prose",
}
HINT_OF = {w: h for h, words in HINTS.items() for w in words.split()}

LENGTHS, SHARES = (0, 1, 25, 80, 200), (0.01, 0.34, 0.67)
NAMES = [*(f"tag {t}" for t in TAGS), "tag inline", *(f"hint {h}" for h in HINTS), *(f"length {n}" for n in LENGTHS), "share none", *(f"share {s}" for s in SHARES), "hidden", "hinted prose", "bias"]
AT = {n: i for i, n in enumerate(NAMES)}
_TAG = {t: AT[f"tag {t}"] for t in TAGS}

#: As HTML has it: whatever follows white space or a slash is a name, and only after "=" quotes bound a value.
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*+)))?+")
_MARKUP = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|" + _ATTRIBUTE.pattern.replace("(", "(?:").replace("(?:?:", "(?:") + r")*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: An opening tag ends those of these kinds that stand open inside the same parent.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}}
#: Kinds that hold running text of their own.
_PROSE = frozenset("p blockquote pre li dd td".split())
_PROSE_AT, _AWAY = {_TAG[t] for t in _PROSE}, {AT[f"hint {h}"] for h in HINTS if h != "content"}
#: Levels of the forest with so few nodes are worked node by node: pages may be nested as deep as they are long.
NARROW = 8


class Page:
    """The tree of a page: per node its parent, depth, features and label if there is one; and its pieces of text."""

    def __init__(self, source: str):
        self.parent, self.depth, self.features, self.label = [-1], [0], [[_TAG["html"]]], [-1]
        self.pieces: list[tuple[int, int, str]] = []
        self.length, self.linked = [0], [0]
        # Of each open element: tag, node, and where the nearest block element stands; and where those of each tag stand.
        open_, places = [("html", 0, 0)], defaultdict(list, html=[0])
        link, block, end = 0, 0, len(source)

        def text(raw: str) -> None:
            s = html.unescape(raw) if "&" in raw else raw
            node = open_[-1][1]
            n = len(s) if not s.isspace() else 0
            self.length[node] += n
            self.linked[node] += n if link else 0
            self.pieces.append((node, block, s))

        def close(k: int) -> None:
            while len(open_) > k:
                places[open_.pop()[0]].pop()

        at = 0
        while at < end:
            m = _MARKUP.search(source, at)
            if not m:
                text(source[at:])
                break
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    link = 0
                if places[tag] and places[tag][-1]:
                    close(places[tag][-1])
                if tag in _TAG:
                    block += 1
                continue
            if tag in RAW:
                # Nothing in these is text or markup of the page.
                shut = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                if not m[3].rstrip().endswith("/") or tag in ("script", "style"):
                    at = shut.end() if shut else end
                continue
            if tag in BREAKS:
                block += 1
            if tag in VOID:
                continue
            if tag == "a":
                link = 1
            hints, hidden, label = self._attributes(m[3]) if m[3].strip() else ((), False, -1)
            if tag not in _TAG and not hints and not hidden:
                continue  # inline markup without a meaning of its own belongs to its block
            if tag in _TAG:
                block += 1
                self._implied(tag, open_, places, close)
            node = len(self.parent)
            self.parent.append(open_[-1][1])
            self.depth.append(self.depth[open_[-1][1]] + 1)
            self.features.append([_TAG.get(tag, AT["tag inline"]), *(AT[f"hint {h}"] for h in hints), *([AT["hidden"]] * hidden)])
            self.label.append(label)
            self.length.append(0)
            self.linked.append(0)
            places[tag].append(len(open_))
            open_.append((tag, node, len(open_) if tag in _TAG else open_[-1][2]))
        for node, f in enumerate(self.features):
            n, share = self.length[node], self.linked[node] / max(self.length[node], 1)
            if n >= LENGTHS[-1] and share < SHARES[0] and f[0] in _PROSE_AT and any(x in _AWAY for x in f):
                f.append(AT["hinted prose"])
            f.append(AT[f"length {max(x for x in LENGTHS if x <= n)}"])
            f.append(AT["share none" if share < SHARES[0] else f"share {max(x for x in SHARES if x <= share)}"])
            f.append(AT["bias"])

    @staticmethod
    def _attributes(raw: str) -> tuple[set[str], bool, int]:
        hints, hidden, label = set(), False, -1
        for a in _ATTRIBUTE.finditer(raw):
            name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if name in ("class", "id", "role"):
                hints |= {HINT_OF[w] for w in map(str.lower, _WORD.findall(value)) if w in HINT_OF}
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
            elif name == "data-label":
                label = int(value)
        return hints, hidden, label

    @staticmethod
    def _implied(tag: str, open_: list, places: dict, close) -> None:
        k = open_[-1][2]
        if open_[k][0] == "p":
            close(k)
        if tag in _ENDS:
            scope = max((places[t][-1] for t in _SCOPE[tag] if places[t]), default=0)
            inside = [p[i] for t in _ENDS[tag] if (p := places[t]) and (i := bisect_right(p, scope)) < len(p)]
            if inside:
                close(min(inside))

    def text(self, content: np.ndarray) -> str:
        blocks: dict[int, list[str]] = {}
        for node, block, s in self.pieces:
            if content[node]:
                blocks.setdefault(block, []).append(s)
        return "\n".join(t for t in (" ".join("".join(b).split()) for b in blocks.values()) if t)


class Forest:
    """The nodes of many pages, and the order in which messages run."""

    def __init__(self, pages: list[Page]):
        self.at = np.cumsum([0] + [len(p.parent) for p in pages])
        shift = np.repeat(self.at[:-1], np.diff(self.at))
        parent = np.concatenate([np.array(p.parent) for p in pages])
        self.parent = np.where(parent < 0, -1, parent + shift)
        depth = np.concatenate([np.array(p.depth) for p in pages])
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max() + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        counts = np.array([len(f) for p in pages for f in p.features])
        self.node = np.repeat(np.arange(len(counts)), counts)
        self.feature = np.array([x for p in pages for f in p.features for x in f])
        self.label = np.concatenate([np.array(p.label) for p in pages])

    def unary(self, weights: np.ndarray) -> np.ndarray:
        """Log potentials; that of "not content" is 0."""
        u = np.zeros((len(self.parent), 2))
        u[:, 1] = np.bincount(self.node, weights[self.feature], len(u))
        return u

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's marginals, and the joint ones of each node (second axis: parent, third: node)."""
        inbox, up, n = np.zeros_like(unary), np.zeros_like(unary), len(unary)
        wide, deep = self._cut()
        self._deep_up(deep, unary, pair, inbox, up)
        for level in reversed(wide):
            b = unary[level] + inbox[level]
            up[level] = np.logaddexp(pair[:, 0] + b[:, :1], pair[:, 1] + b[:, 1:])
            for y in (0, 1):
                np.add.at(inbox[:, y], self.parent[level], up[level, y])
        own, belief = unary + inbox, unary + inbox
        for level in wide:
            cavity = belief[self.parent[level]] - up[level]
            belief[level] = own[level] + np.logaddexp(cavity[:, :1] + pair[0], cavity[:, 1:] + pair[1])
        self._deep_down(deep, own, pair, up, belief)
        inner = np.flatnonzero(self.parent >= 0)
        cavity = belief[self.parent[inner]] - up[inner]
        j = cavity[:, :, None] + pair[None] + own[inner][:, None, :]
        j = np.exp(j - j.max((1, 2), keepdims=True))
        joint = np.zeros((n, 2, 2))
        joint[inner] = j / j.sum((1, 2), keepdims=True)
        e = np.exp(belief - belief.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True), joint

    def _cut(self) -> tuple[list[np.ndarray], list[int]]:
        """The levels down to the last one that is wide, and the nodes below, in order of depth."""
        cut = max((i + 1 for i, x in enumerate(self.levels) if len(x) > NARROW), default=0)
        return self.levels[:cut], [int(x) for level in self.levels[cut:] for x in level]

    def _deep_up(self, nodes: list[int], unary: np.ndarray, pair: np.ndarray, inbox: np.ndarray, up: np.ndarray) -> None:
        p, got = pair.tolist(), {}
        own, parent = unary[nodes].tolist(), self.parent[nodes].tolist()
        sent = []
        for i in range(len(nodes) - 1, -1, -1):
            a, b = got.pop(nodes[i], (0.0, 0.0))
            inbox[nodes[i]] = a, b
            a, b = a + own[i][0], b + own[i][1]
            x, y = _logaddexp(p[0][0] + a, p[0][1] + b), _logaddexp(p[1][0] + a, p[1][1] + b)
            sent.append((x, y))
            a, b = got.get(parent[i], (0.0, 0.0))
            got[parent[i]] = a + x, b + y
        if nodes:
            up[nodes[::-1]] = sent
        for node, m in got.items():
            inbox[node] += m

    def _deep_down(self, nodes: list[int], own: np.ndarray, pair: np.ndarray, up: np.ndarray, belief: np.ndarray) -> None:
        p, known = pair.tolist(), {}
        mine, sent, parent = own[nodes].tolist(), up[nodes].tolist(), self.parent[nodes].tolist()
        for i, node in enumerate(nodes):
            above = known.get(parent[i])
            a, b = belief[parent[i]].tolist() if above is None else above
            a, b = a - sent[i][0], b - sent[i][1]
            known[node] = mine[i][0] + _logaddexp(a + p[0][0], b + p[1][0]), mine[i][1] + _logaddexp(a + p[0][1], b + p[1][1])
        if nodes:
            belief[nodes] = [known[x] for x in nodes]


def _logaddexp(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _labelled_page(rng: random.Random) -> str:
    """One labelled page: an article somewhere among parts that are none."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    links = lambda a, b: "".join(f'<li data-label="0"><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(a, b)))

    def paragraph() -> str:
        s = words(*rng.choice(((1, 4), (8, 40), (40, 160))))
        if rng.random() < 0.2:
            s = f"{s} <a href='/{word()}'>{words(1, 3)}</a> {words(3, 20)}"
        if rng.random() < 0.2:
            s = f"<b>{s}</b>" if rng.random() < 0.5 else f"<b>{s}<br>"
        kind = rng.random()
        if kind < 0.05:
            # Long text of its own is content, whatever its class is called.
            name = rng.choice(("related", "header-note", "notice", "side-note", "footer-text", "reader-line", "share", "promo-text", "alert", "menu-text"))
            return f'<p data-label="1" class="{name}">{words(45, 160)}</p>'
        if kind < 0.8:
            return f'<p data-label="1">{s}' + "</p>" * (rng.random() < 0.85)
        if kind < 0.86:
            return f'<h2 data-label="1">{words(1, 6)}</h2>'
        if kind < 0.91:
            return '<ul data-label="1">' + "".join(f'<li data-label="1">{words(1, 25)}</li>' for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind < 0.94:
            return f'<blockquote data-label="1"><p data-label="1">{s}</p></blockquote>'
        if kind < 0.97:
            return f'<pre data-label="1">{s}</pre>'
        return '<table data-label="1">' + "".join(f'<tr data-label="1"><td data-label="1">{words(1, 5)}</td><td data-label="1">{words(1, 9)}</td></tr>' for _ in range(2)) + "</table>"

    def part(kind: str) -> str:
        tag, name = {
            "menu": (("nav", "div", "ul"), ("nav", "menu", "navbar", "breadcrumb")), "header": (("header", "div"), ("header", "masthead", "logo")),
            "footer": (("footer", "div"), ("footer", "copyright", "site-footer")), "sidebar": (("aside", "div", "section"), ("sidebar", "related", "widget")),
            "advert": (("div", "aside", "section", "p"), ("ad", "advert", "ad-slot", "sponsored", "promo")), "notice": (("div", "section", "p", "dialog"), ("cookie-notice", "notice", "alert", "newsletter", "consent")),
            "comment": (("section", "div", "ol"), ("comments", "comment-list", "reader-comments", "discussion")), "form": (("form",), ("search", "login", "subscribe")),
        }[kind]
        t = rng.choice(tag)
        telling = t in ("nav", "header", "footer", "aside", "form", "dialog")
        attribute = f' {rng.choice(("class", "id"))}="{rng.choice(name)}"' if not telling or rng.random() < 0.4 else ""
        if kind == "menu":
            inner = links(2, 9) if t == "ul" else f'<ul data-label="0">{links(2, 9)}</ul>'
        elif kind == "comment":
            each = "li" if t == "ol" else rng.choice(("div", "article"))
            inner = "".join(f'<{each} data-label="0" class="comment"><p data-label="0">{words(2, 60)}</p></{each}>' for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            inner = f'<label data-label="0">{words(1, 3)}</label><input name="q"><button data-label="0">{words(1, 2)}</button>'
        elif rng.random() < 0.5 or t == "p":
            inner = words(1, 30) + (f' <a href="/{word()}">{words(1, 3)}</a>' if rng.random() < 0.4 else "")
        else:
            inner = "".join(f'<p data-label="0">{words(1, 40)}</p>' for _ in range(rng.randint(1, 3)))
        return f'<{t} data-label="0"{attribute}>{inner}</{t}>'

    body = [f'<h1 data-label="1">{words(1, 9)}</h1>'] * (rng.random() < 0.85) + [paragraph() for _ in range(rng.randint(0, 12))]
    if rng.random() < 0.5:
        for _ in range(rng.randint(1, 2)):
            body.insert(rng.randint(1, len(body)) if body else 0, part(rng.choice(("advert", "sidebar", "notice", "comment", "form"))))
    tag, attribute = rng.choice((("article", ""),) * 4 + (("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="post-body"'), ("section", ' class="article"'), ("body", "")))
    inside = "".join(body)
    article = inside if tag == "body" else f'<{tag} data-label="1"{attribute}>{inside}</{tag}>'
    before = [part(k) for k in ("header", "menu", "notice", "advert", "form") if rng.random() < 0.5]
    after = [part(k) for k in ("sidebar", "advert", "comment", "menu", "footer", "notice") if rng.random() < 0.5]
    rng.shuffle(before)
    middle = "".join(before) + article + "".join(after)
    if rng.random() < 0.4:
        middle = f'<div{rng.choice(("", " class=wrap", " id=page"))}>{middle}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{middle}</body></html>"


def labelled_pages(n: int = 600, seed: int = 5) -> list[str]:
    """Pages whose elements carry their label in ``data-label``, the same ones each time."""
    rng = random.Random(seed)
    return [_labelled_page(rng) for _ in range(n)]


def train(pages: list[str], steps: int = 150, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and pair potentials of greatest conditional likelihood, by Adam; elements without a label are summed out."""
    forest = Forest([Page(p) for p in pages])
    known = forest.label >= 0
    clamp = np.zeros((len(known), 2))
    clamp[known & (forest.label == 1), 0] = clamp[known & (forest.label == 0), 1] = -1e9
    x, first, second = np.zeros(len(NAMES) + 4), np.zeros(len(NAMES) + 4), np.zeros(len(NAMES) + 4)
    inner = forest.parent >= 0
    for step in range(1, steps + 1):
        w, pair = x[: len(NAMES)], x[len(NAMES) :].reshape(2, 2)
        u = forest.unary(w)
        free, free_joint = forest.marginals(u, pair)
        held, held_joint = forest.marginals(u + clamp, pair)
        g = np.bincount(forest.feature, (held - free)[forest.node, 1], len(NAMES))
        g = np.append(g, (held_joint - free_joint)[inner].sum(0).ravel()) / len(pages) - decay * x
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        x = x + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return x[: len(NAMES)], x[len(NAMES) :].reshape(2, 2)


@cache
def model() -> tuple[np.ndarray, np.ndarray]:
    return train(labelled_pages())


def extract(sources: list[str | None], weights: np.ndarray, pair: np.ndarray) -> list[str]:
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    forest = Forest(pages)
    content = forest.marginals(forest.unary(weights), pair)[0][:, 1] > 0.5
    return [p.text(content[a:b]) for p, a, b in zip(pages, forest.at[:-1], forest.at[1:], strict=True)]


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``."""
    weights, pair = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                raw = [None if x.as_py() is None else x.as_py().decode("utf-8", "replace") for x in b.column(2)]
                got = extract(raw, weights, pair)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"))
    return plain.mapInArrow(run, pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))
