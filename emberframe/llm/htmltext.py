"""Main-text extraction: gradient-boosted trees over DOM-node features, decoded along the tree.

A page becomes a tree of its block elements (and of inline ones that carry attributes); every node
has features of its subtree (text density, link density), its attribute tokens, its depth and
its siblings. Boosted trees give each node the odds of being main text. Decoding then chooses a
state for every node, ``above`` (main text may begin below), ``in`` or ``out``, so that the sum of
log-odds is best and no choice contradicts another: below ``out`` all is out, below ``in`` only in and
out. The trees are trained here, on pages that ``training_page`` writes from a seed with the answer known.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.workspace import ship

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())  # no tags inside
UNSEEN = frozenset("template object canvas".split())  # what they hold is not shown
WIDGET = frozenset("button select svg math".split())  # nor these, which a block ends
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = frozenset("ul ol dl table td th div article section aside nav footer header main form body html blockquote".split())
TAGS = "html body div article main section p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption header footer nav aside form address details a span".split()
GOOD = "article content post entry main body text story page prose markdown copy".split()
BAD = (
    "ad ads advert advertisement banner promo sponsor sponsored nav navbar menu breadcrumb breadcrumbs footer foot header masthead sidebar side aside widget related recommended popular "
    "comment comments disqus reply respond cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login search share sharing social tags meta toolbar pagination pager copyright legal skip"
).split()

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_HEAD = re.compile(r"</head\s*>|<body", re.IGNORECASE)
_LISTS = ("ul", "ol", "dl", "table")
_CELLS = ("tr", "td", "th", "tbody")
_ATTR = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: list[str]
    hidden: bool = False
    children: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)  # (order in the page, text)
    link: int = 0
    inline: int = 0
    label: bool = False


def _markup(page: str) -> Iterator[tuple[str, re.Match | None, int]]:
    """(text, tag behind it or None, where the tag ends); send(place) goes on from there. Linear in the page's length.

    Comments are left out. A tag ends at the first ``>`` outside quotes; once one has none to the end of the page,
    quotes no longer count, and where no ``>`` is left the rest is text.
    """
    at = scan = 0
    size, tag = len(page), _TAG
    while at < size:
        lt = page.find("<", scan)
        if lt < 0:
            break
        nxt = page[lt + 1 : lt + 3]
        name = nxt[1:] if nxt[:1] == "/" else nxt[:1]
        if name.isascii() and name.isalpha():
            m = tag.match(page, lt)
            if m is None:
                tag = _BARE
                m = tag.match(page, lt)
            if m is None:
                break
            moved = yield page[at:lt], m, m.end()
            at = scan = m.end() if moved is None else moved
            if moved is not None:
                yield "", None, at
            continue
        if nxt[:1] in ("!", "?"):
            close = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
            end = page.find(close, lt + 2)
            if end < 0 and close == ">":
                break
            yield page[at:lt], None, lt
            at = scan = end + len(close) if end >= 0 else size
            continue
        scan = lt + 1
    if at < size:
        yield page[at:], None, size


class _Open:
    """The open elements, with the places of each name, so that any start or end tag is settled without a walk down the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("#root", 0)]  # element and the node it writes to
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = [0]
        self.links = self.unseen = 0

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.links += tag == "a"
        self.unseen += tag in UNSEEN or tag in WIDGET
        self.stack.append((tag, node))

    def pop_to(self, index: int) -> None:
        while len(self.stack) > index:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            self.links -= tag == "a"
            self.unseen -= tag in UNSEEN or tag in WIDGET

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these names; 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    @property
    def node(self) -> int:
        return self.stack[-1][1]


def dom(page: str) -> list[Node]:
    """Nodes in page order, the first a root. Text that is not shown is left out; end tags may be missing.

    An element that is not shown ends with its end tag or with the element around it, a widget also where a block begins; without any
    end tag behind it its start tag is ignored. Only an open script or style takes the rest of the page.
    """
    nodes = [Node("#root", -1, 0, [])]
    open_, order = _Open(), 0
    buffer: list[str] = []
    ends: dict[str, int] = {}  # last end tag of a name, as far as looked for
    lost: set[str] = set()  # what was looked for in vain

    def flush() -> None:
        nonlocal order
        if buffer:
            text = "".join(buffer)
            buffer.clear()
            if text.strip():
                node = nodes[open_.node]
                if node.tag in ("#root", "html", "body"):  # text without an element of its own gets one
                    loose = Node("p", open_.node, node.depth + 1, [], link=node.link, inline=node.inline)
                    node.link = node.inline = 0
                    node.children.append(len(nodes))
                    nodes.append(loose)
                    node = loose
                node.runs.append((order, text))
                order += 1

    def write(text: str) -> None:
        if text and not open_.unseen:
            buffer.append(html.unescape(text))
            if open_.links:
                nodes[open_.node].link += len(text.strip())

    def pop_to(index: int) -> None:
        if open_.node != open_.stack[index - 1][1]:
            flush()
        open_.pop_to(index)

    def find(name: str, pattern: re.Pattern, at: int) -> re.Match | None:
        m = None if name in lost else pattern.search(page, at)
        if m is None:
            lost.add(name)
        return m

    def closes_later(tag: str, at: int) -> bool:
        if tag not in ends:
            ends[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", page, re.IGNORECASE)), default=-1)
        return ends[tag] >= at

    def add(tag: str, words: list[str], hidden: bool = False) -> None:
        flush()
        parent = open_.node
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, words, hidden))
        nodes[parent].children.append(len(nodes) - 1)
        open_.push(tag, len(nodes) - 1)

    marks = _markup(page)
    for text, m, at in marks:
        write(text)
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            place = open_.last(tag)
            if place and (tag in BLOCK or place > open_.scopes[-1]):
                if tag in BLOCK:
                    flush()
                pop_to(place)
            elif tag == "p" or tag == "br":
                flush()
            continue
        bare = m[3].rstrip().endswith("/")
        if tag == "br":
            if not open_.unseen:
                buffer.append("\n")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            end = find(tag, re.compile(rf"</{tag}\s*>", re.IGNORECASE), at)
            if end:
                marks.send(end.end())
            elif tag in ("script", "style"):
                break
            continue
        if tag == "head":
            end = find(tag, _HEAD, at)
            if end:
                marks.send(end.end() if end[0][1] == "/" else end.start())
            continue
        if tag in UNSEEN or tag in WIDGET:
            if not bare and (tag in WIDGET or closes_later(tag, at)):
                open_.push(tag, open_.node)
            continue
        if open_.unseen and tag in BLOCK and not open_.last("foreignobject"):
            while (place := open_.last(*WIDGET)) > open_.last(*UNSEEN) and (tag != "div" or open_.stack[place][0] != "button"):
                pop_to(place)
        if tag in CLOSES_P and (place := open_.last("p")) > open_.scopes[-1]:
            flush()
            pop_to(place)
        if tag in CLOSED_BY:
            wall = open_.last(*_LISTS) if tag in _CELLS else open_.scopes[-1]
            while (place := open_.last(*CLOSED_BY[tag])) > wall:
                flush()
                pop_to(place)
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m[3])} if m[3].strip() else {}
        words = [t for k in ("class", "id", "role", "aria-label") if k in attrs for t in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", attrs[k]).lower()) if t]
        if tag in BLOCK:
            add(tag, words, "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", ""))))
        elif tag != "a" and set(words) & set(BAD) and any(k in attrs for k in ("class", "id", "role")):  # an inline widget: its text stands apart
            add(tag, words)
        else:
            nodes[open_.node].inline += not any(k in attrs for k in ("class", "id", "role"))
            open_.push(tag, open_.node)
        if bare and tag not in BLOCK:
            pop_to(len(open_.stack) - 1)
    flush()
    return nodes


FEATURES = 30 + 2 * len(TAGS) + 8


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: subtree sizes and densities, attribute tokens, depth, siblings, tags of the node and its parent."""
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    parent[0] = 0
    up = parent.tolist()
    chars = np.array([sum(len(t.strip()) for _, t in x.runs) for x in nodes], np.float64)
    link, runs = np.array([x.link for x in nodes], np.float64), np.array([len(x.runs) for x in nodes], np.float64)
    marks = np.array([sum(t.count(".") + t.count("!") + t.count("?") for _, t in x.runs) for x in nodes], np.float64)
    below = [a.tolist() for a in (chars, link, np.ones(n), runs, marks)]
    for i in range(n - 1, 0, -1):
        p = up[i]
        for a in below:
            a[p] += a[i]
    words, sub_link, count, blocks, stops = (np.array(a) for a in below)
    good, bad = set(GOOD), set(BAD)
    g, b = ([len(known & set(x.tokens)) if x.tokens else 0 for x in nodes] for known in (good, bad))
    above_g, above_b, in_article, in_chrome = [0] * n, [0] * n, [False] * n, [False] * n
    place, alike = np.zeros(n, np.int64), np.zeros(n)
    for i, x in enumerate(nodes):
        if i:
            p = up[i]
            above_g[i], above_b[i] = above_g[p] + g[i], above_b[p] + b[i]
            in_article[i] = in_article[p] or x.tag in ("article", "main")
            in_chrome[i] = in_chrome[p] or x.tag in ("nav", "footer", "aside", "form", "dialog") or (x.tag == "header" and not in_article[p])
        if x.children:
            place[x.children] = np.arange(len(x.children))
            tags = Counter(nodes[c].tag for c in x.children)
            alike[x.children] = [tags[nodes[c].tag] for c in x.children]
    total = max(1.0, words[0])
    kids = np.array([len(x.children) for x in nodes])[parent]
    out = np.zeros((n, FEATURES), np.float32)
    density = sub_link / np.maximum(1, words)
    # neighbours: two on either side among the children of the same parent
    row = np.lexsort((place, parent))
    row = row[row > 0]
    near, near_words, near_links = np.zeros(n), np.zeros(n), np.zeros(n)
    for lag in (1, 2):
        for one, other in ((row[:-lag], row[lag:]), (row[lag:], row[:-lag])):
            same = parent[one] == parent[other]
            one, other = one[same], other[same]
            near[one] += 1
            near_words[one] += words[other]
            near_links[one] += density[other]
    has = near > 0
    out[:, 10] = np.where(has, np.log1p(near_words / np.maximum(1, near)), -1)
    out[:, 11] = np.where(has, near_links / np.maximum(1, near), -1)
    out[:, 12], out[:, 13] = place, kids - 1 - place
    out[:, 14], out[:, 15] = words / np.maximum(1, words[parent]), alike / np.maximum(1, kids)
    out[:, 16], out[:, 17] = np.log1p(words[parent]), density[parent]
    out[0, 10:18] = 0
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(words), np.log1p(chars), density
    out[:, 3], out[:, 4], out[:, 5] = words / count, words / np.maximum(1, blocks), stops / np.maximum(1, words) * 50
    out[:, 6], out[:, 7], out[:, 8] = np.log1p(count), [x.depth for x in nodes], words / total
    out[:, 9], out[:, 18], out[:, 19] = (np.cumsum(chars) - chars) / total, g, b
    out[:, 20], out[:, 21], out[:, 22], out[:, 23] = above_g, above_b, in_article, in_chrome
    out[:, 24], out[:, 25], out[:, 26] = [x.hidden for x in nodes], [len(x.tokens) for x in nodes], [x.inline for x in nodes]
    out[:, 27] = link / np.maximum(1, chars)
    tags = {t: i for i, t in enumerate(TAGS)}
    kind = np.array([tags.get(x.tag, -1) for x in nodes])
    known = np.flatnonzero(kind >= 0)
    out[known, 30 + kind[known]] = 1
    known = np.flatnonzero(kind[parent] >= 0)
    known = known[known > 0]
    out[known, 30 + len(TAGS) + kind[parent[known]]] = 1
    return out


@dataclass
class Forest:
    """Boosted trees of equal depth, level by level: feature, limit of each inner node, then leaf values."""

    depth: int
    start: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows, some thousands at a time."""
        return np.concatenate([self._odds(x[i : i + 8192]) for i in range(0, len(x), 8192)] or [np.zeros(0)])

    def _odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, lim, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > lim[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24, ridge: float = 1.0) -> Forest:
    """Newton boosting on binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    z, inner = np.full(len(y), start), 2**depth - 1
    flat = codes + np.arange(x.shape[1]) * bins
    all_f, all_l, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        f, lim = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, x.shape[1] * bins
            slot = ((at - first)[:, None] * width + flat).ravel()
            sums = [np.bincount(slot, np.repeat(v, x.shape[1]), 2**level * width).reshape(2**level, x.shape[1], bins).cumsum(2) for v in (g, h)]
            gl, hl = sums
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            best = gain.reshape(2**level, -1).argmax(1)
            top = gain.reshape(2**level, -1).max(1)
            for k in range(2**level):
                c, b = divmod(int(best[k]), bins)
                if top[k] > 1e-6 and b < len(edges[c]):
                    f[first + k], lim[first + k] = c, edges[c][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > lim[at])
        leaf_at = at - inner
        gs, hs = np.bincount(leaf_at, g, 2**depth), np.bincount(leaf_at, h, 2**depth)
        leaf = -rate * gs / (hs + ridge)
        z += leaf[leaf_at]
        all_f.append(f)
        all_l.append(lim)
        all_v.append(leaf)
    return Forest(depth, start, np.stack(all_f), np.stack(all_l), np.stack(all_v))


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """True for the nodes in main text: the best consistent choice of above, in and out."""
    p = np.clip(odds, -12, 12)
    yes, no = (-np.log1p(np.exp(-p))).tolist(), (-np.log1p(np.exp(p))).tolist()
    above, inside, out = no[:], yes, no[:]
    for i in range(len(nodes) - 1, 0, -1):
        q = nodes[i].parent
        if nodes[i].hidden:
            inside[i] = above[i] = -1e9
        out[q] += out[i]
        inside[q] += max(inside[i], out[i])
        above[q] += max(above[i], inside[i], out[i])
    state = ["above"] * len(nodes)
    for i in range(1, len(nodes)):
        q = state[nodes[i].parent]
        if q == "out":
            state[i] = "out"
        elif q == "in":
            state[i] = "in" if inside[i] >= out[i] else "out"
        else:
            state[i] = max((out[i], "out"), (above[i], "above"), (inside[i], "in"))[1]
    return np.array([s == "in" for s in state])


def blocks(nodes: list[Node], chosen: np.ndarray) -> list[str]:
    """Texts of chosen nodes in page order, white space folded."""
    runs = sorted((order, " ".join(t.split())) for x, c in zip(nodes, chosen, strict=True) if c for order, t in x.runs)
    return [t for _, t in runs if t]


def training_page(seed: int, things: int = 0) -> tuple[str, list[str]]:
    """A page and its main-text blocks. Containers, class names, chrome and sloppy markup vary with the seed; things: parts of the main text, if not as dealt."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("th er on an re he in ed ti es or st en at is ou que des la sch ung ci as do".split()) for _ in range(r.randint(1, 3)))
    line = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    prose = lambda: " ".join(line(3, 12).capitalize() + r.choice(".....!?") for _ in range(r.randint(1, 6)))
    text: list[str] = []

    def say(t: str) -> str:
        text.append(" ".join(t.split()))
        return t.replace("&", "&amp;")

    def links(n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{line(1, 3)}</a></{tag}>' for _ in range(n))

    def paragraph() -> str:
        t = prose() + r.choice(("", "", " & " + word()))
        if r.random() < 0.12:
            return f"<p><b>{say(t)}<br>" if r.random() < 0.6 else f"<p>{say(t)}"
        if r.random() < 0.15:
            a, b, c = line(3, 9), line(1, 3), prose()
            text.append(f"{a} {b} {c}")
            return f'<p>{a} <a href="/{word()}">{b}</a> {c}</p>'
        if r.random() < 0.1:
            text.append(t)
            return f"<p><em>{t.replace('&', '&amp;')}</em></p>"
        return f"<p>{say(t)}</p>"

    def thing() -> str:
        k = r.random()
        if k < 0.72:
            return paragraph()
        if k < 0.8:
            return f"<h{(n := r.randint(2, 4))}>{say(line(2, 6))}</h{n}>"
        if k < 0.87:
            return "<ul>" + "".join(f"<li>{say(prose() if r.random() < 0.6 else line(2, 6))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < 0.91:
            return f"<blockquote><p>{say(prose())}</p></blockquote>"
        if k < 0.94:
            return "<table>" + "".join(f"<tr><td>{say(line(1, 3))}</td><td>{say(line(1, 4))}</td></tr>" for _ in range(r.randint(2, 3))) + "</table>"
        return noise() if k < 0.98 else f"<pre>{say(line(4, 10))}</pre>"

    def plain_links() -> str:
        between = r.choice((" / ", " | ", " ", " &middot; "))
        return "<div>" + between.join(f'<a href="/{word()}">{line(1, 2)}</a>' for _ in range(r.randint(2, 6))) + "</div>"

    def heading_again(loose: list[str]) -> str:
        """A heading in front of loose blocks; its text comes first."""
        if r.random() < 0.5:
            return ""
        t = line(1, 6)
        text.insert(0, t)
        return f"<h1>{t}</h1>"

    def noise() -> str:
        c = r.choice(BAD)
        return r.choice((
            f'<div class="{c}">{prose()}</div>', f'<aside><h3>{line(1, 3)}</h3><ul>{links(r.randint(2, 6))}</ul></aside>', f'<div class="{c}-{r.choice(BAD)}"><p>{prose()}</p></div>',
            f'<div class="{r.choice(("ad", "ads", "advert", "promo"))}">{line(3, 10)}</div>', f'<div id="{c}"><h4>{line(1, 3)}</h4><ul>{links(r.randint(2, 5))}</ul></div>', f'<form action="/s"><label>{line(1, 3)}</label><input name="q"><button>{word()}</button></form>',
            f'<p class="{r.choice(("ad", "notice", "share", "copyright", "promo"))}">{line(2, 9)}</p>', "<!-- ad -->",
        ))

    def comments() -> str:
        box, one = r.choice((("section", "div"), ("div", "div"), ("ol", "li"), ("div", "article")))
        return f'<{box} {r.choice(("class", "id"))}="{r.choice(("comments", "comment-list", "disqus", "respond", "reader-comments"))}"><h3>{line(1, 2)}</h3>' + "".join(f'<{one} class="comment"><b>{word()}</b><p>{prose()}</p></{one}>' for _ in range(r.randint(1, 5))) + f"</{box}>"

    def chrome(n: int) -> str:
        return "".join(noise() for _ in range(r.randint(0, n)))

    head = f"<head><meta charset=\"utf-8\"><title>{line(2, 6)}</title>" + ("<style>p{margin:0}</style>" if r.random() < 0.7 else "") + ('<script>var t="</p>";track(0);</script>' if r.random() < 0.7 else "") + "</head>"
    nav = r.choice((f"<nav><ul>{links(r.randint(3, 9))}</ul></nav>", f'<div class="{r.choice(("menu", "navbar", "nav"))}"><ul>{links(r.randint(3, 9))}</ul></div>', f'<nav>{links(r.randint(3, 8), "span")}</nav>', "", "", plain_links()))
    top = r.choice(("", "", f'<header><h1>{line(1, 3)}</h1><p>{line(2, 8)}</p></header>', f'<div class="header"><a href="/">{line(1, 3)}</a></div>'))
    tag, attr = r.choice((("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("div", ' class="post-body entry"'), ("section", ' class="story"'), ("div", ' class="article-text"'), ("div", ' class="c12 x"'), ("div", "")))
    heading = f"<h1>{say(line(2, 8))}</h1>" if r.random() < 0.9 else ""
    if heading and r.random() < 0.2 and tag == "article":
        heading = f"<header>{heading}</header>"
    dealt = r.choice((1, 2, 2, 4, 8, 14, 22))
    inner = heading + "".join(thing() for _ in range(things or dealt))
    if r.random() < 0.2:
        inner = f"<div>{inner}</div>"
    inner += comments() if r.random() < 0.12 else ""
    if r.random() < 0.12:
        inner += f'<footer><ul>{links(r.randint(1, 4))}</ul></footer>'
    body = f"<{tag}{attr}>{inner}</{tag}>"
    if r.random() < 0.2 and tag != "main":
        body = f"<main>{body}</main>"
    side = r.choice(("", "", f'<aside><h3>{line(1, 2)}</h3><ul>{links(r.randint(2, 7))}</ul><p>{prose()}</p></aside>', f'<div class="sidebar"><div class="widget"><h3>{line(1, 2)}</h3><p>{prose()}</p></div></div>'))
    after = comments() if r.random() < 0.35 else ""
    foot = r.choice((f"<footer>&copy; {line(2, 8)}</footer>", f'<footer><p>{prose()}</p><ul>{links(3)}</ul></footer>', f'<div class="footer">&copy; {line(2, 6)}</div>', "", f"<div>{r.choice(('&copy;', 'Copyright', 'Copyright &copy;'))} {r.randint(1999, 2030)} {line(1, 4)}</div>", f"<div>{plain_links()}&copy; {line(1, 3)}</div>"))
    if r.random() < 0.15:  # no container at all
        text.clear()
        loose = [say(prose() if r.random() < 0.7 else line(1, 8)) + r.choice(("", "<hr>")) if r.random() < 0.3 else thing() for _ in range(r.choice((1, 1, 2, 3, 6)))]
        if r.random() < 0.2:  # a page of a few words
            text.clear()
            loose = [say(line(1, 3)) if r.random() < 0.3 else f"<p>{say(line(1, 3).capitalize())}{r.choice(('', '</p>'))}"]
        body = heading_again(loose) + ("<div>" + "".join(loose) + "</div>" if r.random() < 0.2 else "".join(loose))
        if r.random() < 0.5:
            bare = r.choice(("", "<html><body>", "<!DOCTYPE html><html><head><title>t</title></head><body>"))
            return bare + body + ("</body></html>" if bare else ""), text
        after = side = ""
    elif r.random() < 0.3:
        body = f'<div class="{r.choice(("wrapper", "container", "row", "page"))}">{side}{body}{after}</div>'
    else:
        body = (side + body if r.random() < 0.3 else body + side) + after
    around = "<div>" * r.choice((0, 0, 0, 0, 1, 2))
    return f'<!DOCTYPE html><html lang="{r.choice(("en", "fr", "de"))}">{head}<body>{around}{top}{nav}{chrome(2)}{body}{chrome(1)}{foot}{around.replace("<", "</")}</body></html>', text


def labelled_nodes(page: str, text: list[str]) -> tuple[list[Node], np.ndarray]:
    """The page's nodes and which of them are main text: those whose own text is, and containers between them."""
    nodes = dom(page)
    left = list(text)
    own = np.zeros(len(nodes), bool)
    bad = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        for _, t in x.runs:
            t = " ".join(t.split())
            if t in left:
                left.remove(t)
                own[i] = True
            else:
                bad[i] = True
    good_below, bad_below = own.copy(), bad.copy()
    for i in range(len(nodes) - 1, 0, -1):
        good_below[nodes[i].parent] |= good_below[i]
        bad_below[nodes[i].parent] |= bad_below[i]
    y = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        if i == 0 or x.tag in ("html", "body"):
            continue
        inside = y[x.parent]
        whole = good_below[i] and not bad_below[i]
        holds = x.tag in ("article", "main", "section", "div") and good_below[i] and own[[*x.children]].any() if x.children else False
        y[i] = own[i] or whole or (inside and good_below[i]) or holds
    return nodes, y


@lru_cache
def train(pages: int = 800, seed: int = 17) -> Forest:
    """Trees from ``pages`` pages, and a fortieth as many with 65 to 400 parts under one parent. Trained once in a process."""
    parts = [labelled_nodes(*training_page(seed * 100_000 + i)) for i in range(pages)]
    parts += [labelled_nodes(*training_page(seed * 100_000 + pages + i, 65 + i * 83 % 336)) for i in range(pages // 40)]
    return boost(np.concatenate([features(n) for n, _ in parts]), np.concatenate([y for _, y in parts]).astype(float))


def main_text(pages: list[str | None], forest: Forest) -> list[str]:
    """Main text of each page. Small pages are scored together, a large one by itself."""
    out, trees = [], []

    def score() -> None:
        rows = [features(t) for t in trees if t]
        odds = iter(np.split(forest.odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1]) if rows else [])
        out.extend("\n\n".join(blocks(t, decode(t, next(odds)))) if t else "" for t in trees)
        trees.clear()

    size = 0
    for p in pages:
        trees.append(dom(p) if p else None)
        size += len(trees[-1] or ())
        if size > 20_000:
            score()
            size = 0
    score()
    return out


def extract(pages: DataFrame, forest: Forest | None = None, batch_rows: int = 200) -> DataFrame:
    """page_id, url and text of every page.

    Null and empty html, and pages without main text, give an empty text. Repeated rows are
    extracted each, null ids and urls stay null, extra columns are ignored, an empty table gives no rows.
    """
    spark = pages.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(forest or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                text = main_text(part.column(2).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
