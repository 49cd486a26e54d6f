"""HTML extraction (operator 1): blocks of a page labelled content or boilerplate by a minimum cut.

A page is cut into text blocks at block-level tags. One logistic classifier sees a block's text and place, and the
landmarks, names and forms around it; its calibrated log-odds are the block's costs for either label: the capacities
of its edges to the two terminals. Neighbouring blocks, and blocks under one parent, are joined by smoothness edges. A
maximum flow finds the cut of least cost. Nothing beside the cut decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import col, map_texts

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|['"][^>]*(?:>|\Z)|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_BAD = r"ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|footer|foot|header|masthead|sidebar|side|aside|widget\w*|comments?|respond|disqus|reply|replies|share|sharing|social|related|recommend\w*|popular|trending|newsletter|subscribe|signup|login|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|toolbar|pagination|pager|copyright|legal|disclaimer|contentinfo|complementary|search"
_GOOD = r"article|content|main|body|post|entry|story|text"
_PLACE = r"site|page|global|main|top|bottom|left|right|primary|secondary"
#: Whole names: a word of the list, alone or with words that only say where it is or what holds it ("has-sidebar" is none).
_BAD_NAME = re.compile(rf"(?:(?:{_PLACE})[_-]+)?(?:{_BAD})(?:[_-]+(?:{_BAD}|tools?|buttons?|links?|icons?|bar|box|list|items?|area|block|section|container|wrap|wrapper|inner|form|\d+))*", re.I)
_GOOD_NAME = re.compile(rf"(?:(?:{_PLACE}|blog)[_-]+)?(?:{_GOOD})(?:[_-]+(?:{_GOOD}|area|block|section|container|wrap|wrapper|inner|\d+))*", re.I)
_HEADING = re.compile(r"header|masthead", re.I)
#: Their text is no text of the page. The first two hold anything up to their end tag or the end of the page, those of
#: _FLAT anything up to their end tag, the others elements; of these, _ONCE can't hold themselves.
_OPAQUE = {"script", "style"}
_FLAT = {"textarea", "title", "iframe"}
_ONCE = {"noscript", "select", "button", "canvas", "audio", "video", "option", "datalist"}
_RAW = _OPAQUE | _FLAT | _ONCE | {"template", "svg", "object", "annotation", "annotation-xml"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in _OPAQUE | _FLAT}
_AGAIN = {t: re.compile(rf"<{t}(?=[\s/>])" + (r"|</head(?=[\s/>])|<body(?=[\s/>])" if t == "title" else ""), re.I) for t in _FLAT}
#: A control does not hold these: one that seems to was never closed.
_CONTROLS, _NOT_IN_CONTROLS = {"select", "button", "option", "datalist"}, {"article", "main", "section", "header", "nav", "footer", "aside", "form"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr", "img", "wbr", "br"}
_MATH = {"math", "maction", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "none", "semantics"}
_INLINE |= _MATH
_LANDMARK_BAD = {"nav", "footer", "aside", "dialog", "menu"}
_CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: What a block's text and place say, and what the markup around it says.
TEXT, MARKUP = 11, 6
FEATURES = TEXT + MARKUP


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    tag: str
    parent: int
    depth: int
    good: bool  # inside article or main
    bad: bool  # inside a landmark of boilerplate, or hidden
    named: int  # 1 a good name, -1 a bad name on an enclosing element, since the last article or main
    form: bool  # inside a form that was opened since the last article or main


class _Element:
    __slots__ = ("tag", "number", "good", "bad", "named", "form", "link", "block")

    def __init__(self, tag, number, good, bad, named, form, link, block):
        # good: 2 inside an article, 1 inside main only; bad: 2 inside a landmark, 1 hidden only
        self.tag, self.number, self.good, self.bad, self.named, self.form, self.link, self.block = tag, number, good, bad, named, form, link, block


def _said_of(attributes: str, tag: str, good: int) -> tuple[int, bool]:
    """Of an element's attributes: 1 for good names, -1 for bad ones (0 for both or none), and whether it is hidden."""
    names, hidden = [], False
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            names += value.strip("\"'").split()
        elif name == "hidden" or name == "aria-hidden" and value.strip("\"'").lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            hidden = True
    bad = tag != "main" and any(_BAD_NAME.fullmatch(x) and not (good and _HEADING.fullmatch(x)) for x in names)
    return any(_GOOD_NAME.fullmatch(x) for x in names) - bad, hidden


class _Raw:
    """Where the raw elements of a page end. What one look ahead finds out is kept, so that a page that leaves very many
    of them open is still read in about linear time."""

    def __init__(self, html: str):
        self.html = html
        self.ends: dict[str, re.Match | None] = {}  # the last end tag found of each tag of _RAW_END
        self.known: dict[int, int | None] = {}  # by the end of a start tag: the element's end, None if it is not closed

    def _end_tag(self, tag: str, at: int) -> re.Match | None:
        found = self.ends.get(tag, ...)
        if found is ... or found is not None and found.start() < at:
            found = self.ends[tag] = _RAW_END[tag].search(self.html, at)
        return found

    def end_of(self, at: int, tag: str, around) -> int | None:
        """Where a raw element whose start tag ends at ``at`` is over, None if it is never closed.

        ``around``: counts of the enclosing elements' tags. The end of one of them, or a start that can't be inside, says
        that it isn't closed.
        """
        if tag in _RAW_END:
            end = self._end_tag(tag, at)
            if tag in _OPAQUE:
                return end.end() if end else len(self.html)
            return end.end() if end and not _AGAIN[tag].search(self.html, at, end.start()) else None
        if at in self.known:
            return self.known[at]
        html, inside, within, whole = self.html, [(tag, at)], Counter([tag]), True
        while m := _TAG.search(html, at):
            at = m.end()
            if m.group(2) is None:
                continue
            name = m.group(2).lower()
            if m.group(1):
                if within[name] > 0:
                    while True:
                        n, began = inside.pop()
                        within[n] -= 1
                        if n == name:
                            break
                        self.known[began] = None
                    self.known[began] = at
                    if not inside:
                        return at
                elif around.get(name) and name not in _INLINE:
                    break
            elif name == tag and tag in _ONCE or tag in _CONTROLS and name in _NOT_IN_CONTROLS:
                whole = False
                break
            elif name in _RAW_END:
                end = self._end_tag(name, at)
                at = end.end() if end else at
            elif name not in _VOID and not m.group(0).endswith("/>"):
                inside.append((name, at))
                within[name] += 1
        for n, began in inside if whole else inside[:1]:
            self.known[began] = None
        return None


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in order, white space collapsed; scripts, styles, titles and comments give none.

    A raw element that is never closed takes the text up to the next block-level tag only, as boilerplate.
    """
    root = _Element("", 0, 0, 0, 0, False, False, "body")
    stack, out, run, linked = [root], [], [], 0
    number, at = 0, 0
    raw = 0  # where on the stack an unclosed raw element is
    raws, opened = _Raw(html), Counter()  # the tags on the stack
    article_before = False

    def cut(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]

    def close() -> None:
        nonlocal run, linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                e = stack[-1]
                out.append(Block(text, min(linked, len(text)), e.block, next(x.number for x in reversed(stack) if x.tag not in _INLINE), len(stack), e.good > 0, e.bad > 0, e.named, e.form))
            run, linked = [], 0

    def said(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text) if "&" in text else text
            run.append(text)
            if stack[-1].link:
                linked += len(text.strip())

    while m := _TAG.search(html, at):  # anew after each raw element: a match must not begin inside one
        said(html[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag not in _INLINE:
                close()
                if raw:
                    cut(raw)
                    raw = 0
            for i in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[i].tag == tag:
                    article_before = article_before or tag == "article" and stack[i].named >= 0
                    cut(i)
                    break
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break
            continue
        if tag in _RAW:
            end = at if tag == "svg" and m.group(0).endswith("/>") else raws.end_of(at, tag, opened)
            if end is not None:
                at = end
                run.append(" ")
                continue
            close()
            if not raw:
                up, raw, number = stack[-1], len(stack), number + 1
                stack.append(_Element(tag, number, up.good, 2, up.named, up.form, up.link, tag))
                opened[tag] += 1
            continue
        if tag in ("br", "hr"):
            run.append(" ")
        if tag not in _INLINE:
            close()
            if raw:
                cut(raw)
                raw = 0
            if stack[-1].tag != "" and any(x.tag == "p" for x in stack[-8:]):  # a block ends an open paragraph
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        cut(i)
                        break
                    if stack[i].tag not in _INLINE:
                        break
            if tag in _CLOSED_BY:
                ends, stops = _CLOSED_BY[tag]
                for i in range(len(stack) - 1, 0, -1) if any(opened[x] > 0 for x in ends) else ():
                    if stack[i].tag in stops:
                        break
                    if stack[i].tag in ends:
                        cut(i)
                        if tag != "tr":
                            break
        if tag in _VOID or m.group(0).endswith("/>") and tag in _INLINE:
            continue
        up = stack[-1]
        good, bad, named, form, attributes = up.good, up.bad, up.named, up.form, m.group(3)
        if tag in ("article", "main"):
            # what was said outside does not count; but an article inside an article, or in a bad name after one, may be a comment
            if good < 2 and not (tag == "article" and named < 0 and article_before):
                named, form, bad = 0, False, 2 if bad == 2 else 0
            good = 2 if tag == "article" else max(good, 1)
        form = form or tag == "form"
        if tag in _LANDMARK_BAD or tag == "header" and not up.good:
            bad = 2
        if attributes and tag not in ("html", "body", "a"):
            own, hidden = _said_of(attributes, tag, good)
            if own:
                named = own if own < 0 or named >= 0 else 0  # a good name inside a bad one leaves the matter open
            bad = bad or int(hidden)
        number += 1
        stack.append(_Element(tag, number, good, bad, named, form, up.link or tag == "a", up.block if tag in _INLINE else tag))
        opened[tag] += 1
    said(html[at:])
    close()
    return out


def features(blocks: list[Block], names: bool = True) -> np.ndarray:
    """What the classifier sees: TEXT columns, then MARKUP columns. Without ``names``, names and forms are not seen.

    The nearest statement counts: a good landmark says nothing inside a bad name or a boilerplate landmark.
    """
    n = len(blocks)
    x = np.zeros((n, FEATURES))
    for i, b in enumerate(blocks):
        size = len(b.text)
        words = b.text.count(" ") + 1
        named, form = (b.named, b.form) if names else (0, False)
        x[i, :TEXT] = [math.log1p(size), b.linked / size, math.log1p(words), min(size / words, 30) / 10, (b.text.count(".") + b.text.count(",")) / words, b.text[-1] in ".!?:;\"'", b.tag == "p", b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), b.tag in ("li", "td", "th", "dt", "dd"), i / n, 1.0]
        clear = b.good and not b.bad and named >= 0
        x[i, TEXT:] = [clear and not form, clear and form, b.bad, named < 0, named > 0 and not b.good, form and not b.good]
    return x


#: Prior weights, which stand where no page teaches otherwise: long unlinked sentences, and what is inside article or
#: main, are content; boilerplate landmarks, bad names, and forms outside an article are not.
PRIOR = np.array([0.6, -4.0, 0.2, 0.0, 0.5, 0.8, 0.8, 0.6, -0.8, 0.0, -2.5] + [4.0, 0.5, -8.0, -5.0, 1.5, -5.0])
#: Capacities of edges between neighbours and between siblings, where no page teaches otherwise.
EDGES = np.array([0.6, 0.9])
#: Label noise that fitting assumes: it bounds the log-odds.
NOISE = 0.02


def _fit(x: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge towards PRIOR; both labels weigh the same.

    Every row is seen whole, and once more with its text and once more with its markup hidden, so that each of the
    two learns to tell content without the other.
    """
    masks = np.ones((3, FEATURES))
    masks[1, : TEXT - 1], masks[2, TEXT:] = 0, 0
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    x = np.concatenate([x * m for m in masks])
    share = np.concatenate([share * f for f in (0.5, 0.25, 0.25)])
    y = np.tile(np.clip(y, NOISE, 1 - NOISE), 3)
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (share * (p - y)) + ridge * (w - PRIOR)
        h = (x * (share * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge * np.eye(FEATURES)
        d = np.linalg.solve(h, g)
        w = w - d / max(1.0, np.abs(d).max())
        if np.abs(d).max() < 1e-6:
            break
    return w


def _weak_label(b: Block) -> int:
    return 0 if b.bad or b.named < 0 and not b.good else 1 if b.good and b.named >= 0 and not b.form else -1


def fit_blocks(pages: DataFrame, *, page_id: str = "page_id", html: str = "html", most_pages: int = 1000, most_blocks: int = 512, ridge: float = 3e-3, steps: int = 100) -> np.ndarray:
    """The classifier's weights and, behind them, the capacities of edges between neighbours and between siblings.

    From the blocks of at most ``most_pages`` pages (those of the smallest hash of id). Weak labels: blocks inside article
    or main, and outside any boilerplate landmark, bad name and form, teach content; blocks inside nav, footer, aside or a
    page header, or a bad name outside article and main, teach boilerplate, 64 of either a page at most; others teach
    nothing. Four fifths of the pages fit the weights. The others, those of at most ``most_blocks`` blocks, fit one scale
    for all weights (calibration), and then the edges: of a grid, those whose cuts mislabel the fewest blocks when markup
    and tags are hidden. Without either label, PRIOR.
    """
    ids = pages.select(col(page_id).alias("page_id")).where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most_pages)
    ids = ids.withColumn("tests", F.row_number().over(Window.orderBy("page_id")) % 5 == 0)  # most_pages rows
    some = pages.select(col(page_id).alias("page_id"), col(html).cast("string").alias("html")).join(F.broadcast(ids), "page_id")

    def fn(texts: pa.Array) -> dict:
        out, whole = [], []
        for t in texts:
            blocks = blocks_of(t.as_py() or "")
            y = np.array([_weak_label(b) for b in blocks])
            z = np.concatenate([features(blocks), y[:, None]], axis=1) if len(y) else np.zeros((0, FEATURES + 1))
            out.append(np.concatenate([z[y == v][:64] for v in (0, 1)]).astype(np.float32).tobytes() if len(y) else b"")
            place = np.array([(b.depth, b.parent) for b in blocks]).reshape(-1, 2)
            whole.append(np.concatenate([z, place], axis=1).astype(np.float32).tobytes() if 0 < len(y) <= most_blocks else b"")
        return {"z": out, "whole": whole}

    found = map_texts(some, "html", ("page_id", "tests"), fn, "z binary, whole binary").select("row.*", "z", "whole")
    rows = found.select("page_id", "tests", F.when(~F.col("tests"), F.col("z")).alias("z"), F.when(F.col("tests"), F.col("whole")).alias("whole")).orderBy("page_id").collect()
    z = np.concatenate([np.frombuffer(r["z"] or b"", np.float32).reshape(-1, FEATURES + 1) for r in rows] or [np.zeros((0, FEATURES + 1))]).astype(float)
    if any(not (z[:, -1] == v).any() for v in (0, 1)):
        return PRIOR
    w = _fit(z[:, :-1], z[:, -1], ridge, steps)
    tests = [t for t in (np.frombuffer(r["whole"] or b"", np.float32).reshape(-1, FEATURES + 3).astype(float) for r in rows) if len(t) and (t[:, FEATURES] >= 0).any()]
    if not tests:
        return np.concatenate([w, EDGES])
    seen = np.concatenate([t[t[:, FEATURES] >= 0] for t in tests])
    x, y = seen[:, :FEATURES] @ w, seen[:, FEATURES]
    grid = np.geomspace(0.25, 4, 65)
    loss = [np.mean(np.logaddexp(0, np.where(y == 1, -s, s) * x) * (1 - NOISE) + np.logaddexp(0, np.where(y == 1, s, -s) * x) * NOISE) for s in grid]
    w = w * grid[int(np.argmin(loss))]
    hidden = np.ones(FEATURES)
    hidden[TEXT:], hidden[6:9] = 0, 0

    def mislabelled(pair: tuple[float, float]) -> int:
        wrong = 0
        for t in tests[:200]:
            side = _cut((t[:, :FEATURES] * hidden) @ w, _edges(t[:, FEATURES + 1], t[:, FEATURES + 2], *pair))
            known = t[:, FEATURES] >= 0
            wrong += int((np.array(side)[known] != (t[known, FEATURES] == 1)).sum())
        return wrong

    pairs = [tuple(EDGES), *((a, b) for a in (0.1, 0.3, 0.6, 1.2, 2.4) for b in (0.1, 0.4, 0.9, 1.8, 3.6) if (a, b) != tuple(EDGES))]
    return np.concatenate([w, min(pairs, key=mislabelled)])  # ties: EDGES, then the smaller


def minimum_cut(source: list[float], sink: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The nodes on the source's side of a minimum cut, by shortest augmenting paths in level graphs.

    ``edges`` are undirected. The flow straight through a node is taken first, so a node is left with either supply
    or demand. Equal cuts: the smallest source side.
    """
    n = len(source)
    supply = [max(0.0, a - b) for a, b in zip(source, sink)]
    demand = [max(0.0, b - a) for a, b in zip(source, sink)]
    near: list[list[int]] = [[] for _ in range(n)]
    left: dict[tuple[int, int], float] = {}
    for (i, j), c in edges.items():
        if c > 0 and i != j:
            if (i, j) not in left:
                near[i].append(j), near[j].append(i)
                left[i, j] = left[j, i] = 0.0
            left[i, j] += c
            left[j, i] += c
    tiny = 1e-9
    while True:
        level = [0 if s > tiny else -1 for s in supply]
        queue = deque(i for i in range(n) if level[i] == 0)
        found = False
        while queue:
            i = queue.popleft()
            found = found or demand[i] > tiny
            for j in near[i]:
                if level[j] < 0 and left[i, j] > tiny:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not found:
            return [x >= 0 for x in level]
        turn = [0] * n
        for s in range(n):
            while supply[s] > tiny:
                path = [s]
                while path and demand[path[-1]] <= tiny:
                    i = path[-1]
                    while turn[i] < len(near[i]):
                        j = near[i][turn[i]]
                        if level[j] == level[i] + 1 and left[i, j] > tiny:
                            path.append(j)
                            break
                        turn[i] += 1
                    else:
                        path.pop()
                        if path:
                            turn[path[-1]] += 1
                if not path:
                    break
                f = min([supply[s], demand[path[-1]], *(left[e] for e in zip(path, path[1:]))])
                supply[s] -= f
                demand[path[-1]] -= f
                for a, b in zip(path, path[1:]):
                    left[a, b] -= f
                    left[b, a] += f
                if f <= tiny:
                    break


def _edges(depth, parent, adjacent: float, sibling: float) -> dict[tuple[int, int], float]:
    """Smoothness: between neighbours, less the more their depths differ, and between the nearest blocks of one parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, p in enumerate(parent):
        if i:
            edges[i - 1, i] = adjacent / (1 + abs(depth[i] - depth[i - 1]))
        j = last.get(p)
        if j is not None:
            edges[j, i] = edges.get((j, i), 0.0) + sibling / (i - j)
        last[p] = i
    return edges


def _cut(z: np.ndarray, edges: dict) -> list[bool]:
    return minimum_cut(np.logaddexp(0, z).tolist(), np.logaddexp(0, -z).tolist(), edges)


def content(html: str | None, weights: np.ndarray, adjacent: float | None = None, sibling: float | None = None) -> list[str]:
    """The content blocks of a page; ``weights`` as :func:`fit_blocks` gives them, or without the edges' capacities (EDGES)."""
    blocks = blocks_of(html or "")
    if not blocks:
        return []
    own = weights[FEATURES:] if len(weights) > FEATURES else EDGES
    edges = _edges([b.depth for b in blocks], [b.parent for b in blocks], own[0] if adjacent is None else adjacent, own[1] if sibling is None else sibling)
    named = any(b.named < 0 or b.form for b in blocks)
    for names in (True, False) if named else (True,):  # names and forms tell the parts of a page apart; where they take it whole they tell nothing
        side = _cut(features(blocks, names) @ weights[:FEATURES], edges)
        if any(side):
            return [b.text for b, s in zip(blocks, side) if s]
    return []


def extracted(html: str | None, weights: np.ndarray) -> list[str]:
    """The content blocks of a page; one in which the cut finds none is cut once more with PRIOR: weights learnt from
    pages of one make may know no content of another."""
    return content(html, weights) or content(html, np.concatenate([PRIOR, weights[FEATURES:]]))


def extract_text(pages: DataFrame, weights: np.ndarray, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``row`` (struct of the kept columns), ``text``, ``n_blocks`` for every page: content blocks joined by newlines.

    Null and empty pages, and pages without content, give the empty text. Whole pages are read, cut-off ones and
    pages without any tag too; repeated rows give a row each.
    """

    def fn(texts: pa.Array) -> dict:
        found = [extracted(t.as_py(), weights) for t in texts]
        return {"text": ["\n".join(f) for f in found], "n_blocks": [len(f) for f in found]}

    return map_texts(pages, html, keep, fn, "text string, n_blocks int")
