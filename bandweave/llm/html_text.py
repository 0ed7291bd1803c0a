"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks: runs of text between the tags of block elements. A logistic classifier gives each block
the cost of being called content or boilerplate; these are the capacities to the two terminals. Neighbouring
blocks, and neighbours under one parent element, are joined by edges whose capacity falls with their distance
in the element tree. The minimum cut between the terminals is the labelling of least cost; blocks whose terminal
outweighs all their edges are settled first, which leaves max-flow (Dinic) little to do.

The classifier is trained on a bounded sample of pages (`sample`, about so many, chosen by a hash of page_id): blocks
in elements that say what they are (article, main; nav, footer, aside, form and the like, or such names in
class, id or role) are its labelled rows. Each is given twice, once without the features of its elements, so that
text features carry pages without such elements. Weights start from and are drawn towards PRIOR, which stands alone
where the sample has no labelled block.

Formulas and drawings (math, svg) are text like any other, as is what noscript and object hold.

Cases: null, empty and tag-only pages have the empty text. An unclosed script, style or comment runs to the end; an
unclosed tag is dropped. Long pages are processed whole. Rows that repeat are treated alike. An empty table gives an
empty result. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandweave.llm.common import map_arrow

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|title|textarea|iframe|select)(?=[\s>/])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s>/]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr noscript object svg g text tspan math mi mn mo mrow ms mspace mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("article main".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button head".split())
#: Parts of class, id and role names that mark boilerplate, and those that mark content.
BOILERPLATE_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|complementary|contentinfo|cookies?|consent|copyright|disclaimer|disqus|footer|form|gdpr|hidden|login|masthead|menus?|modal|nav\w*|newsletter|notices?|pagination|pager|popup|promos?|related|repl(?:y|ies)|search|share|sharing|side|sidebars?|sign-?up|social|sponsor\w*|subscribe|tags?|teasers?|toolbar|topbar|widgets?)(?:$|[\s_-])", re.I)
CONTENT_NAME = re.compile(r"(?:^|[\s_-])(?:article|story|post|entry|main|content|body-?text|article-?body|post-?body)(?:$|[\s_-])", re.I)
#: Elements that a start tag closes, if they are open inside the nearest fence; and any block closes a paragraph.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
FENCE = frozenset("ul ol dl table div section article main aside nav body".split())

#: Weights before training: bias, then as in features().
PRIOR = np.array([-0.3, 4.0, -5.0, 0.8, 0.6, -2.0, 0.5, 0.4, 0.3, -0.6, -2.0, 0.0])
MARKED = slice(1, 3)  # the features that say in which elements a block is


@dataclass
class Block:
    text: str
    at: int  # the number of the element that it is in, 0 for none
    mark: int  # 1: in an element for content, -1: in one for boilerplate, 0: neither
    tag: str
    linked: int  # characters in links


def marked(tag: str, attributes: str, mark: int) -> int:
    """The mark inside an element, given that around it."""
    if tag in BOILERPLATE or (tag == "header" and mark <= 0):
        return -1
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                return -1
            if name in ("class", "id", "role"):
                if BOILERPLATE_NAME.search(value):
                    return -1
                if CONTENT_NAME.search(value) and mark >= 0:
                    mark = 1
    return 1 if tag in CONTENT and mark >= 0 else mark


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page in its order, without those that have no text; and the parent of each element, by number."""
    out: list[Block] = []
    parent = [0]
    stack: list[tuple[str, int, int]] = []  # (tag, number, mark)
    places: dict[str, list[int]] = {}  # of each tag that is open, in the stack
    parts: list[str] = []
    linked = depth_a = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, stack[-1][1] if stack else 0, stack[-1][2] if stack else 0, stack[-1][0] if stack else "", linked))
        parts.clear()
        linked = 0

    def nearest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close(i: int) -> None:
        for tag, _, _ in stack[i:]:
            places[tag].pop()
        del stack[i:]

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if depth_a:
            linked += len(text.strip())

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                depth_a = 0 if m[2] else 1
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
            continue
        flush()
        if m[2]:
            if (i := nearest((tag,))) >= 0:
                close(i)
            depth_a = 0
            continue
        if stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in CLOSES and (i := nearest(CLOSES[tag])) > nearest(FENCE):
            close(i)
        if not m[4].endswith("/"):
            parent.append(stack[-1][1] if stack else 0)
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, len(parent) - 1, marked(tag, m[4], stack[-1][2] if stack else 0)))
    add(page[at:])
    flush()
    return out, parent


def features(found: list[Block]) -> np.ndarray:
    """A row for each block: bias, marks, length, sentences, link density, paragraph or heading, long words around,
    place in the page, list or cell, legal signs, shortness beside short blocks."""
    n = len(found)
    out = np.zeros((n, len(PRIOR)))
    words = np.array([len(b.text.split()) for b in found], float)
    around = np.convolve(np.concatenate([[0], words, [0]]), [1, 0, 1], "valid") if n else words
    for i, b in enumerate(found):
        t = b.text
        out[i] = (
            1,
            b.mark > 0,
            b.mark < 0,
            min(np.log1p(words[i]) - 2.5, 2.5),
            t[-1] in ".!?…。\"”»" and words[i] > 4,
            min(1.0, b.linked / len(t)),
            b.tag in ("p", "blockquote", "pre", "h1", "h2", "h3", "figcaption"),
            min(np.log1p(around[i]) - 2.5, 2.5),
            0.15 < (i + 0.5) / n < 0.85,
            b.tag in ("li", "td", "th", "ul", "dt", "dd", "label", "button"),
            t[0] in "©®" or "©" in t or "all rights reserved" in t.lower(),
            words[i] <= 3,
        )
    return out


def trained(x: np.ndarray, content: np.ndarray, steps: int = 400, rate: float = 0.5, pull: float = 1e-3) -> np.ndarray:
    """Logistic regression by gradient steps, drawn towards PRIOR; both classes weigh the same."""
    w = PRIOR.copy()
    if not len(x) or content.all() or not content.any():
        return w
    bare = x.copy()
    bare[:, MARKED] = 0
    x, y = np.concatenate([x, bare]), np.concatenate([content, content]).astype(float)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= rate * (x.T @ (weight * (p - y)) + pull * (w - PRIOR))
    return w


def distance(a: int, b: int, parent: list[int]) -> int:
    """Steps between two elements in the tree. Numbers ascend from parent to child. Over all neighbours in the page the steps add up
    to twice the tree at most."""
    steps = 0
    while a != b:
        a, b = (parent[a], b) if a > b else (a, parent[b])
        steps += 1
    return steps


def edges(found: list[Block], parent: list[int], strength: float) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours in the page, and the next block under the same parent."""
    out = [(i, i + 1, strength / (1 + distance(found[i].at, found[i + 1].at, parent))) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        j = last.get(parent[b.at])
        if j is not None and j < i - 1:
            out.append((j, i, strength / 4))
        last[parent[b.at]] = i
    return out


def max_flow(source: list[float], sink: list[float], joined: list[tuple[int, int, float]]) -> list[bool]:
    """Dinic's algorithm; True for nodes on the source's side of a minimum cut (that with the fewest)."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i in range(n):
        join(s, i, source[i], 0.0)
        join(i, t, sink[i], 0.0)
    for a, b, c in joined:
        join(a, b, c, c)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        todo = deque([s])
        while todo:
            a = todo.popleft()
            for e in out[a]:
                if room[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    todo.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if room[e] <= eps)
                a = to[path[k] ^ 1]
                del path[k:]
            while at[a] < len(out[a]) and not (room[out[a][at[a]]] > eps and level[to[out[a][at[a]]]] == level[a] + 1):
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = to[path[-1]]
            elif a == s:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def cut(gain: np.ndarray, joined: list[tuple[int, int, float]]) -> np.ndarray:
    """The labelling with the least cost: gain[i] is what calling block i content saves over boilerplate. Blocks whose gain
    outweighs their edges are settled, and their edges become gain or loss of their neighbours."""
    n = len(gain)
    gain, label, settled = gain.astype(float).copy(), np.zeros(n, bool), np.zeros(n, bool)
    beside: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in joined:
        beside[a][b] = beside[a].get(b, 0.0) + c
        beside[b][a] = beside[b].get(a, 0.0) + c
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if settled[i] or abs(gain[i]) < sum(beside[i].values()):
            continue
        settled[i], label[i] = True, gain[i] > 0
        for j, c in beside[i].items():
            gain[j] += c if label[i] else -c
            del beside[j][i]
            todo.append(j)
        beside[i] = {}
    rest = np.flatnonzero(~settled)
    if len(rest):
        place = {int(i): k for k, i in enumerate(rest)}
        inner = [(place[i], place[j], c) for i in place for j, c in beside[i].items() if i < j]
        label[rest] = max_flow([max(0.0, g) for g in gain[rest]], [max(0.0, -g) for g in gain[rest]], inner)
    return label


def main_text(page: str | None, weights: np.ndarray, strength: float) -> str:
    found, parent = blocks(page or "")
    if not found:
        return ""
    # log p - log(1 - p), the difference of the two costs, is the classifier's sum.
    return " ".join(b.text for b, yes in zip(found, cut(features(found) @ weights, edges(found, parent, strength)), strict=True) if yes)


def labelled_blocks(pages: DataFrame) -> DataFrame:
    """(x, content) of the blocks of pages (html) whose elements say what they are."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, content = [], []
            for page in batch.column(0).to_pylist():
                found, _ = blocks(page or "")
                for b, x in zip(found, features(found), strict=True):
                    if b.mark:
                        rows.append(x.tolist())
                        content.append(b.mark > 0)
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(content, pa.bool_())], ["x", "content"])

        return step

    return map_arrow(pages.select("html"), make, "x array<double>, content boolean")


def fit(pages: DataFrame, sample: int, seed: int) -> np.ndarray:
    """Weights from about `sample` pages."""
    share = min(1.0, sample / max(1, pages.count()))
    chosen = pages.where(F.pmod(F.xxhash64(F.lit(seed), "page_id"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    got = labelled_blocks(chosen).toArrow().combine_chunks()
    if not got.num_rows:
        return PRIOR
    order = np.lexsort([got.column("content").to_numpy(), *np.array(got.column("x").to_pylist()).T])  # whatever order they came in
    return trained(np.array(got.column("x").to_pylist())[order], np.asarray(got.column("content"), bool)[order])


def extract(pages: DataFrame, *, sample: int = 400, strength: float = 1.0, seed: int = 11) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. strength: capacity of an edge between blocks of one element."""
    weights = fit(pages, sample, seed)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(page, weights, strength) for page in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return step

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), make, "page_id long, url string, text string, n_chars long")
