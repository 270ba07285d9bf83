"""Main text of web pages by a minimum cut between content and boilerplate.

A page is split into blocks of text. A logistic classifier over a block's structure and wording gives it a
cost for either label; names that speak of content or boilerplate (elements, roles, classes, ids) are features among
others, whose weights are learned. The costs become the capacities from the source and to the sink. Blocks are
tied by smoothness edges: to the next block, the less the further they are apart in the document tree, and
to the containers that they share. The side of the source of a minimum cut is the content.

The classifier learns from blocks whose names leave no doubt, once with those names and once without, so that it
weighs structure and wording where a page has no telling names.

Null and empty pages give an empty text. Whole pages are read and every content block is kept in full; pages are
parsed in time linear in their length, however deep they nest.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bounded_batches

# Element and attribute vocabulary of HTML pages.
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "template", "svg", "math", "noframes", "object", "canvas", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
GOOD_TAGS = {"article", "main"}
BAD_TAGS = {"nav", "footer", "aside", "header", "form", "menu", "dialog", "button", "select"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar"}
GOOD_WORDS = {"article", "content", "entry", "main", "post", "story"}
BAD_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "reply", "share", "sharing", "sidebar", "signup", "skip",
    "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
HEADINGS, ITEMS = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd", "td", "th", "option"}
#: Open elements that an opening tag closes, and those beyond which it closes none.
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu")), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("td", "th", "tr"), ("table",)),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
}
#: Capacities of smoothness edges: to the next block, over the square root of the tree distance, and to a shared container.
ADJACENT, CONTAINER = 0.6, 0.8
#: RAW elements whose content is tags: without an end tag nothing of the page belongs to them.
MARKUP_RAW = {"svg", "math", "noscript", "template", "object", "canvas"}
#: Bounds of the training sample: pages, and blocks of one page.
TRAIN_PAGES, TRAIN_BLOCKS = 400, 200

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attr>(?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[A-Za-z][A-Za-z0-9:-]*)[^>]*>|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?=[\s=>/]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_OPEN_VALUE = re.compile(r"""=\s*[^\s"'>]+\Z""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    """text; share of its characters in links; its container's number; its element; whether names speak for content, and how many against."""

    text: str
    linked: float
    container: int
    name: str
    good: bool = False
    bad: int = 0


def _evidence(name: str, attr: str, in_content: bool) -> tuple[bool, bool, bool, str]:
    """Whether an element speaks for content, whether against, whether the latter as a form or by its class or id only, and "article" or "main" if it is such an element."""
    good, bad, worded = name in GOOD_TAGS, name in BAD_TAGS and not (name == "header" and in_content), False
    holder = name if good else ""
    if bad and name == "form":
        bad, worded = False, True
    if attr and not attr.isspace():
        for m in _ATTR.finditer(attr):
            key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
            if key == "role":
                if value.lower() in GOOD_TAGS:
                    good, holder = True, holder or value.lower()
                bad = bad or value.lower() in BAD_ROLES
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                bad = True
            elif key in ("class", "id"):
                words = {w.lower() for w in _WORD.findall(value)}
                worded = worded or not words.isdisjoint(BAD_WORDS) or ("header" in words and not in_content)
                good = good or not words.isdisjoint(GOOD_WORDS)
    clean = not bad and not worded
    return good and clean, not clean, worded and not bad, holder if clean else ""


@dataclass
class Holder:
    """An article or main element: its name, the holder around it, its place in the chain of elements against content, and its text's length."""

    name: str
    outer: int
    against: int
    size: int = 0


def _weigh(blocks: list[Block], marks: list[tuple[bool, int, int]], holders: list[Holder], chain: list[tuple[int, bool]]) -> None:
    """Sets good and bad of blocks from marks (content evidence, end of the chain of elements against it, holder).

    The page's main element and its longest article are what its wrappers are there for: a class or id of an
    element around one of them says nothing against what articles hold, unless more text stands in clear
    content outside of articles.
    """
    times = [0] * len(chain)
    for i in range(1, len(chain)):
        times[i] = times[chain[i][0]] + 1
    clear = [0] * (len(holders) + 1)
    for b, (good, against, holder) in zip(blocks, marks, strict=True):
        if holder >= 0:
            holders[holder].size += len(b.text)
        if good and not times[against] and (holder < 0 or holders[holder].name == "main"):
            clear[holder] += len(b.text)
    for i in range(len(holders) - 1, -1, -1):  # the inner ones come after the outer ones
        if holders[i].outer >= 0:
            holders[holders[i].outer].size += holders[i].size
    wrappers = set()
    for name in ("main", "article"):
        of_name = [i for i, h in enumerate(holders) if h.name == name]
        if not of_name:
            continue
        best = max(of_name, key=lambda i: holders[i].size)
        inside = [False] * len(holders)
        for i, h in enumerate(holders):
            inside[i] = i == best or h.outer >= 0 and inside[h.outer]
        if sum(clear[i] for i in range(-1, len(holders)) if i < 0 or not inside[i]) <= holders[best].size:
            at = holders[best].against
            while at:
                if chain[at][1]:
                    wrappers.add(at)
                at = chain[at][0]
    left = [0] * len(chain)
    for i in range(1, len(chain)):
        left[i] = left[chain[i][0]] + (i not in wrappers)
    for b, (good, against, holder) in zip(blocks, marks, strict=True):
        bad = times[against]
        if holder >= 0:
            bad += left[holders[holder].against] - times[holders[holder].against]
        b.good, b.bad = good, min(bad, 2)


def parse(page: str) -> tuple[list[Block], list[int]]:
    """The page's blocks in order, and for each container the number of the one that holds it (-1: none)."""
    parents, blocks = [-1], []
    # open elements: name, container, content evidence, end of the chain of elements against it, links, article or main element
    stack: list[tuple[str, int, bool, int, int, int]] = [("", 0, False, 0, 0, -1)]
    opened: dict[str, list[int]] = {}  # places of the open elements in the stack by name
    outer: list[int] = []  # places of the open elements that are not inline
    endless: set[str] = set()  # elements of RAW that have no end tag any more
    chain: list[tuple[int, bool]] = [(0, False)]  # elements against content: the next outer one, whether by words only
    holders: list[Holder] = []
    marks: list[tuple[bool, int, int]] = []
    held: list[str] = []
    size = linked = at = 0

    def close() -> None:
        nonlocal size, linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                _, container, good, against, _, holder = stack[-1]
                blocks.append(Block(text, linked / max(size, 1), container, stack[outer[-1]][0] if outer else ""))
                marks.append((good, against, holder))
            held.clear()
            size = linked = 0

    def add(raw: str) -> None:
        nonlocal size, linked
        if raw:
            text = html_lib.unescape(raw) if "&" in raw else raw
            held.append(text)
            n = len(text.strip())
            size += n
            linked += n * bool(stack[-1][4])

    def last(names: tuple[str, ...]) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=0)

    def leave(depth: int) -> None:
        while len(stack) > depth:
            name = stack.pop()[0]
            opened[name].pop()
            if outer and outer[-1] == len(stack):
                outer.pop()

    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = (m.group("name") or m.group("name2") or "").lower()
        if not name:
            continue
        if m.group("end") or m.group("end2"):
            if name not in INLINE:
                close()
            depth = last((name,))
            if depth and not (name in INLINE and outer and outer[-1] > depth):
                if any(stack[d][1] != stack[depth - 1][1] or stack[d][3] != stack[depth - 1][3] for d in range(depth, len(stack))):
                    close()
                leave(depth)
            if name == "p" and not held:
                close()
            continue
        attr = m.group("attr") or ""
        if name in RAW:
            if attr.endswith("/") and (name in ("svg", "math") or not _OPEN_VALUE.search(attr)):
                continue
            pattern = r"</head\s*>|<body\b" if name == "head" else rf"</{re.escape(name)}\b[^>]*>?"
            end = None if name in endless else re.compile(pattern, re.I).search(page, at)
            if not end:
                endless.add(name)
            if name == "head":
                at = (end.start() if end.group(0)[1] != "/" else end.end()) if end else at
            else:
                at = end.end() if end else at if name in MARKUP_RAW else len(page)
            continue
        if name not in INLINE:
            close()
            for closes, until in ((("p",), ("table", "td", "th", "button")), CLOSED_BY.get(name, ((), ()))):
                depth = last(closes)
                if depth > last(until):
                    leave(depth)
        if name in VOID:
            continue
        _, container, good, against, links, holder = stack[-1]
        here_good, here_bad, worded, holds = _evidence(name, attr, good) if attr or name not in INLINE else (False, False, False, "")
        if name in ("html", "body"):  # what every block of the page has says nothing against one
            here_bad = False
        if name in INLINE and here_bad:
            close()
        if name not in INLINE:
            parents.append(container)
            container = len(parents) - 1
        if not attr.endswith("/") or name in INLINE:
            if holds:
                holders.append(Holder(holds, holder, against))
                holder = len(holders) - 1
            if here_bad:
                chain.append((against, worded))
                against = len(chain) - 1
            opened.setdefault(name, []).append(len(stack))
            if name not in INLINE:
                outer.append(len(stack))
            stack.append((name, container, good or here_good, against, links + (name == "a"), holder))
    add(page[at:])
    close()
    _weigh(blocks, marks, holders, chain)
    return blocks, parents


#: Which features are names; the others are structure and wording.
NAMED = (1, 2)


def features(blocks: list[Block], parents: list[int]) -> np.ndarray:
    """A row for each block: a constant; names for and against content; and its wording, links, element, place and company."""
    words = [b.text.split() for b in blocks]
    group = [parents[b.container] if parents[b.container] >= 0 else b.container for b in blocks]
    n_words, linked, members = Counter(), Counter(), Counter()
    for g, w, b in zip(group, words, blocks, strict=True):
        n_words[g] += len(w)
        linked[g] += b.linked
        members[g] += 1
    rows = []
    for i, (b, w, g) in enumerate(zip(blocks, words, group, strict=True)):
        n = len(w)
        rows.append(
            (
                1.0, float(b.good), float(b.bad), min(np.log1p(n), 6.0) / 3, b.linked, linked[g] / members[g], float(b.text[-1] in ".!?…:;\"'”»"),
                min(b.text.count(".") + b.text.count(","), n) / n, float(n < 4), float("©" in b.text or "|" in b.text or "·" in b.text),
                float(b.name in HEADINGS), float(b.name in ITEMS), float(b.name == "p"), float(i == 0), float(i == len(blocks) - 1), min(np.log1p(n_words[g]), 8.0) / 4,
            )
        )
    return np.array(rows, dtype=float).reshape(len(blocks), len(DEFAULT_WEIGHTS))


#: Used where a table has no blocks to learn from; in the order of the features.
DEFAULT_WEIGHTS = [-1.0, 3.0, -4.0, 0.7, -2.0, -1.0, 0.4, 0.4, -0.4, -2.0, 0.2, -0.3, 0.5, -0.2, -0.5, 0.3]


def fit(rows: np.ndarray, labels: np.ndarray, steps: int = 600, rate: float = 1.0, decay: float = 0.02) -> list[float]:
    """Logistic regression by gradient descent, both classes weighing alike; what the examples leave open stays near DEFAULT_WEIGHTS."""
    if not len(labels) or labels.min() == labels.max():
        return DEFAULT_WEIGHTS
    weight = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    prior = np.array(DEFAULT_WEIGHTS)
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        w -= rate * (rows.T @ (weight * (p - labels)) + decay * (w - prior))
    return w.tolist()


def min_cut(scores: list[float], edges: list[tuple[int, int, float]], n: int) -> list[bool]:
    """Whether each of n nodes lies on the source's side of a minimum cut (Dinic's algorithm).

    A positive score is a capacity from the source, a negative one to the sink; edges hold both ways.
    Nodes beyond the scores have neither. A node that either side may have goes to the sink.
    """
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            tie(source, i, s, 0.0)
        elif s < 0:
            tie(i, sink, -s, 0.0)
    for a, b, w in edges:
        tie(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[first] ^ 1]
                del path[first:]
            while tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(out[a]):
                path.append(out[a][tried[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                tried[a] += 1
            else:
                break


def costs(blocks: list[Block], parents: list[int], weights: list[float]) -> list[float]:
    """The classifier's log odds of content for each block: what it costs to label it as boilerplate, or, if negative, as content."""
    return (features(blocks, parents) @ np.array(weights)).tolist()


def ties(blocks: list[Block], parents: list[int]) -> tuple[list[tuple[int, int, float]], int]:
    """Smoothness edges between blocks, and nodes after them that stand for containers; how many nodes there are.

    Containers that hold one block or container only are left out, so that an edge joins what they hold to the next container.
    """
    n = len(blocks)
    depth = [0] * len(parents)
    for i in range(1, len(parents)):
        depth[i] = depth[parents[i]] + 1
    edges = []
    for i in range(n - 1):
        a, b, apart = blocks[i].container, blocks[i + 1].container, 0
        while a != b:
            if depth[a] >= depth[b]:
                a = parents[a]
            else:
                b = parents[b]
            apart += 1
        edges.append((i, i + 1, ADJACENT / math.sqrt(1 + apart)))
    inside: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        inside.setdefault(b.container, []).append(i)
    nodes = n
    for c in range(len(parents) - 1, -1, -1):  # inner containers come after the outer ones
        items = inside.pop(c, [])
        if len(items) > 1:
            edges += [(item, nodes, CONTAINER) for item in items]
            items = [nodes]
            nodes += 1
        if items and parents[c] >= 0:
            inside.setdefault(parents[c], []).append(items[0])
    return edges, nodes


def label(blocks: list[Block], parents: list[int], weights: list[float]) -> list[bool]:
    """Whether each block is content: the side of the source of a minimum cut."""
    if not blocks:
        return []
    edges, nodes = ties(blocks, parents)
    return min_cut(costs(blocks, parents, weights), edges, nodes)[: len(blocks)]


def main_text(page: str | None, weights: list[float]) -> str:
    blocks, parents = parse(page or "")
    return " ".join(b.text for b, keep in zip(blocks, label(blocks, parents, weights), strict=True) if keep)


def examples(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks whose names speak clearly, without and with those names."""
    blocks, parents = parse(page)
    clear = [i for i, b in enumerate(blocks) if b.good != (b.bad > 0)][:TRAIN_BLOCKS]
    rows = features(blocks, parents)[clear]
    named = rows.copy()
    rows[:, NAMED] = 0.0
    labels = np.array([float(blocks[i].good) for i in clear])
    return np.concatenate((rows, named)), np.concatenate((labels, labels))


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> list[float]:
    """Weights of the logistic score, learned from at most TRAIN_PAGES pages, those with the least md5 of the id.

    A block is an example if its names speak clearly for or against content, and is one without its names too. At
    most TRAIN_BLOCKS blocks of a page count. A table without examples gives DEFAULT_WEIGHTS.
    """
    base = bounded_batches(pages).select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter("html is not null and id is not null")
    ids = base.select("id").distinct().orderBy(F.md5(F.col("id").cast("string")), "id").limit(TRAIN_PAGES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, page in zip(pdf["key"], pdf["html"], strict=True):
                out += [(key, i, x, y) for i, (x, y) in enumerate(zip(*examples(page), strict=True))]
            yield pd.DataFrame(out, columns=["key", "i", "x", "y"])

    sample = base.join(F.broadcast(ids), "id", "left_semi").select(F.md5(F.col("id").cast("string")).alias("key"), "html")
    got = sample.mapInPandas(run, "key string, i int, x array<double>, y double").toPandas().sort_values(["key", "i"], kind="stable")
    return fit(np.array(got["x"].tolist()), got["y"].to_numpy(dtype=float)) if len(got) else DEFAULT_WEIGHTS


def extract(pages: DataFrame, weights: list[float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every page, repeated rows and null ids included; other columns are not read, an empty table gives no rows."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, weights) for p in pages], dtype=object)

    done = bounded_batches(pages).select(F.col(id_col).alias(id_col), F.col(url_col).alias(url_col), run(F.col(html_col)).alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
