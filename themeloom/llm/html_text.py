"""Main text of web pages, by a graphical model over the DOM tree.

Each block element is content or not. A node's own evidence (names, text, links) is one
potential, and each parent and child share another, since content mostly lies in content. Two
passes of sum-product messages, up to the root and down again, give each node's exact marginal
under both; blocks that are rather content are the main text.

Training pages are labelled by their own markup: where a page has one ``article`` or ``main``
element, blocks in it are content and blocks outside are not, nor are adverts, menus and the
like inside it. For half of these pages that markup is then hidden from the features, page
furniture is moved into the article and paragraphs into furniture, so that the model learns from
what else pages show.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.batches import bounded, filled

#: Bounds of the labelled sample: pages that are read, and nodes that are kept.
SAMPLE_PAGES, SAMPLE_NODES = 3_000, 60_000

# Names of elements, and words that classes, ids and roles of page parts contain.
#: Raw text, up to its own end tag or the end of the page; and elements whose content is no text of the page.
SKIPPED = "script|style|noscript|title|textarea|iframe"
DROPPED = frozenset("svg button select template".split())
BLOCKS = frozenset(
    "html body div section article main header footer nav aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary dialog hr center".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
LISTS = frozenset("ul ol dl table".split())
FURNITURE = frozenset(
    "nav header footer aside form dialog menu navigation navbar sidebar side ad ads advert advertisement sponsor sponsored banner promo "
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login search breadcrumb breadcrumbs "
    "pagination pager related recommended share sharing social widget comment comments reply replies respond disqus copyright legal "
    "toolbar complementary contentinfo skip toc masthead".split())
MAIN = frozenset("article main content post entry story articlebody post-content entry-content".split())
SEMANTIC = frozenset(("article", "main"))
#: Elements that carry the text itself: classes and ids, often made from a heading's words, say nothing against them.
TEXTUAL = frozenset("html body main article p h1 h2 h3 h4 h5 h6".split())
#: What a class begins with that tells of something else on the page, as in ``has-sidebar``.
_MODIFIER = re.compile(r"(?:has|no|not|with|without|is)[-_]", re.I)

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({SKIPPED})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
FEATURES = 17


@dataclass
class Node:
    tag: str
    parent: int
    names: set[str] = field(default_factory=set)
    own: int = 0      # characters of text directly in it
    links: int = 0    # of these, in links
    words: int = 0
    stops: int = 0    # full stops and the like
    runs: int = 0


def _names(tag: str, attributes: str) -> set[str]:
    found = {tag}
    if "=" in attributes:
        for groups in _NAMES.findall(attributes):
            for name in "".join(groups).split():
                if not _MODIFIER.match(name):
                    found.add(name.lower())
                    found.update(w.lower() for w in _WORD.findall(name))
    return found - FURNITURE if tag in TEXTUAL else found


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order, parents first, and the text blocks (node, text).

    White space in a block is one space, inline elements leave no mark, a line break is white
    space. End tags that are left out are supplied; those of elements that are not open are ignored.
    A head needs no end tag: what is text or a block there belongs to the body, as in a browser.
    """
    nodes, texts = [Node("#", -1)], []
    stack, pieces, links, linked = [0], [], 0, 0
    dropped: list[str] = []  # open elements of DROPPED; the end of a block around them ends them too

    def end_block() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                node = nodes[stack[-1]]
                node.own += len(text)
                node.links += min(linked, len(text))
                node.words += text.count(" ") + 1
                node.stops += sum(map(text.count, ".!?,;:"))
                node.runs += 1
                texts.append((stack[-1], text))
            pieces, linked = [], 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not dropped:
            raw = entities.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if links:
                linked += len(raw.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        closing = bool(m[2])
        if tag in DROPPED:
            if closing and tag in dropped:
                while dropped.pop() != tag:
                    pass
            elif not closing and not m[4].rstrip().endswith("/"):
                dropped.append(tag)
            continue
        if dropped and tag in BLOCKS and (tag != "div" or closing) and "template" not in dropped:
            dropped.clear()  # one that is left open takes no more than its block along
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            pieces.append(" ")
        elif tag not in BLOCKS:
            continue
        elif closing:
            end_block()
            links = 0
            if any(nodes[i].tag == tag for i in stack):
                while nodes[stack.pop()].tag != tag:
                    pass
        else:
            end_block()
            links = 0
            if nodes[stack[-1]].tag == "p":
                stack.pop()
            if tag in CLOSES:
                for depth in range(len(stack) - 1, 0, -1):
                    name = nodes[stack[depth]].tag
                    if name in LISTS:
                        break
                    if name in CLOSES[tag]:
                        del stack[depth:]
                        if tag != "tr":
                            break
            if tag != "hr":
                nodes.append(Node(tag, stack[-1], _names(tag, m[4])))
                stack.append(len(nodes) - 1)
    text(page[at:])
    end_block()
    return nodes, texts


def features(nodes: list[Node], hide: bool = False) -> np.ndarray:
    """Evidence of each node; ``hide`` leaves out what names the main part."""
    n = len(nodes)
    total, linked, paragraphs = ([0] * n for _ in range(3))
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        total[i] += node.own
        linked[i] += node.links
        if i:
            total[node.parent] += total[i]
            linked[node.parent] += linked[i]
            paragraphs[node.parent] += node.tag == "p" and node.own > 0
    whole = max(total[0], 1)
    out = np.zeros((n, FEATURES))
    before = 0
    for i, node in enumerate(nodes):
        tag, own = node.tag, node.own
        out[i] = (1, bool(node.names & FURNITURE), not hide and bool(node.names & MAIN), tag == "p", tag[0] == "h" and len(tag) == 2 and tag != "hr",
                  tag == "li", tag in ("ul", "ol", "dl"), tag in ("div", "section"), tag in ("td", "th", "tr", "table"), tag in ("html", "body", "#"),
                  math.log1p(own) / 5, math.log1p(total[i]) / 5, linked[i] / max(total[i], 1), node.stops / max(node.words, 1),
                  total[i] / whole, before / whole, min(paragraphs[i], 5) / 5)
        before += own
    return out


@dataclass
class Model:
    """Weights of the evidence, prior of content, and P(child | parent) as [parent is furniture][parent][child]."""

    weights: np.ndarray
    prior: float
    given: list[list[list[float]]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability that each node is content, given the whole page."""
        odds = features(nodes) @ self.weights
        odds -= math.log(self.prior / (1 - self.prior))  # evidence alone; the tree brings the prior
        odds = np.clip(odds, -30, 30)
        up1 = (1 / (1 + np.exp(-odds))).tolist()  # belief of the subtree, normalised
        up0 = [1 - x for x in up1]
        n = len(nodes)
        given = [self.given[bool(i and nodes[x.parent].names & FURNITURE)] for i, x in enumerate(nodes)]
        to0, to1 = [1.0] * n, [1.0] * n  # message of each node to its parent
        for i in range(n - 1, 0, -1):
            (t00, t01), (t10, t11) = given[i]
            a, b = up0[i], up1[i]
            m0, m1 = t00 * a + t01 * b, t10 * a + t11 * b
            s = m0 + m1
            to0[i], to1[i] = m0, m1 = m0 / s, m1 / s
            p = nodes[i].parent
            a, b = up0[p] * m0, up1[p] * m1
            s = a + b or 1.0
            up0[p], up1[p] = max(a / s, 1e-300), max(b / s, 1e-300)
        out = [0.0] * n
        a, b = up0[0] * (1 - self.prior), up1[0] * self.prior
        out[0] = b / (a + b)
        for i in range(1, n):
            (t00, t01), (t10, t11) = given[i]
            p = out[nodes[i].parent]
            # The parent's belief without this child, then down the edge.
            a, b = (1 - p) / to0[i], p / to1[i]
            s = a + b
            a, b = a / s, b / s
            d0, d1 = (a * t00 + b * t10) * up0[i], (a * t01 + b * t11) * up1[i]
            out[i] = d1 / (d0 + d1)
        return out

    def extract(self, page: str) -> str:
        nodes, texts = parse(page)
        if not texts:
            return ""
        content = self.marginals(nodes)
        return " ".join(t for i, t in texts if content[i] > 0.5)


def labels(nodes: list[Node]) -> list[int] | None:
    """1 for blocks in the page's only article or main element and not in furniture, 0 for others; None without one."""
    roots = [i for i, x in enumerate(nodes) if x.tag in SEMANTIC and not _inside(nodes, nodes[i].parent)]
    if len(roots) != 1:
        return None
    out = [0] * len(nodes)
    for i, node in enumerate(nodes):
        inside = i == roots[0] or (i > 0 and out[node.parent])
        out[i] = int(inside and not (node.names & FURNITURE))
    return out


def _inside(nodes: list[Node], i: int) -> bool:
    while i > 0:
        if nodes[i].tag in SEMANTIC:
            return True
        i = nodes[i].parent
    return False


def _commented(nodes: list[Node], truth: list[int], turn: int) -> tuple[list[Node], list[int]]:
    """The page with every other paragraph of the article, from the second on, inside furniture instead."""
    first = next((i for i, x in enumerate(nodes) if not truth[i] and x.names & FURNITURE), None)
    inner = {x.parent for x in nodes}
    moved = [i for i, y in enumerate(truth) if y and first is not None and i > first and i not in inner][1 + turn % 2::2]
    made, truth = [Node(**vars(x)) for x in nodes], list(truth)
    for i in moved:
        made[i].parent, truth[i] = first, 0
    return made, truth


def _moved(nodes: list[Node], truth: list[int], turn: int) -> tuple[list[Node], list[int]]:
    """The page with one piece of furniture inside the article instead of outside it."""
    article = truth.index(1)
    outside = [i for i, x in enumerate(nodes) if not truth[i] and x.names & FURNITURE and not nodes[x.parent].names & FURNITURE]
    if not outside:
        return nodes, truth
    i = outside[turn % len(outside)]
    made = [Node(**vars(x)) for x in nodes]
    if i > article:
        made[i].parent = article
        return made, truth
    # Parents come first: the subtree goes to the end.
    end = next((j for j in range(i + 1, len(nodes)) if nodes[j].parent < i), len(nodes))
    order = [*range(i), *range(end, len(nodes)), *range(i, end)]
    place = {old: new for new, old in enumerate(order)}
    made = [made[j] for j in order]
    for x in made:
        x.parent = place.get(x.parent, -1)
    made[place[i]].parent = place[article]
    return made, [truth[j] for j in order]


def train(df: DataFrame, html: str = "html", pages: int = SAMPLE_PAGES) -> Model:
    """Fit on about ``pages`` pages with one article, chosen by a hash of the page.

    Without such pages the model relies on its starting weights alone: names, links and length.
    """
    bounded(df.sparkSession)
    there = df.filter(F.lower(html).rlike("<(article|main)[ >]"))
    count = there.count()
    key = F.xxhash64(F.lit("pages"), html)
    chosen = there if count <= pages else there.filter(F.pmod(key, F.lit(1 << 20)) < int((1 << 20) * pages / count))

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, key in zip(batch["html"], batch["key"], strict=True):
                nodes, _ = parse(page)
                truth = labels(nodes)
                if truth is None:
                    continue
                turn = abs(int(key)) // 7
                if turn % 3 == 0:
                    nodes, truth = _moved(nodes, truth, turn // 3)
                elif turn % 3 == 1:
                    nodes, truth = _commented(nodes, truth, turn // 3)
                seen = features(nodes, hide=turn % 2 == 0)
                rows += [(int(key), i, seen[i].tolist(), truth[i], truth[x.parent] if i else 0,
                          int(bool(i and nodes[x.parent].names & FURNITURE))) for i, x in enumerate(nodes)]
            yield pd.DataFrame(rows, columns=["key", "i", "x", "y", "above", "kind"])

    rows = (chosen.dropDuplicates([html]).select(F.col(html).alias("html"), key.alias("key"))
            .mapInPandas(labelled, "key long, i int, x array<double>, y int, above int, kind int")
            .orderBy(F.xxhash64("key", "i"), "key", "i").limit(SAMPLE_NODES).toPandas())
    start = np.zeros(FEATURES)
    start[[0, 1, 2, 3, 4, 5, 10, 12]] = -1, -16, 3, 1, 1, -1, 1, -3
    if rows.empty or rows["y"].nunique() < 2:
        return Model(start, 0.5, [[[0.9, 0.1], [0.1, 0.9]]] * 2)
    x, y, above, kind = np.stack(rows["x"]), rows["y"].to_numpy(float), rows["above"].to_numpy(), rows["kind"].to_numpy()
    apart = kind == 0  # below furniture it is the tree that speaks against content
    weights = _logistic(x[apart], y[apart], start)
    given = []
    for k, unseen in ((0, 5.0), (1, 0.01)):  # content below furniture is all but ruled out
        n = [[((kind == k) & (above == a) & (y == b)).sum() + unseen for b in (0, 1)] for a in (0, 1)]
        given.append([[float(v / sum(row)) for v in row] for row in n])
    return Model(weights, float(np.clip(y[apart].mean(), 0.01, 0.99)), given)


def _logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps; the prior is centred on ``start``."""
    w, pull = start.copy(), 2.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (p - y) + pull * (w - start))
        w = w - np.clip(step, -2, 2)
    return w


def extract(df: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` to the columns of ``df`` other than the page, replacing columns of these names.

    A null or empty page, and one without content, has the text ''. Each row gives one row.
    """
    bounded(df.sparkSession)

    @F.pandas_udf("text string, n_chars long")
    def extracted(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in pages:
            texts = [model.extract(p) for p in batch]
            yield pd.DataFrame({"text": pd.Series(texts, dtype=object), "n_chars": pd.Series([len(t) for t in texts], dtype="int64")})

    made = df.withColumn("_made", extracted(filled(html)))
    return made.select(*[c for c in df.columns if c not in (html, "text", "n_chars")], "_made.text", "_made.n_chars")
