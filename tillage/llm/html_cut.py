"""Operator 3: main text of web pages by minimum cut.

A page is cut into blocks of text at its block-level elements. A classifier gives every block a cost of being called
content and a cost of being called boilerplate; these are the capacities to the two terminals. Neighbours in page order,
and blocks close to each other in the element tree, are joined by edges that cost something when the two sides differ. The
minimum cut, found by maximum flow, is the labelling of least cost; the blocks on the source side are the main text.

The classifier is a logistic regression on the shape of blocks (length, links, sentences, place), fitted on a bounded sample of
pages (``SAMPLE_PAGES``) whose semantic elements label their blocks, plus fixed costs for what elements and their names say
(navigation, forms, adverts, comments, article).

Scale: pages are independent, so extraction is a narrow pass; its working set is one page.
"""
from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.shared import arrow_batches

SAMPLE_PAGES = 400
SAMPLE_BLOCKS = 20_000
SCALE = 100  # capacities are whole hundredths

# Element names by their part in a page.
SKIPPED = frozenset("script style noscript template iframe head title select option button textarea datalist".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = frozenset("nav footer aside menu dialog header".split())
CONTROLS = frozenset("form fieldset".split())
CONTENT = frozenset("article main".split())
# Elements that an opening tag of the given name closes.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tbody",)}
# Words of class and id names and of roles.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "sidebar side aside widget related recommended popular share social follow subscribe newsletter signup login search cookie cookies consent notice "
    "popup modal overlay comment comments reply replies discussion disqus toolbar pagination pager copyright legal complementary contentinfo "
    "dialog form tags hidden".split())
GOOD_NAMES = frozenset("article content main post entry story body text".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…]")


class Block:
    """A run of text between block-level tags.

    ``inside``: number of the innermost open block element, 0 for none (see ``blocks_of``). ``outside``: below an element that is never main text.
    ``sign``: what the innermost telling element says (1 content, -1 boilerplate, 0 nothing). ``doubt``: whether an element
    further out says boilerplate.
    """
    __slots__ = ("doubt", "heading", "inside", "item", "links", "outside", "raw", "sign", "text")

    def __init__(self, raw, links, inside, outside, sign, doubt, heading, item):
        self.raw, self.links, self.inside, self.outside, self.sign, self.doubt = raw, links, inside, outside, sign, doubt
        self.heading, self.item, self.text = heading, item, ""


def _named(attributes: str) -> tuple[int, bool]:
    """(sign, hidden) of an element's names: 1 content words, -1 boilerplate words, 0 neither or both."""
    bad = good = hidden = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "style":
            value = value.replace(" ", "")
            hidden |= "display:none" in value or "visibility:hidden" in value
        elif name in ("hidden", "aria-hidden"):
            hidden |= name == "hidden" or value == "true"
        else:
            words = _NAME.findall(value)
            bad |= any(w in BAD_NAMES for w in words)
            good |= any(w in GOOD_NAMES for w in words)
    return good - bad, hidden


class Elements:
    """The block elements of a page as a tree of numbers: 0 is the page, ``parent`` and ``depth`` go by number."""

    def __init__(self):
        self.parent, self.depth = [0], [0]

    def below(self, parent: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1

    def apart(self, a: int, b: int) -> int | None:
        """Steps between two elements; None if only the page joins them."""
        steps, parent, depth = 0, self.parent, self.depth
        while a != b:
            if depth[a] < depth[b]:
                a, b = b, a
            a, steps = parent[a], steps + 1
        return steps if a else None


class Stack:
    """The open elements, each with what holds below it, and the places of every name among them."""

    def __init__(self):
        # name, innermost block element and its name, outside, sign, doubt, skipped, in a link
        self.open: list[tuple] = [("", 0, "", False, 0, False, False, False)]
        self.places: dict[str, list[int]] = {}

    def push(self, entry: tuple) -> None:
        self.places.setdefault(entry[0], []).append(len(self.open))
        self.open.append(entry)

    def last(self, *names: str) -> int:
        """Place of the innermost open element with one of the names, 0 if none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all within."""
        while len(self.open) > place:
            self.places[self.open.pop()[0]].pop()


def blocks_of(page: str) -> tuple[list[Block], Elements]:
    """Blocks of a page with text, in page order, character references decoded and white space joined; and its block elements.

    The time is linear in the page, however deep its elements are nested.
    """
    out: list[Block] = []
    elements, stack = Elements(), Stack()
    text, linked = [], 0

    def flush():
        nonlocal text, linked
        if text:
            raw = "".join(text)
            if raw.strip():
                _, inside, inner, outside, sign, doubt, _, _ = stack.open[-1]
                out.append(Block(raw, linked, inside, outside, sign, doubt, inner in ("h1", "h2", "h3", "h4", "h5", "h6"),
                                 inner in ("li", "dt", "dd", "td", "th")))
            text, linked = [], 0

    def take(raw):
        nonlocal linked
        if raw and not stack.open[-1][6]:
            text.append(raw)
            if stack.open[-1][7]:
                linked += len(raw)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            take(page[at:])
            break
        if m.start() > at:
            take(page[at:m.start()])
        at = m.end()
        if m[2] is None:  # a comment or declaration
            continue
        name = m[2].lower()
        if m[1]:
            k = stack.last(name)
            if k:
                # The text so far belongs to the elements that close now.
                if any(e[0] in BLOCKS for e in stack.open[k:]):
                    flush()
                stack.close(k)
            elif name in BLOCKS:
                flush()
            continue
        if name in BLOCKS:
            flush()
            if name not in ("br", "hr"):
                k = stack.last("p")
                if k > stack.last("button", "td", "th", "caption", "object"):
                    stack.close(k)
            for closed in CLOSES.get(name, ()):
                k = stack.last(closed)
                if k > stack.last("ul", "ol", "dl", "table"):
                    stack.close(k)
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        _, inside, inner, outside, sign, doubt, skipped, link = stack.open[-1]
        if name in BLOCKS:
            inside, inner = elements.below(inside), name
        says, hidden = _named(m[3]) if m[3] and name not in ("html", "body") else (0, False)
        if name in CONTENT:
            says = 1 if says >= 0 else -1
        elif name in CONTROLS:
            says = -1
        elif name in BOILERPLATE and not (name == "header" and sign > 0):  # an article's own header belongs to it
            outside, says = True, -1
        if says:
            doubt, sign = doubt or sign < 0, says
        stack.push((name, inside, inner, outside, sign, doubt, skipped or hidden or name in SKIPPED, link or name == "a"))
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
            at = close.start() if close else end
    flush()
    for b in out:
        b.text = _SPACE.sub(" ", unescape(b.raw)).strip()
    return [b for b in out if b.text], elements


N_SHAPE = 9
# Weights of the shapes (in the order of ``shapes``) for a table whose elements label no block: long blocks of sentences
# are content, links are not.
PRIOR = (0.6, -4.0, 0.6, 0.3, -0.5, 0.0, 0.1, 0.1, -1.0)


def shapes(blocks: list[Block]) -> np.ndarray:
    """Features of the shape of blocks; the last is the constant 1."""
    n = len(blocks)
    words = np.array([b.text.count(" ") + 1 for b in blocks], dtype=np.float64)
    link = np.array([min(1.0, b.links / max(1, len(b.raw))) for b in blocks])
    sentences = np.array([len(_SENTENCE.findall(b.text)) for b in blocks], dtype=np.float64)
    x = np.zeros((n, N_SHAPE))
    x[:, 0] = np.log1p(words)
    x[:, 1] = link
    x[:, 2] = np.log1p(sentences)
    x[:, 3] = [b.heading for b in blocks]
    x[:, 4] = [b.item for b in blocks]
    x[:, 5] = np.arange(n) / max(1, n - 1)
    x[:, 6] = np.r_[0, np.log1p(words[:-1])]
    x[:, 7] = np.r_[np.log1p(words[1:]), 0]
    x[:, 8] = 1
    return x


def weak_label(b: Block) -> int:
    """What the page's own elements say: 1 content, 0 boilerplate, -1 nothing clear."""
    if b.outside or b.sign < 0:
        return 0
    return 1 if b.sign > 0 and not b.doubt else -1


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; ``PRIOR`` if a class is missing."""
    if len(y) == 0 or y.min() == y.max():
        return np.array(PRIOR)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return w


# Costs in log-odds. An element's own word outweighs the shape of its blocks.
ELEMENT_COST, OUTSIDE_COST, SHAPE_LIMIT = 4.0, 4.0, 2.5
ORDER_EDGE, TREE_EDGE = 0.4, 0.8


def element_odds(b: Block) -> float:
    """Log-odds of content from a block's elements alone."""
    if b.outside:
        return -ELEMENT_COST - OUTSIDE_COST
    if b.sign > 0:
        return 0.0 if b.doubt else ELEMENT_COST
    return -ELEMENT_COST if b.sign < 0 else 0.0


def label_blocks(blocks: list[Block], elements: Elements, weights: np.ndarray) -> list[bool]:
    """Whether each block is content, by minimum cut."""
    n = len(blocks)
    if not n:
        return []
    odds = np.clip(shapes(blocks) @ weights, -SHAPE_LIMIT, SHAPE_LIMIT)
    flow = MaxFlow(n + 2)
    for k, b in enumerate(blocks):
        value = odds[k] + element_odds(b)
        capacity = round(abs(value) * SCALE)
        if value > 0:
            flow.edge(n, k, capacity, 0)
        else:
            flow.edge(k, n + 1, capacity, 0)
    last_below: dict[int, int] = {}  # last block whose innermost element is a child of that element
    for k, b in enumerate(blocks):
        near = {}
        if k:
            # Of all earlier blocks the one before is nearest in the tree: any element open then and now holds it.
            near[k - 1] = elements.apart(blocks[k - 1].inside, b.inside)
            flow.edge(k - 1, k, round(ORDER_EDGE * SCALE), round(ORDER_EDGE * SCALE))
        above = elements.parent[b.inside]
        if above:
            sibling = last_below.get(above)
            if sibling is not None and sibling != k - 1:  # a brother element, with others in between
                near[sibling] = 2 if blocks[sibling].inside != b.inside else 0
            last_below[above] = k
        for other, apart in near.items():
            cost = 0 if apart is None else round(TREE_EDGE * SCALE / (1 + apart))
            if cost:
                flow.edge(other, k, cost, cost)
    content = flow.source_side(n, n + 1)
    return [content[k] for k in range(n)]


class MaxFlow:
    """Maximum flow by shortest augmenting levels; capacities in both directions of an edge."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, forward: int, back: int) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.room.append(forward)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def _levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Nodes on the source's side of a minimum cut."""
        to, room, out = self.to, self.room, self.out
        while True:
            level = self._levels(source)
            if level[sink] < 0:
                return [x >= 0 for x in level]
            turn = [0] * len(out)
            path: list[int] = []  # edges from the source to the current node
            node = source
            while True:
                if node == sink:
                    least = min(room[e] for e in path)
                    back = len(path)
                    for k, e in enumerate(path):
                        room[e] -= least
                        room[e ^ 1] += least
                        if not room[e] and k < back:
                            back = k
                    node = to[path[back] ^ 1]
                    del path[back:]
                    continue
                while turn[node] < len(out[node]):
                    e = out[node][turn[node]]
                    if room[e] and level[to[e]] == level[node] + 1:
                        break
                    turn[node] += 1
                else:
                    if node == source:
                        break
                    e = path.pop()
                    node = to[e ^ 1]
                    turn[node] += 1
                    continue
                path.append(e)
                node = to[e]


def main_text(page: str | None, weights: np.ndarray) -> str:
    """Main text of a page: its content blocks in page order, joined by a space."""
    blocks, elements = blocks_of(page or "")
    return " ".join(b.text for b, content in zip(blocks, label_blocks(blocks, elements, weights), strict=True) if content)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, number of the block, shape, label) of the labelled blocks."""
    for b in batches:
        places, at, rows, labels = [], [], [], []
        for place, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            blocks, _ = blocks_of(page or "")
            if blocks:
                for k, (x, block) in enumerate(zip(shapes(blocks).tolist(), blocks, strict=True)):
                    y = weak_label(block)
                    if y >= 0:
                        places.append(place)
                        at.append(k)
                        rows.append(x)
                        labels.append(y)
        yield pa.record_batch([pa.array(places, pa.int64()), pa.array(at, pa.int32()), pa.array(rows, pa.list_(pa.float64())),
                               pa.array(labels, pa.int32())], names=["place", "at", "x", "y"])


def fit_shape(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_blocks: int = SAMPLE_BLOCKS, id_col: str = "page_id",
              html_col: str = "html") -> np.ndarray:
    """Shape weights from the ``sample_pages`` pages with the smallest hashes of their ids, of which at most ``sample_blocks``
    blocks (the first in that order) reach the driver."""
    arrow_batches(pages.sparkSession)
    place = F.xxhash64(id_col)
    last = pages.select(place.alias("place")).distinct().orderBy("place").limit(sample_pages).agg(F.max("place")).first()[0]
    if last is None:
        return np.array(PRIOR)
    # Of rows that repeat an id the page with the smallest hash, so that the sample does not depend on partitions.
    sample = pages.select(place.alias("place"), F.col(html_col).alias("html")).where(F.col("place") <= F.lit(last)).groupBy("place").agg(
        F.min_by("html", F.struct(F.xxhash64("html"), F.col("html"))).alias("html"))
    rows = sample.mapInArrow(_examples, "place long, at int, x array<double>, y int").orderBy("place", "at").limit(sample_blocks).collect()
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(-1, N_SHAPE)
    return fit_logistic(x, np.array([r["y"] for r in rows], dtype=np.float64))


def _extract(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = [main_text(page, weights) for page in b.column(2).to_pylist()]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                              names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    A null page is empty and has an empty text, as has a page without content. Repeated rows give repeated rows, null ids and
    urls stay null. An empty table gives an empty result; other columns are ignored.
    """
    arrow_batches(pages.sparkSession)
    weights = fit_shape(pages, sample_pages)
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(
        lambda b: _extract(b, weights), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
