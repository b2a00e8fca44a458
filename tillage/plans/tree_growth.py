"""Growing regression trees over binned features, in steps that can be added up over blocks of rows.

A block holds rows as bin codes, targets and weights. ``Boosting`` is a machine that alternates between asking for a
measurement (sums per node and bin, or the distribution of residuals per leaf) and taking in its total. What measures a block does not
know about other blocks, so the same machine runs over the blocks of one task or over a table of blocks, one job a
measurement; the trees are the same up to the order of floating-point sums.

``grow_deep`` grows one tree of a forest on the rows of one task; of least squares with all features tried, ``grow_squares`` does.
"""
from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

LEAF = -1
EPS = 1e-12
CELLS = 1 << 21
BY_NODES = 1 << 16
JOINED = 1 << 12
COMBINATIONS = 64
CACHED = 1 << 15  # rows whose columns stay in a core's cache


@dataclass
class Tree:
    """Nodes of a tree: split feature (-1: leaf), last bin that goes left, children, value. Node 0 is the root."""
    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)
    steps: np.ndarray | None = field(default=None, repr=False, compare=False)  # of a finished tree: see predict

    def add(self, value: float) -> int:
        for column, x in ((self.feature, LEAF), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, value)):
            column.append(x)
        return len(self.feature) - 1

    def split(self, at: int, feature: int, cut: int, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[at], self.cut[at] = feature, cut
        self.left[at], self.right[at] = self.add(values[0]), self.add(values[1])
        return self.left[at], self.right[at]

    def leaves(self, bins: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Number of the node that each row ends in, going on from the nodes ``start`` if given."""
        feature, cut, left, right = (np.asarray(x) for x in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(bins), dtype=np.int64) if start is None else start.copy()
        going = np.flatnonzero(feature[at] != LEAF)
        while len(going):
            here = at[going]
            here = np.where(bins[going, feature[here]] > cut[here], right[here], left[here])
            at[going] = here
            going = going[feature[here] != LEAF]
        return at

    def for_scoring(self) -> Tree:
        """A finished tree with what ``predict`` needs alone."""
        self.predict(np.zeros((0, 1), dtype="u1"))
        return Tree(value=np.asarray(self.value), steps=self.steps)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """Values of a finished tree. A node is one number: left child, feature, cut; a leaf is its own left child, with a cut above
        every code, so that rows need not be told apart at each step."""
        if self.steps is None:
            feature, cut, left = (np.asarray(x, dtype=np.int64) for x in (self.feature, self.cut, self.left))
            leaf = feature == LEAF
            self.steps = np.where(leaf, np.arange(len(leaf)), left) << 24 | np.where(leaf, 0, feature) << 8 | np.where(leaf, 255, cut)
        codes, row = np.ascontiguousarray(bins).reshape(-1), np.arange(len(bins)) * bins.shape[1]
        at, out, rows, n = np.zeros(len(bins), dtype=np.int64), None, None, 0
        while len(at):
            step = self.steps[at]
            new, n = (step >> 24) + (codes[row + (step >> 8 & 0xFFFF)] > (step & 255)), n + 1
            if n % 3:
                at = new
                continue
            moved = new != at  # now and then, rows in leaves are left out
            if rows is None:
                out, rows = new, np.flatnonzero(moved)
            else:
                out[rows] = new
                rows = rows[moved]
            at, row = new[moved], row[moved]
        return np.asarray(self.value)[np.zeros(0, dtype=np.int64) if out is None else out]


def bin_sums(bins: np.ndarray, slot: np.ndarray, slots: int, offsets: np.ndarray, sums: list[np.ndarray | None]) -> np.ndarray:
    """Totals of each of ``sums`` (None: of ones) by (slot, bin of each feature): shape (len(sums), slots, all bins)."""
    out = np.empty((len(sums), slots, int(offsets[-1])))
    if len(bins) < 4096:  # few rows: all features in one count
        width = out.shape[2]
        key = ((slot * width)[:, None] + bins + offsets[:-1]).reshape(-1)
        for k, x in enumerate(sums):
            out[k] = np.bincount(key, weights=None if x is None else np.repeat(x, bins.shape[1]), minlength=slots * width).reshape(slots, width)
        return out
    for f in range(bins.shape[1]):
        a, b = int(offsets[f]), int(offsets[f + 1])
        key = slot * (b - a) + bins[:, f]
        for k, x in enumerate(sums):
            out[k, :, a:b] = np.bincount(key, weights=x, minlength=slots * (b - a)).reshape(slots, b - a)
    return out


def best_splits(total: np.ndarray, offsets: np.ndarray, min_leaf: float) -> list[tuple | None]:
    """Per slot the split with the largest gain: (feature, cut, sums left, sums right), None without any.

    ``total`` has the sums of gradients, second derivatives and rows. Ties go to the first feature and bin.
    """
    some = max(1, (1 << 15) // max(total.shape[2], 1))  # slots at a time, so that their sums stay in the cache
    return [x for a in range(0, total.shape[1], some) for x in _best_splits(total[:, a:a + some], offsets, min_leaf)]


def _best_splits(total: np.ndarray, offsets: np.ndarray, min_leaf: float) -> list[tuple | None]:
    running = total.cumsum(axis=2)
    ends = running[:, :, offsets[1:] - 1]
    whole = ends[:, :, :1]
    left = running
    left[:, :, offsets[1]:] -= np.repeat(ends[:, :, :-1], np.diff(offsets)[1:], axis=2)
    right = whole - left
    allowed = (left[2] >= min_leaf) & (right[2] >= min_leaf) & (left[1] > EPS) & (right[1] > EPS)
    if not allowed.any():
        return [None] * total.shape[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1]
    gain = np.where(allowed, gain - whole[0] ** 2 / np.maximum(whole[1], EPS), -np.inf)
    at = gain.argmax(axis=1)
    out: list[tuple | None] = []
    for s, k in enumerate(at.tolist()):
        f = int(np.searchsorted(offsets, k, side="right")) - 1
        found = gain[s, k] > 1e-9 * (1 + abs(whole[0, s, 0] ** 2 / max(whole[1, s, 0], EPS)))
        out.append((f, k - int(offsets[f]), left[:, s, k], right[:, s, k]) if found else None)
    return out


def residual_cells(x: np.ndarray) -> np.ndarray:
    """Order-preserving cells of numbers, one per 2,048 steps of every power of two."""
    bits = np.ascontiguousarray(x, dtype=np.float32).view(np.int32).astype(np.int64)
    return np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) >> 12


def cell_value(cell: np.ndarray) -> np.ndarray:
    middle = (np.asarray(cell, dtype=np.int64) << 12) + (1 << 11)
    size = np.abs(middle).astype(np.int32).view(np.float32).astype(np.float64)
    return np.where(middle < 0, -size, size)


@dataclass
class Boosting:
    """Boosted trees with squared, pinball or softmax loss. ``classes`` trees a round for softmax, else one."""
    offsets: np.ndarray
    loss: str = "squared"
    rounds: int = 500
    rate: float = 0.06
    depth: int = 5
    min_leaf: int = 20
    alpha: float = 0.5
    classes: int = 1
    base: np.ndarray | None = None
    trees: list = field(default_factory=list)   # finished rounds: lists of trees, one a class
    growing: list = field(default_factory=list)
    open: list = field(default_factory=list)    # (tree of the round, node) that may be split next
    asked: list = field(default_factory=list)   # those of them that the next measurement is about
    leafing: bool = False

    def done(self) -> bool:
        return len(self.trees) >= self.rounds

    def scores(self, bins: np.ndarray, since: int = 0, start: np.ndarray | None = None) -> np.ndarray:
        """Raw predictions (rows, classes) after the finished rounds, from ``start`` after ``since`` of them."""
        out = np.tile(self.base, (len(bins), 1)) if start is None else start.copy()
        for step in self.trees[since:]:
            for k, tree in enumerate(step):
                out[:, k] += tree.predict(bins)
        return out

    def gradients(self, y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """First and second derivatives of the loss; None: ones."""
        if self.loss == "squared":
            return raw - y[:, None], None
        if self.loss == "pinball":
            return np.where(y[:, None] > raw, -self.alpha, 1.0 - self.alpha), None
        p = np.exp(raw - raw.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p - (y[:, None] == np.arange(self.classes)), np.maximum(p * (1 - p), 1e-16)

    def for_tasks(self, since: int) -> Boosting:
        """The machine as tasks need it that hold the scores after ``since`` rounds: without those trees and without sums."""
        return replace(self, trees=[None] * since + self.trees[since:])

    def measure(self, bins: np.ndarray, y: np.ndarray, w: np.ndarray, raw: np.ndarray | None,
                at: list[np.ndarray] | None = None) -> tuple[str, np.ndarray]:
        """What the machine asks for, over the rows of one block; ``raw`` are the scores after the finished rounds.

        ``at`` are the nodes of the rows in the growing trees, if known; every row has a weight then.
        """
        used = w > 0
        if self.base is None:
            if self.loss == "pinball":
                return "cells", self._cells(np.zeros(int(used.sum()), dtype=np.int64), y[used])
            if self.loss == "softmax":
                return "sums", np.bincount(y[used].astype(np.int64), minlength=self.classes).astype(float)
            return "sums", np.array([y[used].sum(), used.sum()])
        if not used.all():
            bins, y, raw = bins[used], y[used], raw[used]
        if self.leafing:
            return "cells", self._cells(self.growing[0].leaves(bins) if at is None else at[0], y - raw[:, 0])
        g, h = self.gradients(y, raw)
        kinds = 2 if h is None else 3
        total = np.zeros((kinds, len(self.asked), int(self.offsets[-1])))
        for k, tree in enumerate(self.growing):
            mine = [s for s, (t, _) in enumerate(self.asked) if t == k]
            if mine:
                slot_of = np.full(len(tree.feature), -1, dtype=np.int64)
                slot_of[[self.asked[s][1] for s in mine]] = np.arange(len(mine))
                slot = slot_of[tree.leaves(bins) if at is None else at[k]]
                rows = np.flatnonzero(slot >= 0)
                sums = [g[rows, k], None] if h is None else [g[rows, k], h[rows, k], None]
                total[:, mine] = bin_sums(bins[rows] if len(rows) < len(bins) else bins, slot[rows], len(mine), self.offsets, sums)
        return "sums", total

    @staticmethod
    def _cells(leaf: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Counts per (leaf, cell), the two packed into one sorted number."""
        return np.stack(np.unique(leaf * CELLS + residual_cells(x) + CELLS // 2, return_counts=True))

    @staticmethod
    def join(kind: str, a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
        """Total of two measurements."""
        if a is None:
            return b
        if kind == "sums":
            return a + b
        both = np.concatenate([a, b], axis=1)
        pairs, at = np.unique(both[0], return_inverse=True)
        return np.stack([pairs, np.bincount(at, weights=both[1], minlength=len(pairs)).astype(np.int64)])

    def advance(self, total: np.ndarray) -> None:
        """Take in the total of what was asked for."""
        if self.base is None:
            if self.loss == "pinball":
                self.base = np.array([self._quantiles(total).get(0, 0.0)])
            elif self.loss == "softmax":
                share = np.maximum(total, EPS) / max(total.sum(), EPS)
                self.base = np.log(share) - np.log(share).mean()
            else:
                self.base = np.array([total[0] / max(total[1], 1.0)])
            self._next_round()
        elif self.leafing:
            values = self._quantiles(total)
            tree = self.growing[0]
            tree.value = [self.rate * values.get(k, 0.0) for k in range(len(tree.value))]
            self._finish()
        else:
            total = self._with_siblings(total)
            splits, opened = best_splits(total if len(total) == 3 else total[[0, 1, 1]], self.offsets, self.min_leaf), []
            self.measured = {node: total[:, s] for s, node in enumerate(self.open)}
            for (k, node), found in zip(self.open, splits, strict=True):
                if found is not None:
                    f, cut, left, right = found
                    value = tuple(float(-self.rate * s[0] / s[1]) for s in (left, right))
                    children = self.growing[k].split(node, f, cut, value)
                    if max(left[2], right[2]) >= 2 * self.min_leaf:  # a node of fewer rows has no further split
                        opened += [(k, child) for child in children]
            self.level += 1
            self._ask(opened)
            if self.level == self.depth or not opened:
                if self.loss == "pinball":
                    self.leafing = True
                else:
                    self._finish()

    def _quantiles(self, cells: np.ndarray) -> dict[int, float]:
        """The alpha quantile per leaf."""
        leaves, out = cells[0] // CELLS, {}
        bounds = np.flatnonzero(np.diff(leaves, prepend=-1, append=-1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            upto = cells[1, a:b].cumsum()
            at = a + int(np.searchsorted(upto, self.alpha * upto[-1]))
            out[int(leaves[a])] = float(cell_value(cells[0, at] % CELLS - CELLS // 2))
        return out

    def _finish(self) -> None:
        self.trees.append(self.growing)
        if not self.done():
            self._next_round()

    def _next_round(self) -> None:
        self.leafing, self.level = False, 0
        self.growing = [Tree() for _ in range(self.classes)]
        self.measured = {}
        self._ask([(k, tree.add(0.0)) for k, tree in enumerate(self.growing)])

    def _ask(self, opened: list) -> None:
        """The next measurement is about ``opened``: of two siblings only the one with fewer rows, their parent is known."""
        self.open, self.parent_of = opened, {}
        for a, b in zip(opened[::2], opened[1::2], strict=False):
            if a[1] > 0:
                tree = self.growing[a[0]]
                parent = tree.left.index(a[1], 0)
                rows = self.measured[(a[0], parent)][-1]
                f = tree.feature[parent]
                start, stop = int(self.offsets[f]), int(self.offsets[f + 1])
                few = a if rows[start:start + tree.cut[parent] + 1].sum() <= rows[start:stop].sum() / 2 else b
                self.parent_of[few] = (a[0], parent)
        self.asked = [x for x in opened if x in self.parent_of or x[1] == 0]

    def _with_siblings(self, total: np.ndarray) -> np.ndarray:
        """Sums of all open nodes from those that were asked for."""
        known = {x: total[:, s] for s, x in enumerate(self.asked)}
        for x, parent in self.parent_of.items():
            a = self.growing[parent[0]].left[parent[1]]
            sibling = (x[0], a + 1 if x[1] == a else a)
            known[sibling] = self.measured[parent] - known[x]
        return np.stack([known[x] for x in self.open], axis=1)


class JoinedBins:
    """Codes of several features as one number each, so that one count of them gives the sums of every feature.

    Features share a number while its values that occur are at most ``JOINED``; the numbers are dense.
    """

    def __init__(self, bins: np.ndarray, offsets: np.ndarray):
        self.bins, self.offsets, self.groups = bins, offsets, []
        widths = np.diff(offsets)
        for f in np.argsort(widths, kind="stable").tolist():
            width, column = int(widths[f]), bins[:, f].astype(np.int64)
            if self.groups:
                features, code, parts = self.groups[-1]
                if len(parts) * width <= 4 * JOINED:
                    pair = code * width + column
                    there = np.flatnonzero(np.bincount(pair, minlength=len(parts) * width))
                    if len(there) <= JOINED:
                        place = np.zeros(len(parts) * width, dtype=np.int64)
                        place[there] = np.arange(len(there))
                        self.groups[-1] = ([*features, f], place[pair], np.hstack([parts[there // width], (there % width)[:, None]]))
                        continue
            self.groups.append(([f], column, np.arange(width)[:, None]))
        self.groups = [(features, code.astype(np.uint16), parts) for features, code, parts in self.groups]  # small, as they are read at random
        # Which of a group's numbers belong to which bin of its features.
        self.spread = []
        for features, _, parts in self.groups:
            self.spread.append([(f, None if len(features) == 1 else (parts[:, k, None] == np.arange(int(widths[f]))).astype(float))
                                for k, f in enumerate(features)])

    def sums(self, rows: np.ndarray | None, sums: list[np.ndarray | None]) -> np.ndarray:
        """bin_sums of some rows (None: all) in one slot: shape (len(sums), all bins). ``sums`` are those of these rows."""
        if rows is not None and len(rows) < 4096:
            return bin_sums(self.bins[rows], np.zeros(len(rows), dtype=np.int64), 1, self.offsets, sums)[:, 0]
        out = np.empty((len(sums), int(self.offsets[-1])))
        for (_, code, parts), spread in zip(self.groups, self.spread, strict=True):
            here = (code if rows is None else code.take(rows)).astype(np.int64)
            found = np.stack([np.bincount(here, weights=x, minlength=len(parts)) for x in sums])
            for f, indicator in spread:
                out[:, int(self.offsets[f]):int(self.offsets[f + 1])] = found if indicator is None else found @ indicator
        return out


def boost_here(model: Boosting, bins: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosting:
    """Run the machine over rows that are all here. Rows step down one level a measurement, their scores once a round."""
    used = w > 0
    bins, y, w = np.asfortranarray(bins[used]), y[used], w[used]
    if len(bins) >= BY_NODES:
        return _boost_by_nodes(model, bins, y, w)
    raw, at = None, []
    while not model.done():
        if model.base is None:
            model.advance(model.measure(bins, y, w, None)[1])
            continue
        if raw is None:
            raw = model.scores(bins)
        growing, finished = model.growing, len(model.trees)
        at = [tree.leaves(bins, nodes) for tree, nodes in zip(growing, at or [None] * len(growing), strict=True)]
        model.advance(model.measure(bins, y, w, raw, at)[1])
        if len(model.trees) > finished:
            for k, tree in enumerate(growing):
                raw[:, k] += np.asarray(tree.value)[tree.leaves(bins, at[k])]
            at = []
    return model


def _boost_by_nodes(model: Boosting, bins: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosting:
    """The same for many rows: every node has the list of its rows, so that what is asked for a node touches these alone."""
    if model.base is None and not model.done():
        model.advance(model.measure(bins, y, w, None)[1])
    if model.done():
        return model
    joined, raw = JoinedBins(bins, model.offsets), model.scores(bins)
    while not model.done():
        growing = model.growing
        wanted = [None if x is None else np.asfortranarray(x) for x in model.gradients(y, raw)]
        rows_of = _grow_round(model, joined, bins, y, w, raw, [x for x in wanted if x is not None] + [None])
        for k, (tree, mine) in enumerate(zip(growing, rows_of, strict=True)):
            for node, rows in mine.items():
                raw[slice(None) if rows is None else rows, k] += tree.value[node]
    return model


def _grow_round(model: Boosting, joined: JoinedBins, bins: np.ndarray, y: np.ndarray, w: np.ndarray, raw: np.ndarray | None, wanted: list) -> list[dict]:
    """The trees of one round from the derivatives ``wanted`` (rows, trees); per tree the rows of every leaf (None: all rows)."""
    growing, finished, rows_of = model.growing, len(model.trees), [{0: None} for _ in model.growing]
    while len(model.trees) == finished:
        if model.leafing:
            at = np.zeros(len(bins), dtype=np.int64)
            for node, rows in rows_of[0].items():
                at[slice(None) if rows is None else rows] = node
            model.advance(model.measure(bins, y, w, raw, [at])[1])
            continue
        total = np.zeros((len(wanted), len(model.asked), int(model.offsets[-1])))
        for s, (k, node) in enumerate(model.asked):
            rows = rows_of[k][node]
            total[:, s] = joined.sums(rows, [x if x is None else x[:, k] if rows is None else x[:, k].take(rows) for x in wanted])
        model.advance(total)
        for tree, mine in zip(growing, rows_of, strict=True):
            for node in [x for x in mine if tree.feature[x] != LEAF]:
                rows, column = mine.pop(node), bins[:, tree.feature[node]]
                right = (column if rows is None else column.take(rows)) > tree.cut[node]
                for child, side in ((tree.left[node], ~right), (tree.right[node], right)):
                    at = np.flatnonzero(side)  # with take faster than a mask
                    mine[child] = at if rows is None else rows.take(at)
    return rows_of


def grow_class(model: Boosting, joined: JoinedBins, bins: np.ndarray, y: np.ndarray, raw: np.ndarray, k: int) -> tuple[Tree, np.ndarray]:
    """The next tree of class ``k`` of a softmax model over rows that are all here, and the class's scores with it."""
    one = replace(model, classes=1, rounds=1, base=np.zeros(1), trees=[], growing=[], open=[], asked=[])
    one._next_round()
    wanted = [np.ascontiguousarray(x[:, k])[:, None] for x in model.gradients(y, raw)]
    mine, = _grow_round(one, joined, bins, y, np.ones(len(y)), None, [*wanted, None])
    tree, score = one.trees[0][0], raw[:, k].copy()
    for node, rows in mine.items():
        score[slice(None) if rows is None else rows] += tree.value[node]
    return tree, score


def _put(levels: list[np.ndarray], nodes: np.ndarray, x: np.ndarray) -> None:
    """Set values of nodes of the last level, given by their numbers in the tree."""
    levels[-1][nodes - sum(len(v) for v in levels[:-1])] = x


def _flag_gains(flags: np.ndarray, starts: np.ndarray, weight: np.ndarray, w: np.ndarray, sums: list[np.ndarray],
                weighted: list[np.ndarray]) -> np.ndarray:
    """Per slot and feature of two bins the value of the feature's only cut (-inf: a side is empty).

    ``flags`` (rows, features) are 1 on the left side; the rows are in order of their slots, which begin at ``starts``.
    """
    total = lambda x: np.add.reduceat(flags * x[:, None], starts, axis=0)
    wl = total(w)
    gain, wr = np.zeros(wl.shape), weight[:, None] - wl
    with np.errstate(divide="ignore", invalid="ignore"):
        for x, whole in zip(weighted, sums, strict=True):
            tl = total(x)
            gain += tl * tl / wl + (whole[:, None] - tl) ** 2 / wr
    gain[(wl < 0.5) | (wr < 0.5)] = -np.inf
    return gain


def _joined_flags(columns: list[np.ndarray], flags: list[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """One number a row for the values of some features of two bins, which numbers are on the left of each feature, and the features."""
    code, left, used = np.zeros(len(columns[0]) if columns else 0, dtype=np.int64), np.zeros((1, 0)), []
    for f in flags:
        pair = code * 2 + columns[f]
        there = np.flatnonzero(np.bincount(pair, minlength=2 * len(left)))
        if len(there) > COMBINATIONS:
            continue
        place = np.zeros(2 * len(left), dtype=np.int64)
        place[there] = np.arange(len(there))
        code, left = place[pair], np.hstack([left[there // 2], (there % 2 == 0)[:, None]])
        used.append(f)
    return code, left, used


def grow_squares(bins: np.ndarray, offsets: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int) -> Tree:
    """One least-squares tree of a forest on rows with whole weights ``w``, all features tried, leaves of one row allowed.

    The tree of grow_deep up to ties and the numbers of its nodes. Of many rows the upper levels are grown first, then the rest node by node,
    so that the rows of a node stay in the cache.
    """
    rows = np.flatnonzero(w > 0)
    levels = min(max(len(rows) // CACHED, 1).bit_length() - 1, depth)
    if not levels:
        return _grow_squares(bins, offsets, y, w, depth)
    bins, y, w = bins[rows], y[rows], w[rows]
    top = _grow_squares(bins, offsets, y, w, levels)
    level = np.zeros(len(top.feature), dtype=np.int64)
    for v in np.flatnonzero(top.feature != LEAF):  # a node comes before its children
        level[[top.left[v], top.right[v]]] = level[v] + 1
    leaf = top.leaves(bins)
    by = leaf.argsort(kind="stable")
    ends = np.bincount(leaf, minlength=len(level)).cumsum()
    columns, n = [[x] for x in (top.feature, top.cut, top.left, top.value)], len(level)
    for v in np.flatnonzero((top.feature == LEAF) & (level == levels)).tolist():
        mine = by[ends[v - 1] if v else 0:ends[v]]
        rest = grow_squares(bins[mine], offsets, y[mine], w[mine], depth - levels)
        at = np.where(rest.left > 0, rest.left + n - 1, 0)
        top.feature[v], top.cut[v], top.left[v], top.value[v] = rest.feature[0], rest.cut[0], at[0], rest.value[0]
        for column, x in zip(columns, (rest.feature, rest.cut, at, rest.value), strict=True):
            column.append(x[1:])
        n += len(at) - 1
    feature, cut, left, value = (np.concatenate(x) for x in columns)
    return Tree(feature, cut, left, np.where(left > 0, left + 1, 0), value)


def _grow_squares(bins: np.ndarray, offsets: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int) -> Tree:
    """grow_squares level by level. Targets are kept less their node's mean, so that running sums over the rows of all nodes are zero
    where a node begins, and a cut is worth (sum left)^2 / (weight left * weight right)."""
    widths, rows = np.diff(offsets).tolist(), np.flatnonzero(w > 0)
    # Codes by place, to tell a row's side of any feature's cut.
    codes, place_in = np.ascontiguousarray(bins).reshape(-1), rows * bins.shape[1]
    columns = [np.ascontiguousarray(bins[rows, f]).astype(np.int64) for f in range(bins.shape[1])]
    w = w[rows].astype(float)
    mean = float((y[rows] * w).sum() / max(w.sum(), EPS))
    target = y[rows] - mean
    code, on_left, flags = _joined_flags(columns, [f for f, n in enumerate(widths) if n == 2])
    others = [f for f in range(len(columns)) if f not in flags]
    for f in flags:  # their one number says it all
        columns[f] = columns[f][:0]
    feature, cut, left, value = [np.array([LEAF])], [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], [np.array([mean])]
    # Rows are kept in the order of their slots; ``order`` has them by (slot, bin) for the features that have too few rows for a count a bin.
    slot, nodes, means, n_nodes, order = np.zeros(len(rows), dtype=np.int64), np.zeros(1, dtype=np.int64), np.array([mean]), 1, {}
    for _ in range(depth):
        n, n_slots = len(slot), len(nodes)
        if not n or not n_slots:
            break
        weight, counts = np.bincount(slot, weights=w, minlength=n_slots), np.bincount(slot, minlength=n_slots)
        wt, starts = w * target, counts.cumsum() - counts
        gains, kept, inner = np.full((len(columns), n_slots), -1.0), {}, None

        def counted(key: np.ndarray, width: int, take) -> np.ndarray:
            wl, tl = (take(np.bincount(key, weights=x, minlength=n_slots * width).reshape(n_slots, width)) for x in (w, wt))  # noqa: B023
            wr = weight[:, None] - wl  # noqa: B023
            gain = tl * tl / (wl * wr)
            gain[(wl < 0.5) | (wr < 0.5)] = -1
            return gain

        with np.errstate(divide="ignore", invalid="ignore"):
            if flags:
                gains[flags] = counted(slot * len(on_left) + code, len(on_left), lambda x: x @ on_left).T
            for f in others:
                width = widths[f]
                if f not in order and n_slots * width <= n // 2:
                    kept[f] = counted(slot * width + columns[f], width, lambda x: x.cumsum(axis=1))
                    gains[f] = kept[f].max(axis=1)
                    continue
                if f not in order:
                    shift = max(n - 1, 1).bit_length()
                    order[f] = np.sort((slot * width + columns[f]) << shift | np.arange(n)) & ((1 << shift) - 1)
                if inner is None:
                    inner, whole, before = slot[1:] == slot[:-1], np.repeat(weight, counts), np.repeat(weight.cumsum() - weight, counts)
                    both = np.empty(n, dtype=complex)  # two sums in one pass
                    both.real, both.imag = w, wt
                at = columns[f][order[f]]
                run = both[order[f]].cumsum()
                wl = run.real - before
                gain = run.imag * run.imag / (wl * (whole - wl))
                np.copyto(gain[:-1], -1.0, where=~(inner & (at[1:] != at[:-1])))  # only where a bin ends inside a node
                gain[-1] = -1.0
                kept[f], gains[f] = gain, np.maximum.reduceat(gain, starts)
        cut_f, cut_b = gains.argmax(axis=0), np.zeros(n_slots, dtype=np.int64)
        best = gains[cut_f, np.arange(n_slots)]
        splits = best * weight > 1e-9 * (1 + weight * means ** 2)
        if not splits.any():
            break
        for f, gain in kept.items():
            mine = splits & (cut_f == f)
            if gain.ndim == 2:
                cut_b[mine] = gain[mine].argmax(axis=1)
            elif mine.any():  # the first place with the largest gain
                hit = np.flatnonzero(gain == np.repeat(np.where(mine, best, np.inf), counts))
                hit = hit[np.diff(slot[hit], prepend=-1) != 0]
                cut_b[slot[hit]] = columns[f][order[f][hit]]
        n_new = 2 * int(splits.sum())
        child = np.full((n_slots, 2), -1, dtype=np.int64)
        child[splits] = np.arange(n_new).reshape(-1, 2)
        for level, x in ((feature, cut_f[splits]), (cut, cut_b[splits]), (left, n_nodes + child[splits, 0])):
            _put(level, nodes[splits], x)
        of = child.reshape(-1)[2 * slot + (codes[place_in + cut_f[slot]] > cut_b[slot])]
        going = np.flatnonzero(of >= 0)
        of, mass, target_here = of[going], w[going], target[going]
        weight = np.bincount(of, weights=mass, minlength=n_new)
        step = np.bincount(of, weights=mass * target_here, minlength=n_new) / weight
        target_here = target_here - step[of]
        share = np.repeat(means[splits], 2) + step
        feature.append(np.full(n_new, LEAF))
        cut.append(np.zeros(n_new, dtype=np.int64))
        left.append(np.zeros(n_new, dtype=np.int64))
        value.append(share)
        # Pure nodes and nodes of one row are finished.
        spread = np.bincount(of, weights=mass * target_here * target_here, minlength=n_new) / weight
        alive = (spread > 1e-12 * (1 + share ** 2)) & (weight > 1)
        nodes, means = n_nodes + np.flatnonzero(alive), share[alive]
        n_nodes += n_new
        target[going] = target_here
        last = len(nodes)  # finished rows go to the end
        new = np.full(n, last, dtype=np.uint16 if last < 1 << 16 else np.int64)  # a short number is sorted in one pass
        new[going] = np.where(alive, np.cumsum(alive) - 1, last)[of]
        n_alive = int((new != last).sum())
        by = new.argsort(kind="stable")[:n_alive]
        place = np.empty(n, dtype=np.int64)
        place[by] = np.arange(n_alive)
        order = {f: place[o[new[o].argsort(kind="stable")[:n_alive]]] for f, o in order.items()}
        slot, w, target, code, place_in = new[by].astype(np.int64), w[by], target[by], code[by], place_in[by]
        for f in others:
            columns[f] = columns[f][by]
    at = np.concatenate(left)
    # Arrays, as they are looked up for every block to score.
    return Tree(np.concatenate(feature), np.concatenate(cut), at, np.where(at > 0, at + 1, 0), np.concatenate(value))


def grow_deep(bins: np.ndarray, offsets: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, per_split: int | None = None,
              rng: np.random.Generator | None = None, onehot: np.ndarray | None = None) -> Tree:
    """One tree of a forest on rows with whole weights ``w``: least squares, leaves of one row allowed.

    With ``per_split`` only that many features, drawn per node, are tried. ``onehot`` are class indicators (rows, classes): the
    tree then minimises the Gini impurity, and node values are class shares.
    """
    if onehot is None and per_split is None:
        return grow_squares(bins, offsets, y, w, depth)
    target = y[:, None] if onehot is None else onehot
    tree = Tree()
    feature, cut, left, value = [np.array([LEAF])], [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], []
    rows = np.flatnonzero(w > 0)
    columns = [np.ascontiguousarray(bins[rows, f]).astype(np.int64) for f in range(bins.shape[1])]
    target, w = target[rows].astype(float), w[rows].astype(float)
    n_features, k = len(columns), target.shape[1]
    two = np.flatnonzero(np.diff(offsets) == 2).tolist()  # features of two bins (flags) have one cut: no sort, no running sums
    flags = np.stack([columns[f] == 0 for f in two], axis=1).astype(float) if two else np.zeros((len(rows), 0))
    value.append((target * w[:, None]).sum(axis=0)[None] / max(w.sum(), EPS))
    n_nodes = 1
    # Rows are kept in the order of their slots.
    slot, nodes = np.zeros(len(rows), dtype=np.int64), np.zeros(1, dtype=np.int64)
    for _ in range(depth):
        if not len(nodes):
            break
        n_slots, shift = len(nodes), max(len(slot) - 1, 1).bit_length()
        weight = np.bincount(slot, weights=w, minlength=n_slots)
        weighted = [w * target[:, c] for c in range(k)]
        sums = [np.bincount(slot, weights=x, minlength=n_slots) for x in weighted]
        before = sum(x ** 2 for x in sums) / weight
        best, cut_f, cut_b = np.full(n_slots, -np.inf), np.zeros(n_slots, dtype=np.int64), np.zeros(n_slots, dtype=np.int64)
        tried = None
        if per_split is not None and per_split < n_features:
            tried = rng.random((n_slots, n_features)).argsort(axis=1).argsort(axis=1) < per_split
        starts = np.flatnonzero(np.diff(slot, prepend=-1))
        flag_gain = dict(zip(two, _flag_gains(flags, starts, weight, w, sums, weighted).T, strict=True)) if two else {}
        for at_feature in range(n_features if tried is None else 2 * n_features):
            f = at_feature % n_features
            if at_feature == n_features:  # nodes that the drawn features cannot split try the others
                tried = ~tried & ~(best > 1e-9 * (1 + np.abs(before)))[:, None]
            if f in flag_gain:
                top = flag_gain[f] - before
                better = top > best if tried is None else (top > best) & tried[:, f]
                best[better], cut_f[better], cut_b[better] = top[better], f, 0
                continue
            width = int(offsets[f + 1] - offsets[f])
            mine = slice(None) if tried is None else np.flatnonzero(tried[slot, f])
            key = slot[mine] * width + columns[f][mine]
            if not len(key):
                continue
            dense = n_slots * width <= 2 * len(key)
            if dense:  # sums per (slot, bin)
                at = np.arange(n_slots * width)
                run = [np.bincount(key, weights=x[mine], minlength=len(at)).reshape(n_slots, width).cumsum(axis=1).reshape(-1) for x in (w, *weighted)]
                base = [np.zeros(n_slots)] * (k + 1)
                of = np.repeat(np.arange(n_slots), width)
            else:  # running sums of the rows in order of (slot, bin), at the ends of equal keys
                packed = np.sort(key << shift | np.arange(len(key)))  # faster than an argsort
                order, key = packed & ((1 << shift) - 1), packed >> shift
                ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
                at, of = key[ends], slot[mine][order[ends]]
                run = [x[mine][order].cumsum()[ends] for x in (w, *weighted)]
                there = 1.0 if tried is None else tried[:, f]
                base = [(x * there).cumsum() - x * there for x in (weight, *sums)]
            wl = run[0] - base[0][of]
            wr = weight[of] - wl
            gain = np.zeros(len(of))
            with np.errstate(divide="ignore", invalid="ignore"):
                for c in range(k):
                    tl = run[c + 1] - base[c + 1][of]
                    gain += tl * tl / wl + (sums[c][of] - tl) ** 2 / wr
            gain[(wl < 0.5) | (wr < 0.5)] = -np.inf
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            top = np.maximum.reduceat(gain, first)
            here = of[first]
            better = np.flatnonzero(top - before[here] > best[here])
            if len(better):
                stop = np.append(first[1:], len(of))
                s = here[better]
                best[s], cut_f[s] = top[better] - before[s], f
                # The first bin with the largest gain, looked up only where it counts.
                lengths = stop[better] - first[better]
                span = np.arange(int(lengths.sum())) + np.repeat(first[better] - (lengths.cumsum() - lengths), lengths)
                hit = np.where(gain[span] == np.repeat(top[better], lengths), span, len(of))
                cut_b[s] = at[np.minimum.reduceat(hit, lengths.cumsum() - lengths)] % width
        splits = best > 1e-9 * (1 + np.abs(before))
        if not splits.any():
            break
        child = np.full((n_slots, 2), -1, dtype=np.int64)
        child[splits] = np.arange(2 * int(splits.sum())).reshape(-1, 2)
        for level, x in ((feature, cut_f[splits]), (cut, cut_b[splits]), (left, n_nodes + child[splits, 0])):
            _put(level, nodes[splits], x)
        kept = np.flatnonzero(splits[slot])
        of, side = slot[kept], np.zeros(len(kept), dtype=np.int64)
        on = cut_f[of]
        for f in np.unique(cut_f[splits]).tolist():
            rows = np.flatnonzero(on == f)
            side[rows] = columns[f][kept[rows]] > cut_b[of[rows]]
        of = child[of, side]
        n_new = 2 * int(splits.sum())
        mass = w[kept]
        weight = np.bincount(of, weights=mass, minlength=n_new)
        per_class = [target[kept, c] for c in range(k)]
        share = np.stack([np.bincount(of, weights=mass * x, minlength=n_new) for x in per_class], axis=1) / weight[:, None]
        feature.append(np.full(n_new, LEAF))
        cut.append(np.zeros(n_new, dtype=np.int64))
        left.append(np.zeros(n_new, dtype=np.int64))
        value.append(share)
        # Pure nodes and nodes of one row are finished.
        spread = np.stack([np.bincount(of, weights=mass * x ** 2, minlength=n_new) for x in per_class], axis=1) / weight[:, None] - share ** 2
        alive = (spread.sum(axis=1) > 1e-12 * (1 + (share ** 2).sum(axis=1))) & (weight > 1)
        nodes = n_nodes + np.flatnonzero(alive)
        n_nodes += n_new
        going = np.flatnonzero(alive[of])
        of = (np.cumsum(alive) - 1)[of[going]]
        bits = max(len(of) - 1, 1).bit_length()
        packed = np.sort(of << bits | np.arange(len(of)))
        slot, going = packed >> bits, kept[going[packed & ((1 << bits) - 1)]]
        target, w, flags = target[going], w[going], flags[going]
        columns = [c[going] for c in columns]
    at = np.concatenate(left)
    # Arrays, as they are looked up for every block to score.
    tree.feature, tree.cut, tree.left = np.concatenate(feature), np.concatenate(cut), at
    tree.right = np.where(at > 0, at + 1, 0)
    value = np.concatenate(value)
    tree.value = value[:, 0] if onehot is None else value
    return tree
