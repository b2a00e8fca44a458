"""Forests of more rows than a task holds: each tree on a bootstrap of all its training rows.

Trees are grown some at a time (``ROWS_A_RUN``). The upper nodes of a tree come from sums over all blocks, one job a level for
all trees of the run, until a node's drawn rows are ``PART`` or fewer. Then every row goes to the node that it ends in, and a task a
node grows the rest of the tree on the node's drawn rows and scores the others as they come. Only predictions leave a task; they are
added up run by run, and what a run has written or shuffled is given back before the next.

The bootstrap is that of a single machine: n draws of n rows, dealt to the blocks by a multinomial, and drawn again from its seed
wherever a block is read.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.plans import many_models as MM
from tillage.plans.tree_growth import LEAF, Tree, best_splits, bin_sums, grow_deep
from tillage.session import discard, free_shuffles, written

PART = 1 << 19        # drawn rows that one task grows on
ROWS_A_RUN = 1 << 27  # rows dealt out together
BLOCKS_A_COUNT = 32
GRANULE = 1 << 31


@dataclass
class Top:
    """Upper nodes of tree ``number`` of model ``k``. Targets are less ``mean``, the mean of the training rows."""
    k: int
    number: int
    seed: int
    depth: int
    counts: dict          # block: rows to draw there
    mean: float
    offsets: np.ndarray
    tree: Tree = field(default_factory=Tree)
    level: list = field(default_factory=list)   # of every node
    open: list = field(default_factory=list)    # nodes to measure next
    parts: list = field(default_factory=list)   # nodes that a task goes on from

    def begin(self) -> Top:
        self.tree.add(0.0)
        self.level.append(0)
        (self.open if sum(self.counts.values()) > PART else self.parts).append(0)
        return self

    def drawn(self, block: int, train: np.ndarray) -> np.ndarray:
        """How often each row of a block is in the bootstrap."""
        out, rows = np.zeros(len(train), dtype=np.int64), np.flatnonzero(train)
        if len(rows):
            rng = np.random.default_rng([self.seed, self.k, self.number, block % GRANULE, block // GRANULE % GRANULE])
            out[rows] = np.bincount(rng.integers(0, len(rows), self.counts.get(block, 0)), minlength=len(rows))
        return out

    def advance(self, total: np.ndarray) -> None:
        """Take in the sums (targets, weights) of the open nodes."""
        nodes, self.open = self.open, []
        for node, found in zip(nodes, best_splits(total[[0, 1, 1]], self.offsets, 1), strict=True):
            if found is None:
                continue
            f, cut, *sides = found
            for child, s in zip(self.tree.split(node, f, cut, tuple(float(s[0] / s[1]) for s in sides)), sides, strict=True):
                self.level.append(self.level[node] + 1)
                if self.level[child] < self.depth and s[1] > 1:
                    (self.open if s[1] > PART else self.parts).append(child)

    def finished(self) -> np.ndarray:
        """Which nodes are leaves that no task goes on from."""
        leaf = np.asarray(self.tree.feature) == LEAF
        leaf[self.parts] = False
        return leaf


def _groups(batches: Iterator[pa.RecordBatch], n_features: int) -> Iterator[tuple[dict, list[tuple[int, int, int]]]]:
    """Rows of some blocks together, with (block, first row, end) of each."""
    held: list[tuple[int, dict]] = []

    def joined():
        ends = np.cumsum([len(b["ids"]) for _, b in held]).tolist()
        spans = [(at, end - len(b["ids"]), end) for (at, b), end in zip(held, ends, strict=True)]
        return {c: np.concatenate([b[c] for _, b in held]) for c in held[0][1]}, spans

    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            held.append((row["block"], MM._block(row, n_features)))
            if len(held) == BLOCKS_A_COUNT:
                yield joined()
                held = []
    if held:
        yield joined()


def _weights(top: Top, train: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    mine = MM._has(train, top.k)
    return np.concatenate([top.drawn(block, mine[a:b]) for block, a, b in spans])


def _measured(batches: Iterator[pa.RecordBatch], models: list, tops: list[Top], offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of targets and weights by open node and bin, over a partition's blocks; ``model`` is the place in ``tops``."""
    totals: dict[int, np.ndarray] = {}
    for block, spans in _groups(batches, len(offsets) - 1):
        for j, top in enumerate(tops):
            if not top.open:
                continue
            w = _weights(top, block["train"], spans)
            rows = np.flatnonzero(w)
            slot_of = np.full(len(top.tree.feature), -1, dtype=np.int64)
            slot_of[top.open] = np.arange(len(top.open))
            bins = block["bins"][rows]
            slot = slot_of[top.tree.leaves(bins)]
            here = np.flatnonzero(slot >= 0)
            rows, weight = rows[here], w[rows[here]].astype(float)
            y = MM._target(block["y"][rows], models[top.k]) - top.mean
            x = bin_sums(bins[here], slot[here], len(top.open), offsets, [weight * y, weight])
            totals[j] = totals[j] + x if j in totals else x
    for j, x in totals.items():
        yield MM._total_row(j, "sums", x)


_DEALT = "part int, role int, ids binary, bins binary, y binary, w binary, score binary"


def _dealt(batches: Iterator[pa.RecordBatch], models: list, tops: list[Top], offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows by the node that a task goes on from: drawn ones (role 0) with what the growth needs, others to score (role 1)."""
    first = np.cumsum([0, *[len(t.parts) for t in tops]])
    for block, spans in _groups(batches, len(offsets) - 1):
        for j, top in enumerate(tops):
            part_of = np.full(len(top.tree.feature), -1, dtype=np.int64)
            part_of[top.parts] = first[j] + np.arange(len(top.parts))
            w, score = _weights(top, block["train"], spans), MM._has(block["score"], top.k)
            part = part_of[top.tree.leaves(block["bins"])]
            for role, used in enumerate((w > 0, (w == 0) & score)):
                rows = np.flatnonzero(used & (part >= 0))
                rows = rows[part[rows].argsort(kind="stable")]
                if not len(rows):
                    continue
                of = part[rows]
                bounds = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
                column = {"ids": block["ids"][rows], "bins": block["bins"][rows]}
                if role == 0:
                    column |= {"y": MM._target(block["y"][rows], models[top.k]).astype("<f8"), "w": w[rows].astype("<u4"), "score": score[rows].astype("u1")}
                cut = {c: [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for c, x in column.items()}
                n = len(bounds) - 1
                yield pa.record_batch([pa.array(of[bounds[:-1]].astype(np.int32)), pa.array(np.full(n, role, dtype=np.int32)),
                                       *[pa.array(cut.get(c, [b""] * n), pa.binary()) for c in ("ids", "bins", "y", "w", "score")]],
                                      names=["part", "role", "ids", "bins", "y", "w", "score"])


_SUM = "model int, id long, p double"


def _sum_rows(k: int, ids: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(ids), k, dtype=np.int32)), pa.array(ids), pa.array(np.asarray(p, dtype=np.float64))], names=["model", "id", "p"])


def _grown(batches: Iterator[pa.RecordBatch], parts: list[tuple[int, int]], offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and role: grow on the drawn rows, then score them and the others. ``parts``: model, levels left."""
    at, held, tree, width = None, [], None, len(offsets) - 1
    read = lambda row, c, t: np.frombuffer(row[c], dtype=t)

    def grown():
        """The tree of the held rows, and their predictions."""
        join = lambda c, t: np.concatenate([read(x, c, t) for x in held]) if held else np.zeros(0, dtype=t)
        ids, y, w, score = join("ids", "<i8"), join("y", "<f8"), join("w", "<u4"), join("score", "u1") > 0
        bins = join("bins", "u1").reshape(-1, width)
        by = ids.argsort(kind="stable")  # the order of arrival is not
        found = grow_deep(bins[by], offsets, y[by], w[by], parts[at][1])
        return found, _sum_rows(parts[at][0], ids[score], found.predict(bins[score]))

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["part"] != at:
                if held and tree is None:
                    yield grown()[1]
                at, held, tree = row["part"], [], None
            if row["role"] == 0:
                held.append(row)
                continue
            if tree is None:
                tree, scored = grown()
                yield scored
                held = []
            yield _sum_rows(parts[at][0], read(row, "ids", "<i8"), tree.predict(read(row, "bins", "u1").reshape(-1, width)))
    if held and tree is None:
        yield grown()[1]


def _finished(batches: Iterator[pa.RecordBatch], tops: list[Top], offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Predictions of rows that end in a finished upper node."""
    for block, _ in _groups(batches, len(offsets) - 1):
        for top in tops:
            rows = np.flatnonzero(MM._has(block["score"], top.k))
            leaf = top.tree.leaves(block["bins"][rows])
            there = top.finished()[leaf]
            yield _sum_rows(top.k, block["ids"][rows[there]], np.asarray(top.tree.value)[leaf[there]] + top.mean)


def _training_rows(batches: Iterator[pa.RecordBatch], models: list, which: Sequence[int], n_features: int) -> Iterator[pa.RecordBatch]:
    """Per block and model the number of training rows and the sum of their targets."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            block = MM._block(row, n_features)
            mine = [(k, rows) for k in which if (rows := MM._has(block["train"], k)).any()]
            yield pa.record_batch([pa.array([row["block"]] * len(mine), pa.int64()), pa.array([k for k, _ in mine], pa.int32()),
                                   pa.array([int(rows.sum()) for _, rows in mine], pa.int64()),
                                   pa.array([float(MM._target(block["y"][rows], models[k]).sum()) for k, rows in mine], pa.float64())],
                                  names=["block", "k", "n", "y"])


def _grow_tops(table: DataFrame, models: list, tops: list[Top], offsets: np.ndarray) -> None:
    while any(t.open for t in tops):
        found = table.mapInArrow(lambda b: _measured(b, models, tops, offsets), MM._TOTAL).withColumn("near", F.spark_partition_id() % 64) \
            .groupBy("model", "near").applyInArrow(MM._added, MM._TOTAL).groupBy("model").applyInArrow(MM._added, MM._TOTAL)
        for r in found.collect():  # one total a tree
            tops[r["model"]].advance(MM._total_of(r.asDict()))


def forest_by_parts(blocks: MM.Blocks, models: list, which: list[int]) -> DataFrame:
    """(model, id, p): mean predictions of the forests ``which``, written."""
    offsets, spark = blocks.offsets, blocks.table.sparkSession
    table = blocks.table.select("block", "ids", "bins", "y", "train", "score").coalesce(2 * spark.sparkContext.defaultParallelism)
    held = table.mapInArrow(lambda b: _training_rows(b, models, which, len(offsets) - 1), "block long, k int, n long, y double").toPandas()
    held = {k: mine.sort_values("block") for k, mine in held.groupby("k")}
    n_rows = sum(int(mine["n"].sum()) for mine in held.values()) // max(len(held), 1)
    trees = [(k, t) for k in which for t in range(models[k].rounds)]
    some = max(1, ROWS_A_RUN // max(n_rows, 1))
    sums = None
    for a in range(0, len(trees), some):
        tops = []
        for k, t in trees[a:a + some]:
            m, counts, mean = models[k], {}, 0.0
            if k in held:
                n, total = held[k]["n"].to_numpy(), int(held[k]["n"].sum())
                draws = np.random.default_rng([m.seed, k, t]).multinomial(total, n / total)
                counts, mean = dict(zip(held[k]["block"].tolist(), draws.tolist(), strict=True)), float(held[k]["y"].sum()) / total
            tops.append(Top(k, t, m.seed, m.depth, counts, mean, offsets).begin())
        _grow_tops(table, models, tops, offsets)
        parts = [(t.k, t.depth - t.level[node]) for t in tops for node in t.parts]
        out = []
        if parts:
            out.append(table.mapInArrow(lambda b, tops=tops: _dealt(b, models, tops, offsets), _DEALT)
                       .repartitionById(len(parts), "part").sortWithinPartitions("part", "role")
                       .mapInArrow(lambda b, parts=parts: _grown(b, parts, offsets), _SUM))
        done = [t for t in tops if t.finished().any()]
        if done:
            out.append(table.mapInArrow(lambda b, done=done: _finished(b, done, offsets), _SUM))
        out += [] if sums is None else [sums]
        found = out[0]
        for more in out[1:]:
            found = found.unionByName(more)
        new = written(found.groupBy("model", "id").agg(F.sum("p").alias("p")), "forest-sums")
        if sums is not None:
            discard(sums)
        sums = new
        del out, found
        free_shuffles(spark)
    share = F.create_map(*[F.lit(x) for k in which for x in (k, float(models[k].rounds))])
    return sums.select("model", "id", F.array(F.col("p") / F.element_at(share, F.col("model"))).alias("p"))
