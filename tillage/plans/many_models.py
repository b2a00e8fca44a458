"""Many tree models over one table: folds, groups, quantiles, classes and members of a stack side by side.

The table is binned once and written as blocks of ``BLOCK`` rows: ids, bin codes, target and two bit masks that say for which models a
row is a training row or a row to score. Held-out rows are bits, not copies. Rows reach their block by hash, so any few
blocks are a random sample of the rows.

- Forest: a job is a model and ``TREES_A_JOB`` of its trees, grown on bootstraps of all training rows if the model says ``every_row``, as
  all registered models do (else of ``BLOCKS_HERE`` blocks that the job draws); it then scores block after block. A forest of
  more than ``FOREST_CELLS`` bin codes is grown by parts of its trees (forest_parts.py). Only the sums of predictions leave a task: no
  forest is broadcast or collected.
- Boosting: a model whose rows fit into ``BLOCKS_HERE`` blocks, or are up to ``CELLS_HERE`` bin codes times classes, is a job of its
  own. Larger ones are grown by passes over all blocks, one job a tree level for all of them together, with a task a core and
  histograms added up; every training row counts at any size. A softmax model of more than ``BY_CLASSES`` codes times classes whose
  rows and scores are ``BYTES_HERE`` or less is one job a round with a task a class, so that no histogram travels.
  All run the machine of tree_growth.Boosting, and give the same trees.

Jobs of all models run in one Spark job. The blocks of a small table (``FOREST_CELLS`` codes) are broadcast to them, those of a larger one
shuffled. The training blocks of a job, its trees, a block to score and one histogram are all that a task holds.
"""
from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.plans.tree_growth import Boosting, JoinedBins, Tree, boost_here, grow_class, grow_deep
from tillage.session import discard, free_shuffles, written

BLOCK = 8192
BLOCKS_HERE = 8
CELLS_HERE = 1 << 26  # a byte each
FOREST_CELLS = 1 << 24
TREES_A_JOB = 10
MAX_BINS = 255
BLOCKS_A_FILE = 16
BY_CLASSES = 1 << 24
BYTES_HERE = 1 << 26
TO_DRIVER = 1 << 25
REFRESH = 2
MAX_MODELS = 63


@dataclass(frozen=True)
class TreeModel:
    """A forest or a boosted model, its training rows and the rows to score (boolean columns).

    The target is ``y``, clipped to ``clip`` and taken to log(1 + y) if ``log`` is set, both before the fit only.
    """
    name: str
    kind: str                       # forest, squared, pinball, softmax
    train: Column | None
    score: Column | None
    rounds: int = 500               # of a forest: trees
    rate: float = 0.06
    depth: int = 5
    min_leaf: int = 20
    alpha: float = 0.5
    classes: int = 1
    per_split: int | None = None
    every_row: bool = False         # a forest whose jobs take all training rows, whatever their number
    clip: tuple = (None, None)
    log: bool = False
    seed: int = 42


def forest(name: str, train: Column, score: Column, trees: int = 400, depth: int = 30, **kw) -> TreeModel:
    return TreeModel(name, "forest", train, score, rounds=trees, depth=depth, min_leaf=1, **kw)


def boosted(name: str, train: Column, score: Column, **kw) -> TreeModel:
    """Trees of at most 32 leaves with 20 rows or more each."""
    return TreeModel(name, "squared", train, score, **kw)


def quantile(name: str, train: Column, score: Column, alpha: float, rounds: int = 400, **kw) -> TreeModel:
    return TreeModel(name, "pinball", train, score, rounds=rounds, depth=3, min_leaf=1, alpha=alpha, **kw)


def multinomial(name: str, train: Column, score: Column, classes: int, **kw) -> TreeModel:
    """``classes`` trees a round from the gradients of the softmax; the target is the class number."""
    return TreeModel(name, "softmax", train, score, classes=classes, **kw)


@dataclass
class Blocks:
    table: DataFrame
    offsets: np.ndarray
    edges: list = field(default_factory=list)


def _bits(models: Sequence[TreeModel], which: str) -> Column:
    out = F.lit(0).cast("long")
    for k, m in enumerate(models):
        out = out + F.when(F.coalesce(getattr(m, which), F.lit(False)), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def feature_edges(rows: DataFrame, features: str, n: int, bins: int = MAX_BINS) -> list[np.ndarray]:
    """Upper ends of the bins of each feature, from quantiles of the rows (one pass, mergeable sketches)."""
    if not n:
        return []
    shares = [k / bins for k in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(F.get(F.col(features), F.lit(k)), shares, 20_000).alias(f"f{k}") for k in range(n)]).first()
    return [np.unique(np.array(q if q is not None else [], dtype=np.float64)) for q in got]


def _pack(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray], size: int) -> Iterator[pa.RecordBatch]:
    def packed(rows: pa.Table) -> pa.RecordBatch:
        x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), len(edges))
        codes = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], axis=1).astype("u1")
        column = {"ids": rows.column("id").to_numpy().astype("<i8"), "bins": codes, "y": rows.column("y").to_numpy().astype("<f8"),
                  "train": rows.column("train").to_numpy().astype("<i8"), "score": rows.column("score").to_numpy().astype("<i8")}
        all_bits = [int(np.bitwise_or.reduce(column[c])) for c in ("train", "score")]
        return pa.record_batch([pa.array([int(column["ids"][0])]), *[pa.array([v.tobytes()], pa.binary()) for v in column.values()],
                                *[pa.array([b], pa.int64()) for b in all_bits]], names=["block", *column, "train_any", "score_any"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        while sum(x.num_rows for x in held) >= size:
            table = pa.Table.from_batches(held)
            yield packed(table.slice(0, size))
            held = table.slice(size).to_batches()
    if sum(x.num_rows for x in held):
        yield packed(pa.Table.from_batches(held))


def binned_blocks(rows: DataFrame, models: Sequence[TreeModel]) -> Blocks:
    """Blocks of ``rows`` (id long, y double, x array<double>, and the columns that the models' conditions name).

    A null target is no training row. Every x has the same length, without nulls.
    """
    if len(models) > MAX_MODELS:
        raise ValueError(f"at most {MAX_MODELS} models share a table")
    masked = written(rows.select("id", F.coalesce("y", F.lit(0.0)).alias("y"), "x", F.when(F.col("y").isNotNull(), _bits(models, "train"))
                                  .otherwise(F.lit(0).cast("long")).alias("train"), _bits(models, "score").alias("score"))
                      .where("train <> 0 OR score <> 0"), "model-rows")
    stats = masked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("features")).first()
    edges = feature_edges(masked.where("train <> 0"), "x", stats["features"] or 0)
    parts = max(1, -(-stats["n"] // (BLOCK * BLOCKS_A_FILE)))
    size = BLOCK
    table = masked.repartition(parts, "id").sortWithinPartitions(F.xxhash64("id"), "id").mapInArrow(
        lambda b: _pack(b, edges, size), "block long, ids binary, bins binary, y binary, train binary, score binary, train_any long, score_any long")
    table = written(table, "model-blocks")
    discard(masked)
    return Blocks(table, np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])]).astype(np.int64), edges)


def _block(row: dict, n_features: int) -> dict:
    ids = np.frombuffer(row["ids"], dtype="<i8")
    return {"ids": ids, "bins": np.frombuffer(row["bins"], dtype="u1").reshape(-1, n_features),
            **{c: np.frombuffer(row[c], dtype=t) for c, t in (("y", "<f8"), ("train", "<i8"), ("score", "<i8"))}}


def _has(mask: np.ndarray, k: int) -> np.ndarray:
    return (mask >> k) & 1 == 1


def _target(y: np.ndarray, m: TreeModel) -> np.ndarray:
    y = np.clip(y, *m.clip) if m.clip != (None, None) else y
    return np.log1p(np.maximum(y, 0.0)) if m.log else y


def _machine(m: TreeModel, offsets: np.ndarray) -> Boosting:
    return Boosting(offsets, m.kind, m.rounds, m.rate, m.depth, m.min_leaf, m.alpha, m.classes)


def _fit(m: TreeModel, k: int, part: int, trees: int, blocks: list[dict], offsets: np.ndarray) -> Boosting | list[Tree]:
    bins = np.concatenate([b["bins"] for b in blocks]) if blocks else np.zeros((0, len(offsets) - 1), dtype="u1")
    y = _target(np.concatenate([b["y"] for b in blocks]) if blocks else np.zeros(0), m)
    w = np.concatenate([_has(b["train"], k) for b in blocks]) if blocks else np.zeros(0, dtype=bool)
    if m.kind != "forest":
        return boost_here(_machine(m, offsets), bins, y, w)
    bins, y = bins[w], y[w]
    onehot = (y[:, None] == np.arange(m.classes)).astype(float) if m.classes > 1 else None
    grown = []
    for t in range(trees):
        rng = np.random.default_rng([m.seed, k, part, t])
        drawn = np.bincount(rng.integers(0, max(len(y), 1), len(y)), minlength=len(y))
        grown.append(grow_deep(bins, offsets, y, drawn, m.depth, m.per_split, rng, onehot).for_scoring())
    return grown


def _predict(m: TreeModel, fitted: Boosting | list[Tree], bins: np.ndarray) -> np.ndarray:
    """(rows, classes): probabilities, or one column of values; of a forest the sum over its trees here."""
    if m.kind == "forest":
        return sum(t.predict(bins).reshape(len(bins), -1) for t in fitted)
    raw = fitted.scores(bins)
    if m.kind != "softmax":
        return raw
    p = np.exp(raw - raw.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


_SCORED = "model int, id long, p array<double>"


def _scored(k: int, ids: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.reshape(-1)))
    return pa.record_batch([pa.array(np.full(len(ids), k, dtype=np.int32)), pa.array(ids), flat], names=["model", "id", "p"])


def _takes_all(m: TreeModel) -> bool:
    return m.kind != "forest" or m.every_row


def _run_jobs(batches: Iterator[pa.RecordBatch], models: list[TreeModel], jobs: list[tuple], offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows sorted by job, training blocks first: fit a job when its first block to score comes, then score block by block."""
    job, blocks, fitted = None, [], None
    for b in batches:
        for at in range(b.num_rows):
            row = b.slice(at, 1).to_pylist()[0]
            if row["job"] != job:
                job, blocks, fitted = row["job"], [], None
            k, part, trees = jobs[job]
            block = _block(row, len(offsets) - 1)
            if row["role"] == 0:
                if _takes_all(models[k]) or len(blocks) < BLOCKS_HERE:
                    blocks.append(block)
                continue
            if fitted is None:
                fitted, blocks = _fit(models[k], k, part, trees, blocks, offsets), []
            mine = _has(block["score"], k)
            yield _scored(k, block["ids"][mine], _predict(models[k], fitted, block["bins"][mine]))


def _measured(batches: Iterator[pa.RecordBatch], models: list[TreeModel], machines: dict[int, Boosting], since: int,
              offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Totals over a partition's blocks of what each machine asks for."""
    totals: dict[int, tuple] = {}
    for b in batches:
        for row in b.to_pylist():
            block = _block(row, len(offsets) - 1)
            raws = dict(row["raw"] or [])  # Arrow gives a map as pairs
            for k, machine in machines.items():
                used = _has(block["train"], k)
                if not used.any():
                    continue
                raw = None
                if machine.base is not None:
                    start = np.frombuffer(raws[k], dtype="<f8").reshape(len(used), -1) if k in raws else None
                    raw = machine.scores(block["bins"], since if start is not None else 0, start)
                kind, x = machine.measure(block["bins"], _target(block["y"], models[k]), used, raw)
                before = totals.get(k)
                totals[k] = (kind, Boosting.join(kind, before[1] if before else None, x))
    for k, (kind, x) in totals.items():
        yield _total_row(k, kind, x)


_TOTAL = "model int, kind string, shape array<int>, x binary"


def _total_row(k: int, kind: str, x: np.ndarray) -> pa.RecordBatch:
    data = x.astype("<f8" if kind == "sums" else "<i8").tobytes()
    return pa.record_batch([pa.array([k], pa.int32()), pa.array([kind]), pa.array([list(x.shape)], pa.list_(pa.int32())), pa.array([data], pa.binary())],
                           names=["model", "kind", "shape", "x"])


def _total_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["x"], dtype="<f8" if row["kind"] == "sums" else "<i8").reshape(row["shape"])


def _added(table: pa.Table) -> pa.Table:
    total, kind, k = None, None, None
    for row in table.to_pylist():
        k, kind = row["model"], row["kind"]
        total = Boosting.join(kind, total, _total_of(row))
    return pa.Table.from_batches([_total_row(k, kind, total)])


def _with_raw(batches: Iterator[pa.RecordBatch], machines: dict[int, Boosting], since: int, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            bins, raws = _block(row, len(offsets) - 1)["bins"], dict(row["raw"] or [])
            new = {j: m.scores(bins, since if j in raws else 0, np.frombuffer(raws[j], dtype="<f8").reshape(len(bins), -1) if j in raws else None)
                   for j, m in machines.items()}
            column = pa.array([[(j, x.astype("<f8").tobytes()) for j, x in new.items()]], pa.map_(pa.int32(), pa.binary()))
            yield pa.record_batch([column if c == "raw" else b.column(c).slice(k, 1) for c in b.schema.names], names=b.schema.names)


def boost_by_passes(blocks: Blocks, models: list[TreeModel], which: list[int]) -> dict[int, Boosting]:
    """The boosted models ``which``, grown together: one job a measurement, whatever their number."""
    machines = {k: _machine(models[k], blocks.offsets) for k in which}
    spark, offsets, since, jobs = blocks.table.sparkSession, blocks.offsets, 0, 0
    # A file a core: a pass is one wave of tasks. Rows to score only and their ids take no part.
    tasks = spark.sparkContext.defaultParallelism
    table = written(blocks.table.where("train_any <> 0").select("block", F.lit(b"").alias("ids"), "bins", "y", "train", F.lit(b"").alias("score"),
                                                               F.lit(None).cast("map<int,binary>").alias("raw")).repartition(tasks), "model-scores")
    while True:
        live = {k: m for k, m in machines.items() if not m.done()}
        if not live:
            discard(table)
            return machines
        at = min(len(m.trees) for m in live.values())
        turn = {k: m for k, m in live.items() if len(m.trees) == at}  # a model with fewer measurements a round waits for the others
        if at - since >= REFRESH and len(turn) == len(live):
            # Scores of the finished rounds go into the table, so that a pass never repeats more than REFRESH rounds.
            sent, before = {k: m.for_tasks(since) for k, m in live.items()}, table
            table = written(table.coalesce(tasks).mapInArrow(lambda b, m=sent, s=since: _with_raw(b, m, s, offsets), table.schema), "model-scores")
            discard(before)
            since = at
        # Neither the driver's sums nor the rounds that the scores of the table already hold go out with a pass.
        sent = {k: m.for_tasks(since) for k, m in turn.items()}
        parts = table.coalesce(tasks).mapInArrow(lambda b, m=sent, s=since: _measured(b, models, m, s, offsets), _TOTAL)
        if any(m.leafing for m in turn.values()) or sum(len(m.asked) for m in turn.values()) * int(offsets[-1]) * 24 * tasks > TO_DRIVER:
            near = parts if tasks <= 64 else parts.withColumn("near", F.spark_partition_id() % 64).groupBy("model", "near").applyInArrow(_added, _TOTAL)
            parts, jobs = near.groupBy("model").applyInArrow(_added, _TOTAL), jobs + 1  # one total a model
            if jobs % 64 == 0:
                free_shuffles(spark)
        found: dict[int, np.ndarray] = {}
        for r in parts.collect():
            found[r["model"]] = Boosting.join(r["kind"], found.get(r["model"]), _total_of(r.asDict()))
        for k, machine in turn.items():
            if k in found:
                machine.advance(found[k])
            else:  # no training rows
                machine.base, machine.rounds = np.zeros(machine.classes), len(machine.trees)


_HELD: dict = {}  # of the last model by classes that this process has worked on: what every round needs again


def _grow_classes(batches: Iterator[pa.RecordBatch], model: Boosting, run: str, rows, raw) -> Iterator[pa.RecordBatch]:
    if run not in _HELD:
        bins, y = rows.value
        _HELD.clear()
        _HELD[run] = (np.asfortranarray(bins), y, JoinedBins(bins, model.offsets))
    bins, y, joined = _HELD[run]
    for b in batches:
        for k in b.column(0).to_pylist():
            tree, score = grow_class(model, joined, bins, y, raw.value, k)
            yield pa.record_batch([pa.array([k], pa.int64()), pa.array([pickle.dumps(tree)], pa.binary()), pa.array([score.tobytes()], pa.binary())],
                                  names=["k", "tree", "score"])


def boost_by_classes(blocks: Blocks, m: TreeModel, k: int) -> Boosting:
    """A softmax model whose rows a task holds: one job a round, in which every task grows the tree of a class."""
    spark, model = blocks.table.sparkSession, _machine(m, blocks.offsets)
    held = [_block({**r.asDict(), "ids": b"", "score": b""}, len(blocks.offsets) - 1) for r in
            blocks.table.where(F.shiftright("train_any", k).bitwiseAND(F.lit(1)) != 0).select("block", "bins", "y", "train").orderBy("block").collect()]
    used = [_has(b["train"], k) for b in held]
    bins, y = (np.concatenate([b[c][w] for b, w in zip(held, used, strict=True)]) for c in ("bins", "y"))
    del held
    model.advance(model.measure(bins, y, np.ones(len(y)), None)[1])
    raw, rows, run = model.scores(bins), spark.sparkContext.broadcast((bins, y)), uuid.uuid4().hex
    light = replace(model, trees=[], growing=[], open=[], asked=[])
    model.growing = []
    while not model.done():
        sent = spark.sparkContext.broadcast(raw)
        found = spark.range(0, m.classes, 1, m.classes).mapInArrow(lambda b, s=sent: _grow_classes(b, light, run, rows, s), "k long, tree binary, score binary").collect()
        sent.destroy()
        raw, trees = np.empty_like(raw), {}
        for r in found:
            trees[r["k"]], raw[:, r["k"]] = pickle.loads(r["tree"]), np.frombuffer(r["score"])
        model.trees.append([trees[c] for c in range(m.classes)])
    rows.destroy()
    return model


def _score_machines(batches: Iterator[pa.RecordBatch], models: list[TreeModel], machines: dict[int, Boosting], offsets: np.ndarray):
    for b in batches:
        for row in b.to_pylist():
            block = _block(row, len(offsets) - 1)
            for k, machine in machines.items():
                mine = _has(block["score"], k)
                if mine.any():
                    yield _scored(k, block["ids"][mine], _predict(models[k], machine, block["bins"][mine]))


def fit_and_score(rows: DataFrame, models: Sequence[TreeModel]) -> DataFrame:
    """(model, id, p): predictions of every model for its rows to score, written.

    ``p`` has one value, or the probability of every class. Targets are those of the fit (clipped, log). A model without training
    rows predicts 0 (uniform probabilities); the result of an empty table is empty.
    """
    models = list(models)
    blocks = binned_blocks(rows, models)
    if not blocks.edges:
        return rows.sparkSession.createDataFrame([], _SCORED)
    models = [replace(m, train=None, score=None) for m in models]  # what the tasks need to know
    spark = rows.sparkSession
    # Which blocks hold training rows of a model: counted per model, blocks chosen by hash where a job takes some of them.
    bit = [F.shiftright("train_any", k).bitwiseAND(F.lit(1)) for k in range(len(models))]
    size = F.octet_length("ids") / 8 * F.lit(len(blocks.offsets) - 1)
    held = blocks.table.agg(F.sum(size).alias("codes"), *[F.sum(b).alias(f"m{k}") for k, b in enumerate(bit)],
                            *[F.sum(b * size).alias(f"c{k}") for k, b in enumerate(bit)]).first()
    n_blocks = [int(held[f"m{k}"] or 0) for k in range(len(models))]
    cells = lambda m: BLOCK * (len(blocks.offsets) - 1) * m.classes
    by_classes = [k for k, m in enumerate(models) if m.kind == "softmax" and (held[f"c{k}"] or 0) * m.classes > BY_CLASSES
                  and held[f"c{k}"] * (1 + 8 * m.classes / (len(blocks.offsets) - 1)) <= BYTES_HERE]
    by_passes = [k for k, m in enumerate(models) if m.kind != "forest" and k not in by_classes and n_blocks[k] > BLOCKS_HERE
                 and n_blocks[k] * cells(m) > CELLS_HERE]
    by_parts = [k for k, m in enumerate(models) if m.kind == "forest" and m.every_row and m.classes == 1 and m.per_split is None
                and (held[f"c{k}"] or 0) > FOREST_CELLS]
    jobs: list[tuple] = []
    for k, m in enumerate(models):
        if k in by_parts or k in by_classes:
            continue
        if m.kind == "forest":
            jobs += [(k, part, min(TREES_A_JOB, m.rounds - part)) for part in range(0, m.rounds, TREES_A_JOB)]
        elif k not in by_passes:
            jobs.append((k, 0, 0))
    # The dearest jobs first, so that short ones fill the gaps.
    jobs.sort(key=lambda j: (models[j[0]].kind == "forest", -models[j[0]].rounds * models[j[0]].classes))
    parts = []
    if jobs:
        table = spark.createDataFrame([(j, k, 0 if _takes_all(models[k]) else n_blocks[k]) for j, (k, _, _) in enumerate(jobs)], "job int, k int, n int")
        # A job of a larger model draws some four times the blocks that it takes, and takes the first of them in the order of their hash.
        draws = F.pmod(F.xxhash64("block", "job"), F.lit(1 << 20)) * F.col("n") < F.lit(2 * (BLOCKS_HERE + 8) << 20)
        wants = lambda mask: F.col(mask).bitwiseAND(F.expr("shiftleft(1L, k)")) != 0
        taken = F.when(F.col("role") == 1, wants("score_any")).otherwise(wants("train_any") & ((F.col("n") <= BLOCKS_HERE) | draws))
        # Every block meets every job that needs it; the jobs are as many as the models ask for, whatever the rows. A small table goes to the
        # jobs as it is; shuffled, it would be on disk once a job.
        small = held["codes"] <= FOREST_CELLS
        met = table.repartitionById(len(jobs), "job").crossJoin(F.broadcast(blocks.table)) if small else blocks.table.crossJoin(F.broadcast(table))
        pairs = met.withColumn("role", F.explode(F.array(F.lit(0), F.lit(1)))).where(taken) \
            .withColumn("place", F.xxhash64("block", "job")).drop("train_any", "score_any", "k", "n") \
            .withColumns({c: F.when(F.col("role") == role, F.col(c)).otherwise(F.lit(b"")) for c, role in
                          (("y", 0), ("train", 0), ("ids", 1), ("score", 1))})  # what a role has no use for does not travel
        offsets = blocks.offsets
        # A job is a part by its number: parts by range would need a sample, and so all pairs once more.
        pairs = pairs if small else pairs.repartitionById(len(jobs), "job")
        out = pairs.sortWithinPartitions("job", "role", "place").mapInArrow(lambda b: _run_jobs(b, models, jobs, offsets), _SCORED)
        parts.append(out)
    if by_passes or by_classes:
        machines = {k: boost_by_classes(blocks, models[k], k) for k in by_classes} | (boost_by_passes(blocks, models, by_passes) if by_passes else {})
        sent, offsets = spark.sparkContext.broadcast({k: m.for_tasks(0) for k, m in machines.items()}), blocks.offsets  # rounds x nodes, whatever the rows
        table = blocks.table.where("score_any <> 0").repartition(2 * spark.sparkContext.defaultParallelism)
        parts.append(table.mapInArrow(lambda b: _score_machines(b, models, sent.value, offsets), _SCORED))
    whole = []
    if by_parts:
        from tillage.plans.forest_parts import forest_by_parts
        whole.append(forest_by_parts(blocks, models, by_parts))
    if not parts:
        return whole[0] if whole else spark.createDataFrame([], _SCORED)
    found = written(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "model-predictions")
    trees = {k: m.rounds for k, m in enumerate(models) if m.kind == "forest" and k not in by_parts}
    if not trees:
        return found.unionByName(whole[0]) if whole else found
    width = max(m.classes for m in models)
    share = F.create_map(*[F.lit(x) for k, n in trees.items() for x in (k, float(n))])
    sums = found.where(F.col("model").isin(list(trees))).groupBy("model", "id").agg(
        *[F.sum(F.get("p", F.lit(c))).alias(f"p{c}") for c in range(width)])
    mean = sums.select("model", "id", F.filter(F.array(*[F.col(f"p{c}") / F.element_at(share, F.col("model")) for c in range(width)]),
                                               lambda v: v.isNotNull()).alias("p"))
    out = found.where(~F.col("model").isin(list(trees))).unionByName(mean)
    return out.unionByName(whole[0]) if whole else out
