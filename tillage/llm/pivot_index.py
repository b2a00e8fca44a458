"""Operator 6: exact top-k inner products with a pivot-distance index.

Components are turned into whole numbers (floor(1024 x)), so scores are exact. For the triangle inequality a
vector x becomes x' = (x, sqrt(M - |x|^2)) with M the largest |x|^2, and a query q becomes q' = (q, 0): then
|q' - x'|^2 = |q|^2 + M - 2 q.x, so the largest inner products are the smallest distances.

Index: every vector is keyed by its nearest pivot and its distance to it; sorted by this key the vectors are
written in blocks of ``BLOCK`` rows, which are the annuli (pivot, lowest distance, highest distance).
Pivots come from k-means on a bounded sample (``SAMPLE`` vectors); they affect the speed only, never the result.

Search: (1) every query is scored against its own annulus, where its bound - the distance of its k-th best - starts;
(2) per pivot p a query needs only annuli that meet [d(q, p) - bound, d(q, p) + bound]; groups of queries
are joined with these annuli by pivot and ring and scored, annulus by annulus, where the bound still allows
a result; (3) the partial lists are merged.

Scale: one shuffle of the vectors (by key), one of the index per search; the work is the annuli
that the bounds leave. Hot vectors are spread, as the id and the row are part of the sort key.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillage.llm.shared import arrow_batches, stored

SCALE = 1024
PIVOTS = 32
SAMPLE = 4096
BLOCK = 1024
QUERY_BLOCK = 128
RINGS = 64
TOP_K = 10

_INDEX = "block long, pivot int, low double, high double, ids binary, dists binary, vectors binary"
_HITS = "query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): whole-number vectors; rows without an id, without a vector, or with a null or non-finite component
    are left out."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v"))


def _k_means(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Pivots: k-means of the sample, from evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin(_distances(sample, centres), axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = sample[near == c].mean(axis=0)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d2, 0))


def _lifted(v: np.ndarray, m: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.c_[v, np.sqrt(np.maximum(m - (v * v).sum(axis=1), 0))]


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while every partial sum is a whole number below 2^53."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), dtype=np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2 ** 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return (q.astype(object) @ x.astype(object).T).astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, short vectors padded with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dim), dtype=np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def _key(batches: Iterator[pa.RecordBatch], pivots, m, dim, dtype) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = _matrix(b.column(1), dim)
        d = _distances(_lifted(v, m), pivots) if len(v) else np.zeros((0, len(pivots)))
        near = d.argmin(axis=1)
        raw = [r.tobytes() for r in v.astype(dtype)]
        yield pa.record_batch([b.column(0), pa.array(raw, pa.binary()), pa.array(near, pa.int32()), pa.array(d[np.arange(len(v)), near])],
                              names=["vec_id", "vector", "pivot", "dist"])


def _pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to ``rows`` consecutive rows of one pivot."""
    block = TaskContext.get().partitionId() << 32
    pivot, ids, dists, vectors = None, [], [], []

    def row():
        return pa.record_batch([[block], pa.array([pivot], pa.int32()), [dists[0]], [dists[-1]], [np.array(ids, "<i8").tobytes()],
                                [np.array(dists, "<f8").tobytes()], [b"".join(vectors)]],
                               names=["block", "pivot", "low", "high", "ids", "dists", "vectors"])

    for b in batches:
        for i, x, p, d in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
            if ids and (p != pivot or len(ids) >= rows):
                yield row()
                block, ids, dists, vectors = block + 1, [], [], []
            pivot = p
            ids.append(i)
            dists.append(d)
            vectors.append(x)
    if ids:
        yield row()


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score, then smallest id."""
    return np.lexsort((ids, -scores))[:k]


def _arrays(b: pa.RecordBatch, r: int, dim: int, dtype, names=("ids", "dists", "vectors")):
    ids, dists, vectors = (b.column(n)[r].as_py() for n in names)
    return np.frombuffer(ids, "<i8"), np.frombuffer(dists, "<f8"), np.frombuffer(vectors, dtype).reshape(-1, dim).astype(np.int64)


def _seed(batches: Iterator[pa.RecordBatch], every, k, m, dim, dtype) -> Iterator[pa.RecordBatch]:
    """Queries of each annulus with the distance bound that its own rows give."""
    for b in batches:
        for r in range(b.num_rows):
            ids, dists, v = _arrays(b, r, dim, dtype)
            mine = np.flatnonzero(ids % every == 0)
            if not len(mine):
                continue
            s = _scores(v[mine], v)
            bounds = []
            for row, at in zip(s, mine.tolist(), strict=True):
                others = row[ids != ids[at]]
                if len(others) < k:
                    bounds.append(float("inf"))
                else:
                    worst = float(np.partition(others, len(others) - k)[len(others) - k])
                    norm = float((v[at].astype(np.float64) ** 2).sum())
                    bounds.append(float(np.sqrt(max(norm + m - 2 * worst, 0.0))))
            yield pa.record_batch([pa.array(ids[mine]), pa.array([v[a].astype(dtype).tobytes() for a in mine], pa.binary()),
                                   pa.array([b.column("pivot")[r].as_py()] * len(mine), pa.int32()), pa.array(dists[mine]), pa.array(bounds)],
                                  names=["vec_id", "vector", "pivot", "dist", "bound"])


def _group_queries(batches: Iterator[pa.RecordBatch], pivots, dim, dtype) -> Iterator[pa.RecordBatch]:
    """Groups of queries that lie close together, with the distances to all pivots that any of them can need."""
    group = TaskContext.get().partitionId() << 32
    held: list[tuple] = []

    def row():
        v = np.frombuffer(b"".join(x[1] for x in held), dtype).reshape(-1, dim).astype(np.float64)
        bound = np.array([x[4] for x in held])
        d = _distances(np.c_[v, np.zeros(len(v))], pivots)
        low, high = (d - bound[:, None]).min(axis=0), (d + bound[:, None]).max(axis=0)
        return pa.record_batch([[group], [np.array([x[0] for x in held], "<i8").tobytes()], [b"".join(x[1] for x in held)],
                                [bound.astype("<f8").tobytes()], [low.tolist()], [high.tolist()]],
                               names=["query", "query_ids", "query_vectors", "bounds", "low", "high"])

    for b in batches:
        for x in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
            if held and (len(held) >= QUERY_BLOCK or x[2] != held[0][2]):
                yield row()
                group, held = group + 1, []
            held.append(x)
    if held:
        yield row()


def _slack(m: float) -> float:
    """What rounding can add to a sum of computed distances: squares of size m lose their last digits."""
    return 1e-3 + 4e-7 * float(np.sqrt(m))


def _search(batches: Iterator[pa.RecordBatch], k, m, pivots, dim, dtype) -> Iterator[pa.RecordBatch]:
    """Best k of each annulus for each query of a group, where the triangle inequality allows one."""
    for b in batches:
        out = [], [], []
        for r in range(b.num_rows):
            q_ids, bounds, q = _arrays(b, r, dim, dtype, ("query_ids", "bounds", "query_vectors"))
            ids, _, v = _arrays(b, r, dim, dtype)
            qf = q.astype(np.float64)
            to_pivot = _distances(np.c_[qf, np.zeros(len(qf))], pivots[b.column("pivot")[r].as_py()][None, :])[:, 0]
            least = np.maximum(np.maximum(b.column("low")[r].as_py() - to_pivot, to_pivot - b.column("high")[r].as_py()), 0)
            reach = np.flatnonzero(least <= bounds + _slack(m))  # distances are rounded; scores are not
            s = _scores(q[reach], v)
            norms = (qf[reach] ** 2).sum(axis=1)
            for row, at, norm in zip(s, reach.tolist(), norms.tolist(), strict=True):
                # The bound as a score: |q|^2 + m - 2 s <= bound^2.
                floor = (norm + m - bounds[at] ** 2) / 2 - 1 - 1e-12 * (norm + m)
                good = np.flatnonzero((row >= floor) & (ids != q_ids[at])) if np.isfinite(floor) else np.flatnonzero(ids != q_ids[at])
                good = good[_best(row[good], ids[good], k)]
                out[0].append(np.full(len(good), q_ids[at]))
                out[1].append(ids[good])
                out[2].append(row[good])
        yield pa.record_batch([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = TOP_K) -> DataFrame:
    """(query_id, rank, vec_id, score): for every vector whose id is divisible by ``every`` the ``k`` other vectors with the
    highest inner product of whole-number components, ties to the smaller id; all, if there are fewer.

    Rows with a null id or vector, or with a null or non-finite component, take no part. Rows that share an id all
    take part: none is a result of a query with that id, and the queries of one id share one list of ``k`` results. Vectors of different lengths count as padded with zeros. Components up to 2^28 / 1024
    keep scores within a long. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    base = stored(whole_vectors(vectors, id_col, vec_col), "pivot-vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    facts = base.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m"), F.max(F.size("v")).alias("dim"),
                     F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    m, dim, n = facts["m"], max(1, facts["dim"]), facts["n"]
    dtype = "<i2" if (facts["top"] or 0) < 1 << 15 else "<i4" if facts["top"] < 1 << 31 else "<i8"
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    rows = np.zeros((len(sample), dim), dtype=np.int64)
    for r, s in zip(rows, sample, strict=True):
        r[:len(s["v"])] = s["v"]
    pivots = _k_means(_lifted(rows, m), PIVOTS)
    keyed = base.mapInArrow(lambda b: _key(b, pivots, m, dim, dtype), "vec_id long, vector binary, pivot int, dist double") \
        .withColumn("row", F.monotonically_increasing_id())  # spreads rows that share an id and a vector
    parts = max(1, -(-n // (8 * BLOCK)))
    index = stored(keyed.repartitionByRange(parts, "pivot", "dist", "vec_id", "row").sortWithinPartitions("pivot", "dist", "vec_id", "row")
                   .select("vec_id", "vector", "pivot", "dist").mapInArrow(lambda b: _pack(b, BLOCK), _INDEX), "pivot-index")
    seeded = index.mapInArrow(lambda b: _seed(b, every, k, m, dim, dtype), "vec_id long, vector binary, pivot int, dist double, bound double")
    groups = stored(seeded.repartitionByRange(max(1, -(-n // (every * 8 * QUERY_BLOCK))), "pivot", "dist", "vec_id")
                    .sortWithinPartitions("pivot", "dist", "vec_id")
                    .mapInArrow(lambda b: _group_queries(b, pivots, dim, dtype),
                                "query long, query_ids binary, query_vectors binary, bounds binary, low array<double>, high array<double>"),
                    "pivot-queries")
    # Rings of equal width make the meeting of intervals an equality join; a pair that shares several rings counts once.
    width = float(index.agg(F.max("high")).first()[0]) / RINGS or 1.0
    ring = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(width * RINGS), c)) / F.lit(width)).cast("int")
    annuli = index.select("block", "pivot", F.explode(F.sequence(ring(F.col("low")), ring(F.col("high")))).alias("ring"))
    reach = groups.select("query", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "d")) \
        .select("query", "pivot", F.explode(F.sequence(ring(F.col("d.low") - _slack(m)), ring(F.col("d.high") + _slack(m)))).alias("ring"))
    pairs = reach.join(annuli, ["pivot", "ring"]).select("query", "block").distinct()
    payload = pairs.join(groups.drop("low", "high"), "query").join(index, "block")
    hits = payload.mapInArrow(lambda b: _search(b, k, m, pivots, dim, dtype), _HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
