"""Operator 4: n-gram Jaccard join with Bayesian pruning of MinHash candidates.

Documents are sets of hashed shingles of ``WORDS`` words. Documents with the same set form one class, whose
representative goes on; copies are never expanded into pairs.

1. Candidates: representatives that share one of ``BANDS`` bands of ``ROWS`` MinHash values. At the threshold 0.8 a pair
   is missed with probability (1 - 0.8^4)^32 = 4.8e-8.
2. Pruning: within a bucket MinHash values are compared ``STEP`` at a time. With m of k values equal and a uniform
   prior the similarity has a Beta(m + 1, k - m + 1) posterior; a pair goes when its probability of reaching the
   threshold is below ``TOLERANCE``. Of pairs at 0.8 exactly that drops 8.9e-8 over all steps (9.2e-9 at 0.82).
3. Verification: the similarity of every surviving pair is computed from the whole shingle sets.

A pair in several buckets belongs to the first band in which it agrees, so every link is counted once. Links are
not written as pairs: a bucket's task returns per document the number of its links and one edge to the
smallest document it is connected to, which is all that the classes (connected components) need.

Scale: buckets are cut into chunks of about ``CELL`` documents. Pairs within a chunk are looked at where the chunk is put together;
a chunk of a larger bucket also becomes one packed row, and the pairs of two chunks (a cell) are looked at where their two
rows meet. A document is thus one row per bucket whatever the bucket's size; a bucket of n documents has (n / CELL)^2 / 2 cells,
equal in size and free to run anywhere. Buckets with the same documents are looked at once. Only documents with a surviving pair
have their texts read again for verification.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.shared import arrow_batches, rows_with_ids, shuffle_parts, stored

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
STEP = 16
TOLERANCE = 1e-8
CELL = 512
PAIRS = 1 << 19

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """crc32 of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode())
        return value


_HASHES = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` lower-case words; a shorter text is one run."""
    w = (text or "").lower().split()
    h = np.fromiter(map(_HASHES.__getitem__, w), dtype=np.uint64, count=len(w))
    if not len(h):
        return h
    runs = max(1, len(h) - words + 1)
    out = h[:runs].copy()
    for k in range(1, min(words, len(h))):
        out = _mix(out * _MULTIPLY + h[k:k + runs])
    return np.unique(_mix(out + np.uint64(min(words, len(h)))))


@cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1))[:, None], rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]


def minhash(s: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """``n`` MinHash values of a set of shingle hashes."""
    a, b = _permutations(n)
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(low), 2048):
        v = low[None, k:k + 2048] * a
        v += b
        v ^= v >> np.uint32(15)
        np.minimum(out, v.min(axis=1), out=out)
    return out


@cache
def least_matches(k: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values among ``k`` with which P(similarity >= threshold) is at least ``tolerance``."""
    x = np.linspace(threshold, 1.0, 4001)
    for m in range(k + 1):
        norm = lgamma(k + 2) - lgamma(m + 1) - lgamma(k - m + 1)
        with np.errstate(divide="ignore"):
            density = np.exp(norm + m * np.log(x) + ((k - m) * np.log1p(-x) if k > m else 0.0))
        if np.trapezoid(density, x) >= tolerance:
            return m
    return k


def _key(s: np.ndarray) -> bytes:
    """128-bit name of a shingle set."""
    return blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()


def _digests(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, sizes, sigs = [], [], []
        for text in b.column(1).to_pylist():
            s = shingles(text, words)
            keys.append(_key(s))
            sizes.append(len(s))
            sigs.append(minhash(s).astype("<u4").tobytes() if len(s) else b"")
        yield pa.record_batch([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())],
                              names=["doc_id", "key", "n", "sig"])


def _band_values(sig: np.ndarray) -> np.ndarray:
    """Hash of each band of each signature."""
    bands = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.zeros(bands.shape[:2], dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h * _MULTIPLY + bands[:, :, k] + np.uint64(1))
    return h


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, BANDS * ROWS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, value, node): one row per band of each representative."""
    for b in batches:
        nodes = np.asarray(b.column(0))
        values = _band_values(_signatures(b.column(1)))
        yield pa.record_batch([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(nodes))),
                               pa.array(values.reshape(-1).view(np.int64)), pa.array(np.repeat(nodes, BANDS))],
                              names=["band", "value", "node"])


def _whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``place``, as tables of whole places with the bounds of the places in them. A table ends when its
    places hold ``PAIRS`` pairs, so its size does not depend on the partition's."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        place, node = table.column("place").to_pylist(), table.column("node").to_pylist()
        once = [k == 0 or node[k] != node[k - 1] or place[k] != place[k - 1] for k in range(len(place))]
        if not all(once):  # a document whose id occurs twice with the same words
            table = table.filter(pa.array(once)).combine_chunks()
            place = table.column("place").to_pylist()
        bounds = [0, *[k for k in range(1, len(place)) if place[k] != place[k - 1]], len(place)]
        stop = len(bounds) - 1 if last else len(bounds) - 2  # the last place may go on in the next batch
        k = 0
        while k < stop:
            first, pairs = k, 0
            while k < stop and (k == first or pairs < PAIRS):
                pairs += (bounds[k + 1] - bounds[k]) ** 2 // 2
                k += 1
            yield table.slice(bounds[first], bounds[k] - bounds[first]), np.array(bounds[first:k + 1]) - bounds[first]
        held[:] = table.slice(bounds[stop]).to_batches()

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= 4 * CELL:
            yield from cut(last=False)
    if held:
        yield from cut(last=True)


def _pairs_within(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers i < j of all pairs within the bounds."""
    starts, sizes = bounds[:-1], np.diff(bounds)
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for m in np.unique(sizes[sizes > 1]).tolist():
        a, b = np.triu_indices(m, 1)
        at = starts[sizes == m][:, None]
        left.append((at + a).reshape(-1))
        right.append((at + b).reshape(-1))
    return np.concatenate(left), np.concatenate(right)


def _survivors(sig: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that belong to the band of their rows and survive the pruning."""
    values = _band_values(sig)
    for k in range(BANDS):  # pairs that agree in an earlier band belong there
        mine = (band[i] <= k) | (values[i, k] != values[j, k])
        if not mine.all():
            i, j = i[mine], j[mine]
    same = np.zeros(len(i), dtype=np.int32)
    n = sig.shape[1]
    for k in range(0, n, STEP):
        for c in range(k, min(k + STEP, n)):
            same += sig[i, c] == sig[j, c]
        alive = same >= least_matches(min(k + STEP, n), threshold, tolerance)
        if not alive.all():
            i, j, same = i[alive], j[alive], same[alive]
    return i, j


_KEYS = ["bucket", "band", "chunk", "chunks"]


def _packed_chunks(table: pa.Table, bounds: np.ndarray, columns: list[str]) -> pa.Table:
    """One row per place of a bucket with several chunks: its key and its rows' ``columns`` as lists."""
    first = np.array([k for k in bounds[:-1].tolist() if table.column("chunks")[k].as_py() > 1], dtype=np.int64)
    stop = {a: b for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)}
    out = {c: table.column(c).take(pa.array(first)).combine_chunks() for c in _KEYS}
    for c in columns:
        parts = [table.column(c).slice(a, stop[a] - a).to_pylist() for a in first.tolist()]
        out[c] = pa.array(parts, pa.list_(table.schema.field(c).type))
    return pa.table(out)


def _marked(table: pa.Table, packed: bool) -> Iterator[pa.RecordBatch]:
    yield from table.append_column("packed", pa.array([packed] * len(table), pa.bool_())).combine_chunks().to_batches()


def _prune_chunks(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """The documents with a surviving pair within their chunk (a row each), and the chunks of larger buckets (packed)."""
    for table, bounds in _whole_chunks(batches):
        i, j = _pairs_within(bounds)
        i, j = _survivors(_signatures(table.column("sig")), table.column("band").to_numpy(), i, j, threshold, tolerance)
        some = table.take(pa.array(np.union1d(i, j)))
        nodes = pa.array([[x] for x in some.column("node").to_pylist()], pa.list_(pa.int64()))
        yield from _marked(pa.table({**{c: some.column(c) for c in _KEYS}, "node": nodes, "sig": pa.nulls(len(some), pa.list_(pa.binary()))}), False)
        yield from _marked(_packed_chunks(table, bounds, ["node", "sig"]), True)


def _cells(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[dict, dict]]:
    """The two packed chunks of each cell, from rows sorted by cell and chunk."""
    before = None
    for b in batches:
        for row in b.select(["cell", *_KEYS, *columns]).to_pylist():
            if before is not None and before["cell"] == row["cell"]:
                yield before, row
            before = row


def _pairs_across(a: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.meshgrid(np.arange(len(a["node"])), len(a["node"]) + np.arange(len(b["node"])), indexing="ij")
    return i.reshape(-1), j.reshape(-1)


def _prune_cells(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """The documents with a surviving pair across the two chunks of a cell."""
    for a, b in _cells(batches, ["node", "sig"]):
        i, j = _pairs_across(a, b)
        sig = np.frombuffer(b"".join(a["sig"] + b["sig"]), dtype="<u4").reshape(-1, BANDS * ROWS)
        i, j = _survivors(sig, np.full(len(sig), a["band"]), i, j, threshold, tolerance)
        for row, used, start in ((a, np.unique(i), 0), (b, np.unique(j), len(a["node"]))):
            found = [row["node"][k] for k in (used - start).tolist()]
            keys = {c: pa.array([row[c]] * len(found), t) for c, t in zip(_KEYS, (pa.binary(), pa.int32(), pa.int32(), pa.int32()), strict=True)}
            yield pa.record_batch([*keys.values(), pa.array(found, pa.int64())], names=[*_KEYS, "node"])


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j)."""
    if len(i) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    # Many pairs: shared shingles as columns of a 0/1 matrix, in column blocks that bound the memory.
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, name, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[name]
    owner, name = owner[keep], column[name[keep]]
    by = np.argsort(name, kind="stable")
    owner, name = owner[by], name[by]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for k in range(0, int(shared.sum()), 2048):
        lo, hi = np.searchsorted(name, [k, k + 2048])
        block = np.zeros((len(sets), 2048), dtype=np.float32)
        block[owner[lo:hi], name[lo:hi] - k] = 1
        total += block @ block.T
    return total[i, j].astype(np.int64)


def _links(grams: list[bytes], i: np.ndarray, j: np.ndarray, group: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose similarity reaches the threshold; ``group`` has the bounds of the rows that pairs stay within."""
    sets = [np.frombuffer(x, dtype="<u8") for x in grams]
    size = np.array([len(s) for s in sets])
    at = np.searchsorted(group, i, side="right")
    both = np.zeros(len(i), dtype=np.int64)
    for c in np.unique(at).tolist():
        mine = np.flatnonzero(at == c)
        first = group[c - 1]
        both[mine] = _intersections(sets[first:group[c]], i[mine] - first, j[mine] - first)
    # both / (size_i + size_j - both) >= threshold, without a division
    linked = both >= threshold * (size[i] + size[j] - both) - 1e-9
    return i[linked], j[linked]


def _link_rows(nodes: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> dict[str, pa.Array]:
    """Per document: copies on the other side of its links, and the smallest connected document."""
    links = np.zeros(len(nodes), dtype=np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    label = np.argsort(np.argsort(nodes, kind="stable"), kind="stable")  # ranks, so that the smallest node is the label
    by_rank = np.sort(nodes, kind="stable")
    while True:  # smallest connected row, by label propagation
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if (new == label).all():
            break
        label = new
    used = np.flatnonzero(links)
    return {"node": pa.array(nodes[used], pa.int64()), "links": pa.array(links[used]), "least": pa.array(by_rank[label[used]], pa.int64())}


_FOUND = [*_KEYS, "node", "copies", "sig", "grams", "packed", "links", "least"]
_FOUND_SCHEMA = ("bucket binary, band int, chunk int, chunks int, node array<long>, copies array<long>, sig array<binary>, "
                 "grams array<binary>, packed boolean, links long, least long")
_FOUND_TYPES = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()),
                pa.list_(pa.binary()), pa.bool_(), pa.int64(), pa.int64()]


def _as_found(columns: dict, n: int) -> Iterator[pa.RecordBatch]:
    table = pa.table({c: columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(_FOUND, _FOUND_TYPES, strict=True)})
    yield from table.to_batches(max_chunksize=2000)


def _verify_chunks(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """Links within chunks (a row per document), and the chunks of larger buckets with their shingles (packed)."""
    columns = ["node", "copies", "sig", "grams"]
    for table, bounds in _whole_chunks(batches):
        i, j = _pairs_within(bounds)
        i, j = _survivors(_signatures(table.column("sig")), table.column("band").to_numpy(), i, j, threshold, tolerance)
        i, j = _links(table.column("grams").to_pylist(), i, j, bounds, threshold)
        rows = _link_rows(table.column("node").to_numpy(), table.column("copies").to_numpy(), i, j)
        node = pa.array([[x] for x in rows["node"].to_pylist()], pa.list_(pa.int64()))
        yield from _as_found({**rows, "node": node, "packed": pa.array([False] * len(node))}, len(node))
        packed = _packed_chunks(table, bounds, columns)
        for k in range(len(packed)):  # a chunk with its shingles is a batch of its own
            one = packed.slice(k, 1).combine_chunks()
            yield from _as_found({**{c: one.column(c) for c in [*_KEYS, *columns]}, "packed": pa.array([True])}, 1)


def _verify_cells(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """Links across the two chunks of each cell."""
    for a, b in _cells(batches, ["node", "copies", "sig", "grams"]):
        i, j = _pairs_across(a, b)
        sig = np.frombuffer(b"".join(a["sig"] + b["sig"]), dtype="<u4").reshape(-1, BANDS * ROWS)
        i, j = _survivors(sig, np.full(len(sig), a["band"]), i, j, threshold, tolerance)
        if len(i):
            i, j = _links(a["grams"] + b["grams"], i, j, np.array([0, len(sig)]), threshold)
            rows = _link_rows(np.array(a["node"] + b["node"]), np.array(a["copies"] + b["copies"]), i, j)
            yield pa.record_batch(list(rows.values()), names=list(rows))


def _cell_rows(packed: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """Packed chunks, each once per other chunk of its bucket, those of a cell side by side."""
    other = packed.withColumn("other", F.explode(F.expr("filter(sequence(0, chunks - 1), x -> x <> chunk)")))
    return other.select(F.concat("bucket", F.encode(F.concat_ws(":", F.lit(""), F.least("chunk", "other"), F.greatest("chunk", "other")), "UTF-8"))
                        .alias("cell"), *_KEYS, *columns).repartition(parts, "cell").sortWithinPartitions("cell", "chunk")


def _grams(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t, words) for t in b.column("text").to_pylist()]
        ours = [k == _key(s) for k, s in zip(b.column("key").to_pylist(), sets, strict=True)]  # not another text under the same id
        yield pa.record_batch([b.column("node"), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                              names=["node", "grams"]).filter(pa.array(ours, pa.bool_()))


def connected_classes(edges: DataFrame) -> DataFrame:
    """(node, class): smallest node of each node's component; ``edges`` has (node, least) with least <= node.

    Every round takes the smallest label among a node's neighbours and then that label's own label, so long chains
    shrink by more than one step a round. Nodes without edges are absent.
    """
    apart = edges.where("node <> least")
    both = stored(apart.select(F.col("node").alias("x"), F.col("least").alias("y"))
                  .union(apart.select(F.col("least").alias("x"), F.col("node").alias("y"))).distinct(), "join-edges")
    labels = stored(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")), "join-labels")
    while True:
        seen = both.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(seen, "x").select("x", F.least("label", "near").alias("to"), "label")
        far = labels.select(F.col("x").alias("to"), F.col("label").alias("jump"))
        new = stored(step.join(far, "to").select("x", F.least("to", "jump").alias("label"), (F.least("to", "jump") != F.col("label")).alias("moved")),
                     "join-labels")
        labels = new.select("x", "label")
        if new.where("moved").isEmpty():
            return labels.select(F.col("x").alias("node"), F.col("label").alias("class"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id``, ``n_links``, ``n_copies``, ``kept``.

    Two texts are linked when the Jaccard similarity of their shingle sets reaches ``threshold``; ``class_id`` is the
    smallest id connected by links, ``n_links`` counts the other rows that the row is linked to (copies included),
    ``n_copies`` the rows with the same shingle set, and the row of the smallest id of a class is kept. Texts without
    words (null, empty) have no links and are a class of their own; a text of fewer words than a shingle is one shingle.
    Rows with a null id take part under no id: they have a null ``class_id``, no links, and are kept. Rows that repeat an id share
    its fate. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    digests = stored(texts.mapInArrow(lambda b: _digests(b, words), "doc_id long, key binary, n long, sig binary"), "join-digests")
    reps = stored(digests.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id()), "join-reps")
    bands = stored(reps.select("node", "sig").mapInArrow(_bands, "band int, value long, node long"), "join-bands")
    buckets = bands.groupBy("band", "value").agg(
        F.count(F.lit(1)).alias("size"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("members")).where("size > 1")
    # Buckets with the same documents: the first band's one does for all.
    buckets = buckets.groupBy("size", "least", "members").agg(F.min(F.struct("band", "value")).alias("b")).select("b.*", "size")
    placed = bands.join(buckets, ["band", "value"]).select(
        F.expr("unhex(md5(concat_ws(':', band, value)))").alias("bucket"), "band", "node", F.expr(f"cast(ceil(size / {CELL}) as int)").alias("chunks")) \
        .withColumn("chunk", F.expr("cast(pmod(xxhash64(node, band), chunks) as int)")) \
        .withColumn("place", F.concat("bucket", F.encode(F.col("chunk").cast("string"), "UTF-8")))
    parts = 2 * shuffle_parts(spark)
    by_place = lambda d: d.repartition(parts, "place").sortWithinPartitions("place", "node")
    pruned = stored(by_place(placed.join(reps.select("node", "sig"), "node")).mapInArrow(
        lambda b: _prune_chunks(b, threshold, tolerance),
        "bucket binary, band int, chunk int, chunks int, node array<long>, sig array<binary>, packed boolean"), "join-pruned")
    within = pruned.where("NOT packed").select(*_KEYS, F.explode("node").alias("node"))
    across = _cell_rows(pruned.where("packed"), ["node", "sig"], parts).mapInArrow(
        lambda b: _prune_cells(b, threshold, tolerance), "bucket binary, band int, chunk int, chunks int, node long")
    alive = stored(within.unionByName(across).distinct(), "join-alive")
    some = reps.join(alive.select("node").distinct(), "node").select("rep", "key", "node")
    grams = texts.withColumnRenamed("doc_id", "rep").join(some, "rep").dropDuplicates(["rep", "node", "key", "text"]) \
        .mapInArrow(lambda b: _grams(b, words), "node long, grams binary")
    ready = alive.join(reps.select("node", "copies", "sig"), "node").join(grams, "node") \
        .withColumn("place", F.concat("bucket", F.encode(F.col("chunk").cast("string"), "UTF-8")))
    verified = stored(by_place(ready).mapInArrow(lambda b: _verify_chunks(b, threshold, tolerance), _FOUND_SCHEMA), "join-verified")
    crossing = _cell_rows(verified.where("packed"), ["node", "copies", "sig", "grams"], parts).mapInArrow(
        lambda b: _verify_cells(b, threshold, tolerance), "node long, links long, least long")
    found = stored(verified.where("NOT packed").select(F.explode("node").alias("node"), "links", "least").unionByName(crossing), "join-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_classes(found.select("node", "least"))
    nodes = reps.select("key", "node", "rep", "copies").join(links, "node", "left").join(classes, "node", "left") \
        .withColumn("class", F.coalesce("class", "node"))
    smallest = nodes.groupBy("class").agg(F.min("rep").alias("class_id"))
    named = nodes.join(smallest, "class").select(
        "key", "class_id", F.col("copies").alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return digests.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "key").join(named, "key").select(
        F.col("doc_id").alias(id_col), "class_id", "n_links", "n_copies", (F.col("doc_id") == F.col("class_id")).alias("kept")).unionByName(
        digests.where("n = 0 OR doc_id IS NULL").select(
            F.col("doc_id").alias(id_col), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
            F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("kept")))


def first_of_each_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class of near copies is kept, with all columns."""
    return rows_with_ids(docs, near_duplicates(docs).where("kept").select("doc_id").distinct(), "doc_id")
