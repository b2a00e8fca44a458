"""Operator 8: best-fit packing certified by dual feasible functions.

Documents become pieces of at most ``capacity`` tokens (a longer document is cut into full pieces and a last one). The
pieces are dealt over partitions of about ``PART_ITEMS`` pieces by hash; each partition is packed by best-fit
decreasing, and dual feasible functions give a number of sequences that no packing of the partition can go below.
A partition that reaches its bound is proved optimal and done. The other partitions exchange the pieces of their sequences
that are not full: these are dealt anew and packed again, as long as that saves sequences.

Scale: texts are read once; a piece moves as one narrow row. A partition's work is bounded by its number of pieces, whatever the
number of rows, and no document's pieces have to meet.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.shared import arrow_batches, shuffle_parts, stored
from tillage.llm.tokens import worker_tokenizer

CAPACITY = 2048
END_ID = 0
PART_ITEMS = 32_768

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long, fill int, gap int"


def _cut(batches: Iterator[pa.RecordBatch], vocabulary, end_id, capacity) -> Iterator[pa.RecordBatch]:
    tok = worker_tokenizer(vocabulary)
    end = np.array([end_id], dtype=tok.dtype).tobytes()
    for b in batches:
        rows = [], [], [], [], []
        for doc, raw in zip(b.column(0).to_pylist(), tok.ids(b.column(1).to_pylist()), strict=True):
            ids = np.frombuffer(raw + end, tok.dtype).astype("<u4")
            for piece, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start:start + capacity]
                for column, x in zip(rows, (doc, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                    column.append(x)
        types = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
        yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, types, strict=True)],
                              names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every text (null: empty) with its end id: doc_id, piece, start, length, ids_crc32."""
    arrow_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(lambda b: _cut(b, vocabulary, end_id, capacity), _PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that no packing can go below: the largest bound of two families of dual feasible functions."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    # Above capacity - t a piece fills a sequence, below t it counts nothing.
    tokens, above = np.cumsum(count * x), count[::-1].cumsum()[::-1]
    for t in range(capacity // 2 + 1):
        large = int(above[capacity - t + 1]) if t else 0
        middle = int(tokens[capacity - t] - (tokens[t - 1] if t else 0))
        best = max(best, large + -(-middle // capacity))
    # (k + 1) x / capacity rounded down to whole k-ths, unless it is whole already.
    for k in range(1, 100):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece and the fill of every sequence. Largest first, into the fullest sequence
    that still has room."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by free tokens
    open_rooms = 0  # bit r is set if a sequence has r free tokens
    n = 0
    fills: list[int] = []
    for k, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_rooms >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            s = room[free].pop()
            if not room[free]:
                open_rooms ^= 1 << free
        else:
            s, free = n, capacity
            n += 1
            fills.append(0)
        sequence[k], offset[k] = s, capacity - free
        fills[s] += size
        left = free - size
        if left:
            if not room[left]:
                open_rooms |= 1 << left
            room[left].append(s)
    return sequence, offset, np.array(fills, dtype=np.int64)


def _pack(table: pa.Table, capacity: int) -> pa.Table:
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    lengths = table.column("length").to_numpy().astype(np.int64)
    sequence, offset, fills = best_fit_decreasing(lengths, capacity)
    gap = len(fills) - lower_bound(lengths, capacity)
    part, rnd = table.column("part")[0].as_py(), table.column("round")[0].as_py()
    cols = {c: table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
    return pa.table(cols | {"sequence_id": pa.array((rnd << 52) + (part << 28) + sequence), "offset": pa.array(offset),
                            "fill": pa.array(fills[sequence], pa.int32()), "gap": pa.array(np.full(len(lengths), gap), pa.int32())})


def _pack_round(items: DataFrame, n: int, rnd: int, capacity: int, part_items: int) -> DataFrame:
    parts = max(1, -(-n // part_items))
    dealt = items.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(rnd).cast("long").alias("round"),
                         # Dealt by the row's place in the written table, so that repeated rows are spread as well.
                         F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(rnd)), F.lit(parts)).alias("part"))
    return stored(dealt.repartition(max(parts, min(parts * 2, shuffle_parts(items.sparkSession))), "part").groupBy("part")
                  .applyInArrow(lambda t: _pack(t, capacity), _PACKED), f"packing-{rnd}")


def pack(items: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS, rounds: int | None = None) -> DataFrame:
    """Sequences of the rows of ``items``, a written table with the columns of :func:`pieces`: adds sequence_id and offset.

    Exchange goes on until a round saves nothing or all partitions meet their bound; ``rounds`` may bound it.
    Lengths must lie between 1 and ``capacity``. A sequence has no gaps: its pieces' offsets follow each other from 0.
    """
    done = None
    now = _pack_round(items, items.count(), 0, capacity, part_items)
    for rnd in count(1) if rounds is None else range(1, rounds + 1):
        open_now = now.where((F.col("gap") > 0) & (F.col("fill") < capacity))
        closed = now.where((F.col("gap") <= 0) | (F.col("fill") >= capacity))
        n, before = open_now.agg(F.count(F.lit(1)), F.count_if(F.col("offset") == 0)).first()
        if not n:
            break
        again = _pack_round(open_now, n, rnd, capacity, part_items)
        if again.where("offset = 0").count() >= before:
            break
        done = closed if done is None else done.unionByName(closed)
        now = again
    packed = now if done is None else done.unionByName(now)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Every token of every document in as few sequences as the method finds: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A null text is empty and has its end id only; rows with a null id or a repeated id are packed like any other. An empty
    table gives an empty result; other columns are ignored.
    """
    return pack(stored(pieces(docs, capacity, vocabulary, END_ID, id_col, text_col), "packing-pieces"), capacity)


def token_ids(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) of the same documents, from which a writer fills the sequences of :func:`pack_documents`."""
    arrow_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(vocabulary)
        for b in batches:
            ids = [[*np.frombuffer(raw, tok.dtype).tolist(), end_id] for raw in tok.ids(b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids array<int>")
