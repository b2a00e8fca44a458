"""Operator 1: token-id files with canonical length-limited Huffman codes.

File format (a folder that any Spark reader can open):

* ``codebook`` - one row: ``lengths`` (one byte per id, 0 = unused), ``max_bits``, ``width`` (bytes of an id).
  Codes are canonical: ids in order of (length, id) take consecutive code values.
* ``chunks`` - one row per run of documents in ascending id order: ``part`` and ``chunk`` give the order,
  ``start`` the ids before it in its part, ``doc_ids`` and ``n_tokens`` the documents, ``block_ids`` the ids per
  block, ``block_bits`` the bit offset of every block (the checkpoints), ``payload`` the bits.

A block can be decoded without the blocks before it: the decoder looks up ``max_bits`` bits at a time in
one table and walks all blocks of a chunk side by side.

Scale: texts are tokenised once; parts are ranges of the document id (bounds from quantiles of the id
column), so one shuffle orders the corpus. The driver sees one count per id of the vocabulary and one total
per part.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm.shared import arrow_batches, shuffle_parts, stored
from tillage.llm.tokens import worker_tokenizer

END_ID = 2
MAX_BITS = 18
BLOCK_IDS = 128
CHUNK_IDS = 1 << 18
ROWS_PER_PART = 100_000

_STAGED = "part int, chunk int, start long, doc_ids array<long>, n_tokens array<int>, ids binary"
_CHUNKS = ("part int, chunk int, start long, doc_ids array<long>, n_tokens array<int>, n_ids long, "
           "block_ids int, block_bits binary, payload binary")


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` bits for the used symbols (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError("more symbols than codes of max_bits bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels = []  # for each level, from the longest codes up: is the k-th cheapest item a leaf?
    packages = np.empty(0)
    for _ in range(max_bits):
        items = np.concatenate([leaves, packages])
        rank = np.argsort(items, kind="stable")
        levels.append(rank < len(leaves))
        items = items[rank]
        packages = items[0:len(items) // 2 * 2:2] + items[1:len(items) // 2 * 2:2]
    bits = np.zeros(len(order), dtype=np.int64)
    take = 2 * (len(order) - 1)
    for is_leaf in reversed(levels):
        n_leaves = int(is_leaf[:take].sum())
        bits[:n_leaves] += 1
        take = 2 * (take - n_leaves)
    lengths[order] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code value of every symbol: consecutive in order of (length, symbol)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    top = int(lengths.max()) if len(used) else 0
    steps = np.left_shift(np.uint64(1), (top - lengths[order]).astype(np.uint64))
    firsts = np.concatenate([[np.uint64(0)], np.cumsum(steps)[:-1]]) if len(order) else steps
    codes[order] = firsts.astype(np.uint64) >> (top - lengths[order]).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray, max_bits: int) -> np.ndarray:
    """For every string of ``max_bits`` bits the symbol it starts with, times 256, plus the symbol's length."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    bits = lengths[order].astype(np.int64)
    table = np.repeat((order.astype(np.int64) << 8) + bits, np.left_shift(1, max_bits - bits))
    if len(order):  # a single used symbol fills half of the table; the rest never occurs
        table = np.pad(table, (0, (1 << max_bits) - len(table)), mode="edge")
    return table.astype(np.uint32)


def encode_chunk(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray,
                 block_ids: int) -> tuple[bytes, np.ndarray]:
    """Payload of ``ids`` and the bit offset of every block of ``block_ids`` ids."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 64 + 2, dtype=np.uint64)
    if total:
        word, stop = starts >> 6, (starts & 63) + n
        value = codes[ids]
        over = np.maximum(stop - 64, 0).astype(np.uint64)
        here = np.where(stop <= 64, np.left_shift(value, np.maximum(64 - stop, 0).astype(np.uint64)), value >> over)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] = np.add.reduceat(here, first)
        cross = np.flatnonzero(stop > 64)  # at most one code crosses the end of a word
        words[word[cross] + 1] |= np.left_shift(value[cross], (128 - stop[cross]).astype(np.uint64))
    payload = words.astype(">u8").tobytes()[:(total + 7) // 8]
    return payload, starts[::block_ids]


def decode_chunk(payload: bytes, block_bits: np.ndarray, n_ids: int, block_ids: int, table: np.ndarray, max_bits: int) -> np.ndarray:
    """Ids of a chunk; every block starts at its checkpoint, all blocks advance together."""
    out = np.empty((block_ids, len(block_bits)), dtype=np.uint32)
    raw = np.frombuffer(payload + b"\0" * (16 - len(payload) % 4), dtype=">u4").astype(np.int64)
    # 63 bits from every 32-bit word on, so that any code of up to 31 bits lies in one of them.
    pairs = (raw[:-1] << 31) | (raw[1:] >> 1)
    at, mask, last = block_bits.astype(np.int64), (1 << max_bits) - 1, len(pairs) - 1
    for k in range(block_ids):
        # Blocks that have ended (only the last one can) run on into padding; their ids are cut off below.
        window = pairs[np.minimum(at >> 5, last)]
        window >>= (63 - max_bits) - (at & 31)
        window &= mask
        found = table[window]
        out[k] = found
        at += found & 255
    out >>= 8
    return out.T.reshape(-1)[:n_ids]


def _tokenise(batches: Iterator[pa.RecordBatch], vocabulary, end_id, bounds) -> Iterator[pa.RecordBatch]:
    tok = worker_tokenizer(vocabulary)
    end = np.array([end_id], dtype=tok.dtype).tobytes()
    for b in batches:
        ids = [x + end for x in tok.ids(b.column(1).to_pylist())]
        doc = b.column(0)
        part = np.searchsorted(bounds, doc.fill_null(0).to_numpy(zero_copy_only=False), side="left")
        part[doc.is_null().to_numpy(zero_copy_only=False)] = 0
        yield pa.record_batch([pa.array(part, pa.int32()), doc, pa.array(ids, pa.binary())],
                              names=["part", "doc_id", "ids"])


def _pack_chunks(batches: Iterator[pa.RecordBatch], width, chunk_ids) -> Iterator[pa.RecordBatch]:
    """Rows in order of (part, doc_id) become rows of up to ``chunk_ids`` ids (one document at least)."""
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("start", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("ids", pa.binary())])
    part, chunk, start, held, docs, sizes, data = None, 0, 0, 0, [], [], []

    def row():
        return pa.record_batch([[part], [chunk], [start], [docs], [sizes], [b"".join(data)]], schema=schema)

    for b in batches:
        for p, d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if docs and (p != part or held >= chunk_ids):
                yield row()
                chunk, start, held, docs, sizes, data = chunk + 1, start + held, 0, [], [], []
            if p != part:
                part, chunk, start = p, 0, 0
            docs.append(d)
            sizes.append(len(x) // width)
            data.append(x)
            held += len(x) // width
    if docs:
        yield row()


def _staged_ids(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if width == 2 else "<u4")


def _count_ids(batches: Iterator[pa.RecordBatch], width, size) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, dtype=np.int64)
    for b in batches:
        for blob in b.column(0).to_pylist():
            total += np.bincount(_staged_ids(blob, width), minlength=size)
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])


def _encode(batches: Iterator[pa.RecordBatch], width, lengths, block_ids) -> Iterator[pa.RecordBatch]:
    lengths = np.frombuffer(lengths, dtype=np.uint8)
    codes = canonical_codes(lengths)
    for b in batches:
        payloads, checkpoints, n = [], [], []
        for blob in b.column("ids").to_pylist():
            ids = _staged_ids(blob, width)
            payload, at = encode_chunk(ids, lengths, codes, block_ids)
            payloads.append(payload)
            # Checkpoints are kept as the bits of each block; their running sum gives the offsets.
            checkpoints.append(np.diff(at, prepend=0).astype("<u4").tobytes())
            n.append(len(ids))
        yield pa.record_batch(
            [b.column("part"), b.column("chunk"), b.column("start"), b.column("doc_ids"), b.column("n_tokens"),
             pa.array(n, pa.int64()), pa.array([block_ids] * len(n), pa.int32()),
             pa.array(checkpoints, pa.binary()), pa.array(payloads, pa.binary())],
            names=["part", "chunk", "start", "doc_ids", "n_tokens", "n_ids", "block_ids", "block_bits", "payload"])


def _decode(batches: Iterator[pa.RecordBatch], lengths, max_bits, offsets, digest) -> Iterator[pa.RecordBatch]:
    table = decode_table(np.frombuffer(lengths, dtype=np.uint8), max_bits)
    for b in batches:
        for r in range(b.num_rows):
            get = lambda c, r=r: b.column(c)[r].as_py()
            checkpoints = np.cumsum(np.frombuffer(get("block_bits"), dtype="<u4").astype(np.int64))
            ids = decode_chunk(get("payload"), checkpoints, get("n_ids"), get("block_ids"), table, max_bits)
            sizes = np.array(get("n_tokens"), dtype=np.int64)
            stops = np.cumsum(sizes)
            starts = stops - sizes
            first = offsets[get("part")] + get("start")
            columns = [pa.array(get("doc_ids"), pa.int64()), pa.array(starts + first), pa.array(sizes)]
            names = ["doc_id", "start", "n_tokens"]
            raw = ids.astype("<u4")
            if digest:
                view = memoryview(raw).cast("B")
                crc = [zlib.crc32(view[4 * s:4 * e]) for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]
                columns.append(pa.array(crc, pa.int64()))
                names.append("ids_crc32")
            else:
                at = pa.array(np.r_[0, stops], pa.int32())
                columns.append(pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.record_batch(columns, names=names)


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
              vocabulary: str | None = None, end_id: int = END_ID, max_bits: int = MAX_BITS) -> None:
    """Tokenise every text (null: empty), append ``end_id``, write Huffman files in ascending id order.

    Rows with a null id come first; rows that share an id follow each other in the order of their ids.
    An empty table gives an empty codebook and no chunks. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tok = worker_tokenizer(vocabulary)
    width, size = tok.dtype.itemsize, max(tok.size, end_id + 1)
    n_rows = docs.count()
    parts = max(shuffle_parts(spark), -(-n_rows // ROWS_PER_PART))
    shares = [k / parts for k in range(1, parts)]
    found = docs.select(F.percentile_approx("doc_id", shares, 10 * parts).alias("q")).first()["q"] if shares else []
    bounds = np.unique(np.array(found or [], dtype=np.int64))
    tokenised = docs.mapInArrow(lambda b: _tokenise(b, vocabulary, end_id, bounds), "part int, doc_id long, ids binary")
    ordered = tokenised.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    staged = stored(ordered.mapInArrow(lambda b: _pack_chunks(b, width, CHUNK_IDS), _STAGED), "token-ids")
    counted = (staged.select("ids").mapInArrow(lambda b: _count_ids(b, width, size), "id int, n long")
               .groupBy("id").agg(F.sum("n").alias("n")).collect())  # one row per id of the vocabulary
    counts = np.zeros(size, dtype=np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, max_bits).tobytes()
    spark.createDataFrame([(bytearray(lengths), max_bits, width)], "lengths binary, max_bits int, width int") \
        .coalesce(1).write.parquet(f"{path}/codebook")
    staged.mapInArrow(lambda b: _encode(b, width, lengths, BLOCK_IDS), _CHUNKS) \
        .write.option("compression", "uncompressed").parquet(f"{path}/chunks")


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of a folder written by :func:`write_ids`: doc_id, start, n_tokens and ``ids``
    (``digest``: the crc32 of the ids as little-endian 32-bit integers instead)."""
    arrow_batches(spark)
    book = spark.read.schema("lengths binary, max_bits int, width int").parquet(f"{path}/codebook").first()
    lengths, max_bits = bytes(book["lengths"]), book["max_bits"]
    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")
    offsets, before = {}, 0
    for r in chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row per part
        offsets[r["part"]] = before
        before += r["n"]
    last = "ids_crc32 long" if digest else "ids array<int>"
    return chunks.mapInArrow(lambda b: _decode(b, lengths, max_bits, offsets, digest),
                             f"doc_id long, start long, n_tokens long, {last}")
