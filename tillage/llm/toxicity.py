"""Operator 10: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text becomes the set of its hashed words, word pairs and pairs that skip one word. FTRL-proximal learns one weight per hash
with its own rate; the L1 term keeps most weights at exactly zero, so the model is a short list of (hash, weight) that fits
into every task.

Scale: the labelled rows are sampled down to ``SAMPLE`` (a documented bound: the smallest hashes of their ids) and their hashes
to ``SAMPLE_HASHES``, so the fit is one small task whatever the input; their features are computed in parallel. Scoring reads every text once, in a narrow pass
without a shuffle.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm.shared import arrow_batches, stored

BITS = 20
SAMPLE = 20_000
SAMPLE_HASHES = 1 << 26  # of the sampled rows' hashes, 4 bytes each: what the fit holds at most
EPOCHS = 6
# A strong L1 term with high rates: word pairs are mostly noise, and only hashes that keep telling survive.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
FOLDS = 5

_WORD = re.compile(r"\w+")


class _WordHashes(dict):
    """crc32 of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode())
        return value


_HASHES = _WordHashes()


def hashes(text: str | None) -> np.ndarray:
    """Hashes (``BITS`` bits) of the lower-case words, word pairs and skip pairs of a text, repeats included."""
    words = _WORD.findall((text or "").lower())
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    parts = [h * np.uint64(0x9E3779B97F4A7C15)]
    for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        if len(h) > gap:
            parts.append((h[:-gap] * np.uint64(salt) ^ (h[gap:] + np.uint64(gap))) * np.uint64(0x9E3779B97F4A7C15))
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.uint32)


def features(text: str | None) -> np.ndarray:
    """The set of a text's hashes, sorted."""
    return np.unique(hashes(text))


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA,
             l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights by hash, with the bias in the last place, after ``epochs`` passes over the rows in order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((beta + np.sqrt(n[at])) / alpha + l2))

    bias = np.array([1 << BITS], dtype=np.uint32)
    for _ in range(epochs):
        for row, y in zip(rows, labels.tolist(), strict=True):
            at = np.concatenate([row, bias])
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - rate * w
            n[at] += g * g
    return weights(slice(None))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text leaves the remainder 0: such rows are never learnt from. Null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [features(t).tobytes() for t in b.column(2).to_pylist()]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["place", "label", "hashes"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights from rows in order of their places; rows that would take the hashes over ``SAMPLE_HASHES`` are left out."""
    rows, labels, held = [], [], 0
    for b in batches:
        for raw, label in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True):
            if held + len(raw) // 4 <= SAMPLE_HASHES:
                held += len(raw) // 4
                rows.append(np.frombuffer(raw, np.uint32))
                labels.append(label)
    if rows:
        w = fit_ftrl(rows, np.array(labels, dtype=np.float64))
        used = np.flatnonzero(w)
        used = np.union1d(used, [1 << BITS])  # the bias, even if zero, tells a model from none
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(w[used], pa.float32())], names=["hash", "weight"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Model rows (hash, weight) from a bounded sample of the labelled rows that are not held out.

    ``labels`` has doc_id and toxic; rows with a null in either take no part, an id labelled twice is toxic if one label says so. Without
    usable rows the model is empty.
    """
    arrow_batches(docs.sparkSession)
    place = F.xxhash64("doc_id")
    usable = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("label")).where(
        "doc_id IS NOT NULL AND label IS NOT NULL").where(~held_out(F.col("doc_id")))
    # limit(sample) bounds this table to `sample` rows of 20 bytes, which may be sent to all tasks.
    chosen = usable.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("place", place).orderBy("place", "doc_id").limit(sample)
    chosen = stored(chosen, "toxic-sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("place", "label", "text").mapInArrow(
        _extract, "place long, label int, hashes binary").dropDuplicates(["place"])
    return stored(rows.repartition(1).sortWithinPartitions("place").mapInArrow(_fit, "hash int, weight float"), "toxic-model")


def _dense(used: np.ndarray, values: np.ndarray) -> np.ndarray | None:
    if not len(used):
        return None
    w = np.zeros((1 << BITS) + 1, dtype=np.float64)
    w[used] = values
    return w


def _scores(texts: list[str | None], w: np.ndarray | None) -> np.ndarray:
    if w is None:
        return np.zeros(len(texts))
    total = np.full(len(texts), w[-1])
    for k, t in enumerate(texts):
        h = hashes(t)
        h = h[w[h] != 0]
        if len(h):
            total[k] += w[np.unique(h)].sum()
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _score(batches: Iterator[pa.RecordBatch], used: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    w = _dense(used, values)
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array(_scores(b.column(1).to_pylist(), w), pa.float64())], names=["doc_id", "score"])


def _clean(batches: Iterator[pa.RecordBatch], used: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    w = _dense(used, values)
    for b in batches:
        yield b.filter(pa.array(_scores(b.column("text").to_pylist(), w) < 0.5))


def _model(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights on the driver: at most 2^BITS + 1 rows of 8 bytes, far fewer by the L1 term."""
    rows = model.orderBy("hash").toPandas()
    return rows["hash"].to_numpy(dtype=np.int64), rows["weight"].to_numpy(dtype=np.float64)


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, score) of every row; null texts are scored as empty, without a model every score is 0."""
    arrow_batches(docs.sparkSession)
    used, values = _model(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda b: _score(b, used, values), f"doc_id {kind}, score double")


def judge_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from a score of 0.5).

    Null and empty texts are scored by the bias alone. Repeated rows get the same score each, a null id counts as held out. An
    empty table gives an empty result; other columns are ignored.
    """
    return score(docs, train(docs, labels, sample)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns; a narrow pass, row by row."""
    arrow_batches(docs.sparkSession)
    used, values = _model(train(docs, labels))
    return docs.mapInArrow(lambda b: _clean(b, used, values), docs.schema)
