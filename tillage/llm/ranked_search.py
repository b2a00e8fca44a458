"""Operator 12: ranked lexical search without random access (NRA) over impact-sorted lists.

The documents are cut into segments of at most ``SEGMENT`` rows. A segment's index holds, for every term of the items, the list of
its postings sorted by falling impact. An item is answered on a segment by reading its terms' lists from the front in steps
of growing depth. Every document met has a lower bound, the sum of what was read of it, and an upper bound, which adds for
every list where it was not met yet the impact at which that list stands. Reading goes on until no document that was not met
can reach the threshold, every document met is either below it or has equal bounds, and so membership, ties and scores are settled.

1. Segments: one pass over the texts counts the items' terms per document (bytes, table-driven splitting). No shuffle.
2. Global counts (N, L, df) come from the lengths of the segments' lists; then every segment is written again with
   its lists sorted by impact.
3. A first round reads ``BAR_DEPTH`` postings of every list. The 10th best lower bound over all segments is a threshold that
   the item's answer is known to reach, so most segments stop soon after.
4. NRA per segment and item against that threshold; the best 10 over all segments are the answer.

Scale: a segment is one row of a table and one unit of work; its size does not depend on the corpus. Items are answered in
blocks of about ``BLOCK_TERMS`` terms, whose terms and weights are the only broadcast.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillage.llm.shared import arrow_batches, stored, text_or_empty

TOP = 10
SEGMENT = 8192
SEGMENT_POSTINGS = 1 << 20
FIRST = 64
BAR_DEPTH = 2048
BLOCK_TERMS = 1 << 18
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Bytes of terms, A-Z lower-cased; all others separate. Bytes above 0x7F belong to characters of terms.
_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

SEGMENTS = "ids binary, known binary, lengths binary, n_docs long, n_terms long, terms array<binary>, counts binary, places binary, weights binary"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_BYTES).split()


def _packed(ids: list, lengths: list, lists: dict[bytes, tuple[list, list]]) -> pa.RecordBatch:
    """One segment as a row: documents, and per term the places and term frequencies."""
    terms = sorted(lists)
    each = [lists[t] for t in terms]
    row = [[np.array([0 if x is None else x for x in ids], dtype="<i8").tobytes()], [np.array([x is not None for x in ids], dtype="u1").tobytes()],
           [np.array(lengths, dtype="<i8").tobytes()], [sum(n > 0 for n in lengths)], [sum(lengths)],
           [terms], [np.array([len(p) for p, _ in each], dtype="<i4").tobytes()],
           [np.array([x for p, _ in each for x in p], dtype="<i4").tobytes()], [np.array([x for _, f in each for x in f], dtype="<i4").tobytes()]]
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SEGMENTS.split(", ")])


def _segments(batches: Iterator[pa.RecordBatch], wanted: frozenset, size: int) -> Iterator[pa.RecordBatch]:
    """Segments of the documents that come; one ends at ``size`` documents or ``SEGMENT_POSTINGS`` postings."""
    ids, lengths, lists, held = [], [], {}, 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            found = terms_of(text)
            counts = Counter(found)
            for t in counts.keys() & wanted:
                places, tf = lists.setdefault(t, ([], []))
                places.append(len(ids))
                tf.append(counts[t])
                held += 1
            ids.append(doc_id)
            lengths.append(len(found))
            if len(ids) >= size or held >= SEGMENT_POSTINGS:
                yield _packed(ids, lengths, lists)
                ids, lengths, lists, held = [], [], {}, 0
    if ids:
        yield _packed(ids, lengths, lists)


def _list_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): lengths of the segments' lists, added up per batch of rows."""
    for b in batches:
        total: Counter = Counter()
        for terms, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total.update(dict(zip(terms, np.frombuffer(counts, dtype="<i4").tolist(), strict=True)))
        yield pa.record_batch([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What a term's weight is multiplied with, for documents of ``n`` terms in which it occurs ``tf`` times."""
    m = 100 - 75 + (75 * n * docs) // max(length, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _sorted_by_impact(batches: Iterator[pa.RecordBatch], docs: int, length: int) -> Iterator[pa.RecordBatch]:
    """The segments with every list in order of falling impact, impacts in place of frequencies."""
    for b in batches:
        for k in range(b.num_rows):
            row = {c: b.column(c)[k].as_py() for c in ("lengths", "counts", "places", "weights")}
            counts, places = np.frombuffer(row["counts"], dtype="<i4"), np.frombuffer(row["places"], dtype="<i4")
            f = impacts(np.frombuffer(row["weights"], dtype="<i4").astype(np.int64),
                        np.frombuffer(row["lengths"], dtype="<i8")[places], docs, length).astype("<i4")
            order = np.lexsort((places, -f, np.repeat(np.arange(len(counts)), counts)))
            new = {"places": places[order].tobytes(), "weights": f[order].tobytes()}
            yield pa.record_batch([pa.array([new[c]], pa.binary()) if c in new else b.column(c).slice(k, 1) for c in b.schema.names],
                                  names=b.schema.names)


class Segment:
    """The lists of one segment, and NRA over them."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        self.known = np.frombuffer(row["known"], dtype="u1").astype(bool)
        self.at = {t: k for k, t in enumerate(row["terms"])}
        self.bounds = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], dtype="<i4"))]).tolist()
        self.places = np.frombuffer(row["places"], dtype="<i4")
        self.impacts = np.frombuffer(row["weights"], dtype="<i4").astype(np.int64)

    def lists(self, item: list[tuple[bytes, int]]) -> list[tuple[int, int, int]]:
        """(start, stop, weight) of the item's lists here; a weight of 0 adds nothing."""
        found = [(self.at[t], w) for t, w in item if w > 0 and t in self.at]
        return [(self.bounds[k], self.bounds[k + 1], w) for k, w in found]

    def first_bounds(self, item: list[tuple[bytes, int]], depth: int, top: int) -> np.ndarray:
        """The best lower bounds after ``depth`` postings of each list."""
        low = np.zeros(len(self.ids), dtype=np.int64)
        for start, stop, w in self.lists(item):
            part = slice(start, min(stop, start + depth))
            low[self.places[part]] += w * self.impacts[part]
        best = np.sort(low)[::-1][:top]
        return best[best > 0]

    def search(self, item: list[tuple[bytes, int]], least: int, top: int, first: int = FIRST) -> tuple[list[int], np.ndarray, int]:
        """(places, scores, postings read) of the documents that are among the segment's best ``top`` and reach ``least``."""
        lists = self.lists(item)
        low = np.zeros(len(self.ids), dtype=np.int64)
        stands = [w * int(self.impacts[start]) for start, _, w in lists]
        at = [start for start, _, _ in lists]
        going = [k for k, (start, stop, _) in enumerate(lists) if start < stop]
        alive = np.ones(len(low), dtype=bool)
        depth, read, bar, all_met = first, 0, max(least, 1), False
        while True:
            for k in going:
                start, stop, w = lists[k]
                part = slice(at[k], min(stop, start + depth))
                low[self.places[part]] += w * self.impacts[part]
                read += part.stop - part.start
                at[k], stands[k] = part.stop, w * int(self.impacts[part.stop - 1]) if part.stop < stop else 0
            depth *= 2
            # Enough lower bounds seen here raise the bar; what cannot reach it is not among the best ``top``.
            if len(low) > top:
                bar = max(bar, int(np.partition(low, len(low) - top)[len(low) - top]))
            unread = [k for k in range(len(lists)) if at[k] < lists[k][1]]
            high = low + sum(stands)
            for k in unread:
                high[self.places[lists[k][0]:at[k]]] -= stands[k]
            alive &= high >= bar
            if sum(stands) < bar:  # a document that was not met yet stays below the bar, so only those met are followed
                all_met = True
            left = int(alive.sum())
            if not unread or (all_met and (high[alive] == low[alive]).all()):
                break
            # Once all are met only those lists matter in which a document that is left was not met.
            going = [k for k in unread if not all_met or int(alive[self.places[lists[k][0]:at[k]]].sum()) < left]
        alive &= low > 0
        found = np.flatnonzero(alive)
        scores = low[found]
        order = np.lexsort((self.ids[found], ~self.known[found], -scores))[:top]
        return found[order].tolist(), scores[order], read


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for b in batches:
        for row in b.select(["ids", "known", "terms", "counts", "places", "weights"]).to_pylist():
            yield Segment(row)


def _first(batches: Iterator[pa.RecordBatch], items: dict[int, list], depth: int, top: int) -> Iterator[pa.RecordBatch]:
    for segment in _rows(batches):
        found = [(i, x) for i, item in items.items() for x in segment.first_bounds(item, depth, top).tolist()]
        yield pa.record_batch([pa.array([i for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["item", "low"])


def _search(batches: Iterator[pa.RecordBatch], items: dict[int, list], least: dict[int, int], top: int) -> Iterator[pa.RecordBatch]:
    for segment in _rows(batches):
        out = []
        for i, item in items.items():
            places, scores, read = segment.search(item, least.get(i, 0), top)
            held = sum(stop - start for start, stop, _ in segment.lists(item))
            out += [(i, int(segment.ids[p]) if segment.known[p] else None, s, None, None) for p, s in zip(places, scores.tolist(), strict=True)]
            out.append((i, None, None, read, held))
        kinds = [pa.int64()] * 5
        yield pa.record_batch([pa.array([r[k] for r in out], kinds[k]) for k in range(5)], names=["item", "doc_id", "score", "read", "held"])


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term, times): the terms of every row of ``items``; ``item`` numbers the rows."""
    lower = F.translate(text_or_empty(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), lower.alias("text")), "search-items")
    return rows.select("item", "item_id", F.explode(F.regexp_extract_all("text", F.lit(TERM), 0)).alias("term")) \
        .groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def _search_block(docs: DataFrame, terms: DataFrame, top: int, segment_rows: int) -> DataFrame:
    """(item, doc_id, score, read, held) of one block of items, best documents of each segment and what was read."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    wanted = sc.broadcast(frozenset(bytes(r["t"]) for r in terms.select(F.encode("term", "UTF-8").alias("t")).distinct().collect()))
    segments = stored(docs.mapInArrow(lambda b: _segments(b, wanted.value, segment_rows), SEGMENTS), "search-segments")
    total = segments.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("length")).first()
    n_docs, length = total["docs"] or 0, total["length"] or 0
    df = segments.select("terms", "counts").mapInArrow(_list_lengths, "term binary, n long").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = terms.join(df.select(F.decode("term", "UTF-8").alias("term"), weight.alias("weight")), "term")
    lists: dict[int, list] = {}
    for r in weighed.select("item", F.encode("term", "UTF-8").alias("t"), (F.col("times") * F.col("weight")).alias("w")).sort("item", "term").collect():
        lists.setdefault(r["item"], []).append((bytes(r["t"]), r["w"]))
    items = sc.broadcast(lists)
    index = stored(segments.mapInArrow(lambda b: _sorted_by_impact(b, n_docs, length), SEGMENTS), "search-index")
    best = Window.partitionBy("item").orderBy(F.desc("low"))
    lows = index.mapInArrow(lambda b: _first(b, items.value, BAR_DEPTH, top), "item long, low long")
    bars = lows.withColumn("k", F.row_number().over(best)).where(F.col("k") == top)
    least = sc.broadcast({r["item"]: r["low"] for r in bars.collect()})  # one number per item of the block
    return index.mapInArrow(lambda b: _search(b, items.value, least.value, top), "item long, doc_id long, score long, read long, held long")


def search_documents(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                     item_id: str = "item_id", item_text: str = "text", segment_rows: int = SEGMENT) -> DataFrame:
    """The ``top`` documents of every row of ``items``: item id, ``rank``, id, ``score``, ``postings_read``, ``postings_held``.

    The last two are the same for all rows of an item: what NRA read of its lists, and their whole length. Ties go to the smaller
    id, null ids last; rows that repeat an id are separate documents, rows that repeat an item id separate items. Null and empty
    texts have no terms: such documents do not count, such items have no rows, and neither do items of which no term occurs.
    A term in every document weighs 0. Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    terms = stored(item_terms(items, item_id, item_text), "search-terms")
    blocks = terms.count() // BLOCK_TERMS + 1
    found = None
    for k in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        part = _search_block(texts, mine, top, segment_rows)
        found = part if found is None else found.unionByName(part)
    found = stored(found, "search-found")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.where("score IS NOT NULL").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    read = found.groupBy("item").agg(F.sum("read").alias("postings_read"), F.sum("held").alias("postings_held"))
    names = terms.select("item", "item_id").distinct()
    return ranked.drop("read", "held").join(read, "item").join(names, "item").select(
        F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(id_col), "score", "postings_read", "postings_held")


# The same ranking in DuckDB, every score computed.
RANKED_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(terms)) AS BIGINT) AS big_l FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf, any_value(n) AS n FROM (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(big_n) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term),
f AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l))) AS s FROM p JOIN w USING (term), g),
s AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM q JOIN f USING (term) GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
