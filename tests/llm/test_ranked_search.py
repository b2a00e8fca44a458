"""Operator 12 against scores computed one by one."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tillage.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    counted = [(doc_id, Counter(terms(text)), len(terms(text))) for doc_id, text in docs]
    n_docs = sum(n > 0 for _, _, n in counted)
    length = sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c, n in counted:
            if not n:
                continue
            m = 100 - 75 + (75 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id))
        out += [(item_id, k + 1, x[2], -x[0]) for k, x in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def result(docs, items, **kw):
    return sorted((tuple(r)[:4] for r in ranked_search.search_documents(docs, items, **kw).collect()), key=repr)


@pytest.mark.parametrize("segment_rows", [3, 40, 8192])
def test_ranking_of_many_ties(spark, segment_rows):
    rng = random.Random(3)
    vocabulary = [f"t{k}" for k in range(30)] + ["É", "ß", "Straße", "x1"]
    pick = lambda n: " ".join(rng.choices(vocabulary, weights=[60 // (k + 1) + 1 for k in range(len(vocabulary))], k=n))
    docs = [(1000 - k, pick(rng.choice([1, 3, 3, 10, 50]))) for k in range(120)] + [(5000 + k, "t3 t4 T5") for k in range(30)]
    items = [(k, pick(8)) for k in range(12)] + [(50, "t3 t4 t5"), (51, "nowhere"), (52, ""), (53, None), (50, "T0-t0 t0")]
    got = result(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, ITEMS), segment_rows=segment_rows)
    assert got == brute(docs, items)


def test_ranking_of_odd_texts(spark, odd_docs, no_docs):
    items = [(1, "w1x0 WORD1 word2 w3x1, Ключ 的"), (2, "a"), (None, "other long again x"), (3, "x" * 50_000), (4, "lost id"),
             (5, " ".join(f"word{k}" for k in range(2000)))]
    frame = spark.createDataFrame(items, ITEMS).selectExpr("*", "'odd' AS term", "'odd' AS score", "'odd' AS item")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert result(odd_docs, frame) == brute(docs, items)
    assert result(no_docs, frame) == [] and result(odd_docs, spark.createDataFrame([], ITEMS)) == []


def test_blocks_of_items_and_extra_columns(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 5)
    docs = [(k, f"a{k % 7} b{k % 11} c{k % 3}") for k in range(60)]
    items = [(k, f"a{k} b{k} c{k % 3}") for k in range(9)]
    assert result(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)) == brute(docs, items)


def test_reading_stops_early():
    """A rare term decides: the long list of the common one is not read to its end in a segment without the rare one."""
    n = 5000
    lists = {b"common": (list(range(n)), [1] * n), b"rare": ([17], [3])}
    row = ranked_search._packed(list(range(n)), [40 + k % 60 for k in range(n)], lists)
    (ready,) = ranked_search._sorted_by_impact(iter([row]), n, 70 * n)
    segment = ranked_search.Segment(ready.to_pylist()[0])
    places, scores, read = segment.search([(b"common", 10), (b"rare", 8000)], 4_000_000_000, 10)
    assert places == [17] and read < n + 1
    assert segment.search([(b"common", 10)], 4_000_000_000, 10)[2] == ranked_search.FIRST
    full = segment.search([(b"common", 10), (b"rare", 8000)], 0, 10)
    assert full[0][0] == 17 and (np.diff(full[1]) <= 0).all() and len(full[0]) == 10
