"""Operators 6 and 7 against brute force."""
import numpy as np
from pyspark.sql import functions as F

from tillage.llm import bloom_cascade, pivot_index


def brute_top(rows, every, k=10):
    whole = {}
    for r in rows:
        x = r["embedding"]
        if r["vec_id"] is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        v = [int(np.floor(1024 * float(c))) for c in x]
        whole[r["vec_id"]] = min(v, whole.get(r["vec_id"], v))
    out = set()
    for q in whole:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def test_top_k_edges(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=6) / 3 + (k % 3)).astype(np.float32).tolist(), "odd") for k in range(300)]
    rows += [(k, rows[0][1], "odd") for k in range(300, 360)]  # one common vector: ties
    rows += [(400, None, "x"), (401, [1.0, None], "x"), (402, [float("nan")] * 6, "x"), (403, [float("inf")] * 6, "x"), (None, rows[1][1], "x"),
             (404, [], "x"), (500, [0.5], "x"), (7, rows[7][1], "x"), (600, [90000.0] * 6, "x")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string").withColumn("pivot", F.lit(1))
    got = {tuple(r) for r in pivot_index.top_k(d, every=20).collect()}
    assert got == brute_top(d.collect(), 20)


def test_top_k_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (100, [1.0, 2.0]), (5, [0.0, -1.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in pivot_index.top_k(few).collect()} == brute_top(few.collect(), 100)
    assert pivot_index.top_k(few.limit(0)).count() == 0


URLS = ["http://a.example.org/es/x?q#f", "https://EXAMPLE.org/en/1", "https://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/a",
        "http://x.com/fr", "http://com/de/1", "http://telecom/de/1", "http://example.net/p?utm_source=a", "http://example.net/p", "http://example.net/q#://r",
        "no scheme", "", None, "://", "ftp://h", "http://Äx.ORG?x", "http://example.net/p"]


def judged(d, **how):
    return sorted((tuple(r) for r in bloom_cascade.judge_urls(d, bloom_cascade.tracked(F.col("url")), **how).collect()), key=repr)


def test_rules_and_list(spark):
    d = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("key", F.lit("odd")).withColumn("host", F.lit("odd"))
    rows = {r[0]: r[1:] for r in judged(d)}
    assert len(rows) == len(URLS)
    assert rows[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert rows[1] == ("example.org", "/en/1", "example.org/en/1", "block")
    assert rows[2] == ("example.org", "/en/2", "org/", "allow")
    assert rows[3] == ("notexample.org", "/es/", "org/", "allow")
    assert rows[4][2:] == ("com/fr/", "allow") and rows[5][2:] == (None, "allow") and rows[6][2:] == ("com/de/", "block") and rows[7][2:] == (None, "allow")
    assert rows[8][2:] == (None, "block") and rows[9][2:] == (None, "block") and rows[17][2:] == (None, "block") and rows[10] == ("example.net", "/q", None, "allow")
    assert rows[11] == ("", "", None, "allow") and rows[13] == ("", "", None, "allow") and rows[15] == ("h", "", None, "allow")
    assert rows[16] == ("Äx.org", "", None, "allow")
    assert judged(d, broadcast_bytes=-1, salt_rows=3) == judged(d)
    assert judged(d.limit(0)) == []


def test_cascade_is_exact_over_shards(spark, monkeypatch):
    monkeypatch.setattr(bloom_cascade, "SHARD_KEYS", 500)
    d = spark.range(6000).selectExpr("id AS page_id", "concat('http://h', id % 40, '.net/', id, if(id % 7 = 0, '?utm_source=x', '')) AS url")
    for how in ({}, {"broadcast_bytes": -1}):
        assert all((r[4] == "block") == (r[0] % 7 == 0) for r in judged(d, **how))


def test_cascade_sides():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 3000, dtype=np.uint64) for _ in range(2))
    for share in (0.0, 0.01, 0.5, 1.0):
        listed = rng.random(3000) < share
        levels = [(n, h, np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool)) for n, h, f in bloom_cascade.build_cascade(a, b, listed)]
        assert (bloom_cascade.is_listed(levels, a, b) == listed).all()
