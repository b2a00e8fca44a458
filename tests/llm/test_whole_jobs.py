"""Operators 4, 6, 8 and 9 do the whole job: losses, repeated ids, exchange to the end, the ledger kept."""
from math import comb

import numpy as np

from tillage.llm import ngram_join, packing, pivot_index, secret_ledger
from tillage.llm.catalog import op9_secret_ledger
from tillage.llm.shared import stored


def test_near_copies_lost_at_the_threshold():
    s, n = ngram_join.THRESHOLD, ngram_join.BANDS * ngram_join.ROWS
    alive = {0: 1.0}
    for k in range(ngram_join.STEP, n + 1, ngram_join.STEP):
        new = {}
        for m, p in alive.items():
            for j in range(ngram_join.STEP + 1):
                new[m + j] = new.get(m + j, 0) + p * comb(ngram_join.STEP, j) * s ** j * (1 - s) ** (ngram_join.STEP - j)
        alive = {m: p for m, p in new.items() if m >= ngram_join.least_matches(k, s, ngram_join.TOLERANCE)}
    assert (1 - s ** ngram_join.ROWS) ** ngram_join.BANDS + 1 - sum(alive.values()) < 2e-7


def test_rows_that_share_an_id_all_take_part(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(k % 150, rng.normal(size=6).astype(np.float32).tolist()) for k in range(300)] + [(3, [9.0] * 6)] * 40 + [(20, [9.0] * 6)]
    whole = [(k, [int(np.floor(1024 * float(c))) for c in x]) for k, x in rows]
    want = []
    for q in {k for k, _ in whole if k % 20 == 0}:
        pairs = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for k, x in whole if k == q for i, v in whole if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(pairs[:10])]
    got = pivot_index.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=20).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_exchange_goes_on_while_it_saves(spark, monkeypatch):
    """A stand-in for a round leaves one sequence fewer each time, up to the sixth."""
    left = iter(range(20, 13, -1))
    rounds = []

    def fake(items, n, rnd, capacity, part_items):
        rounds.append(rnd)
        k = max(next(left, 14), 14)
        return spark.range(k).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1L AS length", "0L AS ids_crc32",
                                         f"{rnd}L * 100 + id AS sequence_id", "0L AS offset", "1 AS fill", "1 AS gap")

    monkeypatch.setattr(packing, "_pack_round", fake)
    assert packing.pack(spark.range(20)).count() == 14
    assert rounds == list(range(8))


def test_ledger_at_a_path_is_read_and_appended(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"token=abcdef{k % 6} -----BEGIN PRIVATE KEY-----") for k in range(9)], "doc_id long, text string")
    path = str(tmp_path / "ledger")
    half = secret_ledger.scan_secrets(docs.where("doc_id < 4"), path)
    assert half.count() == 4 and secret_ledger.read_ledger(spark, path).count() == 4
    got = sorted(map(tuple, secret_ledger.scan_secrets(docs, path).collect()))
    assert got == sorted(map(tuple, secret_ledger.scan_secrets(docs).collect()))
    assert secret_ledger.read_ledger(spark, path).count() == 6
    secret_ledger.append_new(docs, path)
    assert secret_ledger.read_ledger(spark, path).count() == 6


def test_the_query_keeps_one_ledger_for_both_rule_sets(spark, monkeypatch):
    seen = []
    real = secret_ledger.append_new
    monkeypatch.setattr(secret_ledger, "append_new", lambda d, path, *a, **kw: (real(d, path, *a, **kw), seen.append(path)))
    assert op9_secret_ledger(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert len(set(seen)) == 1
    rows = secret_ledger.read_ledger(spark, seen[0]).groupBy("rules").count().collect()
    assert len(rows) == 2 and len({r["count"] for r in rows}) == 1
