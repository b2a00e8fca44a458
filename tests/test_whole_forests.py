"""Forests of all training rows at any size: in one task, and by parts of their trees."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tillage.catalog import q_model as Q
from tillage.plans import forest_parts as P
from tillage.plans import leave_out as L
from tillage.plans import many_models as MM
from tillage.plans import regress as G
from tillage.plans.tree_growth import grow_deep
from tillage.session import discard, written


class _Seen(Exception):
    pass


@pytest.mark.parametrize("query", [Q.m4_models, Q.m5_models, Q.m9, Q.m12, Q.m22])
def test_forests_of_registered_queries_take_every_row(spark, monkeypatch, query):
    asked = []

    def stop(rows, models):
        asked.extend(models)
        raise _Seen
    monkeypatch.setattr(MM, "fit_and_score", stop)
    with pytest.raises(_Seen):
        query(spark, SF001)
    forests = [m for m in asked if m.kind == "forest"]
    assert forests and all(MM._takes_all(m) for m in forests)


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(3000).selectExpr("id", "id % 5 AS fold", "(id * 7919) % 50 AS a", "(id * 104729) % 11 AS b")
    return d.selectExpr("id", "fold", "CAST(1000 + 50 * a - 40 * b + sin(id) * 100 AS double) AS y", "array(CAST(a AS double), CAST(b AS double)) AS x")


def _models():
    held = F.col("fold") == 0
    return [MM.boosted("b", ~held, F.lit(True), rounds=3), MM.forest("f", ~held, F.lit(True), trees=3, every_row=True),
            MM.forest("g", ~held, held, trees=2, every_row=True, clip=(900.0, 2000.0), depth=6, seed=7), MM.forest("none", F.lit(False), held, trees=2, every_row=True)]


def test_trees_by_parts_are_those_of_one_machine(spark, rows, monkeypatch):
    monkeypatch.setattr(MM, "BLOCK", 300)
    monkeypatch.setattr(MM, "FOREST_CELLS", -1)
    monkeypatch.setattr(P, "PART", 400)
    monkeypatch.setattr(P, "ROWS_A_RUN", 5000)  # two trees a run
    kept = []
    blocks_of = MM.binned_blocks
    monkeypatch.setattr(MM, "binned_blocks", lambda *a: kept.append(blocks_of(*a)) or kept[-1])
    models = _models()
    got = {(r["model"], r["id"]): r["p"][0] for r in MM.fit_and_score(rows, models).collect()}
    assert len(got) == 2 * 3000 + 600 + 600 and all(p == 0 for (k, _), p in got.items() if k == 3)
    offsets = kept[0].offsets
    blocks = {r["block"]: MM._block(r.asDict(), 2) for r in sorted(kept[0].table.collect(), key=lambda r: r["block"])}
    for k in (1, 2):
        m, ids, p = models[k], [], 0
        n = np.array([int(MM._has(b["train"], k).sum()) for b in blocks.values()])
        bins, y, ids = (np.concatenate([b[c] for b in blocks.values()]) for c in ("bins", "y", "ids"))
        for t in range(m.rounds):
            draws = np.random.default_rng([m.seed, k, t]).multinomial(n.sum(), n / n.sum())
            top = P.Top(k, t, m.seed, m.depth, dict(zip(blocks, draws.tolist(), strict=True)), 0.0, offsets)
            w = np.concatenate([top.drawn(at, MM._has(b["train"], k)) for at, b in blocks.items()])
            assert w.sum() == n.sum() == 2400 and (w[ids % 5 == 0] == 0).all()
            p = p + grow_deep(bins, offsets, MM._target(y, m), w, m.depth).predict(bins) / m.rounds
        there = [(i, v) for i, v in zip(ids.tolist(), p.tolist(), strict=True) if (k, i) in got]
        assert len(there) == (3000 if k == 1 else 600)
        assert np.mean([abs(got[k, i] - v) < 1e-6 for i, v in there]) > 0.99  # of cuts of the same gain either may be taken


def test_forest_by_parts_with_equal_targets_and_nothing_to_part(spark, rows, monkeypatch):
    monkeypatch.setattr(MM, "FOREST_CELLS", -1)
    monkeypatch.setattr(P, "PART", 100)
    every = F.lit(True)
    got = MM.fit_and_score(rows.withColumn("y", F.lit(7.0)), [MM.forest("f", every, every, trees=2, every_row=True)])
    assert [(r["n"], r["lo"], r["hi"]) for r in got.agg(F.count("id").alias("n"), F.min(F.get("p", F.lit(0))).alias("lo"), F.max(F.get("p", F.lit(0))).alias("hi")).collect()] == [(3000, 7.0, 7.0)]


def test_small_tables_reach_their_jobs_without_a_shuffle_a_job(spark, rows, monkeypatch):
    here = {(r["model"], r["id"]): r["p"][0] for r in MM.fit_and_score(rows, _models()[:2]).collect()}
    codes = MM.FOREST_CELLS
    monkeypatch.setattr(MM, "FOREST_CELLS", 0)
    monkeypatch.setattr(P, "PART", 1 << 30)
    shuffled = {(r["model"], r["id"]): r["p"][0] for r in MM.fit_and_score(rows, _models()[:1]).collect()}
    assert codes > 0 and all(abs(here[k] - p) < 1e-9 * abs(p) for k, p in shuffled.items()) and len(shuffled) == 3000


def test_discarded_tables_leave_the_disk(spark):
    a, b = (written(spark.range(10), n) for n in ("one", "two"))
    at = [x.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] for x in (a, b)]
    discard(a)
    assert [os.path.exists(x) for x in at] == [False, True] and b.count() == 10


def test_folds_take_every_row_too(spark):
    assert L._tree_model(G.Forest(), "f", F.lit(True), F.lit(True)).every_row and G.Stack().forest.every_row
