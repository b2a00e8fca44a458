"""Large models in one task, light passes, and MLlib's tree models on the side-by-side plan."""
import pickle

import numpy as np
from pyspark.sql import functions as F

from tillage.plans import classify as C
from tillage.plans import many_models as MM
from tillage.plans import regress as G
from tillage.plans.tree_growth import Boosting, boost_here


def _rows(spark):
    d = spark.range(2000).selectExpr("id", "(id * 7919) % 50 AS a", "(id * 104729) % 11 AS b")
    return d.selectExpr("id", "CAST(1000 + 50 * a - 40 * b + (id * 17) % 13 AS double) AS y", "array(CAST(a AS double), CAST(b AS double)) AS x")


def _found(rows, models):
    return {(r["model"], r["id"]): r["p"][0] for r in MM.fit_and_score(rows, models).collect()}


def test_boosting_of_many_blocks_is_one_job_unless_too_large(spark, monkeypatch):
    every = F.lit(True)
    models = [MM.boosted("b", every, every, rounds=8, rate=0.3), MM.quantile("q", every, every, 0.9, rounds=8, rate=0.3)]
    monkeypatch.setattr(MM, "BLOCK", 300)
    monkeypatch.setattr(MM, "BLOCKS_HERE", 1)
    asked = []
    by_passes = MM.boost_by_passes
    monkeypatch.setattr(MM, "boost_by_passes", lambda blocks, m, which: asked.append(which) or by_passes(blocks, m, which))
    here = _found(_rows(spark), models)
    assert asked == [] and len(here) == 4000
    monkeypatch.setattr(MM, "CELLS_HERE", 0)
    monkeypatch.setattr(MM, "REFRESH", 3)
    passes = _found(_rows(spark), models)
    assert asked == [[0, 1]] and set(passes) == set(here)
    assert all(abs(p - passes[k]) <= 1e-6 * (1 + abs(p)) for k, p in here.items())


def test_a_forest_of_every_row_leaves_no_block_out(spark, monkeypatch):
    monkeypatch.setattr(MM, "BLOCK", 100)
    monkeypatch.setattr(MM, "BLOCKS_HERE", 1)
    # One bootstrap of all 2,000 rows fits each of the 550 (a, b) cells far better than one of 100 rows.
    every = F.lit(True)
    y = {r["id"]: r["y"] for r in _rows(spark).collect()}
    p = _found(_rows(spark), [MM.forest("all", every, every, trees=10, every_row=True), MM.forest("some", every, every, trees=10)])
    far = [np.mean([abs(v - y[i]) for (m, i), v in p.items() if m == k]) for k in (0, 1)]
    assert far[0] < 10 and far[0] < far[1] / 2


def test_tasks_get_neither_sums_nor_old_rounds():
    rng = np.random.default_rng(0)
    bins = rng.integers(0, 200, (5000, 30)).astype("u1")
    model = Boosting(np.arange(31) * 200, "softmax", rounds=4, classes=5, depth=4, min_leaf=5)
    y = (bins[:, 0] // 41).astype(float)
    boost_here(model, bins, y, np.ones(len(y)))
    model.rounds = 5
    model._next_round()
    raw = model.scores(bins)
    model.advance(model.measure(bins, y, np.ones(len(y)), raw)[1])
    sent = model.for_tasks(4)
    assert len(pickle.dumps(sent)) < 20_000 < len(pickle.dumps(model))
    whole, light = (m.measure(bins, y, np.ones(len(y)), raw)[1] for m in (model, sent))
    assert (whole == light).all()


def test_mllib_trees_side_by_side(spark):
    rows = [(str(k), float(k % 9), "a" if k % 2 else "b", float(5 + 3 * (k % 9) + k % 2), "test" if k % 5 == 0 else "train") for k in range(200)]
    d = G.condition_target(spark.createDataFrame(rows, "k string, x double, c string, y double, split string"), "y", False, 0.0)
    m, _, fitted = G.compare_regressors(d.where("split = 'train'"), d.where("split = 'test'"), ["x"], ["c"], "k",
                                        {"HistGB": G.boosted(rounds=40, rate=0.3)}, side_by_side=True)
    got = {r["split"]: r for r in m.collect()}
    assert fitted == {} and got["train"]["n"] == 160 and got["test"]["n"] == 40 and got["test"]["mae"] < 1
    e = spark.createDataFrame([(k, [float(k % 7), float(k % 5)], f"c{(k % 7) // 3}") for k in range(210)], "k long, v array<double>, cls string")
    *_, long, fitted, labels = C.compare_classifiers(e.where("k % 3 > 0"), e.where("k % 3 = 0"), "k", "cls", {"RandomForest": C.forest(trees=12)},
                                                     array_col="v", side_by_side=True)
    assert fitted == {} and labels == ["c0", "c1", "c2"] and long.count() == 210 and long.where("y <> p").count() == 0
