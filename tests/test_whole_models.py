"""The registered model queries fit whole models."""
import numpy as np
import pytest

from tests.conftest import SF001
from tillage.catalog import q_model as Q
from tillage.plans import classify as C
from tillage.plans import regress as G
from tillage.operators.features import imputed_values
from tillage.operators.folds import leave_one_group_out
from tillage.plans.grouped import fold_models, group_estimators, per_group_models, random_split_models
from tillage.plans.importance import importance_in_one_fit
from tillage.plans.leave_out import fold_metrics, fold_predictions, folds_together


class _Seen(Exception):
    pass


def _estimators(monkeypatch, where, name, query, spark):
    def stop(*a, **kw):
        raise _Seen(next(x for x in [*a, *kw.values()] if isinstance(x, dict)))
    monkeypatch.setattr(where, name, stop)
    with pytest.raises(_Seen) as e:
        query(spark, SF001)
    return e.value.args[0]


def test_registered_regressors_have_full_sizes(spark, monkeypatch):
    seen = {}
    for q in (Q.m9, Q.m10, Q.m12):
        seen |= _estimators(monkeypatch, G, "compare_regressors", q, spark)
    assert (seen["RandomForest"].trees, seen["RandomForest"].depth) == (400, 30)
    assert (seen["HistGB"].getMaxIter(), seen["HistGB"].getStepSize()) == (500, 0.06)
    stack = seen["Stacked_Ensemble"]
    assert (stack.forest.trees, stack.boosted.rounds, stack.meta.rounds, stack.meta.rate, stack.k) == (250, 350, 300, 0.08, 5)
    assert Q.QUANTILE_ROUNDS == 400


def test_registered_classifiers_have_full_sizes(spark, monkeypatch):
    seen = {}
    for q in (Q.m17, Q.m18, Q.m19, Q.m20):
        seen |= _estimators(monkeypatch, C, "compare_classifiers", q, spark)
    assert seen["LogReg"].getMaxIter() == 2000 and seen["MLP"].getMaxIter() == 120
    assert (seen["RandomForest"].getNumTrees(), seen["RandomForest"].getMaxDepth()) == (400, 30)
    assert seen["HistGB"].rounds == 500


def test_comparisons_hold_every_model(spark, monkeypatch):
    assert set(_estimators(monkeypatch, G, "compare_regressors", Q.m22, spark)) == set(G.MODEL_ORDER)
    assert set(_estimators(monkeypatch, C, "compare_classifiers", Q.m21, spark)) == {"LogReg", "HistGB", "RandomForest", "MLP"}


def _small(train):
    return {"HistGB": G.boosted(rounds=2), "Huber": G.huber(n_train=train.count())}


def _plants(spark):
    rng = np.random.default_rng(2)
    rows = [(str(k), "rice" if k % 4 else "rye", 2000 + k % 3, None if k % 5 == 4 else f"r{k % 2}", float(x), "a" if k % 2 else "b",
             float(5 + 3 * x + rng.normal()), "test" if k % 5 == 0 else "train") for k, x in enumerate(rng.uniform(0, 9, 100))]
    return spark.createDataFrame(rows, "k string, crop string, year int, region string, x double, c string, y double, split string")


def test_per_group_models_have_coverage_importance_and_folds(spark):
    def run(part, name):
        return [random_split_models(part, "y", ["x"], ["c"], "k", _small, interval={"rounds": 2}),
                fold_models(part, "loyo", "year", "y", ["x"], ["c"], "k", _small)]
    got = {(r["crop"], r["eval"]): r for r in per_group_models(_plants(spark), "crop", run, min_rows=30, max_workers=1).collect()}
    assert not [r["best_model"] for r in got.values() if r["best_model"].startswith("error")]
    assert set(got) == {("rice", "random"), ("rice", "loyo"), ("rye", None)}
    rice = got["rice", "random"]
    assert 0 <= rice["coverage80"] <= 1 and rice["test_MAE"] is not None
    assert [r["feature"] for r in rice["importance"]][0] == "x"
    assert got["rice", "loyo"]["test_MAE"] is not None and got["rye", None]["best_model"].startswith("skipped")


def test_leave_one_out_models_give_every_fold(spark):
    d = _plants(spark)
    p = fold_predictions(d, "region", "y", ["x"], ["c"], "k", _small, as_text=True)
    assert p.count() == 2 * d.where("region IS NOT NULL").count()
    m = {(r["fold"], r["model"]): r["n"] for r in fold_metrics(p).collect()}
    n = {r["region"]: r["count"] for r in d.groupBy("region").count().collect()}
    assert m == {(f, name): n[f] for f in ("r0", "r1") for name in ("HistGB", "Huber")}
    assert fold_predictions(d.where("year = 2000"), "year", "y", ["x"], ["c"], "k", _small).count() == 0


def test_folds_together_give_every_fold_and_model(spark):
    d = _plants(spark)
    trees = {"RandomForest": G.Forest(trees=12), "HistGB": G.HistBoosting(rounds=20, rate=0.3, min_leaf=3)}
    p = folds_together(d, "region", "y", ["x"], ["c"], "k", trees, {"Huber": G.huber}, log_target=True, winsor=0.01, as_text=True)
    m = {(r["fold"], r["model"]): r for r in fold_metrics(p).collect()}
    n = {r["region"]: r["count"] for r in d.groupBy("region").count().collect()}
    assert {k: r["n"] for k, r in m.items()} == {(f, name): n[f] for f in ("r0", "r1") for name in ("RandomForest", "HistGB", "Huber")}
    assert all(r["mae"] < 6 for r in m.values())  # y runs from 5 to 32 with noise of deviation 1
    assert folds_together(d.where("year = 2000"), "year", "y", ["x"], ["c"], "k", trees, {}).count() == 0


def test_stack_and_members_side_by_side(spark):
    d = G.condition_target(_plants(spark), "y", False, 0.0)
    specs = {"Forest": G.Forest(trees=20), "Stack": G.Stack(G.Forest(trees=20), G.HistBoosting(rounds=20, rate=0.3, min_leaf=3),
                                                           G.HistBoosting(rounds=30, rate=0.3, min_leaf=3), k=3), "Huber": G.huber(80)}
    m, long, fitted = G.compare_regressors(d.where("split = 'train'"), d.where("split = 'test'"), ["x"], ["c"], "k", specs)
    got = {(r["model"], r["split"]): r for r in m.collect()}
    assert set(got) == {(n, s) for n in specs for s in ("train", "test")} and set(fitted) == {"Huber"}
    assert all(got[n, "train"]["n"] == 80 and got[n, "test"]["n"] == 20 and got[n, "test"]["mae"] < 4 for n in specs)


def test_multinomial_boosting_separates_classes(spark):
    rows = [(k, [float(k % 7), float(k % 5), None][:2], f"c{(k % 7) // 3}") for k in range(210)]
    d = spark.createDataFrame(rows, "k long, v array<double>, cls string")
    comp, _, _, long, _, labels = C.compare_classifiers(d.where("k % 3 > 0"), d.where("k % 3 = 0"), "k", "cls",
                                                       {"HistGB": C.MultinomialBoosting(rounds=10, rate=0.3, min_leaf=3)}, array_col="v")
    assert labels == ["c0", "c1", "c2"] and comp.first()["accuracy"] == 1.0 and long.count() == 210


def test_population_deviation_of_array_features(spark):
    d = spark.createDataFrame([(k, [float(x)], "a" if x < 3 else "b") for k, x in enumerate([1, 2, 4, 9])], "k long, v array<double>, cls string")
    *_, fitted, _ = C.compare_classifiers(d, d, "k", "cls", {"LogReg": C.logistic(4.0)}, array_col="v")
    rows = d.selectExpr("*", "cls AS label_name").withColumn("_vec", C.array_to_vector("v"))
    got = [r["features"][0] for r in fitted["LogReg"].transform(rows).orderBy("k").collect()]
    x = np.array([1.0, 2, 4, 9])
    assert np.allclose(got, (x - x.mean()) / x.std())


def _trees(train):
    return {"RandomForest": G.Forest(trees=10, every_row=True), "HistGB": G.HistBoosting(rounds=20, rate=0.3, min_leaf=3), "Huber": G.huber(n_train=train.count())}


def test_models_of_a_group_grow_side_by_side(spark):
    got = group_estimators(_plants(spark))
    assert got["RandomForest"] == G.Forest(trees=400, depth=30, every_row=True)
    assert got["HistGB"] == G.HistBoosting(rounds=500, rate=0.06, depth=5, min_leaf=20)

    def run(part, name):
        return [random_split_models(part, "y", ["x"], ["c"], "k", _trees, interval={"rounds": 2}), fold_models(part, "loyo", "year", "y", ["x"], ["c"], "k", _trees)]
    rows = {(r["crop"], r["eval"]): r for r in per_group_models(_plants(spark), "crop", run, min_rows=30, max_workers=1).collect()}
    assert not [r["best_model"] for r in rows.values() if r["best_model"].startswith("error")]
    assert rows["rice", "random"]["importance"][0]["feature"] == "x" and rows["rice", "random"]["importance"][0]["importance"] > 0.1
    assert rows["rice", "loyo"]["test_MAE"] < 6


def test_importance_of_a_model_fitted_again(spark):
    d = G.condition_target(_plants(spark), "y", True, 0.0)
    tr, te = d.where("split = 'train'"), d.where("split = 'test'")
    imp = importance_in_one_fit(te, "k", ["x", "c"], lambda rows: G.predict_refitted(tr, rows, ["x"], ["c"], G.HistBoosting(rounds=20, rate=0.3, min_leaf=3)), "label")
    got = {r["feature"]: r["importance_mean"] for r in imp.collect()}
    assert set(got) == {"x", "c"} and got["x"] > 0.1 > abs(got["c"])


def test_trees_of_all_folds_are_those_of_each_fold(spark):
    at = [(k, 5 if k % 3 == 0 and k % 4 else k // 3 % 6) for k in range(240)]  # higher values in r0: other medians without it
    rows = [(str(k), f"r{k % 3}" if k % 10 else None, None if k % 7 == 0 else float(x), "ab"[k // 18 % 2],
             float(3 + x + k % 3 + k % 5 / 10 + k // 18 % 2 / 3)) for k, x in at]
    d = spark.createDataFrame(rows, "k string, g string, x double, c string, y double")
    spec = {"HistGB": G.HistBoosting(rounds=10, rate=0.3, min_leaf=3)}
    got = {r["k"]: (r["fold"], r["y"], r["p"]) for r in fold_predictions(d, "g", "y", ["x"], ["c"], "k", lambda t: spec, True, 0.05).collect()}
    assert len(got) == d.where("g IS NOT NULL").count()
    assert len({imputed_values(train, ["x"], ["c"])[0] for _, train, _ in leave_one_group_out(d, "g")}) > 1
    for fold, train, test in leave_one_group_out(d, "g"):
        train, test = (G.condition_target(x, "y", True, 0.05) for x in (train, test))
        _, long, _ = G.compare_regressors(train, test, ["x"], ["c"], "k", spec, True)
        for r in long.where("split = 'test'").collect():
            assert got[r["k"]] == (fold, pytest.approx(r["y"]), pytest.approx(r["p"]))
