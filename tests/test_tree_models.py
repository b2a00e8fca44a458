"""Trees grown side by side against a plain single-machine form, and by passes against in one task."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tillage.plans import many_models as MM
from tillage.plans.tree_growth import Boosting, best_splits, bin_sums, boost_here, cell_value, grow_deep, residual_cells


def _data(n=400, seed=0):
    rng = np.random.default_rng(seed)
    sizes = [6, 9, 2]
    bins = np.stack([rng.integers(0, s, n) for s in sizes], axis=1)
    y = 3.0 * bins[:, 0] - 2.0 * bins[:, 1] * bins[:, 2] + rng.normal(0, 0.3, n)
    return bins, np.concatenate([[0], np.cumsum(sizes)]), y


def _plain_split(bins, g, min_leaf):
    best = (-np.inf, None)
    for f in range(bins.shape[1]):
        for cut in range(bins[:, f].max()):
            left = bins[:, f] <= cut
            if min_leaf <= left.sum() <= len(g) - min_leaf:
                gain = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum()
                if gain > best[0] + 1e-9:
                    best = (gain, (f, cut))
    return best[1]


def test_best_split_is_that_of_a_plain_search():
    for seed in range(20):
        bins, offsets, y = _data(60, seed)
        total = bin_sums(bins, np.zeros(60, dtype=int), 1, offsets, [y, np.ones(60), None])
        assert best_splits(total, offsets, 5)[0][:2] == _plain_split(bins, y, 5)
        tree = grow_deep(bins, offsets, y, np.ones(60), 1)
        assert (tree.feature[0], tree.cut[0]) == _plain_split(bins, y, 1)


def test_boosting_is_that_of_a_plain_loop():
    bins, offsets, y = _data()
    model = boost_here(Boosting(offsets, rounds=6, rate=0.3, depth=3, min_leaf=10), bins, y, np.ones(len(y)))
    raw = np.full(len(y), y.mean())
    for _ in range(6):
        leaf, g = [np.arange(len(y))], raw - y
        for _ in range(3):
            grown = []
            for rows in leaf:
                split = _plain_split(bins[rows], g[rows], 10) if len(rows) >= 20 else None
                whole = g[rows].sum() ** 2 / len(rows)
                if split is not None:
                    left = bins[rows, split[0]] <= split[1]
                    gain = g[rows[left]].sum() ** 2 / left.sum() + g[rows[~left]].sum() ** 2 / (~left).sum()
                    split = split if gain - whole > 1e-9 * (1 + whole) else None
                grown += [rows] if split is None else [rows[left], rows[~left]]
            leaf = grown
        raw = raw.copy()
        for rows in leaf:
            raw[rows] -= 0.3 * g[rows].mean()
    assert np.allclose(model.scores(bins)[:, 0], raw)


def test_forest_tree_fits_its_rows_and_classes():
    bins, offsets, y = _data()
    w = np.random.default_rng(1).poisson(1, len(y))
    tree = grow_deep(bins, offsets, y, w, 30)
    cell = bins[:, 0] * 100 + bins[:, 1] * 10 + bins[:, 2]
    used = w > 0
    mean = {c: np.average(y[used & (cell == c)], weights=w[used & (cell == c)]) for c in np.unique(cell[used])}
    assert np.allclose(tree.predict(bins)[used], [mean[c] for c in cell[used]])
    kind = (bins[:, 0] > 2).astype(int) + bins[:, 2]
    shares = grow_deep(bins, offsets, y, w, 30, per_split=1, rng=np.random.default_rng(2), onehot=np.eye(3)[kind]).predict(bins)
    assert (np.stack(shares).argmax(axis=1)[used] == kind[used]).all()


def test_cells_keep_order_and_size():
    x = np.sort(np.concatenate([np.random.default_rng(0).normal(0, 100, 500), [0.0, 1e-9, -1e-9, 1e30, -1e30]]))
    cells = residual_cells(x)
    assert (np.diff(cells) >= 0).all() and np.allclose(cell_value(cells), x, rtol=1e-3, atol=1e-30)


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(3000).selectExpr("id", "id % 5 AS fold", "(id * 7919) % 50 AS a", "(id * 104729) % 11 AS b")
    return d.selectExpr("id", "fold", "CAST(1000 + 50 * a - 40 * b + (id * 17) % 13 AS double) AS y", "array(CAST(a AS double), CAST(b AS double)) AS x")


def _models():
    held = F.col("fold") == 0
    return [MM.boosted("b", ~held, F.lit(True), rounds=20, rate=0.3), MM.quantile("q", ~held, F.lit(True), 0.9, rounds=20, rate=0.3),
            MM.boosted("log", ~held, held, rounds=5, rate=0.3, clip=(900.0, 3000.0), log=True), MM.forest("f", ~held, held, trees=25)]


def _predictions(rows):
    return {(r["model"], r["id"]): r["p"][0] for r in MM.fit_and_score(rows, _models()).collect()}


def test_passes_over_blocks_give_the_trees_of_one_task(spark, rows, monkeypatch):
    here = _predictions(rows)
    assert len(here) == 2 * 3000 + 2 * 600
    y = {r["id"]: r["y"] for r in rows.collect()}
    assert np.mean([abs(p - y[i]) for (m, i), p in here.items() if m == 0]) < 60
    assert 0.85 < np.mean([y[i] <= p for (m, i), p in here.items() if m == 1]) < 0.95
    assert max(abs(p - y[i]) for (m, i), p in here.items() if m == 3) < 60
    assert all(np.log1p(900) - 0.1 < p < np.log1p(3000) + 0.1 for (m, _), p in here.items() if m == 2)
    monkeypatch.setattr(MM, "BLOCK", 700)
    monkeypatch.setattr(MM, "BLOCKS_HERE", 1)
    monkeypatch.setattr(MM, "REFRESH", 7)
    passes = _predictions(rows)
    assert set(passes) == set(here)
    far = [(k, p, passes[k]) for k, p in here.items() if k[0] != 3 and abs(p - passes[k]) > 1e-6 * (1 + abs(p))]
    assert not far, far[:5]
    assert np.mean([abs(p - y[i]) for (m, i), p in passes.items() if m == 3]) < 60  # jobs that draw some of the blocks


def test_null_targets_and_empty_sides(spark, rows):
    none = MM.fit_and_score(rows.limit(0), _models()[:1]).count()
    assert none == 0
    with_null = rows.withColumn("y", F.when(F.col("id") % 2 == 0, F.col("y")))
    got = MM.fit_and_score(with_null, [MM.boosted("b", F.lit(True), F.lit(True), rounds=3), MM.boosted("none", F.lit(False), F.col("id") < 5, rounds=3)])
    assert {r["model"]: r["count"] for r in got.groupBy("model").count().collect()} == {0: 3000, 1: 5}
