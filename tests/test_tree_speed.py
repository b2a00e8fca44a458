"""Forms of tree growth for many rows against the plain ones, and what a job's blocks carry."""
import numpy as np
import pytest

from tillage.plans import tree_growth as T
from tillage.session import written

SIZES = [40, 6, 9, 2, 2, 2, 300]


def _data(n=6000, seed=0):
    rng = np.random.default_rng(seed)
    bins = np.stack([rng.integers(0, min(s, 255), n) for s in SIZES], axis=1).astype("u1")
    y = 3.0 * bins[:, 0] - 2.0 * bins[:, 1] * bins[:, 3] + 0.1 * bins[:, 6] + rng.normal(0, 2, n)
    return bins, np.concatenate([[0], np.cumsum(np.minimum(SIZES, 255))]), y


def test_sums_of_joined_bins_are_those_of_single_ones(monkeypatch):
    bins, offsets, y = _data()
    for limit in (8, 300, 1 << 12):
        monkeypatch.setattr(T, "JOINED", limit)
        joined = T.JoinedBins(np.asfortranarray(bins), offsets)
        for rows in (None, np.flatnonzero(bins[:, 0] > 2), np.arange(50)):
            x = y if rows is None else y[rows]
            here = bins if rows is None else bins[rows]
            assert np.allclose(joined.sums(rows, [x, None]), T.bin_sums(here, np.zeros(len(here), dtype=int), 1, offsets, [x, None])[:, 0])


@pytest.mark.parametrize("loss", ["squared", "pinball", "softmax"])
def test_boosting_by_nodes_gives_the_trees_of_boosting_by_levels(monkeypatch, loss):
    bins, offsets, y = _data()
    y = (y > 50).astype(float) + (y > 70) if loss == "softmax" else y
    w = (np.arange(len(y)) % 7 > 0).astype(float)
    found = []
    for by in (1, 1 << 30):
        monkeypatch.setattr(T, "BY_NODES", by)
        found.append(T.boost_here(T.Boosting(offsets, loss, rounds=6, rate=0.3, alpha=0.8, classes=3 if loss == "softmax" else 1), bins, y, w).scores(bins))
    assert np.allclose(*found)


def test_rounds_without_rows_or_without_rounds(monkeypatch):
    bins, offsets, y = _data(50)
    monkeypatch.setattr(T, "BY_NODES", 0)
    assert (T.boost_here(T.Boosting(offsets, rounds=2), bins, y, np.zeros(50)).scores(bins) == 0).all()


def test_least_squares_tree_is_that_of_the_general_form():
    for seed in range(3):
        bins, offsets, y = _data(seed=seed)
        w = np.random.default_rng(seed).poisson(1, len(y))
        for depth in (1, 4, 30):
            a = T.grow_squares(bins, offsets, y, w, depth)
            b = T.grow_deep(bins, offsets, y, w, depth, onehot=y[:, None])
            assert len(a.feature) == len(b.feature)
            assert np.allclose(a.predict(bins)[w > 0], np.stack(b.predict(bins))[w > 0, 0])
        assert (a.predict(bins) == a.value[a.leaves(bins)]).all()
    for y in (np.zeros(0), np.full(5, 3.0)):
        tree = T.grow_squares(bins[:len(y)], offsets, y, np.ones(len(y)), 30)
        assert len(tree.feature) == 1 and (tree.predict(bins) == (3.0 if len(y) else 0.0)).all()
    assert tree.predict(bins[:0]).shape == (0,)


def test_spread_tables_are_read_by_several_tasks(spark):
    d = written(spark.range(0, 2000, 1, 1), "one-part", spread=True)
    assert len(d.inputFiles()) > 1 and d.count() == 2000


def test_least_squares_tree_node_by_node_is_that_of_all_levels(monkeypatch):
    for seed in range(3):
        bins, offsets, y = _data(seed=seed)
        w = np.random.default_rng(seed).poisson(1, len(y))
        for depth in (2, 5, 30):
            monkeypatch.setattr(T, "CACHED", 1 << 30)
            a = T.grow_squares(bins, offsets, y, w, depth)
            monkeypatch.setattr(T, "CACHED", 200)
            b = T.grow_squares(bins, offsets, y, w, depth)
            assert len(a.feature) == len(b.feature)
            assert np.allclose(a.predict(bins)[w > 0], b.predict(bins)[w > 0])
            assert (b.predict(bins) == b.value[b.leaves(bins)]).all() and (b.for_scoring().predict(bins) == b.predict(bins)).all()
    assert len(T.grow_squares(bins, offsets, np.full(len(y), 3.0), w, 30).feature) == 1
