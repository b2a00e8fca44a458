"""A9 and its rank search against plain loops."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tillage.operators import rank_search
from tillage.operators.lowess import lowess_curve


def plain_curve(x, y, frac=2 / 3, grid=50, iterations=3):
    points = x.min() + np.arange(grid) * ((x.max() - x.min()) / (grid - 1))
    step = points[1] - points[0]
    robust = np.ones(len(x))
    for it in range(iterations + 1):
        fit = []
        for g in points:
            d = np.abs(x - g)
            h = np.quantile(d, frac)
            w = robust * (np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0) if h > 0 else (d == 0))
            if w.sum() == 0:
                fit.append(np.nan)
                continue
            mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
            var = (w * (x - mx) ** 2).sum()
            fit.append(my + ((w * (x - mx) * (y - my)).sum() / var * (g - mx) if var > 0 else 0.0))
        if it == iterations:
            return points, np.array(fit)
        at = np.minimum((x - points[0]) // step, grid - 2).astype(int) if step > 0 else np.zeros(len(x), int)
        pos = (x - points[0]) / step if step > 0 else np.zeros(len(x))
        fit = np.array(fit)
        res = y - (fit[at] + (fit[at + 1] - fit[at]) * (pos - at))
        s = np.median(np.abs(res))
        if s > 0:
            z = res / (6 * s)
            robust = np.where(np.abs(z) < 1, (1 - z * z) ** 2, 0.0)


def test_curve_is_that_of_plain_loops(spark, monkeypatch):
    monkeypatch.setattr("tillage.operators.lowess.HELD", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=900)
    few = np.floor(rng.random(900) * 4)  # many rows share an x
    y = np.sin(x) + few + rng.normal(size=900) * 0.2 + np.where(rng.random(900) < 0.05, 30, 0)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(x, few, y, strict=True)] + [(None, 1.0, None), (float("nan"), None, 3.0), (2.0, 1.0, None)]
    got = lowess_curve(spark.createDataFrame(rows, "x double, few double, y double").repartition(5), ["x", "few"], "y").collect()
    for name, values in (("x", x), ("few", few)):
        points, fit = plain_curve(values, y)
        mine = sorted((r["i"], r["x"], r["fit"]) for r in got if r["feature"] == name)
        assert np.allclose([m[1] for m in mine], points)
        known = ~np.isnan(fit)
        assert np.allclose(np.array([m[2] for m in mine], dtype=float)[known], fit[known], rtol=1e-8)
        assert all((mine[k][2] is None) == (not known[k]) for k in range(len(mine)))


def test_curve_edges(spark):
    schema = "x double, y double"
    assert lowess_curve(spark.createDataFrame([], schema), ["x"], "y").count() == 0
    assert lowess_curve(spark.createDataFrame([(None, 1.0), (1.0, None)], schema), ["x"], "y").count() == 0
    one = lowess_curve(spark.createDataFrame([(4.0, 7.0)] * 3, schema), ["x"], "y").collect()
    assert {(r["x"], r["fit"]) for r in one} == {(4.0, 7.0)} and len(one) == 50


@pytest.mark.parametrize("values", [
    [1.0] * 50 + [2.0], list(range(1000)), [0.0, 1e-300, 1.0, 1e300], [-5.0, -5.0, 3.0, 3.0], [7.5],
    [1e308, -1e308, 0.0, 1.0], list(np.random.default_rng(1).normal(size=777) ** 9)])
def test_ranks_are_exact(spark, monkeypatch, values):
    monkeypatch.setattr(rank_search, "CELLS", 8)
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)

    def measure(batches):
        for b in batches:
            v = b.column(0).to_numpy()
            yield 0, v, np.ones(len(v), dtype=np.int64)

    for p in (0.0, 0.25, 0.5, 2 / 3, 1.0):
        want = rows.agg(F.percentile("v", F.lit(p))).first()[0]
        got = rank_search.quantiles_of(rows, measure, [0, 1], p)
        assert set(got) == {0} and np.isclose(got[0], want, rtol=1e-12, atol=0)
