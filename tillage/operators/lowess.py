"""Locally weighted curves, by sums that tasks add up per grid point.

A pass reads the narrow (x, y) rows once. A task joins the rows of a batch that share an x and adds five weighted sums per grid point;
features × grid rows leave it and one small aggregation totals them. Bandwidths and medians are exact ranks found in the
same way (rank_search), so no distance, row or distinct x is ever shuffled, and nothing grows with the rows but the passes' reads.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.operators.profile import _clean
from tillage.operators.rank_search import quantiles_of

SUMS = ["s0", "sx", "sy", "sxx", "sxy"]
CURVE = "feature string, i int, x double, fit double"
AT_ONCE = 4096  # distinct x of a batch whose weights to all grid points are held at a time
JOINED = 131_072  # rows of narrow batches that a task joins before it works on them
HELD = 65_536  # distinct x of a feature that a task joins over batches


def _pairs(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the rows of a batch that have both; column 0 is y, column k + 1 the feature."""
    y = batch.column(0).to_numpy(zero_copy_only=False)
    x = batch.column(k + 1).to_numpy(zero_copy_only=False)
    there = ~(np.isnan(x) | np.isnan(y))
    return x[there], y[there]


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to some ``JOINED`` rows, so that rows with equal x meet before weights are taken."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= JOINED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _counted(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(feature, x, rows with it); a task's distinct x are joined until there are ``HELD`` of them."""
    held = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * features
    for batch in _larger(batches):
        for k in range(features):
            x, n = held[k]
            more = _pairs(batch, k)[0]
            u, at = np.unique(np.concatenate([x, more]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n, np.ones(len(more))]), minlength=len(u)).astype(np.int64)
            if len(u) > HELD:
                yield k, u, n
                u, n = u[:0], n[:0]
            held[k] = u, n
    for k, (u, n) in enumerate(held):
        if len(u):
            yield k, u, n


def _interpolated(x: np.ndarray, points: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """The curve at x, straight between grid points."""
    step = (points[-1] - points[0]) / (len(points) - 1)
    pos = (x - points[0]) / step if step > 0 else np.zeros(len(x))
    at = np.minimum(np.floor(pos), len(points) - 2).astype(np.int64)
    return fit[at] + (fit[at + 1] - fit[at]) * (pos - at)


def _tricube(distance: np.ndarray, bandwidth: np.ndarray) -> np.ndarray:
    """Weights by distance (x, grid); a bandwidth of 0 counts only rows at the grid point itself."""
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.where(bandwidth > 0, distance / bandwidth, np.where(distance == 0, 0.0, 1.0))
    return np.where(u < 1, (1 - u ** 3) ** 3, 0.0)


def _grid_sums(batches: Iterator[pa.RecordBatch], points: list, bandwidth: list, curve: list | None, spread: list) -> Iterator[pa.RecordBatch]:
    total = [np.zeros((len(SUMS), len(p))) for p in points]
    for batch in _larger(batches):
        for k, grid in enumerate(points):
            x, y = _pairs(batch, k)
            if not len(x):
                continue
            weight = np.ones(len(x))
            if curve is not None and spread[k] > 0:
                z = (y - _interpolated(x, grid, curve[k])) / (6.0 * spread[k])
                weight = np.where(np.abs(z) < 1, (1 - z * z) ** 2, 0.0)
            u, at = np.unique(x, return_inverse=True)
            b, by = np.bincount(at, weights=weight), np.bincount(at, weights=weight * y)
            for start in range(0, len(u), AT_ONCE):
                part = slice(start, start + AT_ONCE)
                off = u[part, None] - grid  # from the grid point, so that the line's value there is its intercept
                w = _tricube(np.abs(off), bandwidth[k])
                wb, wy = w * b[part, None], w * by[part, None]
                total[k] += np.stack([wb.sum(0), (wb * off).sum(0), wy.sum(0), (wb * off * off).sum(0), (wy * off).sum(0)])
    for k, t in enumerate(total):
        if t.any():
            n = t.shape[1]
            yield pa.record_batch([pa.array(np.full(n, k, dtype=np.int32)), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, t)],
                                  names=["slot", "i", *SUMS])


def _fits(rows: DataFrame, points: list, bandwidth: list, curve: list | None, spread: list) -> list[np.ndarray]:
    """Per feature the weighted line of every grid point, at that point; NaN where no row has weight."""
    sums = rows.mapInArrow(lambda b: _grid_sums(b, points, bandwidth, curve, spread),
                           "slot int, i int, " + ", ".join(f"{c} double" for c in SUMS)).groupBy("slot", "i").agg(*[F.sum(c).alias(c) for c in SUMS])
    out = [np.full(len(p), np.nan) for p in points]
    for r in sums.collect():  # features × grid rows
        if r["s0"] > 0:
            den = r["s0"] * r["sxx"] - r["sx"] * r["sx"]
            slope = (r["s0"] * r["sxy"] - r["sx"] * r["sy"]) / den if den != 0 else 0.0
            out[r["slot"]][r["i"]] = (r["sy"] - slope * r["sx"]) / r["s0"]
    return out


def lowess_curve(df: DataFrame, x_cols: Sequence[str], y: str, frac: float = 2.0 / 3.0, grid: int = 50,
                 iterations: int = 3) -> DataFrame:
    """Locally weighted linear fit of ``y`` on each ``x`` evaluated on a grid of points.

    Per grid point g: bandwidth = the ``frac`` quantile of |x - g|, tricube weights, weighted least squares line. Robust passes
    re-weight rows by the bisquare of their residual (fit interpolated from the grid) over 6 × median |residual|.
    Output: (feature, i, x, fit); a feature without a row that has both values has no rows, fit is null where no row has weight.
    """
    spark = df.sparkSession
    if not x_cols:
        return spark.createDataFrame([], CURVE)
    rows = df.select(_clean(df, y).cast("double").alias("_y"), *[_clean(df, c).cast("double").alias(f"_x{k}") for k, c in enumerate(x_cols)]).where(
        "_y IS NOT NULL").persist(StorageLevel.MEMORY_AND_DISK)
    ends = rows.agg(*[f(f"_x{k}") for k in range(len(x_cols)) for f in (F.min, F.max)], F.max(F.abs("_y"))).first()
    used = [k for k in range(len(x_cols)) if ends[2 * k] is not None]
    rows_used = rows.select("_y", *[f"_x{k}" for k in used])
    points = [ends[2 * k] + np.arange(grid) * ((ends[2 * k + 1] - ends[2 * k]) / (grid - 1)) for k in used]

    def distances(batches):
        for k, u, n in _counted(batches, len(points)):
            for i, g in enumerate(points[k]):
                yield k * grid + i, np.abs(u - g), n

    reach = {k * grid + i: (0.0, float(max(abs(p[0] - g), abs(p[-1] - g), abs(ends[2 * used[k]] - g), abs(ends[2 * used[k] + 1] - g))))
             for k, p in enumerate(points) for i, g in enumerate(p)}
    width = quantiles_of(rows_used, distances, list(reach), frac, reach) if used else {}
    bandwidth = [np.array([width[k * grid + i] for i in range(grid)]) for k in range(len(used))]
    curve, spread = None, [0.0] * len(used)
    for it in range(iterations + 1 if used else 0):
        curve = _fits(rows_used, points, bandwidth, curve, spread)
        if it == iterations:
            break

        def residuals(batches, curve=curve):
            for batch in _larger(batches):
                for k, p in enumerate(points):
                    x, v = _pairs(batch, k)
                    size = np.abs(v - _interpolated(x, p, curve[k]))
                    size = size[~np.isnan(size)]
                    yield k, size, np.ones(len(size), dtype=np.int64)

        # No residual is larger than the largest value and the curve's largest together.
        most = {k: (0.0, 1.001 * (ends[-1] + float(np.nanmax(np.abs(c)))) if not np.isnan(c).all() else np.inf) for k, c in enumerate(curve)}
        middle = quantiles_of(rows_used, residuals, list(most), 0.5, most)
        spread = [middle.get(k, 0.0) for k in range(len(used))]
    rows.unpersist()
    out = [(x_cols[k], i, float(points[n][i]), None if np.isnan(curve[n][i]) else float(curve[n][i]))
           for n, k in enumerate(used) for i in range(grid)]
    return spark.createDataFrame(out, CURVE)
