"""Target conditioning: winsorising, log transform and its back-transforms, coverage."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.operators.order import group_quantiles
from tillage.operators.stats import attach_group_stats


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def winsorize(df: DataFrame, value: str, q: float, by: Sequence[str] = (), out_col: str | None = None) -> DataFrame:
    """Clip ``value`` to its [q, 1-q] quantiles (per group when ``by`` is given).

    ``q <= 0`` is the identity. Quantiles interpolate linearly (pandas ``quantile``).
    A null value stays null.
    """
    out_col = out_col or value
    if q <= 0:
        return df.withColumn(out_col, F.col(value).cast("double"))
    bounds = group_quantiles(df, value, [q, 1.0 - q], by=by, names=["_w_lo", "_w_hi"])
    j = attach_group_stats(df, bounds, by)
    v = F.col(value).cast("double")
    clipped = F.when(v.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(v, F.col("_w_lo")), F.col("_w_hi")))
    return j.withColumn(out_col, clipped).drop("_w_lo", "_w_hi")


def log_forward(c, on: bool = True) -> Column:
    """log1p(y) when ``on``; y <= -1 gives null (counted by ``count_invalid_log``)."""
    return F.log1p(_c(c)) if on else _c(c)


def log_back(c, on: bool = True) -> Column:
    """expm1(prediction) when ``on``."""
    return F.expm1(_c(c)) if on else _c(c)


def log_back_corrected(pred_log, sigma2, on: bool = True) -> Column:
    """expm1(pred + sigma²/2), the lognormal half-variance correction."""
    if not on:
        return _c(pred_log)
    return F.expm1(_c(pred_log) + F.lit(0.5) * _c(sigma2))


def smearing_variance(df: DataFrame, y_log: str, p_log: str, by: Sequence[str] = ()) -> DataFrame:
    """N4 helper: population variance of log residuals per group (one row per group)."""
    return df.groupBy(*by).agg(F.var_pop(F.col(y_log) - F.col(p_log)).alias("sigma2"))


def count_invalid_log(df: DataFrame, y: str) -> DataFrame:
    """Rows whose target cannot be log1p-transformed (y <= -1)."""
    return df.agg(F.count_if(F.col(y) <= -1).alias("n_invalid_log"))


def interval_covered(y, lo, hi) -> Column:
    """1 when lo <= y <= hi (both bounds inclusive), else 0; null if any input is null."""
    return _c(y).between(_c(lo), _c(hi)).cast("int")
