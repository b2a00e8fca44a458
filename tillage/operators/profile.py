"""Profiling: describe, missing values, value counts, histograms, density, box statistics,
outliers, correlation, local regression curves and scatter rows.

Every operator is a few grouped aggregations over the whole table; per-column work is
expressed in long form (column, value) so one shuffle serves all columns. Statistics
tables have one row per group and are attached back with a size-checked join.
"""
from __future__ import annotations

import math
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillage.functions.scalars import is_numeric_type
from tillage.operators.order import group_quantiles
from tillage.operators.stats import attach_group_stats


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in exclude]


def _clean(df: DataFrame, c: str):
    """A column as pandas sees it: NaN is missing."""
    dt = df.schema[c].dataType
    col = F.col(c)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.nanvl(col, F.lit(None).cast(dt))
    return col


def _long_numeric(df: DataFrame, cols: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Unpivot numeric columns to (extra..., column, v double) in one narrow step."""
    structs = [F.struct(F.lit(c).alias("column"), _clean(df, c).cast("double").alias("v")) for c in cols]
    return df.select(*extra, F.explode(F.array(*structs)).alias("_s")).select("*", "_s.column", "_s.v").drop("_s")


def _long_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    structs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    return df.select(F.explode(F.array(*structs)).alias("_s")).select("_s.column", "_s.value")


DESCRIBE_SCHEMA = ("position int, column string, count long, unique long, top string, freq long, "
                   "mean double, std double, min double, q25 double, q50 double, q75 double, max double")


# A1 ------------------------------------------------------------------------------------
def describe_all(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """pandas ``describe(include="all")`` in long form: one row per column.

    Text columns get count/unique/top/freq (top = most frequent, ties → smallest value);
    numeric columns get count/mean/std (sample)/min/quartiles (exact, interpolated)/max.
    """
    cols = list(columns or df.columns)
    num = [c for c in cols if is_numeric_type(df.schema[c].dataType)]
    txt = [c for c in cols if c not in num]
    pos = {c: i for i, c in enumerate(cols)}
    spark = df.sparkSession
    parts = []
    # one wide partial aggregation for counts and moments of every column
    aggs = []
    for c in cols:
        aggs.append(F.count(_clean(df, c)).alias(f"{pos[c]}_n"))
    for c in num:
        v = _clean(df, c).cast("double")
        aggs += [F.avg(v).alias(f"{pos[c]}_mean"), F.stddev_samp(v).alias(f"{pos[c]}_std"),
                 F.min(v).alias(f"{pos[c]}_min"), F.max(v).alias(f"{pos[c]}_max")]
    wide = df.agg(*aggs)
    null_d = F.lit(None).cast("double")
    rows = []
    for c in cols:
        i = pos[c]
        if c in num:
            rows.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                                 F.col(f"{i}_n").alias("count"), F.col(f"{i}_mean").alias("mean"),
                                 F.col(f"{i}_std").alias("std"), F.col(f"{i}_min").alias("min"),
                                 F.col(f"{i}_max").alias("max")))
        else:
            rows.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                                 F.col(f"{i}_n").alias("count"), null_d.alias("mean"), null_d.alias("std"),
                                 null_d.alias("min"), null_d.alias("max")))
    base = wide.select(F.explode(F.array(*rows)).alias("_s")).select("_s.*")
    if num:
        q = group_quantiles(_long_numeric(df, num), "v", [0.25, 0.5, 0.75], by=["column"],
                            names=["q25", "q50", "q75"])
    else:
        q = spark.createDataFrame([], "column string, q25 double, q50 double, q75 double")
    if txt:
        counts = _long_text(df, txt).where(F.col("value").isNotNull()).groupBy("column", "value").count()
        t = counts.groupBy("column").agg(
            F.count(F.lit(1)).alias("unique"),
            F.min_by("value", F.struct((-F.col("count")).alias("n"), F.col("value").alias("v"))).alias("top"),
            F.max("count").alias("freq"))
    else:
        t = spark.createDataFrame([], "column string, unique long, top string, freq long")
    out = base.join(q, "column", "left").join(t, "column", "left")
    return out.select("position", "column", "count", "unique", "top", "freq", "mean", "std", "min",
                      "q25", "q50", "q75", "max")


# A2 ------------------------------------------------------------------------------------
def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: missing count (null, and NaN for floats) and percent of all rows."""
    cols = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("_rows")] + [
        F.count_if(_clean(df, c).isNull()).alias(f"{i}_m") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                     F.col(f"{i}_m").alias("missing_count")) for i, c in enumerate(cols)]
    return wide.select("_rows", F.explode(F.array(*rows)).alias("_s")).select(
        "_s.position", "_s.column", "_s.missing_count",
        F.try_divide(F.col("_s.missing_count") * F.lit(100.0), F.col("_rows")).alias("missing_pct"))


# A3 ------------------------------------------------------------------------------------
def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value (nulls excluded), most frequent first, ties by value."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).count()
              .orderBy(F.desc("count"), F.asc("value")))


# A4 ------------------------------------------------------------------------------------
def histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 20) -> DataFrame:
    """Equal-width bins over each group's own [min, max]; last bin closed; a single-valued
    group spans [v - 0.5, v + 0.5]. Dense output: every bin of every group, zeros included."""
    by = list(by)
    v = _clean(df, value).cast("double")
    data = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull())
    rng = data.groupBy(*by).agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    rng = rng.select(*by,
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
    j = attach_group_stats(data, rng, by)
    b = F.least(F.floor((F.col("_v") - F.col("_lo")) * F.lit(bins) / (F.col("_hi") - F.col("_lo"))),
                F.lit(bins - 1)).cast("int")
    counts = j.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    dense = rng.select(*by, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    out = dense.join(counts, [*by, "bin"], "left") if not by else _null_safe_left(dense, counts, [*by, "bin"])
    return out.select(*by, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
                      (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def _null_safe_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        e = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in keys])


# A5 ------------------------------------------------------------------------------------
def kde_curve(df: DataFrame, value: str, by: Sequence[str] = (), grid: int = 200, bins: int = 20) -> DataFrame:
    """Gaussian kernel density per group on ``grid`` points over the data range.

    Bandwidth is Scott's rule (sample std · n^(-1/5)). Equal values are aggregated first,
    so the work is (distinct values × grid). ``kde_count`` scales the density to the
    histogram's counts (n · bin width), as drawn over a histogram.
    """
    by = list(by)
    v = _clean(df, value).cast("double")
    data = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull())
    st = data.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_sd"),
                               F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    st = st.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    weights = data.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_w"))
    j = attach_group_stats(weights, st, by).where(F.col("_h") > 0)
    pts = j.select(*by, "_v", "_w", "_h", "_mn", "_mx",
                   F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    x = F.col("_mn") + F.col("i") * (F.col("_mx") - F.col("_mn")) / F.lit(grid - 1)
    pts = pts.withColumn("x", x)
    z = (F.col("x") - F.col("_v")) / F.col("_h")
    k = F.col("_w") * F.exp(F.lit(-0.5) * z * z)
    dens = pts.groupBy(*by, "i").agg(F.sum(k).alias("_k"), F.first("x").alias("x"))
    dens = attach_group_stats(dens, st, by)
    density = F.col("_k") / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))
    return dens.select(*by, "i", "x", density.alias("density"),
                       (density * F.col("_n") * (F.col("_mx") - F.col("_mn")) / F.lit(bins)).alias("kde_count"))


# A6 / A7 -------------------------------------------------------------------------------
def _fences(df: DataFrame, value: str, by: list) -> DataFrame:
    q = group_quantiles(df, value, [0.25, 0.5, 0.75], by=by, names=["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.select(*by, "q1", "median", "q3", iqr.alias("iqr"),
                    (F.col("q1") - F.lit(1.5) * iqr).alias("lower_fence"),
                    (F.col("q3") + F.lit(1.5) * iqr).alias("upper_fence"))


def box_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, fences, whiskers (most extreme data point inside the fences) and outlier
    counts per group."""
    by = list(by)
    v = _clean(df, value).cast("double")
    data = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull())
    fences = _fences(data, "_v", by)
    j = attach_group_stats(data, fences, by)
    inside = F.col("_v").between(F.col("lower_fence"), F.col("upper_fence"))
    agg = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))
    out = attach_group_stats(agg, fences, by)
    return out.select(*by, "n", "q1", "median", "q3", "iqr", "lower_fence", "upper_fence",
                      "whisker_low", "whisker_high", "n_outliers",
                      (F.col("n_outliers") / F.col("n")).alias("outlier_share"))


def outliers_iqr(df: DataFrame, value: str, by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Rows strictly beyond the 1.5·IQR fences of their group, with the side."""
    by = list(by)
    data = df.select(*keep, *[c for c in by if c not in keep],
                     _clean(df, value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    fences = _fences(data, "_v", by)
    j = attach_group_stats(data, fences, by)
    side = F.when(F.col("_v") < F.col("lower_fence"), F.lit("low")).when(
        F.col("_v") > F.col("upper_fence"), F.lit("high"))
    return j.select(*keep, *[c for c in by if c not in keep], F.col("_v").alias(value),
                    "lower_fence", "upper_fence", side.alias("side")).where(F.col("side").isNotNull())


# A8 ------------------------------------------------------------------------------------
def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every numeric pair, pairwise-complete, in one aggregation.

    Long form (col_a, col_b, corr) with both orders and the diagonal; a constant column
    gives null (never a division error).
    """
    cols = list(columns or numeric_columns(df))
    clean = {c: _clean(df, c).cast("double") for c in cols}
    aggs = []
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    for i, j in pairs:
        a, b = clean[cols[i]], clean[cols[j]]
        both = a.isNotNull() & b.isNotNull()
        a2, b2 = F.when(both, a), F.when(both, b)
        aggs += [F.covar_pop(a2, b2).alias(f"c{i}_{j}"), F.stddev_pop(a2).alias(f"sa{i}_{j}"),
                 F.stddev_pop(b2).alias(f"sb{i}_{j}")]
    wide = df.agg(*aggs)
    rows = []
    for i, j in pairs:
        den = F.col(f"sa{i}_{j}") * F.col(f"sb{i}_{j}")
        if i == j:  # a column with itself: exactly 1 unless constant
            r = F.when(den > 0, F.lit(1.0))
        else:
            r = F.when(den > 0, F.col(f"c{i}_{j}") / den)
        rows.append(F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"), r.alias("corr")))
        if i != j:
            rows.append(F.struct(F.lit(cols[j]).alias("col_a"), F.lit(cols[i]).alias("col_b"), r.alias("corr")))
    return wide.select(F.explode(F.array(*rows)).alias("_s")).select("_s.*")


# A10 -----------------------------------------------------------------------------------
def scatter_points(df: DataFrame, x_cols: Sequence[str], y: str, group: str | None = None,
                   keep: Sequence[str] = ()) -> DataFrame:
    """Long (feature, x, y[, group]) rows for every feature: the data behind scatter plots."""
    extra = list(keep) + ([group] if group else []) + [_clean(df, y).cast("double").alias("y")]
    long = _long_numeric(df, x_cols, extra=extra)
    return long.select(*keep, *([group] if group else []), F.col("column").alias("feature"),
                       F.col("v").alias("x"), "y")
