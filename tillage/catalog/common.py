"""Shared pieces of the query catalogue: views, stand-in predictions, rounding."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions.target import interval_covered
from tillage.operators.folds import hash_split
from tillage.operators.order import group_quantiles
from tillage.operators.stats import attach_group_stats
from tillage.session import written
from tillage.sources.tables import YIELD_VIEW_SQL, read_table, sql_hash_bucket, yield_view

FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]
CATEGORICAL = ["l_returnflag", "o_orderpriority"]
DIGITS = 6


SIG_BITS = 32
GRID_SHIFT = 0.3183098861837907  # 1/pi: moves grid midpoints off every dyadic value


def r(c, d: int | None = None) -> Column:
    """Round for the engine comparison to 32 significant bits: x is scaled by a power of two
    (exact), shifted by 1/pi of a step, rounded to an integer and scaled back. Both engines do the
    same IEEE operations, so equal inputs give equal outputs; the shifted grid has no
    midpoint on decimal-derived values (ties), and 2^-32 relative is far above the
    engines' summation noise (~1e-14 relative).
    """
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    scale = F.pow(F.lit(2.0), F.lit(SIG_BITS) - F.floor(F.log2(F.abs(x))))
    phi = F.lit(GRID_SHIFT)
    return F.when((x == 0) | x.isNull(), x).otherwise(F.round(x * scale + phi, 0) / scale)


def sql_r(expr: str, d: int | None = None) -> str:
    x = f"CAST({expr} AS DOUBLE)"
    scale = f"pow(2.0, {SIG_BITS} - floor(log2(abs({x}))))"
    return f"(CASE WHEN {x} = 0 OR {x} IS NULL THEN {x} ELSE round({x} * {scale} + {GRID_SHIFT!r}) / {scale} END)"


def with_cte(*ctes: str) -> str:
    parts = [YIELD_VIEW_SQL.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts)


def yv(spark: SparkSession, sf: str) -> DataFrame:
    return yield_view(spark, sf)


def split_view(spark: SparkSession, sf: str) -> DataFrame:
    return hash_split(yv(spark, sf), "row_key")


STANDIN_COLS = ["row_key", "crop", "year", "region_nk", "yield", "l_quantity", "l_discount", "p_size"]


def standin_view(spark: SparkSession, sf: str) -> DataFrame:
    """What the stand-in predictors and intervals need of the view, with its split; written once, as they read it several times."""
    return written(split_view(spark, sf).select(*STANDIN_COLS, "split"), "standin-rows")


SPLIT_SQL = f"""ys AS (
  SELECT *, CASE WHEN {sql_hash_bucket('row_key', ':42', 1 << 32)} < {round(0.2 * (1 << 32))} THEN 'test' ELSE 'train' END AS split
  FROM yv
)"""

PLANTED = "1000 + 50 * l_quantity - 4000 * l_discount + 20 * p_size"


def planted_expr() -> Column:
    return F.lit(1000) + F.lit(50) * F.col("l_quantity") - F.lit(4000) * F.col("l_discount") + F.lit(20) * F.col("p_size")


def standin_predictions(spark: SparkSession, sf: str, view: DataFrame | None = None) -> DataFrame:
    """Long prediction table (model, split, row_key, crop, year, y, p) of two fixed
    predictors on the hash split: the planted formula and the training mean per crop.
    ``view``: standin_view, if there is one already."""
    d = standin_view(spark, sf) if view is None else view
    means = d.where(F.col("split") == "train").groupBy("crop").agg(F.avg("yield").alias("_m"))
    d = attach_group_stats(d, means, ["crop"])
    planted = d.select(F.lit("planted").alias("model"), "split", "row_key", "crop", "year", "region_nk",
                       F.col("yield").alias("y"), planted_expr().alias("p"))
    crop_mean = d.select(F.lit("crop_mean").alias("model"), "split", "row_key", "crop", "year", "region_nk",
                         F.col("yield").alias("y"), F.col("_m").alias("p"))
    return planted.unionByName(crop_mean)


STANDIN_SQL = f"""cm AS (SELECT crop, avg(yield) AS m FROM ys WHERE split = 'train' GROUP BY crop),
preds AS (
  SELECT 'planted' AS model, split, row_key, crop, year, region_nk, yield AS y, CAST({PLANTED} AS DOUBLE) AS p FROM ys
  UNION ALL
  SELECT 'crop_mean' AS model, split, row_key, ys.crop, year, region_nk, yield AS y, cm.m AS p
  FROM ys JOIN cm ON ys.crop = cm.crop
)"""


def crop_interval_bounds(spark: SparkSession, sf: str, view: DataFrame | None = None) -> DataFrame:
    """Test rows with p10 / p90 = training quantiles of their crop, and coverage. ``view``: standin_view, if there is one already."""
    d = standin_view(spark, sf) if view is None else view
    q = group_quantiles(d.where(F.col("split") == "train"), "yield", [0.1, 0.9], by=["crop"], names=["p10", "p90"])
    t = attach_group_stats(d.where(F.col("split") == "test"), q, ["crop"])
    return t.withColumn("covered", interval_covered("yield", "p10", "p90"))


BOUNDS_SQL = """cq AS (
  SELECT crop, quantile_cont(yield, 0.1) AS p10, quantile_cont(yield, 0.9) AS p90 FROM ys WHERE split = 'train' GROUP BY crop
),
tb AS (
  SELECT ys.*, cq.p10, cq.p90, CAST(yield BETWEEN cq.p10 AND cq.p90 AS INTEGER) AS covered
  FROM ys JOIN cq ON ys.crop = cq.crop WHERE split = 'test'
)"""


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings")


def class_standin(spark: SparkSession, sf: str) -> DataFrame:
    """(model, vec_id, y, p): two fixed predictors that err on a key pattern."""
    e = embeddings(spark, sf)
    y = F.concat(F.lit("c"), F.col("label").cast("string"))
    m1 = e.select(F.lit("shift7").alias("model"), "vec_id", y.alias("y"),
                  F.concat(F.lit("c"), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10)
                           .otherwise(F.col("label")).cast("string")).alias("p"))
    m2 = e.select(F.lit("shift5").alias("model"), "vec_id", y.alias("y"),
                  F.concat(F.lit("c"), F.when(F.col("vec_id") % 5 == 0, (F.col("label") + 3) % 10)
                           .otherwise(F.col("label")).cast("string")).alias("p"))
    return m1.unionByName(m2)


CLASS_SQL = """cp AS (
  SELECT 'shift7' AS model, vec_id, 'c' || CAST(label AS VARCHAR) AS y,
         'c' || CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS VARCHAR) AS p FROM embeddings
  UNION ALL
  SELECT 'shift5' AS model, vec_id, 'c' || CAST(label AS VARCHAR) AS y,
         'c' || CAST(CASE WHEN vec_id % 5 = 0 THEN (label + 3) % 10 ELSE label END AS VARCHAR) AS p FROM embeddings
)"""
