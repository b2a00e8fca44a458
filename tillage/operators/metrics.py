"""Evaluation metrics over long prediction tables (model, split, fold, group, y, p).

One grouped aggregation computes every metric for every (model, split, ...) at once:
the shuffle carries one partial-aggregate row per group and task, never the rows.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.operators.stats import attach_group_stats
from pyspark.sql.window import Window



# A11 -----------------------------------------------------------------------------------
def regression_metrics(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R² per group. Rows with a null truth or prediction are ignored.

    R² = 1 - SSE/SST; SST = 0 gives 1.0 when SSE = 0 else 0.0; fewer than two rows gives null.
    """
    by = list(by)
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    e = F.col(p) - F.col(y)
    agg = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"),
                             F.avg(e * e).alias("_mse"), F.sum(e * e).alias("_sse"),
                             (F.var_pop(F.col(y)) * F.count(F.col(y))).alias("_sst"))
    r2 = (F.when(F.col("n") < 2, F.lit(None).cast("double"))
           .when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
           .otherwise(F.lit(1.0) - F.col("_sse") / F.col("_sst")))
    return agg.select(*by, "n", "mae", F.sqrt("_mse").alias("rmse"), r2.alias("r2"))


# A12 -----------------------------------------------------------------------------------
def interval_coverage(df: DataFrame, covered: str = "covered", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(covered).cast("double")).alias("coverage"),
                               F.count(F.col(covered)).alias("n"))


# A13 -----------------------------------------------------------------------------------
def fold_average(metrics: DataFrame, by: Sequence[str] = ("model",),
                 cols: Sequence[str] = ("mae", "rmse", "r2")) -> DataFrame:
    """Unweighted mean of per-fold metrics."""
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n_folds"))


# A14 -----------------------------------------------------------------------------------
def group_summary(metrics: DataFrame, group: str, model: str = "model") -> DataFrame:
    """Best MAE, best RMSE and best R² per group, each taken independently, plus the
    model with the lowest MAE (ties: first by model name)."""
    return metrics.groupBy(group).agg(
        F.min_by(model, F.struct("mae", model)).alias("best_model"),
        F.min("mae").alias("test_mae"), F.min("rmse").alias("test_rmse"), F.max("r2").alias("test_r2"))


# A15 / A16 -----------------------------------------------------------------------------
def best_fit_line(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line p = slope·y + intercept (null when y is constant)."""
    return df.groupBy(*by).agg(F.regr_slope(F.col(p), F.col(y)).alias("slope"),
                               F.regr_intercept(F.col(p), F.col(y)).alias("intercept"))


def axis_limits(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.least(F.min(y), F.min(p)).alias("lo"),
                               F.greatest(F.max(y), F.max(p)).alias("hi"))


# A19 / A18 / A20 -----------------------------------------------------------------------
def _class_counts(df: DataFrame, y: str, p: str, by: list) -> DataFrame:
    """(by, label, support, predicted, hits) from one pre-aggregated (y, p) count table."""
    pairs = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, F.col(y).alias("_y"),
                                                                           F.col(p).alias("_p")).count()
    hit = F.when(F.col("_y") == F.col("_p"), F.col("count")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("_y").alias("label"), F.col("count").alias("sup"), F.lit(0).cast("long").alias("pred"),
                 hit.cast("long").alias("tp")),
        F.struct(F.col("_p").alias("label"), F.lit(0).cast("long").alias("sup"), F.col("count").alias("pred"),
                 F.lit(0).cast("long").alias("tp")))
    return (pairs.select(*by, F.explode(sides).alias("_s"))
                 .groupBy(*by, F.col("_s.label").alias("label"))
                 .agg(F.sum("_s.sup").alias("support"), F.sum("_s.pred").alias("predicted"),
                      F.sum("_s.tp").alias("hits")))


def classification_report(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Per-class precision, recall, F1 and support, then 'accuracy', 'macro avg' and
    'weighted avg' rows (0/0 → 0). The accuracy row repeats the accuracy in every column.

    Labels are those seen in truth or prediction; ``row_order`` sorts classes by label,
    then the three summary rows.
    """
    by = list(by)
    cc = _class_counts(df, y, p, by)
    prec = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(F.lit(0.0))
    cls = cc.select(*by, F.col("label").cast("string").alias("label"), prec.alias("precision"),
                    rec.alias("recall"), F.col("support").cast("double").alias("support"), "hits")
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(F.lit(0.0))
    cls = cls.withColumn("f1_score", f1)
    tot = cls.groupBy(*by).agg(
        F.sum("support").alias("_n"), F.sum("hits").alias("_hits"),
        F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1_score").alias("_mf"),
        F.sum(F.col("precision") * F.col("support")).alias("_wp"),
        F.sum(F.col("recall") * F.col("support")).alias("_wr"),
        F.sum(F.col("f1_score") * F.col("support")).alias("_wf"))
    acc = F.col("_hits") / F.col("_n")
    summary = tot.select(*by, F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"),
                 acc.alias("f1_score"), acc.alias("support"), F.lit(1).alias("_o")),
        F.struct(F.lit("macro avg").alias("label"), F.col("_mp").alias("precision"), F.col("_mr").alias("recall"),
                 F.col("_mf").alias("f1_score"), F.col("_n").alias("support"), F.lit(2).alias("_o")),
        F.struct(F.lit("weighted avg").alias("label"), (F.col("_wp") / F.col("_n")).alias("precision"),
                 (F.col("_wr") / F.col("_n")).alias("recall"), (F.col("_wf") / F.col("_n")).alias("f1_score"),
                 F.col("_n").alias("support"), F.lit(3).alias("_o")))).alias("_s")).select(*by, "_s.*")
    cls = cls.select(*by, "label", "precision", "recall", "f1_score", "support", F.lit(0).alias("_o"))
    out = cls.unionByName(summary)
    w = Window.partitionBy(*by).orderBy("_o", "label") if by else Window.orderBy("_o", "label")
    return out.withColumn("row_order", F.row_number().over(w) - 1).drop("_o")


def accuracy_macro_f1(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro-F1 (mean over labels seen in truth or prediction)."""
    by = list(by)
    cc = _class_counts(df, y, p, by)
    prec = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return cc.groupBy(*by).agg((F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def confusion_matrix(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = (),
                     labels: Sequence[str] | None = None, dense: bool = False) -> DataFrame:
    """Counts in long form (by, y, p, count): the cells that occur, or with ``dense`` all K × K cells of
    the label set (truth ∪ prediction, or ``labels``), zeros included. Groups may have a null key.
    """
    by = list(by)
    counts = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(
        *by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("count"))
    if not dense:
        return counts if labels is None else counts.where(F.col("y").isin(list(labels)) & F.col("p").isin(list(labels)))
    if labels is None:
        lab = (df.select(*by, F.col(y).alias("_l")).union(df.select(*by, F.col(p).alias("_l")))
                 .where(F.col("_l").isNotNull()).distinct())
        arr = lab.groupBy(*by).agg(F.sort_array(F.collect_list("_l")).alias("_ls"))
    else:
        arr = df.sparkSession.range(1).select(F.array(*[F.lit(x) for x in labels]).alias("_ls"))
        if by:
            arr = df.select(*by).distinct().select(*by, F.array(*[F.lit(x) for x in labels]).alias("_ls"))
    cells = (arr.select(*by, "_ls", F.explode("_ls").alias("y"))
                .select(*by, "y", F.explode("_ls").alias("p")))
    keys = [*by, "y", "p"]
    out = attach_group_stats(cells, counts, keys)
    return out.select(*keys, F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def confusion_matrix_wide(long: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pivot the long matrix to one column per predicted label (labels given, so no extra job)."""
    return long.groupBy(*by, "y").pivot("p", list(labels)).agg(F.sum("count")).orderBy(*by, "y")


# A21 / A22 / A23 -----------------------------------------------------------------------
def distinct_sorted(df: DataFrame, col: str, as_text: bool = False) -> DataFrame:
    c = F.col(col).cast("string") if as_text else F.col(col)
    return df.select(c.alias(col)).where(F.col(col).isNotNull()).distinct().orderBy(col)


def row_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(split) == "train").alias("n_train"),
                  F.count_if(F.col(split) == "test").alias("n_test"))


def class_weights_balanced(df: DataFrame, label: str) -> DataFrame:
    """n / (K · n_c) per class (K = number of classes)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n = counts.select(F.sum("n_c")).scalar()
    k = counts.select(F.count(F.lit(1))).scalar()
    return counts.select(label, "n_c", (n / (k * F.col("n_c"))).alias("weight"))
