"""Ordering of results: rank models, pick the best, top-k classes, top-n, head."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.functions.scalars import rank_label


def _order_expr(col: str, order: Sequence[str] | None) -> Column:
    """Position of a name in a given order (unknown names last)."""
    if not order:
        return F.lit(0)
    m = F.create_map(*[x for i, name in enumerate(order) for x in (F.lit(name), F.lit(i))])
    return F.coalesce(F.element_at(m, F.col(col)), F.lit(len(order)))


# R1 ------------------------------------------------------------------------------------
def rank_models(metrics: DataFrame, metric: str, ascending: bool = True, model: str = "model",
                model_order: Sequence[str] | None = None) -> DataFrame:
    key = F.col(metric) if ascending else -F.col(metric)
    return metrics.orderBy(key, _order_expr(model, model_order), F.col(model))


# R2 ------------------------------------------------------------------------------------
def pick_best(metrics: DataFrame, metric: str, ascending: bool = True, by: Sequence[str] = (),
              model: str = "model", model_order: Sequence[str] | None = None) -> DataFrame:
    """One row per group: the best model; ties go to the earlier model in ``model_order``."""
    key = F.col(metric) if ascending else -F.col(metric)
    rank_key = F.struct(key.alias("_m"), _order_expr(model, model_order).alias("_o"), F.col(model).alias("_n"))
    cols = [c for c in metrics.columns if c not in by]
    best = metrics.groupBy(*by).agg(F.min_by(F.struct(*cols), rank_key).alias("_b"))
    return best.select(*by, "_b.*")


# R3 ------------------------------------------------------------------------------------
def top_k_classes(df: DataFrame, prob: str, classes: Sequence[str] | Column, k: int = 3,
                  digits: int | None = 4, prefix: str = "Top") -> DataFrame:
    """Columns ``{prefix}{i}_Class`` / ``{prefix}{i}_Prob`` for the k most probable classes.

    Sorting happens inside each row's array (no shuffle); ties go to the lower class index.
    Probabilities are rounded half-to-even to ``digits``.
    """
    cls = classes if isinstance(classes, Column) else F.array(*[F.lit(c) for c in classes])
    ranked = F.slice(F.array_sort(F.transform(
        F.col(prob), lambda p, i: F.struct((-p).alias("np"), i.alias("idx"), p.alias("p")))), 1, k)
    out = df.withColumn("_topk", ranked).withColumn("_cls", cls)
    for i in range(k):
        e = F.element_at("_topk", i + 1)
        pr = e["p"] if digits is None else F.bround(e["p"], digits)
        out = out.withColumn(f"{prefix}{i + 1}_Class", F.element_at("_cls", e["idx"] + 1)).withColumn(
            f"{prefix}{i + 1}_Prob", pr)
    return out.drop("_topk", "_cls")


def top_k_long(df: DataFrame, prob: str, classes: Sequence[str], k: int = 2, key: Sequence[str] = (),
               digits: int = 4) -> DataFrame:
    """The app's small table: (key..., Rank 'Top-i', Class, Prob), padded to k rows."""
    cls = F.array(*[F.lit(c) for c in classes])
    ranked = F.slice(F.array_sort(F.transform(
        F.col(prob), lambda p, i: F.struct((-p).alias("np"), i.alias("idx"), p.alias("p")))), 1, k)
    pos = F.sequence(F.lit(0), F.lit(k - 1))
    x = df.select(*key, ranked.alias("_r"), F.explode(pos).alias("_pos"))
    e = F.element_at("_r", F.col("_pos") + 1)
    return x.select(*key, rank_label(F.col("_pos")).alias("Rank"),
                    F.coalesce(F.element_at(cls, e["idx"] + 1), F.lit("")).alias("Class"),
                    F.bround(e["p"], digits).alias("Prob"))


# R4 / R5 -------------------------------------------------------------------------------
def top_n(df: DataFrame, col: str, n: int = 30, tie: str | None = None) -> DataFrame:
    keys = [F.desc(col)] + ([F.asc(tie)] if tie else [])
    return df.orderBy(*keys).limit(n)


def head_n(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(key).limit(n)
