"""Catalogue: metrics (A11-A23), ranking (R1-R5, N19), unions (U1, U2), splits and folds
(M1-M5), preprocessing (M6-M8), permutation importance (M15) and alignment (J3)."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillage.catalog.common import (BOUNDS_SQL, CATEGORICAL, CLASS_SQL, FEATURES, PLANTED, SPLIT_SQL, STANDIN_SQL,
                                    class_standin, crop_interval_bounds, embeddings, planted_expr, r, split_view,
                                    sql_r, standin_predictions, standin_view, with_cte, yv)
from tillage.operators import folds as FO
from tillage.operators import metrics as M
from tillage.operators import ranking as R
from tillage.operators.features import MedianImputeScaler, category_index, standardizer_stats
from tillage.operators.joins import align_truth_and_predictions
from tillage.operators.sets import collect_result_rows, concat_fold_predictions
from tillage.operators.stats import attach_group_stats
from tillage.plans.importance import permutation_importance
from tillage.session import written

MODEL_ORDER = ["planted", "crop_mean"]


def _rm(df, *keep):
    return df.select(*keep, *[r(c).alias(c) for c in ("mae", "rmse", "r2")])


def _metric_sql(by, rounded=True):
    rr = sql_r if rounded else (lambda e: e)
    return (f"SELECT {by}, count(*) AS n, {rr('avg(abs(p - y))')} AS mae, {rr('sqrt(avg((p - y) * (p - y)))')} AS rmse, "
            f"{rr('CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(y) * count(y) = 0 THEN (CASE WHEN sum((p - y) * (p - y)) = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)) END')} AS r2")


def a11(spark, sf):
    m = M.regression_metrics(standin_predictions(spark, sf), by=["model", "split"])
    return _rm(m, "model", "split", "n")


A11_SQL = with_cte(SPLIT_SQL, STANDIN_SQL) + "\n" + _metric_sql("model, split") + " FROM preds GROUP BY model, split"


def a12(spark, sf):
    c = M.interval_coverage(crop_interval_bounds(spark, sf), "covered", by=["crop"])
    return c.select("crop", r("coverage").alias("coverage"), "n")


A12_SQL = with_cte(SPLIT_SQL, BOUNDS_SQL) + "\nSELECT crop, " + sql_r("avg(covered)") + " AS coverage, count(covered) AS n FROM tb GROUP BY crop"


def _loyo_predictions(spark, sf, view=None):
    """Each row once, as test row of its own year fold: planted, and the crop mean of the
    other years (the training folds), from per-(crop, year) sums."""
    if view is None:
        view = standin_view(spark, sf)
    d = view.where(F.col("year").isNotNull())
    cy = d.groupBy("crop", "year").agg(F.sum("yield").alias("_s_cy"), F.count(F.lit(1)).alias("_n_cy"))
    c = d.groupBy("crop").agg(F.sum("yield").alias("_s_c"), F.count(F.lit(1)).alias("_n_c"))
    j = attach_group_stats(attach_group_stats(d, cy, ["crop", "year"]), c, ["crop"])
    cm = (F.col("_s_c") - F.col("_s_cy")) / (F.col("_n_c") - F.col("_n_cy"))
    base = j.select(F.col("year").alias("fold"), "row_key", "crop", F.col("yield").alias("y"), planted_expr().alias("_pp"),
                    F.when(F.col("_n_c") > F.col("_n_cy"), cm).alias("_pc"))
    return concat_fold_predictions([
        base.select("fold", F.lit("planted").alias("model"), "row_key", "crop", "y", F.col("_pp").alias("p")),
        base.select("fold", F.lit("crop_mean").alias("model"), "row_key", "crop", "y", F.col("_pc").alias("p"))])


LOYO_SQL = f"""cy AS (SELECT crop, year, sum(yield) AS s_cy, count(*) AS n_cy FROM yv WHERE year IS NOT NULL GROUP BY 1, 2),
cc AS (SELECT crop, sum(yield) AS s_c, count(*) AS n_c FROM yv WHERE year IS NOT NULL GROUP BY 1),
lp AS (
  SELECT yv.year AS fold, 'planted' AS model, row_key, yv.crop, yield AS y, CAST({PLANTED} AS DOUBLE) AS p FROM yv WHERE year IS NOT NULL
  UNION ALL
  SELECT yv.year AS fold, 'crop_mean' AS model, row_key, yv.crop, yield AS y,
         CASE WHEN n_c > n_cy THEN (s_c - s_cy) / (n_c - n_cy) END AS p
  FROM yv JOIN cy ON yv.crop = cy.crop AND yv.year = cy.year JOIN cc ON yv.crop = cc.crop
)"""


def _fold_metrics(spark, sf, view=None):
    return M.regression_metrics(_loyo_predictions(spark, sf, view), by=["fold", "model"])


FOLD_METRICS_SQL = "fm AS (" + _metric_sql("fold, model", rounded=False) + " FROM lp GROUP BY fold, model)"


def a13(spark, sf):
    a = M.fold_average(_fold_metrics(spark, sf), by=["model"])
    return _rm(a, "model", "n_folds")


A13_SQL = with_cte(LOYO_SQL, FOLD_METRICS_SQL) + (
    "\nSELECT model, count(*) AS n_folds, " + sql_r("avg(mae)") + " AS mae, " + sql_r("avg(rmse)") + " AS rmse, "
    + sql_r("avg(r2)") + " AS r2 FROM fm GROUP BY model")


def _test_metrics_by_crop(spark, sf):
    p = standin_predictions(spark, sf).where(F.col("split") == "test")
    return M.regression_metrics(p, by=["crop", "model"])


def a14(spark, sf):
    s = M.group_summary(_test_metrics_by_crop(spark, sf), "crop")
    return s.select("crop", "best_model", *[r(c).alias(c) for c in ("test_mae", "test_rmse", "test_r2")])


A14_SQL = with_cte(SPLIT_SQL, STANDIN_SQL, "cmx AS (" + _metric_sql("crop, model", rounded=False) + " FROM preds WHERE split = 'test' GROUP BY crop, model)") + """
SELECT crop, arg_min(model, (mae, model)) AS best_model, """ + sql_r("min(mae)") + " AS test_mae, " + sql_r("min(rmse)") + \
    " AS test_rmse, " + sql_r("max(r2)") + " AS test_r2 FROM cmx GROUP BY crop"


def a15(spark, sf):
    p = standin_predictions(spark, sf).where(F.col("split") == "test")
    return M.best_fit_line(p, by=["model"]).select("model", r("slope").alias("slope"), r("intercept").alias("intercept"))


A15_SQL = with_cte(SPLIT_SQL, STANDIN_SQL) + "\nSELECT model, " + sql_r("regr_slope(p, y)") + " AS slope, " + \
    sql_r("regr_intercept(p, y)") + " AS intercept FROM preds WHERE split = 'test' GROUP BY model"


def a16(spark, sf):
    p = standin_predictions(spark, sf).where(F.col("split") == "test")
    return M.axis_limits(p, by=["model"]).select("model", r("lo").alias("lo"), r("hi").alias("hi"))


A16_SQL = with_cte(SPLIT_SQL, STANDIN_SQL) + "\nSELECT model, " + sql_r("least(min(y), min(p))") + " AS lo, " + \
    sql_r("greatest(max(y), max(p))") + " AS hi FROM preds WHERE split = 'test' GROUP BY model"


def a17(spark, sf):
    s = standardizer_stats(yv(spark, sf), FEATURES)
    return s.select("position", "feature", r("mean").alias("mean"), r("std").alias("std"))


def a17_sql():
    parts = [f"SELECT {i} AS position, '{c}' AS feature, {sql_r(f'avg(CAST({c} AS DOUBLE))')} AS mean, "
             f"{sql_r(f'CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) > 1e-8 THEN stddev_pop(CAST({c} AS DOUBLE)) ELSE 1.0 END')} AS std FROM yv"
             for i, c in enumerate(FEATURES)]
    return with_cte() + "\n" + "\nUNION ALL\n".join(parts)


CLASS_COUNTS_SQL = """cc2 AS (
  SELECT model, label, sum(sup) AS support, sum(pred) AS predicted, sum(tp) AS hits FROM (
    SELECT model, y AS label, 1 AS sup, 0 AS pred, CASE WHEN y = p THEN 1 ELSE 0 END AS tp FROM cp
    UNION ALL SELECT model, p AS label, 0, 1, 0 FROM cp) GROUP BY model, label
),
pr AS (SELECT model, label, support, hits,
         CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall FROM cc2),
pf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)"""


def a18(spark, sf):
    a = M.accuracy_macro_f1(class_standin(spark, sf), by=["model"])
    return a.select("model", r("accuracy").alias("accuracy"), r("macro_f1").alias("macro_f1"))


A18_SQL = "WITH " + CLASS_SQL + ",\n" + CLASS_COUNTS_SQL + "\nSELECT model, " + sql_r("sum(hits) / sum(support)") + \
    " AS accuracy, " + sql_r("avg(f1)") + " AS macro_f1 FROM pf GROUP BY model"


def a19(spark, sf):
    rep = M.classification_report(class_standin(spark, sf), by=["model"])
    return rep.select("model", "label", *[r(c).alias(c) for c in ("precision", "recall", "f1_score", "support")], "row_order")


A19_SQL = "WITH " + CLASS_SQL + ",\n" + CLASS_COUNTS_SQL + """,
tot AS (SELECT model, sum(support) AS n, sum(hits) AS h, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
               sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM pf GROUP BY model),
allr AS (
  SELECT model, label, precision, recall, f1 AS f1_score, CAST(support AS DOUBLE) AS support, 0 AS o FROM pf
  UNION ALL SELECT model, 'accuracy', h / n, h / n, h / n, h / n, 1 FROM tot
  UNION ALL SELECT model, 'macro avg', mp, mr, mf, n, 2 FROM tot
  UNION ALL SELECT model, 'weighted avg', wp / n, wr / n, wf / n, n, 3 FROM tot
)
SELECT model, label, """ + ", ".join(sql_r(c) + f" AS {c}" for c in ("precision", "recall", "f1_score", "support")) + \
    ", CAST(row_number() OVER (PARTITION BY model ORDER BY o, label) - 1 AS INTEGER) AS row_order FROM allr"


def a20(spark, sf):
    return M.confusion_matrix(class_standin(spark, sf), by=["model"], dense=True)


A20_SQL = "WITH " + CLASS_SQL + """,
lab AS (SELECT DISTINCT model, l FROM (SELECT model, y AS l FROM cp UNION ALL SELECT model, p FROM cp)),
cnt AS (SELECT model, y, p, count(*) AS n FROM cp GROUP BY ALL)
SELECT a.model, a.l AS y, b.l AS p, CAST(coalesce(cnt.n, 0) AS BIGINT) AS count
FROM lab a JOIN lab b ON a.model = b.model LEFT JOIN cnt ON cnt.model = a.model AND cnt.y = a.l AND cnt.p = b.l"""


def a21(spark, sf):
    return M.distinct_sorted(yv(spark, sf), "year")


A21_SQL = with_cte() + "\nSELECT DISTINCT year FROM yv WHERE year IS NOT NULL"


def a22(spark, sf):
    return M.row_counts(split_view(spark, sf))


A22_SQL = with_cte(SPLIT_SQL) + "\nSELECT count(*) AS n_rows, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test FROM ys"


def a23(spark, sf):
    w = M.class_weights_balanced(embeddings(spark, sf), "label")
    return w.select("label", "n_c", r("weight").alias("weight"))


A23_SQL = """WITH c AS (SELECT label, count(*) AS n_c FROM embeddings WHERE label IS NOT NULL GROUP BY label)
SELECT label, n_c, """ + sql_r("(SELECT sum(n_c) FROM c) / ((SELECT count(*) FROM c) * n_c)") + " AS weight FROM c"


def r1(spark, sf):
    m = M.regression_metrics(standin_predictions(spark, sf).where(F.col("split") == "test"), by=["model"])
    ranked = R.rank_models(m, "mae", model_order=MODEL_ORDER)
    w = Window.orderBy("mae", "model")  # a handful of model rows
    return _rm(ranked.withColumn("rank", F.row_number().over(w)), "model", "rank")


R1_SQL = with_cte(SPLIT_SQL, STANDIN_SQL, "tm AS (" + _metric_sql("model", rounded=False) + " FROM preds WHERE split = 'test' GROUP BY model)") + \
    "\nSELECT model, row_number() OVER (ORDER BY mae, model) AS rank, " + sql_r("mae") + " AS mae, " + sql_r("rmse") + " AS rmse, " + sql_r("r2") + " AS r2 FROM tm"


def r2(spark, sf):
    best = R.pick_best(_test_metrics_by_crop(spark, sf), "mae", by=["crop"], model_order=MODEL_ORDER)
    return _rm(best, "crop", "model")


R2_SQL = with_cte(SPLIT_SQL, STANDIN_SQL, "cmx AS (" + _metric_sql("crop, model", rounded=False) + " FROM preds WHERE split = 'test' GROUP BY crop, model)") + \
    "\nSELECT crop, model, " + sql_r("mae") + " AS mae, " + sql_r("rmse") + " AS rmse, " + sql_r("r2") + " AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY mae, " \
    "CASE model WHEN 'planted' THEN 0 WHEN 'crop_mean' THEN 1 ELSE 2 END, model) AS k FROM cmx) WHERE k = 1"

CLASSES = [f"c{i}" for i in range(64)]


def _softmax_frame(spark, sf):
    e = embeddings(spark, sf)
    v = F.transform("embedding", lambda x: x.cast("double"))
    ex = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    s = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.transform(ex, lambda x: x / s).alias("prob"))


def r3(spark, sf):
    t = R.top_k_classes(_softmax_frame(spark, sf), "prob", CLASSES, k=3)
    return t.drop("prob")


SOFTMAX_SQL = """e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
em AS (SELECT vec_id, max(CAST(x AS DOUBLE)) AS mx FROM e GROUP BY vec_id),
ez AS (SELECT e.vec_id, i, exp(CAST(x AS DOUBLE) - mx) AS z FROM e JOIN em ON e.vec_id = em.vec_id),
es AS (SELECT vec_id, sum(z) AS sz FROM ez GROUP BY vec_id),
pr AS (SELECT ez.vec_id, i, z / sz AS p, row_number() OVER (PARTITION BY ez.vec_id ORDER BY z DESC, i) AS rk
       FROM ez JOIN es ON ez.vec_id = es.vec_id)"""

R3_SQL = "WITH " + SOFTMAX_SQL + "\nSELECT vec_id, " + ", ".join(
    f"max(CASE WHEN rk = {k} THEN 'c' || CAST(i AS VARCHAR) END) AS Top{k}_Class, "
    f"max(CASE WHEN rk = {k} THEN round_even(p, 4) END) AS Top{k}_Prob" for k in (1, 2, 3)) + " FROM pr GROUP BY vec_id"


def n19(spark, sf):
    return R.top_k_long(_softmax_frame(spark, sf), "prob", CLASSES, k=2, key=["vec_id"])


N19_SQL = "WITH " + SOFTMAX_SQL + "\nSELECT vec_id, 'Top-' || CAST(rk AS VARCHAR) AS Rank, 'c' || CAST(i AS VARCHAR) AS Class, round_even(p, 4) AS Prob FROM pr WHERE rk <= 2"


def r4(spark, sf):
    from tillage.operators.profile import correlation_matrix
    from tillage.catalog.q_profile import CORR_COLS
    c = correlation_matrix(yv(spark, sf), CORR_COLS).where(F.col("col_a") < F.col("col_b"))
    c = c.withColumn("abs_corr", r(F.abs("corr"))).withColumn("pair", F.concat_ws("~", "col_a", "col_b"))
    return R.top_n(c, "abs_corr", 10, tie="pair").select("col_a", "col_b", "abs_corr")


def r4_sql():
    from tillage.catalog.q_profile import CORR_COLS
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            if a < b:
                x = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
                y = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
                den = f"(stddev_pop({x}) * stddev_pop({y}))"
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                             f"{sql_r(f'abs(CASE WHEN {den} > 0 THEN covar_pop({x}, {y}) / {den} END)')} AS abs_corr FROM yv")
    return with_cte("cm2 AS (" + " UNION ALL ".join(parts) + ")") + \
        "\nSELECT col_a, col_b, abs_corr FROM cm2 ORDER BY abs_corr DESC NULLS LAST, col_a || '~' || col_b LIMIT 10"


def r5(spark, sf):
    p = standin_predictions(spark, sf).where((F.col("split") == "test") & (F.col("model") == "planted"))
    return R.head_n(p.select("row_key", r("y").alias("y"), r("p").alias("p")), "row_key", 5)


R5_SQL = with_cte(SPLIT_SQL, STANDIN_SQL) + "\nSELECT row_key, " + sql_r("y") + " AS y, " + sql_r("p") + \
    " AS p FROM preds WHERE split = 'test' AND model = 'planted' ORDER BY row_key LIMIT 5"


def u1(spark, sf):
    lp = _loyo_predictions(spark, sf)
    fm = M.regression_metrics(lp, by=["fold", "model"])
    best = R.pick_best(fm, "mae", by=["fold"], model_order=MODEL_ORDER).select("fold", "model")
    out = attach_group_stats(lp, best.withColumn("_best", F.lit(True)), ["fold", "model"]).where("_best")
    return out.select("fold", "model", "row_key", r("y").alias("y"), r("p").alias("p"))


U1_SQL = with_cte(LOYO_SQL, FOLD_METRICS_SQL, """bf AS (SELECT fold, model FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY mae,
             CASE model WHEN 'planted' THEN 0 WHEN 'crop_mean' THEN 1 ELSE 2 END, model) AS k FROM fm) WHERE k = 1)""") + \
    "\nSELECT lp.fold, lp.model, row_key, " + sql_r("y") + " AS y, " + sql_r("p") + " AS p FROM lp JOIN bf ON lp.fold = bf.fold AND lp.model = bf.model"


def u2(spark, sf):
    view = standin_view(spark, sf)
    rnd = M.regression_metrics(standin_predictions(spark, sf, view).where(F.col("split") == "test"), by=["model"])
    cov = crop_interval_bounds(spark, sf, view).select(F.avg("covered").alias("coverage80"))
    rnd = rnd.select(F.lit("random").alias("mode"), "model", "mae", "rmse", "r2", cov.scalar().alias("coverage80"))
    loyo = M.fold_average(_fold_metrics(spark, sf, view), by=["model"]).select(F.lit("loyo").alias("mode"), "model", "mae", "rmse", "r2")
    out = collect_result_rows([rnd, loyo])
    return out.select("mode", "model", *[r(c).alias(c) for c in ("mae", "rmse", "r2", "coverage80")])


U2_SQL = with_cte(SPLIT_SQL, STANDIN_SQL, BOUNDS_SQL, LOYO_SQL, FOLD_METRICS_SQL,
                  "tm AS (" + _metric_sql("model") + " FROM preds WHERE split = 'test' GROUP BY model)") + f"""
SELECT 'random' AS mode, model, mae, rmse, r2, {sql_r('(SELECT avg(covered) FROM tb)')} AS coverage80 FROM tm
UNION ALL
SELECT 'loyo', model, {sql_r('avg(mae)')}, {sql_r('avg(rmse)')}, {sql_r('avg(r2)')}, NULL FROM fm GROUP BY model"""


def m1(spark, sf):
    return FO.hash_split(yv(spark, sf), "row_key").select("row_key", "split")


M1_SQL = with_cte(SPLIT_SQL) + "\nSELECT row_key, split FROM ys"


def m1_exact(spark, sf):
    return FO.exact_split(yv(spark, sf).select("row_key"), "row_key").select("row_key", "split")


M1E_SQL = with_cte() + """
SELECT row_key, CASE WHEN row_number() OVER (ORDER BY md5(row_key || ':42')) - 1 < ceil(count(*) OVER () * 0.2)
                     THEN 'test' ELSE 'train' END AS split FROM yv"""


def m2(spark, sf):
    return FO.stratified_split(yv(spark, sf).select("row_key", "crop"), "crop", "row_key").select("row_key", "crop", "split")


M2_SQL = with_cte() + """
SELECT row_key, crop, CASE WHEN row_number() OVER (PARTITION BY crop ORDER BY md5(row_key || ':42')) - 1
                                < floor(count(*) OVER (PARTITION BY crop) * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split
FROM yv WHERE crop IS NOT NULL"""


def m3(spark, sf):
    return FO.kfold_ids(yv(spark, sf).select("row_key"), 5, ["row_key"], total_order=True)


M3_SQL = with_cte("ix AS (SELECT row_key, row_number() OVER (ORDER BY row_key) - 1 AS i, count(*) OVER () AS n FROM yv)") + """
SELECT row_key, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN floor(i / (n // 5 + 1))
                     ELSE (n % 5) + floor((i - (n % 5) * (n // 5 + 1)) / (n // 5)) END AS INTEGER) AS fold FROM ix"""


def m4(spark, sf):
    f = FO.logo_fold_sizes(yv(spark, sf), "year", "yield")
    return f.select("fold", "n_train", "n_test", r("sum_y_train").alias("sum_y_train"), r("sum_y_test").alias("sum_y_test"))


def _logo_sql(key):
    return with_cte(f"pf2 AS (SELECT {key} AS fold, count(*) AS n_test, sum(yield) AS sum_y_test FROM yv GROUP BY 1)",
                    "tt AS (SELECT count(*) AS n, sum(yield) AS s FROM yv)") + f"""
SELECT fold, n - n_test AS n_train, n_test, {sql_r('s - sum_y_test')} AS sum_y_train, {sql_r('sum_y_test')} AS sum_y_test
FROM pf2, tt WHERE fold IS NOT NULL AND n - n_test > 0 AND n_test > 0"""


def m5(spark, sf):
    f = FO.logo_fold_sizes(yv(spark, sf), "region_nk", "yield", as_text=True)
    return f.select("fold", "n_train", "n_test", r("sum_y_train").alias("sum_y_train"), r("sum_y_test").alias("sum_y_test"))


def m6(spark, sf):
    d = split_view(spark, sf)
    model = MedianImputeScaler(inputCols=FEATURES, outputCols=[f"{c}__num" for c in FEATURES]).fit(
        d.where(F.col("split") == "train"))
    return model.transform(d).select("row_key", *[r(f"{c}__num").alias(f"{c}__num") for c in FEATURES])


def m6_sql():
    med = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS md_{c}" for c in FEATURES)
    st = ", ".join(f"avg(coalesce(CAST({c} AS DOUBLE), md_{c})) AS m_{c}, "
                   f"CASE WHEN stddev_pop(coalesce(CAST({c} AS DOUBLE), md_{c})) > 0 THEN stddev_pop(coalesce(CAST({c} AS DOUBLE), md_{c})) ELSE 1.0 END AS s_{c}"
                   for c in FEATURES)
    sel = ", ".join(sql_r(f"(coalesce(CAST({c} AS DOUBLE), md_{c}) - m_{c}) / s_{c}") + f" AS {c}__num" for c in FEATURES)
    return with_cte(SPLIT_SQL, f"md AS (SELECT {med} FROM ys WHERE split = 'train')",
                    f"st AS (SELECT {st} FROM ys, md WHERE split = 'train')") + f"\nSELECT row_key, {sel} FROM ys, md, st"


def m7(spark, sf):
    d = split_view(spark, sf)
    train = d.where(F.col("split") == "train")
    for c in CATEGORICAL:
        d = category_index(d, train, c)
    return d.select("row_key", *[f"{c}__idx" for c in CATEGORICAL])


def m7_sql():
    ctes = [SPLIT_SQL]
    sel = []
    for c in CATEGORICAL:
        ctes.append(f"v_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM "
                    f"(SELECT DISTINCT {c} AS v FROM ys WHERE split = 'train' AND {c} IS NOT NULL))")
        ctes.append(f"mo_{c} AS (SELECT {c} AS v FROM ys WHERE split = 'train' AND {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
        sel.append(f"(SELECT i FROM v_{c} WHERE v_{c}.v = coalesce(ys.{c}, (SELECT v FROM mo_{c}))) AS {c}__idx")
    return with_cte(*ctes) + f"\nSELECT row_key, {', '.join(sel)} FROM ys"


def m8(spark, sf):
    train = split_view(spark, sf).where(F.col("split") == "train")
    num = spark.createDataFrame([(i, c) for i, c in enumerate(FEATURES)], "position int, name string")
    parts = [num]
    offset = F.lit(len(FEATURES))
    for k, c in enumerate(CATEGORICAL):
        vals = train.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct()
        w = Window.orderBy("v")  # one row per category of one column
        named = vals.select((F.row_number().over(w) - 1).alias("_j"), F.concat(F.lit(f"{c}_"), F.col("v")).alias("name"))
        parts.append(named.select((offset + F.col("_j")).cast("int").alias("position"), "name"))
        offset = offset + vals.select(F.count(F.lit(1))).scalar()
    return collect_result_rows(parts)


def m8_sql():
    num = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS name" for i, c in enumerate(FEATURES))
    parts, off = [num], str(len(FEATURES))
    for c in CATEGORICAL:
        parts.append(f"SELECT CAST({off} + row_number() OVER (ORDER BY v) - 1 AS INTEGER), '{c}_' || v FROM "
                     f"(SELECT DISTINCT {c} AS v FROM ys WHERE split = 'train' AND {c} IS NOT NULL)")
        off = f"{off} + (SELECT count(DISTINCT {c}) FROM ys WHERE split = 'train')"
    return with_cte(SPLIT_SQL) + "\n" + "\nUNION ALL\n".join(parts)


PI_FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]


def m15(spark, sf):
    test = written(split_view(spark, sf).where(F.col("split") == "test").select("row_key", *PI_FEATURES, "yield"), "importance-rows")
    imp = permutation_importance(test, "row_key", PI_FEATURES, lambda d: d.withColumn("prediction", planted_expr()),
                                 "yield", n_repeats=5, seed=42)
    return imp.select("feature", r("importance_mean").alias("importance_mean"), r("importance_std").alias("importance_std"))


def m15_sql():
    vals = ", ".join(f"('{c}')" for c in PI_FEATURES)
    donor = "CASE f " + " ".join(f"WHEN '{c}' THEN CAST({c} AS DOUBLE)" for c in PI_FEATURES) + " END"
    def sub(c):
        return f"(CASE WHEN f = '{c}' THEN dv ELSE {c} END)"
    p = f"1000 + 50 * {sub('l_quantity')} - 4000 * {sub('l_discount')} + 20 * {sub('p_size')}"
    return with_cte(SPLIT_SQL,
                    "ki AS (SELECT *, row_number() OVER (ORDER BY row_key) - 1 AS ki FROM ys WHERE split = 'test')",
                    f"ex AS (SELECT ki.*, f, rr FROM ki CROSS JOIN (VALUES {vals}) t(f) CROSS JOIN (SELECT range AS rr FROM range(0, 5)) rg)",
                    f"dn AS (SELECT f, rr, {donor} AS dv, row_number() OVER (PARTITION BY f, rr ORDER BY "
                    f"md5(concat_ws(':', row_key, f, CAST(rr AS VARCHAR), '42'))) - 1 AS dr FROM ex)",
                    "pm AS (SELECT ex.*, dn.dv FROM ex JOIN dn ON ex.f = dn.f AND ex.rr = dn.rr AND ex.ki = dn.dr)",
                    f"mm AS (SELECT f, rr, avg(abs(({p}) - yield)) AS mae FROM pm GROUP BY f, rr)",
                    f"bm AS (SELECT avg(abs(({PLANTED}) - yield)) AS b FROM ki)") + \
        f"\nSELECT f AS feature, {sql_r('avg(mae - b)')} AS importance_mean, {sql_r('stddev_pop(mae - b)')} AS importance_std FROM mm, bm GROUP BY f"


def j3(spark, sf):
    view = standin_view(spark, sf)
    t = crop_interval_bounds(spark, sf, view)
    truth = t.select("row_key", F.col("yield").alias("y"))
    preds = standin_predictions(spark, sf, view).where((F.col("split") == "test") & (F.col("model") == "crop_mean"))
    out = align_truth_and_predictions(truth, {"p10": t.select("row_key", "p10"),
                                              "p_mean": preds.select("row_key", "p"),
                                              "p90": t.select("row_key", "p90")}, "row_key")
    return out.select("row_key", *[r(c).alias(c) for c in ("y", "p10", "p_mean", "p90")])


J3_SQL = with_cte(SPLIT_SQL, STANDIN_SQL, BOUNDS_SQL) + "\nSELECT tb.row_key, " + sql_r("yield") + " AS y, " + sql_r("p10") + \
    " AS p10, " + sql_r("preds.p") + " AS p_mean, " + sql_r("p90") + \
    " AS p90 FROM tb JOIN preds ON tb.row_key = preds.row_key AND preds.model = 'crop_mean'"


QUERIES = {
    "a11_regression_metrics": (a11, A11_SQL),
    "a12_interval_coverage": (a12, A12_SQL),
    "a13_fold_average": (a13, A13_SQL),
    "a14_group_summary": (a14, A14_SQL),
    "a15_best_fit_line": (a15, A15_SQL),
    "a16_axis_limits": (a16, A16_SQL),
    "a17_standardizer_stats": (a17, a17_sql()),
    "a18_accuracy_macro_f1": (a18, A18_SQL),
    "a19_classification_report": (a19, A19_SQL),
    "a20_confusion_matrix": (a20, A20_SQL),
    "a21_distinct_sorted": (a21, A21_SQL),
    "a22_row_counts": (a22, A22_SQL),
    "a23_class_weights_balanced": (a23, A23_SQL),
    "r1_rank_models": (r1, R1_SQL),
    "r2_pick_best": (r2, R2_SQL),
    "r3_top_k_classes": (r3, R3_SQL),
    "n19_rank_label": (n19, N19_SQL),
    "r4_top_n": (r4, r4_sql()),
    "r5_head_n": (r5, R5_SQL),
    "u1_concat_fold_predictions": (u1, U1_SQL),
    "u2_collect_result_rows": (u2, U2_SQL),
    "m1_hash_split": (m1, M1_SQL),
    "m1_exact_split": (m1_exact, M1E_SQL),
    "m2_stratified_split": (m2, M2_SQL),
    "m3_kfold_ids": (m3, M3_SQL),
    "m4_leave_one_year_out": (m4, _logo_sql("year")),
    "m5_leave_one_region_out": (m5, _logo_sql("region_nk")),
    "m6_preprocess_numeric": (m6, m6_sql()),
    "m7_preprocess_categorical": (m7, m7_sql()),
    "m8_feature_names": (m8, m8_sql()),
    "m15_permutation_importance": (m15, m15_sql()),
    "j3_align_predictions": (j3, J3_SQL),
}
