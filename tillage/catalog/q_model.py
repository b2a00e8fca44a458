"""Catalogue: model training, scoring and generation (M4, M5 with models, M9-M14, M16-M23, S5, X1-X3).

Fitted models have no SQL form. The queries return what SQL can tell of them: the rows of each split, fold and model, whether the
error is below that of the training mean or the accuracy above the largest class's share, whether quantiles are calibrated. S5 compares a
saved model with the loaded one; X1-X3 use stand-ins that SQL can state. Every model has the reference's size and sees all training rows.
"""
from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tillage.catalog.common import CATEGORICAL, FEATURES, SPLIT_SQL, embeddings, r, split_view, sql_r, with_cte, yv
from tillage.catalog.q_scalar import PHRASES, SCRIPTS, SQL_CHOICE, _choice, _sql_language, _sql_map
from tillage.functions.text import (LANGUAGE_CHOICES, LANGUAGE_SCRIPT, PROMPTS, language_name, recommendation_prompt,
                                    sql_script_coverage, whitespace_class)
from tillage.operators.folds import stratified_split
from tillage.operators.order import group_quantiles
from tillage.plans import classify as C
from tillage.plans import many_models as MM
from tillage.plans import regress as G
from tillage.plans.generate import generate_text, length_generator, make_stub_translator, translate_with_retry
from tillage.plans.grouped import fold_models, per_group_models, random_split_models
from tillage.plans.leave_out import fold_metrics, folds_together
from tillage.plans.score import linear_logits_model, predict_with_user_model, score_batch
from tillage.operators.ranking import top_k_classes
from tillage.session import written
from tillage.sources.tables import read_table

KEY = "row_key"


def _view(spark, sf):
    """The rows with their split, written once: fits and metrics read them many times."""
    return written(split_view(spark, sf).select(KEY, "split", "yield", *FEATURES, *CATEGORICAL), "split-rows", spread=True)


def _split(spark, sf, log_target=False, winsor=0.0):
    d = G.condition_target(_view(spark, sf), "yield", log_target, winsor)
    return d.where(F.col("split") == "train"), d.where(F.col("split") == "test")


def _one(spark, sf, name, est):
    """Rows of each split and whether the model's mean error is below the training mean's."""
    tr, te = _split(spark, sf)
    est = est(tr) if callable(est) else est
    m, _, _ = G.compare_regressors(tr, te, FEATURES, CATEGORICAL, KEY, {name: est}, side_by_side=True)
    mean = tr.agg(F.avg("y_raw")).scalar()
    base = tr.unionByName(te).groupBy("split").agg(F.avg(F.abs(F.col("y_raw") - mean)).alias("_mean_mae"))
    return m.join(base, "split").select("model", "split", "n", (F.col("mae") < F.col("_mean_mae")).alias("beats_mean"))


def _one_sql(*names):
    return with_cte(SPLIT_SQL) + "\n" + "\nUNION ALL\n".join(
        f"SELECT '{m}' AS model, split, count(yield) AS n, true AS beats_mean FROM ys WHERE yield IS NOT NULL GROUP BY split" for m in names)


def m9(spark, sf):
    return _one(spark, sf, "RandomForest", G.Forest())


def m10(spark, sf):
    return _one(spark, sf, "HistGB", G.boosted())


def m11(spark, sf):
    return _one(spark, sf, "Huber", lambda train: G.huber(n_train=train.count()))


def m12(spark, sf):
    return _one(spark, sf, "Stacked_Ensemble", G.Stack())


ALPHAS, QUANTILE_ROUNDS = (0.1, 0.9), 400


def m13(spark, sf):
    """Both quantile models on the training rows: is the share of targets below the curve near alpha, and is
    the pinball loss below that of the constant quantile?"""
    tr, _ = _split(spark, sf)
    rows = G.fit_preprocessor(tr, FEATURES, CATEGORICAL).transform(tr).select(F.col("label").alias("y"), vector_to_array("features").alias("x"))
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()), "quantile-rows")
    every = F.lit(True)
    p = MM.fit_and_score(rows, [MM.quantile(f"q{a}", every, every, a, QUANTILE_ROUNDS) for a in ALPHAS])
    names = spark.createDataFrame([(k, a) for k, a in enumerate(ALPHAS)], "model int, alpha double")
    fixed = group_quantiles(rows, "y", list(ALPHAS), names=["q0", "q1"])
    p = p.join(rows.select("id", "y"), "id").join(F.broadcast(names), "model").crossJoin(F.broadcast(fixed))  # two rows, one row
    constant = F.when(F.col("model") == 0, F.col("q0")).otherwise(F.col("q1"))
    loss = lambda q: F.greatest(F.col("alpha") * (F.col("y") - q), (F.col("alpha") - 1) * (F.col("y") - q))
    q = F.get("p", F.lit(0))
    return p.groupBy("alpha").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") <= q).cast("double")).alias("_share"),
                                  F.avg(loss(q)).alias("_loss"), F.avg(loss(constant)).alias("_fixed")).select(
        "alpha", F.lit(QUANTILE_ROUNDS).alias("rounds"), "n", (F.abs(F.col("_share") - F.col("alpha")) < 0.02).alias("calibrated"),
        (F.col("_loss") < F.col("_fixed")).alias("beats_constant"))


M13_SQL = with_cte(SPLIT_SQL) + f"""
SELECT CAST(alpha AS DOUBLE) AS alpha, {QUANTILE_ROUNDS} AS rounds, count(*) AS n, true AS calibrated, true AS beats_constant
FROM ys, (SELECT unnest([{', '.join(map(str, ALPHAS))}]) AS alpha) WHERE split = 'train' GROUP BY alpha"""


def m14(spark, sf):
    """A row per test row: are its three values there and its interval no narrower than nothing? With the share covered (near 80%)."""
    tr, te = _split(spark, sf)
    rows, covered = G.prediction_intervals(tr, te, FEATURES, CATEGORICAL, KEY)
    share = covered.first()["coverage"]
    return rows.select(KEY, r("y").alias("y"), (F.col("p10").isNotNull() & F.col("p_mean").isNotNull() & F.col("p90").isNotNull()).alias("has_interval"),
                       F.lit(0.7 <= share <= 0.9).alias("covers_80"))


M14_SQL = with_cte(SPLIT_SQL) + f"""
SELECT row_key, {sql_r('yield')} AS y, true AS has_interval, true AS covers_80 FROM ys WHERE split = 'test'"""


def m16(spark, sf):
    d = split_view(spark, sf)

    def run(part, name):
        return [random_split_models(part, "yield", FEATURES, CATEGORICAL, KEY),
                fold_models(part, "loyo", "year", "yield", FEATURES, CATEGORICAL, KEY),
                fold_models(part, "loro", "region_nk", "yield", FEATURES, CATEGORICAL, KEY, as_text=True)]
    return per_group_models(d, "crop", run, min_rows=60, max_workers=3)


def m22(spark, sf):
    """All four models with a log target on clipped training values; the two splits are clipped apart. Per model and split: rows, and is the
    mean error below that of the training mean?"""
    parts = {n: G.condition_target(d, "yield", True, 0.01) for n, d in zip(("train", "test"), _raw_split(spark, sf), strict=True)}
    m, _, _ = G.compare_regressors(parts["train"], parts["test"], FEATURES, CATEGORICAL, KEY, _estimators(parts["train"]), log_target=True)
    mean = parts["train"].agg(F.avg("y_raw")).scalar()
    base = [d.agg(F.avg(F.abs(F.col("y_raw") - mean)).alias("_mean_mae")).withColumn("split", F.lit(n)) for n, d in parts.items()]
    return m.join(base[0].unionByName(base[1]), "split").select("model", "split", "n", (F.col("mae") < F.col("_mean_mae")).alias("beats_mean"))


def _raw_split(spark, sf):
    d = _view(spark, sf)
    return d.where(F.col("split") == "train"), d.where(F.col("split") == "test")


def _estimators(train):
    return {"RandomForest": G.Forest(), "HistGB": G.HistBoosting(), "Huber": G.huber(n_train=train.count()), "Stacked_Ensemble": G.Stack()}


def _leave_out(spark, sf, group, as_text=False):
    """Per fold and model: rows, and is the mean error below that of the mean of all other rows?"""
    d = written(yv(spark, sf).select(KEY, "year", "region_nk", "yield", *FEATURES, *CATEGORICAL), "leave-out-rows", spread=True)
    p = folds_together(d, group, "yield", FEATURES, CATEGORICAL, KEY, {"RandomForest": G.Forest(), "HistGB": G.HistBoosting()},
                       {"Huber": G.huber}, log_target=True, winsor=0.01, as_text=as_text)
    mean = d.agg(F.avg("yield")).scalar()
    base = p.where(F.col("model") == "Huber").groupBy("fold").agg(F.avg(F.abs(F.col("y") - mean)).alias("_mean_mae"))
    return fold_metrics(p).join(base, "fold").select("fold", "model", "n", (F.col("mae") < F.col("_mean_mae")).alias("beats_mean"))


def _leave_out_sql(group):
    return with_cte() + f"""
SELECT CAST({group} AS VARCHAR) AS fold, model, count(*) AS n, true AS beats_mean
FROM yv, (SELECT unnest(['RandomForest', 'HistGB', 'Huber']) AS model) WHERE {group} IS NOT NULL GROUP BY {group}, model"""


def m4_models(spark, sf):
    return _leave_out(spark, sf, "year")


def m5_models(spark, sf):
    return _leave_out(spark, sf, "region_nk", as_text=True)


def _emb_split(spark, sf):
    e = embeddings(spark, sf).withColumn("cls", F.concat(F.lit("c"), F.col("label").cast("string")))
    s = stratified_split(e, "cls", "vec_id")
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test")


def _clf(spark, sf, ests):
    tr, te = _emb_split(spark, sf)
    return C.compare_classifiers(tr, te, "vec_id", "cls", ests, array_col="embedding", side_by_side=True)


def _learned(spark, sf, ests):
    """Per model: rows of both splits, and is its accuracy on the training rows above the largest class's share of them? (The labels of
    the given embeddings need not depend on the vectors, so nothing can be said of the test rows.)"""
    *_, long, _fitted, _labels = _clf(spark, sf, ests)
    train = F.col("split") == "train"
    most = long.where(train).groupBy("model", "y").count().groupBy("model").agg(F.max("count").alias("_most"))
    right = long.groupBy("model").agg(F.count(F.when(train, 1)).alias("n_train"), F.count(F.when(~train, 1)).alias("n_test"),
                                      F.sum((train & (F.col("y") == F.col("p"))).cast("long")).alias("_right"))
    return right.join(most, "model").select("model", "n_train", "n_test", (F.col("_right") > F.col("_most")).alias("learned"))


def _learned_sql(*names):
    rows = " UNION ALL ".join(f"SELECT '{n}' AS model" for n in names)
    return f"""SELECT model, n - n_test AS n_train, n_test, true AS learned FROM ({rows}),
(SELECT CAST(sum(c) AS BIGINT) AS n, CAST(sum(floor(c * 0.2 + 0.5)) AS BIGINT) AS n_test FROM (SELECT count(*) AS c FROM embeddings WHERE label IS NOT NULL GROUP BY label))"""


def m17(spark, sf):
    tr, _ = _emb_split(spark, sf)
    return _learned(spark, sf, {"LogReg": C.logistic(n_weight_sum=float(tr.count()))})


def m18(spark, sf):
    return _learned(spark, sf, {"RandomForest": C.forest()})


def m19(spark, sf):
    return _learned(spark, sf, {"HistGB": C.MultinomialBoosting()})


def m20(spark, sf):
    return _learned(spark, sf, {"MLP": C.mlp(64, 10)})


def m21(spark, sf):
    tr, _ = _emb_split(spark, sf)
    return _learned(spark, sf, {"LogReg": C.logistic(float(tr.count())), "HistGB": C.MultinomialBoosting(), "RandomForest": C.forest(),
                                             "MLP": C.mlp(64, 10)})


def _fitted_lr(spark, sf):
    tr, te = _emb_split(spark, sf)
    comp, reports, best, long, fitted, labels = C.compare_classifiers(
        tr, te, "vec_id", "cls", {"LogReg": C.logistic(float(tr.count()))}, array_col="embedding")
    te = te.drop("label").withColumn("_vec", array_to_vector("embedding")).withColumn("label_name", F.col("cls"))
    return fitted["LogReg"], labels, te


def m23(spark, sf):
    model, labels, te = _fitted_lr(spark, sf)
    return score_batch(model, labels, te, k=3, keep=["vec_id"])


def s5(spark, sf):
    """Every embedding scored by the fitted model and by the one read back: are all values the same?"""
    from tillage.session import scratch_path
    from tillage.sources.models import load_model, save_model
    model, labels, _te = _fitted_lr(spark, sf)
    path = save_model(model, scratch_path(spark, "model"), labels, spark)
    loaded, loaded_labels = load_model(spark, path)
    rows = embeddings(spark, sf).withColumn("label_name", F.concat(F.lit("c"), F.col("label").cast("string"))).drop("label")
    rows = rows.withColumn("_vec", array_to_vector("embedding"))
    before, after = (score_batch(m, names, rows, k=3, keep=["vec_id"]) for m, names in ((model, labels), (loaded, loaded_labels)))
    values = [c for c in before.columns if c != "vec_id"]
    same = F.struct(*[before[c] for c in values]) == F.struct(*[after[c] for c in values])
    return before.join(after, "vec_id").select("vec_id", same.alias("same"))


S5_SQL = "SELECT vec_id, true AS same FROM embeddings"


X1_CLASSES, X1_FEATURES = 10, 64


def x1(spark, sf):
    w = np.fromfunction(lambda j, k: (7 * j + 3 * k) % 11 - 5, (X1_FEATURES, X1_CLASSES))
    e = embeddings(spark, sf)
    p = predict_with_user_model(e, "embedding", linear_logits_model(w), returns_logits=True)
    return top_k_classes(p, "prob", [f"c{i}" for i in range(X1_CLASSES)], k=3).select(
        "vec_id", *[f"Top{i}_{c}" for i in (1, 2, 3) for c in ("Class", "Prob")])


X1_SQL = f"""WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings),
z AS (SELECT vec_id, k, sum(CAST(x AS DOUBLE) * ((7 * j + 3 * k) % 11 - 5)) AS z FROM e CROSS JOIN range(0, {X1_CLASSES}) t(k) GROUP BY ALL),
p AS (SELECT vec_id, k, exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) AS p,
      row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, k) AS rk FROM z WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, """ + ", ".join(
    f"max(CASE WHEN rk = {i} THEN 'c' || CAST(k AS VARCHAR) END) AS Top{i}_Class, "
    f"max(CASE WHEN rk = {i} THEN round_even(p, 4) END) AS Top{i}_Prob" for i in (1, 2, 3)) + " FROM p GROUP BY vec_id"


def x2(spark, sf):
    c = read_table(spark, sf, "conversations")
    prompts = c.select("conv_id", "turn", recommendation_prompt(F.col("role"), F.col("text"), "app").alias("prompt"))
    return generate_text(prompts, "prompt", length_generator).drop("prompt")


def x2_sql():
    p = PROMPTS["app"]
    tail = p["user_tail"] + "".join(f"{h}\n- ...\n" for h in p["sections"] or [])
    quoted = "'" + tail.replace("'", "''") + "'"
    words = f"len(regexp_extract_all(prompt, '[^{whitespace_class('re2')[1:]}+'))"
    return f"""SELECT conv_id, turn, '(stub) ' || CAST(length(prompt) AS VARCHAR) || ' chars, ' || CAST({words} AS VARCHAR) || ' words' AS generated
FROM (SELECT *, 'Predicted crop: ' || role || chr(10) || 'Profile: ' || text || chr(10) || {quoted} AS prompt FROM conversations)"""


def _languages():
    return dict(zip([n.split(" ")[0] for n in LANGUAGE_CHOICES], PHRASES, strict=True))


def x3(spark, sf):
    c = read_table(spark, sf, "conversations")
    d = c.select("conv_id", "turn", "text", language_name(_choice(F.col("conv_id") + F.col("turn"))).alias("language"))
    tr = make_stub_translator(_languages())
    return translate_with_retry(d, "text", "language", tr).select("conv_id", "turn", "language", "retried",
                                                                   F.length("translated").alias("n_chars"))


def x3_sql():
    """The stand-in gives the text back at first (kept if it is in the language's script), its phrase when asked again."""
    lang = _sql_language(SQL_CHOICE.format(k="(conv_id + turn)"))
    kept = "CASE " + " ".join(f"WHEN {_sql_map(LANGUAGE_SCRIPT, 'language', 'Latin')} = '{s}' THEN {sql_script_coverage('text', s)}"
                              for s in SCRIPTS) + " ELSE 0.0 END >= 0.6"
    phrase = "CASE " + " ".join(f"WHEN language = '{n}' THEN {len(p)}" for n, p in _languages().items()) + " END"
    stripped = f"regexp_replace(regexp_replace(text, '^{whitespace_class('re2')}+', ''), '{whitespace_class('re2')}+$', '')"
    return f"""SELECT conv_id, turn, language, NOT ok AS retried, CASE WHEN language = 'English' THEN length(text)
WHEN ok THEN length({stripped}) ELSE {phrase} END AS n_chars
FROM (SELECT *, language = 'English' OR coalesce({kept}, false) AS ok FROM (SELECT *, {lang} AS language FROM conversations))"""


QUERIES = {
    "m4_leave_one_year_out_models": (m4_models, _leave_out_sql("year")),
    "m5_leave_one_region_out_models": (m5_models, _leave_out_sql("region_nk")),
    "m9_random_forest_regressor": (m9, _one_sql("RandomForest")),
    "m10_boosted_regressor": (m10, _one_sql("HistGB")),
    "m11_huber_regressor": (m11, _one_sql("Huber")),
    "m12_stacked_ensemble": (m12, _one_sql("Stacked_Ensemble")),
    "m13_quantile_boosting": (m13, M13_SQL),
    "m14_prediction_intervals": (m14, M14_SQL),
    "m16_per_group_models": (m16, None),
    "m17_logistic_regression": (m17, _learned_sql("LogReg")),
    "m18_random_forest_classifier": (m18, _learned_sql("RandomForest")),
    "m19_boosted_classifier": (m19, _learned_sql("HistGB")),
    "m20_mlp_classifier": (m20, _learned_sql("MLP")),
    "m21_compare_classifiers": (m21, _learned_sql("LogReg", "HistGB", "RandomForest", "MLP")),
    "m22_compare_regressors": (m22, _one_sql("RandomForest", "HistGB", "Huber", "Stacked_Ensemble")),
    "m23_score_batch": (m23, None),
    "s5_save_load_model": (s5, S5_SQL),
    "x1_predict_with_user_model": (x1, X1_SQL),
    "x2_generate_text": (x2, x2_sql()),
    "x3_translate_with_retry": (x3, x3_sql()),
}
