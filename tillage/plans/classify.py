"""Classification plans (M17-M21): MLlib classifiers over one shared feature pipeline,
one long (model, key, y, p) prediction table, reports and model choice by macro-F1."""
from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, StringIndexer
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.operators.features import MedianImputeScaler
from tillage.operators.metrics import accuracy_macro_f1, class_weights_balanced, classification_report
from tillage.operators.ranking import pick_best
from tillage.operators.sets import concat_fold_predictions
from tillage.operators.stats import attach_group_stats
from tillage.plans import many_models as MM
from tillage.session import written

MODEL_ORDER = ["LogReg", "HistGB", "RandomForest", "MLP"]


def logistic(n_weight_sum: float, max_iter: int = 2000, c: float = 1.0) -> LogisticRegression:
    """Multinomial, balanced class weights; C=1 on a weighted sum → regParam = 1/(C·Σw)."""
    return LogisticRegression(family="multinomial", maxIter=max_iter, regParam=1.0 / (c * max(n_weight_sum, 1.0)),
                              elasticNetParam=0.0, standardization=False, weightCol="weight")


def forest(trees: int = 400, max_depth: int = 30, seed: int = 42) -> RandomForestClassifier:
    """Trees as deep as Spark allows (30)."""
    return RandomForestClassifier(numTrees=trees, maxDepth=max_depth, featureSubsetStrategy="sqrt", seed=seed)


@dataclass(frozen=True)
class MultinomialBoosting:
    """One model of K trees a round from the gradients of the softmax."""
    rounds: int = 500
    rate: float = 0.06
    depth: int = 5
    min_leaf: int = 20


def mlp(n_features: int, n_classes: int, max_iter: int = 120, seed: int = 42) -> MultilayerPerceptronClassifier:
    """F → 128 → 64 → K."""
    return MultilayerPerceptronClassifier(layers=[n_features, 128, 64, n_classes], maxIter=max_iter, seed=seed)


def feature_stages(numeric: Sequence[str] | None = None, array_col: str | None = None, label: str = "label_name"):
    """Label index (alphabetical) + standardised features: exact median-impute/scale for
    numeric columns, or a standard scaler over an array column."""
    stages = [StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc")]
    if array_col:
        stages.append(StandardScaler(inputCol="_vec", outputCol="features", withMean=True, withStd=True))
    else:
        from pyspark.ml.feature import VectorAssembler
        outs = [f"{c}__num" for c in numeric]
        stages += [MedianImputeScaler(inputCols=list(numeric), outputCols=outs),
                   VectorAssembler(inputCols=outs, outputCol="features")]
    return stages


def _population_scaled(fe: PipelineModel, n: int) -> PipelineModel:
    """The same stages with the deviation of the training rows as a population (A17): MLlib divides by the sample deviation,
    which is larger by sqrt(n / (n - 1)), so the scaled values are multiplied with that."""
    if n < 2:
        return fe
    width = fe.stages[-1].mean.size
    more = ElementwiseProduct(scalingVec=Vectors.dense([math.sqrt(n / (n - 1))] * width), inputCol="_scaled", outputCol="features")
    return PipelineModel(stages=[*fe.stages[:-1], fe.stages[-1].setOutputCol("_scaled"), more])


def _tree_model(name: str, est, classes: int, width: int) -> MM.TreeModel:
    train, every = F.col("split") == "train", F.lit(True)
    if isinstance(est, MultinomialBoosting):
        return MM.multinomial(name, train, every, classes, rounds=est.rounds, rate=est.rate, depth=est.depth, min_leaf=est.min_leaf)
    return MM.forest(name, train, every, trees=est.getNumTrees(), depth=est.getMaxDepth(), classes=classes,
                     per_split=math.ceil(math.sqrt(width)), every_row=True, seed=est.getSeed())


def compare_classifiers(train: DataFrame, test: DataFrame, key: str, label: str, estimators: dict,
                        numeric: Sequence[str] | None = None, array_col: str | None = None, side_by_side: bool = False):
    """Fit all, predict both sides, build (model, split, key, y, p) and report per model on the test rows; best by
    macro-F1 with ties to the earlier model in training order. Returns
    (comparison, reports, best, predictions of both splits, fitted, labels).

    With ``side_by_side`` a forest whose training rows a task can hold (many_models.CELLS_HERE) is grown on the side-by-side plan too: the
    same trees, depth and features a split, all rows in every bootstrap; it has no entry in ``fitted`` then.
    """
    def prep(d):
        d = d.where(F.col(label).isNotNull()).withColumn("label_name", F.col(label).cast("string"))
        d = d.drop("label", "features", "prediction", "probability", "rawPrediction")
        return d.withColumn("_vec", array_to_vector(array_col)) if array_col else d
    tr, te = prep(train), prep(test)
    w = class_weights_balanced(tr, "label_name").select("label_name", "weight")
    tr = attach_group_stats(tr, w, ["label_name"])
    fe = Pipeline(stages=feature_stages(numeric, array_col)).fit(tr)
    if array_col:
        fe = _population_scaled(fe, tr.count())
    labels = fe.stages[0].labels
    both = written(fe.transform(tr).withColumn("split", F.lit("train")).select(key, "label_name", "label", "features", "weight", "split").unionByName(
        fe.transform(te).select(key, "label_name", "label", "features", F.lit(1.0).alias("weight"), F.lit("test").alias("split")))
        .withColumn("_id", F.monotonically_increasing_id()), "classify-rows")
    trf = both.where("split = 'train'")
    fitted, parts = {}, []
    lab = F.array(*[F.lit(x) for x in labels])
    together = [(name, est) for name, est in estimators.items() if isinstance(est, MultinomialBoosting)]
    width = 0
    if side_by_side and any(isinstance(est, RandomForestClassifier) for est in estimators.values()):
        size = trf.select(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_to_array("features"))).alias("width")).first()
        width = size["width"] or 0
        if size["n"] * width <= MM.CELLS_HERE:
            together = [(name, est) for name, est in estimators.items() if isinstance(est, (MultinomialBoosting, RandomForestClassifier))]
    if together:
        rows = both.select(F.col("_id").alias("id"), F.col("label").alias("y"), vector_to_array("features").alias("x"), "split")
        models = [_tree_model(name, est, len(labels), width) for name, est in together]
        p = MM.fit_and_score(rows, models).withColumnRenamed("id", "_id").join(both, "_id")
        for k, (name, _) in enumerate(together):
            parts.append(p.where(F.col("model") == k).select(F.lit(name).alias("model"), "split", key, F.col("label_name").alias("y"),
                                                             F.element_at(lab, F.array_position("p", F.array_max("p")).cast("int")).alias("p")))
    for name, est in estimators.items():
        if name in dict(together):
            continue
        m = est.fit(trf)
        fitted[name] = PipelineModel(stages=[fe, m])
        p = m.transform(both)
        parts.append(p.select(F.lit(name).alias("model"), "split", key, F.col("label_name").alias("y"),
                              F.element_at(lab, F.col("prediction").cast("int") + 1).alias("p")))
    long = concat_fold_predictions(parts)
    test = long.where("split = 'test'")
    comp = accuracy_macro_f1(test, by=["model"])
    best = pick_best(comp, "macro_f1", ascending=False, model_order=MODEL_ORDER)
    reports = classification_report(test, by=["model"])
    return comp, reports, best, long, fitted, labels
