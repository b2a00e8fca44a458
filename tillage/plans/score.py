"""Batch scoring (M23) and scoring with a user-supplied model.

Both are narrow (row-wise) plans: no shuffle, and they run unchanged on streams.
"""
from __future__ import annotations

from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillage.operators.joins import decode_labels
from tillage.operators.ranking import top_k_classes


def score_batch(model: PipelineModel, labels: Sequence[str], df: DataFrame, k: int = 3, keep: Sequence[str] = (),
                prob_col: str = "probability") -> DataFrame:
    """Predicted class plus ``Top{i}_Class`` / ``Top{i}_Prob`` (k ≤ number of classes)."""
    k = min(k, len(labels))
    out = model.transform(df)
    out = out.withColumn("_prob", vector_to_array(prob_col) if prob_col in out.columns else F.lit(None))
    out = out.withColumn("PredictedClass", decode_labels("prediction", list(labels)))
    out = top_k_classes(out, "_prob", list(labels), k=k)
    return out.select(*keep, "PredictedClass", *[c for i in range(1, k + 1) for c in (f"Top{i}_Class", f"Top{i}_Prob")])


def softmax(c: Column) -> Column:
    """Softmax of an array column, max subtracted first; JVM-side."""
    mx = F.array_max(c)
    ex = F.transform(c, lambda x: F.exp(x - mx))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    return F.transform(ex, lambda x: x / tot)


def predict_with_user_model(df: DataFrame, features: str, fn: Callable[[np.ndarray], np.ndarray],
                            returns_logits: bool = True, out_col: str = "prob", fill: Sequence[float] | None = None) -> DataFrame:
    """Apply any batch function (N × F array → N × K scores) through an Arrow-batched
    pandas UDF; logits go through a softmax on the JVM side. Missing features (a null row, null or NaN values)
    take the values of ``fill`` (the training means); without ``fill`` a null row gives null."""
    means = None if fill is None else np.asarray(fill, dtype=np.float64)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _score(col: pd.Series) -> pd.Series:
        values = [means if v is None else np.asarray(v, dtype=np.float64) for v in col]
        asked = [k for k, v in enumerate(values) if v is not None]
        out: list = [None] * len(values)
        if asked:
            x = np.vstack([values[k] for k in asked])
            if means is not None:
                x = np.where(np.isnan(x), means, x)
            for k, row in zip(asked, np.asarray(fn(x), dtype=np.float64), strict=True):
                out[k] = row.tolist()
        return pd.Series(out, dtype=object)

    out = df.withColumn("_scores", _score(F.col(features)))
    prob = softmax(F.col("_scores")) if returns_logits else F.col("_scores")
    return out.withColumn(out_col, prob).drop("_scores")


def linear_logits_model(weights: np.ndarray, bias: np.ndarray | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """A user model as a plain function: x @ W + b."""
    def fn(x):
        z = x @ weights
        return z + bias if bias is not None else z
    return fn
