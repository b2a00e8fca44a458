"""Persist and reload a fitted pipeline together with its label list (no pickles)."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def save_model(model: PipelineModel, path: str, labels=None, spark: SparkSession | None = None) -> str:
    model.write().overwrite().save(f"{path}/pipeline")
    if labels is not None:
        spark = spark or SparkSession.getActiveSession()
        spark.createDataFrame([(i, str(l)) for i, l in enumerate(labels)], "index int, label string") \
             .coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")
    return path


def load_model(spark: SparkSession, path: str):
    model = PipelineModel.load(f"{path}/pipeline")
    try:
        labels = [r["label"] for r in spark.read.parquet(f"{path}/labels").orderBy("index").collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        labels = None
    return model, labels
