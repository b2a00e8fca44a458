"""Run metadata and JSON parameter files (class list, scaler statistics, best model)."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALER_SCHEMA = "map<string, struct<mean: double, std: double>>"
CLASSES_SCHEMA = "array<string>"
BEST_MODEL_SCHEMA = ("struct<best_model: string, metric: string, macro_f1: double, accuracy: double, "
                     "features: array<string>, target: string, random_state: int>")


def run_metadata(df: DataFrame, split: str | None = None, **fields) -> DataFrame:
    """S3: one-row metadata table: given fields plus row counts from one aggregation."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if split:
        aggs += [F.count_if(F.col(split) == "train").alias("n_train"),
                 F.count_if(F.col(split) == "test").alias("n_test")]
    counts = df.agg(*aggs)
    extra = []
    for k, v in fields.items():
        if isinstance(v, (list, tuple)):
            extra.append(F.array(*[F.lit(str(x)) for x in v]).cast("array<string>").alias(k))
        else:
            extra.append(F.lit(v).alias(k))
    return counts.select(*extra, *counts.columns)


def write_run_metadata(meta: DataFrame, path: str) -> str:
    meta.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_json_param(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole JSON file parsed with an explicit schema into one column ``value``."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("value"))


def read_model_type(spark: SparkSession, path: str) -> str:
    """'sklearn' for a classical model; anything else (e.g. a JSON object) means a network."""
    text = spark.read.text(path, wholetext=True).first()[0].strip()
    return "sklearn" if text == "sklearn" else "dl"


def params_to_json(d) -> str:
    return json.dumps(d, indent=2)
