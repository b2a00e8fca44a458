"""Streaming use of the narrow operators: batch scoring (M23) and text checks
apply unchanged to a streaming DataFrame; nothing here keeps state."""
from __future__ import annotations

from typing import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions.text import is_in_language, strip_markdown
from tillage.plans.score import score_batch


def read_parquet_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def score_stream(model: PipelineModel, labels: Sequence[str], stream: DataFrame, k: int = 3,
                 keep: Sequence[str] = ()) -> DataFrame:
    return score_batch(model, labels, stream, k=k, keep=keep)


def text_check_stream(stream: DataFrame, text: str, language: str) -> DataFrame:
    return stream.withColumn("plain", strip_markdown(F.col(text))).withColumn(
        "in_language", is_in_language(F.col("plain"), F.col(language)))
