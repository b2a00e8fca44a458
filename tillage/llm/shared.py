"""Helpers of the training-data operators: written intermediate tables, Arrow batch sizes, columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.session import scratch_path

# Rows and bytes of one Arrow batch sent to a Python worker. Documents differ in length by four
# orders of magnitude, so the byte bound is what keeps a worker's memory small.
ARROW_ROWS = 2000
ARROW_BYTES = 4 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python operators (rows and bytes)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and return a reader of it.

    Cuts the lineage, survives lost executors, and frees the shuffle files of the job that made
    it as soon as the table is complete.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def rows_with_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id occurs in ``ids`` (one column); null ids match null ids."""
    picked = ids.select(F.col(id_col).alias("__picked_id"))
    return rows.join(picked, rows[id_col].eqNullSafe(picked["__picked_id"]), "left_semi")
