"""Lookups and alignment."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.functions.text import normalize_key


# J1 ------------------------------------------------------------------------------------
def lookup_by_normalized_name(df: DataFrame, name_col: str, index: DataFrame, key_col: str = "key",
                              value_col: str = "path", out_col: str = "image_path",
                              placeholder: str | None = None) -> DataFrame:
    """Left-join a (key, value) index on the normalised name; missing → placeholder/null.
    The index must be unique on key (``scan_file_index`` guarantees it)."""
    idx = index.select(F.col(key_col).alias("_jk"), F.col(value_col).alias(out_col))
    j = df.withColumn("_jk", normalize_key(F.col(name_col))).join(idx, "_jk", "left")
    if placeholder is not None:
        j = j.withColumn(out_col, F.coalesce(F.col(out_col), F.lit(placeholder)))
    return j.drop("_jk")


# J2 ------------------------------------------------------------------------------------
def decode_labels(index_col, labels: Sequence[str] | Column) -> Column:
    """Class code (0-based) → class name, from the model's label list."""
    arr = labels if isinstance(labels, Column) else F.array(*[F.lit(x) for x in labels])
    c = F.col(index_col) if isinstance(index_col, str) else index_col
    return F.element_at(arr, c.cast("int") + 1)


# J3 ------------------------------------------------------------------------------------
def align_truth_and_predictions(truth: DataFrame, preds: dict, key: str) -> DataFrame:
    """Bind prediction tables to the truth by row key (never by position).

    ``preds`` maps an output name to a (key, prediction) DataFrame; prediction tables
    from ``transform`` on the same frame should instead be added as columns directly.
    """
    out = truth
    for name, p in preds.items():
        out = out.join(p.select(key, F.col(p.columns[1]).alias(name)), key, "left")
    return out
