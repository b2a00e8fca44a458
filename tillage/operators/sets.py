"""Stacking result tables."""
from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame


def concat_fold_predictions(parts: Sequence[DataFrame]) -> DataFrame:
    """Union all of per-fold prediction tables (same columns)."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def collect_result_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Union all of result rows whose columns may differ (missing → null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
