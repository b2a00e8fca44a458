"""Attach per-group statistics (one row per group) back onto the rows."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_group_stats(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the columns of ``stats`` to each row of ``df`` matching on ``by`` (null-safe).

    With no grouping the statistics are one row: each column becomes a scalar subquery,
    computed once and inlined, so no join is planned. Otherwise the statistics table is
    joined; Spark picks the join by measured bytes. Rows of a group without statistics stay, with nulls.
    """
    by = list(by)
    stat_cols = [c for c in stats.columns if c not in by]
    if not by:
        return df.select("*", *[stats.select(c).scalar().alias(c) for c in stat_cols])
    renamed = stats.select(*[F.col(c).alias(f"_k_{c}") for c in by], *stat_cols)
    cond = None
    for c in by:
        e = df[c].eqNullSafe(renamed[f"_k_{c}"])
        cond = e if cond is None else cond & e
    return df.join(renamed, cond, "left").drop(*[f"_k_{c}" for c in by])
