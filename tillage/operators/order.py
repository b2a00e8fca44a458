"""Distributed ordering primitives: ranks within groups and exact quantiles.

``rank_within_groups`` gives every row its 0-based position inside its group without a
window over the group: rows are range-partitioned on (group, order) keys, so a hot group
is split over many tasks by value; each task numbers its rows, and a small table of
per-(group, partition) counts turns local numbers into group ranks.

``group_quantiles`` has one exact path for every size. A mergeable rank sketch brackets each wanted
rank between two values of the group; one aggregation then counts every value inside the brackets and
everything between them as one cell each. No group and no tied value meets in one task: only the cells
of a group do (about 6/accuracy of its distinct values per probability).
"""
from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillage.operators.stats import attach_group_stats
from tillage.session import cut_lineage

# Ranks of the sketch are off by at most 1/ACCURACY of the group; brackets reach three times as far.
ACCURACY = 100_000


def _null_safe_on(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def rank_within_groups(df: DataFrame, by: Sequence[str], order: Sequence[Column | str],
                       rank_col: str = "_rank", num_partitions: int | None = None,
                       total_order: bool = False, kept: list[DataFrame] | None = None) -> DataFrame:
    """Add ``rank_col`` = 0-based position of the row in its ``by`` group under ``order``.

    ``total_order`` declares that (by, order) identifies rows up to identical rows; if not,
    the numbered table is checkpointed so every consumer sees the same numbering. ``kept`` gets the persisted
    table, for a caller that knows when it has been read.
    """
    by = list(by)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    nparts = num_partitions or _shuffle_partitions(df)
    keys = [F.col(c).asc_nulls_first() for c in by] + [c.asc_nulls_last() if hasattr(c, "asc_nulls_last") else c
                                                       for c in order_cols]
    numbered = (df.repartitionByRange(nparts, *keys)
                  .sortWithinPartitions(*keys)
                  .withColumn("_pid", F.spark_partition_id())
                  .withColumn("_mid", F.monotonically_increasing_id()))
    # Range bounds are sampled with a seed tied to the RDD id, so re-running the plan can
    # move rows to other partitions: the numbered table must be materialised once.
    # Persisted blocks that are lost are rebuilt through the same RDD (same bounds), which
    # is enough when tied rows are indistinguishable; otherwise write a reliable checkpoint.
    if total_order:
        numbered = numbered.persist(StorageLevel.MEMORY_AND_DISK)
        if kept is not None:
            kept.append(numbered)
    else:
        numbered = cut_lineage(numbered)
    per_part = (numbered.groupBy(*by, "_pid")
                        .agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_m0")))
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = per_part.select(*[F.col(c).alias(f"_o_{c}") for c in by], F.col("_pid").alias("_o_pid"),
                              (F.sum("_c").over(w) - F.col("_c")).alias("_off"), "_m0")
    small = offsets
    cond = numbered["_pid"] == small["_o_pid"]
    for c in by:
        cond = cond & numbered[c].eqNullSafe(small[f"_o_{c}"])
    out = numbered.join(small, cond, "inner")
    out = out.withColumn(rank_col, F.col("_off") + F.col("_mid") - F.col("_m0"))
    return out.drop("_pid", "_mid", "_off", "_m0", "_o_pid", *[f"_o_{c}" for c in by])


def _value_column(df: DataFrame, value: str | Column) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return c.cast("double")


def group_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """One row per group with one column per probability (linear interpolation, as
    ``percentile`` / pandas ``quantile``), exact for every ``accuracy``, which only sets the brackets' width.
    Nulls and NaN are ignored; groups without other values have no row."""
    by = list(by)
    probs = [float(p) for p in probs]
    names = list(names) if names else [f"q{str(p).replace('.', '_')}" for p in probs]
    ordered = sorted(set(probs))
    v = _value_column(df, value)
    base = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    reach = 3.0 / accuracy
    ends = [F.lit(e) for p in ordered for e in (max(p - reach, 0.0), min(p + reach, 1.0))]
    brackets = base.groupBy(*by).agg(F.percentile_approx("_v", F.array(*ends), F.lit(accuracy)).alias("_b"))
    rows = attach_group_stats(base, brackets, by)
    # Cells in ascending order: below bracket 0, the values of bracket 0, between brackets 0 and 1, ...
    cell, inside = F.lit(2 * len(ordered)), F.lit(False)
    for k in reversed(range(len(ordered))):
        lo, hi = F.col("_b")[2 * k], F.col("_b")[2 * k + 1]
        below_hi = F.col("_v") <= hi
        cell = F.when(below_hi, F.when(F.col("_v") >= lo, F.lit(2 * k + 1)).otherwise(F.lit(2 * k))).otherwise(cell)
        inside = F.when(below_hi, F.col("_v") >= lo).otherwise(inside)
    cells = rows.select(*by, cell.alias("_cell"), F.when(inside, F.col("_v")).alias("_at"), "_v").groupBy(
        *by, "_cell", "_at").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    w = Window.partitionBy(*(by or [F.lit(0)]))
    run = w.orderBy("_cell", "_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select("*", F.sum("_c").over(run).alias("_end"), F.sum("_c").over(w).alias("_n"))

    def at_rank(rank: Column) -> Column:
        first = F.col("_end") - F.col("_c")
        here = (rank >= first) & (rank < F.col("_end"))
        known = F.when(rank == first, F.col("_mn")).when(rank == F.col("_end") - 1, F.col("_mx")).when(
            F.col("_at").isNotNull(), F.col("_at")).otherwise(F.raise_error(F.lit("rank outside of its bracket")))
        return F.max(F.when(here, known))

    found = []
    for k, p in enumerate(ordered):
        pos = F.lit(p) * (F.col("_n") - 1)
        found += [F.max(pos).alias(f"_pos{k}"), at_rank(F.floor(pos)).alias(f"_lo{k}"), at_rank(F.ceil(pos)).alias(f"_hi{k}")]
    ranks = cells.groupBy(*by).agg(*found)
    return ranks.where(F.col("_pos0").isNotNull()).select(*by, *[_between(ordered.index(p)).alias(n)
                                                                 for p, n in zip(probs, names, strict=True)])


def _between(k: int) -> Column:
    pos, lo, hi = F.col(f"_pos{k}"), F.col(f"_lo{k}"), F.col(f"_hi{k}")
    return F.when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi)


def global_row_index(df: DataFrame, order: Sequence[Column | str], index_col: str = "_idx",
                     total_order: bool = False, kept: list[DataFrame] | None = None) -> DataFrame:
    """0-based position of each row in the total order ``order`` (distributed, no single task)."""
    return rank_within_groups(df, [], order, rank_col=index_col, total_order=total_order, kept=kept)
