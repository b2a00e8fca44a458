"""Splits and folds: hash split, exact split, stratified split, contiguous k folds,
leave-one-group-out.

Splits are functions of a row key (md5 of key and seed), never of partitioning, so they are
reproducible on any cluster layout and after task retries.
"""
from __future__ import annotations

from typing import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.operators.order import global_row_index, rank_within_groups
from tillage.operators.stats import attach_group_stats
from tillage.session import written
from tillage.sources.tables import hash_bucket

# Marks of the sketch of hashes, and its accuracy: an error of at most 1/10,000 of a group, a tenth of the step between marks.
MARKS, SKETCH = 1000, 10_000


def _key(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def hash_split(df: DataFrame, key, test_fraction: float = 0.2, seed: int = 42, split_col: str = "split") -> DataFrame:
    """M1 (cheap form): a row is 'test' when the first 32 bits of its md5 are below fraction·2^32."""
    b = hash_bucket(_key(key), salt=f":{seed}", modulo=1 << 32)
    return df.withColumn(split_col, F.when(b < F.lit(round(test_fraction * (1 << 32))), "test").otherwise("train"))


def exact_split(df: DataFrame, key, test_fraction: float = 0.2, seed: int = 42, split_col: str = "split",
                key_unique: bool = True) -> DataFrame:
    """M1 (exact form): the ceil(fraction·n) rows with the smallest md5(key:seed) are 'test'."""
    return _smallest_hashes(df, [], key, seed, split_col, lambda n: F.ceil(n * F.lit(test_fraction)))


def stratified_split(df: DataFrame, label: str, key, test_fraction: float = 0.2, seed: int = 42,
                     split_col: str = "split") -> DataFrame:
    """M2: per class, the round(fraction·n_c) rows with the smallest md5(key:seed) are 'test'.

    Rows with a null label are dropped (they are not a class).
    """
    return _smallest_hashes(df.where(F.col(label).isNotNull()), [label], key, seed, split_col,
                            lambda n: F.floor(n * F.lit(test_fraction) + F.lit(0.5)))


def _smallest_hashes(df: DataFrame, by: list, key, seed: int, split_col: str, wanted: Callable[[Column], Column]) -> DataFrame:
    """Per group the ``wanted(size)`` rows with the smallest md5(key:seed) are 'test', the others 'train'.

    A sketch brackets the last wanted hash of each group, with twice its error on either side. Rows outside of the bracket are told by
    their hash alone, wherever they are; only those inside are ranked, from the number of rows below it. Null hashes come last.
    """
    rows = written(df, "split-rows").withColumn("_h", F.md5(F.concat(_key(key), F.lit(f":{seed}"))))
    # The first 60 bits, as a number in the order of the hashes.
    rows = rows.withColumn("_b", F.coalesce(F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"), F.lit(1 << 60)))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_b", [k / MARKS for k in range(MARKS + 1)], SKETCH).alias("_q"))
    n = F.col("_n")
    at = F.when(n > 0, wanted(n) / n)
    # Marks next to the wanted share, one more on either side, so that the sketch's error cannot matter.
    lo, hi = F.get("_q", (F.floor(at * MARKS) - 2).cast("int")), F.get("_q", (F.ceil(at * MARKS) + 2).cast("int"))
    sizes = written(sizes.select(*by, wanted(n).alias("_wanted"), F.coalesce(lo, F.lit(-1)).alias("_lo"),
                                 F.coalesce(hi, F.lit((1 << 60) + 1)).alias("_hi")), "split-brackets")
    marked = attach_group_stats(rows, sizes, by)
    columns = [c for c in df.columns if c != split_col]
    told = marked.where("_b < _lo OR _b > _hi").select(*columns, F.when(F.col("_b") < F.col("_lo"), "test").otherwise("train").alias(split_col))
    below = marked.groupBy(*by).agg(F.count_if(F.col("_b") < F.col("_lo")).alias("_below"))
    inside = rank_within_groups(marked.where("_b BETWEEN _lo AND _hi"), by, [F.col("_h")], rank_col="_r")
    inside = attach_group_stats(inside, below, by)
    test = F.col("_below") + F.col("_r") < F.col("_wanted")
    return told.unionByName(inside.select(*columns, F.when(test, "test").otherwise("train").alias(split_col)))


def kfold_ids(df: DataFrame, k: int, order: Sequence, fold_col: str = "fold", total_order: bool = False) -> DataFrame:
    """M3: contiguous folds over the row order (unshuffled k-fold): the first n mod k folds
    hold one row more."""
    ranked = global_row_index(df, list(order), index_col="_i", total_order=total_order)
    n = df.select(F.count(F.lit(1))).scalar()
    small, extra = F.floor(n / F.lit(k)), n % F.lit(k)
    big_rows = extra * (small + 1)
    fold = F.when(F.col("_i") < big_rows, F.floor(F.col("_i") / (small + 1))).otherwise(
        extra + F.floor((F.col("_i") - big_rows) / small))
    return ranked.withColumn(fold_col, fold.cast("int")).drop("_i")


def group_keys(df: DataFrame, key: str, as_text: bool = False) -> Iterator:
    """Sorted distinct non-null fold keys, streamed to the driver."""
    c = F.col(key).cast("string") if as_text else F.col(key)
    keys = df.select(c.alias("_k")).where(F.col("_k").isNotNull()).distinct().orderBy("_k")
    return (r[0] for r in keys.toLocalIterator())


def leave_one_group_out(df: DataFrame, key: str, as_text: bool = False) -> Iterator[tuple]:
    """M4/M5: (fold value, train, test) per key value. Rows with a null key are in every
    training set and never tested (the reference's ``!=`` on NaN keeps them).
    Folds with an empty side are skipped: the only one is that of a key which all rows have."""
    c = F.col(key).cast("string") if as_text else F.col(key)
    for v in group_keys(df, key, as_text):
        train = df.where(~c.eqNullSafe(F.lit(v)))
        if not train.isEmpty():
            yield v, train, df.where(c == F.lit(v))


def logo_fold_sizes(df: DataFrame, key: str, y: str, as_text: bool = False) -> DataFrame:
    """Per fold: train/test row counts and target sums, from one grouped pass
    (train = everything - test, null keys included in train)."""
    c = F.col(key).cast("string") if as_text else F.col(key)
    per = df.groupBy(c.alias("fold")).agg(F.count(F.lit(1)).alias("n_test"), F.sum(y).alias("sum_y_test"))
    tot = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_s"))
    per = per.where(F.col("fold").isNotNull())
    out = per.select("fold", (tot.select("_n").scalar() - F.col("n_test")).alias("n_train"), "n_test",
                     (tot.select("_s").scalar() - F.col("sum_y_test")).alias("sum_y_train"), "sum_y_test")
    return out.where((F.col("n_train") > 0) & (F.col("n_test") > 0))
