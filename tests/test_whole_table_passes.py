"""Queries that read the view many times write it once; splits and permutations move few rows."""
import hashlib
import math
import os

import pyarrow as pa
from pyspark.sql import functions as F

from tests.conftest import SF001
from tillage.catalog import common, q_eval, q_model, q_profile
from tillage.operators import folds as FO
from tillage.operators import lowess
from tillage.operators.rank_search import quantiles_of
from tillage.plans.generate import generate_text


def _tables(df):
    return {os.path.basename(os.path.dirname(f)) if "tillage-" in f else os.path.basename(f) for f in df.inputFiles()}


def test_the_view_is_read_once(spark):
    for df in (common.standin_predictions(spark, SF001), common.crop_interval_bounds(spark, SF001), q_eval._loyo_predictions(spark, SF001),
               q_profile.a1(spark, SF001), q_eval.u2(spark, SF001), *q_model._split(spark, SF001)):
        assert "lineitem.parquet" not in _tables(df)


def _expected(rows, wanted):
    order = sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}:42".encode()).hexdigest())
    return {r[0] for r in order[:wanted(len(order))]}


def test_splits_are_those_of_a_sort(spark, monkeypatch):
    rows = [(str(k), "a" if k % 10 else "b", k) for k in range(3000)] + [("x", "c", 1)]
    d = spark.createDataFrame(rows, "k string, g string, v long")
    ranked = []
    rank = FO.rank_within_groups
    monkeypatch.setattr(FO, "rank_within_groups", lambda df, *a, **kw: ranked.append(df.count()) or rank(df, *a, **kw))
    got = FO.exact_split(d, "k").collect()
    assert len(got) == 3001 and {r["k"] for r in got if r["split"] == "test"} == _expected(rows, lambda n: math.ceil(0.2 * n))
    got = FO.stratified_split(d, "g", "k").collect()
    want = set().union(*[_expected([r for r in rows if r[1] == g], lambda n: math.floor(0.2 * n + 0.5)) for g in "abc"])
    assert len(got) == 3001 and {r["k"] for r in got if r["split"] == "test"} == want
    assert max(ranked) < 60  # only rows next to the last wanted hash are ranked


def test_split_of_repeated_and_null_keys_keeps_its_size(spark):
    d = spark.range(1000).select(F.when(F.col("id") % 4 == 0, "twin").when(F.col("id") % 4 != 1, F.col("id").cast("string")).alias("k"), "id")
    got = FO.exact_split(d, "k")
    assert got.where("split = 'test'").count() == 200 and got.select("id").distinct().count() == 1000
    assert FO.exact_split(d.limit(0), "k").count() == 0


def test_generator_gets_few_texts_at_a_time(spark):
    d = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("p"), F.col("id"))).alias("p")).coalesce(1)
    out = generate_text(d, "p", lambda texts: [f"{t}/{len(texts)}" for t in texts], batch_size=8)
    got = {r["id"]: r["generated"] for r in out.collect()}
    assert len(got) == 500 and all((v is None) == (k % 3 == 0) for k, v in got.items())
    assert all(v.startswith(f"p{k}/") and int(v.split("/")[1]) <= 8 for k, v in got.items() if v)
    assert "MapInArrow" in out._jdf.queryExecution().toString()


def test_bounds_save_a_round_and_batches_are_joined(spark):
    d = spark.range(0, 1000, 1, 2).select(F.col("id").cast("double").alias("v"))

    def measure(batches):
        for b in batches:
            v = b.column(0).to_numpy()
            yield 0, v, (v >= 0).astype("int64")
    assert quantiles_of(d, measure, [0], 0.3, {0: (0.0, 2000.0)}) == quantiles_of(d, measure, [0], 0.3)
    small = [pa.record_batch([pa.array([float(k)])], names=["x"]) for k in range(10)]
    assert [b.num_rows for b in lowess._larger(iter(small))] == [10] and list(lowess._larger(iter([]))) == []
