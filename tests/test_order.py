import numpy as np
import pytest
from pyspark.sql import functions as F

from tillage.operators.order import global_row_index, group_quantiles, rank_within_groups


def test_rank_within_groups_skewed(spark):
    # one hot group with a third of the rows; ranks must be 0..n_g-1 in value order
    rows = [(("hot" if i % 3 == 0 else f"g{i % 7}"), float((i * 37) % 101)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = rank_within_groups(df, ["g"], ["v"]).toPandas()
    for g, sub in out.groupby("g"):
        assert sorted(sub["_rank"]) == list(range(len(sub)))
        s = sub.sort_values("_rank")
        assert list(s["v"]) == sorted(s["v"])


@pytest.mark.parametrize("accuracy", [20, 100_000])
def test_group_quantiles_match_numpy(spark, accuracy):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=2500)
    grp = np.where(np.arange(2500) % 3 == 0, "a", np.where(np.arange(2500) % 5 == 0, "b", "c"))
    pdf = [(g, float(v)) for g, v in zip(grp, vals)] + [("a", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(pdf, "g string, v double")
    got = group_quantiles(df, "v", [0.01, 0.25, 0.5, 0.99], by=["g"], names=["a", "b", "c", "d"],
                          accuracy=accuracy).toPandas()
    for _, r in got.iterrows():
        if r["g"] is None:
            sub = np.array([1.0, 3.0])
        else:
            sub = vals[grp == r["g"]]
        exp = np.quantile(sub, [0.01, 0.25, 0.5, 0.99])
        assert np.allclose([r["a"], r["b"], r["c"], r["d"]], exp, rtol=1e-12, atol=1e-12)


def test_global_quantile_distributed_ungrouped(spark):
    df = spark.range(997).withColumn("v", (F.col("id") * 7 % 997).cast("double"))
    got = group_quantiles(df, "v", [0.5, 0.9], names=["m", "p9"]).first()
    assert got["m"] == 498.0 and abs(got["p9"] - 896.4) < 1e-9


def test_global_row_index(spark):
    df = spark.range(500).withColumn("k", F.md5(F.col("id").cast("string")))
    out = global_row_index(df, ["k"], total_order=True).toPandas().sort_values("_idx")
    assert list(out["_idx"]) == list(range(500))
    assert list(out["k"]) == sorted(out["k"])


def test_quantiles_of_tiny_and_tied_groups(spark):
    groups = {"one": [4.0], "two": [1.0, 2.0], "four": [3.0, 1.0, 2.0, 9.0], "ties": [5.0] * 600 + [1.0] * 200 + [7.0, 8.0] * 100,
              "none": [None, float("nan")]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    probs = [0.9, 0.0, 0.25, 0.25, 1.0, 0.01]
    for accuracy in (10, 100_000):
        got = {r["g"]: list(r)[1:] for r in group_quantiles(df, "v", probs, by=["g"], names=list("abcdef"), accuracy=accuracy).collect()}
        assert got.keys() == groups.keys() - {"none"}
        for g, q in got.items():
            assert np.allclose(q, np.quantile(groups[g], probs), rtol=1e-12)
    assert group_quantiles(df.where("false"), "v", [0.5], names=["m"]).collect() == []


def test_tied_values_are_counted_before_the_shuffle(spark):
    # 60 % equal values: the aggregation that shuffles has one row per value and task, not one per row
    df = spark.range(0, 20_000, 1, 4).select(F.when(F.col("id") % 5 < 3, 1.0).otherwise(F.col("id") % 50 + 0.5).alias("v"))
    q = group_quantiles(df, "v", [0.25, 0.5, 0.75], names=["a", "b", "c"])
    vals = [1.0 if i % 5 < 3 else i % 50 + 0.5 for i in range(20_000)]
    assert np.allclose(list(q.first()), np.quantile(vals, [0.25, 0.5, 0.75]))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "partial_count" in plan
