"""Boosted models larger than a task: passes in step, and a softmax model with a task a class."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tillage.plans import many_models as MM


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(2000).selectExpr("id", "(id * 7919) % 50 AS a", "(id * 104729) % 11 AS b")
    return d.selectExpr("id", "CAST(1000 + 50 * a - 40 * b + (id * 17) % 13 AS double) AS y", "array(CAST(a AS double), CAST(b AS double)) AS x",
                        "CAST((a DIV 10 + b + abs(xxhash64(id)) % 13 DIV 9) % 3 AS double) AS cls")  # noise: no two cuts of the same gain


def _found(rows, models):
    return {(r["model"], r["id"]): r["p"] for r in MM.fit_and_score(rows, models).collect()}


def _near(a, b):
    return set(a) == set(b) and all(np.allclose(p, b[k], rtol=1e-6, atol=1e-9) for k, p in a.items())


def test_models_of_unlike_rounds_share_their_scores(spark, rows, monkeypatch):
    every = F.lit(True)
    models = [MM.quantile("lo", every, every, 0.1, rounds=9, rate=0.3), MM.boosted("mean", every, F.col("id") < 50, rounds=9, rate=0.3, depth=3, min_leaf=1),
              MM.quantile("none", F.lit(False), F.col("id") < 5, 0.9, rounds=9)]
    here = _found(rows, models)
    monkeypatch.setattr(MM, "BLOCK", 300)
    monkeypatch.setattr(MM, "BLOCKS_HERE", 0)
    monkeypatch.setattr(MM, "CELLS_HERE", 0)
    sent = []
    for_tasks = MM.Boosting.for_tasks
    monkeypatch.setattr(MM.Boosting, "for_tasks", lambda self, since: sent.append(len(self.trees) - since) or for_tasks(self, since))
    passes = _found(rows, models)
    assert _near(here, passes) and len(passes) == 2055
    assert max(sent[:-3]) <= MM.REFRESH  # but for the last, to score with, no task repeats more rounds


def test_a_task_a_class_gives_the_trees_of_one_task(spark, rows, monkeypatch):
    d = rows.withColumn("y", F.col("cls"))
    train = F.col("id") % 4 > 0
    models = [MM.multinomial("c", train, F.lit(True), 3, rounds=6, rate=0.3, min_leaf=5), MM.forest("f", train, F.lit(True), trees=2, classes=3, every_row=True)]
    here = _found(d, models)
    asked = []
    by_classes = MM.boost_by_classes
    monkeypatch.setattr(MM, "boost_by_classes", lambda blocks, m, k: asked.append(k) or by_classes(blocks, m, k))
    monkeypatch.setattr(MM, "BY_CLASSES", 0)
    monkeypatch.setattr(MM, "BLOCK", 300)
    classes = _found(d, models)
    assert asked == [0] and _near({k: p for k, p in here.items() if k[0] == 0}, {k: p for k, p in classes.items() if k[0] == 0})
    assert len(classes) == 4000
    # Too large for a task: by passes, as before.
    monkeypatch.setattr(MM, "BYTES_HERE", 0)
    monkeypatch.setattr(MM, "BLOCKS_HERE", 0)
    monkeypatch.setattr(MM, "CELLS_HERE", 0)
    monkeypatch.setattr(MM, "TO_DRIVER", 0)
    passes = _found(d, models[:1])
    assert asked == [0] and _near({k: p for k, p in here.items() if k[0] == 0}, passes)


def test_blocks_share_files(spark, rows, monkeypatch):
    monkeypatch.setattr(MM, "BLOCK", 100)
    blocks = MM.binned_blocks(rows, [MM.boosted("b", F.lit(True), F.lit(True))])
    assert len(blocks.table.inputFiles()) <= 2 and blocks.table.count() >= 20
    ids = np.concatenate([np.frombuffer(r["ids"], dtype="<i8") for r in blocks.table.collect()])
    assert sorted(ids.tolist()) == list(range(2000))
