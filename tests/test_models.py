import numpy as np

from tillage.operators.ranking import top_k_classes
from tillage.plans.generate import generate_text, translate_with_retry
from tillage.plans.score import linear_logits_model, predict_with_user_model


def test_top_k_ties_and_order(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3],), ([0.4, 0.2, 0.4],)], "p array<double>")
    out = top_k_classes(df, "p", ["a", "b", "c"], k=3).collect()
    assert [out[0][f"Top{i}_Class"] for i in (1, 2, 3)] == ["b", "c", "a"]
    assert [out[1][f"Top{i}_Class"] for i in (1, 2, 3)] == ["a", "c", "b"]
    assert out[0]["Top1_Prob"] >= out[0]["Top2_Prob"] >= out[0]["Top3_Prob"]


def test_generation_of_null_and_failing_prompts(spark):
    def picky(prompts):
        if any(p == "bad" for p in prompts):
            raise ValueError("no answer")
        return [p.upper() for p in prompts]
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "bad"), (4, "b")], "k int, p string").coalesce(1)
    got = {r["k"]: r["generated"] for r in generate_text(df, "p", picky).collect()}
    assert got == {1: "A", 2: None, 3: "(generation failed: no answer)", 4: "B"}


def test_translation_keeps_rows_and_asks_nothing_for_english(spark):
    def no_english(prompts):
        assert not any("into English" in p for p in prompts)
        return ["hello"] * len(prompts)
    df = spark.createDataFrame([(1, "x", "English"), (2, "x", None), (3, "x", "Tamil"), (4, None, "Tamil")], "k int, t string, l string")
    got = {r["k"]: (r["translated"], r["retried"]) for r in translate_with_retry(df, "t", "l", no_english).collect()}
    assert got == {1: ("x", False), 2: (None, True), 3: ("hello", True), 4: (None, True)}


def test_user_model_with_missing_features(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 2.0])], "k int, f array<double>")
    fn = linear_logits_model(np.eye(2))
    plain = {r["k"]: r["prob"] for r in predict_with_user_model(df, "f", fn, returns_logits=False).collect()}
    assert plain[1] == [1.0, 2.0] and plain[2] is None
    filled = {r["k"]: r["prob"] for r in predict_with_user_model(df, "f", fn, returns_logits=False, fill=[5.0, 6.0]).collect()}
    assert filled == {1: [1.0, 2.0], 2: [5.0, 6.0], 3: [5.0, 2.0]}
