"""The pipeline's stages against what each of them promises."""
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_copies import brute_near

SF = "/root/testdata/sf0.01"


def test_stages_on_the_documents_table(spark):
    from tillage.llm.shared import stored
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), f"test-{name}")
        before, after = docs.collect(), out.collect()
        if name != "packing":
            assert out.columns == docs.columns and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
        if name == "toxicity":
            assert sum(labels.get(k) == 0 for k in gone) <= 2
        elif name == "exact_dedup":
            norm = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r["text"])
            assert len(after) == len({norm(r) for r in before}) == len({norm(r) for r in after})
        elif name == "near_dedup":
            assert {r["doc_id"] for r in after} == {c for c, _ in brute_near(before).values()}
        elif name == "mixing":
            count = lambda rows: sum(len(re.findall(r"\S+", r["text"])) for r in rows)
            assert 0.5 * count(before) < count(after) <= 0.8 * count(before)
        else:
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
        docs = out


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_edges(spark, odd_docs, empty):
    docs = odd_docs.limit(0) if empty else odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert (docs.count() == 0) == empty
    assert docs.where(F.col("length") < 1).count() == 0
