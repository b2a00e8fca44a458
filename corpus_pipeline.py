"""Corpus pipeline: five stages over the documents table, from raw texts to packed training sequences.

1. toxicity        documents that the classifier rejects go
2. exact_dedup     one document of each group of equal texts stays
3. near_dedup      one document of each class of near copies (five-word shingles, similarity 0.8) stays
4. mixing          sources to target weights: a share of the tokens, each document once at most
5. packing         sequences of 2,048 tokens

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; all but the last return the
columns of documents. A stage's result is written as Parquet and read again as the next one's docs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillage.llm import block_naming, mixing, ngram_join, packing, toxicity
from tillage.llm.shared import stored
from tillage.sources.tables import read_table

# Share of the remaining tokens that the mixture takes, in percent.
MIX_BUDGET = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return block_naming.first_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.first_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture_rows(docs, MIX_BUDGET)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies),
          ("mixing", mix_sources), ("packing", pack_sequences)]

# The classifier, the MinHash candidates and the packing are not expressible in SQL; tests/llm/test_pipeline.py holds the
# stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
