"""Registered queries of the training-data operators: op1_ ... op13_.

Every query applies its operator with production parameters to the whole table. A DuckDB statement is given where SQL can
state the result; the others are tested against brute force in tests/llm.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import (block_naming, bloom_cascade, html_cut, huffman, infilling, mixing, ngram_join, packing, pivot_index,
                         ranked_search, secret_ledger, slots, toxicity)
from tillage.session import scratch_path
from tillage.sources.tables import read_table

MIX_BUDGET, MIX_EPOCHS, MIX_SEED = 60, 4, 7


def op1_huffman_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "id-files")
    huffman.write_ids(read_table(spark, sf, "documents"), path)
    return huffman.read_ids(spark, path, digest=True)


def op2_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = mixing.with_domain(read_table(spark, sf, "documents"))
    return mixing.select_mixture(docs, mixing.LEVELS, mixing.WEIGHTS, MIX_BUDGET, MIX_EPOCHS, MIX_SEED)


def op3_html_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_cut.extract_main_text(read_table(spark, sf, "pages"))


def op4_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf, "documents"))


def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return block_naming.duplicate_groups(read_table(spark, sf, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH t AS (SELECT doc_id, len(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
           FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       row_number() OVER w = 1 AS kept, s AS text_sha256
FROM t WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)"""


def op6_top_k_search(spark: SparkSession, sf: str) -> DataFrame:
    return pivot_index.top_k(read_table(spark, sf, "embeddings"))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages")
    return bloom_cascade.judge_urls(pages, bloom_cascade.tracked(F.col("url")))


def op8_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf, "documents"))


def op9_secret_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """One ledger, two scans: the base rules first, then all rules, of which only the added ones are new to the known blobs."""
    docs, ledger = read_table(spark, sf, "documents"), scratch_path(spark, "ledger")
    base = [x for x in secret_ledger.RULES if x[0] in secret_ledger.BASE_KINDS]
    secret_ledger.append_new(docs, ledger, base)
    return secret_ledger.scan_secrets(docs, ledger)


def op10_toxicity_ftrl(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.judge_toxicity(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    return infilling.infilling_digests(read_table(spark, sf, "documents"))


def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    found = ranked_search.search_documents(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op13_virtual_slots(spark: SparkSession, sf: str) -> DataFrame:
    return slots.shard_places(read_table(spark, sf, "documents"))


def catalogue() -> dict:
    """{name: (builder, DuckDB statement or None)}"""
    return {
        "op1_huffman_token_files": (op1_huffman_token_files, None),
        "op2_mix_sources": (op2_mix_sources, mixing.mixture_sql(MIX_BUDGET, MIX_EPOCHS, MIX_SEED)),
        "op3_html_main_text": (op3_html_main_text, None),
        "op4_ngram_jaccard_join": (op4_ngram_jaccard_join, None),
        "op5_exact_dedup": (op5_exact_dedup, OP5_SQL),
        "op6_top_k_search": (op6_top_k_search, OP6_SQL),
        "op7_url_filter": (op7_url_filter, bloom_cascade.JUDGE_SQL),
        "op8_best_fit_packing": (op8_best_fit_packing, None),
        "op9_secret_ledger": (op9_secret_ledger, None),
        "op10_toxicity_ftrl": (op10_toxicity_ftrl, None),
        "op11_fill_in_middle": (op11_fill_in_middle, infilling.INFILLING_SQL),
        "op12_ranked_search": (op12_ranked_search, ranked_search.RANKED_SQL),
        "op13_virtual_slots": (op13_virtual_slots, None),
    }
