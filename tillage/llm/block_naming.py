"""Operator 5: exact duplicates by deterministic block naming.

The normalised text (UTF-8) is cut into blocks of ``BLOCK_BYTES`` bytes. All distinct blocks are sorted and
numbered; equal blocks have one name and different blocks different names. Then adjacent names of a document
are paired, the distinct pairs are sorted and numbered in turn, and so on until each document has one name:
after level k a name stands for 2^k blocks. Two documents are equal exactly if they end at the same level with
the same name.

Scale: texts are read twice and shuffled once (as distinct blocks, pre-aggregated in each input
task). Everything else moves integers. A block refers to its name by a 128-bit digest, which is no source
of error: the table of names holds the blocks' whole contents while it is made, and another seed is taken if
two blocks ever share a digest. Copies of one document never meet in one task: names are joined by skew-splittable
joins and groups are reduced by partial aggregation.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm.shared import rows_with_ids, stored, text_or_empty

BLOCK_BYTES = 4096
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """UTF-8 bytes of a text (null: empty) without the characters of ``[\\x20\\x09-\\x0D]``."""
    return F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, ""), "UTF-8")


def _blocks(raw: str, block_bytes: int) -> Column:
    """Array of the blocks of a binary column; an empty text is one empty block."""
    last = f"greatest(0, (octet_length({raw}) - 1) div {block_bytes})"
    return F.expr(f"transform(sequence(0, {last}), i -> substring({raw}, cast(i * {block_bytes} + 1 as int), {block_bytes}))")


def _digest(block: str, seed: int) -> str:
    return f"struct(xxhash64({seed}L, {block}) as a, xxhash64({block}, {seed + 1}L) as b)"


def _named(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number the distinct keys in sorted order within the exchange's partitions: unique whole numbers."""
    return stored(distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), name)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``level``, ``name``.

    Equal normalised texts form a group. Of a group the row with the most code points in the original text, then
    the smallest id, stays; a null id loses ties, and of rows that share id and length one stays. Null texts count as
    empty, and empty texts are equal to each other. An empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")) \
        .withColumn("raw", normalised(F.col("text")))
    seed = 0
    while True:
        rows = stored(texts.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.char_length("text").alias("n_chars"),
            F.unhex(F.sha2("raw", 256)).alias("sha"), _blocks("raw", block_bytes).alias("blocks")).select(
            "row", "doc_id", "n_chars", "sha", F.expr(f"transform(blocks, x -> {_digest('x', seed)})").alias("blocks")),
            "naming-rows")
        distinct = texts.select(F.explode(_blocks("raw", block_bytes)).alias("block")).distinct()
        names = stored(distinct.sortWithinPartitions("block").select(
            F.expr(_digest("block", seed)).alias("block"), F.monotonically_increasing_id().alias("name")), "naming-0")
        if names.groupBy("block").count().where("count > 1").isEmpty():
            break
        seed += 2
    longest = rows.agg(F.max(F.size("blocks")).alias("n")).first()["n"] or 1
    level, finished = 0, []
    now = stored(rows.select("row", F.size("blocks").alias("size"), F.posexplode("blocks").alias("pos", "block"))
                 .join(names, "block").select("row", "size", F.col("pos").cast("long").alias("pos"), "name"), "naming-at-0")
    while True:
        done = F.col("size") <= (1 << level)
        finished.append(now.where(done).select("row", F.lit(level).alias("level"), "name"))
        if longest <= 1 << level:
            break
        level += 1
        pairs = now.where(~done).groupBy("row", "size", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
        names = _named(pairs.select("left", "right").distinct(), ["left", "right"], f"naming-{level}")
        now = stored(pairs.join(names, ["left", "right"]).select("row", "size", "pos", "name"), f"naming-at-{level}")
    identity = finished[0]
    for f in finished[1:]:
        identity = identity.unionByName(f)
    each = stored(rows.drop("blocks").join(identity, "row"), "naming-identity")
    # Least in this order: most code points, smallest id, null ids last, then the row's number.
    best = F.struct(-F.col("n_chars").cast("long"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    # Written, so that the join below has a plain exchange on either side, which Spark splits for a hot group.
    groups = stored(each.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best")), "naming-best")
    return each.join(groups, ["level", "name"]).select(
        F.col("doc_id").alias(id_col), F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "level", "name")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when exact copies go, with all their columns.

    Rows that repeat one id with one text are one document, of which one row stays.
    """
    groups = stored(duplicate_groups(docs), "naming-groups")
    kept = groups.where("kept").select("doc_id", "text_sha256")
    repeated = groups.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return rows_with_ids(docs, kept.select("doc_id"), "doc_id")
    again = stored(repeated, "naming-repeated")
    once = kept.join(again.withColumnRenamed("doc_id", "_r"), F.col("doc_id").eqNullSafe(F.col("_r")), "left_anti")
    some = rows_with_ids(docs, again, "doc_id").withColumn("__sha", F.sha2(normalised(F.col("text")), 256))
    keep = rows_with_ids(kept, again, "doc_id").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__kept"))
    some = some.join(keep, some["doc_id"].eqNullSafe(keep["__id"]) & (F.col("__sha") == F.col("__kept")), "left_semi")
    longest = F.max_by(F.struct(*docs.columns), F.char_length(text_or_empty("text"))).alias("__row")
    some = some.groupBy("doc_id", "__sha").agg(longest).select("__row.*")
    return rows_with_ids(docs, once.select("doc_id"), "doc_id").unionByName(some)
