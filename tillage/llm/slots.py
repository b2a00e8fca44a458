"""Operator 13: shards through a fixed number of virtual slots (DataFrame functions only).

A record's id is hashed into one of ``SLOTS`` slots, for good. Bytes and rows are added up per slot, and a small map says which
shard holds a slot. The map is a stored table with versions: a new version is an edit of the last one, in which shards above
their fair share give up slots (largest kept first) and the others take them, largest first, each to the shard with the
least bytes. When a shard is added, only that shard takes slots. Ids never move between slots, so a record moves only with its slot.

A slot much heavier than the mean (an id that very many rows repeat, or null ids) is split into parts, to which its rows are dealt by
row number; a part is placed like a slot of its own. The map thus has at most ``SLOTS * (1 + 1 / HEAVY)`` rows at any size of
the corpus, and it is the only table that is joined by broadcast or gathered in one row.

Scale: texts are read once for size and checksum; from there on a record is an id and some numbers. A record's place
in its shard is the number of records in the chunks before its own (one row per ``CHUNK_ROWS`` records) plus its place in
the chunk; no window holds more than a chunk or a shard's chunks.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillage.llm.shared import stored, text_or_empty
from tillage.session import scratch_path

SLOTS = 4096
SHARDS = 24
HEAVY = 8
CHUNK_ROWS = 32_768
OVERHEAD = 8
MAP = "version int, slot int, part int, parts int, shard int, bytes long, n_rows long"


def record_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, slot, row) of every record; ``row`` numbers the records, so that equal ones can be told apart."""
    raw = F.encode(text_or_empty(text_col), "UTF-8")
    return stored(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(slots)).cast("int").alias("slot"),
        F.monotonically_increasing_id().alias("row")), "slots-records")


def slot_parts(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, parts): 1, or as many parts as bring a heavy slot's down to ``HEAVY`` times the mean."""
    each = records.groupBy("slot").agg(F.sum("size").alias("bytes"))
    mean = each.agg((F.sum("bytes") / F.lit(slots)).alias("mean"))
    return each.crossJoin(F.broadcast(mean)).select(  # mean: one row
        "slot", F.greatest(F.lit(1), F.ceil(F.col("bytes") / (F.col("mean") * HEAVY))).cast("int").alias("parts"))


def in_parts(records: DataFrame, parts: DataFrame) -> DataFrame:
    """``records`` with ``parts`` and ``part``. ``parts`` has at most one row per slot."""
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).otherwise(F.lit(0))
    return records.join(F.broadcast(parts.select("slot", "parts")), "slot").withColumn("part", part)


def slot_bytes(placed: DataFrame) -> DataFrame:
    """(slot, part, parts, bytes, n_rows) of records in parts."""
    return placed.groupBy("slot", "part", "parts").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def deal(pool: DataFrame, loads: Column) -> DataFrame:
    """(slot, part, shard): slots of ``pool`` by falling bytes, each to the shard with the least bytes so far.

    ``loads`` is the array of bytes that the shards hold already, null for a shard that takes nothing. The pool has at most
    one row per slot and part, and becomes one array.
    """
    rows = pool.agg(F.collect_list(F.struct((-F.col("bytes")).alias("less"), F.col("slot"), F.col("part"))).alias("slots"))
    start = F.struct(loads.alias("loads"), F.expr("CAST(array() AS ARRAY<INT>)").alias("shards"))

    def place(state: Column, slot: Column) -> Column:
        to = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        return F.struct(F.transform(state["loads"], lambda x, k: F.when(k + 1 == to, x - slot["less"]).otherwise(x)).alias("loads"),
                        F.concat(state["shards"], F.array(to - 1)).alias("shards"))

    dealt = rows.select(F.sort_array("slots").alias("slots")).select(
        "slots", F.aggregate("slots", start, place, lambda state: state["shards"]).alias("shards"))
    return dealt.select(F.explode(F.arrays_zip("slots", "shards")).alias("x")).select("x.slots.slot", "x.slots.part", F.col("x.shards").alias("shard"))


def edited_map(sizes: DataFrame, shards: int, last: DataFrame | None = None) -> DataFrame:
    """The next version of the map for slots of these ``sizes`` (as slot_bytes() gives them).

    Without ``last`` all slots are dealt. Otherwise every shard keeps, largest first, the slots that fit into its fair share of
    all bytes, the others and slots that are new are dealt again. If ``last`` has fewer shards, only the added ones take slots,
    and slots that are new go to them as well. A map with more shards than asked for is an error.
    """
    spark = sizes.sparkSession
    if last is None:
        empty = F.array_repeat(F.lit(0).cast("long"), shards)
        return sizes.join(deal(sizes, empty), ["slot", "part"]).select(
            F.lit(1).alias("version"), "slot", "part", "parts", F.col("shard").cast("int").alias("shard"), "bytes", "n_rows")
    head = last.agg(F.max("version").alias("version"), (F.max("shard") + 1).alias("shards")).first()
    before = int(head["shards"] or 0)
    if before > shards:
        raise ValueError("a map is edited to as many shards as it has, or more")
    total = sizes.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    held = sizes.join(last.select("slot", "part", F.col("shard").alias("_was")), ["slot", "part"], "left")
    largest = Window.partitionBy("_was").orderBy(F.desc("bytes"), "slot", "part").rowsBetween(Window.unboundedPreceding, 0)
    held = stored(held.withColumn("_keep", F.col("_was").isNotNull() & (F.sum("bytes").over(largest) * shards <= F.lit(total))), "slots-held")
    kept = {r["_was"]: r["b"] for r in held.where("_keep").groupBy("_was").agg(F.sum("bytes").alias("b")).collect()}  # one row a shard
    takes = range(before, shards) if before < shards else range(shards)
    loads = F.array(*[F.lit(kept.get(k, 0) if k in takes else None).cast("long") for k in range(shards)])
    # All slots of a full shard may be cut off, so what the taking shards cannot hold stays where it was.
    moved = deal(held.where("NOT _keep"), loads).withColumnRenamed("shard", "_to")
    if before < shards:
        moved = stored(moved.join(held.select("slot", "part", "bytes", "_was"), ["slot", "part"]), "slots-moved")
        into = Window.partitionBy("_to").orderBy(F.col("_was").isNotNull(), F.desc("bytes"), "slot", "part").rowsBetween(Window.unboundedPreceding, 0)
        fits = F.col("_was").isNull() | (F.sum("bytes").over(into) * shards <= F.lit(total))
        moved = moved.withColumn("_fits", fits).select("slot", "part", F.when(F.col("_fits"), F.col("_to")).otherwise(F.col("_was")).alias("_to"))
    return spark.createDataFrame([], MAP).unionByName(held.join(moved, ["slot", "part"], "left").select(
        F.lit(int(head["version"]) + 1).alias("version"), "slot", "part", "parts",
        F.when(F.col("_keep"), F.col("_was")).otherwise(F.col("_to")).cast("int").alias("shard"), "bytes", "n_rows"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Append one version of the map to the table at ``path``."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map at ``path``, the last one unless given."""
    m = spark.read.schema(MAP).parquet(path)
    wanted = m.agg(F.max("version")).scalar() if version is None else F.lit(version)
    return m.where(F.col("version") == wanted)


def records_in_shards(placed: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``placed`` records with ``shard`` and ``place`` (from 0 without gaps in each shard), by the map."""
    chunked = slot_map.select("slot", "part", "shard", "version", F.ceil(F.col("n_rows") / CHUNK_ROWS).cast("int").alias("chunks"))
    d = placed.join(F.broadcast(chunked), ["slot", "part"]).withColumn(  # the map: bounded by SLOTS
        "chunk", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("row", F.lit(1)), F.col("chunks")).cast("int")).otherwise(F.lit(0)))
    earlier = Window.partitionBy("shard").orderBy("slot", "part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy("shard", "slot", "part", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("slot", "part", "chunk", "before")
    own = Window.partitionBy("slot", "part", "chunk").orderBy("row")
    d = d.withColumn("at", F.row_number().over(own) - 1)
    return d.join(before, ["slot", "part", "chunk"]).withColumn("place", F.col("before") + F.col("at"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, map_path: str | None = None, id_col: str = "doc_id",
                    text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``shard``, ``place``, ``virtual_slot``, ``part``, ``map_version``.

    The size is the text's UTF-8 bytes plus 8; a null text has none and the checksum of an empty one. If ``map_path``
    holds a map, its next version is an edit of the last; otherwise version 1 is made, there or in the scratch folder. A null id is
    hashed like an empty one; rows that repeat an id share a slot, and its part if the slot is not split. An empty table
    gives an empty result and an empty map; other columns are ignored.
    """
    spark = docs.sparkSession
    records = record_sizes(docs, id_col, text_col, slots)
    path = map_path or scratch_path(spark, "slot-map")
    last = _stored_map(spark, map_path) if map_path else None
    # A slot keeps the parts it had, so that its records move only with it.
    parts = slot_parts(records, slots)
    if last is not None:
        old = last.groupBy("slot").agg(F.max("parts").alias("_old"))
        parts = parts.join(F.broadcast(old), "slot", "left").select("slot", F.coalesce("_old", "parts").alias("parts"))
    parts = stored(parts, "slots-parts")
    placed = in_parts(records, parts)
    sizes = stored(slot_bytes(placed), "slots-sizes")
    store_map(edited_map(sizes, shards, last), path)
    return records_in_shards(placed, read_map(spark, path)).select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", F.col("place").cast("long").alias("place"),
        F.col("slot").alias("virtual_slot"), "part", F.col("version").alias("map_version"))


def _stored_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version of the map at ``path``, if there is one."""
    try:
        m = read_map(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if m.isEmpty() else m


def shard_places(docs: DataFrame) -> DataFrame:
    """The columns of the registered query: near equal bytes is the law that the map keeps."""
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "part", "map_version")
