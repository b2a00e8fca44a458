"""The driver's parquet tables and the measurement views built from them.

The "yield view" maps the reference's crop-table roles onto the star schema
(target, group, year, region, numeric and categorical features). Dimension tables
of fixed size (nation: 25 rows, region: 5 rows) are broadcast; everything else is left
to the planner, whose broadcast decision is bounded by the scanned file sizes.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

NUMERIC_FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]
CATEGORICAL_FEATURES = ["l_returnflag", "o_orderpriority"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hash_bucket(key: Column, salt: str = "", modulo: int = 100) -> Column:
    """Deterministic bucket in [0, modulo) from the first 32 bits of md5(key || salt)."""
    k = F.concat(key, F.lit(salt)) if salt else key
    return F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("long") % F.lit(modulo)


def lineitem_key() -> Column:
    """Row identity of lineitem: all four integer keys (the pair orderkey/linenumber repeats)."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in
                              ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])


def yield_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders ⋈ part ⋈ supplier ⋈ nation ⋈ region, projected to the roles.

    Columns: row_key, crop, year, region, region_nk (ASIA → null: a null fold key),
    price (real target), yield (planted target), numeric and categorical features.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    pt = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    su = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    na = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rg = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # nation (25 rows) and region (5 rows) have a fixed size by the schema's definition.
    sup_dim = (su.join(F.broadcast(na), su.s_nationkey == na.n_nationkey)
                 .join(F.broadcast(rg), F.col("n_regionkey") == rg.r_regionkey)
                 .select("s_suppkey", "r_name"))
    j = (li.join(sup_dim, li.l_suppkey == sup_dim.s_suppkey)
           .join(pt, li.l_partkey == pt.p_partkey)
           .join(od, li.l_orderkey == od.o_orderkey))
    base = j.select(
        lineitem_key().alias("row_key"),
        F.col("p_type").alias("crop"),
        F.year("l_shipdate").cast("int").alias("year"),
        F.col("r_name").alias("region"),
        F.when(F.col("r_name") == "ASIA", F.lit(None).cast("string")).otherwise(F.col("r_name")).alias("region_nk"),
        F.col("l_extendedprice").alias("price"),
        "l_quantity", "l_discount",
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"),
        "p_size", "p_retailprice", "l_returnflag", "o_orderpriority",
    )
    noise = hash_bucket(F.col("row_key"), modulo=1000).cast("double") / 10.0 - 50.0
    planted = (F.lit(1000) + F.lit(50) * F.col("l_quantity") - F.lit(4000) * F.col("l_discount")
               + F.lit(20) * F.col("p_size") + noise)
    return base.withColumn("yield", planted)


# DuckDB text of the same view, used by the oracle SQL.
YIELD_VIEW_SQL = """
yv0 AS (
  SELECT concat_ws('|', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_partkey AS VARCHAR),
                   CAST(l.l_suppkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR)) AS row_key,
         p.p_type AS crop, CAST(year(l.l_shipdate) AS INTEGER) AS year, r.r_name AS region,
         CASE WHEN r.r_name = 'ASIA' THEN NULL ELSE r.r_name END AS region_nk,
         l.l_extendedprice AS price, l.l_quantity, l.l_discount, nullif(l.l_tax, 0.0) AS l_tax,
         p.p_size, p.p_retailprice, l.l_returnflag, o.o_orderpriority
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
yv AS (
  SELECT *, 1000 + 50 * l_quantity - 4000 * l_discount + 20 * p_size
            + (CAST(CAST('0x' || substring(md5(row_key), 1, 8) AS UBIGINT) % 1000 AS DOUBLE) / 10.0 - 50.0) AS yield
  FROM yv0
)"""


def sql_hash_bucket(key_sql: str, salt: str = "", modulo: int = 100) -> str:
    k = f"({key_sql} || '{salt}')" if salt else key_sql
    return f"(CAST('0x' || substring(md5({k}), 1, 8) AS UBIGINT) % {modulo})"
