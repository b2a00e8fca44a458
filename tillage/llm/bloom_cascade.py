"""Operator 7: URL rules, and exact list membership by a Bloom filter cascade.

Rules are (host, path) pairs that fit a host, its subdomains and every path that starts with theirs; the longest
wins. Addresses without a rule are judged by a list of keys, held as a cascade of Bloom filters: level 1 encodes the
listed keys, level 2 the keys of the corpus that level 1 wrongly accepts, level 3 the listed keys that level 2 wrongly
accepts, and so on until a level makes no error. The levels are built over all distinct keys of the corpus, so every
answer about the corpus is exact, and no address is joined with the list.

Scale: keys are reduced to distinct keys by partial aggregation and dealt over shards of about ``SHARD_KEYS`` keys by
their hash; each shard has its own small cascade. All cascades are sent to the tasks while their bytes stay
within ``BROADCAST_BYTES``; beyond that pages meet their shard's cascade in a co-grouped pass, hot shards salted.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm.shared import arrow_batches, shuffle_parts, stored

# The registered query's rules, (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SHARD_KEYS = 16_384
BROADCAST_BYTES = 32 << 20
MAX_LEVELS = 200

_LEVELS = "shard int, bits array<long>, hashes array<int>, filters array<binary>"
_PAGE_FIELDS = ["page_id", "host", "path", "rule"]


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), upper, upper.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule (first of equals), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # later ones take precedence
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _positions(a: np.ndarray, b: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Places of keys in the filter of a level, by double hashing of their two digests."""
    with np.errstate(over="ignore"):
        x = a + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        y = ((b ^ np.uint64(level * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
        return (x[:, None] + np.arange(hashes, dtype=np.uint64)[None, :] * y[:, None]) % np.uint64(bits)


def _accepts(level_filter: np.ndarray, places: np.ndarray) -> np.ndarray:
    return level_filter[places].all(axis=1) if len(places) else np.zeros(0, dtype=bool)


def build_cascade(a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Levels (bits, hashes, filter) of the cascade that tells ``listed`` keys from the others; digests a, b of all keys."""
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels: list[tuple[int, int, bytes]] = []
    while len(inside):
        # The first filter is sized for the ratio of the two sides, the later ones for an error of one half.
        error = min(0.5, max(1e-9, len(inside) * sqrt(0.5) / max(1, len(outside)))) if not levels else 0.5
        bits = max(8, ceil(-len(inside) * log(error) / log(2) ** 2))
        hashes = max(1, round(-log(error, 2)))
        level_filter = np.zeros(bits, dtype=bool)
        level_filter[_positions(a[inside], b[inside], len(levels), bits, hashes).reshape(-1)] = True
        wrong = outside[_accepts(level_filter, _positions(a[outside], b[outside], len(levels), bits, hashes))]
        levels.append((bits, hashes, np.packbits(level_filter).tobytes()))
        if len(levels) > MAX_LEVELS:
            raise ValueError("two different keys share both digests")
        inside, outside = wrong, inside
    return levels


def is_listed(levels: list[tuple[int, int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Membership of keys: the number of levels that accept a key in a row is odd for listed keys.

    A key that every level accepts is on the side that the last level encodes.
    """
    count = np.zeros(len(a), dtype=np.int64)
    going = np.arange(len(a))
    for k, (bits, hashes, level_filter) in enumerate(levels):
        going = going[_accepts(level_filter, _positions(a[going], b[going], k, bits, hashes))]
        count[going] += 1
        if not len(going):
            break
    return count % 2 == 1


def _build(table: pa.Table) -> pa.Table:
    digest = lambda c: table.column(c).to_numpy().astype(np.int64).view(np.uint64)
    levels = build_cascade(digest("a"), digest("b"), table.column("listed").to_numpy(zero_copy_only=False).astype(bool))
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                     "bits": pa.array([[x[0] for x in levels]], pa.list_(pa.int64())),
                     "hashes": pa.array([[x[1] for x in levels]], pa.list_(pa.int32())),
                     "filters": pa.array([[x[2] for x in levels]], pa.list_(pa.binary()))})


def cascades(keys: DataFrame) -> tuple[DataFrame, int]:
    """Cascades of all shards and their number. ``keys``: (key, listed), every key of the corpus, repeats allowed; a key is
    listed if any of its rows is."""
    distinct = stored(keys.groupBy("key").agg(F.max("listed").alias("listed")).select(
        F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"), "listed"), "cascade-keys")
    shards = max(1, -(-distinct.count() // SHARD_KEYS))
    dealt = distinct.withColumn("shard", shard_of(F.col("a"), shards)).repartition(max(shards, shuffle_parts(keys.sparkSession)), "shard")
    return stored(dealt.groupBy("shard").applyInArrow(_build, _LEVELS), "cascade-levels"), shards


def shard_of(digest: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(digest, 16), F.lit(shards)).cast("int")


def _unpacked(bits: list[int], hashes: list[int], filters: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    return [(n, h, np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool)) for n, h, f in zip(bits, hashes, filters, strict=True)]


def _judge(batches: Iterator[pa.RecordBatch], tables: dict) -> Iterator[pa.RecordBatch]:
    unpacked: dict[int, list] = {}
    for b in batches:
        digest = lambda c, b=b: b.column(c).to_numpy().view(np.uint64)
        shard, a, c = b.column("shard").to_numpy(), digest("a"), digest("b")
        listed = np.zeros(b.num_rows, dtype=bool)
        for s in np.unique(shard).tolist():
            if s not in unpacked:
                unpacked[s] = _unpacked(*tables.get(s, ([], [], [])))
            mine = np.flatnonzero(shard == s)
            listed[mine] = is_listed(unpacked[s], a[mine], c[mine])
        yield _verdicts(b, listed)


def _verdicts(b, listed: np.ndarray):
    verdict = [v if v is not None else "block" if x else "allow" for v, x in zip(b.column("verdict").to_pylist(), listed.tolist(), strict=True)]
    return type(b).from_arrays([*(b.column(n) for n in _PAGE_FIELDS), pa.array(verdict, pa.string())], names=[*_PAGE_FIELDS, "verdict"])


def _judge_group(pages: pa.Table, levels: pa.Table) -> pa.Table:
    pages = pages.combine_chunks()
    rows = levels.to_pylist()[:1]
    table = _unpacked(rows[0]["bits"], rows[0]["hashes"], rows[0]["filters"]) if rows else []
    digest = lambda c: pages.column(c).to_numpy().astype(np.int64).view(np.uint64)
    return _verdicts(pages, is_listed(table, digest("a"), digest("b")))


def judge_urls(pages: DataFrame, listed: Column, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id",
               url_col: str = "url", broadcast_bytes: int = BROADCAST_BYTES, salt_rows: int = 200_000) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``listed`` says of a row of ``pages`` whether its key (host and path) is put on the block list; a key listed by one row
    is listed for all. A rule decides first (its verdict), else the list (block if listed, allow if not). A null url, or one
    without ``://``, has an empty host and path, which is a key like any other. A null ``listed`` counts as false. An
    empty table gives an empty result; repeated rows give repeated rows; other columns are ignored.
    """
    spark = pages.sparkSession
    arrow_batches(spark)
    url = F.coalesce(F.col(url_col), F.lit(""))
    d = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"),
                     F.coalesce(listed, F.lit(False)).alias("listed"))
    d = d.withColumn("key", F.concat(F.col("host"), F.col("path")))
    levels, shards = cascades(d.select("key", "listed"))
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    asked = d.withColumn("_r", rule).select(
        "page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("verdict"),
        F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b")).withColumn("shard", shard_of(F.col("a"), shards))
    out = f"page_id {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string"
    size = levels.agg(F.sum(F.expr("aggregate(filters, 0L, (s, f) -> s + octet_length(f))"))).first()[0] or 0
    if size <= broadcast_bytes:
        tables = {r["shard"]: (r["bits"], r["hashes"], [bytes(f) for f in r["filters"]]) for r in levels.collect()}
        return asked.mapInArrow(lambda b: _judge(b, tables), out)
    salts = asked.groupBy("shard").count().select("shard", F.ceil(F.col("count") / F.lit(salt_rows)).cast("int").alias("salts"))
    asked = asked.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.col("salts")).cast("int")).drop("salts")
    spread = levels.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return asked.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInArrow(_judge_group, out)


def tracked(url: Column) -> Column:
    """The registered query's block list: keys that the corpus has seen with a ``utm_source`` parameter."""
    return url.contains("?utm_source=")


# The same judgement in DuckDB.
JUDGE_SQL = """
WITH cut AS (SELECT page_id, coalesce(url, '') AS u, instr(coalesce(url, ''), '://') AS spot FROM pages),
rest AS (SELECT page_id, u, CASE WHEN spot > 0 THEN substr(u, spot + 3) ELSE '' END AS r FROM cut),
parts AS (SELECT page_id, u, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
listed AS (SELECT DISTINCT host || path AS key FROM parts WHERE contains(u, '?utm_source=')),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""
