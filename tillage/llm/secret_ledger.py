"""Operator 9: secret scans kept in a ledger of text blobs.

Every version of a text is addressed by the SHA-256 of its content, its blob. Every rule has a version of its own, a digest of
its pattern and limits. A ledger row says of a blob which rule versions a scan has applied to it, with their findings; a blob
may have several rows. A scan takes only the (blob, rule version) pairs that the ledger lacks: a new rule runs alone
over the known blobs, a new blob meets all rules. Findings are joined back to all rows (paths) that hold the blob.

Scale: a first pass reduces the texts to (id, blob). What is missing is found on these narrow rows, with one
representative per blob from partial aggregation, and written; its size is then known when the texts are joined with it, so a scan
with little that is new need not shuffle texts, and one with nothing new does not read them again. Only
representatives reach the patterns, which dominate the cost. Copies share one ledger row and meet it in a join of narrow
rows that Spark can split when a blob is hot. Two writers may append the same pair: readers drop doubles.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm.shared import arrow_batches, stored, text_or_empty

# Kind, pattern, group whose length counts, least length. Kinds sort in this order; the first three are
# the base kinds, the others are added spans. Two more values ask for context: the least entropy of the match in bits a
# character, and within how many code points after a keyword it must start.
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("webtoken", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 0, 40),
    ("upper", r"(?<![A-Za-z0-9])[A-Z0-9]++(?![a-z])", 0, 16, 3.0, 40),
    ("base64", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]++={0,2}", 0, 24, 4.0, 40),
]
BASE_KINDS = ("assign", "access", "hex")
# Keywords of the assign pattern: a text without any of them has no match, and no match in context.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

LEDGER = "blob binary, rules array<string>, spans array<struct<rule:string,kind:string,start:long,end:long>>"


def rule_version(rule: tuple) -> str:
    """Name of a rule: a digest of its kind, pattern and limits."""
    return sha256(repr(tuple(rule)).encode()).hexdigest()[:16]


def _compiled(rules: list[tuple]) -> list[tuple]:
    out = []
    for kind, pattern, group, least, *context in rules:
        # A run of one class may as well be asked for its least length, which skips short runs sooner: the match is the
        # whole run either way, and a run that is too short holds no other match.
        if kind == "hex":
            pattern = f"[0-9a-f]{{{least},}}"
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else re.ASCII
        out.append((kind, re.compile(pattern, flags), group, least, context))
    return out


_KEYWORD = re.compile("|".join(KEYWORDS), re.IGNORECASE | re.ASCII)


def entropy(text: str) -> float:
    """Bits a character, from the characters' own shares."""
    return -sum(n / len(text) * log2(n / len(text)) for n in Counter(text).values())


def find_spans(text: str, rules: list[tuple]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all matches, by start, then kind as listed. ``rules`` come from ``_compiled``."""
    found = []
    lower = text.lower()
    keyed = any(w in lower for w in KEYWORDS)
    ends: list[int] | None = None
    for k, (kind, pattern, group, least, context) in enumerate(rules):
        if not keyed and (kind == "assign" or context):
            continue
        if context and ends is None:
            ends = [m.end() for m in _KEYWORD.finditer(text)]
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) < least:
                continue
            if context:
                bits, reach = context
                at = bisect_left(ends, m.start() - reach)
                if at == len(ends) or ends[at] > m.start() or entropy(m.group(group)) < bits:
                    continue
            found.append((m.start(), k, m.end()))
    return [(rules[k][0], start, end) for start, k, end in sorted(found)]


_SPANS = pa.list_(pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch], rules: dict[str, tuple]) -> Iterator[pa.RecordBatch]:
    """Apply to every text the rules whose versions it lacks."""
    compiled = dict(zip(rules, _compiled(list(rules.values())), strict=True))
    name = {c[0]: v for v, c in compiled.items()}
    for b in batches:
        spans = [[{"rule": name[k], "kind": k, "start": s, "end": e} for k, s, e in find_spans(t, [compiled[v] for v in lacks])]
                 for t, lacks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.record_batch([b.column(0), b.column(2), pa.array(spans, _SPANS)], names=["blob", "rules", "spans"])


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob) of every row; a null text has the blob of the empty text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)).alias("blob"))


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, rules: list[tuple] = RULES, id_col: str = "doc_id",
             text_col: str = "text", paths: DataFrame | None = None) -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs of ``docs`` and ``rules`` that ``ledger`` lacks (schema ``LEDGER``).

    ``paths`` may hold the result of :func:`versions` if it is at hand.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    named = {rule_version(r): r for r in rules}
    wanted = F.array(*[F.lit(v) for v in named]).cast("array<string>")
    blobs = (versions(docs, id_col, text_col) if paths is None else paths).groupBy("blob").agg(F.min("doc_id").alias("first_id"))
    if ledger is None:
        missing = blobs.withColumn("rules", wanted)
    else:
        # A blob has a row per scan that found something to do: as many as there have been rule versions, at most.
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        missing = blobs.join(seen, "blob", "left").select(
            "blob", "first_id", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules"))
    missing = stored(missing.where(F.size("rules") > 0), "ledger-missing")
    if missing.isEmpty():
        return spark.createDataFrame([], LEDGER)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")) \
        .withColumn("own_blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    # One row per new blob has the blob's smallest id. Rows that repeat that id give the same row again.
    new = texts.join(missing, (texts["own_blob"] == missing["blob"]) & texts["id"].eqNullSafe(missing["first_id"]))
    return new.select("blob", "text", "rules").mapInArrow(lambda b: _scan(b, named), LEDGER).dropDuplicates(["blob"])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``, which is made if it is not there."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def append_new(docs: DataFrame, path: str, rules: list[tuple] = RULES, id_col: str = "doc_id", text_col: str = "text",
               paths: DataFrame | None = None) -> None:
    """Scan what the ledger at ``path`` lacks and append it. The new rows are complete before any is appended."""
    new = stored(scan_new(docs, read_ledger(docs.sparkSession, path), rules, id_col, text_col, paths), "ledger-new")
    new.write.mode("append").parquet(path)


def findings(paths: DataFrame, ledger: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """Findings of every path: (doc_id, blob, spans) from a ledger that has all pairs of ``paths`` and ``rules``.

    Spans are sorted by start, then kind as listed; pairs that the ledger holds twice count once, rule versions that are not
    asked for do not count.
    """
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (rule_version(r), k)])
    mine = F.filter("spans", lambda s: s["rule"].isin(*[rule_version(r) for r in rules]))
    sortable = F.transform(mine, lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["rule"]).alias("place"),
                                                    s["end"].alias("end"), s["kind"].alias("kind")))
    each = ledger.select("blob", sortable.alias("spans")).groupBy("blob").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return paths.join(each, "blob")


def joined(spans, kinds: tuple | None = None):
    """Text of spans: kind:start:end, joined by commas."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, ledger: DataFrame | str | None = None, rules: list[tuple] = RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text counts as empty and has no spans; equal texts have equal findings, whatever their ids; repeated rows give
    repeated rows and a null id stays null. A ``ledger`` given by its path is read, if it is there, and the new rows are
    appended to it: a later scan takes only what it lacks. An empty table gives an empty result; other columns are ignored.
    """
    paths = stored(versions(docs, id_col, text_col), "ledger-paths")
    if isinstance(ledger, str):
        append_new(docs, ledger, rules, id_col, text_col, paths)
        full = read_ledger(docs.sparkSession, ledger)
    else:
        new = stored(scan_new(docs, ledger, rules, id_col, text_col, paths), "ledger-new")
        full = new if ledger is None else ledger.unionByName(new)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return findings(paths, full, rules).select(
        F.col("doc_id").alias(id_col), *[count(k) for k in BASE_KINDS],
        F.sha2(joined(F.col("spans"), BASE_KINDS).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
