"""Operator 11: fill-in-the-middle with a counted-quantifier regular expression.

A text is a run of n units: optional white space followed by other characters, or the white space at its end.
``regexp_count`` gives n. Two numbers drawn from the hash of seed and id cut the units into prefix, middle and suffix,
and a pattern made for the row, ``\\A((?:unit){a}+)((?:unit){b-a}+)(.*+)\\z``, captures the three parts in one match; the same
call puts them into the order of the row's form. The counted groups are possessive, so the matcher walks through a
text of any length in a loop, without a stack frame per unit and without ever going back.

Scale: one pass, one projection, no shuffle; nothing leaves the JVM.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm.shared import text_or_empty

UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
MARKS = r"<[PSM]>"
SEED, RATE, SPM_RATE = 42, 50, 80


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits (from 0) as an unsigned number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
                   spm_rate: int = SPM_RATE) -> DataFrame:
    """One row per row of ``docs``: id, ``n`` units, ``form`` (plain, psm or spm), ``output``, ``prefix``, ``middle``, ``suffix``.

    ``rate`` percent of the texts are cut, ``spm_rate`` percent of these suffix first. The three parts are those that
    a reader finds in ``output``; they are null for plain rows, whose output is the text. A null text counts as empty; an
    empty text and one that contains a mark stay plain. A null id is drawn like an empty one, and rows that repeat an id are cut at
    places drawn from the same numbers. An empty table gives an empty result; other columns are ignored.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    d = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), digest.alias("digest")).withColumn(
        "n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    first, second = _draw(F.col("digest"), 0) % (F.col("n") + 1), _draw(F.col("digest"), 1) % (F.col("n") + 1)
    plain = (F.col("text") == "") | F.col("text").rlike(MARKS) | (_draw(F.col("digest"), 2) % 100 >= rate)
    d = d.select("id", "text", "n", F.least(first, second).alias("a"), F.greatest(first, second).alias("b"),
                 F.when(plain, "plain").when(_draw(F.col("digest"), 3) % 100 < spm_rate, "spm").otherwise("psm").alias("form"))
    pattern = F.concat(F.lit(rf"(?s)\A((?:{UNIT}){{"), F.col("a"), F.lit(rf"}}+)((?:{UNIT}){{"), F.col("b") - F.col("a"),
                       F.lit(r"}+)(.*+)\z"))
    order = F.when(F.col("form") == "psm", "<P>$1<S>$3<M>$2").otherwise("<S>$3<P>$1<M>$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    d = d.select("id", "n", "form", output.alias("output"))
    # The text holds no mark, so the output splits into exactly: "", first part, second part, middle.
    parts = F.when(F.col("form") != "plain", F.split("output", MARKS, -1))
    d = d.select("*", parts.alias("parts"))
    psm = F.col("form") == "psm"
    return d.select(F.col("id").alias(id_col), "n", "form", "output",
                    F.when(psm, F.col("parts")[1]).otherwise(F.col("parts")[2]).alias("prefix"), F.col("parts")[3].alias("middle"),
                    F.when(psm, F.col("parts")[2]).otherwise(F.col("parts")[1]).alias("suffix"))


def restored() -> Column:
    """The text that an output row of fill_in_middle was made from."""
    return F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat("prefix", "middle", "suffix"))


def infilling_digests(docs: DataFrame) -> DataFrame:
    """Lengths and hashes of fill_in_middle over the documents table."""
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


# The same rules in DuckDB, with lists of units in place of the per-row pattern.
INFILLING_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
u AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
    CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o"""
