"""Catalogue: scalar and text expressions (N1-N20), lookups (J1, J2) and sources."""
from __future__ import annotations

from pyspark.sql import functions as F

from tillage.catalog.common import (FEATURES, PLANTED, SPLIT_SQL, BOUNDS_SQL, crop_interval_bounds, planted_expr,
                                    r, split_view, sql_r, with_cte, yv)
from tillage.functions import scalars as N
from tillage.functions import target as TG
from tillage.functions import text as TX
from tillage.operators.features import standardizer_stats
from tillage.operators.joins import decode_labels, lookup_by_normalized_name
from tillage.sources.tables import read_table

# Short phrases in each offered language (our own text), appended to table texts so the
# script checks see every script. Order follows TX.LANGUAGE_CHOICES.
PHRASES = ["hello farmer, the field is ready", "नमस्ते किसान खेत तैयार है", "ನಮಸ್ಕಾರ ರೈತ ಹೊಲ ಸಿದ್ಧವಾಗಿದೆ",
           "నమస్కారం రైతు పొలం సిద్ధంగా ఉంది", "வணக்கம் விவசாயி வயல் தயார்", "നമസ്കാരം കർഷകാ വയൽ തയ്യാറാണ്"]
SCRIPTS = list(TX.SCRIPT_RANGES)


def _choice(idx_col):
    return F.element_at(F.array(*[F.lit(x) for x in TX.LANGUAGE_CHOICES]), (idx_col % 6 + 1).cast("int"))


def _phrase(idx_col):
    return F.element_at(F.array(*[F.lit(x) for x in PHRASES]), (idx_col % 6 + 1).cast("int"))


def _sql_list(items):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def n1(spark, sf):
    d = TG.winsorize(yv(spark, sf), "yield", 0.01, by=["crop"], out_col="yield_w")
    return d.select("row_key", "crop", r("yield_w").alias("yield_w"))


N1_SQL = with_cte("q AS (SELECT crop, quantile_cont(yield, 0.01) AS lo, quantile_cont(yield, 0.99) AS hi FROM yv GROUP BY crop)") + \
    "\nSELECT row_key, yv.crop, " + sql_r("least(greatest(yield, lo), hi)") + " AS yield_w FROM yv JOIN q ON yv.crop = q.crop"


def n2(spark, sf):
    return yv(spark, sf).select("row_key", r(TG.log_forward("price")).alias("log_price"))


N2_SQL = with_cte() + "\nSELECT row_key, " + sql_r("ln(1 + price)") + " AS log_price FROM yv"


def n3(spark, sf):
    return yv(spark, sf).select("row_key", r(TG.log_back(TG.log_forward("price"))).alias("price_back"))


N3_SQL = with_cte() + "\nSELECT row_key, " + sql_r("exp(ln(1 + price)) - 1") + " AS price_back FROM yv"


def n4(spark, sf):
    d = split_view(spark, sf).where(F.col("split") == "test")
    d = d.withColumn("y_log", TG.log_forward("yield")).withColumn("p_log", TG.log_forward(planted_expr()))
    s2 = TG.smearing_variance(d, "y_log", "p_log", by=["crop"])
    from tillage.operators.stats import attach_group_stats
    j = attach_group_stats(d, s2, ["crop"])
    return j.select("row_key", "crop", r("sigma2").alias("sigma2"),
                    r(TG.log_back_corrected("p_log", "sigma2")).alias("p_corrected"))


N4_SQL = with_cte(SPLIT_SQL, f"t AS (SELECT row_key, crop, ln(1 + yield) AS y_log, ln(1 + ({PLANTED})) AS p_log FROM ys WHERE split = 'test')",
                  "s AS (SELECT crop, var_pop(y_log - p_log) AS sigma2 FROM t GROUP BY crop)") + \
    "\nSELECT row_key, t.crop, " + sql_r("sigma2") + " AS sigma2, " + sql_r("exp(p_log + 0.5 * sigma2) - 1") + \
    " AS p_corrected FROM t JOIN s ON t.crop = s.crop"


def n5(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", "p_name", TX.normalize_key("p_name").alias("key"))


N5_SQL = "SELECT p_partkey, p_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part"


def n6(spark, sf):
    e = read_table(spark, sf, "events")
    raw = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.regexp_extract("props", "([0-9]+)", 1))
    return e.select("event_id", N.to_number_or_null(raw).alias("k_value"))


N6_SQL = """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a'
            ELSE regexp_extract(props, '([0-9]+)', 1) END AS DOUBLE) AS k_value FROM events"""


def n7(spark, sf):
    d = split_view(spark, sf)
    m = d.where(F.col("split") == "train").select(F.avg("l_tax")).scalar()
    return d.select("row_key", r(N.fill_with("l_tax", m)).alias("l_tax_filled"))


N7_SQL = with_cte(SPLIT_SQL, "m AS (SELECT avg(l_tax) AS m FROM ys WHERE split = 'train')") + \
    "\nSELECT row_key, " + sql_r("coalesce(l_tax, m)") + " AS l_tax_filled FROM ys, m"


def n8(spark, sf):
    d = split_view(spark, sf)
    st = standardizer_stats(d.where(F.col("split") == "train"), FEATURES)
    cols = []
    for c in FEATURES:
        one = st.where(F.col("feature") == c)
        cols.append(r(N.standardize(F.col(c), one.select("mean").scalar(), one.select("std").scalar())).alias(f"{c}_std"))
    return d.select("row_key", *cols)


def n8_sql():
    st = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) > 1e-8 "
                   f"THEN stddev_pop(CAST({c} AS DOUBLE)) ELSE 1.0 END AS s_{c}" for c in FEATURES)
    sel = ", ".join(sql_r(f"(CAST({c} AS DOUBLE) - m_{c}) / s_{c}") + f" AS {c}_std" for c in FEATURES)
    return with_cte(SPLIT_SQL, f"st AS (SELECT {st} FROM ys WHERE split = 'train')") + f"\nSELECT row_key, {sel} FROM ys, st"


def n9(spark, sf):
    return yv(spark, sf).select("row_key", N.round_half_even(F.col("l_quantity") / 16.0, 3).alias("q16"),
                                N.round_half_even(F.col("price") / 7.0, 4).alias("p7"))


N9_SQL = with_cte() + "\nSELECT row_key, round_even(l_quantity / 16.0, 3) AS q16, round_even(price / 7.0, 4) AS p7 FROM yv"

FACT_COLS = ["l_quantity", "l_discount", "p_size", "p_retailprice"]


def n10(spark, sf):
    return yv(spark, sf).select("row_key", TX.generic_fact_line(FACT_COLS, 2).alias("fact_line"))


FACT_SQL = " || ' ' || ".join(f"'{c}=' || printf('%.2f', CAST({c} AS DOUBLE))" for c in FACT_COLS)
N10_SQL = with_cte() + f"\nSELECT row_key, {FACT_SQL} AS fact_line FROM yv"


def n11(spark, sf):
    d = yv(spark, sf)
    return d.select("row_key", TX.recommendation_prompt("crop", TX.generic_fact_line(FACT_COLS, 2), "app").alias("prompt"))


def _prompt_tail_sql(variant="app"):
    t = TX.PROMPTS[variant]
    tail = t["user_tail"] + "".join(f"{h}\n- ...\n" for h in (t["sections"] or []))
    return "'" + tail.replace("'", "''") + "'"


N11_SQL = with_cte() + (f"\nSELECT row_key, 'Predicted crop: ' || crop || chr(10) || 'Profile: ' || {FACT_SQL} || chr(10) || "
                        f"{_prompt_tail_sql()} AS prompt FROM yv")


def n12(spark, sf):
    d = read_table(spark, sf, "documents")
    lang = TX.language_name(_choice(F.col("doc_id")))
    return d.select("doc_id", lang.alias("language"), TX.translate_prompt(F.col("text"), lang).alias("prompt"))


def _sql_language(expr):
    return ("CASE " + " ".join(f"WHEN starts_with({expr}, '{n}') THEN '{n}'" for n in
                               ["Hindi", "Kannada", "Telugu", "Tamil", "Malayalam"]) + " ELSE 'English' END")


SQL_CHOICE = f"list_extract({_sql_list(TX.LANGUAGE_CHOICES)}, CAST({{k}} % 6 + 1 AS INTEGER))"
SQL_PHRASE = f"list_extract({_sql_list(PHRASES)}, CAST({{k}} % 6 + 1 AS INTEGER))"

N12_SQL = (f"SELECT doc_id, {_sql_language(SQL_CHOICE.format(k='doc_id'))} AS language, "
           f"'Translate the following Markdown into ' || {_sql_language(SQL_CHOICE.format(k='doc_id'))} || "
           f"'.' || chr(10) || chr(10) || 'Do not add or remove content. Only translate.' || chr(10) || chr(10) || '---' || chr(10) "
           f"|| text || chr(10) || '---' AS prompt FROM documents")


def n13(spark, sf):
    c = read_table(spark, sf, "conversations")
    disp = _choice(F.col("conv_id") + F.col("turn"))
    return c.select("conv_id", "turn", disp.alias("display"), TX.language_name(disp).alias("language"))


N13_SQL = (f"SELECT conv_id, turn, {SQL_CHOICE.format(k='(conv_id + turn)')} AS display, "
           f"{_sql_language(SQL_CHOICE.format(k='(conv_id + turn)'))} AS language FROM conversations")


def n14(spark, sf):
    c = read_table(spark, sf, "conversations")
    lang = TX.language_name(_choice(F.col("conv_id") + F.col("turn")))
    return c.select("conv_id", "turn", lang.alias("language"), TX.language_script(lang).alias("script"),
                    TX.speech_code(lang).alias("speech_code"))


def _sql_map(d, expr, default):
    return "CASE " + " ".join(f"WHEN {expr} = '{k}' THEN '{v}'" for k, v in d.items()) + f" ELSE '{default}' END"


_L14 = _sql_language(SQL_CHOICE.format(k="(conv_id + turn)"))
N14_SQL = (f"SELECT conv_id, turn, {_L14} AS language, {_sql_map(TX.LANGUAGE_SCRIPT, _L14, 'Latin')} AS script, "
           f"{_sql_map(TX.SPEECH_CODE, _L14, 'en')} AS speech_code FROM conversations")


def n15(spark, sf):
    d = read_table(spark, sf, "documents")
    t = d.select("doc_id", F.concat_ws(" ", F.col("text"), _phrase(F.col("doc_id"))).alias("t"))
    cov = TX.with_script_coverages(t, "t", SCRIPTS)
    return cov.select("doc_id", *[r(f"cov_{s.lower()}").alias(f"cov_{s.lower()}") for s in SCRIPTS])


def n15_sql():
    t = f"concat_ws(' ', text, {SQL_PHRASE.format(k='doc_id')})"
    cols = ", ".join(sql_r(TX.sql_script_coverage(t, s)) + f" AS cov_{s.lower()}" for s in SCRIPTS)
    return f"SELECT doc_id, {cols} FROM documents"


def _translated(c):
    return F.when(F.col("turn") % 2 == 0, _phrase(F.col("conv_id") + F.col("turn"))).otherwise(
        F.concat_ws(" ", F.col("text"), _phrase(F.col("conv_id") + F.col("turn"))))


def n16(spark, sf):
    c = read_table(spark, sf, "conversations")
    lang = TX.language_name(_choice(F.col("conv_id") + F.col("turn")))
    t = _translated(c)
    return c.select("conv_id", "turn", lang.alias("language"),
                    r(TX.script_coverage(t, TX.language_script(lang))).alias("coverage"),
                    TX.is_in_language(t, lang).alias("in_language"))


def n16_sql():
    ph = SQL_PHRASE.format(k="(conv_id + turn)")
    t = f"(CASE WHEN turn % 2 = 0 THEN {ph} ELSE concat_ws(' ', text, {ph}) END)"
    lang = _sql_language(SQL_CHOICE.format(k="(conv_id + turn)"))
    script = _sql_map(TX.LANGUAGE_SCRIPT, lang, "Latin")
    cov = "CASE " + " ".join(f"WHEN {script} = '{s}' THEN {TX.sql_script_coverage(t, s)}" for s in SCRIPTS) + " ELSE 0.0 END"
    return (f"SELECT conv_id, turn, {lang} AS language, {sql_r(cov)} AS coverage, "
            f"CASE WHEN {lang} = 'English' THEN true ELSE ({cov}) >= 0.6 END AS in_language FROM conversations")


def _md(c):
    return F.concat(F.lit("### "), F.col("role"), F.lit("\n"), F.col("text"),
                    F.lit("\n\n\n\n- `tip` one\n```\ncode block\n```\n  * two\n\n"))


def n17(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", TX.strip_markdown(_md(c)).alias("plain"))


N17_SQL = ("SELECT conv_id, turn, " + TX.sql_strip_markdown(
    "('### ' || role || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || '- `tip` one' || chr(10) || "
    "'```' || chr(10) || 'code block' || chr(10) || '```' || chr(10) || '  * two' || chr(10) || chr(10))") +
    " AS plain FROM conversations")


def n18(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", N.slug("p_name").alias("slug"))


N18_SQL = "SELECT p_partkey, replace(p_name, ' ', '_') AS slug FROM part"


def n20(spark, sf):
    t = crop_interval_bounds(spark, sf)
    return t.select("row_key", r("p10").alias("p10"), r("p90").alias("p90"), "covered")


N20_SQL = with_cte(SPLIT_SQL, BOUNDS_SQL) + "\nSELECT row_key, " + sql_r("p10") + " AS p10, " + sql_r("p90") + " AS p90, covered FROM tb"


def _image_index(spark, sf):
    p = read_table(spark, sf, "part")
    path = F.concat(F.lit("img/"), F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit(".png"))
    return p.select(TX.normalize_key("p_name").alias("key"), path.alias("path")).groupBy("key").agg(
        F.min("path").alias("path"))


def j1(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = read_table(spark, sf, "part").select("p_partkey", "p_name")
    named = li.join(p, li.l_partkey == p.p_partkey).select(
        F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]).alias("row_key"),
        "p_name")
    return lookup_by_normalized_name(named, "p_name", _image_index(spark, sf), placeholder="(no image)")


J1_SQL = """WITH idx AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key,
                     min('img/' || p_brand || '/' || p_name || '.png') AS path FROM part GROUP BY 1)
SELECT concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                 CAST(l_linenumber AS VARCHAR)) AS row_key, p.p_name, coalesce(idx.path, '(no image)') AS image_path
FROM lineitem JOIN part p ON l_partkey = p.p_partkey
LEFT JOIN idx ON regexp_replace(lower(p.p_name), '[^a-z0-9]', '', 'g') = idx.key"""


def j2(spark, sf):
    d = yv(spark, sf)
    labels = d.where(F.col("crop").isNotNull()).select("crop").distinct().agg(F.sort_array(F.collect_list("crop")))
    arr = labels.scalar()
    idx = (F.array_position(arr, F.col("crop")) - 1).cast("int")
    return d.select("row_key", idx.alias("crop_index"), decode_labels(idx, arr).alias("decoded"))


J2_SQL = with_cte("lb AS (SELECT crop, CAST(row_number() OVER (ORDER BY crop) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT crop FROM yv WHERE crop IS NOT NULL))") + \
    "\nSELECT row_key, lb.i AS crop_index, lb.crop AS decoded FROM yv JOIN lb ON yv.crop = lb.crop"


def s1(spark, sf):
    from tillage.session import scratch_path
    from tillage.sources.csv_io import read_table_csv, write_table_csv
    path = write_table_csv(read_table(spark, sf, "customer"), scratch_path(spark, "customer-csv"))
    return read_table_csv(spark, path)


S1_SQL = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


def s3(spark, sf):
    from tillage.sources.params import run_metadata
    m = run_metadata(split_view(spark, sf), split="split", target_column="yield", group_column="crop",
                     numeric_cols=",".join(FEATURES), winsor=0.01, log_target=True)
    return m


S3_SQL = with_cte(SPLIT_SQL) + f"""
SELECT 'yield' AS target_column, 'crop' AS group_column, '{",".join(FEATURES)}' AS numeric_cols, CAST(0.01 AS DOUBLE) AS winsor,
       true AS log_target, count(*) AS n_rows, count(*) FILTER (WHERE split = 'train') AS n_train,
       count(*) FILTER (WHERE split = 'test') AS n_test FROM ys"""


def s4(spark, sf):
    from tillage.session import scratch_path
    from tillage.sources.params import SCALER_SCHEMA, read_json_param
    from tillage.operators.features import stats_as_param_map
    d = split_view(spark, sf).where(F.col("split") == "train")
    path = scratch_path(spark, "scaler-json")
    stats_as_param_map(standardizer_stats(d, FEATURES)).select(F.to_json("scaler").alias("v")) \
        .coalesce(1).write.mode("overwrite").text(path)
    m = read_json_param(spark, path, SCALER_SCHEMA)
    e = m.select(F.explode("value").alias("feature", "s"))
    return e.select("feature", r("s.mean").alias("mean"), r("s.std").alias("std"))


def s4_sql():
    parts = [f"SELECT '{c}' AS feature, {sql_r(f'avg(CAST({c} AS DOUBLE))')} AS mean, "
             f"{sql_r(f'CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) > 1e-8 THEN stddev_pop(CAST({c} AS DOUBLE)) ELSE 1.0 END')} AS std "
             f"FROM ys WHERE split = 'train'" for c in FEATURES]
    return with_cte(SPLIT_SQL) + "\n" + "\nUNION ALL\n".join(parts)


def s8(spark, sf):
    from tillage.session import scratch_path
    from tillage.sources.files import write_partitioned_by_group
    path = write_partitioned_by_group(yv(spark, sf).select("crop", "price"), "crop", scratch_path(spark, "by-crop"))
    back = spark.read.parquet(path)
    return back.groupBy("group_slug").agg(F.count(F.lit(1)).alias("n_rows"), r(F.sum("price")).alias("sum_price"))


S8_SQL = with_cte() + "\nSELECT replace(crop, ' ', '_') AS group_slug, count(*) AS n_rows, " + sql_r("sum(price)") + \
    " AS sum_price FROM yv GROUP BY 1"


QUERIES = {
    "n1_winsorize": (n1, N1_SQL),
    "n2_log_forward": (n2, N2_SQL),
    "n3_log_back": (n3, N3_SQL),
    "n4_log_back_corrected": (n4, N4_SQL),
    "n5_normalize_key": (n5, N5_SQL),
    "n6_to_number_or_null": (n6, N6_SQL),
    "n7_fill_with_mean": (n7, N7_SQL),
    "n8_standardize": (n8, n8_sql()),
    "n9_round_half_even": (n9, N9_SQL),
    "n10_fact_line": (n10, N10_SQL),
    "n11_recommendation_prompt": (n11, N11_SQL),
    "n12_translate_prompt": (n12, N12_SQL),
    "n13_language_name": (n13, N13_SQL),
    "n14_language_maps": (n14, N14_SQL),
    "n15_script_coverage": (n15, n15_sql()),
    "n16_is_in_language": (n16, n16_sql()),
    "n17_strip_markdown": (n17, N17_SQL),
    "n18_slug": (n18, N18_SQL),
    "n20_interval_covered": (n20, N20_SQL),
    "j1_lookup_by_normalized_name": (j1, J1_SQL),
    "j2_decode_labels": (j2, J2_SQL),
    "s1_read_csv": (s1, S1_SQL),
    "s3_run_metadata": (s3, S3_SQL),
    "s4_read_json_params": (s4, s4_sql()),
    "s8_write_partitioned_by_group": (s8, S8_SQL),
}
