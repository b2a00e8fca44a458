"""Catalogue: profiling (A1-A10) and schema/filter (P3, P9, P10) queries on the yield view."""
from __future__ import annotations

from pyspark.sql import functions as F

from tillage.catalog.common import r, sql_r, with_cte, yv
from tillage.operators import profile as P
from tillage.operators import schema as S
from tillage.operators.lowess import lowess_curve
from tillage.session import written

DESCRIBE_COLS = ["crop", "year", "region", "region_nk", "price", "l_quantity", "l_discount", "l_tax", "p_size",
                 "p_retailprice", "l_returnflag", "o_orderpriority", "yield"]
NUMERIC_IN_VIEW = ["year", "price", "l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", "yield"]
TEXT_IN_VIEW = ["crop", "region", "region_nk", "l_returnflag", "o_orderpriority"]
CORR_COLS = ["year", "price", "l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", "yield"]
LOWESS_X = ["l_quantity", "l_discount", "p_size", "p_retailprice"]


def a1(spark, sf):
    # Counts, brackets, quantiles and texts read the rows in turn: the view is written once.
    d = P.describe_all(written(yv(spark, sf).select(*DESCRIBE_COLS), "describe-rows"), DESCRIBE_COLS)
    return d.select("position", "column", "count", "unique", "top", "freq",
                    *[r(c).alias(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


def a1_sql():
    parts = []
    for i, c in enumerate(DESCRIBE_COLS):
        if c in NUMERIC_IN_VIEW:
            v = f"CAST({c} AS DOUBLE)"
            parts.append(
                f"SELECT {i} AS position, '{c}' AS column, count({c}) AS count, CAST(NULL AS BIGINT) AS unique, "
                f"CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, {sql_r(f'avg({v})')} AS mean, "
                f"{sql_r(f'stddev_samp({v})')} AS std, {sql_r(f'min({v})')} AS min, "
                f"{sql_r(f'quantile_cont({v}, 0.25)')} AS q25, {sql_r(f'quantile_cont({v}, 0.5)')} AS q50, "
                f"{sql_r(f'quantile_cont({v}, 0.75)')} AS q75, {sql_r(f'max({v})')} AS max FROM yv")
        else:
            top = (f"(SELECT {c} FROM yv WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")
            freq = (f"(SELECT count(*) FROM yv WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")
            nd = "CAST(NULL AS DOUBLE)"
            parts.append(
                f"SELECT {i} AS position, '{c}' AS column, count({c}) AS count, count(DISTINCT {c}) AS unique, "
                f"{top} AS top, {freq} AS freq, {nd} AS mean, {nd} AS std, {nd} AS min, {nd} AS q25, "
                f"{nd} AS q50, {nd} AS q75, {nd} AS max FROM yv")
    return with_cte() + "\n" + "\nUNION ALL\n".join(parts)


def a2(spark, sf):
    d = P.missing_values(yv(spark, sf), DESCRIBE_COLS)
    return d.select("position", "column", "missing_count", r("missing_pct").alias("missing_pct"))


def a2_sql():
    parts = [f"SELECT {i} AS position, '{c}' AS column, count(*) - count({c}) AS missing_count, "
             f"{sql_r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct FROM yv"
             for i, c in enumerate(DESCRIBE_COLS)]
    return with_cte() + "\n" + "\nUNION ALL\n".join(parts)


def a3(spark, sf):
    return P.value_counts(yv(spark, sf), "crop")


A3_SQL = with_cte() + "\nSELECT crop AS value, count(*) AS count FROM yv WHERE crop IS NOT NULL GROUP BY crop"


def a4(spark, sf):
    h = P.histogram(yv(spark, sf), "price", by=["crop"], bins=20)
    return h.select("crop", "bin", r("bin_lo").alias("bin_lo"), r("bin_hi").alias("bin_hi"), "count")


A4_SQL = with_cte("""st AS (SELECT crop, CASE WHEN min(price) = max(price) THEN min(price) - 0.5 ELSE min(price) END AS lo,
                      CASE WHEN min(price) = max(price) THEN max(price) + 0.5 ELSE max(price) END AS hi
               FROM yv WHERE price IS NOT NULL GROUP BY crop)""",
                  """bc AS (SELECT yv.crop, CAST(least(floor((price - lo) * 20 / (hi - lo)), 19) AS INTEGER) AS bin,
                      count(*) AS n FROM yv JOIN st ON yv.crop = st.crop WHERE price IS NOT NULL GROUP BY 1, 2)""") + """
SELECT st.crop, CAST(g.bin AS INTEGER) AS bin, (CASE WHEN CAST(lo + g.bin * ((hi - lo) / 20) AS DOUBLE) = 0 OR CAST(lo + g.bin * ((hi - lo) / 20) AS DOUBLE) IS NULL THEN CAST(lo + g.bin * ((hi - lo) / 20) AS DOUBLE) ELSE (round(CAST(lo + g.bin * ((hi - lo) / 20) AS DOUBLE) * pow(2.0, 32 - floor(log2(abs(CAST(lo + g.bin * ((hi - lo) / 20) AS DOUBLE))))) + 0.3183098861837907)) / pow(2.0, 32 - floor(log2(abs(CAST(lo + g.bin * ((hi - lo) / 20) AS DOUBLE))))) END) AS bin_lo,
       (CASE WHEN CAST(lo + (g.bin + 1) * ((hi - lo) / 20) AS DOUBLE) = 0 OR CAST(lo + (g.bin + 1) * ((hi - lo) / 20) AS DOUBLE) IS NULL THEN CAST(lo + (g.bin + 1) * ((hi - lo) / 20) AS DOUBLE) ELSE (round(CAST(lo + (g.bin + 1) * ((hi - lo) / 20) AS DOUBLE) * pow(2.0, 32 - floor(log2(abs(CAST(lo + (g.bin + 1) * ((hi - lo) / 20) AS DOUBLE))))) + 0.3183098861837907)) / pow(2.0, 32 - floor(log2(abs(CAST(lo + (g.bin + 1) * ((hi - lo) / 20) AS DOUBLE))))) END) AS bin_hi, CAST(coalesce(bc.n, 0) AS BIGINT) AS count
FROM st CROSS JOIN (SELECT range AS bin FROM range(0, 20)) g
LEFT JOIN bc ON bc.crop = st.crop AND bc.bin = g.bin"""


def a5(spark, sf):
    k = P.kde_curve(yv(spark, sf), "price", by=["crop"], grid=200, bins=20)
    return k.select("crop", "i", r("x").alias("x"), r("density").alias("density"), r("kde_count").alias("kde_count"))


A5_SQL = with_cte("""st AS (SELECT crop, count(*) AS n, stddev_samp(price) AS sd, min(price) AS mn, max(price) AS mx,
                      stddev_samp(price) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h
               FROM yv WHERE price IS NOT NULL GROUP BY crop)""",
                  """w AS (SELECT crop, price AS v, count(*) AS w FROM yv WHERE price IS NOT NULL GROUP BY 1, 2)""",
                  """g AS (SELECT st.*, gi.i, mn + gi.i * (mx - mn) / 199 AS x FROM st
                      CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(0, 200)) gi WHERE h > 0)""",
                  """k AS (SELECT g.crop, g.i, g.x, g.n, g.h, g.mn, g.mx,
                      sum(w.w * exp(-0.5 * ((g.x - w.v) / g.h) * ((g.x - w.v) / g.h))) AS s
               FROM g JOIN w ON g.crop = w.crop GROUP BY ALL)""") + """
SELECT crop, i, (CASE WHEN CAST(x AS DOUBLE) = 0 OR CAST(x AS DOUBLE) IS NULL THEN CAST(x AS DOUBLE) ELSE (round(CAST(x AS DOUBLE) * pow(2.0, 32 - floor(log2(abs(CAST(x AS DOUBLE))))) + 0.3183098861837907)) / pow(2.0, 32 - floor(log2(abs(CAST(x AS DOUBLE))))) END) AS x, (CASE WHEN CAST(s / (n * h * sqrt(2 * pi())) AS DOUBLE) = 0 OR CAST(s / (n * h * sqrt(2 * pi())) AS DOUBLE) IS NULL THEN CAST(s / (n * h * sqrt(2 * pi())) AS DOUBLE) ELSE (round(CAST(s / (n * h * sqrt(2 * pi())) AS DOUBLE) * pow(2.0, 32 - floor(log2(abs(CAST(s / (n * h * sqrt(2 * pi())) AS DOUBLE))))) + 0.3183098861837907)) / pow(2.0, 32 - floor(log2(abs(CAST(s / (n * h * sqrt(2 * pi())) AS DOUBLE))))) END) AS density,
       (CASE WHEN CAST(s / (n * h * sqrt(2 * pi())) * n * (mx - mn) / 20 AS DOUBLE) = 0 OR CAST(s / (n * h * sqrt(2 * pi())) * n * (mx - mn) / 20 AS DOUBLE) IS NULL THEN CAST(s / (n * h * sqrt(2 * pi())) * n * (mx - mn) / 20 AS DOUBLE) ELSE (round(CAST(s / (n * h * sqrt(2 * pi())) * n * (mx - mn) / 20 AS DOUBLE) * pow(2.0, 32 - floor(log2(abs(CAST(s / (n * h * sqrt(2 * pi())) * n * (mx - mn) / 20 AS DOUBLE))))) + 0.3183098861837907)) / pow(2.0, 32 - floor(log2(abs(CAST(s / (n * h * sqrt(2 * pi())) * n * (mx - mn) / 20 AS DOUBLE))))) END) AS kde_count FROM k"""


BOX_COLS = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence", "whisker_low", "whisker_high"]


def a6(spark, sf):
    b = P.box_stats(yv(spark, sf), "price", by=["crop"])
    return b.select("crop", "n", *[r(c).alias(c) for c in BOX_COLS], "n_outliers",
                    r("outlier_share").alias("outlier_share"))


FENCE_SQL = """fq AS (SELECT crop, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
                      quantile_cont(price, 0.75) AS q3 FROM yv WHERE price IS NOT NULL GROUP BY crop)""", \
            """fe AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM fq)"""

A6_SQL = with_cte(*FENCE_SQL) + """
SELECT fe.crop, count(*) AS n, """ + ", ".join(
    f"(CASE WHEN CAST(any_value(fe.{c}) AS DOUBLE) = 0 OR CAST(any_value(fe.{c}) AS DOUBLE) IS NULL THEN CAST(any_value(fe.{c}) AS DOUBLE) ELSE (round(CAST(any_value(fe.{c}) AS DOUBLE) * pow(2.0, 32 - floor(log2(abs(CAST(any_value(fe.{c}) AS DOUBLE))))) + 0.3183098861837907)) / pow(2.0, 32 - floor(log2(abs(CAST(any_value(fe.{c}) AS DOUBLE))))) END) AS {c}" for c in BOX_COLS[:6]) + """,
       (CASE WHEN CAST(min(CASE WHEN price BETWEEN lower_fence AND upper_fence THEN price END) AS DOUBLE) = 0 OR CAST(min(CASE WHEN price BETWEEN lower_fence AND upper_fence THEN price END) AS DOUBLE) IS NULL THEN CAST(min(CASE WHEN price BETWEEN lower_fence AND upper_fence THEN price END) AS DOUBLE) ELSE (round(CAST(min(CASE WHEN price BETWEEN lower_fence AND upper_fence THEN price END) AS DOUBLE) * pow(2.0, 32 - floor(log2(abs(CAST(min(CASE WHEN price BETWEEN lower_fence AND upper_fence THEN price END) AS DOUBLE))))) + 0.3183098861837907)) / pow(2.0, 32 - floor(log2(abs(CAST(min(CASE WHEN price BETWEEN lower_fence AND upper_fence THEN price END) AS DOUBLE))))) END) AS whisker_low,
       (CASE WHEN CAST(max(CASE WHEN price BETWEEN lower_fence AND upper_fence THEN price END) AS DOUBLE) = 0 OR CAST(max(CASE WHEN price BETWEEN lower_fence AND upper_fence THEN price END) AS DOUBLE) IS NULL THEN CAST(max(CASE WHEN price BETWEEN lower_fence AND upper_fence THEN price END) AS DOUBLE) ELSE (round(CAST(max(CASE WHEN price BETWEEN lower_fence AND upper_fence THEN price END) AS DOUBLE) * pow(2.0, 32 - floor(log2(abs(CAST(max(CASE WHEN price BETWEEN lower_fence AND upper_fence THEN price END) AS DOUBLE))))) + 0.3183098861837907)) / pow(2.0, 32 - floor(log2(abs(CAST(max(CASE WHEN price BETWEEN lower_fence AND upper_fence THEN price END) AS DOUBLE))))) END) AS whisker_high,
       count(*) FILTER (WHERE NOT (price BETWEEN lower_fence AND upper_fence)) AS n_outliers,
       (CASE WHEN CAST(count(*) FILTER (WHERE NOT (price BETWEEN lower_fence AND upper_fence)) / count(*) AS DOUBLE) = 0 OR CAST(count(*) FILTER (WHERE NOT (price BETWEEN lower_fence AND upper_fence)) / count(*) AS DOUBLE) IS NULL THEN CAST(count(*) FILTER (WHERE NOT (price BETWEEN lower_fence AND upper_fence)) / count(*) AS DOUBLE) ELSE (round(CAST(count(*) FILTER (WHERE NOT (price BETWEEN lower_fence AND upper_fence)) / count(*) AS DOUBLE) * pow(2.0, 32 - floor(log2(abs(CAST(count(*) FILTER (WHERE NOT (price BETWEEN lower_fence AND upper_fence)) / count(*) AS DOUBLE))))) + 0.3183098861837907)) / pow(2.0, 32 - floor(log2(abs(CAST(count(*) FILTER (WHERE NOT (price BETWEEN lower_fence AND upper_fence)) / count(*) AS DOUBLE))))) END) AS outlier_share
FROM yv JOIN fe ON yv.crop = fe.crop WHERE price IS NOT NULL GROUP BY fe.crop"""


def a7(spark, sf):
    from tillage.sources.tables import read_table
    o = P.outliers_iqr(read_table(spark, sf, "events"), "value", by=["event_type"], keep=["event_id"])
    return o.select("event_id", "event_type", r("value").alias("value"), r("lower_fence").alias("lower_fence"),
                    r("upper_fence").alias("upper_fence"), "side")


A7_SQL = """WITH fq AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
            FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type),
fe AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM fq)
SELECT event_id, events.event_type, """ + sql_r("value") + """ AS value, """ + sql_r("lower_fence") + """ AS lower_fence,
       """ + sql_r("upper_fence") + """ AS upper_fence, CASE WHEN value < lower_fence THEN 'low' ELSE 'high' END AS side
FROM events JOIN fe ON events.event_type = fe.event_type WHERE value < lower_fence OR value > upper_fence"""


def a8(spark, sf):
    c = P.correlation_matrix(yv(spark, sf), CORR_COLS)
    return c.select("col_a", "col_b", r("corr").alias("corr"))


def a8_sql():
    parts = []
    for i, a in enumerate(CORR_COLS):
        for j, b in enumerate(CORR_COLS):
            x = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
            y = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
            den = f"(stddev_pop({x}) * stddev_pop({y}))"
            if a == b:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN {den} > 0 THEN 1.0 END AS corr FROM yv")
                continue
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                         f"(CASE WHEN CAST(CASE WHEN {den} > 0 THEN covar_pop({x}, {y}) / {den} END AS DOUBLE) = 0 OR CAST(CASE WHEN {den} > 0 THEN covar_pop({x}, {y}) / {den} END AS DOUBLE) IS NULL THEN CAST(CASE WHEN {den} > 0 THEN covar_pop({x}, {y}) / {den} END AS DOUBLE) ELSE (round(CAST(CASE WHEN {den} > 0 THEN covar_pop({x}, {y}) / {den} END AS DOUBLE) * pow(2.0, 32 - floor(log2(abs(CAST(CASE WHEN {den} > 0 THEN covar_pop({x}, {y}) / {den} END AS DOUBLE))))) + 0.3183098861837907)) / pow(2.0, 32 - floor(log2(abs(CAST(CASE WHEN {den} > 0 THEN covar_pop({x}, {y}) / {den} END AS DOUBLE))))) END) AS corr FROM yv")
    return with_cte() + "\n" + "\nUNION ALL\n".join(parts)


LOWESS_GRID = 50


def a9(spark, sf):
    f = lowess_curve(yv(spark, sf), LOWESS_X, "yield", grid=LOWESS_GRID)
    return f.select("feature", "i", r("x").alias("x"), r("fit").alias("fit"))


def a9_sql():
    """Three robust passes, each from the curve of the pass before."""
    g = LOWESS_GRID
    ctes = [
        "lg AS MATERIALIZED (" + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, yield AS y FROM yv "
            f"WHERE {c} IS NOT NULL AND yield IS NOT NULL" for c in LOWESS_X) + ")",
        "rg AS (SELECT feature, min(x) AS mn, max(x) AS mx FROM lg GROUP BY feature)",
        f"""gp AS MATERIALIZED (SELECT lg.feature, lg.x, gi.i, any_value(rg.mn + gi.i * ((rg.mx - rg.mn) / {g - 1})) AS g, count(*) AS c
                 FROM lg JOIN rg ON lg.feature = rg.feature
                 CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(0, {g})) gi GROUP BY ALL)""",
        f"""bw AS MATERIALIZED (SELECT lg.feature, gi.i, quantile_cont(abs(x - (rg.mn + gi.i * ((rg.mx - rg.mn) / {g - 1}))), 2.0 / 3.0) AS h
                 FROM lg JOIN rg ON lg.feature = rg.feature
                 CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(0, {g})) gi GROUP BY ALL)""",
        "r0 AS (SELECT feature, x, y, 1.0 AS w FROM lg)"]
    for k in range(4):
        ctes += [
            f"b{k} AS MATERIALIZED (SELECT feature, x, sum(w) AS b, sum(w * y) AS byy FROM r{k} GROUP BY ALL)",
            f"""w{k} AS (SELECT gp.feature, gp.i, gp.g, gp.x, b.b, b.byy, CASE WHEN bw.h > 0 THEN
                  CASE WHEN abs(gp.x - gp.g) / bw.h < 1 THEN pow(1 - pow(abs(gp.x - gp.g) / bw.h, 3), 3) ELSE 0.0 END
                  WHEN gp.x = gp.g THEN 1.0 ELSE 0.0 END AS w
                  FROM gp JOIN bw ON gp.feature = bw.feature AND gp.i = bw.i JOIN b{k} b ON b.feature = gp.feature AND b.x = gp.x)""",
            f"""s{k} AS (SELECT feature, i, any_value(g) AS g, sum(w * b) AS s0, sum(w * x * b) AS sx, sum(w * byy) AS sy,
                  sum(w * x * x * b) AS sxx, sum(w * x * byy) AS sxy FROM w{k} GROUP BY feature, i)""",
            f"""f{k} AS MATERIALIZED (SELECT feature, i, g, CASE WHEN s0 > 0 THEN (sy - sl * sx) / s0 + sl * g END AS fit FROM
                  (SELECT *, CASE WHEN s0 * sxx - sx * sx <> 0 THEN (s0 * sxy - sx * sy) / (s0 * sxx - sx * sx) ELSE 0.0 END AS sl FROM s{k}))"""]
        if k < 3:
            ctes += [
                f"""e{k} AS MATERIALIZED (SELECT q.feature, q.x, q.y, q.y - (a.fit + (z.fit - a.fit) * (q.pos - q.j)) AS res FROM
                  (SELECT *, CAST(least(floor(pos), {g - 2}) AS INTEGER) AS j FROM (SELECT lg.*,
                   CASE WHEN mx > mn THEN (x - mn) / ((mx - mn) / {g - 1}) ELSE 0.0 END AS pos FROM lg JOIN rg ON lg.feature = rg.feature)) q
                  JOIN f{k} a ON a.feature = q.feature AND a.i = q.j JOIN f{k} z ON z.feature = q.feature AND z.i = q.j + 1)""",
                f"m{k} AS (SELECT feature, quantile_cont(abs(res), 0.5) AS s FROM e{k} GROUP BY feature)",
                f"""r{k + 1} AS (SELECT e.feature, e.x, e.y, CASE WHEN m.s <= 0 THEN 1.0 WHEN abs(e.res / (6.0 * m.s)) < 1
                  THEN pow(1 - (e.res / (6.0 * m.s)) * (e.res / (6.0 * m.s)), 2) ELSE 0.0 END AS w
                  FROM e{k} e JOIN m{k} m ON e.feature = m.feature)"""]
    return with_cte(*ctes) + f"\nSELECT feature, i, {sql_r('g')} AS x, {sql_r('fit')} AS fit FROM f3"


def a10(spark, sf):
    s = P.scatter_points(yv(spark, sf), LOWESS_X, "yield", group="crop", keep=["row_key"])
    return s.select("row_key", "crop", "feature", r("x").alias("x"), r("y").alias("y"))


A10_SQL = with_cte() + "\n" + "\nUNION ALL\n".join(
    f"SELECT row_key, crop, '{c}' AS feature, (CASE WHEN CAST(CAST({c} AS DOUBLE) AS DOUBLE) = 0 OR CAST(CAST({c} AS DOUBLE) AS DOUBLE) IS NULL THEN CAST(CAST({c} AS DOUBLE) AS DOUBLE) ELSE (round(CAST(CAST({c} AS DOUBLE) AS DOUBLE) * pow(2.0, 32 - floor(log2(abs(CAST(CAST({c} AS DOUBLE) AS DOUBLE))))) + 0.3183098861837907)) / pow(2.0, 32 - floor(log2(abs(CAST(CAST({c} AS DOUBLE) AS DOUBLE))))) END) AS x, (CASE WHEN CAST(yield AS DOUBLE) = 0 OR CAST(yield AS DOUBLE) IS NULL THEN CAST(yield AS DOUBLE) ELSE (round(CAST(yield AS DOUBLE) * pow(2.0, 32 - floor(log2(abs(CAST(yield AS DOUBLE))))) + 0.3183098861837907)) / pow(2.0, 32 - floor(log2(abs(CAST(yield AS DOUBLE))))) END) AS y FROM yv"
    for c in LOWESS_X)


def p3(spark, sf):
    d = yv(spark, sf).drop("row_key")
    return S.year_candidates(d).select("position", "column", "n_nonnull", r("share_yearlike").alias("share_yearlike"),
                                       "is_candidate")


def p3_sql():
    cols = ["year", "price", "l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", "yield"]
    parts = [f"SELECT {i} AS position, '{c}' AS column, count({c}) AS n_nonnull, "
             f"{sql_r(f'avg(CAST(CAST({c} AS DOUBLE) BETWEEN 1990 AND 2035 AS DOUBLE))')} AS share_yearlike, "
             f"count({c}) >= greatest(5, floor(0.2 * count(*))) AND coalesce(avg(CAST(CAST({c} AS DOUBLE) BETWEEN 1990 AND 2035 AS DOUBLE)), 0) > 0.5 AS is_candidate "
             f"FROM yv" for i, c in enumerate(cols)]
    return with_cte() + "\n" + "\nUNION ALL\n".join(parts)


def p9(spark, sf):
    return S.filter_group(yv(spark, sf), "crop", "LARGE").select("row_key", "crop", r("price").alias("price"))


P9_SQL = with_cte() + "\nSELECT row_key, crop, (CASE WHEN CAST(price AS DOUBLE) = 0 OR CAST(price AS DOUBLE) IS NULL THEN CAST(price AS DOUBLE) ELSE (round(CAST(price AS DOUBLE) * pow(2.0, 32 - floor(log2(abs(CAST(price AS DOUBLE))))) + 0.3183098861837907)) / pow(2.0, 32 - floor(log2(abs(CAST(price AS DOUBLE))))) END) AS price FROM yv WHERE crop = 'LARGE'"


def p10(spark, sf):
    d = yv(spark, sf).withColumn("cell", F.concat_ws("/", "crop", F.col("year").cast("string"), "region"))
    return S.filter_min_rows(d, "cell", min_rows=300)


P10_SQL = with_cte() + """
SELECT cell, count(*) AS n_rows, CASE WHEN count(*) < 300 THEN 'skipped (too few rows)' ELSE 'modelled' END AS status
FROM (SELECT concat_ws('/', crop, CAST(year AS VARCHAR), region) AS cell FROM yv) WHERE cell IS NOT NULL GROUP BY cell"""


QUERIES = {
    "a1_describe_all": (a1, a1_sql()),
    "a2_missing_values": (a2, a2_sql()),
    "a3_value_counts": (a3, A3_SQL),
    "a4_histogram": (a4, A4_SQL),
    "a5_kde_curve": (a5, A5_SQL),
    "a6_box_stats": (a6, A6_SQL),
    "a7_outliers_iqr": (a7, A7_SQL),
    "a8_correlation_matrix": (a8, a8_sql()),
    "a9_lowess_curve": (a9, a9_sql()),
    "a10_scatter_points": (a10, A10_SQL),
    "p3_year_candidates": (p3, p3_sql()),
    "p9_filter_group": (p9, P9_SQL),
    "p10_filter_min_rows": (p10, P10_SQL),
}
