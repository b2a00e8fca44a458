"""CSV in and out with pandas-like missing-value handling and type inference."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions.scalars import to_number_or_null

# The text markers pandas reads as missing by default.
NA_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
              "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_table_csv(spark: SparkSession, path: str, schema: str | None = None,
                   na_markers=NA_MARKERS, multi_line: bool = True) -> DataFrame:
    """Header CSV; every missing marker becomes null; types inferred per column
    (long if every present value is an integer, double if numeric, else text), or taken
    from ``schema`` with unparsable values → null. Inference is one aggregation.

    A quote inside quoted text is doubled, and quoted text may hold line breaks; ``multi_line=False`` lets
    Spark split large files that are known to hold none."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("multiLine", multi_line).csv(path)
    markers = F.array(*[F.lit(m) for m in na_markers])
    clean = raw.select(*[F.when(F.array_contains(markers, F.trim(F.col(c))) | F.col(c).isNull(),
                                F.lit(None).cast("string")).otherwise(F.col(c)).alias(c) for c in raw.columns])
    if schema:
        from pyspark.sql.types import _parse_datatype_string
        st = _parse_datatype_string(schema)
        return clean.select(*[F.col(f.name).try_cast(f.dataType.simpleString()).alias(f.name) for f in st.fields])
    aggs = []
    for i, c in enumerate(clean.columns):
        aggs += [F.count(F.col(c)).alias(f"n{i}"),
                 F.count(to_number_or_null(F.trim(F.col(c)), nan_is_null=False)).alias(f"d{i}"),
                 F.count(F.trim(F.col(c)).try_cast("long")).alias(f"l{i}")]
    r = clean.agg(*aggs).first() if clean.columns else None
    out = []
    for i, c in enumerate(clean.columns):
        n, d, l = r[f"n{i}"], r[f"d{i}"], r[f"l{i}"]
        if n > 0 and l == n:
            out.append(F.trim(F.col(c)).try_cast("long").alias(c))
        elif n > 0 and d == n:
            out.append(F.nanvl(F.trim(F.col(c)).try_cast("double"), F.lit(None).cast("double")).alias(c))
        else:
            out.append(F.col(c))
    return clean.select(*out)


def write_table_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> str:
    """Header CSV folder. ``single_file`` is for small reports only (one task writes)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path
