"""Edge cases that once went wrong."""
from pyspark.sql import functions as F

from tillage.functions.scalars import to_number_or_null
from tillage.functions.target import winsorize
from tillage.operators.features import preprocessing_stages
from tillage.operators.folds import hash_split
from tillage.plans.generate import translate_with_retry
from tillage.session import scratch_path
from tillage.sources.csv_io import read_table_csv, write_table_csv


def test_csv_keeps_quoted_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, 'say "hi", ok'), (-2, 'two\nlines, "quoted"'), (-3, "10d")], "doc_id long, text string")
    path = write_table_csv(docs.unionByName(odd), scratch_path(spark, "csv"))
    back = read_table_csv(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.unionByName(odd).collect()))


def test_numbers_have_no_type_suffix(spark):
    df = spark.createDataFrame([(s,) for s in ("10d", "7F", " 12 ", "1e3", ".5", "5.", "x", None, "nan")], "t string")
    assert [r[0] for r in df.select(to_number_or_null("t")).collect()] == [None, None, 12.0, 1000.0, 0.5, 5.0, None, None, None]


def test_winsorize_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 30.0), ("b", None), ("b", None)], "g string, v double")
    rows = winsorize(df, "v", 0.1, by=["g"]).collect()
    assert len(rows) == 5 and [r["v"] for r in rows if r["g"] == "b"] == [None, None]


def test_unseen_category_is_all_zeros(spark):
    from pyspark.ml import Pipeline
    train = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    model = Pipeline(stages=preprocessing_stages([], ["c"])).fit(train)
    rows = model.transform(spark.createDataFrame([("a",), ("b",), ("z",)], "c string")).select("features").collect()
    assert [r[0].toArray().tolist() for r in rows] == [[1, 0], [0, 1], [0, 0]]


def test_translation_keeps_rows_without_language(spark):
    df = spark.createDataFrame([(1, "hello", "English"), (2, "hello", None), (3, "hello", "Hindi")], "id int, t string, lang string")
    out = translate_with_retry(df, "t", "lang", lambda prompts: ["नमस्ते"] * len(prompts))
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 3]


def test_small_test_fractions(spark):
    df = spark.range(20000).select(F.col("id"))
    n = hash_split(df, "id", test_fraction=0.004).where("split = 'test'").count()
    assert 40 < n < 140
