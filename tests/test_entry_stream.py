import tempfile

from pyspark.sql import functions as F

from tests.conftest import SF001


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    rows = E.entry(spark).collect()
    assert len(rows) == 6 and all(r["q1"] <= r["median"] <= r["q3"] for r in rows)
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) >= 80


def test_text_checks_on_a_stream(spark):
    from tillage.streaming.score_stream import text_check_stream
    src = tempfile.mkdtemp(prefix="tillage-stream-")
    spark.createDataFrame([("### Title\n- नमस्ते किसान", "Hindi"), ("## नमस्ते किसान", "Telugu"), ("- hello", "Tamil")], "t string, lang string") \
        .write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema("t string, lang string").parquet(src)
    q = (text_check_stream(stream, "t", "lang").writeStream.format("memory").queryName("tc_out")
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = {r["lang"]: (r["plain"], r["in_language"]) for r in spark.sql("SELECT * FROM tc_out").collect()}
    # 5 Latin letters against 7 Devanagari letters (vowel signs are not letters): 0.58 < 0.6
    assert got["Hindi"] == ("Title\nनमस्ते किसान", False)
    assert got["Telugu"] == ("नमस्ते किसान", False) and got["Tamil"] == ("hello", False)
