import os
import tempfile

from pyspark.sql import functions as F

from tillage.operators import folds as FO
from tillage.operators.schema import detect_region_column, detect_year_column, find_target_column
from tillage.sources.csv_io import read_table_csv
from tillage.sources.files import inline_table, scan_file_index


def test_leave_one_group_out_keeps_null_keys_in_train(spark):
    df = spark.createDataFrame([(1, 2000), (2, 2001), (3, None), (4, 2000)], "id int, year int")
    folds = list(FO.leave_one_group_out(df, "year"))
    assert [f[0] for f in folds] == [2000, 2001]
    for v, tr, te in folds:
        ids_tr = {r[0] for r in tr.select("id").collect()}
        assert 3 in ids_tr
        assert {r[0] for r in te.select("id").collect()}.isdisjoint(ids_tr)


def test_kfold_partition(spark):
    df = spark.range(23).withColumn("k", F.col("id").cast("string"))
    out = FO.kfold_ids(df, 5, ["id"], total_order=True).toPandas()
    sizes = out.groupby("fold").size().tolist()
    assert sizes == [5, 5, 5, 4, 4]


def test_stratified_split_counts(spark):
    df = spark.createDataFrame([(i, f"c{i % 4}") for i in range(400)], "id int, c string")
    out = FO.stratified_split(df, "c", "id").groupBy("c", "split").count().collect()
    assert all(r["count"] == (20 if r["split"] == "test" else 80) for r in out)


def test_csv_markers_and_types(spark):
    d = tempfile.mkdtemp(prefix="tillage-csv-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write("a,b,c\n1,2.5,x\nNA,n/a,y\n3,,NULL\n")
    df = read_table_csv(spark, p)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    assert [tuple(r) for r in df.collect()] == [(1, 2.5, "x"), (None, None, "y"), (3, None, None)]


def test_file_index(spark):
    d = tempfile.mkdtemp(prefix="tillage-img-")
    os.makedirs(os.path.join(d, "sub"))
    for name in ["Rice.png", "sub/Kidney Beans.JPG", "Odd.Jpg", "note.txt"]:
        with open(os.path.join(d, name), "wb") as f:
            f.write(b"x")
    idx = {r["key"]: r["path"] for r in scan_file_index(spark, d).collect()}
    assert set(idx) == {"rice", "kidneybeans"}
    assert scan_file_index(spark, os.path.join(d, "missing")).count() == 0


def test_inline_and_schema_detection(spark):
    assert inline_table(spark).count() == 5
    e = spark.createDataFrame([], "Crop_Yield double, YEAR int, District string, x double")
    assert find_target_column(e) == "Crop_Yield"
    assert detect_year_column(e) == "YEAR"
    assert detect_region_column(e) == "District"
