import pytest
from pyspark.sql import functions as F

from orderlens.operators import confusion as C
from orderlens.operators import metrics as M
from orderlens.schemas import CHUNK, ORDERS
from orderlens.sources import files as FS
from orderlens.sources.risk_orders import risk_orders


def test_order_table_has_the_declared_schema(spark, sf):
    df = risk_orders(spark, sf)
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in ORDERS]
    assert df.count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_order_csv_round_trip(spark, sf, tmp_path):
    df = risk_orders(spark, sf)
    FS.write_csv(df, str(tmp_path / "orders"))
    back = FS.read_orders_csv(spark, str(tmp_path / "orders"))
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_empty_and_nan_cells_become_null(spark, tmp_path):
    header = ",".join(ORDERS.names)
    (tmp_path / "o.csv").write_text(
        f"{header}\n1,Apparel,10,5.0,COD,3,1,0,4.0,2,1,,0\n2,Home,10,5.0,COD,3,1,0,4.0,2,1,NaN,1\n")
    rows = FS.read_orders_csv(spark, str(tmp_path / "o.csv")).orderBy("order_id").collect()
    assert [r["rating_given"] for r in rows] == [None, None]


def test_json_arrays_and_lines(spark, tmp_path):
    (tmp_path / "c.json").write_text(
        '[{"chunk_id": "a__0", "parent_doc_id": "a", "category": "x", "text": "One."},\n'
        ' {"chunk_id": "a__1", "parent_doc_id": "a", "category": "x", "text": "Two."}]')
    df = FS.read_json(spark, str(tmp_path / "c.json"), CHUNK)
    assert df.count() == 2
    FS.write_json(df, str(tmp_path / "out"))
    back = FS.read_json(spark, str(tmp_path / "out"), CHUNK, multi_line=False)
    assert sorted(back.collect()) == sorted(df.collect())


def test_scalar(spark, tmp_path):
    FS.save_scalar(spark, 0.5, str(tmp_path / "t"))
    assert FS.load_scalar(spark, str(tmp_path / "t")) == 0.5
    spark.range(2).select(F.col("id").cast("double").alias("value")).write.parquet(
        str(tmp_path / "two"))
    with pytest.raises(ValueError):
        FS.load_scalar(spark, str(tmp_path / "two"))


def test_metric_files(spark, tmp_path):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y int, p int")
    FS.write_metrics_csv(M.per_class_metrics(df, "y", "p"), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 2
    FS.write_matrix_csv(C.confusion_matrix(df, "y", "p", [0, 1]), ["T-shirt/top", "Bag"],
                        str(tmp_path / "x"))
    back = spark.read.option("header", True).csv(str(tmp_path / "x"))
    assert back.columns == ["class", "T-shirt/top", "Bag"]
    assert [tuple(r) for r in back.collect()] == [("T-shirt/top", "1", "1"), ("Bag", "0", "1")]


def test_stored_features_and_inline_rows(spark, tmp_path):
    df = FS.inline_table(spark, [(1, [0.5])], "id bigint, v array<float>")
    assert FS.cache_features(df, str(tmp_path / "f")).collect() == df.collect()
