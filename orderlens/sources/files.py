"""CSV, JSON, text, scalar and model files."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nan_to_null
from ..schemas import ORDERS


def read_orders_csv(spark: SparkSession, path: str, schema: T.StructType = ORDERS) -> DataFrame:
    """Header CSV with an explicit schema; empty cells and NaN become null."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    doubles = {f.name for f in schema if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[nan_to_null(F.col(c)).alias(c) if c in doubles else F.col(c)
                       for c in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_metrics_csv(per_class: DataFrame, path: str, digits: int = 4) -> None:
    """One row per class; measures rounded."""
    doubles = [f.name for f in per_class.schema if isinstance(f.dataType, T.DoubleType)]
    write_csv(per_class.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c)
                                 for c in per_class.columns]), path)


def write_matrix_csv(matrix: DataFrame, names: list[str], path: str) -> None:
    """Confusion matrix with class names as header and first column."""
    columns = [c for c in matrix.columns if c != "true_label"]
    named = matrix.orderBy("true_label").select(
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("true_label") + 1).alias("class"),
        *[F.col(c).alias(n) for c, n in zip(columns, names)])
    write_csv(named.coalesce(1), path)  # one row per class


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType,
              multi_line: bool = True) -> DataFrame:
    """Files that each hold an array of records (or one record per line)."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def inline_table(spark: SparkSession, rows: list, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def save_scalar(spark: SparkSession, value: float, path: str) -> None:
    spark.createDataFrame([(float(value),)], "value double").write.mode("overwrite").parquet(path)


def load_scalar(spark: SparkSession, path: str) -> float:
    rows = spark.read.schema("value double").parquet(path).take(2)
    if len(rows) != 1:
        raise ValueError(f"{path} does not hold exactly one value")
    return rows[0]["value"]


def cache_features(df: DataFrame, path: str) -> DataFrame:
    """Writes an expensive frame once; what follows reads the written table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def reload_parity(model: PipelineModel, df: DataFrame, path: str, key: str) -> DataFrame:
    """Saves, reloads and compares: rows and largest difference of the probabilities.

    Both models score the same row, so nothing is joined; `key` only has to be a column."""
    from ..operators.models import probability

    save_model(model, path)
    scored = model.transform(df)
    added = [c for c in scored.columns if c not in df.columns]
    once = scored.withColumn("_p1", probability()).drop(*added)
    twice = load_model(path).transform(once).withColumn("_p2", probability())
    return twice.select(key, "_p1", "_p2").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("_p1") - F.col("_p2"))).alias("max_diff"))


def write_report(sections: DataFrame, path: str) -> DataFrame:
    """Rows (section, line_no, text) as text files, one folder per section; returns the rows."""
    (sections.repartition("section").sortWithinPartitions("section", "line_no")
     .select("section", "text").write.mode("overwrite").partitionBy("section").text(path))
    return sections
