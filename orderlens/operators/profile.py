"""Table profile, group rates and missingness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pp_delta, round_to


def null_share(c: Column) -> Column:
    """Aggregate: percentage of rows where `c` is null."""
    return F.avg(c.isNull().cast("double")) * F.lit(100.0)


def table_profile(df: DataFrame, target: str, nullable: str) -> DataFrame:
    """One row: rows, columns, overall rate of the target, percentage of nulls."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).alias("n_columns"),
                  F.avg(F.col(target).cast("double")).alias("rate"),
                  null_share(F.col(nullable)).alias("null_pct"))


def rate_by(df: DataFrame, group: str, target: str, digits: int = 4) -> DataFrame:
    """Target rate and count per group value, groups ascending."""
    return (df.filter(F.col(group).isNotNull()).groupBy(group)
            .agg(round_to(F.avg(F.col(target).cast("double")), digits).alias("rate"),
                 F.count(target).alias("n_rows"))
            .orderBy(group))


def null_share_by(df: DataFrame, group: str, c: str, digits: int = 4) -> DataFrame:
    """Share of nulls (0-1) per group value, groups ascending."""
    return (df.filter(F.col(group).isNotNull()).groupBy(group)
            .agg(round_to(F.avg(F.col(c).isNull().cast("double")), digits).alias("null_share"))
            .orderBy(group))


def missing_gap(df: DataFrame, c: str, predicate: Column) -> DataFrame:
    """Null share inside and outside a predicate and the gap in percentage points, in one pass."""
    missing = F.col(c).isNull().cast("double")
    return (df.agg(F.avg(F.when(predicate, missing)).alias("share_in"),
                   F.avg(F.when(~predicate, missing)).alias("share_out"))
            .withColumn("gap_pp", pp_delta(F.col("share_in"), F.col("share_out"))))
