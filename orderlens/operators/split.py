"""Stratified splits and folds by a hash of the row key.

Within each class the rows are ordered by the hash; a split or fold border is the hash value at a
given rank. Borders are found exactly from counts per (class, hash prefix) plus the few rows that
share the border's prefix, so wide rows are neither sorted nor shuffled: they are only compared
with one short list of borders per class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import order_hash
from .running import hash_prefix


def _class_sizes(df: DataFrame, label: str) -> DataFrame:
    return (df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("_label"))
            .agg(F.count(F.lit(1)).alias("_size")))


def _borders(df: DataFrame, label: str, key: str, seed, ranks: DataFrame) -> DataFrame:
    """Hash value at each wanted rank: rows (_label, _i, _rank) in, (_label, _i, _cut) out."""
    hashed = df.filter(F.col(label).isNotNull()).select(
        F.col(label).alias("_label"), order_hash(F.col(key), seed).alias("_h"))
    buckets = (hashed.withColumn("_b", hash_prefix(F.col("_h"))).groupBy("_label", "_b")
               .agg(F.count(F.lit(1)).alias("_n")))
    ordered = Window.partitionBy("_label").orderBy("_b")
    upto = buckets.withColumn("_upto", F.sum("_n").over(ordered))  # 65,536 prefixes per class
    # the bucket that holds the wanted rank: at most one per class and border
    holding = (upto.join(F.broadcast(ranks), "_label")
               .filter((F.col("_rank") > F.col("_upto") - F.col("_n"))
                       & (F.col("_rank") <= F.col("_upto")))
               .select("_label", "_i", "_b",
                       (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_at")))
    near = hashed.withColumn("_b", hash_prefix(F.col("_h"))).join(
        F.broadcast(holding), ["_label", "_b"])
    inside = Window.partitionBy("_label", "_i").orderBy("_h")
    return (near.withColumn("_r", F.row_number().over(inside))
            .filter(F.col("_r") == F.col("_at"))
            .select("_label", "_i", F.col("_h").alias("_cut")))


def test_quotas(df: DataFrame, label: str, test_size) -> DataFrame:
    """Rows of each class that go to the test part: (_label, _size, _quota).

    `test_size` is a share (rounded up to whole rows) or a row count. The total is spread over the
    classes in proportion; whole rows first, then by largest remainder.
    """
    sizes = _class_sizes(df, label)
    every = Window.partitionBy()  # one row per class from here on
    total = F.sum("_size").over(every)
    wanted = (F.ceil(total * F.lit(test_size) - F.lit(1e-9)) if isinstance(test_size, float)
              else F.lit(int(test_size)).cast("bigint"))
    share = sizes.withColumn("_total", total).withColumn("_wanted", wanted)
    # whole-number arithmetic wide enough for the product of two row counts
    share = share.withColumn("_product", F.col("_size").cast("decimal(19,0)")
                             * F.col("_wanted").cast("decimal(19,0)"))
    share = share.withColumn("_whole", F.expr("_product div _total"))
    share = share.withColumn("_rest", F.expr("_product % _total"))
    by_rest = Window.partitionBy().orderBy(F.desc("_rest"), "_label")
    left = F.col("_wanted") - F.sum("_whole").over(every)
    extra = (F.row_number().over(by_rest) <= left).cast("bigint")
    return share.select("_label", "_size", (F.col("_whole") + extra).alias("_quota"))


def stratified_split(df: DataFrame, label: str, key: str, test_size=0.2, seed=42,
                     name: str = "split") -> DataFrame:
    """Adds `name` = 'test' or 'train', keeping the class shares to within one row."""
    quotas = test_quotas(df, label, test_size)
    ranks = quotas.filter(F.col("_quota") > 0).select(
        "_label", F.lit(0).alias("_i"), F.col("_quota").alias("_rank"))
    cuts = _borders(df, label, key, seed, ranks).select("_label", "_cut")
    hashed = order_hash(F.col(key), seed)
    joined = df.join(F.broadcast(cuts), F.col(label) == F.col("_label"), "left")
    in_test = F.coalesce(hashed <= F.col("_cut"), F.lit(False))
    return joined.withColumn(name, F.when(in_test, F.lit("test")).otherwise(F.lit("train"))).drop(
        "_label", "_cut")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed=42,
                     name: str = "fold") -> DataFrame:
    """Adds a fold number 0..k-1; every fold keeps the class shares to within one row."""
    sizes = _class_sizes(df, label)
    borders = (sizes.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(k - 1))))
               .withColumn("_rank", F.ceil(F.col("_i") * F.col("_size") / F.lit(k)))
               .select("_label", "_i", "_rank"))
    cuts = (_borders(df, label, key, seed, borders).groupBy("_label")
            .agg(F.sort_array(F.collect_list("_cut")).alias("_cuts")))  # k - 1 values
    hashed = order_hash(F.col(key), seed)
    joined = df.join(F.broadcast(cuts), F.col(label) == F.col("_label"), "left")
    fold = F.size(F.filter(F.col("_cuts"), lambda c: c < hashed))
    return joined.withColumn(name, F.coalesce(fold, F.lit(0)).cast("int")).drop("_label", "_cuts")


def hash_split(key: Column, test_share: float, seed=42) -> Column:
    """Stateless split for streams: class shares hold only within sampling error."""
    first = F.conv(F.substring(order_hash(key, seed), 1, 8), 16, 10).cast("double")
    return F.when(first / F.lit(4294967296.0) < F.lit(test_share), F.lit("test")).otherwise(
        F.lit("train"))


def sample_per_class(df: DataFrame, label: str, order_by: str, n: int = 1) -> DataFrame:
    """First n rows of each class in key order; the limit is applied before the shuffle."""
    order = Window.partitionBy(label).orderBy(order_by)
    return (df.filter(F.col(label).isNotNull()).withColumn("_rn", F.row_number().over(order))
            .filter(F.col("_rn") <= n).drop("_rn"))
