"""One-hot encoding of any number of categories: the value-to-slot list is a table, not literals."""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prep import OrderPrep, category_counts
from .running import PIECE_ROWS, Running, range_pieces, running


def category_slots(counts: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(feature, value, slot): values of each feature numbered from 0 in ascending order.

    `counts` is (feature, value, n). The numbering runs over sorted pieces of bounded size, so a feature
    with any number of values is spread over tasks.
    """
    pieces = range_pieces(counts.select("feature", "value"), ["feature"], ["value"], piece_rows)
    return running(pieces, ["feature"], [F.col("value")], "_bucket", {"slot": Running("count", F.lit(1), default=0)})


class _IndexParams(Params):
    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "category columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "feature vector column", TypeConverters.toString)
    path = Param(Params._dummy(), "path", "folder of the category table", TypeConverters.toString)


class IndexedPrep(Estimator, _IndexParams, DefaultParamsReadable, DefaultParamsWritable):
    """Impute and scale like `OrderPrep`, one-hot encode through a category table below `path`.

    The driver sees a few numbers per column and the number of categories, never the categories.
    """

    def __init__(self, path: str = "", numeric=None, categorical=None, outputCol="features"):
        super().__init__()
        self._set(path=path, numeric=list(numeric or []), categorical=list(categorical or []), outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> "IndexedPrepModel":
        path, categorical = self.getOrDefault("path"), self.getOrDefault("categorical")
        stats = OrderPrep(self.getOrDefault("numeric"), []).fit(dataset).statistics()
        category_counts(dataset, categorical).write.mode("overwrite").parquet(f"{path}/counts")
        counts = dataset.sparkSession.read.parquet(f"{path}/counts")
        category_slots(counts).write.mode("overwrite").parquet(f"{path}/slots")
        # per feature one row: number of categories and the most frequent one, the smallest on ties
        top = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("n"))
        modes = counts.join(top, ["feature", "n"]).groupBy("feature", "size").agg(F.min("value").alias("mode")).collect()
        stats["mode"] = {r["feature"]: r["mode"] for r in modes}
        stats["size"] = {r["feature"]: r["size"] for r in modes}
        model = IndexedPrepModel(json.dumps(stats))
        model._set(**{p: self.getOrDefault(p) for p in ("path", "numeric", "categorical", "outputCol")})
        return model


class IndexedPrepModel(Model, _IndexParams, DefaultParamsReadable, DefaultParamsWritable):
    stats = Param(Params._dummy(), "stats", "fitted numbers as JSON", TypeConverters.toString)

    def __init__(self, stats: str = "{}"):
        super().__init__()
        self._set(stats=stats)

    def statistics(self) -> dict:
        return json.loads(self.getOrDefault("stats"))

    def slots(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.getOrDefault('path')}/slots")

    def feature_names(self, spark) -> DataFrame:
        """(position, name): numeric names, then `column_value` per category in ascending order."""
        numeric, sizes = self.getOrDefault("numeric"), self.statistics()["size"]
        before, at = {}, len(numeric)
        for c in self.getOrDefault("categorical"):
            before[c], at = at, at + sizes.get(c, 0)
        start = F.create_map(*[F.lit(x) for item in before.items() for x in item]) if before else None
        plain = spark.createDataFrame(list(enumerate(numeric)), "position bigint, name string")
        if start is None:
            return plain
        return plain.unionByName(self.slots(spark).select(
            (F.element_at(start, F.col("feature")) + F.col("slot")).cast("bigint").alias("position"),
            F.concat_ws("_", "feature", "value").alias("name")))

    def indexed(self, dataset: DataFrame) -> DataFrame:
        """Adds `<column>_slot` per category column: the slot of the value, or of the mode where it is null;
        null for a value that the fit has not seen. Each lookup is a join on the value."""
        out, modes = dataset, self.statistics()["mode"]
        slots = self.slots(dataset.sparkSession)
        for c in self.getOrDefault("categorical"):
            known = slots.filter(F.col("feature") == c).select(F.col("value").alias("_value"), F.col("slot").alias(f"{c}_slot"))
            out = out.withColumn("_key", F.coalesce(F.col(c), F.lit(modes.get(c))))
            out = out.join(known, F.col("_key") == F.col("_value"), "left").drop("_key", "_value")
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s, categorical = self.statistics(), [c for c in self.getOrDefault("categorical") if self.statistics()["size"].get(c)]
        out = self.indexed(dataset)
        scaled = [(F.coalesce(F.col(c).cast("double"), F.lit(s["median"][c])) - F.lit(s["mean"][c])) / F.lit(s["std"][c])
                  for c in self.getOrDefault("numeric")]
        out = out.withColumn("_numbers", array_to_vector(F.array(*scaled))) if scaled else out
        parts = ["_numbers"] if scaled else []
        for c in categorical:
            # one more index stands for "not seen", which the encoder drops: such a row has zeros
            size = s["size"][c]
            out = out.withColumn(f"_{c}", F.coalesce(F.col(f"{c}_slot"), F.lit(size)).cast("double"))
            shape = dataset.sparkSession.createDataFrame([(float(size),)], f"`_{c}` double")
            encoder = OneHotEncoder(inputCol=f"_{c}", outputCol=f"_{c}_hot", dropLast=True).fit(shape)
            out, parts = encoder.transform(out), [*parts, f"_{c}_hot"]
        assembled = VectorAssembler(inputCols=parts, outputCol=self.getOrDefault("outputCol")).transform(out)
        return assembled.select(*dataset.columns, self.getOrDefault("outputCol"))
