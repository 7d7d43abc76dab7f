"""Training, scoring and model selection on MLlib."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (LogisticRegression, LogisticRegressionModel,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import argmax, class_name, cut_points, risk_bucket, round_to
from ..schemas import TARGET
from ..session import spread, work_dir
from .deep_forest import deep_scores
from .metrics import balanced_weights, majority_class, roc_auc
from .prep import OrderPrep

MAX_DEPTH = 30  # the deepest tree MLlib grows; stands in for "unlimited"
DEEP = 5  # a search grows the folds' trees of more levels once for all grid points, see `deep_forest`
ACCURACY_BAR = 0.80  # fixed value: the bar of the accuracy gate


def with_class_weights(df: DataFrame, label: str = TARGET, name: str = "weight") -> DataFrame:
    weights = balanced_weights(df, label).select(F.col(label).alias("_label"),
                                                 F.col("weight").alias(name))
    # one row per class
    return df.join(F.broadcast(weights), F.col(label) == F.col("_label")).drop("_label")


def baseline_majority(train: DataFrame, df: DataFrame, label: str = TARGET) -> DataFrame:
    """Predicts the training majority class for every row."""
    majority = majority_class(train, label).first()["majority"]
    return df.withColumn("prediction", F.lit(majority))


def fit_logistic(train: DataFrame, label: str = TARGET, features: str = "features",
                 balanced: bool = True, c: float = 1.0) -> LogisticRegressionModel:
    """L2-regularised logistic regression whose optimum is that of an unaveraged loss with
    inverse strength `c`; MLlib averages by the sum of weights, hence the division."""
    data = with_class_weights(train, label) if balanced else train.withColumn("weight", F.lit(1.0))
    total = data.agg(F.sum("weight")).first()[0]
    return LogisticRegression(
        featuresCol=features, labelCol=label, weightCol="weight", regParam=1.0 / (c * total),
        elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-8).fit(data)


def forest(label: str = TARGET, features: str = "features", trees: int = 100,
           depth: int | None = None, seed: int = 42) -> RandomForestClassifier:
    # deep trees: rows remember their node instead of walking down to it, and many nodes split at a time
    return RandomForestClassifier(
        labelCol=label, featuresCol=features, weightCol="weight", numTrees=trees,
        maxDepth=MAX_DEPTH if depth is None else depth, seed=seed, cacheNodeIds=True, maxMemoryInMB=1024)


def fit_forest(train: DataFrame, label: str = TARGET, features: str = "features",
               trees: int = 100, depth: int | None = None, seed: int = 42):
    return forest(label, features, trees, depth, seed).fit(with_class_weights(train, label))


def fold_areas(scores: DataFrame, by=("position", "fold"), label: str = "label", score: str = "score") -> DataFrame:
    """The exact area of every candidate in every fold, from one scan of (position, fold, label, score)."""
    return roc_auc(scores, label, score, by=list(by))


def cross_validated(areas: DataFrame, grid: DataFrame) -> DataFrame:
    """Grid rows with `cv_auc`, the mean area over the folds (those with both classes)."""
    means = areas.groupBy("position").agg(F.avg("auc").alias("cv_auc"))
    return grid.join(means, "position")


class GridSearch:
    """Cross-validated forest grid by ROC-AUC, stored step by step below `path` and resumable.

    `path/learn` and `path/held` hold each fold's prepared rows, once for the whole grid; `path/scores`
    gets the held-out scores of one (fold, grid point) at a time, and `path/model` the chosen pipeline,
    refitted on all rows. A step that is stored is not run again, so a search that was interrupted goes
    on where it stopped. The areas of all candidates come from one scan of the scores. Grid points that
    have more than `DEEP` levels share a fold's trees, in `path/deep`: fewer trees are the first ones, and
    fewer levels the upper ones. Some folds are worked on at a time.
    """

    def __init__(self, path: str, *, label: str = TARGET, fold_col: str = "fold", k: int = 5, trees=(100, 200),
                 depths=(6, 10, None), prep: OrderPrep | None = None, parallelism: int = 2, seed: int = 42):
        self.path, self.label, self.fold_col, self.k, self.seed = path, label, fold_col, k, seed
        self.grid = [(t, MAX_DEPTH if d is None else d) for t in trees for d in depths]
        self.prep, self.parallelism = prep or OrderPrep(), parallelism

    def _read(self, spark, name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing stored yet
            return None

    def _fold(self, data: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
        """The fold's rows as features, prepared by what the other folds say."""
        spark = data.sparkSession
        names = [f"learn/fold={fold}", f"held/fold={fold}"]
        parts = [self._read(spark, n) for n in names]
        if None in parts:
            held = F.col(self.fold_col) == fold
            fitted = self.prep.fit(data.filter(~held))
            for name, rows in zip(names, (data.filter(~held), data.filter(held))):
                fitted.transform(rows).select(self.label, "weight", "features").write.mode("overwrite").parquet(
                    f"{self.path}/{name}")
            parts = [self._read(spark, n) for n in names]
        return spread(parts[0]), parts[1]

    def _deep(self, learn: DataFrame, held: DataFrame, fold: int) -> DataFrame:
        """The fold's held-out scores by the grid's deep forests, a column for each."""
        name = f"deep/fold={fold}"
        if self._read(learn.sparkSession, f"{name}/scores") is None:
            depths = sorted({d for _, d in self.grid if d > DEEP})
            deep_scores(learn, held, f"{self.path}/{name}", label=self.label, depth=depths[-1], depths=depths, seed=self.seed,
                        sizes=sorted({t for t, d in self.grid if d > DEEP})).write.mode("overwrite").parquet(f"{self.path}/{name}/scores")
        return self._read(learn.sparkSession, f"{name}/scores")

    def _score(self, learn: DataFrame, held: DataFrame, fold: int, position: int) -> None:
        trees, depth = self.grid[position]
        if depth > DEEP:
            scores = self._deep(learn, held, fold).select(
                F.col("label").cast(learn.schema[self.label].dataType).alias("label"), F.col(f"score_{trees}_{depth}").alias("score"))
        else:
            model = forest(self.label, trees=trees, depth=depth, seed=self.seed).fit(learn)
            scores = model.transform(held).select(F.col(self.label).alias("label"), probability().alias("score"))
        scores.write.mode("overwrite").parquet(f"{self.path}/scores/fold={fold}/position={position}")

    def areas(self, train: DataFrame) -> DataFrame:
        """(position, fold, auc) of all candidates; runs what is not stored."""
        data = with_class_weights(train, self.label)
        stored = self._read(train.sparkSession, "scores")
        done = set() if stored is None else {(r["fold"], r["position"]) for r in stored.select(
            "fold", "position").distinct().collect()}  # at most folds x grid points

        def run(fold: int) -> None:
            todo = [p for p in range(len(self.grid)) if (fold, p) not in done]
            if todo:
                learn, held = self._fold(data, fold)
                for p in todo:
                    self._score(learn, held, fold, p)
        with ThreadPool(self.parallelism) as pool:
            pool.map(run, range(self.k))
        return fold_areas(self._read(train.sparkSession, "scores"))

    def table(self, train: DataFrame) -> DataFrame:
        """(position, trees, depth, cv_auc)."""
        rows = [(i, t, d) for i, (t, d) in enumerate(self.grid)]
        return cross_validated(self.areas(train), train.sparkSession.createDataFrame(
            rows, "position int, trees int, depth int"))

    def run(self, train: DataFrame) -> tuple[PipelineModel, DataFrame]:
        """The chosen pipeline (the first one on ties) and the table of fold averages."""
        table = self.table(train)
        stored = self._read(train.sparkSession, "model/metadata")  # written last
        if stored is None:
            best = best_params(table).first()
            data = with_class_weights(train, self.label)
            whole = self.prep.fit(data)
            model = forest(self.label, trees=best["trees"], depth=best["depth"], seed=self.seed).fit(spread(whole.transform(data)))
            PipelineModel(stages=[whole, model]).write().overwrite().save(f"{self.path}/model/pipeline")
            train.sparkSession.createDataFrame([(best["position"],)], "position int").write.mode(
                "overwrite").parquet(f"{self.path}/model/metadata")
        return PipelineModel.load(f"{self.path}/model/pipeline"), table


def grid_search(train: DataFrame, path: str | None = None, **options) -> tuple[PipelineModel, DataFrame]:
    """Best pipeline and rows of fold averages; see `GridSearch`. Without a path, a fresh work folder."""
    return GridSearch(path or work_dir(train.sparkSession, "search"), **options).run(train)


def best_params(table: DataFrame) -> DataFrame:
    """The grid row with the highest average; the first one on ties."""
    return table.orderBy(F.desc("cv_auc"), "position").limit(1)


def probability(column: str = "probability") -> Column:
    return vector_to_array(column)[1]


def score_return_risk(df: DataFrame, model: PipelineModel, t_star: float) -> DataFrame:
    """Adds return_probability (4 decimals), risk_bucket, t_star and cut_points to orders."""
    scored = model.transform(df).withColumn("_p", probability())
    extra = [c for c in ("features", "rawPrediction", "probability", "prediction")
             if c not in df.columns]
    return with_bucket(scored, "_p", t_star).drop("_p", *extra)


def with_bucket(df: DataFrame, p: str, t_star: float) -> DataFrame:
    """The bucket is decided on the unrounded probability, which is rounded afterwards."""
    t = F.lit(float(t_star))
    return (df.withColumn("risk_bucket", risk_bucket(F.col(p), t))
            .withColumn("return_probability", round_to(F.col(p), 4))
            .withColumn("t_star", t).withColumn("cut_points", cut_points(t)))


# ---- linear head on cached vectors ----------------------------------------------------------

def fit_linear_head(df: DataFrame, vector: str = "embedding", label: str = "label",
                    reg: float = 0.0, max_iter: int = 100) -> LogisticRegressionModel:
    """Softmax regression on vectors that were computed once and stored."""
    data = df.select(F.col(label).cast("double").alias("label"),
                     array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return LogisticRegression(family="multinomial", regParam=reg, maxIter=max_iter).fit(data)


def apply_linear_head(df: DataFrame, model, vector: str = "embedding") -> DataFrame:
    """Adds `probs` (array) and `predicted` (class index)."""
    scored = model.transform(df.withColumn(
        "features", array_to_vector(F.col(vector).cast("array<double>"))))
    return (scored.withColumn("probs", vector_to_array("probability"))
            .withColumn("predicted", argmax(F.col("probs")))
            .drop("features", "rawPrediction", "probability", "prediction"))


def predict_class(df: DataFrame, names: list[str], probs: str = "probs") -> DataFrame:
    """Adds predicted_category and confidence (4 decimals)."""
    return (df.withColumn("predicted_category", class_name(argmax(F.col(probs)), names))
            .withColumn("confidence", round_to(F.array_max(F.col(probs)), 4)))


def score_vectors(df: DataFrame, make_predict_fn, vector: str = "embedding",
                  output: str = "logits", batch_size: int = 64) -> DataFrame:
    """Adds the output of a user's model; `make_predict_fn` runs once per Python worker and
    returns a function from a batch of vectors to a batch of vectors.

    Every row stays: one whose vector is null, holds nulls or has another than the commonest length
    gets a null output."""
    width = _width(df, vector)
    infer = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()),
                              batch_size=batch_size, input_tensor_shapes=[[width]])
    whole = (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull())
    filler = F.array_repeat(F.lit(0.0).cast("float"), width)
    fed = F.when(F.coalesce(whole, F.lit(False)), F.col(vector).cast("array<float>")).otherwise(filler)
    return df.withColumn(output, F.when(F.coalesce(whole, F.lit(False)), infer(fed)))


def _width(df: DataFrame, vector: str) -> int:
    """The commonest length; 1 without any vector."""
    row = (df.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).count()
           .orderBy(F.desc("count"), F.desc("n")).first())
    return int(row["n"]) if row else 1


# ---- selection ------------------------------------------------------------------------------

def select_artifact(candidates: DataFrame, prefer=("finetuned", "head")) -> DataFrame:
    """From (stage, step, metric, path): per stage the best metric, the earliest step on ties;
    then the first preferred stage that has a candidate. Fails when there is none."""
    place = F.array_position(F.array(*[F.lit(s) for s in prefer]), F.col("stage"))
    order = Window.partitionBy("stage").orderBy(F.desc("metric"), "step")
    best = (candidates.filter(place > 0).withColumn("_rn", F.row_number().over(order))
            .filter(F.col("_rn") == 1).withColumn("_place", place)
            .orderBy("_place").limit(1).drop("_rn", "_place"))
    if not best.take(1):
        raise ValueError("no trained candidate to select")
    return best


def gate(metrics: DataFrame, metric: str = "accuracy", bar: float = ACCURACY_BAR) -> DataFrame:
    """Adds `passed`: the metric reaches the bar."""
    return metrics.withColumn("bar", F.lit(bar)).withColumn("passed", F.col(metric) >= bar)


def generalisation_gap(best: DataFrame, test_auc: float) -> DataFrame:
    return best.withColumn("test_auc", F.lit(test_auc)).withColumn(
        "gap", F.abs(F.col("cv_auc") - F.col("test_auc")))
