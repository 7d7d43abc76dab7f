"""Registered queries that train or apply models; checked by invariants in the tests."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators import importance as I
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import split as S
from ..operators.logistic import newton_logistic
from ..operators.prep import OrderPrep
from ..session import shared_dir, work_dir
from ..sources import files as FS
from ..sources.tables import table
from ..streaming import run_available, stream_score
from . import settings as X
from .data_queries import _query, nearest_label, scored, split_orders, stored
from .fixed_models import ColumnScore, LinearScore


def _logistic_pipeline(rows):
    """Preparation and logistic regression fitted on the training part."""
    train = rows.filter(F.col("split") == "train")
    prep = OrderPrep().fit(train)
    model = MD.fit_logistic(prep.transform(train))
    return PipelineModel(stages=[prep, model]), prep


def searched_forest(spark, d):
    """(rows with their split, chosen pipeline, table of fold averages) of the full search.

    The search is kept under a name made from the rows and its parameters, so all queries that need the
    chosen forest share one search, and an interrupted one goes on.
    """
    rows = split_orders(spark, d)
    mark = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("h")).first()
    search = MD.GridSearch("", k=5, trees=(100, 200), depths=(6, 10, None), seed=X.SEED)
    search.path = shared_dir(spark, f"forest-{mark['n']}-{mark['h'] & (1 << 64) - 1:x}-5-100-200-6-10-30-{X.SEED}")
    train = stored(S.stratified_folds(rows.filter(F.col("split") == "train"), "returned", "order_id", 5, X.SEED), "folds")
    return (rows, *search.run(train))


@_query
def m_logistic(spark, d):
    """Area and metrics of the test part at 0.5."""
    rows = split_orders(spark, d)
    model, _ = _logistic_pipeline(rows)
    test = model.transform(rows.filter(F.col("split") == "test")).select(
        "returned", MD.probability().alias("p"))
    test = test.withColumn("predicted", (F.col("p") >= X.DECISION).cast("int"))
    counts = M.binary_metrics(M.confusion_counts(test, "returned", "predicted"))
    return counts.withColumn("auc", F.lit(M.roc_auc(test, "returned", "p").first()["auc"]))


@_query
def m_majority(spark, d):
    rows = split_orders(spark, d, distance=False)
    test = MD.baseline_majority(rows.filter(F.col("split") == "train"),
                                rows.filter(F.col("split") == "test"))
    return M.classification_report(test, "returned", "prediction")


@_query
def m_forest_cv(spark, d):
    """The best grid point by fold averages, and the area of its refitted pipeline on the test part."""
    rows, best, grid = searched_forest(spark, d)
    test = best.transform(rows.filter(F.col("split") == "test")).select(
        "returned", MD.probability().alias("p"))
    auc = M.roc_auc(test, "returned", "p").first()["auc"]
    return MD.generalisation_gap(MD.best_params(grid), auc)


@_query
def m_impurity(spark, d):
    _, best, _ = searched_forest(spark, d)
    prep, model = best.stages
    return I.impurity_importance(spark, model, prep.feature_names())


def _permutation(rows, best, repeats):
    prep, model = best.stages
    test = prep.transform(rows.filter(F.col("split") == "test"))
    return I.permutation_importance(model, test, prep.feature_names(), key="order_id",
                                    label="returned", repeats=repeats)


@_query
def m_permutation(spark, d):
    rows, best, _ = searched_forest(spark, d)
    return _permutation(rows, best, repeats=15)


@_query
def m_importance_comparison(spark, d):
    rows, best, _ = searched_forest(spark, d)
    prep, model = best.stages
    return I.importance_comparison(
        I.impurity_importance(spark, model, prep.feature_names()), _permutation(rows, best, repeats=15))


@_query
def m_risk_scores(spark, d):
    """Probability, bucket and cut points per order; t* from the test part's sweep."""
    rows, model, _ = searched_forest(spark, d)
    test = model.transform(rows.filter(F.col("split") == "test")).select(
        "returned", MD.probability().alias("p"))
    t_star = M.best_threshold(M.threshold_sweep(test, "returned", "p")).first()["threshold"]
    return MD.score_return_risk(rows, model, t_star).select(
        "order_id", "return_probability", "risk_bucket", "cut_points")


@_query
def m_reload_parity(spark, d):
    rows, model, _ = searched_forest(spark, d)
    return FS.reload_parity(model, rows, work_dir(spark, "model"), "order_id")


@_query
def m_head(spark, d):
    """Linear head on stored vectors: accuracy, loss and the accuracy gate on a held-out part."""
    rows = stored(S.stratified_split(table(spark, d, "embeddings"), "label", "vec_id", 0.2,
                                     X.SEED), "vectors")
    head = MD.fit_linear_head(rows.filter(F.col("split") == "train"), reg=0.01)
    test = MD.apply_linear_head(rows.filter(F.col("split") == "test"), head)
    loss = M.log_loss(test, "probs", "label").first()["log_loss"]
    return MD.gate(M.accuracy(test, "label", "predicted")).withColumn("log_loss", F.lit(loss))


@_query
def m_score_vectors(spark, d):
    """The fitted head applied as a plugged-in batch model."""
    from ..functions import argmax

    vectors = table(spark, d, "embeddings")
    head = MD.fit_linear_head(vectors, reg=0.01)
    weights = head.coefficientMatrix.toArray().T
    bias = head.interceptVector.toArray()

    def make_predict_fn():
        return lambda batch: (batch @ weights + bias).astype("float32")

    return MD.score_vectors(vectors, make_predict_fn).select(
        "vec_id", "label", argmax(F.col("logits")).alias("predicted"))


@_query
def m_select_artifact(spark, d):
    """Heads of several strengths compared on the held-out part; the best one is selected."""
    rows = stored(S.stratified_split(table(spark, d, "embeddings"), "label", "vec_id", 0.2,
                                     X.SEED), "vectors")
    train = rows.filter(F.col("split") == "train")
    test = rows.filter(F.col("split") == "test")
    tried = []
    for step, reg in enumerate((0.1, 0.01)):
        head = MD.fit_linear_head(train, reg=reg)
        got = M.accuracy(MD.apply_linear_head(test, head), "label", "predicted").first()
        tried.append(("head", step, got["accuracy"], f"reg={reg}"))
    return MD.select_artifact(spark.createDataFrame(
        tried, "stage string, step int, metric double, path string"))


@_query
def m_stream_score(spark, d):
    """Orders written as files, scored as they arrive."""
    rows, model, _ = searched_forest(spark, d)
    folder = work_dir(spark, "arriving")
    rows.write.parquet(folder)
    arriving = spark.readStream.schema(rows.schema).parquet(folder)
    return run_available(stream_score(arriving, model, 0.5).select(
        "order_id", "return_probability", "risk_bucket"), "scores")


# ---- the same operators with models of stated weights, which SQL can follow -------------------

def _fixed_test(spark, d):
    rows = split_orders(spark, d, distance=False).filter(F.col("split") == "test")
    return rows.select("order_id", "returned", array_to_vector(F.array(*[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in X.FIXED_WEIGHTS])).alias("features"))


def _fixed_permutation(spark, d):
    return I.permutation_importance(
        LinearScore(list(X.FIXED_WEIGHTS.values())), stored(_fixed_test(spark, d), "test"),
        list(X.FIXED_WEIGHTS), key="order_id", label="returned", repeats=15)


@_query
def q_fold_areas_fixed(spark, d):
    """Fold areas of stated scores, their averages and the best one; all from one scan."""
    rows = S.stratified_folds(stored(scored(spark, d), "scored"), "returned", "order_id", 5, X.SEED)
    parts = [sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
             for weights in X.CANDIDATES]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), p.alias("score")) for i, p in enumerate(parts)]))
    long = rows.select("fold", F.col("returned").alias("label"), each.alias("e")).select("fold", "label", "e.*")
    grid = FS.inline_table(spark, [(i,) for i in range(len(parts))], "position int")
    table = MD.cross_validated(MD.fold_areas(long), grid)
    best = MD.best_params(table).select(F.col("position").alias("best"))
    return table.crossJoin(best).select("position", F.round("cv_auc", 9).alias("cv_auc"),
                                        (F.col("position") == F.col("best")).alias("chosen"))


@_query
def q_logistic_newton(spark, d):
    """Class-balanced logistic regression of two features: coefficients at the optimum."""
    rows = MD.with_class_weights(scored(spark, d)).select("returned", "weight", *[
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / s).alias(c) for c, s in X.NEWTON_SCALES.items()])
    fit = newton_logistic(stored(rows, "newton"), list(X.NEWTON_SCALES), "returned", "weight")
    return spark.createDataFrame(
        [("intercept", round(fit.intercept, 6)), *[(c, round(float(v), 6)) for c, v in zip(X.NEWTON_SCALES, fit.coefficients)]],
        "feature string, coefficient double")


@_query
def q_permutation_fixed(spark, d):
    """Mean and deviation of the area lost over 15 permutations of each column."""
    return _fixed_permutation(spark, d).select(
        "feature", *[F.round(c, 9).alias(c) for c in ("perm_importance_mean", "perm_importance_std")])


@_query
def q_impurity_fixed(spark, d):
    model = LinearScore(list(X.FIXED_WEIGHTS.values()))
    names = I.impurity_importance(spark, model, list(X.FIXED_WEIGHTS))
    missing = split_orders(spark, d, distance=False).agg(*[
        F.avg(F.col(c).isNull().cast("double")).alias(c) for c in X.FIXED_WEIGHTS])
    share = missing.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("null_share"))
                                               for c in X.FIXED_WEIGHTS])).alias("s")).select("s.*")
    return names.join(share, "feature").select("feature", F.round("importance", 9).alias("importance"), "null_share")


@_query
def q_importance_comparison_fixed(spark, d):
    model = LinearScore(list(X.FIXED_WEIGHTS.values()))
    out = I.importance_comparison(I.impurity_importance(spark, model, list(X.FIXED_WEIGHTS)),
                                  _fixed_permutation(spark, d), top=3)
    return out.select("feature", F.round("impurity_importance", 9).alias("impurity_importance"),
                      F.col("perm_rank").cast("bigint").alias("perm_rank"),
                      F.round("perm_importance", 9).alias("perm_importance"), "lost_most")


@_query
def q_risk_scores_fixed(spark, d):
    """Bucket and cut points of every order; t* from the sweep over the test part."""
    rows = stored(S.stratified_split(scored(spark, d), "returned", "order_id", 0.2, X.SEED), "split")
    test = rows.filter(F.col("split") == "test")
    t_star = M.best_threshold(M.threshold_sweep(test, "returned", "p")).first()["threshold"]
    return MD.score_return_risk(rows, ColumnScore("p"), t_star).select(
        "order_id", "return_probability", "risk_bucket", "cut_points")


@_query
def q_stream_score_fixed(spark, d):
    """The same scoring of orders that arrive as files, cut at 0.25."""
    rows = scored(spark, d)
    folder = work_dir(spark, "arriving")
    rows.write.parquet(folder)
    arriving = spark.readStream.schema(rows.schema).parquet(folder)
    return run_available(stream_score(arriving, ColumnScore("p"), 0.25).select(
        "order_id", "return_probability", "risk_bucket"), "scores")


@_query
def q_score_vectors_fixed(spark, d):
    """Nearest class mean as a plugged-in batch model."""
    from ..functions import argmax, as_doubles

    vectors = table(spark, d, "embeddings")
    parts = vectors.select("label", F.posexplode(as_doubles(F.col("embedding"))).alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.round(F.avg("x"), 6).alias("m")).collect()  # classes x dimensions
    weights = np.zeros((X.DIMENSIONS, X.CLASSES))
    for r in means:
        weights[r["i"], r["label"]] = r["m"]
    bias = -0.5 * (weights ** 2).sum(axis=0)

    def make_predict_fn():
        return lambda batch: (batch @ weights + bias).astype("float32")

    return MD.score_vectors(vectors, make_predict_fn).select(
        "vec_id", "label", argmax(F.col("logits")).alias("predicted"))


@_query
def q_select_artifact_fixed(spark, d):
    """One candidate per class with its recall as metric: even classes stand for the preferred stage."""
    got = M.per_class_metrics(nearest_label(spark, d), "label", "predicted")
    stage = F.when(F.col("label") % 2 == 0, "finetuned").otherwise("head")
    return MD.select_artifact(got.select(
        stage.alias("stage"), F.col("label").cast("int").alias("step"), F.col("recall").alias("metric"),
        F.concat(F.lit("class-"), F.col("label")).alias("path")))
