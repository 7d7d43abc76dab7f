"""Evaluation of scores and class predictions.

All counts are combined before their shuffle. A sweep over many thresholds reads the scores once.
Rows whose label, prediction or score is null are left out of every measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import at_least, div0, f1_score, log_loss_term, pp_delta


def _flag(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("bigint"))


def confusion_aggregates(y: Column, predicted: Column) -> list[Column]:
    return [_flag((y == 1) & (predicted == 1)).alias("tp"),
            _flag((y == 0) & (predicted == 1)).alias("fp"),
            _flag((y == 1) & (predicted == 0)).alias("fn"),
            _flag((y == 0) & (predicted == 0)).alias("tn")]


def confusion_counts(df: DataFrame, y: str, predicted: str) -> DataFrame:
    return df.agg(*confusion_aggregates(F.col(y), F.col(predicted)))


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall and F1 of class 1 to rows of tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (counts.withColumn("accuracy", div0(tp + tn, tp + fp + fn + tn))
            .withColumn("precision", div0(tp, tp + fp))
            .withColumn("recall", div0(tp, tp + fn))
            .withColumn("f1", f1_score(tp, tp + fp, tp + fn)))


def _both(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())


def cell_counts(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """Rows per (true class, predicted class); rows without one of the two are left out."""
    return _both(df, y, predicted).groupBy(F.col(y).alias("t"), F.col(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n"))


def class_counts(cells: DataFrame) -> DataFrame:
    """Per class: hits, rows that are of it, rows predicted as it. Works on cells, not on rows."""
    n = F.col("n")
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("t").alias("label"),
                 F.when(F.col("t") == F.col("p"), n).otherwise(zero).alias("tp"),
                 n.alias("actual"), zero.alias("predicted")),
        F.struct(F.col("p").alias("label"), zero.alias("tp"), zero.alias("actual"),
                 n.alias("predicted")))
    return (cells.select(F.explode(sides).alias("s")).select("s.*").groupBy("label")
            .agg(*[F.sum(c).alias(c) for c in ("tp", "actual", "predicted")]))


def _class_metrics(counts: DataFrame) -> DataFrame:
    return counts.select(
        "label", "tp", "actual",
        div0(F.col("tp"), F.col("predicted")).alias("precision"),
        div0(F.col("tp"), F.col("actual")).alias("recall"),
        f1_score(F.col("tp"), F.col("predicted"), F.col("actual")).alias("f1"))


def classification_report(df: DataFrame, y: str, predicted: str, digits: int = 4) -> DataFrame:
    """Rows for each class, then accuracy, macro avg and weighted avg.

    The summary rows come from grouping sets over the class rows, so the data is read once.
    """
    per_class = _class_metrics(class_counts(cell_counts(df, y, predicted)))
    kinds = F.explode(F.array(F.col("label").cast("string"), F.lit("accuracy"),
                              F.lit("macro avg"), F.lit("weighted avg"))).alias("row")
    spread = per_class.select(kinds, "tp", "actual", "precision", "recall", "f1")
    weight = F.col("actual").cast("double")

    def summary(c: str) -> Column:
        weighted = div0(F.sum(F.col(c) * weight), F.sum(weight))
        value = (F.when(F.col("row") == "accuracy", div0(F.sum("tp"), F.sum("actual")))
                 .when(F.col("row") == "weighted avg", weighted)
                 .otherwise(F.avg(c)))
        return F.round(value, digits).alias(c)

    return spread.groupBy("row").agg(summary("precision"), summary("recall"), summary("f1"),
                                     F.sum("actual").alias("support"))


def per_class_metrics(df: DataFrame, y: str, predicted: str, digits: int = 4) -> DataFrame:
    return metrics_of_cells(cell_counts(df, y, predicted), digits)


def metrics_of_cells(cells: DataFrame, digits: int = 4) -> DataFrame:
    """Precision and recall per class from (t, p, n) rows."""
    return _class_metrics(class_counts(cells)).select(
        "label", F.round("precision", digits).alias("precision"),
        F.round("recall", digits).alias("recall"))


def accuracy(df: DataFrame, y: str, predicted: str) -> DataFrame:
    return _both(df, y, predicted).agg(
        F.avg((F.col(y) == F.col(predicted)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n_rows"))


def log_loss(df: DataFrame, probs: str, label: str) -> DataFrame:
    return df.agg(F.avg(log_loss_term(F.col(probs), F.col(label))).alias("log_loss"))


def majority_class(df: DataFrame, y: str) -> DataFrame:
    """One row: the most frequent class (smallest on ties) and its share."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max_by(y, F.struct("n", -F.col(y))).alias("majority"),
                      F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.select("majority", div0(F.col("n"), F.col("total")).alias("share"))


def negative_share(df: DataFrame, y: str) -> DataFrame:
    return df.agg((F.lit(1.0) - F.avg(F.col(y).cast("double"))).alias("negative_share"))


def balanced_weights(df: DataFrame, y: str) -> DataFrame:
    """Weight n / (k * n_class) per class."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # one row per class
    return counts.select(y, "n", (
        F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    ).cast("double").alias("weight"))


# ---- threshold sweeps -----------------------------------------------------------------------

SWEEP_LOW, SWEEP_HIGH, SWEEP_STEP = 0.10, 0.90, 0.02  # fixed values of the sweep


def thresholds_cleared(score: Column, lo: float, step: float, n: int) -> Column:
    """How many of lo, lo+step, ... (n of them) the score reaches.

    The quotient may be off by one next to a threshold, so both neighbours are compared with the
    threshold itself.
    """
    def level(i: Column) -> Column:
        return F.lit(lo) + i.cast("double") * F.lit(step)

    guess = F.floor((score - F.lit(lo)) / F.lit(step))
    exact = F.when(score >= level(guess + 1), guess + 2).when(score < level(guess), guess)
    return F.greatest(F.lit(0), F.least(F.coalesce(exact, guess + 1), F.lit(n))).cast("int")


def threshold_sweep(df: DataFrame, y: str, score: str, *, by: list[str] | None = None,
                    lo: float = SWEEP_LOW, hi: float = SWEEP_HIGH,
                    step: float = SWEEP_STEP) -> DataFrame:
    """F1, recall and precision of class 1 at every threshold, optionally per group.

    Rows are counted by the number of thresholds they clear (at most n + 1 rows per group after
    the first aggregation); everything after that works on those counts.
    """
    by = list(by or [])
    n = int((hi - lo) / step + 1e-9) + 1
    counts = (_both(df, y, score).groupBy(*by, thresholds_cleared(F.col(score), lo, step, n).alias("_cleared"))
              .agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("rows")))
    zero = F.lit(0).cast("bigint")
    reached = F.col("_cleared") > F.col("i")
    per_threshold = (
        counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .groupBy(*by, "i").agg(
            F.sum(F.when(reached, F.col("pos")).otherwise(zero)).alias("tp"),
            F.sum(F.when(reached, F.col("rows")).otherwise(zero)).alias("predicted"),
            F.sum("pos").alias("actual")))
    return per_threshold.select(
        *by, F.round(F.lit(lo) + F.col("i") * F.lit(step), 2).alias("threshold"),
        f1_score(F.col("tp"), F.col("predicted"), F.col("actual")).alias("f1"),
        div0(F.col("tp"), F.col("actual")).alias("recall"),
        div0(F.col("tp"), F.col("predicted")).alias("precision"))


def best_threshold(sweep: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The row with the highest F1, the lowest threshold on ties; one per group when grouped."""
    if not by:
        return sweep.orderBy(F.desc("f1"), F.asc("threshold")).limit(1)
    place = F.struct("f1", -F.col("threshold"))
    return sweep.groupBy(*by).agg(*[F.max_by(c, place).alias(c)
                                    for c in ("threshold", "f1", "recall", "precision")])


def threshold_tradeoff(df: DataFrame, y: str, score: str, default: float = 0.5) -> DataFrame:
    """Recall gained and precision lost, in percentage points, by the best threshold."""
    base = binary_metrics(
        df.agg(*confusion_aggregates(F.col(y), at_least(F.col(score), default)))
    ).select(F.col("recall").alias("r0"), F.col("precision").alias("p0"), F.lit(1).alias("one"))
    best = best_threshold(threshold_sweep(df, y, score)).withColumn("one", F.lit(1))
    return best.join(base, "one").select(
        "threshold", pp_delta(F.col("recall"), F.col("r0")).alias("recall_gain_pp"),
        pp_delta(F.col("p0"), F.col("precision")).alias("precision_drop_pp"))


def roc_auc(df: DataFrame, y: str, score: str, by: list[str] | None = None,
            digits: int | None = None) -> DataFrame:
    """Exact area under the ROC curve (ties count half); null where a class is absent.

    Equal scores are merged first. Pairs inside a fine score bucket (2^-24 wide) are counted by a
    window over that bucket, pairs across the 4,096 fine buckets of a coarse one from their totals,
    and pairs across coarse buckets from theirs. So neither a heavily repeated score, nor scores that
    lie close together, nor a large table is ever sorted by one task, and the scores are read once.
    """
    by = list(by or [])
    value = F.col(score) if digits is None else F.round(F.col(score), digits)
    ties = (_both(df, y, score).groupBy(*by, value.alias("_s")).agg(
        F.sum(F.col(y).cast("bigint")).alias("pos"),
        F.sum((F.lit(1) - F.col(y)).cast("bigint")).alias("neg"))
        .withColumn("_fine", F.floor(F.col("_s") * F.lit(1 << 24)))
        .withColumn("_bucket", F.floor(F.col("_s") * F.lit(1 << 12))))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")

    def ahead(keys, order):
        w = (Window.partitionBy(*keys).orderBy(order)
             .rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(F.sum(neg).over(w), F.lit(0.0))

    fine = (ties.withColumn("_ahead", ahead([*by, "_bucket", "_fine"], "_s"))
            .groupBy(*by, "_bucket", "_fine").agg(
                F.sum(pos * (2 * F.col("_ahead") + neg)).alias("_d"),
                F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    coarse = (fine.withColumn("_ahead", ahead([*by, "_bucket"], "_fine"))
              .groupBy(*by, "_bucket").agg(F.sum(F.col("_d") + 2 * pos * F.col("_ahead")).alias("_d"),
                                           F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    across = coarse.withColumn("_ahead", ahead(by, "_bucket"))  # one row per coarse bucket
    out = across.groupBy(*by).agg(F.sum(F.col("_d") + 2 * pos * F.col("_ahead")).alias("_d"),
                                  F.sum(pos).alias("_p"), F.sum(neg).alias("_n"))
    return out.select(*by, F.try_divide(
        F.col("_d"), F.lit(2.0) * F.col("_p") * F.col("_n")).alias("auc"))


# ---- subgroups ------------------------------------------------------------------------------

def subgroup_metrics(df: DataFrame, y: str, predicted: str, groups: list[str]) -> DataFrame:
    """n, actual positives, recall and precision per value of each group column, and overall.

    Each row is turned into one row per group column plus one for "overall", which the partial
    aggregation folds back to a handful of rows per task.
    """
    keys = F.array(*[F.struct(F.lit(g).alias("dimension"),
                              F.col(g).cast("string").alias("value")) for g in groups],
                   F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value")))
    spread = df.select(F.explode(keys).alias("k"), F.col(y).alias("y"),
                       F.col(predicted).alias("predicted"))
    counts = (spread.filter(F.col("k.value").isNotNull())
              .groupBy(F.col("k.dimension").alias("dimension"), F.col("k.value").alias("value"))
              .agg(*confusion_aggregates(F.col("y"), F.col("predicted"))))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("dimension", "value", (tp + fp + fn + tn).alias("n"),
                         (tp + fn).alias("n_positive"), div0(tp, tp + fn).alias("recall"),
                         div0(tp, tp + fp).alias("precision"))


def weakest_subgroup(metrics: DataFrame) -> DataFrame:
    """Per dimension, the value with the lowest recall (first value on ties)."""
    place = F.struct("recall", "value")
    return (metrics.filter(F.col("dimension") != "overall").groupBy("dimension")
            .agg(F.min_by("value", place).alias("value"), F.min("recall").alias("recall")))


def group_thresholds(df: DataFrame, y: str, score: str, group: str) -> DataFrame:
    """Best threshold per value of a group column."""
    kept = df.filter(F.col(group).isNotNull())
    return best_threshold(threshold_sweep(kept, y, score, by=[group]), by=[group])


def mean_and_std(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population deviation over repeats."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
