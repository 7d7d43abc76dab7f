"""Dense confusion matrices, most-confused pairs and their explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import class_name, pair_high, pair_low
from .metrics import cell_counts

NO_TEXT = "No explanation is on record for %s and %s."


def confusion_matrix(df: DataFrame, y: str, predicted: str, labels: list) -> DataFrame:
    """One row per true label, one column `p_<label>` per predicted label, zeros included."""
    return matrix_of_cells(cell_counts(df, y, predicted), labels)


def matrix_of_cells(cells: DataFrame, labels: list) -> DataFrame:
    counts = cells.groupBy("t").agg(*[
        F.sum(F.when(F.col("p") == label, F.col("n")).otherwise(F.lit(0))).alias(f"p_{label}")
        for label in labels])
    spine = cells.sparkSession.createDataFrame([(label,) for label in labels], ["label"])
    spine = spine.select(F.col("label").cast(cells.schema["t"].dataType).alias("label"))
    return (F.broadcast(counts).join(spine, F.col("t") == F.col("label"), "right")
            .select(F.col("label").alias("true_label"),
                    *[F.coalesce(F.col(f"p_{label}"), F.lit(0)).alias(f"p_{label}")
                      for label in labels]))


def dense_cells(cells: DataFrame, labels: list) -> DataFrame:
    """Long form of the matrix: every (t, p) pair of labels with its count, 0 where none."""
    values = F.array(*[F.lit(label) for label in labels])
    spine = (cells.sparkSession.range(1).select(F.explode(values).alias("true_label"))
             .withColumn("pred_label", F.explode(values)))
    # the counts have at most one row per pair of classes
    return (spine.join(F.broadcast(cells), (F.col("t") == F.col("true_label"))
                       & (F.col("p") == F.col("pred_label")), "left")
            .select("true_label", "pred_label", F.coalesce("n", F.lit(0)).alias("n")))


def top_confused_pairs(cells: DataFrame, n: int = 2) -> DataFrame:
    """The n unordered pairs of distinct classes with the largest one-direction count."""
    best = (cells.filter((F.col("t") != F.col("p")) & (F.col("n") > 0))
            .groupBy(pair_low(F.col("t"), F.col("p")), pair_high(F.col("t"), F.col("p")))
            .agg(F.max(F.struct("n", "t", "p")).alias("b")))
    return (best.select(F.col("b.t").alias("true_label"), F.col("b.p").alias("pred_label"),
                        F.col("b.n").alias("n"))
            .orderBy(F.desc("n"), F.desc("true_label"), F.desc("pred_label")).limit(n))


def label_texts(df: DataFrame, label: str, names: list[str], reach: int) -> DataFrame:
    """(name_a, name_b, text): how often both classes occur, for classes at most `reach` apart.

    A table of texts that the data itself gives; any table of these columns explains pairs.
    """
    n = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    a, b = n.select(F.col("label").alias("a"), F.col("n").alias("n_a")), n.select(
        F.col("label").alias("b"), F.col("n").alias("n_b"))
    near = a.join(F.broadcast(b), (F.col("b") > F.col("a")) & (F.col("b") - F.col("a") <= reach))  # one row per class
    name_a, name_b = class_name(F.col("a"), names), class_name(F.col("b"), names)
    return near.select(name_a.alias("name_a"), name_b.alias("name_b"), F.format_string(
        "%d rows are %s, %d are %s.", "n_a", name_a, "n_b", name_b).alias("text"))


def explain_pairs(pairs: DataFrame, texts: DataFrame | None = None,
                  names: list[str] | None = None) -> DataFrame:
    """Adds `explanation` to pairs: the text that `texts` (name_a, name_b, text) has for the
    unordered pair, else a neutral sentence."""
    true_name, pred_name = F.col("true_label"), F.col("pred_label")
    if names is not None:
        true_name, pred_name = class_name(true_name, names), class_name(pred_name, names)
    named = (pairs.withColumn("true_name", true_name.cast("string"))
             .withColumn("pred_name", pred_name.cast("string")))
    neutral = F.format_string(NO_TEXT, "true_name", "pred_name")
    if texts is None:
        return named.select("true_label", "pred_label", "n", neutral.alias("explanation"))
    keyed = texts.select(pair_low(F.col("name_a"), F.col("name_b")).alias("_lo"),
                         pair_high(F.col("name_a"), F.col("name_b")).alias("_hi"), "text")
    found = named.join(
        F.broadcast(keyed),  # one row per pair of class names
        (pair_low(F.col("true_name"), F.col("pred_name")) == F.col("_lo"))
        & (pair_high(F.col("true_name"), F.col("pred_name")) == F.col("_hi")), "left")
    return found.select("true_label", "pred_label", "n", F.coalesce(
        F.col("text"), neutral).alias("explanation"))


def evaluation_report(df: DataFrame, y: str, predicted: str, names: list[str],
                      bar: float = 0.80, n_pairs: int = 2, texts: DataFrame | None = None
                      ) -> DataFrame:
    """Long-form report (section, line_no, text): accuracy, matrix, per-class metrics, pairs."""
    from .metrics import metrics_of_cells

    labels = list(range(len(names)))
    cells = cell_counts(df, y, predicted)
    total = cells.agg(F.sum("n").alias("n"), F.sum(
        F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0))).alias("hits"))
    acc = (F.col("hits") / F.col("n"))
    head = total.select(
        F.lit("accuracy").alias("section"),
        F.posexplode(F.array(
            F.format_string("Test accuracy: %.4f (%.2f%%)", acc, acc * 100),
            F.when(acc >= bar, F.lit(f"Meets the required accuracy of {bar:.2f}."))
            .otherwise(F.lit(f"Below the required accuracy of {bar:.2f}."))))
        .alias("line_no", "text"))
    matrix = matrix_of_cells(cells, labels).select(
        F.lit("confusion_matrix").alias("section"), F.col("true_label").alias("line_no"),
        F.concat_ws(",", class_name(F.col("true_label"), names),
                    *[F.col(f"p_{label}") for label in labels]).alias("text"))
    per_class = metrics_of_cells(cells).select(
        F.lit("per_class").alias("section"), F.col("label").alias("line_no"),
        F.format_string("%s precision=%.4f recall=%.4f", class_name(F.col("label"), names),
                        "precision", "recall").alias("text"))
    pairs = explain_pairs(top_confused_pairs(cells, n_pairs), texts, names)
    order = Window.partitionBy().orderBy(F.desc("n"), F.desc("true_label"), F.desc("pred_label"))
    pair_lines = pairs.select(
        F.lit("confused_pairs").alias("section"),
        (F.row_number().over(order) - 1).alias("line_no"),  # n_pairs rows
        F.format_string("True=%s Predicted=%s count=%d: %s", class_name(F.col("true_label"), names),
                        class_name(F.col("pred_label"), names), "n", "explanation").alias("text"))
    return (head.unionByName(matrix).unionByName(per_class).unionByName(pair_lines))
