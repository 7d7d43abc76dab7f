import random

import pytest
from pyspark.sql import functions as F

from orderlens.operators import confusion as C
from orderlens.operators import metrics as M
from orderlens.operators import profile as PR
from orderlens.schemas import CLASS_NAMES

# published matrix: rows are true classes in label order
MATRIX = [
    [825, 4, 20, 40, 2, 0, 103, 0, 5, 1],
    [2, 971, 0, 23, 1, 0, 3, 0, 0, 0],
    [13, 0, 867, 10, 50, 0, 59, 0, 1, 0],
    [10, 5, 17, 902, 22, 0, 44, 0, 0, 0],
    [1, 1, 71, 44, 776, 0, 104, 0, 3, 0],
    [0, 0, 0, 0, 0, 953, 1, 37, 2, 7],
    [113, 0, 51, 43, 75, 0, 713, 0, 5, 0],
    [0, 0, 0, 0, 0, 16, 0, 969, 1, 14],
    [2, 0, 2, 3, 1, 2, 10, 0, 979, 1],
    [0, 0, 0, 1, 1, 12, 0, 48, 1, 937],
]
PRECISION = [.8540, .9898, .8434, .8462, .8362, .9695, .6876, .9194, .9819, .9760]
RECALL = [.8250, .9710, .8670, .9020, .7760, .9530, .7130, .9690, .9790, .9370]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(t, p, n) for t, row in enumerate(MATRIX)
                                  for p, n in enumerate(row) if n], "t int, p int, n bigint")


@pytest.fixture(scope="module")
def predictions(cells):
    return cells.select(F.col("t").alias("y"), F.col("p").alias("yhat"),
                        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))


def test_published_class_metrics(cells):
    rows = M.metrics_of_cells(cells).orderBy("label").collect()
    assert [r["precision"] for r in rows] == PRECISION
    assert [r["recall"] for r in rows] == RECALL


def test_published_accuracy_and_matrix(predictions, cells):
    assert M.accuracy(predictions, "y", "yhat").first()["accuracy"] == 0.8892
    rows = C.confusion_matrix(predictions, "y", "yhat", list(range(10))).orderBy("true_label")
    assert [list(r)[1:] for r in rows.collect()] == MATRIX
    dense = C.dense_cells(cells, list(range(10)))
    assert dense.count() == 100 and dense.agg(F.sum("n")).first()[0] == 10_000


def test_published_confused_pairs(cells):
    """Shirt/T-shirt counts one direction only, so the reverse (103) does not appear."""
    rows = C.top_confused_pairs(cells, 3).collect()
    assert [(CLASS_NAMES[r["true_label"]], CLASS_NAMES[r["pred_label"]], r["n"])
            for r in rows] == [("Shirt", "T-shirt/top", 113), ("Coat", "Shirt", 104),
                               ("Coat", "Pullover", 71)]


def test_explanations_ignore_pair_order_and_have_a_default(spark, cells):
    pairs = C.top_confused_pairs(cells, 10)
    texts = {(r["true_label"], r["pred_label"]): r["explanation"]
             for r in C.explain_pairs(pairs, spark.createDataFrame(
                 [("Shirt", "T-shirt/top", "own text")], "name_a string, name_b string, text string"),
                 CLASS_NAMES).collect()}
    assert texts[(6, 0)] == "own text"
    assert any("No explanation" in t for t in texts.values())


def test_report_has_all_sections(spark, predictions, tmp_path):
    from orderlens.sources.files import write_report
    report = C.evaluation_report(predictions, "y", "yhat", CLASS_NAMES)
    rows = {(r["section"], r["line_no"]): r["text"] for r in report.collect()}
    assert rows[("accuracy", 0)] == "Test accuracy: 0.8892 (88.92%)"
    assert rows[("accuracy", 1)].startswith("Meets")
    assert rows[("per_class", 6)] == "Shirt precision=0.6876 recall=0.7130"
    assert rows[("confusion_matrix", 6)] == "Shirt,113,0,51,43,75,0,713,0,5,0"
    assert len(rows) == 2 + 10 + 10 + 2
    write_report(report, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report/section=per_class")).count() == 10


def test_sweep_counts_a_score_on_the_threshold(spark):
    df = spark.createDataFrame([(1, 0.10 + 20 * 0.02), (0, 0.3), (1, 0.95)], "y int, p double")
    rows = M.threshold_sweep(df, "y", "p").orderBy("threshold").collect()
    assert len(rows) == 41 and rows[0]["threshold"] == 0.1 and rows[-1]["threshold"] == 0.9
    assert rows[20]["threshold"] == 0.5 and rows[20]["recall"] == 1.0
    assert rows[21]["recall"] == 0.5


def brute_sweep(data):
    out = []
    for i in range(41):
        t = 0.10 + i * 0.02
        tp = sum(1 for y, p in data if p >= t and y)
        pp = sum(1 for _, p in data if p >= t)
        pos = sum(y for y, _ in data)
        out.append((round(t, 2), 2 * tp / (pp + pos) if pp + pos else 0.0,
                    tp / pos if pos else 0.0, tp / pp if pp else 0.0))
    return out


@pytest.mark.parametrize("kind", ["mixed", "grid", "no_pos", "all_pos"])
def test_sweep_equals_brute_force(spark, kind):
    rnd = random.Random(3)
    y = {"no_pos": lambda: 0, "all_pos": lambda: 1}.get(kind, lambda: rnd.randrange(2))
    p = (lambda: 0.10 + rnd.randrange(-3, 44) * 0.02) if kind == "grid" else rnd.random
    data = [(y(), p()) for _ in range(500)]
    df = spark.createDataFrame(data, "y int, p double")
    got = [tuple(r) for r in M.threshold_sweep(df, "y", "p").orderBy("threshold").collect()]
    assert got == brute_sweep(data)
    recalls = [r[2] for r in got]
    assert recalls == sorted(recalls, reverse=True)


def test_best_threshold_is_lowest_on_ties(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.05)], "y int, p double")
    assert M.best_threshold(M.threshold_sweep(df, "y", "p")).first()["threshold"] == 0.1
    grouped = df.withColumn("g", F.lit("a"))
    best = M.group_thresholds(grouped, "y", "p", "g").first()
    assert (best["threshold"], best["f1"]) == (0.1, 1.0)


def brute_auc(data):
    pos = [p for y, p in data if y]
    neg = [p for y, p in data if not y]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc(spark):
    rnd = random.Random(5)
    data = [(rnd.randrange(2), round(rnd.random(), 2)) for _ in range(300)]
    data += [(rnd.randrange(2), 0.5) for _ in range(200)]  # one score holds a large share
    df = spark.createDataFrame(data, "y int, p double")
    auc = M.roc_auc(df, "y", "p").first()["auc"]
    assert auc == pytest.approx(brute_auc(data), abs=1e-12)
    flipped = M.roc_auc(df.withColumn("p", -F.col("p")), "y", "p").first()["auc"]
    assert flipped == pytest.approx(1 - auc, abs=1e-12)
    same = spark.createDataFrame([(1, 0.3), (0, 0.3)], "y int, p double")
    assert M.roc_auc(same, "y", "p").first()["auc"] == 0.5
    single = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, p double")
    assert M.roc_auc(single, "y", "p").first()["auc"] is None


def test_counts_sum_to_rows(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "y int, yhat int")
    row = M.binary_metrics(M.confusion_counts(df, "y", "yhat")).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (1, 1, 1, 2)
    assert row["accuracy"] == 0.6 and row["f1"] == 0.5
    none = M.binary_metrics(M.confusion_counts(df.withColumn("yhat", F.lit(0)), "y", "yhat"))
    assert none.first()["precision"] == 0.0 and none.first()["f1"] == 0.0


def test_majority_prefers_the_smaller_class_on_ties(spark):
    df = spark.createDataFrame([(1,), (0,)], "y int")
    assert M.majority_class(df, "y").first()["majority"] == 0


def test_subgroups_and_weakest(spark):
    df = spark.createDataFrame([("b", 1, 0), ("b", 0, 0), ("a", 1, 0), ("c", 1, 1), (None, 1, 1)],
                               "g string, y int, yhat int")
    m = M.subgroup_metrics(df, "y", "yhat", ["g"])
    rows = {(r["dimension"], r["value"]): r for r in m.collect()}
    assert rows[("overall", "all")]["n"] == 5 and rows[("overall", "all")]["recall"] == 0.5
    assert rows[("g", "b")]["n_positive"] == 1
    assert M.weakest_subgroup(m).first()["value"] == "a"


def test_profile_and_gap(spark):
    df = spark.createDataFrame([("COD", None, 1), ("COD", 1.0, 0), ("Card", 2.0, 1),
                                ("Card", 3.0, 0)], "m string, r double, y int")
    row = PR.table_profile(df, "y", "r").first()
    assert (row["n_rows"], row["n_columns"], row["rate"], row["null_pct"]) == (4, 3, 0.5, 25.0)
    gap = PR.missing_gap(df, "r", F.col("m") == "COD").first()
    assert (gap["share_in"], gap["share_out"], gap["gap_pp"]) == (0.5, 0.0, 50.0)
    assert [r["rate"] for r in PR.rate_by(df, "m", "y").collect()] == [0.5, 0.5]
    assert [r["null_share"] for r in PR.null_share_by(df, "m", "r").collect()] == [0.5, 0.0]


def test_rows_without_score_label_or_prediction_do_not_count(spark):
    rows = [(1, .95, 1), (0, .05, 0), (0, .92, 1), (0, None, None), (None, .99, 1), (1, .93, None)]
    df = spark.createDataFrame(rows, "y int, s double, yhat int")
    whole = spark.createDataFrame([(1, .95), (0, .05), (0, .92), (1, .93)], "y int, s double")
    assert M.threshold_sweep(df, "y", "s").orderBy("threshold").collect() == \
        M.threshold_sweep(whole, "y", "s").orderBy("threshold").collect()
    assert M.roc_auc(df, "y", "s").collect() == M.roc_auc(whole, "y", "s").collect()
    assert M.accuracy(df, "y", "yhat").first()["n_rows"] == 3
    report = {r["row"]: r for r in M.classification_report(df, "y", "yhat").collect()}
    assert set(report) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert report["accuracy"]["precision"] == round(2 / 3, 4)


def test_area_of_scores_that_lie_close_together(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(2), 0.2 + rnd.randrange(300) * 1e-6) for _ in range(3000)]
    got = M.roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()["auc"]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    pairs = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert got == pytest.approx(pairs / len(pos) / len(neg), abs=1e-12)
