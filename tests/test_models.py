import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from orderlens.operators import importance as I
from orderlens.operators import metrics as M
from orderlens.operators import models as MD
from orderlens.operators.prep import OrderPrep
from orderlens.operators.split import stratified_folds, stratified_split
from orderlens.sources import files as FS


@pytest.fixture(scope="module")
def orders(spark):
    """Label depends on x; flat is constant, k weakly related."""
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=400)
    y = (rnd.random(400) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(int)
    rows = [(i, float(x[i]), 1.0, "a" if rnd.random() < .5 else "b", int(y[i]))
            for i in range(400)]
    df = spark.createDataFrame(rows, "order_id bigint, x double, flat double, k string, "
                                     "returned int")
    return stratified_split(df, "returned", "order_id", 0.25).cache()


@pytest.fixture(scope="module")
def prep(orders):
    return OrderPrep(["x", "flat"], ["k"]).fit(orders.filter("split = 'train'"))


def newton_optimum(X, y, w, steps=50):
    """Minimiser of 0.5 |b|^2 + sum w * loss with an unpenalised intercept."""
    A = np.hstack([X, np.ones((len(X), 1))])
    ridge = np.diag([1.0] * X.shape[1] + [0.0])
    b = np.zeros(A.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-A @ b))
        grad = A.T @ (w * (p - y)) + ridge @ b
        b -= np.linalg.solve((A * (w * p * (1 - p))[:, None]).T @ A + ridge, grad)
    return b


def test_logistic_reaches_the_unaveraged_optimum(orders, prep):
    train = prep.transform(orders.filter("split = 'train'"))
    model = MD.fit_logistic(train)
    rows = train.select("features", "returned").collect()
    X = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["returned"] for r in rows])
    n = np.bincount(y)
    want = newton_optimum(X, y, len(y) / (2 * n[y]))
    assert np.allclose(model.coefficients.toArray(), want[:-1], atol=1e-4)
    assert abs(model.intercept - want[-1]) < 1e-4


def test_reloaded_model_gives_the_same_probabilities(orders, prep, tmp_path):
    model = PipelineModel(stages=[prep, MD.fit_logistic(
        prep.transform(orders.filter("split = 'train'")))])
    row = FS.reload_parity(model, orders, str(tmp_path / "m"), "order_id").first()
    assert row["n_rows"] == 400 and row["max_diff"] == 0.0
    scored = MD.score_return_risk(orders, model, 0.5)
    assert set(orders.columns) < set(scored.columns) and "probability" not in scored.columns
    assert scored.filter("return_probability is null or risk_bucket is null").count() == 0


def test_forest_importances(spark, orders, prep):
    model = MD.fit_forest(prep.transform(orders.filter("split = 'train'")), trees=10, depth=3)
    test = prep.transform(orders.filter("split = 'test'"))
    names = prep.feature_names()
    impurity = I.impurity_importance(spark, model, names)
    assert impurity.first()["feature"] == "x"
    perm = I.permutation_importance(model, test, names, key="order_id", label="returned",
                                    repeats=3)
    rows = {r["feature"]: r for r in perm.collect()}
    assert len(rows) == 4
    assert rows["flat"]["perm_importance_mean"] == 0.0  # a constant column cannot matter
    assert rows["x"]["perm_importance_mean"] > 0.1
    table = I.importance_comparison(impurity, perm, top=3).collect()
    assert len(table) == 3 and sum(r["lost_most"] for r in table) == 1


def test_grid_search_prepares_inside_each_fold(orders):
    train = stratified_folds(orders.filter("split = 'train'"), "returned", "order_id", 3)
    best, table = MD.grid_search(train, k=3, trees=(3,), depths=(2, None),
                                 prep=OrderPrep(["x", "flat"], ["k"]))
    assert table.count() == 2 and MD.best_params(table).count() == 1
    assert isinstance(best.stages[0].statistics(), dict)
    gap = MD.generalisation_gap(MD.best_params(table), 0.5).first()
    assert gap["gap"] == abs(gap["cv_auc"] - 0.5)


def test_a_search_goes_on_where_it_stopped(spark, orders, tmp_path, monkeypatch):
    train = stratified_folds(orders.filter("split = 'train'"), "returned", "order_id", 3)
    options = dict(k=3, trees=(2, 3), depths=(2,), prep=OrderPrep(["x", "flat"], ["k"]))
    search = MD.GridSearch(str(tmp_path / "s"), **options)
    ran, score = [], MD.GridSearch._score

    def counted(self, learn, held, fold, position):
        if len(ran) == 4:
            raise RuntimeError("lost")
        ran.append((fold, position))
        score(self, learn, held, fold, position)
    monkeypatch.setattr(MD.GridSearch, "_score", counted)
    with pytest.raises(RuntimeError):
        search.run(train)
    monkeypatch.setattr(MD.GridSearch, "_score", lambda self, learn, held, fold, position: (
        ran.append((fold, position)), score(self, learn, held, fold, position)))
    best, table = MD.GridSearch(str(tmp_path / "s"), **options).run(train)
    assert sorted(ran) == [(f, p) for f in range(3) for p in range(2)]  # nothing ran twice
    areas = {(r["fold"], r["position"]): r["auc"] for r in search.areas(train).collect()}
    assert len(ran) == 6 and len(areas) == 6
    for r in table.collect():
        assert r["cv_auc"] == pytest.approx(sum(areas[f, r["position"]] for f in range(3)) / 3, abs=1e-12)
    again = MD.GridSearch(str(tmp_path / "s"), **options).run(train)[0]
    a, b = (m.transform(orders).select("order_id", MD.probability().alias("p")).orderBy("order_id").collect()
            for m in (best, again))
    assert a == b and len(ran) == 6


def test_baseline_predicts_the_majority(orders):
    out = MD.baseline_majority(orders, orders)
    assert [r[0] for r in out.select("prediction").distinct().collect()] == [0]
    assert M.binary_metrics(M.confusion_counts(out, "returned", "prediction")).first()["f1"] == 0.0


def test_class_weights_are_balanced(orders):
    weighted = MD.with_class_weights(orders).groupBy("returned").agg(F.sum("weight").alias("w"))
    assert [r["w"] for r in weighted.collect()] == pytest.approx([200.0, 200.0])


def test_head_and_plugged_in_model_agree(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    head = MD.fit_linear_head(vectors, reg=0.1, max_iter=20)
    weights, bias = head.coefficientMatrix.toArray().T, head.interceptVector.toArray()

    def make_predict_fn():
        return lambda batch: (batch @ weights + bias).astype("float32")

    from orderlens.functions import argmax
    a = MD.apply_linear_head(vectors, head).select("vec_id", "predicted")
    b = MD.score_vectors(vectors, make_predict_fn, batch_size=32).select(
        "vec_id", argmax(F.col("logits")).alias("plugged"))
    joined = a.join(b, "vec_id")
    assert joined.count() == vectors.count()
    assert joined.filter("predicted = plugged").count() >= vectors.count() - 1


def test_predict_class(spark):
    df = spark.createDataFrame([([0.1, 0.45, 0.45],)], "probs array<double>")
    row = MD.predict_class(df, ["a", "b", "c"]).first()
    assert (row["predicted_category"], row["confidence"]) == ("b", 0.45)


def test_selection_and_gate(spark):
    schema = "stage string, step int, metric double, path string"
    rows = [("head", 1, .88, "h1"), ("head", 2, .90, "h2"), ("head", 3, .90, "h3")]
    assert MD.select_artifact(spark.createDataFrame(rows, schema)).first()["path"] == "h2"
    rows.append(("finetuned", 1, .70, "f"))
    assert MD.select_artifact(spark.createDataFrame(rows, schema)).first()["path"] == "f"
    with pytest.raises(ValueError):
        MD.select_artifact(spark.createDataFrame([], schema))
    got = MD.gate(spark.createDataFrame([(0.8,), (0.7999,)], "accuracy double")).collect()
    assert [r["passed"] for r in got] == [True, False]


def test_linear_head_on_separable_vectors(spark):
    rows = [(i, [float(i % 3 == c) for c in range(3)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>, label int")
    out = MD.apply_linear_head(df, MD.fit_linear_head(df))
    assert M.accuracy(out, "label", "predicted").first()["accuracy"] == 1.0
    assert out.select(array_to_vector("probs")).count() == 60


def test_newton_steps_reach_the_optimum_of_the_library_fit(spark, orders, prep):
    from orderlens.operators.logistic import newton_logistic

    train = MD.with_class_weights(orders.filter("split = 'train'"))
    encoded = prep.encoded(train, ["returned", "weight"])
    names = [c for c in encoded.columns if c not in ("returned", "weight")]
    plain = encoded.toDF("returned", "weight", *[f"f{i}" for i in range(len(names))])
    fit = newton_logistic(plain.repartition(3), [f"f{i}" for i in range(len(names))], "returned", "weight")
    model = MD.fit_logistic(prep.transform(orders.filter("split = 'train'")))
    assert fit.steps < 15
    assert fit.coefficients == pytest.approx(model.coefficients.toArray(), abs=1e-3)
    x = np.array([[*r[2:]] for r in plain.collect()], float)
    y, w = np.array([[r[0], r[1]] for r in plain.collect()], float).T
    p = 1 / (1 + np.exp(-(x @ fit.coefficients + fit.intercept)))
    assert np.abs(x.T @ (w * (p - y)) + fit.coefficients).max() < 1e-6 and abs((w * (p - y)).sum()) < 1e-6
    nulls = plain.unionByName(plain.limit(3).withColumn("f0", F.lit(None).cast("double")))
    assert newton_logistic(nulls, [f"f{i}" for i in range(len(names))], "returned", "weight").intercept == pytest.approx(fit.intercept, abs=1e-8)


def test_permutation_scores_a_row_once_per_value_and_matches_plain_permutations(spark):
    from hashlib import md5

    from orderlens.plans.fixed_models import LinearScore

    rnd = np.random.default_rng(5)
    n, repeats = 60, 33  # more repeats than one number has bits
    x = np.stack([rnd.integers(0, 2, n), rnd.integers(0, 3, n), rnd.random(n)], axis=1).astype(float)
    y = (rnd.random(n) < 0.2 + 0.5 * x[:, 0]).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], "k bigint, y int, a array<double>")
    test, weights, fed, parts = df.select("k", "y", array_to_vector("a").alias("features")), [0.5, 0.25, 0.125], [], []

    class Counted(LinearScore):
        def transform(self, df):
            fed.append(df.count())
            parts.append(df.rdd.getNumPartitions())
            return super().transform(df)

    got = {r[0]: r[1:] for r in I.permutation_importance(
        Counted(weights), test, ["two", "three", "real"], key="k", label="y", repeats=repeats).collect()}
    assert fed[0] <= n * 2 * (2 + 3 + repeats) and fed[1] == n  # two numbers of bits, not rows x columns x repeats
    assert parts[0] >= spark.sparkContext.defaultParallelism  # however few bytes they have

    def area(score):
        s = np.round(score, 6)
        d = s[y == 1][:, None] - s[y == 0][None, :]
        return ((d > 0) + 0.5 * (d == 0)).mean()

    def order(tail):
        return sorted(range(n), key=lambda i: (md5(f"{i}:{tail}".encode()).hexdigest(), i))
    for j, name in enumerate(["two", "three", "real"]):
        drops = []
        for repeat in range(repeats):
            shuffled = x.copy()
            shuffled[order("slot"), j] = x[order(f"42:{repeat}"), j]
            drops.append(area(x @ weights) - area(shuffled @ weights))
        assert got[name] == pytest.approx((np.mean(drops), np.std(drops)), abs=1e-12)
