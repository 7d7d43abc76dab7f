import random
import statistics

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from orderlens.operators import quantile
from orderlens.operators.category_index import IndexedPrep, category_slots
from orderlens.operators.prep import OrderPrep
from orderlens.operators.quantile import exact_medians
from orderlens.operators.split import (hash_split, sample_per_class, stratified_folds,
                                       stratified_split)


def labelled(spark, n=1003):
    return spark.range(n).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))


@pytest.mark.parametrize("size", [0.2, 0.25, 37, 1])
def test_split_is_complete_and_stratified(spark, size):
    df = labelled(spark)
    out = stratified_split(df, "y", "id", size, seed=7).collect()
    assert len(out) == 1003 and len({r["id"] for r in out}) == 1003
    test = [r for r in out if r["split"] == "test"]
    wanted = -(-1003 * size // 1) if isinstance(size, float) else size
    assert len(test) == wanted
    share = sum(r["y"] for r in out) / 1003
    assert abs(sum(r["y"] for r in test) - share * len(test)) <= 1


def test_split_does_not_depend_on_partitioning(spark):
    df = labelled(spark, 200)
    a = stratified_split(df.repartition(5), "y", "id").orderBy("id").collect()
    assert a == stratified_split(df.repartition(2), "y", "id").orderBy("id").collect()


def test_folds_keep_class_shares(spark):
    out = stratified_folds(labelled(spark), "y", "id", k=5)
    counts = {(r["fold"], r["y"]): r["count"] for r in out.groupBy("fold", "y").count().collect()}
    assert sum(counts.values()) == 1003 and {f for f, _ in counts} == set(range(5))
    for y in (0, 1):
        sizes = [counts[(f, y)] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_folds_with_fewer_rows_than_folds(spark):
    df = spark.createDataFrame([(i, 1) for i in range(3)], "id bigint, y int")
    assert stratified_folds(df, "y", "id", k=5).count() == 3


def test_hash_split_share(spark):
    n = spark.range(20_000).filter(hash_split(F.col("id"), 0.2) == "test").count()
    assert abs(n / 20_000 - 0.2) < 0.02


def test_sample_per_class(spark):
    rows = sample_per_class(labelled(spark, 20), "y", "id", 2).orderBy("y", "id").collect()
    assert [(r["y"], r["id"]) for r in rows] == [(0, 1), (0, 2), (1, 0), (1, 4)]


def test_median_is_interpolated(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (10.0, None)],
                               "a double, b double")
    assert exact_medians(df, ["a", "b"]) == {"a": 2.5, "b": None}


@pytest.mark.parametrize("n,accuracy", [(1, 10_000), (2, 10_000), (999, 100), (5000, 50)])
def test_median_of_skewed_columns(spark, n, accuracy):
    rnd = random.Random(n)
    rows = [(rnd.gauss(0, 1e6), 7.0 if rnd.random() < .4 else rnd.random() * 20,
             rnd.randrange(3), None if rnd.random() < .5 else rnd.random()) for _ in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c int, d double")
    got = exact_medians(df, ["a", "b", "c", "d"], accuracy)
    for i, c in enumerate("abcd"):
        values = [r[i] for r in rows if r[i] is not None]
        assert got[c] == (statistics.median(values) if values else None)


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(
        [(1.0, 5, "b"), (2.0, 5, "a"), (None, 5, "b"), (10.0, 5, "a"), (3.0, 5, None)],
        "x double, c int, k string")


def test_prep_statistics_and_names(train):
    model = OrderPrep(["x", "c"], ["k"]).fit(train)
    s = model.statistics()
    filled = [1.0, 2.0, 2.5, 10.0, 3.0]
    assert s["median"] == {"x": 2.5, "c": 5.0} and s["mode"] == {"k": "a"}
    assert s["mean"]["x"] == pytest.approx(statistics.fmean(filled))
    assert s["std"]["x"] == pytest.approx(statistics.pstdev(filled))
    assert s["std"]["c"] == 1.0
    assert model.feature_names() == ["x", "c", "k_a", "k_b"]


def test_prep_applies_training_numbers_only(spark, train):
    model = OrderPrep(["x", "c"], ["k"]).fit(train)
    other = spark.createDataFrame([(None, 7, "z"), (2.5, None, None)], "x double, c int, k string")
    rows = model.encoded(other, []).collect()
    centre = (2.5 - model.statistics()["mean"]["x"]) / model.statistics()["std"]["x"]
    assert list(rows[0]) == pytest.approx([centre, 2.0, 0.0, 0.0])  # unseen value: all zeros
    assert list(rows[1]) == pytest.approx([centre, 0.0, 1.0, 0.0])  # missing value: the mode
    assert model.transform(other).first()["features"].toArray().tolist() == \
        pytest.approx(list(rows[0]))


def test_prep_survives_saving_inside_a_pipeline(train, tmp_path):
    model = Pipeline(stages=[OrderPrep(["x"], ["k"])]).fit(train)
    model.write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert back.transform(train).select("features").collect() == \
        model.transform(train).select("features").collect()


def test_all_null_columns(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, k string")
    model = OrderPrep(["x"], ["k"]).fit(df)
    assert model.feature_names() == ["x"]
    assert model.transform(df).first()["features"].toArray().tolist() == [0.0]


def test_medians_with_far_outliers_are_refined_before_ranking(spark, monkeypatch):
    rnd = random.Random(11)
    near = [rnd.random() for _ in range(4000)]
    wide = near[:1990] + [1e12 * (1 + x) for x in near[:2010]]  # the bracket reaches over 10^12
    rows = [(a, b, 5.0, None if i % 3 else a * 1e-9) for i, (a, b) in enumerate(zip(near, wide))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    ranked, real = [], quantile._ranked

    def watched(rows, wanted):
        for (c, _), (lo, hi, _) in wanted.items():
            ranked.append(rows.filter(F.col(c).between(lo, hi)).count())
        return real(rows, wanted)
    monkeypatch.setattr(quantile, "_ranked", watched)
    got = exact_medians(df, ["a", "b", "c", "d"], accuracy=50, most_ranked=40)
    assert max(ranked) <= 40
    for c, values in zip("abcd", zip(*rows)):
        assert got[c] == statistics.median([v for v in values if v is not None])


def test_category_index_equals_the_literal_one(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["b", "a", "c", None]), str(rnd.randrange(30)), rnd.choice([None, 1.0, 2.5, 9.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, k string, m string, x double")
    train, other = df.filter("id < 400"), df.withColumn("k", F.when(F.col("id") % 50 == 0, F.lit("new")).otherwise(F.col("k")))
    plain = OrderPrep(["x"], ["k", "m"]).fit(train)
    wide = IndexedPrep(str(tmp_path / "c"), ["x"], ["k", "m"]).fit(train)
    names = [r["name"] for r in wide.feature_names(spark).orderBy("position").collect()]
    assert names == plain.feature_names()
    PipelineModel(stages=[wide]).write().overwrite().save(str(tmp_path / "m"))
    for model in (wide, PipelineModel.load(str(tmp_path / "m"))):
        a = {r["id"]: r["features"].toArray().tolist() for r in plain.transform(other).collect()}
        b = {r["id"]: r["features"].toArray().tolist() for r in model.transform(other).collect()}
        assert a == b


def test_many_categories_never_reach_the_driver(spark, tmp_path):
    df = spark.range(300_000).select("id", F.concat(F.lit("v"), F.col("id") % 200_000).alias("k"), F.lit(1.0).alias("x"))
    model = IndexedPrep(str(tmp_path / "c"), ["x"], ["k"]).fit(df)
    assert model.statistics()["size"] == {"k": 200_000} and len(model.getOrDefault("stats")) < 500
    row = model.transform(df.filter("id = 7")).first()["features"]
    assert row.size == 200_001 and row.numNonzeros() == 1  # the constant is centred to zero
    slots = model.slots(spark)
    assert slots.agg(F.count_distinct("slot"), F.max("slot")).first()[:] == (200_000, 199_999)
    assert slots.filter("value = 'v0'").first()["slot"] == 0
    pieces = category_slots(df.groupBy(F.lit("k").alias("feature"), F.col("k").alias("value")).count(), piece_rows=20_000)
    assert pieces.count() == 200_000
