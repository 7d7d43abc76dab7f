import random

from pyspark.sql import functions as F

from orderlens.operators.running import (Running, carry_forward, hot_bucket, hot_keys, plain_running, range_pieces,
                                         ranked, row_numbers, running, running_over, shuffle_column)
from orderlens.sources.risk_orders import risk_orders


def skewed(spark, n=600):
    """One key holds more than a third of the rows."""
    rnd = random.Random(1)
    rows = [(0 if i % 5 < 2 else rnd.randrange(1, 40), i, rnd.choice([None, 1.0, 2.0, 5.0]))
            for i in range(n)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k bigint, i bigint, v double")


def values():
    return {
        "n": Running("count", F.lit(1), default=0),
        "s": Running("sum", F.col("v")),
        "lo": Running("min", F.col("v"), inclusive=True),
        "hi": Running("max", F.col("v")),
        "last": Running("last", F.col("v"), inclusive=True),
    }


def test_bucketed_running_equals_plain_window(spark):
    df = skewed(spark)
    hot = hot_keys(df, "k", 100)
    assert [r["k"] for r in hot.collect()] == [0]
    assert hot_keys(df, "k", 10_000) is None
    many = spark.range(400_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(
        F.col("id")).alias("k"))
    assert [r["k"] for r in hot_keys(many, "k", 20_000).collect()] == [0]  # counted on a sample
    split = running(hot_bucket(df, "k", F.floor(F.col("i") / 20), hot), ["k"], [F.col("i")],
                    "_bucket", values())
    plain = plain_running(df, ["k"], [F.col("i")], values())
    assert sorted(split.collect(), key=str) == sorted(plain.collect(), key=str)


def test_hot_key_is_spread_over_tasks(spark):
    df = skewed(spark)
    bucketed = hot_bucket(df, "k", F.floor(F.col("i") / 20), hot_keys(df, "k", 100))
    out = running(bucketed, ["k"], [F.col("i")], "_bucket", {"n": Running("count", F.lit(1))})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_bucket" in plan.split("hashpartitioning(k")[1][:40]


def test_carry_forward_with_and_without_hot_keys(spark):
    df = skewed(spark)
    want, held = {}, {}
    for k, i, v in sorted(df.collect(), key=lambda r: r["i"]):
        held[k] = v if v is not None else held.get(k)
        want[i] = held[k]
    for hot_rows in (10_000, 50):
        out = carry_forward(df, "k", "i", {"c": F.col("v")}, piece_rows=15, hot_rows=hot_rows)
        assert {r["i"]: r["c"] for r in out.collect()} == want


def test_global_rank(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"))
    out = ranked(df, [], [F.col("x")], F.floor(F.col("x") / 13), "r").collect()
    assert all(r["r"] == r["x"] + 1 for r in out) and len(out) == 500


def test_shuffle_is_a_permutation(spark):
    df = spark.range(300).select("id", (F.col("id") * 10).alias("v"))
    a = shuffle_column(df, "id", ["v"], 1).collect()
    assert sorted(r["shuffled_v"] for r in a) == sorted(r["v"] for r in a)
    assert len({r["id"] for r in a}) == 300
    assert sum(r["v"] == r["shuffled_v"] for r in a) < 20
    b = shuffle_column(df.repartition(5), "id", ["v"], 1).collect()
    assert sorted(a) == sorted(b)
    assert sorted(a) != sorted(shuffle_column(df, "id", ["v"], 2).collect())


def test_customer_history_is_the_same_for_hot_customers(spark, sf):
    plain = risk_orders(spark, sf, score=True).collect()
    split = risk_orders(spark, sf, score=True, hot_rows=5, piece_rows=100).collect()
    assert sorted(plain, key=str) == sorted(split, key=str)


def test_a_hot_null_key_is_cut_like_any_other(spark):
    df = skewed(spark).withColumn("k", F.when(F.col("k") != 0, F.col("k")))
    hot = hot_keys(df, "k", 100)
    assert [r["k"] for r in hot.collect()] == [None]
    got = running(hot_bucket(df, "k", F.floor(F.col("i") / 50), hot), ["k"], [F.col("i")], "_bucket", values())
    want = plain_running(df, ["k"], [F.col("i")], values())
    key = lambda r: r["i"]
    assert sorted((r.asDict() for r in got.collect()), key=key) == sorted((r.asDict() for r in want.collect()), key=key)


def same_rows(a, b):
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted((r.asDict() for r in a.collect()), key=key) == sorted((r.asDict() for r in b.collect()), key=key)


def test_pieces_are_bounded_and_give_the_plain_result(spark):
    """A hot key, a hot day, a null key and sparse 64-bit numbers, all in one table."""
    rnd = random.Random(7)
    turns = [rnd.randrange(-2**62, 2**62) for _ in range(899)] + [None]
    rows = [(1, t, rnd.choice([None, 1.0, 2.0])) for t in turns]
    rows += [(None, i * 2**50, 1.0) for i in range(700)] + [(i, i, 3.0) for i in range(300)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(k, "2020-01-01" if i % 4 else "2021-05-05", t, v) for i, (k, t, v) in enumerate(rows)],
                               "k bigint, day string, i bigint, v double").withColumn("day", F.to_date("day"))
    for order in (["i"], ["day", "i"]):
        got = running_over(df, "k", order, values(), hot_rows=500, piece_rows=100)
        same_rows(got, plain_running(df, ["k"], [F.col(c) for c in order], values()))
        for keys in (["k"], []):
            pieces = range_pieces(df, keys, order, 100)
            sizes = [r["count"] for r in pieces.groupBy("_bucket").count().collect()]
            assert len(sizes) >= 15 and max(sizes) <= 300
            spans = pieces.groupBy("_bucket").agg(F.min(F.struct(*keys, *order)).alias("a"),
                                                  F.max(F.struct(*keys, *order)).alias("b")).orderBy("_bucket").collect()
            low = lambda s: tuple((x is not None, x or 0) if not hasattr(x, "year") else x for x in s)
            assert all(low(x["b"]) <= low(y["a"]) for x, y in zip(spans, spans[1:]))


def test_row_numbers_over_sparse_keys(spark):
    rnd = random.Random(3)
    keys = [rnd.randrange(-2**62, 2**62) for _ in range(800)]
    df = spark.createDataFrame([(k,) for k in keys], "x bigint")
    got = {r["x"]: r["n"] for r in row_numbers(df, ["x"], "n", piece_rows=50).collect()}
    assert got == {x: n for n, x in enumerate(sorted(keys), 1)}
