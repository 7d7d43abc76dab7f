import math

from pyspark.sql import functions as F

from orderlens import functions as L


def one(spark, c, rows="(1)"):
    return spark.sql(f"SELECT * FROM VALUES {rows} t(a)").select(c.alias("x")).first()["x"]


def test_clip_keeps_null_and_takes_column_bounds(spark):
    df = spark.createDataFrame([(5.0, 3.0), (None, 3.0), (-1.0, 3.0)], "a double, b double")
    got = [r[0] for r in df.select(L.clip(F.col("a"), 0.0, F.col("b"))).collect()]
    assert got == [3.0, None, 0.0]
    assert [r[0] for r in df.select(L.clip(F.col("a"), 0.0)).collect()] == [5.0, None, 0.0]


def test_rounding_is_half_even(spark):
    assert one(spark, L.round_to(F.lit(0.5), 0)) == 0.0
    assert one(spark, L.round_to(F.lit(1.5), 0)) == 2.0


def test_ratios(spark):
    assert one(spark, L.div0(F.lit(3), F.lit(0))) == 0.0
    assert one(spark, L.safe_ratio(F.lit(3), F.lit(0))) == 0.0
    assert one(spark, L.safe_ratio(F.lit(3), F.lit(2))) == 1.5


def test_hash_uniform_matches_modular_product_for_any_key(spark):
    keys = [0, 1, 14999, 2 ** 31, 6 * 10 ** 11 + 7, 2 ** 62 + 12345]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = [r[0] for r in df.select(L.hash_uniform(F.col("k"))).collect()]
    assert got == [(k * 2654435761 % 2 ** 32) / 2 ** 32 for k in keys]


def test_first_match_follows_list_order(spark):
    df = spark.createDataFrame([("the border #4 b a",), ("none",), (None,)], "t string")
    got = [r[0] for r in df.select(L.first_match(F.lower("t"), ["order #", "b"])).collect()]
    assert got == ["order #", None, None]


def test_sentences(spark):
    text = "  Worn items (e.g. signs of use) go back.\n\nAsk us!  Why? Because.\t "
    got = one(spark, L.split_sentences(F.lit(text)))
    assert got == ["Worn items (e.g.", "signs of use) go back.", "Ask us!", "Why?", "Because."]
    assert one(spark, L.split_sentences(F.lit("  "))) == []


def test_softmax_and_argmax(spark):
    v = F.array(F.lit(1000.0), F.lit(-1000.0), F.lit(1000.0))
    assert one(spark, L.softmax(v)) == [0.5, 0.0, 0.5]
    assert one(spark, L.argmax(v)) == 0


def test_zero_vector_stays_zero(spark):
    assert one(spark, L.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, L.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]


def test_affine_and_dot(spark):
    v = F.array(F.lit(1.0), F.lit(3.0))
    assert one(spark, L.affine(v, 1.0, 2.0)) == [0.0, 1.0]
    assert one(spark, L.affine(v, [0.0, 1.0], [1.0, 4.0])) == [1.0, 0.5]
    assert one(spark, L.dot(v, v)) == 10.0


def test_risk_buckets(spark):
    df = spark.createDataFrame([(0.4999,), (0.5,), (0.6499,), (0.65,), (0.6608,), (None,)],
                               "p double")
    got = [r[0] for r in df.select(L.risk_bucket(F.col("p"), F.lit(0.5))).collect()]
    assert got == ["Low", "Medium", "Medium", "High", "High", None]
    assert one(spark, L.cut_points(F.lit(0.5))) == "Low < 0.50 <= Medium < 0.65 <= High"
    assert one(spark, L.percent_text(F.lit(0.6608))) == "66.08%"


def test_names(spark):
    assert one(spark, L.sample_name(F.lit(0), F.lit("T-shirt/top"))) == "00_t-shirt_top.png"
    assert one(spark, L.sample_name(F.lit(9), F.lit("Ankle boot"))) == "09_ankle_boot.png"
    assert one(spark, L.class_name(F.lit(1), ["a", "b"])) == "b"
    assert one(spark, L.chunk_id(F.lit(7), F.lit(0))) == "7__0"


def test_first_present_skips_empty_text(spark):
    assert one(spark, L.first_present(F.lit(""), F.lit("kept"))) == "kept"
    assert one(spark, L.first_present(F.lit("now"), F.lit("kept"))) == "now"


def test_return_logit_matches_hand_computation(spark):
    z = L.return_logit(F.lit(2), F.lit(4), F.lit("Apparel"), F.lit(35.0), F.lit("COD"), F.lit(6),
                       F.lit(1800.0), F.lit(1), F.lit(120))
    want = (-2.2 + 1.9 * 0.5 + 0.55 + 0.014 * 1.5 + 0.9 + 0.10 * 0.75 + 0.30 * 0.04 + 0.05
            - 0.15 * math.tanh(0.24))
    assert math.isclose(one(spark, z), want, rel_tol=1e-12)
    assert math.isclose(one(spark, L.sigmoid(z)), 1 / (1 + math.exp(-want)), rel_tol=1e-12)


def test_mask_and_draw_depend_on_the_key_only(spark):
    df = spark.range(10_000).select("id", F.lit(1.0).alias("c"))
    out = df.select("id", L.mask_null(F.col("c"), F.col("id"), F.lit(0.22)).alias("m"),
                    L.bernoulli(F.col("id"), F.lit(0.3)).alias("y"))
    a = out.repartition(7).orderBy("id").collect()
    assert a == out.repartition(3).orderBy("id").collect()
    assert abs(sum(r["m"] is None for r in a) / 10_000 - 0.22) < 0.02
    assert abs(sum(r["y"] for r in a) / 10_000 - 0.3) < 0.02
