import glob
import math
import os
import zlib

import duckdb
import numpy as np
import pytest
from llm_helpers import WORD, components, edge_documents
from pyspark.sql import functions as F
from test_llm_text_stages import check_packing, repeated_lines_go

import corpus_pipeline
from orderlens.llm import mix, permutation, quality, urls
from orderlens.llm.base import read, stored
from orderlens.llm.queries import op5_mix, op9_quality, op10_permutation_search, oracle_sql, queries
from tools.compare import rows_of


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    db = duckdb.connect()
    for path in glob.glob(os.path.join(sf, "*.parquet")):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df, cursor = queries()[name](spark, sf), db.execute(oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == \
        rows_of([c[0] for c in cursor.description], cursor.fetchall())


RULES = [("org", "/", "allow"), ("b.org", "/x", "block"), ("a.b.org", "/x/y", "allow"), ("", "/zz", "block"),
         ("b.org", "/x", "allow"), ("com", "", "block"), ("ab.org", "/", "block")]
URLS = ["http://org/", "https://A.B.ORG/x/yz?q", "http://b.org/x#f", "http://q.b.org/x/", "http://cb.org/x",
        "http://c.com", "http://c.com?x=/y", "nothing", None, "", "x://h.net/zz/1", "http://a.b.org:80/x/y",
        "http://ab.org/", "http://z.ab.org/x", "http://b.org", "http://a.b.org/x/y://b.com/"]


def verdict(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), v == "block", len(h), h + p, v) for h, p, v in RULES
            if (host == h or h == "" or host.endswith("." + h)) and path.startswith(p)
            and not (v == "allow" and (h, p, "block") in RULES)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_nested_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 3)],
                                  "page_id long, url string, host string, stack string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for n in (4, 37):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = urls.url_filter(pages, rules).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == \
            {i: verdict(u) for i, u in enumerate(URLS * 3)}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert urls.url_filter(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.url_filter(pages, rules.limit(0)).collect()} == {"allow"}


def water_level(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not full:
            target.update({s: left * weight[s] / total for s in open_})
            break
        target.update({s: cap * sizes[s] for s in full})
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def check_mix(rows):
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    target = water_level(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1


def test_mix_meets_targets_and_repeats(spark, sf):
    first = op5_mix(spark, sf).collect()
    check_mix(first)
    texts = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    assert all(r.size == len(WORD.findall(texts[r.doc_id])) for r in first)
    docs = read(spark, sf, "documents").repartition(7, "n_chars")
    again = {r.doc_id: r.taken for r in mix.mix(docs).collect()}
    assert again == {r.doc_id: r.taken for r in first}


def test_mix_of_edge_rows(spark):
    rows = mix.mix(edge_documents(spark), shards=3).collect()
    assert len(rows) == 13
    check_mix(rows)
    assert mix.mix(edge_documents(spark).filter("doc_id < 0")).count() == 0


def test_tree_splits_quotas_exactly_and_like_the_distribution(spark):
    quotas = spark.createDataFrame([(1, 1000), (2, 40), (3, 3000), (4, 0), (5, 1)], "rank int, quota long")
    lefts = []
    for seed in range(12):
        rows = mix.split_tree(quotas, 2, seed * 10).collect()
        for rank, quota in ((1, 1000), (2, 40), (3, 3000), (4, 0), (5, 1)):
            own = sorted((r.start, r.end) for r in rows if r.rank == rank)
            assert own[0][0] == 0 and own[-1][1] == quota and all(a[1] == b[0] for a, b in zip(own, own[1:]))
        sizes = [sum(r.end - r.start for r in rows if r.shard == s) for s in range(4)]
        assert max(sizes) - min(sizes) <= 1
        lefts.append(sum(r.end - r.start for r in rows if r.rank == 1 and r.shard < 2))
    # hypergeometric: mean 500, standard deviation 13.7
    assert abs(np.mean(lefts) - 500) < 5 * 13.7 / 12 ** 0.5 and 4 < np.std(lefts) < 30


def log_mass(n, m, k):
    """Exact log probabilities of all values, by gamma functions."""
    lf = math.lgamma
    choose = lambda a, b: lf(a + 1) - lf(b + 1) - lf(a - b + 1)
    low, high = max(0, k - (n - m)), min(m, k)
    return low, np.array([choose(m, x) + choose(n - m, k - x) - choose(n, k) for x in range(low, high + 1)])


def test_hat_covers_every_table():
    for n in range(2, 41):
        for m in range(1, n // 2 + 1):
            for k in range(1, n // 2 + 1):
                low, logs = log_mass(n, m, k)
                part = m / n
                sd = math.sqrt(k * part * (1 - part) * (n - k) / (n - 1) + 0.5)
                x = low + np.arange(len(logs))
                away = np.maximum(abs(x - k * part - 0.5), abs(x + 1 - k * part - 0.5))
                assert (away * np.exp((logs - logs.max()) / 2) <= (mix.WIDE * sd + mix.WIDER) / 2 + 1e-9).all()


@pytest.mark.parametrize("n, m, k", [(10, 3, 5), (50, 45, 30), (1000, 400, 900), (40_000, 9_000, 20_000),
                                     (1_000_000, 700_000, 500_000)])
def test_draws_follow_the_exact_distribution(spark, n, m, k):
    draws = 20_000
    got = spark.range(draws).select(mix._hypergeometric(F.lit(n), F.lit(m), F.lit(k), F.xxhash64("id")).alias("x"))
    counts = {r.x: r["count"] for r in got.groupBy("x").count().collect()}
    low, logs = log_mass(n, m, k)
    assert min(counts) >= low and max(counts) < low + len(logs)
    seen = np.cumsum([counts.get(low + i, 0) for i in range(len(logs))]) / draws
    assert abs(seen - np.cumsum(np.exp(logs))).max() < 1.95 / math.sqrt(draws)  # Kolmogorov, 0.1 %


def test_draws_from_very_many(spark):
    n, m, k, draws = 40 * 10 ** 12, 13 * 10 ** 12, 20 * 10 ** 12, 4_000
    got = spark.range(draws).select(mix._hypergeometric(F.lit(n), F.lit(m), F.lit(k), F.xxhash64("id")).alias("x"))
    x = np.array([r.x for r in got.collect()], float)
    sd = math.sqrt(k * (m / n) * (1 - m / n) * (n - k) / (n - 1))
    z = np.sort((x - k * m / n) / sd)
    normal = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])
    assert abs(normal - (np.arange(draws) + 0.5) / draws).max() < 1.95 / math.sqrt(draws)


def test_draws_without_a_choice(spark):
    rows = spark.createDataFrame([(0, 0, 0), (5, 0, 3), (5, 5, 3), (5, 2, 5), (5, 2, 0), (1, 1, 1)], "n long, m long, k long")
    got = rows.select("n", "m", "k", mix._hypergeometric(F.col("n"), F.col("m"), F.col("k"), F.lit(7)).alias("x")).collect()
    assert [r.x for r in got] == [0, 0, 3, 2, 0, 1]


def test_classifier_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in op9_quality(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.quality for r in read(spark, "/root/testdata/sf0.1", "labels").collect()}
    held = [(rows[i], q) for i, q in labels.items() if rows[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert np.mean([r.predicted == q for r, q in held]) > 0.97
    assert np.mean([r.predicted for r, q in held if q == 1]) > 0.99
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_classifier_does_not_see_held_out_labels(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in quality.quality_classifier(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_classifier_of_edge_rows(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (6, None), (99, 0), (8, 0), (7, 0)], "doc_id long, quality int")
    rows = quality.quality_classifier(docs, labels).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.quality_classifier(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_classifier(docs.filter("doc_id < 0"), labels).count() == 0
    assert quality.isotonic(np.array([.1, .5, .3, .9]), np.array([1., 1, 3, 1])).tolist() == [.1, .35, .35, .9]


def nearest(ids, x, own, k):
    gap = np.sqrt(((x - x[own]) ** 2).sum(1))
    gap[own] = np.inf
    order = np.lexsort((ids, gap))[:k]
    return [(int(ids[i]), gap[i]) for i in order if i != own]


def test_neighbour_recall_and_scores(spark, sf01):
    rows = op10_permutation_search(spark, sf01).collect()
    table = read(spark, sf01, "embeddings").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    hit = total = 0
    for own in np.flatnonzero(ids % 100 == 0):
        want = nearest(ids, x, own, 10)
        got = sorted((r for r in rows if r.query_id == ids[own]), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 11))
        for r in got:
            assert r.score == pytest.approx(np.sqrt(((x[ids == r.vec_id][0] - x[own]) ** 2).sum()), abs=1e-12)
        hit += len({r.vec_id for r in got} & {i for i, _ in want})
        total += 10
    assert hit / total >= 0.9


def test_neighbours_of_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(300)]
    rows += [(500, None), (501, [0.0, 0.0, 0.0]), (502, [1.0, None, 2.0]), (503, [1.0, float("nan"), 2.0]),
             (504, [1.0, float("inf"), 2.0]), (505, [1.0]), (None, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = permutation.permutation_search(vectors, vectors, block_rows=64, query_rows=100, share=1.0).collect()
    kept = [r for r in rows[:340]]
    ids, x = np.array([r[0] for r in kept]), np.array([r[1] for r in kept])
    assert {r.query_id for r in got} == set(ids.tolist())
    for own in range(len(ids)):
        mine = sorted((r for r in got if r.query_id == ids[own]), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == [i for i, _ in nearest(ids, x, own, 10)]
    few = permutation.permutation_search(vectors.filter("vec_id < 4"), vectors.filter("vec_id = 1"))
    assert [r.vec_id for r in few.orderBy("rank").collect()] == [0, 2, 3]
    assert permutation.permutation_search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_pipeline_stages_equal_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    scored = {r.doc_id: r.predicted for r in quality.quality_classifier(docs, read(spark, sf, "labels")).collect()}
    kept = stored(stages["quality"](spark, docs, sf), "t1")
    assert {r.doc_id: r.text for r in kept.collect()} == {i: t for i, t in texts.items() if scored[i]}
    want = {i: t for i, t in repeated_lines_go({i: t for i, t in texts.items() if scored[i]}).items()
            if t == texts[i] or WORD.search(t)}
    cleaned = stored(stages["lines"](spark, kept, sf), "t2")
    assert {r.doc_id: (r.text, r.n_chars) for r in cleaned.collect()} == {i: (t, len(t)) for i, t in want.items()}
    root, _ = components(want, 5, 80)
    single = stored(stages["near_duplicates"](spark, cleaned, sf), "t3")
    assert {r.doc_id for r in single.collect()} == {i for i in want if root[i] == i}
    mixed = stored(stages["mix"](spark, single, sf), "t4")
    assert mixed.columns == docs.columns == single.columns
    size, taken, most = {}, {}, {}
    for r in single.collect():
        n = len(WORD.findall(r.text))
        size[r.source] = size.get(r.source, 0) + n
        most[r.source] = max(most.get(r.source, 0), n)
    out = mixed.collect()
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + len(WORD.findall(r.text))
    for s, target in water_level(size).items():
        assert abs(taken.get(s, 0) - target) <= most[s]
    packed = stages["pack"](spark, mixed, sf).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in out])
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_pipeline_stages_take_edge_rows(spark, sf):
    for docs in (edge_documents(spark), edge_documents(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, sf), name)
        docs.count()


def test_pipeline_decides_by_rows_not_ids(spark, sf):
    """Copies under one id, without an id, and one id with two texts."""
    rng = np.random.default_rng(5)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(5)]
    shared = "\n".join(" ".join(f"s{x}" for x in rng.integers(0, 10**6, 20)) for _ in range(3))
    rows = [(3, text[0]), (3, text[0]), (None, text[0]), (None, text[1]), (None, text[1]), (4, text[2]), (5, text[2]),
            (5, text[3]), (6, text[4])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, stored(docs, "t5"), sf).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted(
        [("3", text[0]), ("None", text[1]), ("4", text[2]), ("5", text[3]), ("6", text[4])])
    lined = spark.createDataFrame([(i, f"{t}\n{shared}", "en", "a", 0) for i, t in
                                   [(7, text[0]), (7, text[1]), (None, text[2]), (None, text[3]), (8, text[4])]], docs.schema)
    got = {r.text for r in stages["lines"](spark, stored(lined, "t6"), sf).collect()}
    assert sum(shared in t for t in got) == 1 and {t.split("\n")[0] for t in got} == set(text)
