import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.operators.topk import block_plan, exact_top_k


def frame(spark, vecs, ids, extra="x"):
    rows = [(i, v.tolist(), f"{extra}{i}") for i, v in zip(ids, vecs)]
    kind = "string" if isinstance(ids[0], str) else "bigint"
    return spark.createDataFrame(rows, f"id {kind}, v array<double>, tag string")


def brute(qids, q, iids, items, k, exclude=False):
    out = {}
    for i, qv in zip(qids, q):
        scored = sorted((-round(float(qv @ v), 6), j) for j, v in zip(iids, items)
                        if not (exclude and i == j))
        out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def collect(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
        assert r["tag"] == f"x{r['item_id']}"
    return out


# limits chosen so that the query side, the item side or neither counts as small
PATHS = {"queries": dict(small_rows=1000), "items": None, "blocks": dict(small_rows=3,
                                                                         block_rows=17)}


@pytest.mark.parametrize("path", ["queries", "items", "blocks"])
@pytest.mark.parametrize("text_ids", [False, True])
def test_all_paths_equal_brute_force(spark, path, text_ids):
    rnd = np.random.default_rng(4)
    items = rnd.integers(-2, 3, (60, 4)).astype(float)  # many exact ties
    items[::3] = items[0]                               # a third are copies of one vector
    items[5] = 0.0
    q = rnd.integers(-2, 3, (90 if path == "items" else 40, 4)).astype(float)
    name = (lambda i: f"c__{i}") if text_ids else int
    iids, qids = [name(i) for i in range(len(items))], [name(i) for i in range(len(q))]
    corpus = frame(spark, items, iids).repartition(5)
    queries = frame(spark, q, qids).repartition(3)
    options = PATHS[path] or dict(small_rows=70)
    got = exact_top_k(queries, corpus, 3, query_id="id", query_vec="v", item_id="id",
                      item_vec="v", carry=["tag"], **options)
    assert collect(got) == brute(qids, q, iids, items, 3)


def test_excluding_the_vector_itself(spark):
    rnd = np.random.default_rng(9)
    v = rnd.normal(size=(50, 8))
    ids = list(range(50))
    df = frame(spark, v, ids)
    for options in (dict(), dict(small_rows=5, block_rows=11)):
        got = exact_top_k(df, df, 4, query_id="id", query_vec="v", item_id="id", item_vec="v",
                          carry=["tag"], exclude_self=True, **options)
        have = collect(got)
        want = brute(ids, v, ids, v, 4, exclude=True)
        assert {k: [i for i, _ in x] for k, x in have.items()} == \
            {k: [i for i, _ in x] for k, x in want.items()}


def test_fewer_items_than_k_and_empty_sides(spark):
    v = np.eye(2)
    df = frame(spark, v, [0, 1])
    run = dict(query_id="id", query_vec="v", item_id="id", item_vec="v", carry=["tag"])
    assert exact_top_k(df, df, 5, **run).count() == 4
    assert exact_top_k(df.filter("id > 9"), df, 5, **run).count() == 0
    assert exact_top_k(df, df.filter("id > 9"), 5, **run).count() == 0


def test_float_vectors_are_scored_as_doubles(spark, sf):
    from orderlens.functions import dot
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    top = exact_top_k(e, e, 1, query_id="vec_id", query_vec="embedding", item_id="vec_id",
                      item_vec="embedding", exclude_self=True)
    a = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("x"))
    b = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("y"))
    check = top.join(a, "query_id").join(b, "item_id").select(
        F.max(F.abs(F.col("score") - dot(F.col("x"), F.col("y")))))
    assert check.first()[0] < 1e-6


def test_null_vectors_give_no_hits_and_ragged_ones_an_error(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [1.0, None]), (4, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    run = dict(query_id="id", query_vec="v", item_id="id", item_vec="v")
    for small in (100, 1):
        hits = exact_top_k(df, df, 5, small_rows=small, **run).collect()
        assert {(r["query_id"], r["item_id"]) for r in hits} == {(0, 0), (0, 4), (4, 0), (4, 4)}
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0, 3.0])], "id bigint, v array<double>")
    with pytest.raises(Exception, match="different lengths"):
        exact_top_k(ragged, ragged, 1, **run).collect()


def clustered(rows, clusters, width, seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(clusters, width))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    v = centres[rnd.integers(0, clusters, rows)] + rnd.normal(scale=0.01, size=(rows, width))
    return v / np.linalg.norm(v, axis=1)[:, None]


def test_blocks_that_cannot_hold_a_hit_are_skipped(spark):
    items, asked = clustered(1500, 12, 16, 1), clustered(400, 12, 16, 1)[:300]
    corpus, queries = frame(spark, items, list(range(1500))), frame(spark, asked, list(range(300)))
    q = queries.select(F.col("id").alias("query_id"), F.col("v").alias("_qv"))
    c = corpus.select(F.col("id").alias("item_id"), F.col("v").alias("_iv"))
    plan = block_plan(q, c, 3, block_rows=60)
    n_blocks, n_met = plan.blocks.count(), plan.met.count()
    assert n_blocks > 10 and n_met < 0.5 * 300 * (n_blocks - 1)  # the full product meets all of them
    assert plan.items.groupBy("block", "part").count().agg(F.max("count")).first()[0] < 200
    got = exact_top_k(queries, corpus, 3, query_id="id", query_vec="v", item_id="id", item_vec="v", carry=["tag"],
                      small_rows=10, block_rows=60)
    assert collect(got) == brute(list(range(300)), asked, list(range(1500)), items, 3)


def test_blocks_with_one_vector_for_a_third_and_fewer_items_than_k(spark):
    rnd = np.random.default_rng(2)
    items = rnd.normal(size=(90, 5))
    items[:30] = items[0]
    df = frame(spark, items, list(range(90)))
    run = dict(query_id="id", query_vec="v", item_id="id", item_vec="v", carry=["tag"], small_rows=2)
    got = collect(exact_top_k(df, df, 4, block_rows=8, exclude_self=True, **run))
    assert got == brute(list(range(90)), items, list(range(90)), items, 4, exclude=True)
    few = frame(spark, items[:5], list(range(5)))
    assert collect(exact_top_k(df, few, 9, block_rows=2, **run)) == brute(list(range(90)), items, list(range(5)), items[:5], 9)


def test_a_rough_look_at_floats_loses_no_hit(monkeypatch):
    from orderlens.operators import topk
    rnd = np.random.default_rng(6)
    dense = []
    plain = topk._best_columns
    monkeypatch.setattr(topk, "_best_columns", lambda scores, k: dense.append(scores.shape) or plain(scores, k))
    items = rnd.normal(size=(3000, 16)) * 3
    items[100:2000:7] += 1e-7  # differences below what floats hold
    items[7::50] = items[7]    # ties across rounding
    items[2001:2009] = items[100] + 4e-7
    ids, q = rnd.permutation(3000), np.concatenate([items[:400], rnd.normal(size=(50, 16))])
    asked = np.concatenate([ids[:400], np.arange(5000, 5050)])
    for exclude in (False, True):
        qi, ii, score = topk._score_block(asked, q, ids, items, 3, exclude, 6)
        got = sorted(zip(qi.tolist(), (-score).tolist(), ids[ii].tolist()))
        full = np.round(q @ items.T, 6)
        want = []
        for r in range(len(q)):
            at = [(-full[r, c], ids[c]) for c in np.argsort(-full[r])[:80] if not (exclude and ids[c] == asked[r])]
            want += [(r, s, int(i)) for s, i in sorted(at)[:3]]
        assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in sorted(want)]
        assert np.allclose([b for _, b, _ in got], [b for _, b, _ in sorted(want)], atol=2e-6)
    assert not dense  # no matrix of doubles was sorted


def test_many_copies_and_vectors_that_are_not_numbers_are_scored_in_full():
    from orderlens.operators import topk
    rnd = np.random.default_rng(8)
    items = rnd.normal(size=(2000, 8))
    items[::2] = items[0]
    qi, ii, score = topk._score_block(np.arange(20), items[:20], np.arange(2000), items, 3, False, 6)
    full = np.round(items[:20] @ items.T, 6)
    for r in range(20):
        want = sorted(range(2000), key=lambda c: (-full[r, c], c))[:3]
        assert set(ii[qi == r]) == set(want)
    odd = items.copy()
    odd[3] = np.inf
    assert len(topk._score_block(np.arange(20), odd[:20], np.arange(2000), odd, 3, False, 6)[0])
