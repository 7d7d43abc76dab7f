import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.operators.hash_tables import build_hash_index, hash_top_k, recall, sign_vectors
from orderlens.operators.retrieval import retrieve_approximate
from orderlens.operators.topk import exact_top_k


def frame(spark, vecs, ids=None):
    ids = range(len(vecs)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], f"x{i}") for i, v in zip(ids, vecs)],
                                 "id bigint, v array<double>, tag string")


def plain(q, items, tables, bits, probes, k, exclude):
    """The same tables with loops over pairs."""
    signs = sign_vectors(tables, bits, items.shape[1])
    code = lambda v, t: sum(int(v @ signs[t, b] >= 0) << b for b in range(bits))
    out = {}
    for i, v in enumerate(q):
        near = set()
        for t in range(tables):
            closest = sorted(range(bits), key=lambda b: abs(v @ signs[t, b]))[:probes]
            codes = {code(v, t)} | {code(v, t) ^ (1 << b) for b in closest}
            near |= {j for j, w in enumerate(items) if code(w, t) in codes and not (exclude and i == j)}
        scored = sorted((-round(float(v @ items[j]), 6), j) for j in near)
        out[i] = [(j, -s) for s, j in scored[:k]]
    return {i: hits for i, hits in out.items() if hits}


def collect(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
        assert r["tag"] == f"x{r['item_id']}" and r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("block_rows", [20_000, 7])
def test_equals_the_same_tables_with_loops(spark, block_rows):
    v = np.random.default_rng(3).normal(size=(120, 8))
    v[::3] = v[0]  # a third are copies of one vector
    df = frame(spark, v)
    index = build_hash_index(df.repartition(5), item_id="id", item_vec="v", carry=["tag"], tables=3, bucket_rows=20, keep=200)
    assert index.bits == 3 and index.postings.count() == 360
    got = hash_top_k(df, index, 4, query_id="id", query_vec="v", carry=["tag"], probes=1, exclude_self=True,
                     block_rows=block_rows)
    assert collect(got) == plain(v, v, 3, 3, 1, 4, True)


def test_copies_beyond_the_kept_ones_change_nothing(spark):
    v = np.random.default_rng(5).normal(size=(90, 6))
    v[30:] = v[0]
    df = frame(spark, v)
    few, all_ = (build_hash_index(df, item_id="id", item_vec="v", carry=["tag"], tables=4, bucket_rows=rows, keep=n)
                 for n, rows in ((5, 9), (1000, 23)))  # the same number of sign vectors
    assert few.bits == all_.bits and few.items.count() == 30 - 1 + 5
    ask = lambda index: collect(hash_top_k(df, index, 4, query_id="id", query_vec="v", carry=["tag"], exclude_self=True))
    assert ask(few) == ask(all_)
    with pytest.raises(ValueError, match="keeps 5 copies"):
        hash_top_k(df, few, 5, query_id="id", query_vec="v", exclude_self=True)


def test_clustered_vectors_are_found_in_a_small_share_of_the_table(spark):
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(60, 32))
    v = np.repeat(centres, 50, axis=0) + rnd.normal(scale=0.2, size=(3000, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = frame(spark, v)
    index = build_hash_index(df, item_id="id", item_vec="v", tables=12, bucket_rows=16)
    options = dict(query_id="id", query_vec="v", exclude_self=True)
    exact = exact_top_k(df, df, 3, item_id="id", item_vec="v", **options)
    found = recall(hash_top_k(df, index, 3, probes=3, **options), exact).first()
    assert found["n_exact"] == 9000 and found["recall"] >= 0.95
    # what a query reads: its buckets, all tables together, against the table
    sizes = index.postings.groupBy("table", "code").count()
    assert sizes.agg(F.sum(F.col("count") ** 2)).first()[0] / 3000 < 0.25 * 3000


def test_edge_rows(spark):
    df = frame(spark, [[1.0, 0.0], None, [], [0.0, 0.0], [1.0, 0.0]])
    index = build_hash_index(df, item_id="id", item_vec="v", tables=2)
    got = hash_top_k(df, index, 3, query_id="id", query_vec="v")
    # a zero vector lies on the positive side everywhere and scores 0 wherever it is met
    assert {r["query_id"] for r in got.collect()} <= {0, 3, 4}
    assert [r["item_id"] for r in got.filter("query_id = 0 AND score = 1").orderBy("rank").collect()] == [0, 4]
    empty = build_hash_index(df.limit(0), item_id="id", item_vec="v")
    assert hash_top_k(df, empty, query_id="id", query_vec="v").count() == 0
    assert hash_top_k(df.limit(0), index, query_id="id", query_vec="v").count() == 0


def test_chunks_are_retrieved_with_their_columns(spark):
    chunks = frame(spark, np.eye(4)).select(F.concat(F.lit("c__"), "id").alias("chunk_id"), F.lit("c").alias("parent_doc_id"),
                                            F.col("tag").alias("text"), F.col("v").alias("vector"))
    index = build_hash_index(chunks, item_id="chunk_id", item_vec="vector", carry=["parent_doc_id", "text"])
    asked = frame(spark, np.eye(4)[:2]).select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    rows = retrieve_approximate(asked, index, 1).orderBy("query_id").collect()
    assert [(r["chunk_id"], r["text"], r["score"]) for r in rows] == [("c__0", "x0", 1.0), ("c__1", "x1", 1.0)]
