import collections
import math
import zlib

import pytest
from llm_helpers import components, edge_documents, words

from orderlens.llm import encoded, graph, jaccard, lm
from orderlens.llm.base import read
from orderlens.llm.queries import op1_lm_score


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(encoded, "BUCKET_KEYS", 20_000)


def crc(key):
    return zlib.crc32(str("" if key is None else key).encode())


def test_base_score_and_counts_equal_brute_force(spark, sf, small_buckets):
    got = {r.doc_id: r for r in op1_lm_score(spark, sf).collect()}
    tokens = {r.doc_id: [*words(r.text), None] for r in read(spark, sf, "documents").collect()}
    count = collections.Counter()
    for key, own in tokens.items():
        if crc(key) % 7 != 2:
            count.update(own)
    total, kinds = sum(count.values()), len(count)
    assert len(got) == len(tokens)
    for key, own in tokens.items():
        row = got[key]
        assert (row.n_tokens, row.n_known) == (len(own), sum(count[t] > 0 for t in own))
        assert row.train_tokens == total and row.held_out == (crc(key) % 7 == 2)
        base = sum(math.log10((count[t] + 1) / (total + kinds + 1)) for t in own)
        assert row.base_score == pytest.approx(base, abs=1e-7)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_score_equals_brute_force_with_its_weights(spark, small_buckets, monkeypatch):
    seen = {}
    learn = lm.mixture_weights

    def spy(*args, **kw):
        seen["weights"] = learn(*args, **kw)
        return seen["weights"]
    monkeypatch.setattr(lm, "mixture_weights", spy)
    docs = spark.createDataFrame([(i, f"the cat sat on the mat {i % 5} the cat {i % 3} sat") for i in range(60)],
                                 "doc_id long, text string")
    rows = lm.lm_score(docs).collect()
    one, two, context = collections.Counter(), collections.Counter(), collections.Counter()
    texts = {r.doc_id: ["</s>", *words(r.text), "</s>"] for r in docs.collect()}
    for key, own in texts.items():
        if crc(key) % 7 != 2:
            one.update(own[1:])
            two.update(zip(own, own[1:]))
    total, kinds = sum(one.values()), len(one)
    for row in rows:
        own, score = texts[row.doc_id], 0.0
        for v, w in zip(own, own[1:]):
            weight = seen["weights"][int(math.log2(one[v])) + 1 if one[v] else 0]
            p = weight[0] * (two[v, w] / one[v] if one[v] else 0) + weight[1] * one[w] / total + weight[2] / (kinds + 1)
            score += math.log10(p)
        assert row.score == pytest.approx(score, abs=1e-9)


def test_weights_are_those_that_maximise_held_out_likelihood():
    # contexts of bucket 3 where the bigram is right every time, of bucket 4 where it never is
    weights = lm.mixture_weights([(3, 1000, 900.0, 10.0), (4, 1000, 0.0, 10.0)], 1e-6)
    assert weights[3][0] > 0.95 and weights[4][0] < 0.01 and weights[4][1] > 0.95
    assert weights[0][0] == 0 and abs(weights.sum(1) - 1).max() < 1e-12


def test_score_of_edge_rows(spark):
    rows = lm.lm_score(edge_documents(spark)).collect()
    assert len(rows) == 13
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    assert all(math.isfinite(r.score) for r in rows)
    assert lm.lm_score(edge_documents(spark).filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("rare,block", [(50, 512), (2, 8)])
def test_join_equals_all_pairs(spark, sf, small_buckets, rare, block):
    docs = read(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    root, size = components(texts, 3, 90)
    got = jaccard.jaccard_components(docs, shingle=3, percent=90, rare=rare, block=block).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {i: (root[i], size[i]) for i in texts}


@pytest.mark.parametrize("shingle,percent", [(3, 90), (5, 80), (1, 50)])
def test_join_of_a_large_group_of_near_copies(spark, shingle, percent):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        own = list(base)
        for j in range(i % 6):
            own[(i * 7 + j * 17) % 120] = f"x{i}y{j}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"u{i}v{j}" for j in range(40))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(docs, shingle=shingle, percent=percent, rare=4, block=16).collect()
    root, _ = components(dict(rows), shingle, percent)
    assert {r.doc_id: r.component_id for r in got} == root


def test_join_of_edge_rows(spark):
    rows = jaccard.jaccard_components(edge_documents(spark)).collect()
    assert len(rows) == 13
    by = {r.doc_id: r for r in rows}
    assert by[5].component_id == 1 and by[2].component_id == 2 and by[2].n_shingles == 0
    assert by[7].n_shingles == 1 and by[None].component_id is None
    assert jaccard.jaccard_components(edge_documents(spark).filter("doc_id < 0")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3)]
    edges += [(300 + (i * 7) % 50, 300 + (i * 7 + 7) % 50) for i in range(50)]
    got = {r.node: r.root for r in graph.components(
        spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)},
                   **{i: 300 for i in range(301, 350)}}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
