"""Scoring texts with a deleted-interpolation bigram model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import crc_mod, row_sums, stored
from .encoded import REQUEST, Slice, encode, gathered, mix, n_buckets, requests, squeeze, unique, unsqueeze

LEARN, TUNE, HELD = 0, 1, 2      # roles of documents
UNIGRAM, BIGRAM = 1, 2
REPLY = ("slice_id long, kind int, bucket int, n int, total binary, learn binary, "
         "tokens long, types long, learn_tokens long, learn_types long")
STEPS = 4                        # cells per octave of a probability


def ngrams(piece: Slice):
    """Tokens, offsets, and for both orders (sorted distinct keys, position of each token's key, counts)."""
    codes, bounds = piece.with_ends()
    before = np.concatenate(([piece.end], codes[:-1]))  # a text starts behind an end
    one = unique(piece.hashes[codes])
    # pairs get local numbers first, so that each distinct pair is hashed once
    pair, at, count = unique(before * (piece.end + 1) + codes)
    hashed = mix(piece.hashes[pair // (piece.end + 1)], piece.hashes[pair % (piece.end + 1)])
    order = np.argsort(hashed, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return codes, before, bounds, one, (hashed[order], back[at], count[order])


def _ask(buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, _, _, one, two = ngrams(Slice(row))
                out = []
                for kind, (keys, _, counts) in ((UNIGRAM, one), (BIGRAM, two)):
                    learn = counts if row["role"] == LEARN else None
                    tune = counts if row["role"] == TUNE else None
                    out += requests(kind, row["slice_id"], keys, learn, tune, int(row["role"] == TUNE), buckets)
                yield pa.RecordBatch.from_pylist(out, schema=ASKED)
    return run


ASKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("slice_id", pa.int64()), ("n", pa.int32()),
                   ("wants", pa.int32()), ("hashes", pa.binary()), ("learn", pa.binary()), ("tune", pa.binary())])
ANSWER = pa.schema([("slice_id", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()),
                    ("total", pa.binary()), ("learn", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()),
                    ("learn_tokens", pa.int64()), ("learn_types", pa.int64())])


def _answer(key, table):
    kind, bucket = key[0].as_py(), key[1].as_py()
    at, learn, tune, cuts, rows = gathered(table)
    total = learn + tune
    out = [{"slice_id": None, "kind": kind, "bucket": bucket, "tokens": int(total.sum()),
            "types": int((total > 0).sum()), "learn_tokens": int(learn.sum()), "learn_types": int((learn > 0).sum())}]
    for row, low, high in zip(rows, cuts[:-1], cuts[1:]):
        own = at[low:high]
        out.append({"slice_id": row["slice_id"], "kind": kind, "bucket": bucket, "n": row["n"],
                    "total": squeeze(total[own].astype(np.uint32)),
                    "learn": squeeze(learn[own].astype(np.uint32)) if row["wants"] else None})
    return pa.Table.from_pylist(out, schema=ANSWER)


def _counts(answers: pa.Table, kind: int, name: str) -> np.ndarray:
    rows = sorted((r for r in answers.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])
    return np.concatenate([unsqueeze(r[name], r["n"], np.uint32) for r in rows]).astype(np.int64)


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket per power of two of its frequency."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64)


def _estimates(piece: Slice, answers: pa.Table, name: str, n_tokens: int):
    """Per token: its bucket, ML estimates of both orders, its own count; and the offsets."""
    codes, before, bounds, one, two = ngrams(piece)
    unigram = _counts(answers, UNIGRAM, name)
    own = unigram[one[1]]
    by_code = np.zeros(piece.end + 1, np.int64)
    by_code[codes] = own
    context = by_code[before]
    pair = _counts(answers, BIGRAM, name)[two[1]]
    return (context_bucket(context), pair / np.maximum(context, 1), own / max(n_tokens, 1), own, bounds)


def _cells(n_tokens: int):
    def run(key, left, right):
        rows = left.to_pylist()
        empty = pa.table({c: pa.array([], t) for c, t in CELL.items()})
        if not rows:
            return empty
        bucket, two, one, _, _ = _estimates(Slice(rows[0]), right, "learn", n_tokens)
        cell = lambda p: np.where(p > 0, 1 - np.floor(STEPS * np.log2(np.maximum(p, 1e-300))), 0).astype(np.int64)
        keys, at, n = unique((bucket << 40) | (cell(two) << 20) | cell(one))
        return pa.table({"cell": pa.array(keys), "n": pa.array(n.astype(np.int64)),
                         "two": pa.array(np.bincount(at, weights=two)), "one": pa.array(np.bincount(at, weights=one))})
    return run


CELL = {"cell": pa.int64(), "n": pa.int64(), "two": pa.float64(), "one": pa.float64()}


def mixture_weights(cells: list[tuple[int, int, float, float]], zero: float, rounds: int = 50) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket by expectation-maximisation.

    `cells` are held-out tokens with nearly equal estimates: (bucket, tokens, summed bigram estimate,
    summed unigram estimate); `zero` is the uniform probability. One pseudo-token per component
    keeps every weight above 0; in bucket 0 (context unseen) the bigram has none.
    """
    out = np.full((64, 3), 1 / 3)
    table = np.array(cells, float).reshape(-1, 4)
    for b in range(64):
        rows = table[table[:, 0] == b]
        n = rows[:, 1]
        p = np.column_stack([rows[:, 2] / np.maximum(n, 1), rows[:, 3] / np.maximum(n, 1), np.full(len(rows), zero)])
        w = np.array([0.0, 0.5, 0.5]) if b == 0 else np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p * w
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
            w = (share * n[:, None]).sum(0) + (np.array([0.0, 1, 1]) if b == 0 else 1.0)
            w /= w.sum()
        out[b] = w
    return out


def _score(weights: np.ndarray, n_tokens: int, n_types: int):
    def run(key, left, right):
        row = left.select(["bounds", "codes", "hashes", "n_tokens"]).to_pylist()[0]
        piece = Slice(row)
        bucket, two, one, own, bounds = _estimates(piece, right, "total", n_tokens)
        w = weights[bucket]
        if not n_tokens:
            w = np.array([[0.0, 0.0, 1.0]])
        score = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] / (n_types + 1))
        base = np.log10((own + 1) / (n_tokens + n_types + 1))
        ids = left["doc_ids"].combine_chunks().flatten()
        n = len(ids)
        return pa.table({
            "doc_id": ids, "role": pa.array(np.full(n, left["role"][0].as_py(), np.int32)),
            "n_tokens": pa.array(np.diff(bounds)), "n_known": pa.array(row_sums((own > 0).astype(np.int64), bounds)),
            "base_score": pa.array(row_sums(base, bounds)), "score": pa.array(row_sums(score, bounds))})
    return run


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2,
             tune_folds: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    Tokens are lower-cased (A-Z) words and one end per text. The model is
    p(w|v) = l2(b) c(v,w)/c(v) + l1(b) c(w)/N + l0(b)/(V+1), where b is the power of two of c(v) and a
    text starts behind an end. Documents whose crc32(id) modulo `folds` is `held_fold` are not learnt
    from. Of the others, one in `tune_folds` (by a hash of the id) is deleted while the estimates are
    formed and gives the held-out counts from which EM learns the weights of each bucket; the final
    estimates use both parts. Counts cover every training token; only the summary of held-out tokens
    by bucket and quarter octave of both estimates, whose size does not grow with the corpus, comes
    to the driver. Words are told apart by 64-bit hashes.

    Defined cases: null and empty texts are one end; null ids count as the empty text in crc32;
    repeated rows are separate documents; without training rows the score is that of the uniform
    distribution over nothing but the unknown word (0); an empty table gives an empty result; other
    columns are not read.
    """
    doc = F.col(id_col)
    role = F.when(crc_mod(doc, folds) == held_fold, HELD).when(
        F.pmod(F.xxhash64(doc), F.lit(tune_folds)) == 0, TUNE).otherwise(LEARN)
    sliced = encode(docs.select(doc.alias("doc_id"), role.alias("role"), F.col(text_col).alias("text")))
    asked = sliced.mapInArrow(_ask(n_buckets(sliced)), REQUEST)
    answers = stored(asked.groupBy("kind", "bucket").applyInArrow(_answer, REPLY), "answers")
    stats = answers.filter(f"slice_id is null and kind = {UNIGRAM}").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "learn_tokens", "learn_types")]).first()
    own = answers.filter("slice_id is not null").drop("tokens", "types", "learn_tokens", "learn_types")
    tuned = sliced.filter(f"role = {TUNE}")
    cells = tuned.groupBy("slice_id").cogroup(
        own.filter("learn is not null").groupBy("slice_id")).applyInArrow(
        _cells(stats["learn_tokens"]), "cell long, n long, two double, one double")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("two").alias("two"), F.sum("one").alias("one"))
    weights = mixture_weights([(r["cell"] >> 40, r["n"], r["two"], r["one"]) for r in cells.collect()],
                              1 / (stats["learn_types"] + 1))
    kind = docs.schema[id_col].dataType.simpleString()
    scored = sliced.groupBy("slice_id").cogroup(own.drop("learn").groupBy("slice_id")).applyInArrow(
        _score(weights, stats["tokens"], stats["types"]),
        f"doc_id {kind}, role int, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (F.col("role") == HELD).alias("held_out"), "n_tokens", "n_known",
                         F.lit(stats["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
