"""Removing passages that repeat: hashed runs of consecutive sentences, joined globally."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .base import WORD, mix, owner, slices, stored, words

WORDS = re.compile(WORD)
ENDING = ".!?"
STEP = np.uint64(0x9E3779B97F4A7C15)  # any odd number: multiplier of the hash of a unit's words


@dataclass
class Units:
    """Sentences and steps of long ones, of many texts: first word (counted over all texts), number of
    words, text and hash of each; `bounds` are the units of each text, `first_word` its first word."""

    start: np.ndarray
    size: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray
    first_word: np.ndarray


def _cuts(bare: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Words at which long sentences [begin, end) are cut, chosen by the words around them.

    Of every `window` consecutive pairs of words the last one with the smallest hash is followed by a
    cut. The same words are cut alike whatever stands before them, but for `window` words at their
    edges, and no step between two cuts has more than `window` words.
    """
    spans = np.maximum(end - begin - window, 0)  # places of a window of pairs
    if not spans.sum():
        return np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(begin)), spans)
    first = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(spans) - spans, spans)
    pairs = mix(bare[:-1], bare[1:])
    picked = first + window - 1 - np.argmin(pairs[(first + window - 1)[:, None] - np.arange(window)], axis=1)
    return np.unique(picked[picked + 2 < end[of]] + 2)


def units(texts: pa.Array, unit_words: int) -> Units:
    """Sentences end at words that end in `.`, `!` or `?` and at line ends; one of more than `unit_words`
    words is cut further where its words say (see `_cuts`), so a passage in a long sentence is also a run
    of several units, the same ones behind any other words. A unit's hash covers its words in order, less
    the marks at its end."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    per_text = lines.offsets.to_numpy().astype(np.int64)
    per_text = per_text - per_text[0]
    codes, ends, values = words(lines.flatten(), lower=False)
    listed = values.to_pylist()
    stems = [w.rstrip(ENDING) for w in listed]
    full = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in listed), np.uint64, len(listed))[codes]
    bare = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in stems), np.uint64, len(listed))[codes]
    marked = np.fromiter((len(a) < len(b) for a, b in zip(stems, listed)), bool, len(listed))[codes]
    n = len(codes)
    closes = marked.copy()
    closes[ends[1:][ends[1:] > ends[:-1]] - 1] = True
    stop = np.flatnonzero(closes) + 1
    begin = np.concatenate(([0], stop[:-1])) if len(stop) else stop
    long = stop - begin > unit_words
    start = np.union1d(begin, _cuts(bare, begin[long], stop[long], max(1, unit_words // 2)))
    size = np.diff(np.append(start, n))
    first_word = ends[per_text]  # per text, and the end
    bounds = np.searchsorted(start, first_word)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, STEP))), dtype=np.uint64)
        back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(pow(int(STEP), -1, 1 << 64))))), dtype=np.uint64)
        before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(full * powers[:n], dtype=np.uint64)))
        inner = (before[start + size - 1] - before[start]) * back[start] if n else before[:0]
    hashed = mix(inner, bare[start + size - 1], size) if n else inner
    return Units(start, size, owner(bounds), hashed, bounds, first_word)


def run_keys(u: Units, run: int, least: int, grow: bool = True) -> tuple[np.ndarray, ...]:
    """(unit, units, hash, check) of every run of `run` units of one text, or of more where these are short.

    With `grow`, a run of `run` units with fewer than `least` words grows by whole units, forwards from
    its first one and backwards from its last one, until it has them. So each unit of a passage with
    `run` units and `least` words lies in a run inside the passage.
    """
    total = np.concatenate(([0], np.cumsum(u.size)))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for size in range(run, (max(run, least) if grow else run) + 1):  # a unit has one word at least
        places = max(0, len(u.text) - size + 1)
        at = np.flatnonzero(u.text[len(u.text) - places:] == u.text[:places])
        if not len(at):
            break
        counts = total[at + size] - total[at]
        wanted = counts >= least
        if size > run:
            wanted &= (counts - u.size[at + size - 1] < least) | (counts - u.size[at] < least)
        chosen = at[wanted]
        parts = [u.hash[chosen + i] for i in range(size)]
        found.append((chosen, np.full(len(chosen), size), mix(*parts), mix(*parts[::-1]) >> np.uint64(32)))
        if counts.min() >= least:
            break  # nothing is left to grow
    at, size, first, second = (np.concatenate(x) for x in zip(*found))
    return at, size, first.view(np.int64), second.astype(np.uint32).view(np.int32)


def _runs(unit_words: int, run: int, least: int, grow: bool):
    """Runs with `again`: true for all but the first of equal runs in this slice, which need no partner."""
    def work(batches):
        for batch in slices(batches, "text"):
            u = units(batch.column("text"), unit_words)
            at, size, hashes, check = run_keys(u, run, least, grow)
            text = u.text[at]
            pos = at - u.bounds[text]
            ids = batch.column("doc_id")
            order = pc.sort_indices(pa.table([ids], ["k"]), [("k", "ascending")], null_placement="at_start").to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            by = np.lexsort((pos, rank[text], check, hashes))
            again = np.zeros(len(at), bool)
            if len(at):
                again[by[1:]] = (hashes[by[1:]] == hashes[by[:-1]]) & (check[by[1:]] == check[by[:-1]])
            table = pa.Table.from_arrays(
                [ids.take(pa.array(text)), pa.array(pos.astype(np.int32)), pa.array(size.astype(np.int32)),
                 pa.array(hashes), pa.array(check), pa.array(again)],
                names=["doc_id", "pos", "size", "hash", "check", "again"])
            yield from table.to_batches(max_chunksize=50_000)
    return work


def _later(batches):
    """Of rows in the order of (again, hash, check, id, position): all but the first of each group of equal runs."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        again = batch["again"].to_numpy(zero_copy_only=False)
        hashes, check = batch["hash"].to_numpy(), batch["check"].to_numpy()
        same = np.zeros(len(again), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (check[1:] == check[:-1]) & ~again[:-1]
        same[0] = before == (hashes[0], check[0])
        if not again[-1]:
            before = (hashes[-1], check[-1])
        yield batch.select(["doc_id", "pos", "size"]).filter(pa.array(again | same))


def _cut(unit_words: int):
    def work(batches):
        for batch in slices(batches, "text"):
            u = units(batch.column("text"), unit_words)
            total = np.diff(u.bounds)
            texts, gone, spans = batch.column("text").to_pylist(), [], []
            for i, starts in enumerate(batch.column("starts").to_pylist()):
                drop = sorted({p for s in starts or () for p in range(s["pos"], s["pos"] + s["size"]) if p < total[i]})
                gone.append(len(drop))
                joined: list[list[int]] = []
                if drop:
                    # a unit reaches from its first word to the next unit's
                    own = u.start[u.bounds[i]:u.bounds[i + 1]] - u.first_word[i]
                    at = [m.start() for m in WORDS.finditer(texts[i])]
                    edges = [0, *[at[w] for w in own[1:].tolist()], len(texts[i])]
                    for p in drop:
                        if joined and joined[-1][1] == edges[p]:
                            joined[-1][1] = edges[p + 1]
                        else:
                            joined.append([edges[p], edges[p + 1]])
                    keep = [0, *[e for span in joined for e in span], len(texts[i])]
                    texts[i] = "".join(texts[i][keep[k]:keep[k + 1]] for k in range(0, len(keep), 2))
                spans.append([{"start": a, "end": b} for a, b in joined])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("others"), pa.array(texts, pa.string()), pa.array(total.astype(np.int64)),
                 pa.array(gone, pa.int64()), pa.array(spans, kind)],
                names=["others", "text", "n_sentences", "n_removed", "removed"])
    return work


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3,
               least_words: int = 12, unit_words: int = 16, grow: bool = True) -> DataFrame:
    """All columns of `docs` with the cut text, then n_sentences, n_removed and removed.

    Every run of `run` consecutive sentences (see `units`) is hashed (96 bits). One with fewer than
    `least_words` words grows by whole sentences until it has them (see `run_keys`), or without `grow`
    is left out, so that a repeated list of short lines stays. Of equal runs the one with the smallest
    (id, position) is first; sentences that any other one covers are removed, also inside one document.
    `removed` lists the character spans [start, end) taken out of the original text. Runs, not texts,
    are shuffled to find repeats, once and with their places: of equal runs in one slice of text only the
    first can be the first of all, the others are dealt anywhere. So a run that a third of all documents
    share reaches its task as one row per slice.

    Defined cases: a null text stays null with 0 sentences; texts of fewer than `run` sentences or
    `least_words` words are never cut; rows that repeat an id get the findings of all of them, at the same
    positions; null ids are one id, the smallest; result columns replace columns of the same name.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    runs = rows.mapInArrow(_runs(unit_words, run, least_words, grow),
                           f"doc_id {kind}, pos int, size int, hash long, check int, again boolean")
    dealt = runs.repartition(F.when(F.col("again"), F.xxhash64("doc_id", "pos")).otherwise(F.col("hash")))
    later = dealt.sortWithinPartitions(F.desc("again"), "hash", "check", "doc_id", "pos") \
        .mapInArrow(_later, f"doc_id {kind}, pos int, size int")
    starts = later.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "size")).alias("starts"))
    others = [c for c in docs.columns if c not in (text_col, "n_sentences", "n_removed", "removed")]
    plain = docs.select(F.struct(*others).alias("others"), F.col(id_col).alias("key"),
                        F.col(text_col).cast("string").alias("text"))
    starts = stored(starts, "repeats")
    joined = plain.join(starts, plain["key"].eqNullSafe(starts["doc_id"]), "left").select("others", "text", "starts")
    fields = T.StructType([joined.schema["others"]] + T._parse_datatype_string(
        "text string, n_sentences long, n_removed long, removed array<struct<start: long, end: long>>").fields)
    done = joined.mapInArrow(_cut(unit_words), fields)
    return done.select(*[F.col("others")[c].alias(c) for c in others],
                       *[F.col("text").alias(text_col), "n_sentences", "n_removed", "removed"])
