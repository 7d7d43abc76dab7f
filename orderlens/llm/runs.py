"""Maximal periodic runs of words, found through a Re-Pair grammar of the texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .base import mix, owner as owners, slices, words
from .grammar import fold_rest, re_pair

PAIRS = 1 << 20  # candidate pairs held at once
BATCH_BYTES = 2 << 20
RESULT = T.StructType([
    T.StructField("n_runs", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("period", T.LongType()), T.StructField("exponent_milli", T.LongType()),
    T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])


class Windows:
    """Names of all windows of 1, 2, 4, ... symbols: equal names mean equal windows.

    Levels end where no window repeats. Windows that reach over the end get names of their own.
    """

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.levels = [codes.astype(np.int64)]
        size = 1
        while 2 * size <= self.n:
            names, repeated = self._joined(self.levels[-1], self.levels[-1], size, 2 * size)
            if not repeated:
                break
            self.levels.append(names)
            size *= 2

    def _joined(self, head: np.ndarray, tail: np.ndarray, shift: int, size: int) -> tuple[np.ndarray, bool]:
        """Names of windows of `size`: a head window and a tail window `shift` further."""
        whole = self.n - size + 1
        names = np.arange(self.n) + self.n  # until shown to repeat, a name of its own
        if whole < 2:
            return names, False
        low = np.bincount(head, minlength=1)[head[:whole]] > 1
        low &= np.bincount(tail, minlength=1)[tail[shift:shift + whole]] > 1
        spots = np.flatnonzero(low)
        if not len(spots):
            return names, False
        _, which, counts = np.unique(head[spots] * (2 * self.n) + tail[spots + shift], return_inverse=True, return_counts=True)
        again = counts[which] > 1
        names[spots[again]] = which[again]  # below n
        return names, bool(again.any())

    def triples(self) -> np.ndarray:
        if len(self.levels) < 2:
            return np.arange(self.n) + self.n
        return self._joined(self.levels[1], self.levels[0], 2, 3)[0]

    def forward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on agree, `limit` at most (i < j)."""
        return self._reach(i, j, limit, 1)

    def backward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many symbols before i and before j agree, `limit` at most."""
        return self._reach(i, j, limit, -1)

    def _reach(self, i, j, limit, way) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        top = len(self.levels) - 1
        for level in [top, *range(top, -1, -1)]:
            size, names = 1 << level, self.levels[level]
            while True:
                room = np.flatnonzero(out + size <= limit)
                shift = out[room] if way > 0 else -out[room] - size
                room = room[names[i[room] + shift] == names[j[room] + shift]]
                out[room] += size
                # a higher level would hold if a window twice as long did; only the top one can go on
                if level < top or not len(room):
                    break
        return out


def _crossing(windows: Windows, triples: np.ndarray, keys: np.ndarray, spots: np.ndarray, start: np.ndarray,
              inner: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Runs inside [start, start + size) that cross start + inner: (node, run start, run end, period).

    A run of `least` symbols with two periods matches itself, moved by its period, over `least // 2`
    symbols or more, and with its first or its last full period next to the border. So one of the
    three symbols after the border, or the three before it, occurs again a period away.
    """
    n = windows.n
    found: list[list[np.ndarray]] = [[], [], [], []]
    border, stop = start + inner, start + size
    for side in (0, -3):
        anchor = border + side
        fits = np.flatnonzero((anchor >= start) & (anchor + 3 <= stop))
        fits = fits[triples[anchor[fits]] < n]  # a triple that repeats
        name = triples[anchor[fits]]
        low = np.searchsorted(keys, name * n + start[fits])
        high = np.searchsorted(keys, name * n + stop[fits] - 2)
        counts = high - low
        ends = np.cumsum(counts)
        at = 0
        while at < len(fits):
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
            node = np.repeat(fits[at:upto], counts[at:upto])
            first = np.repeat(low[at:upto] - (ends[at:upto] - counts[at:upto] - base), counts[at:upto])
            other = spots[first + np.arange(len(node))] - side
            at = upto
            here = border[node]
            real = other != here
            node, other, here = node[real], other[real], here[real]
            i, j = np.minimum(here, other), np.maximum(here, other)
            ahead = windows.forward(i, j, stop[node] - j)
            behind = windows.backward(i, j, i - start[node])
            period, match = j - i, ahead + behind
            good = match >= np.maximum(period, least - period)
            for column, value in zip(found, (node, i - behind, j + ahead, period)):
                column.append(value[good])
    node, s, e, p = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in found]
    order = np.lexsort((p, e, s, node))  # of the periods of one stretch the smallest is its own
    node, s, e, p = node[order], s[order], e[order], p[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return node[new], s[new], e[new], p[new]


def maximal_runs(codes: np.ndarray, owner: np.ndarray, least: int = 12) -> tuple[np.ndarray, ...]:
    """(sequence, start, end, period) of every maximal run of `least` symbols and two periods or more.

    `codes` are symbols of all sequences in a row, `owner` the number of each symbol's sequence; starts
    and ends are positions in `codes`. Results are ordered by sequence, start and period.

    Sequences are put in one Re-Pair grammar, whose pairs stay inside a sequence. The lowest node that
    holds a run has it across its border, so the runs across each rule's border are worked out once, at
    the rule's first use, and moved to all its uses; what remains of each sequence is joined by halves.
    Pieces of one run that a node cut off are merged: equal period, and at least a period in common.
    """
    empty = (np.zeros(0, np.int64),) * 4
    if least < 6:
        raise ValueError("runs must have six symbols or more")
    # a run repeats half of its least length inside its sequence: other sequences have none
    half = least // 2
    if len(codes) < least:
        return empty
    whole = len(codes) - half + 1
    hashed = mix(*[codes[k:k + whole] for k in range(half)], owner[:whole])
    inside = np.flatnonzero(owner[:whole] == owner[half - 1:])
    order = inside[np.argsort(hashed[inside], kind="stable")]
    twice = hashed[order[1:]] == hashed[order[:-1]]
    hit = np.zeros(int(owner[-1]) + 1, bool)
    hit[owner[order[1:][twice]]] = True
    places = np.flatnonzero(hit[owner])
    if not len(places):
        return empty
    mine = owner[places]
    # symbols of their own in each sequence: rules, windows and triples never span two
    _, symbols = np.unique(mine * (int(codes.max()) + 1) + codes[places], return_inverse=True)
    windows = Windows(symbols)
    triples = windows.triples()
    spots = np.flatnonzero(triples < len(symbols))
    keys = triples[spots] * len(symbols) + spots
    rank = np.argsort(keys, kind="stable")
    spots, keys = spots[rank], keys[rank]

    grammar = re_pair(symbols, mine)
    by_rule = np.argsort(grammar.rule, kind="stable")
    ruled = grammar.rule[by_rule]
    firsts = by_rule[np.concatenate(([True], ruled[1:] != ruled[:-1]))] if len(ruled) else by_rule
    rest = fold_rest(grammar)
    start = np.concatenate([grammar.start[firsts], *[level[2] for level in rest]])
    inner = np.concatenate([grammar.inner[firsts], *[level[3] for level in rest]])
    size = np.concatenate([grammar.size[firsts], *[level[4] for level in rest]])
    large = np.flatnonzero(size >= least)
    node, s, e, p = _crossing(windows, triples, keys, spots, start[large], inner[large], size[large], least)
    node = large[node]

    # to every use of the rule
    uses = np.bincount(grammar.rule - grammar.first, minlength=len(firsts)) if len(firsts) else np.zeros(0, np.int64)
    begin = np.cumsum(uses) - uses
    copies = np.where(node < len(firsts), np.append(uses, 1)[np.minimum(node, len(firsts))], 1)
    which = np.repeat(np.arange(len(node)), copies)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
    ruled_node = node[which] < len(firsts)
    moved = np.zeros(len(which), np.int64)
    r = which[ruled_node]
    moved[ruled_node] = grammar.start[by_rule[begin[node[r]] + nth[ruled_node]]] - start[node[r]]
    s, e, p = s[which] + moved, e[which] + moved, p[which]

    seq = mine[s]
    order = np.lexsort((-e, s, p, seq))
    seq, s, e, p = seq[order], s[order], e[order], p[order]
    group = np.cumsum(np.concatenate(([True], (seq[1:] != seq[:-1]) | (p[1:] != p[:-1])))) - 1 if len(s) else s
    lift = group * (len(symbols) + 1)
    reach = np.maximum.accumulate(e + lift) - lift if len(s) else e
    opens = np.ones(len(s), bool)
    opens[1:] = (group[1:] != group[:-1]) | (s[1:] + p[1:] > reach[:-1])
    heads = np.flatnonzero(opens)
    if not len(heads):
        return empty
    last = np.append(heads[1:], len(s)) - 1
    seq, s, e, p = seq[heads], s[heads], reach[last], p[heads]
    order = np.lexsort((p, s, seq))
    # sequences keep their places next to each other, so a run's positions only shift
    s, e = s[order], e[order]
    begin_at = places[s]
    return seq[order], begin_at, begin_at + (e - s), p[order]


def _digests(least: int):
    def run(batches):
        for batch in slices(batches, "text", BATCH_BYTES):
            codes, offsets, values = words(batch.column("text"), lower=False)
            owner = owners(offsets)
            seq, s, e, p = maximal_runs(codes, owner, least)
            n = len(offsets) - 1
            gone = np.zeros(len(codes) + 1, np.int64)
            np.add.at(gone, s + p, 1)
            np.add.at(gone, e, -1)
            kept = np.cumsum(gone[:-1]) == 0
            counts = np.concatenate(([0], np.cumsum(np.bincount(owner[kept], minlength=n)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(counts), values.take(pa.array(codes[kept])).cast(pa.string()))
            collapsed = [hashlib.sha256(t.encode()).hexdigest() for t in pc.binary_join(lists, " ").to_pylist()]
            s_in, length = s - offsets[seq], e - s
            bounds = np.searchsorted(seq, np.arange(n + 1))
            empty = hashlib.sha256(b"").hexdigest()
            rows: list[list] = [[], [], [], [], [], []]
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if low == high:
                    best, text = (None,) * 4, empty
                else:
                    runs = list(zip(s_in[low:high].tolist(), length[low:high].tolist(), p[low:high].tolist()))
                    a, b, c = min(runs, key=lambda x: (-x[1], x[0], x[2]))
                    best = (a, b, c, 1000 * b // c)
                    text = hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in runs).encode()).hexdigest()
                for column, value in zip(rows, (high - low, *best, text)):
                    column.append(value)
            others = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], *[pa.array(c, pa.int64()) for c in rows[:5]],
                 pa.array(rows[5], pa.string()), pa.array(collapsed, pa.string())],
                names=[*others, *RESULT.fieldNames()])
    return run


def _spans(least: int):
    def run(batches):
        for batch in slices(batches, "text", BATCH_BYTES):
            codes, offsets, _ = words(batch.column("text"), lower=False)
            seq, s, e, p = maximal_runs(codes, owners(offsets), least)
            others = batch.drop_columns(["text"]).take(pa.array(seq))
            yield pa.RecordBatch.from_arrays(
                [*others.columns, pa.array(s - offsets[seq]), pa.array(e - s), pa.array(p)],
                names=[*others.schema.names, "start", "length", "period"])
    return run


def run_spans(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, period): every maximal run of words, one row each."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_spans(least), f"doc_id {kind}, start long, length long, period long")


def run_digests(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, number of runs, the longest one, and two digests.

    Words are what ASCII white space separates, numbered from 0 and compared as they are. A run is a
    stretch with smallest period q (words q apart are equal) of at least `least` words and two periods
    that no neighbouring word extends. `start`, `length`, `period`, `exponent_milli` describe the
    longest run (ties: smallest start, then period). `runs_sha256` covers all runs (`start,length,period`
    and a line feed each, by start, then period), `collapsed_sha256` the words outside every run's tail
    behind its first period, joined by a space.

    A document is worked on whole and alone, in slices of a few megabytes of text; memory grows with the
    longest document (a few hundred bytes a word where it repeats itself). No shuffle.

    Defined cases: null, empty and blank texts have no runs, four nulls and the digests of the empty
    text; repeated rows give repeated rows; a null id is returned as null; an empty table gives an
    empty result; other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *RESULT.fields])
    return rows.mapInArrow(_digests(least), kinds)
