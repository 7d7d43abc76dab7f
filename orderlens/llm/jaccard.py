"""Exact n-gram Jaccard self join with token-combination prefixes.

Shingles are ordered by document frequency, rare ones first. Two sets of the wanted similarity share
a shingle in the first n - required + 1 of each. Shingles in few documents are signatures alone. To
make signatures of frequent ones selective, only pairs of them are signatures: pairs are formed
inside m hash classes, and the prefix is extended by m shingles, so that two similar sets share m + 1
prefix shingles and hence either a rare one or, by the pigeonhole principle, two frequent ones of one
class. m follows the size of the set (by power of two; a set whose smallest possible partner has
another power of two signs for both), so long texts get no more than about ten pairs per shingle.

Documents that share a signature form families: stars around a signature's smallest document, joined
by their connected components, so a signature shared by a million documents makes a million rows and
no pairs. Each set then travels once to its family's task (once per block of a large family), where
intersections are counted exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import owner, release, stored
from .encoded import REQUEST, Slice, encode, gathered, mix, n_buckets, requests, squeeze, unique, unsqueeze
from .graph import components
from .lm import ASKED

SHINGLE = 3
CLASS_TOKENS = 16     # frequent prefix shingles per class, at most about
ANSWER = pa.schema([("slice_id", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("total", pa.binary())])


def shingle_sets(piece: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending: (hashes, offsets)."""
    h, bounds = piece.hashes[piece.codes], piece.bounds
    counts = np.diff(bounds)
    doc = owner(bounds)
    keys, docs = [], []
    if len(h) >= size:
        at = np.flatnonzero(doc[size - 1:] == doc[:len(doc) - size + 1])
        keys.append(mix(*[h[at + i] for i in range(size)]))
        docs.append(doc[at])
    for n in range(1, size):  # shorter texts are one shingle
        few = np.flatnonzero(counts == n)
        keys.append(mix(*[h[bounds[few] + i] for i in range(n)], np.full(len(few), n, np.uint64)))
        docs.append(few)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    if len(key):
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
        key, doc = key[new], doc[new]
    return key, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(counts)))))


def _ask(buckets: int, size: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, _, counts = unique(shingle_sets(Slice(row), size)[0])
                yield pa.RecordBatch.from_pylist(
                    list(requests(SHINGLE, row["slice_id"], keys, counts, None, 0, buckets)), schema=ASKED)
    return run


def _answer(key, table):
    at, total, _, cuts, rows = gathered(table)
    return pa.Table.from_pylist(
        [{"slice_id": r["slice_id"], "bucket": key[0].as_py(), "n": r["n"],
          "total": squeeze(total[at[low:high]].astype(np.uint32))}
         for r, low, high in zip(rows, cuts[:-1], cuts[1:])], schema=ANSWER)


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def scheme(band: int, percent: int) -> int:
    """Classes of frequent shingles for sets of 2^band to 2^(band + 1) shingles."""
    return max(1, _ceil((100 - percent) << (band + 1), 100 * CLASS_TOKENS))


def prefix(n: int, percent: int, classes: int) -> int:
    return min(n, n - _ceil(percent * n, 100) + 1 + classes)


def bands(n: int, percent: int) -> list[int]:
    return sorted({n.bit_length() - 1, max(1, _ceil(percent * n, 100)).bit_length() - 1})


def signatures(keys: np.ndarray, df: np.ndarray, percent: int, rare: int) -> np.ndarray:
    """Signatures of one set, given its shingles and their document frequencies in (df, hash) order."""
    n, out = len(keys), []
    for band in bands(n, percent):
        classes = scheme(band, percent)
        p = prefix(n, percent, classes)
        k, d = keys[:p], df[:p]
        single = k[(d > 1) & (d <= rare)]
        out.append(mix(single, np.ones(len(single), np.uint64)))
        often = k[d > rare]
        kind = often % np.uint64(classes)
        order = np.argsort(kind, kind="stable")
        often, kind = often[order], kind[order]
        for step in range(1, len(often)):
            same = np.flatnonzero(kind[step:] == kind[:-step])
            if not len(same):
                break
            one, two = often[same], often[same + step]
            out.append(mix(np.minimum(one, two), np.maximum(one, two), np.full(len(one), band + 2, np.uint64)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _signed(size: int, percent: int, rare: int):
    def run(key, left, right):
        piece = Slice(left.select(["bounds", "codes", "hashes", "n_tokens"]).to_pylist()[0])
        keys, bounds = shingle_sets(piece, size)
        distinct, at, _ = unique(keys)
        answers = sorted(right.select(["bucket", "n", "total"]).to_pylist(), key=lambda r: r["bucket"])
        df = np.concatenate([unsqueeze(r["total"], r["n"], np.uint32) for r in answers])[at] if answers \
            else np.zeros(0, np.uint32)
        ids = left["doc_ids"].combine_chunks().flatten()
        mixed = mix(keys)
        first, second = np.zeros(piece.n_docs, np.uint64), np.zeros(piece.n_docs, np.uint64)
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            first[some] = np.add.reduceat(mixed, bounds[some])
            second[some] = np.bitwise_xor.reduceat(mix(mixed), bounds[some])
        least = percent / (100 - percent)  # smaller sets are similar to equal ones only
        signs, sets = [], []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            n = high - low
            own = np.zeros(0, np.uint64)
            if n >= least:
                d = df[low:high]
                p = max(prefix(n, percent, scheme(b, percent)) for b in bands(n, percent))
                if np.count_nonzero(d == 1) < p:
                    order = np.argsort(d, kind="stable")  # hashes are ascending already
                    own = signatures(keys[low:high][order], d[order], percent, rare)
            signs.append(own.view(np.int64))
            sets.append(squeeze(np.diff(keys[low:high], prepend=np.uint64(0))) if len(own) else None)
        ends = np.concatenate(([0], np.cumsum([len(s) for s in signs]))).astype(np.int32)
        flat = np.concatenate(signs) if signs else np.zeros(0, np.int64)
        return pa.table({
            "doc_id": ids, "n": pa.array(np.diff(bounds)), "d1": pa.array(first.view(np.int64)),
            "d2": pa.array(second.view(np.int64)),
            "signs": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), "keys": pa.array(sets, pa.binary())})
    return run


def similar(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of `left` and `right` are similar, counted over the hashes they share."""
    a, b = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    rows = np.repeat(np.arange(len(a) + len(b)), np.concatenate((a, b)))
    _, column, count = unique(np.concatenate([*left, *right]))
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    rows, column = rows[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    common = np.zeros((len(a), len(b)), np.float64)
    width = 2048
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, (start, start + width))
        grid = np.zeros((len(a) + len(b), width), np.float32)
        grid[rows[low:high], column[low:high] - start] = 1
        common += grid[:len(a)] @ grid[len(a):].T
    return 100 * common >= percent * (a[:, None] + b[None, :] - common)


def _labels(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable over a symmetric matrix of links."""
    label = ids.copy()
    links = links | np.eye(len(ids), dtype=bool)
    while True:
        new = np.where(links, label[None, :], np.iinfo(np.int64).max).min(1)
        if (new == label).all():
            return label
        label = new


def _verify(percent: int):
    def run(key, table):
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        table = table.sort_by([("family", "ascending"), ("doc_id", "ascending")])
        family, ids = table["family"].to_numpy(), table["doc_id"].to_numpy()
        side, sizes, packed = table["side"].to_numpy(), table["n"].to_pylist(), table["keys"].to_pylist()
        cuts = np.flatnonzero(np.concatenate(([True], family[1:] != family[:-1], [True])))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            sets = [np.cumsum(unsqueeze(packed[i], sizes[i], np.uint64), dtype=np.uint64) for i in range(low, high)]
            own, part = ids[low:high], side[low:high]
            a, b = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
            links = np.zeros((len(own), len(own)), bool)
            if len(b):  # two blocks of a large family
                cross = similar([sets[i] for i in a], [sets[i] for i in b], percent)
                links[np.ix_(a, b)] = cross
                links[np.ix_(b, a)] = cross.T
            else:
                links = similar(sets, sets, percent)
            label = _labels(links, own)
            moved = label != own
            out[0].append(own[moved])
            out[1].append(label[moved])
        return pa.table({"doc_id": pa.array(np.concatenate(out[0])), "other": pa.array(np.concatenate(out[1]))})
    return run


def _families(reps: DataFrame) -> DataFrame:
    """(doc_id, family) of the documents that share a signature with another one."""
    signed = stored(reps.select("doc_id", F.explode("signs").alias("sign")), "signs")
    heads = signed.groupBy("sign").agg(F.count("*").alias("docs"), F.min("doc_id").alias("head")).filter("docs > 1")
    star = signed.join(heads, "sign").select("doc_id", "head").filter("doc_id != head").distinct()
    roots = components(star, "doc_id", "head")
    release(signed)
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("family")).unionByName(
        roots.select(F.col("root").alias("doc_id"), F.col("root").alias("family")).distinct())


def _linked(members: DataFrame, percent: int, block: int) -> DataFrame:
    """(doc_id, other) links that connect what similar members of a family connect."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    tasks = max(1, members.count() // (4 * block))
    place = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    small = members.filter(F.col("size") <= block).select(
        F.pmod(F.xxhash64("family"), F.lit(tasks)).alias("place"), F.lit(-1).alias("i"), F.lit(-1).alias("j"),
        F.lit(0).alias("side"), "family", "doc_id", "n", "keys")
    large = members.filter(F.col("size") > block).withColumn("blocks", blocks).withColumn("own", place)
    met = large.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    met = met.select(F.col("family").alias("place"), F.least("own", "with").alias("i"),
                     F.greatest("own", "with").alias("j"),
                     F.when(F.col("own") > F.col("with"), 1).otherwise(0).alias("side"), "family", "doc_id", "n", "keys")
    return small.unionByName(met).groupBy("place", "i", "j").applyInArrow(_verify(percent), "doc_id long, other long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                       percent: int = 80, rare: int = 50, block: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document.

    A document is the set of its distinct `shingle`-word shingles (lower-cased A-Z; fewer words: the
    whole sequence). Two documents link when 100 * intersection >= percent * union, counted exactly;
    `component_id` is the smallest id reachable over links. Documents with equal sets are one class,
    of which only the smallest id is compared. `rare` is the document frequency up to which a single
    shingle is a signature. Families of more than `block` documents are compared block by block: a
    task holds two blocks.

    Defined cases: null texts and texts without words have an empty set and link with nothing; rows
    with a null id link with nothing and have a null component; an id should be unique: rows that
    repeat one with equal text agree, with different texts they are separate documents; an empty table
    gives an empty result; other columns are not read. Ids are whole numbers.
    """
    sliced = encode(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).alias("role"),
                                F.col(text_col).alias("text")))
    asked = sliced.mapInArrow(_ask(n_buckets(sliced), shingle), REQUEST).drop("kind", "wants")
    answers = asked.withColumn("wants", F.lit(0)).groupBy("bucket").applyInArrow(
        _answer, "slice_id long, bucket int, n int, total binary")
    rows = stored(sliced.groupBy("slice_id").cogroup(answers.groupBy("slice_id")).applyInArrow(
        _signed(shingle, percent, rare),
        "doc_id long, n long, d1 long, d2 long, signs array<long>, keys binary"), "sets")
    release(sliced)
    same = ["n", "d1", "d2"]
    classes = stored(rows.filter("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    signed = rows.filter("keys is not null and doc_id is not null")
    reps = classes.select(*same, F.col("rep").alias("doc_id"))
    families = stored(_families(signed.select(*same, "doc_id", "signs").join(reps, [*same, "doc_id"], "left_semi")),
                      "families")
    sizes = families.groupBy("family").agg(F.count("*").alias("size"))
    placed = families.join(sizes, "family").join(reps, "doc_id")
    # the sets themselves move for this join and once more to their tasks
    members = stored(signed.select(*same, "doc_id", "keys").join(placed, [*same, "doc_id"])
                     .select("doc_id", "n", "keys", "family", "size"), "members")
    roots = components(_linked(members, percent, block), "doc_id", "other")
    release(members)
    classed = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left") \
        .select(*same, F.coalesce("root", "rep").alias("component"))
    joined = rows.select("doc_id", *same).join(classed, same, "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"),
                         F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
