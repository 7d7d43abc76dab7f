"""Best-fit packing of tokenised documents, partition by partition and then up a merge tree."""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .base import row_sums, slices, stored, words

PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII without the apostrophe
LETTERS = "".join(chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7))
PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[!-&(-/:-@\[-`{-~]*$"
MEMO = 400_000  # words remembered by a task
PIECE = ["piece", "start", "length", "ids_crc32"]


class WordTokenizer:
    """Token ids of single words, each worked out once.

    The tokenizer drops white space, so a text's ids are those of its words in order. Words made of
    letters and a tail of punctuation are two pre-tokens, known without running its normaliser; any
    other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.memo: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: chr(b) for b in shown}
        for n, b in enumerate(b for b in range(256) if b not in self.bytes):
            self.bytes[b] = chr(256 + n)

    def _piece(self, piece: str) -> bytes:
        known = self.memo.get(piece)
        if known is None:
            text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes)
            known = array("I", [t.id for t in self.model.tokenize(text)]).tobytes() if piece else b""
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = known
        return known

    def ids(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, number of ids) of an array of words."""
        plain = pc.match_substring_regex(values, PLAIN)
        lower = pc.utf8_lower(values.filter(plain))
        stems = pc.utf8_rtrim(lower, characters=PUNCTUATION).dictionary_encode()
        tails = pc.utf8_ltrim(lower, characters=LETTERS).dictionary_encode()
        stem_ids = [self._piece(s) for s in stems.dictionary.to_pylist()]
        tail_ids = [self._piece(s) for s in tails.dictionary.to_pylist()]
        fast = (stem_ids[s] + tail_ids[t] for s, t in zip(stems.indices.to_pylist(), tails.indices.to_pylist()))
        rest = values.filter(pc.invert(plain)).to_pylist()
        slow = (array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(rest, add_special_tokens=False))
        parts = [next(fast) if p else next(slow) for p in plain.to_pylist()]
        return (np.frombuffer(b"".join(parts), np.uint32),
                np.fromiter(map(len, parts), np.int64, len(parts)) // 4)


def encode(tokenizer: WordTokenizer, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts with `end_id` behind each, offsets by text)."""
    codes, offsets, values = words(texts, lower=False)
    used = np.unique(codes)
    flat, sizes = tokenizer.ids(values.take(pa.array(used)))
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    codes = np.searchsorted(used, codes)
    n = sizes[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts[codes] - (ends - n), n) + np.arange(total)
    bounds = np.concatenate(([0], np.cumsum(row_sums(n, offsets) + 1)))
    out = np.full(int(bounds[-1]), end_id, np.uint32)
    mask = np.ones(len(out), bool)
    mask[bounds[1:] - 1] = False
    out[mask] = flat[at]
    return out, bounds


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        tokenizer = WordTokenizer(path)
        for batch in slices(batches, "text"):
            ids, bounds = encode(tokenizer, batch.column("text"), end_id)
            rows: list[list[int]] = [[], [], [], [], []]
            for doc, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                for piece, at in enumerate(range(low, high, capacity)):
                    stop = min(at + capacity, high)
                    for column, value in zip(rows, (doc, piece, at - low, stop - at,
                                                    zlib.crc32(ids[at:stop].astype("<u4", copy=False)))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()),
                 *[pa.array(c, pa.int64()) for c in rows[2:]]], names=["doc_id", *PIECE])
    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of each document: only documents longer than `capacity` are cut."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id),
                           f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, largest item first: lists of item positions. Open bins are found by a bit per free space."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, bins = 0, []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        above = bits >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            chosen = free[space].pop()
            if not free[space]:
                bits ^= 1 << space
            bins[chosen].append(item)
        else:
            space, chosen = capacity, len(bins)
            bins.append([item])
        if space > size:
            free[space - size].append(chosen)
            bits |= 1 << (space - size)
    return bins


def _round(capacity: int, full: float, carry: int, step: int, last: bool):
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        sizes = table["size"].to_numpy().astype(np.int64)
        bins = best_fit(sizes, capacity)
        fill = np.array([int(sizes[b].sum()) for b in bins])
        order = np.argsort(fill, kind="stable")
        merge = np.zeros(len(bins), bool)
        if not last:
            merge[order[:carry]] = True
            merge &= fill < full * capacity
        part = TaskContext.get().partitionId()
        lists = table["members"].combine_chunks()
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        items = np.concatenate([np.array(b) for b in bins]).astype(np.int64)
        counts = np.diff(offsets)
        n = counts[items]
        # members of a bin in the order of its items, each moved by what lies before its item
        base = np.concatenate([np.cumsum(np.concatenate(([0], sizes[b][:-1]))) for b in bins])
        at = np.repeat(offsets[items] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        moved = flat.take(pa.array(at))
        fields = {f.name: moved.field(f.name) for f in moved.type}
        fields["offset"] = pa.array(fields["offset"].to_numpy() + np.repeat(base, n))
        members = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
        per_bin = np.array([int(counts[b].sum()) for b in bins])
        bounds = np.concatenate(([0], np.cumsum(per_bin))).astype(np.int32)
        number = (np.int64(step) << 56) + (np.int64(part) << 32) + np.arange(len(bins), dtype=np.int64)
        yield from pa.Table.from_arrays(
            [pa.array(merge), pa.array(number), pa.array(fill),
             pa.ListArray.from_arrays(pa.array(bounds), members)],
            names=["merge", "sequence_id", "size", "members"]).to_batches(max_chunksize=5000)
    return run


def pack(items: DataFrame, capacity: int = 4096, full: float = 0.995, carry: int = 256,
         fan_in: int = 8) -> DataFrame:
    """Adds `sequence_id` and `offset` to rows with a `length` of at most `capacity`.

    Every partition packs its rows by best fit, largest first. Bins filled to `full` are final; of
    the others the `carry` least filled ones go on as items, and `fan_in` partitions at a time are
    packed again, until one is left. After best fit at most one bin of a task is half empty, so bins
    that stay behind could hardly be merged, and a task gets `fan_in * carry` items at most: the
    width of the tree grows with the data, no task does. Nothing is dropped: bins that are not
    carried on are simply final.

    Defined cases: an empty table gives an empty result; equal rows are packed separately; lengths
    must be 1 to `capacity`.
    """
    member = F.struct(*items.columns, F.lit(0).cast("long").alias("offset"))
    level = items.select(F.col("length").cast("long").alias("size"), F.array(member).alias("members"))
    fields = T.StructType([T.StructField("merge", T.BooleanType()), T.StructField("sequence_id", T.LongType()),
                           T.StructField("size", T.LongType()), level.schema["members"]])
    parts, step, done = max(1, level.rdd.getNumPartitions()), 0, []
    while True:
        last = parts == 1
        packed = stored(level.mapInArrow(_round(capacity, full, carry, step, last), fields), "bins")
        done.append(packed.filter("not merge").select("sequence_id", F.explode("members").alias("m")))
        if last:
            break
        parts, step = -(-parts // fan_in), step + 1
        level = packed.filter("merge").select("size", "members").repartition(parts)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*[F.col(f"m.{c}").alias(c) for c in items.columns], "sequence_id",
                      F.col("m.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1,
                   id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Defined cases: null and empty texts are the single token `end_id`; a text of any length is cut
    into pieces of `capacity` tokens, the last one shorter; rows with equal or null ids are packed
    separately; an empty table gives an empty result; other columns are not read.
    """
    return pack(stored(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces"),
                capacity, **options)
