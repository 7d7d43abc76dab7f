"""The corpus as slices of word codes, and counting n-grams over them in blocks.

A slice is some megabytes of documents: one row with a local dictionary of word hashes and every
word's code in it. N-gram keys are unique inside a slice before they are shuffled, sorted, packed and
sent to the bucket that owns their hash range; buckets answer every slice with its keys' totals, in
the order the slice asked for them. So an n-gram that is everywhere costs one entry per slice, and a
bucket holds about `BUCKET_KEYS` keys however large the corpus is, because there are more buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .base import mix, slices, stored, words

BUCKET_KEYS = 1_500_000
SLICE_BYTES = 5 << 20
SLICE_COLUMNS = "slice_id long, role int, doc_ids array<{kind}>, bounds binary, codes binary, hashes binary, n_tokens long"
REQUEST = "kind int, bucket int, slice_id long, n int, wants int, hashes binary, learn binary, tune binary"
END = np.uint64(0x5851F42D4C957F2D)  # the hash of the end of a text


def squeeze(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unsqueeze(data: bytes, n: int, dtype) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    width = np.dtype(dtype).itemsize
    raw = pa.Codec("zstd", 1).decompress(data, decompressed_size=n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(dtype).ravel()


def _slice(parts: list[pa.RecordBatch], role: int, number: int):
    table = pa.Table.from_batches(parts).combine_chunks()
    codes, offsets, values = words(table["text"].combine_chunks(), lower=True)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in values.to_pylist()), np.uint64, len(values))
    ids = table["doc_id"].combine_chunks()
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([role], pa.int32()), lists,
         pa.array([offsets.astype(np.int64).tobytes()], pa.binary()),
         pa.array([squeeze(codes.astype(np.uint32))], pa.binary()),
         pa.array([hashes.tobytes()], pa.binary()), pa.array([len(codes)])],
        names=["slice_id", "role", "doc_ids", "bounds", "codes", "hashes", "n_tokens"])


def _encode(batches):
    held: dict[int, list] = {}
    number = TaskContext.get().partitionId() << 32
    for batch in slices(batches, "text", SLICE_BYTES // 4):
        roles = batch.column("role").to_numpy(zero_copy_only=False)
        for role in np.unique(roles).tolist():
            part = batch.filter(pa.array(roles == role))
            parts = held.setdefault(role, [])
            parts.append(part)
            if sum(p.column("text").nbytes for p in parts) >= SLICE_BYTES:
                yield _slice(held.pop(role), role, number)
                number += 1
    for role, parts in held.items():
        yield _slice(parts, role, number)
        number += 1


def encode(docs: DataFrame) -> DataFrame:
    """Stores (doc_id, role, text) as slices of lower-cased word codes; a slice has one role."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
                  .mapInArrow(_encode, SLICE_COLUMNS.format(kind=kind)), "slices")


class Slice:
    """A decoded slice: codes, offsets by document and the hash of each code (the end of text last)."""

    def __init__(self, row: dict):
        self.bounds = np.frombuffer(row["bounds"], np.int64)
        self.codes = unsqueeze(row["codes"], int(row["n_tokens"]), np.uint32).astype(np.int64)
        self.hashes = np.append(np.frombuffer(row["hashes"], np.uint64), END)
        self.end = len(self.hashes) - 1
        self.n_docs = len(self.bounds) - 1

    def with_ends(self) -> tuple[np.ndarray, np.ndarray]:
        """(codes with the end of text behind each document, offsets)."""
        bounds = self.bounds + np.arange(self.n_docs + 1)
        codes = np.full(int(bounds[-1]), self.end, np.int64)
        mask = np.ones(len(codes), bool)
        mask[bounds[1:] - 1] = False
        codes[mask] = self.codes
        return codes, bounds


def unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, position of each element's key among them, counts)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, bool)
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return ranked[starts], at, np.diff(np.append(starts, len(keys)))


def requests(kind: int, slice_id: int, keys: np.ndarray, learn: np.ndarray | None, tune: np.ndarray | None,
             wants: int, n_buckets: int):
    """Request rows for sorted distinct keys, one per bucket met; counts None mean none."""
    edges = [(i << 64) // n_buckets for i in range(1, n_buckets)]
    cuts = np.concatenate(([0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]))
    for bucket in np.flatnonzero(np.diff(cuts)).tolist():
        low, high = cuts[bucket], cuts[bucket + 1]
        part = keys[low:high]
        yield {"kind": kind, "bucket": bucket, "slice_id": slice_id, "n": int(high - low), "wants": wants,
               "hashes": squeeze(np.diff(part, prepend=np.uint64(0))),
               "learn": squeeze(learn[low:high].astype(np.uint32)) if learn is not None else None,
               "tune": squeeze(tune[low:high].astype(np.uint32)) if tune is not None else None}


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """A bucket's requests: (key of each entry as a position, its learn and tune totals, sizes, rows)."""
    rows = table.select(["slice_id", "n", "wants"]).to_pylist()
    sizes = np.array([r["n"] for r in rows], np.int64)
    keys = np.concatenate([np.cumsum(unsqueeze(h, n, np.uint64), dtype=np.uint64)
                           for h, n in zip(table["hashes"].to_pylist(), sizes.tolist())])
    _, at, _ = unique(keys)
    totals = []
    for name in ("learn", "tune"):
        counts = np.concatenate([unsqueeze(c, n, np.uint32) if c is not None else np.zeros(n, np.uint32)
                                 for c, n in zip(table[name].to_pylist(), sizes.tolist())])
        totals.append(np.bincount(at, weights=counts, minlength=int(at.max()) + 1).astype(np.int64))
    return at, totals[0], totals[1], np.concatenate(([0], np.cumsum(sizes))), rows


def n_buckets(sliced: DataFrame) -> int:
    total = sliced.agg(F.sum("n_tokens")).first()[0] or 0
    return max(1, -(-total // BUCKET_KEYS))


__all__ = ["BUCKET_KEYS", "REQUEST", "Slice", "encode", "gathered", "mix", "n_buckets", "requests", "squeeze",
           "unique", "unsqueeze"]
