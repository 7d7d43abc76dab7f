"""What the text operators share: reading, stored intermediates, words as integer codes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import work_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` once to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def release(*frames: DataFrame) -> None:
    """Empties stored frames whose every reader has itself been stored or collected."""
    for frame in frames:
        frame.sparkSession.createDataFrame([], frame.schema).write.mode("overwrite").parquet(frame.stored_at)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(kept == "", 0).otherwise(F.size(F.split(kept, GAP))).cast("long")


def crc_mod(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo `mod`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % mod


def slices(batches: Iterator[pa.RecordBatch], column: str,
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows whose texts hold about `max_bytes` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text as codes into a dictionary: (codes, offsets by text, dictionary).

    Words are runs of anything but the ASCII white space characters; null is the empty text. The
    dictionary may hold an entry (the empty word) that no code refers to.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    codes, values = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
    offsets = offsets - offsets[0]
    empty = pc.index(values, "").as_py() if len(values) else -1
    if empty >= 0:
        real = codes != empty
        offsets = np.concatenate(([0], np.cumsum(real)))[offsets]
        codes = codes[real]
    return codes.astype(np.int64), offsets, values


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each element of a ragged array, the index of the row it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if values.dtype.kind == "f":  # running totals would lose digits
        return np.bincount(owner(offsets), weights=values, minlength=len(offsets) - 1)
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def mix(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of aligned integer arrays."""
    out = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for part in parts:
            out ^= part.astype(np.uint64)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
            out *= np.uint64(0x94D049BB133111EB)
            out ^= out >> np.uint64(32)
    return out


def seen_before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to an earlier element, occurs at least twice) for each element."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.concatenate(([False], ranked[1:] == ranked[:-1])) if len(keys) else np.zeros(0, bool)
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same
    twice[order] = same | np.concatenate((same[1:], [False])) if len(keys) else same
    return later, twice
