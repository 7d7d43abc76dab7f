"""Removing repeated multi-line chunks whose borders are chosen by the lines themselves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .base import mix, owner, slices, stored

BLANK = " \t\n\x0b\x0c\r"
STEP = np.uint64(0x9E3779B97F4A7C15)  # any odd number: multiplier of the hash of a chunk


def line_hashes(lines: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines))


def chunk_spans(hashes: np.ndarray, owner: np.ndarray, modulus: int, residues: tuple[int, ...], most: int
                ) -> tuple[np.ndarray, ...]:
    """(first line, last line, residue) of the content-defined chunks of two lines or more of all texts.

    `owner` numbers the text of each line. A rolling hash over two line hashes is taken behind every
    line. For each residue, a border follows the lines where it has that residue, and every line opens a
    chunk that ends at the text's next border (none, if that is more than `most` lines away). A chunk
    depends on its own lines alone, so the same lines make the same chunks whatever stands around them;
    and since every rolling hash has some residue, all residues together find every repeated passage of
    two lines or more.
    """
    rolling = mix(hashes[:-1], hashes[1:]) % np.uint64(modulus)  # behind lines 1, 2, ...
    within = owner[1:] == owner[:-1]
    firsts, lasts, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for residue in residues:
        borders = np.flatnonzero(within & (rolling == residue)) + 1
        if len(borders):
            opens = np.arange(int(borders[-1]))
            ends = borders[np.searchsorted(borders, opens + 1)]
            near = (ends - opens < most) & (owner[ends] == owner[opens])
            firsts.append(opens[near])
            lasts.append(ends[near])
            kinds.append(np.full(int(near.sum()), residue))
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(kinds)


def chunk_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One hash per chunk from the hashes of its lines and their order."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(hashes), STEP))), dtype=np.uint64)
        before = np.zeros(len(hashes) + 1, np.uint64)
        # sum of h[i] * STEP^i, scaled so that equal chunks at different places agree
        np.cumsum(hashes * powers[:-1], out=before[1:], dtype=np.uint64)
        inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
        back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(hashes), inverse))), dtype=np.uint64)
        return mix((before[last + 1] - before[first]) * back[first], last - first)


def shown_chunks(lines: list[str], owner: np.ndarray, shape: tuple) -> tuple[np.ndarray, ...]:
    """(first line, last line, residue, hash) of the chunks that have a visible character."""
    hashes = line_hashes(lines)
    first, last, kind = chunk_spans(hashes, owner, *shape)
    seen = np.concatenate(([0], np.cumsum([bool(x.strip(BLANK)) for x in lines])))
    shown = seen[last + 1] > seen[first]
    first, last, kind = first[shown], last[shown], kind[shown]
    return first, last, kind, chunk_hashes(hashes, first, last).astype(np.int64)


def chunks_of(text: str, shape: tuple) -> list[tuple[int, int, int, int]]:
    """The chunks of one text."""
    lines = text.split("\n")
    return list(zip(*[c.tolist() for c in shown_chunks(lines, np.zeros(len(lines), np.int64), shape)]))


def _keys(shape: tuple):
    def run(batches):
        for batch in slices(batches, "text"):
            parts = pc.split_pattern(pc.fill_null(batch.column("text"), ""), "\n")
            offsets = parts.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            of = owner(offsets)
            first, _, kind, hashed = shown_chunks(parts.flatten().to_pylist(), of, shape)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of[first])), pa.array((first - offsets[of[first]]).astype(np.int32)),
                 pa.array(kind.astype(np.int32)), pa.array(hashed)], names=["doc_id", "line", "kind", "hash"])
    return run


def _texts(shape: tuple):
    """The wanted chunks' texts; `wanted` lists (line, kind, hash, first)."""
    def run(batches):
        for batch in slices(batches, "text"):
            rows: list[list] = [[], [], [], [], [], []]
            for at, (text, wanted) in enumerate(zip(batch.column("text").to_pylist(),
                                                    batch.column("wanted").to_pylist())):
                lines = (text or "").split("\n")
                ends = {(first, kind, hashed): last for first, last, kind, hashed in chunks_of(text or "", shape)}
                for w in wanted:
                    last = ends.get((w["line"], w["kind"], w["hash"]))
                    if last is not None:
                        for column, value in zip(rows, (at, w["line"], w["kind"], w["hash"], w["first"],
                                                        "\n".join(lines[w["line"]:last + 1]))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()),
                 pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.bool_()),
                 pa.array(rows[5], pa.string())],
                names=["doc_id", "line", "kind", "hash", "first", "bytes"])
    return run


def _clean(shape: tuple):
    def run(batches):
        for batch in slices(batches, "text"):
            kept, total, gone = [], [], []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist()):
                total.append(0 if text is None else text.count("\n") + 1)
                if not drop:
                    kept.append(text)
                    gone.append(0)
                    continue
                lines = (text or "").split("\n")
                out = {(d["line"], d["kind"], d["hash"]) for d in drop}
                found = chunks_of(text or "", shape)
                # lines of an equal chunk that stays in this text are not removed by a later one over them
                stays = {}
                for first, last, kind, hashed in found:
                    if (first, kind, hashed) not in out:
                        stays.setdefault((kind, hashed), []).append((first, last))
                away = set()
                for first, last, kind, hashed in found:
                    if (first, kind, hashed) in out:
                        start = first
                        for a, b in stays.get((kind, hashed), ()):
                            if a < first <= b and lines[a:b + 1] == lines[first:last + 1]:
                                start = max(start, b + 1)
                        away.update(range(start, last + 1))
                kept.append("\n".join(x for i, x in enumerate(lines) if i not in away))
                gone.append(len(away))
            columns = [batch.column(n) for n in batch.schema.names if n not in ("text", "drop")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                names=[*[n for n in batch.schema.names if n not in ("text", "drop")],
                       "text", "n_lines", "n_removed"])
    return run


def repeated_chunks(rows: DataFrame, shape: tuple) -> DataFrame:
    """(doc_id, drop): the chunks of each document that repeat an earlier chunk, byte for byte."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    keys = stored(rows.mapInArrow(_keys(shape), f"doc_id {kind}, line int, kind int, hash long"), "chunks")
    group = keys.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line")).alias("head"))
    again = keys.join(group.filter("n > 1"), "hash").select(
        "doc_id", "line", "kind", "hash",
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("line") == F.col("head.line"))).alias("first"))
    wanted = again.groupBy("doc_id").agg(F.collect_set(F.struct("line", "kind", "hash", "first")).alias("wanted"))
    joined = rows.alias("r").join(wanted.alias("w"), F.expr("r.doc_id <=> w.doc_id")) \
        .select("r.doc_id", "r.text", "w.wanted")
    texts = stored(joined.mapInArrow(
        _texts(shape), f"doc_id {kind}, line int, kind int, hash long, first boolean, bytes string"), "chunk-texts")
    heads = texts.filter("first").groupBy("hash").agg(F.min("bytes").alias("head"))
    same = texts.filter("not first").join(heads, "hash").filter(F.col("bytes") == F.col("head"))
    return same.groupBy("doc_id").agg(F.collect_set(F.struct("line", "kind", "hash")).alias("drop"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 2,
               residues: tuple[int, ...] | None = None, most: int = 16) -> DataFrame:
    """All columns of `docs` with the cleaned text, then `n_lines` and `n_removed` (lines removed).

    Lines (parts between `\\n`) form content-defined chunks of two to `most` lines, see `chunk_spans`. Of
    chunks that occur more than once anywhere, the occurrence with the smallest (id, position) stays and
    the lines of the others go, once their bytes are found equal to it. With all residues (the default)
    every repeated passage of two lines or more is found wherever it stands; fewer residues hash less
    and find a passage of n lines with a chance of 1 - (1 - residues / modulus) ** (n - 1). Only hashes of
    all chunks are shuffled; texts of repeated chunks are fetched for the comparison. A chunk that a
    third of all documents share is counted before the shuffle.

    Defined cases: a null text stays null with 0 lines; an empty text has one empty line; chunks
    without a visible character are never removed; rows that repeat an id are cleaned by the union of
    that id's findings, and rows that repeat id and text count as one document (so copies under one
    id stay); null ids are one id, the smallest; a text of any length is cut whole; if `docs` has
    columns named like the results, the results replace them.
    """
    shape = (modulus, tuple(range(modulus)) if residues is None else tuple(residues), most)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    drop = repeated_chunks(rows, shape)
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    plain = docs.select(F.struct(*[F.col(c) for c in others]).alias("others"), F.col(id_col).alias("key"),
                        F.col(text_col).cast("string").alias("text"))
    joined = plain.join(drop, plain["key"].eqNullSafe(drop["doc_id"]), "left").select("others", "text", "drop")
    kinds = T.StructType([joined.schema["others"], T.StructField("text", T.StringType()),
                          T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    done = joined.mapInArrow(_clean(shape), kinds)
    return done.select(*[F.col("others")[c].alias(c) for c in others],
                       *[F.col("text").alias(text_col), "n_lines", "n_removed"])

