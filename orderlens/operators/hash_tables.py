"""Approximate top-k by random-projection hash tables: the opt-in path beside the exact one.

Every table has a few sign vectors. A vector's code in a table says on which side of each sign vector
it lies, so near vectors often share a code. A table's buckets are posting lists of item ids. A query
looks into its own bucket of every table and into those across the sign vectors that it lies closest
to; what it meets there is scored exactly, so scores are never approximate, only the candidates are.

Buckets of any size are met in bounded pieces: items are cut into parts and queries into cells, and a
(part, cell) pair is one matrix product that returns k rows per query.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .topk import (SMALL_ROWS, _arrow, _ids, _matrix, _merge, _result, _score_block, _stored, _whole)

MAX_BITS = 30
CODED = T.ArrayType(T.StructType([T.StructField("table", T.IntegerType()), T.StructField("code", T.IntegerType())]))


@dataclass(frozen=True)
class HashIndex:
    """`items`: item_id, _iv and carried columns; `postings`: table, code, item_id; `keep`: the copies of
    a vector that are posted."""

    items: DataFrame
    postings: DataFrame
    tables: int
    bits: int
    keep: int


def sign_vectors(tables: int, bits: int, width: int) -> np.ndarray:
    """(table, bit, width) of 1 and -1, from a hash of the three numbers."""
    first = (hashlib.md5(f"{t}:{b}:{d}".encode()).hexdigest()[0] < "8"
             for t in range(tables) for b in range(bits) for d in range(width))
    return np.where(np.fromiter(first, bool, tables * bits * width), 1.0, -1.0).reshape(tables, bits, width)


def _coded(df: DataFrame, vector: str, index_tables: int, bits: int, probes: int) -> DataFrame:
    """Adds `_at`: the (table, code) pairs of each vector, with those of its `probes` nearest neighbour buckets."""
    schema = T.StructType([*df.schema.fields, T.StructField("_at", CODED)])
    kind = _arrow(schema).field("_at").type
    probes = min(probes, bits)

    def add(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs = _matrix(batch[vector])
            signs = sign_vectors(index_tables, bits, vecs.shape[1])
            codes = np.zeros((len(vecs), index_tables, 1 + probes), np.int32)
            for t in range(index_tables):
                side = vecs @ signs[t].T
                own = ((side >= 0) << np.arange(bits)).sum(axis=1)
                near = np.argsort(np.abs(side), axis=1, kind="stable")[:, :probes]
                codes[:, t, 0] = own
                codes[:, t, 1:] = own[:, None] ^ (1 << near)
            each = index_tables * (1 + probes)
            numbers = np.tile(np.repeat(np.arange(index_tables, dtype=np.int32), 1 + probes), len(vecs))
            pairs = pa.StructArray.from_arrays([pa.array(numbers), pa.array(codes.ravel())], names=["table", "code"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * each), pairs)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists.cast(kind)], names=schema.fieldNames())

    return df.mapInArrow(add, schema)


def build_hash_index(corpus: DataFrame, *, item_id: str, item_vec: str, carry: list[str] | None = None,
                     tables: int = 12, bucket_rows: int = 1024, keep: int = 16) -> HashIndex:
    """Writes the items once and a posting per item and table.

    The number of sign vectors follows the corpus, so a bucket holds about `bucket_rows` rows. Of equal
    vectors only the `keep` smallest ids are posted: ties go to the smaller id, so the others can be
    in no list of fewer than `keep` hits. Rows without a whole vector are left out.
    """
    rows = _whole(corpus.select(F.col(item_id).alias("item_id"), F.col(item_vec).alias("_iv"), *(carry or [])), "_iv")
    same = Window.partitionBy("_iv").orderBy("item_id")
    items = _stored(rows.withColumn("_copy", F.row_number().over(same)).filter(F.col("_copy") <= keep).drop("_copy"),
                    "hash-items")
    bits = max(1, min(MAX_BITS, (-(-items.count() // bucket_rows) - 1).bit_length()))
    posted = _coded(items.select("item_id", "_iv"), "_iv", tables, bits, 0).select("item_id", F.explode("_at").alias("_a"))
    return HashIndex(items, _stored(posted.select("_a.table", "_a.code", "item_id"), "postings"), tables, bits, keep)


def _pieces(rows: DataFrame, name: str, block_rows: int) -> DataFrame:
    """(table, code, name): the number of pieces of at most about `block_rows` rows in each bucket."""
    return rows.groupBy("table", "code").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias(name))


def hash_top_k(queries: DataFrame, index: HashIndex, k: int = 3, *, query_id: str, query_vec: str,
               carry: list[str] | None = None, probes: int = 3, exclude_self: bool = False, digits: int = 6,
               block_rows: int = SMALL_ROWS) -> DataFrame:
    """Rows (query_id, item_id, score, rank, *carry) as `exact_top_k` gives them, out of the items that
    share a bucket with the query or lie in one of the `probes` buckets next to it, in any table.

    A query that meets fewer than k items gets fewer. Only the buckets that are asked for are read, and
    only their items' vectors are moved: once per table and cell that needs them.
    """
    if k + int(exclude_self) > index.keep:
        raise ValueError(f"the index keeps {index.keep} copies of a vector, too few for {k} hits")
    carry = list(carry or [])
    asked = _whole(queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("_qv")), "_qv")
    met = _stored(_coded(asked, "_qv", index.tables, index.bits, probes).select(
        "query_id", "_qv", F.explode("_at").alias("_a")).select("_a.table", "_a.code", "query_id", "_qv"), "asked")
    cells = _pieces(met, "cells", block_rows)
    parts = _pieces(index.postings.join(cells.select("table", "code"), ["table", "code"], "left_semi"), "parts", block_rows)
    shape = _stored(cells.join(parts, ["table", "code"]), "buckets")
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = met.join(shape, ["table", "code"]).withColumn("cell", deal("query_id", "cells")).select(
        "table", "code", "cell", every("parts").alias("part"), "query_id", "_qv")
    wanted = index.postings.join(shape, ["table", "code"]).withColumn("part", deal("item_id", "parts")).select(
        "table", "code", "part", every("cells").alias("cell"), "item_id")
    right = wanted.join(index.items.select("item_id", "_iv"), "item_id")
    kinds = T.StructType([asked.schema["query_id"], index.items.schema["item_id"], T.StructField("score", T.DoubleType())])
    schema = _arrow(kinds)

    def search(qs: pa.Table, held: pa.Table) -> pa.Table:
        if not qs.num_rows or not held.num_rows:
            return schema.empty_table()
        qi, ii, score = _score_block(_ids(qs["query_id"]), _matrix(qs["_qv"]), _ids(held["item_id"]),
                                     _matrix(held["_iv"]), k, exclude_self, digits)
        hits = held.select(["item_id"]).take(pa.array(ii)).append_column("score", pa.array(score))
        return _result(qs["query_id"].take(pa.array(qi)), hits, schema, [])

    piece = ["table", "code", "part", "cell"]
    found = left.groupBy(*piece).cogroup(right.groupBy(*piece)).applyInArrow(search, kinds)
    hits = _merge(found.groupBy("query_id", "item_id").agg(F.max("score").alias("score")), k, [])
    if not carry:
        return hits
    return hits.join(index.items.select("item_id", *carry), "item_id").select("query_id", "item_id", "score", "rank", *carry)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: exact hits, how many of them were found, and the share."""
    key = ["query_id", "item_id"]
    both = exact.select(*key).join(found.select(*key, F.lit(1).alias("_hit")), key, "left")
    return both.agg(F.count(F.lit(1)).alias("n_exact"), F.count("_hit").alias("n_found"),
                    F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias("recall"))
