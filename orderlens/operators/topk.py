"""Exact top-k by inner product.

The product itself is a blocked matrix multiplication inside Arrow batches. Only k rows per query
leave a task, so pairs are never written out. Which side is sent to every task depends on a
checked size:

* the query side, when it has at most `small_rows` rows: each partition of the corpus keeps its
  own k best per query and the partial lists are merged;
* the corpus side, when that one is small: every batch of queries is answered at once, without a
  shuffle;
* neither: both sides are cut into blocks of near vectors, each with a centre and a radius. A query
  first meets its own block, which gives a floor under its k-th best score; it then meets only blocks
  whose bound (product with the centre plus length times radius) reaches that floor. Each pair of
  blocks that is left is one bounded group of vectors.

Columns that come along are joined to the winners when both sides are large.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_dir

SMALL_ROWS = 20_000
SMALL_BYTES = 64 << 20
CENTRE_BYTES = 32 << 20  # all centres together; with more rows, blocks are split into parts instead
SLACK = 1e-6  # scores are compared after rounding, bounds with room for it
TILE_CELLS = 1 << 20  # scores held at once: 8 MB of doubles, 4 MB of floats
STRIPES = 32          # columns that a rough maximum stands for
MANY = 64             # rough candidates per query, on average, above which all scores are worked out exactly


def _matrix(column) -> np.ndarray:
    """A list column as a two-dimensional array; every row must have the same length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.unique(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes.tolist()}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _ids(column) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) \
        else column.to_numpy()
    return values if values.dtype.kind in "iu" else values.astype(str)


def _best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores per row, the leftmost columns first on ties."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
        above = scores > kth
        room = k - above.sum(axis=1, keepdims=True)
        level = scores == kth
        keep = above | (level & (np.cumsum(level, axis=1) <= room))
    else:
        keep = np.ones(scores.shape, dtype=bool)
    keep &= np.isfinite(scores)
    return np.nonzero(keep)


def _own_cells(query_ids, item_ids) -> tuple[np.ndarray, np.ndarray]:
    """(query position, item position) of equal ids; `item_ids` are sorted."""
    first = np.searchsorted(item_ids, query_ids, side="left")
    n = np.searchsorted(item_ids, query_ids, side="right") - first
    return np.repeat(np.arange(len(query_ids)), n), np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def _screened(query_vecs, rough_queries, item_vecs, rough_items, room, own, k, digits):
    """(row, column, score) of the k best columns per row, or None where a rough look does not help.

    Products of floats are `room` / 2 from the true ones at most. The k-th best of the maxima over k or more
    stripes of columns is no better than the k-th best product, so what lies further than `room` and the
    rounding below it is no hit; the rest is scored in doubles.
    """
    rough = rough_queries @ rough_items
    rough[own] = -np.inf
    n = rough.shape[1] // STRIPES
    tops = rough[:, :n * STRIPES].reshape(len(rough), STRIPES, n).max(axis=1)
    floor = np.partition(tops, n - k, axis=1)[:, n - k] - room - 2 * 10.0 ** -digits
    at = np.flatnonzero(rough >= floor[:, None].astype(np.float32))
    if len(at) > max(MANY, 2 * k) * len(rough) or not np.isfinite(floor).all():
        return None
    rows, cols = np.divmod(at, rough.shape[1])
    scores = np.round(np.einsum("ij,ij->i", query_vecs[rows], item_vecs[cols]), digits)
    order = np.lexsort((cols, -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[best], cols[best], scores[best]


def _score_block(query_ids, query_vecs, item_ids, item_vecs, k, exclude_self, digits):
    """(query position, item position, score) of the k best items per query."""
    order = np.argsort(item_ids, kind="stable")
    item_ids, item_vecs = item_ids[order], item_vecs[order]
    items, rough_items = item_vecs.T, None
    lengths = np.sqrt((query_vecs ** 2).sum(axis=1))
    longest = np.sqrt((item_vecs ** 2).sum(axis=1).max())
    if len(item_ids) >= 2 * STRIPES * (k + 1) and np.isfinite(lengths).all() and max(lengths.max(), longest) < 1e15:
        rough_items, rough_queries = items.astype(np.float32), query_vecs.astype(np.float32)
        room = (query_vecs.shape[1] + 4) * 2.0 ** -22 * lengths * longest
    own = _own_cells(query_ids, item_ids) if exclude_self else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    out_q, out_i, out_s = [], [], []
    tile = max(1, TILE_CELLS // len(item_ids))
    for start in range(0, len(query_ids), tile):
        asked = slice(start, start + tile)
        mine = slice(*np.searchsorted(own[0], (start, start + tile)))
        hidden = own[0][mine] - start, own[1][mine]
        hits = None if rough_items is None else _screened(
            query_vecs[asked], rough_queries[asked], item_vecs, rough_items, room[asked], hidden, k, digits)
        if hits is None:
            scores = np.round(query_vecs[asked] @ items, digits)
            scores[hidden] = -np.inf
            rows, cols = _best_columns(scores, k)
            hits = rows, cols, scores[rows, cols]
        rows, cols, scores = hits
        out_q.append(rows + start)
        out_i.append(order[cols])
        out_s.append(scores)
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


def _keep_best(table: pa.Table, k: int) -> pa.Table:
    """The k best rows per query of a table with _q, score and item_id."""
    q = table["_q"].to_numpy()
    score, ids = table["score"].to_numpy(), _ids(table["item_id"])
    order = np.lexsort((ids, -score, q))
    sorted_q = q[order]
    first = np.searchsorted(sorted_q, sorted_q, side="left")
    return table.take(pa.array(order[np.arange(len(order)) - first < k]))


def _small_side(df: DataFrame, key: str, small_rows: int):
    """The rows as one Arrow table if there are at most `small_rows` of them, else None.

    One aggregation adds up rows and bytes where the rows are; only a side known to be small is
    collected.
    """
    size = sum((F.coalesce(F.size(f.name) * 8 if isinstance(f.dataType, T.ArrayType)
                           else F.octet_length(F.col(f.name).cast("string")), F.lit(0)).cast("bigint")
                for f in df.schema), F.lit(0).cast("bigint"))
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return df.toArrow() if found["n"] <= small_rows and found["size"] <= SMALL_BYTES else None


def _whole(df: DataFrame, vector: str) -> DataFrame:
    """Rows that can be scored: the vector is there and holds no nulls."""
    v = F.col(vector)
    return df.filter(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()))


def exact_top_k(queries: DataFrame, corpus: DataFrame, k: int = 3, *, query_id: str,
                query_vec: str, item_id: str, item_vec: str, carry: list[str] | None = None,
                exclude_self: bool = False, digits: int = 6, small_rows: int = SMALL_ROWS,
                block_rows: int = SMALL_ROWS) -> DataFrame:
    """Rows (query_id, item_id, score, rank, *carry): the k best items of every query.

    Scores are double inner products rounded to `digits`; ties go to the smaller item id. `carry`
    lists further corpus columns to return with each hit, so no join back is needed. Rows whose
    vector is null, empty or holds nulls ask for nothing and are never hits; vectors of different
    lengths are an error.
    """
    carry = list(carry or [])
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("_qv"))
    c = corpus.select(F.col(item_id).alias("item_id"), F.col(item_vec).alias("_iv"), *carry)
    q, c = _whole(q, "_qv"), _whole(c, "_iv")
    out_schema = T.StructType([
        T.StructField("query_id", q.schema["query_id"].dataType),
        T.StructField("item_id", c.schema["item_id"].dataType),
        T.StructField("score", T.DoubleType()),
        *[c.schema[name] for name in carry]])

    held = _small_side(q, "query_id", small_rows)
    if held is not None:
        return _merge(_scan_corpus(c, held, k, exclude_self, digits, out_schema, carry), k, carry)
    held = _small_side(c, "item_id", small_rows)
    if held is not None:
        return _scan_queries(q, held, k, exclude_self, digits, out_schema, carry)
    plan = block_plan(q, c, k, exclude_self=exclude_self, digits=digits, block_rows=block_rows)
    hits = _merge(plan.near.unionByName(_meet(plan.queries, plan.items, plan.met, k, exclude_self, digits)), k, [])
    if not carry:
        return hits
    extra = corpus.select(F.col(item_id).alias("item_id"), *carry)
    return hits.join(extra, "item_id").select("query_id", "item_id", "score", "rank", *carry)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _result(query_ids, table: pa.Table, schema: pa.Schema, carry) -> pa.Table:
    columns = [query_ids, table["item_id"], table["score"], *[table[c] for c in carry]]
    return pa.Table.from_arrays([
        pa.chunked_array(col.chunks if isinstance(col, pa.ChunkedArray) else [col]).cast(f.type)
        for col, f in zip(columns, schema)], schema=schema)


def _scan_corpus(corpus, held, k, exclude_self, digits, out_schema, carry) -> DataFrame:
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast((held["query_id"].combine_chunks(),
                                           _ids(held["query_id"]), _matrix(held["_qv"])))
    schema = _arrow(out_schema)

    def search(batches):
        original, ids, vecs = shared.value
        best = None
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            qi, ii, score = _score_block(ids, vecs, _ids(batch["item_id"]),
                                         _matrix(batch["_iv"]), k, exclude_self, digits)
            hits = pa.Table.from_batches([batch]).select(["item_id", *carry]).take(pa.array(ii))
            hits = hits.append_column("_q", pa.array(qi)).append_column("score", pa.array(score))
            best = _keep_best(hits if best is None else pa.concat_tables([best, hits]), k)
        if best is not None and best.num_rows:
            yield from _result(original.take(best["_q"].combine_chunks()), best, schema,
                               carry).to_batches()

    return corpus.mapInArrow(search, out_schema)


def _scan_queries(queries, held, k, exclude_self, digits, out_schema, carry) -> DataFrame:
    """A query's list is finished, and ranked, in its own task."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((held.select(["item_id", *carry]),
                                           _ids(held["item_id"]), _matrix(held["_iv"])))
    schema = _arrow(out_schema)
    ranked = T.StructType([*out_schema.fields, T.StructField("rank", T.IntegerType())])

    def search(batches):
        items, ids, vecs = shared.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            qi, ii, score = _score_block(_ids(batch["query_id"]), _matrix(batch["_qv"]), ids,
                                         vecs, k, exclude_self, digits)
            order = np.lexsort((ids[ii], -score, qi))
            qi, ii, score = qi[order], ii[order], score[order]
            rank = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") + 1
            hits = items.take(pa.array(ii)).append_column("score", pa.array(score))
            yield from _result(batch["query_id"].take(pa.array(qi)), hits, schema, carry
                               ).append_column("rank", pa.array(rank, pa.int32())).to_batches()

    return queries.mapInArrow(search, ranked).select("query_id", "item_id", "score", "rank", *carry)


# ---- both sides large: blocks of near vectors -----------------------------------------------

@dataclass(frozen=True)
class BlockPlan:
    """`near`: hits of each query in the blocks it met first; `met`: (query_id, cell, block), the further
    blocks it has to meet; `queries`: query_id, cell, _qv; `items`: item_id, block, part, _iv;
    `blocks`: block, radius, n."""

    near: DataFrame
    met: DataFrame
    queries: DataFrame
    items: DataFrame
    blocks: DataFrame


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _nearest(rows: DataFrame, column: str, centres: Broadcast, own: str) -> DataFrame:
    """Adds the nearest centre as `own` and the distance to it."""
    schema = T.StructType([*rows.schema.fields, T.StructField(own, T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def assign(batches):
        points = centres.value
        squares = (points ** 2).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs = _matrix(batch[column])
            chosen, tile = np.zeros(len(vecs), np.int32), max(1, TILE_CELLS // len(points))
            for at in range(0, len(vecs), tile):
                chosen[at:at + tile] = np.argmin(squares - 2 * vecs[at:at + tile] @ points.T, axis=1)
            away = np.sqrt(((vecs - points[chosen]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen), pa.array(away)], names=schema.fieldNames())

    return rows.mapInArrow(assign, schema)


def _bounded(queries: DataFrame, blocks: Broadcast, least: int, floors: bool) -> DataFrame:
    """(query_id, cell, block): without floors the blocks of highest bound that hold `least` items, else
    all others whose bound reaches the query's floor (all, where it has none)."""
    schema = T.StructType([queries.schema["query_id"], T.StructField("cell", T.IntegerType()),
                           T.StructField("block", T.IntegerType())])

    def choose(batches):
        numbers, points, radius, counts = blocks.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs, floor = _matrix(batch["_qv"]), None
            if floors:
                floor = batch["floor"].to_numpy(zero_copy_only=False).astype(np.float64)
            for at in range(0, len(vecs), max(1, TILE_CELLS // max(1, len(numbers)))):
                some = vecs[at:at + max(1, TILE_CELLS // max(1, len(numbers)))]
                bound = some @ points.T + np.sqrt((some ** 2).sum(axis=1))[:, None] * radius
                order = np.argsort(-bound, axis=1, kind="stable")
                first = np.cumsum(counts[order], axis=1) - counts[order] < least
                keep = np.zeros(bound.shape, bool)
                np.put_along_axis(keep, order, first, axis=1)
                if floors:
                    here = floor[at:at + len(some)]
                    keep = ~keep & (np.isnan(here)[:, None] | (bound >= here[:, None] - SLACK))
                rows, cols = np.nonzero(keep)
                taken = pa.array(rows + at)
                yield pa.RecordBatch.from_arrays(
                    [batch["query_id"].take(taken), batch["cell"].take(taken), pa.array(numbers[cols].astype(np.int32))],
                    names=schema.fieldNames())

    return queries.mapInArrow(choose, schema)


def _meet(queries: DataFrame, items: DataFrame, met: DataFrame, k: int, exclude_self: bool, digits: int) -> DataFrame:
    """Partial lists (query_id, item_id, score) of every pair of blocks that `met` leaves over."""
    asked = met.join(queries.select("query_id", "_qv"), "query_id")
    pairs = met.select(F.col("cell").alias("to"), F.col("block").alias("b")).distinct()
    parts = items.select(F.col("block").alias("b"), F.col("part").alias("piece")).distinct()
    left = asked.join(parts, F.col("block") == F.col("b")).select("cell", "block", "piece", "query_id", "_qv")
    right = items.join(pairs, F.col("block") == F.col("b")).select("to", "b", "part", "item_id", "_iv")
    kinds = T.StructType([queries.schema["query_id"], items.schema["item_id"], T.StructField("score", T.DoubleType())])
    schema = _arrow(kinds)

    def search(qs: pa.Table, held: pa.Table) -> pa.Table:
        if not qs.num_rows or not held.num_rows:
            return schema.empty_table()
        qi, ii, score = _score_block(_ids(qs["query_id"]), _matrix(qs["_qv"]), _ids(held["item_id"]),
                                     _matrix(held["_iv"]), k, exclude_self, digits)
        hits = held.select(["item_id"]).take(pa.array(ii)).append_column("score", pa.array(score))
        return _result(qs["query_id"].take(pa.array(qi)), hits, schema, [])

    return left.groupBy("cell", "block", "piece").cogroup(right.groupBy("to", "b", "part")).applyInArrow(search, kinds)


def block_plan(queries: DataFrame, corpus: DataFrame, k: int, *, exclude_self: bool = False, digits: int = 6,
               block_rows: int = SMALL_ROWS) -> BlockPlan:
    """Blocks of both sides and the pairs of them that have to be compared.

    queries: (query_id, _qv), corpus: (item_id, _iv), ids unique. Centres are corpus vectors chosen by a
    hash, one per `block_rows` rows and as many as `CENTRE_BYTES` hold; a block with more rows is cut
    into parts. Queries are put into cells by the same centres, so a cell's queries need the same
    blocks, and a block is sent only to the cells that need it.
    """
    spark = corpus.sparkSession
    size = corpus.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_iv")).alias("width")).first()
    if not size["n"] or not queries.take(1):
        none = queries.join(corpus, F.lit(False)).select("query_id", "item_id", F.lit(0.0).alias("score"))
        cells = none.select("query_id", F.lit(0).alias("cell"), F.lit(0).alias("block"))
        return BlockPlan(none, cells, queries.withColumn("cell", F.lit(0)),
                         corpus.select("item_id", F.lit(0).alias("block"), F.lit(0).alias("part"), "_iv"), cells.limit(0))
    wanted = max(1, min(-(-size["n"] // block_rows), CENTRE_BYTES // (8 * size["width"])))
    chosen = corpus.orderBy(F.xxhash64("item_id")).limit(int(wanted)).select("_iv").toArrow()
    centres = spark.sparkContext.broadcast(np.unique(_matrix(chosen["_iv"]), axis=0))
    near = _stored(_nearest(corpus, "_iv", centres, "block"), "items")
    blocks = _stored(near.groupBy("block").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")), "blocks")
    parts = F.broadcast(blocks.select("block", F.ceil(F.col("n") / F.lit(block_rows)).cast("int").alias("parts")))
    items = near.join(parts, "block").select(
        "item_id", "block", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int").alias("part"), "_iv")
    held = blocks.orderBy("block").collect()  # at most as many rows as there are centres
    numbers = np.array([r["block"] for r in held])
    shapes = spark.sparkContext.broadcast((numbers, centres.value[numbers], np.array([r["radius"] for r in held]),
                                           np.array([r["n"] for r in held])))
    cell = F.col("home") * F.lit(1 << 16) + F.pmod(F.xxhash64("query_id"), F.col("split")).cast("int")
    homes = _stored(_nearest(queries, "_qv", centres, "home"), "queries")
    split = homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("split"))
    celled = _stored(homes.join(F.broadcast(split), "home").select("query_id", cell.alias("cell"), "_qv"), "cells")
    least = k + int(exclude_self)
    first = _stored(_meet(celled, items, _bounded(celled, shapes, least, False), k, exclude_self, digits), "near")
    best = _merge(first, k, []).groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("found"))
    floors = celled.join(best, "query_id", "left").select(
        "query_id", "cell", "_qv", F.when(F.col("found") == k, F.col("floor")).alias("floor"))
    met = _stored(_bounded(floors, shapes, least, True), "met")
    return BlockPlan(first, met, celled, items, blocks)


def _rank(hits: DataFrame, carry: list[str]) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("item_id"))
    return hits.withColumn("rank", F.row_number().over(order)).select(
        "query_id", "item_id", "score", "rank", *carry)


def _merge(hits: DataFrame, k: int, carry: list[str]) -> DataFrame:
    """The k best of the partial lists; the row limit per query also runs before the shuffle."""
    return _rank(hits, carry).filter(F.col("rank") <= k)
