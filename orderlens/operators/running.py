"""Running totals, ranks and carried values that survive hot keys.

A plain window puts all rows of one key into one task. Here a key's rows are cut into ordered
buckets: each bucket is reduced to one small row (partial aggregation runs before the shuffle),
the per-bucket results are accumulated in bucket order, and the row-level window runs inside one
bucket only. The result equals the plain window over the whole key.

Buckets may be given (a hash prefix, say) or found: `range_pieces` sorts rows by key and order into
pieces whose borders come from a sample, so they hold about equally many rows whatever the values
are: one key, one day, nulls or sparse 64-bit numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir

HOT_ROWS = 1_000_000
HOT_SAMPLE = 1_000
PIECE_ROWS = 1_000_000


@dataclass(frozen=True)
class Running:
    """One running value. `kind` is sum, min, max, count or last (last non-null)."""

    kind: str
    value: Column
    inclusive: bool = False
    default: object = None


def _merge(kind: str):
    return {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max,
            "last": lambda c: F.last(c, ignorenulls=True)}[kind]


def _within(kind: str):
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
            "last": lambda c: F.last(c, ignorenulls=True)}[kind]


def _combine(kind: str, before: Column, inside: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(before + inside, before, inside)
    if kind == "last":
        return F.coalesce(inside, before)
    return (F.least if kind == "min" else F.greatest)(before, inside)


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with about `min_rows` rows or more, or None when there are none.

    One counting job over the key column. It only steers how a window is planned, never what it
    returns, so for large limits the keys are counted on a sample (about 1,000 rows for a key at
    the limit; half of that counts as hot) and the shuffle stays a thousandth of the table. Small
    limits are counted exactly. The keys stay a stored table: their number is not bounded, and a join
    with them is planned by the table's size.
    """
    share = min(1.0, HOT_SAMPLE / min_rows)
    limit = min_rows if share == 1.0 else min_rows * share / 2
    seen = df.select(key)  # null is a key like any other: a window puts its rows together too
    if share < 1.0:
        seen = seen.sample(share, seed=17)
    counts = seen.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    found = _stored(counts.filter(F.col("_n") > F.lit(limit)).select(key), "hot-keys")
    return found if found.take(1) else None


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_bucket(df: DataFrame, key: str, bucket: Column, hot: DataFrame) -> DataFrame:
    """Adds `_bucket`: the given bucket for hot keys, null (one bucket) for all others."""
    marked = hot.select(F.col(key).alias("_hot"), F.lit(True).alias("_is_hot"))
    joined = df.join(marked, F.col(key).eqNullSafe(F.col("_hot")), "left")
    return joined.withColumn("_bucket", F.when(F.col("_is_hot"), bucket)).drop("_hot", "_is_hot")


def plain_running(df: DataFrame, keys: list[str], order: list,
                  values: dict[str, Running]) -> DataFrame:
    """The same columns as `running`, by one window per key; for keys of ordinary size."""
    window = Window.partitionBy(*keys).orderBy(*order)
    out = []
    for name, v in values.items():
        last = 0 if v.inclusive else -1
        c = _within(v.kind)(v.value).over(window.rowsBetween(Window.unboundedPreceding, last))
        out.append((c if v.default is None else F.coalesce(c, F.lit(v.default))).alias(name))
    return df.select("*", *out)


def running(df: DataFrame, keys: list[str], order: list, bucket: str,
            values: dict[str, Running]) -> DataFrame:
    """Adds one column per entry of `values`, over `keys` in `order`.

    `bucket` names a column that never decreases along `order`; rows whose bucket is null form a
    single bucket of their key and take no part in the cross-bucket step.
    """
    rows = df.repartition(*[F.col(k) for k in keys], F.col(bucket))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    with_inside = rows.select("*", *[
        _within(v.kind)(v.value).over(upto if v.inclusive else before).alias(f"_in_{name}")
        for name, v in values.items()])

    position = F.struct(*order)
    partials = (df.filter(F.col(bucket).isNotNull()).groupBy(*keys, bucket).agg(*[
        (F.max_by(v.value, F.when(v.value.isNotNull(), position)) if v.kind == "last"
         else _within(v.kind)(v.value)).alias(f"_part_{name}") for name, v in values.items()]))
    earlier = (Window.partitionBy(*keys).orderBy(bucket)
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = partials.select(
        *[F.col(c).alias(f"_k_{c}") for c in (*keys, bucket)],
        *[_merge(v.kind)(F.col(f"_part_{name}")).over(earlier).alias(f"_off_{name}")
          for name, v in values.items()])
    matched = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys],
                     F.col(bucket) == F.col(f"_k_{bucket}"))
    joined = with_inside.join(offsets, matched, "left")
    results = []
    for name, v in values.items():
        merged = _combine(v.kind, F.col(f"_off_{name}"), F.col(f"_in_{name}"))
        if v.default is not None:
            merged = F.coalesce(merged, F.lit(v.default))
        results.append(merged.alias(name))
    return joined.select(*[F.col(c) for c in df.columns if c != bucket], *results)


def ranked(df: DataFrame, keys: list[str], order: list, bucket: Column, name: str) -> DataFrame:
    """Adds an exact 1-based rank over `order` within `keys` (or over the whole table)."""
    return running(df.withColumn("_bucket", bucket), keys, order, "_bucket",
                   {name: Running("count", F.lit(1), inclusive=True, default=0)})


def range_pieces(df: DataFrame, keys: list[str], order: list[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The rows as a stored table with `_bucket`, the number of a piece of about `piece_rows` rows.

    Pieces are ranges of (keys, order) with borders from a sample, so they follow each other along the
    order of every key, however its values are spread. Rows that agree in all of these share a piece.
    """
    pieces = max(1, -(-df.count() // piece_rows))
    dealt = df.repartitionByRange(pieces, *[F.col(c) for c in (*keys, *order)])
    return _stored(dealt.withColumn("_bucket", F.spark_partition_id()), "pieces")


def running_over(df: DataFrame, key: str, order: list[str], values: dict[str, Running], *, hot_rows: int = HOT_ROWS,
                 piece_rows: int = PIECE_ROWS, seen: DataFrame | None = None) -> DataFrame:
    """Adds running values over `key` in `order` (columns that tell a key's rows apart).

    Keys of up to about `hot_rows` rows are one window each. The rows of all others are cut into
    pieces first, so no task holds more than a piece of them. `seen` may name a cheaper table with the
    same keys to count them on.
    """
    sorts = [F.col(c) for c in order]
    hot = hot_keys((df if seen is None else seen).select(key), key, hot_rows)
    if hot is None:
        return plain_running(df, [key], sorts, values)
    marked = _stored(hot_bucket(df, key, F.lit(True), hot).withColumnRenamed("_bucket", "_is_hot"), "marked")
    cool = plain_running(marked.filter(F.col("_is_hot").isNull()).drop("_is_hot"), [key], sorts, values)
    pieces = range_pieces(marked.filter("_is_hot").drop("_is_hot"), [key], order, piece_rows)
    return cool.unionByName(running(pieces, [key], sorts, "_bucket", values))


def row_numbers(df: DataFrame, order: list[str], name: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Adds 1, 2, ... over the whole table in `order`."""
    return running(range_pieces(df, [], order, piece_rows), [], [F.col(c) for c in order], "_bucket",
                   {name: Running("count", F.lit(1), inclusive=True, default=0)})


def hash_prefix(hashed: Column, digits: int = 4) -> Column:
    """Leading hex digits of a hash: a bucket that grows with the hash and is filled evenly."""
    return F.substring(hashed, 1, digits)


def carry_forward(df: DataFrame, key: str, order: str, values: dict[str, Column], *, hot_rows: int = HOT_ROWS,
                  piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Last non-null value of each expression up to and including the row, per `key`; see `running_over`."""
    wanted = {name: Running("last", v, inclusive=True) for name, v in values.items()}
    return running_over(df, key, [order], wanted, hot_rows=hot_rows, piece_rows=piece_rows)


def shuffle_column(df: DataFrame, key: str, columns: list[str], seed, repeat=0,
                   prefix: str = "shuffled_") -> DataFrame:
    """Adds a random permutation of `columns` (moved together) as `prefix + name`.

    Each row gets a rank by one hash of its key and takes the values of the row whose rank by a
    second hash is the same, so every value is used exactly once.
    """
    slot = F.md5(F.concat(F.col(key).cast("string"), F.lit(":slot")))
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}:{repeat}")))
    taking = ranked(df.withColumn("_h", slot), [], [F.col("_h"), F.col(key)],
                    hash_prefix(F.col("_h")), "_slot").drop("_h")
    giving = ranked(df.select(key, *columns).withColumn("_h", draw), [],
                    [F.col("_h"), F.col(key)], hash_prefix(F.col("_h")), "_draw")
    giving = giving.select("_draw", *[F.col(c).alias(prefix + c) for c in columns])
    return taking.join(giving, F.col("_slot") == F.col("_draw")).drop("_slot", "_draw")
