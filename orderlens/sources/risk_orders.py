"""The 13-column labelled order table, derived from the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (bernoulli, clip, either, mask_null, return_logit, sigmoid)
from ..operators.routing import left_lookup
from ..operators.running import HOT_ROWS, PIECE_ROWS, Running, running_over
from .tables import table

# Stand-ins in the star schema for the values that the score singles out.
COD_VALUE = "1-URGENT"
FIT_CATEGORIES = ("PROMO", "SMALL")
PRICE_SCALE = 500_000.0
# Share of missing ratings for the stand-in payment value and for all others (fixed values).
MISSING_RATES = (0.22, 0.06)


PART_KEYS = 10 ** 15  # more than any part key


def line_facts(lineitem: DataFrame, supplier: DataFrame | None = None) -> DataFrame:
    """One row per order: line count, discount hundredths, returned lines, first ship date and the
    part of its highest-priced line (lowest part key on ties).

    Everything is a sum, minimum or maximum of plain numbers, so it is combined before the shuffle
    in a hash table and an order with very many lines reaches its reducer as a few rows: price in
    cents and part key are packed into one decimal. Sums are over integers, which makes the result
    independent of partitioning. With `supplier`, lines are first combined per supplier nation and
    `nations` lists the lines of each (at most one entry per nation), all in one pass over the lines.
    """
    top = (F.round(F.col("l_extendedprice") * 100).cast("decimal(20,0)") * F.lit(PART_KEYS).cast("decimal(16,0)")
           + (F.lit(PART_KEYS - 1) - F.col("l_partkey")).cast("decimal(16,0)"))
    first = [F.count(F.lit(1)).alias("n_lines"),
             F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("discount_hundredths"),
             F.sum((F.col("l_returnflag") == "R").cast("bigint")).alias("n_returned"),
             F.min("l_shipdate").alias("first_ship"), F.max(top).alias("top")]
    facts = ["l_orderkey", "n_lines", "discount_hundredths", "n_returned", "first_ship",
             (F.lit(PART_KEYS - 1) - F.pmod(F.col("top"), F.lit(PART_KEYS).cast("decimal(16,0)")).cast("bigint"))
             .alias("top_partkey")]
    if supplier is None:
        return lineitem.groupBy("l_orderkey").agg(*first).select(*facts)
    per_nation = (lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
                  .groupBy("l_orderkey", "s_nationkey").agg(*first))
    again = [F.sum(c).alias(c) for c in ("n_lines", "discount_hundredths", "n_returned")]
    known = F.when(F.col("s_nationkey").isNotNull(),
                   F.struct(F.col("s_nationkey").alias("nation"), F.col("n_lines").alias("n")))
    return per_nation.groupBy("l_orderkey").agg(
        *again, F.min("first_ship").alias("first_ship"), F.max("top").alias("top"),
        F.collect_list(known).alias("nations")).select(*facts, "nations")


def nation_distance(nations: Column, home: Column) -> Column:
    """Average of 100 * |home - nation| over the lines that `nations` counts, to one decimal."""
    zero = F.lit(0).cast("bigint")
    total = F.aggregate(nations, zero, lambda a, x: a + F.lit(100) * F.abs(home - x["nation"]).cast("bigint") * x["n"])
    n = F.aggregate(nations, zero, lambda a, x: a + x["n"])
    return F.when(n > 0, _one_decimal(total, n))


def line_distance(lineitem: DataFrame, supplier: DataFrame, orders: DataFrame,
                  customer: DataFrame) -> DataFrame:
    """Average of 100 * |customer nation - supplier nation| over an order's lines, to one decimal.

    Lines are first counted per (order, supplier nation), so a huge order has no more rows than
    there are nations by the time it meets its customer.
    """
    per_nation = (
        lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .groupBy("l_orderkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n")))
    homes = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
             .select("o_orderkey", "c_nationkey"))
    gap = F.abs(F.col("c_nationkey") - F.col("s_nationkey")).cast("bigint")
    sums = (per_nation.filter(F.col("s_nationkey").isNotNull())
            .join(homes, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("o_orderkey").alias("d_orderkey"))
            .agg(F.sum(F.lit(100) * gap * F.col("n")).alias("total"), F.sum("n").alias("n")))
    return sums.select("d_orderkey",
                       _one_decimal(F.col("total"), F.col("n")).alias("delivery_distance_km"))


def _one_decimal(total: Column, n: Column) -> Column:
    """total / n rounded half-up to one decimal, in integer arithmetic."""
    return F.floor((F.lit(20) * total + n) / (F.lit(2) * n)).cast("double") / F.lit(10.0)


def _orders(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", "o_custkey", "o_totalprice",
                         F.to_date("o_orderdate").alias("order_date"), "o_orderpriority")


def customer_history(facts: DataFrame, orders: DataFrame, hot_rows: int = HOT_ROWS,
                     piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Adds prior orders, prior returns and tenure per customer, in (date, key) order.

    `facts` carries o_orderkey, o_custkey, order_date and line_returned. Customers with very many
    orders are cut into pieces, see `running_over`.
    """
    wanted = {
        "num_previous_orders": Running("count", F.lit(1), default=0),
        "num_previous_returns": Running("sum", F.col("line_returned"), default=0),
        "first_order": Running("min", F.col("order_date"), inclusive=True),
    }
    out = running_over(facts, "o_custkey", ["order_date", "o_orderkey"], wanted, hot_rows=hot_rows, piece_rows=piece_rows,
                       seen=orders)
    return (out.withColumn("customer_tenure_days",
                           F.datediff("order_date", "first_order").cast("bigint"))
            .drop("first_order"))


def with_score(df: DataFrame, *, fit_categories=FIT_CATEGORIES, cod_value=COD_VALUE,
               price_scale: float = PRICE_SCALE) -> DataFrame:
    """Adds `p`: the fixed score through the logistic function, to six decimals."""
    z = return_logit(
        F.col("num_previous_returns"), F.col("num_previous_orders"), F.col("product_category"),
        F.col("discount_pct"), F.col("payment_method"), F.col("delivery_days"),
        F.col("price_inr"), F.col("is_weekend_order"), F.col("customer_tenure_days"),
        fit_categories=fit_categories, cod_value=cod_value, price_scale=price_scale)
    return df.withColumn("p", F.round(sigmoid(z), 6))


def risk_orders(spark: SparkSession, folder: str, *, label: str = "drawn",
                distance: bool = True, score: bool = False,
                hot_rows: int = HOT_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per order with the columns of `schemas.ORDERS`.

    `label="drawn"` draws the label from the fixed score; `label="lines"` uses the share of
    returned lines. `distance=False` leaves out delivery_distance_km and the three joins behind it;
    `score=True` keeps the score as `p`.
    """
    orders = table(spark, folder, "orders")
    lineitem = table(spark, folder, "lineitem")
    part = table(spark, folder, "part").select("p_partkey", "p_type")

    # everything keyed by order meets first, so one partitioning by order serves both joins
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey") if distance else None
    facts = (
        _orders(orders)
        .join(line_facts(lineitem, supplier), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .withColumn("line_returned", F.coalesce(
            (F.lit(2) * F.col("n_returned") > F.col("n_lines")).cast("bigint"),
            F.lit(0).cast("bigint"))))
    if distance:
        home = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
        facts = facts.join(home, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn(
            "delivery_distance_km", nation_distance(F.col("nations"), F.col("c_nationkey"))).drop(
            "nations", "c_custkey", "c_nationkey")
    facts = left_lookup(facts, part, "top_partkey", "p_partkey", ["o_orderkey"])
    out = customer_history(facts, orders, hot_rows, piece_rows)

    gap_days = F.abs(F.datediff(F.to_date("first_ship"), "order_date")).cast("bigint")
    key = F.col("o_orderkey")
    rate = either(F.col("o_orderpriority") == COD_VALUE, *MISSING_RATES)
    columns = [
        key.alias("order_id"),
        F.col("p_type").alias("product_category"),
        F.col("o_totalprice").alias("price_inr"),
        _one_decimal(F.col("discount_hundredths"), F.col("n_lines")).alias("discount_pct"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("customer_tenure_days"),
        F.col("num_previous_orders"),
        F.col("num_previous_returns"),
    ]
    if distance:
        columns.append(F.col("delivery_distance_km"))
    columns += [
        clip(gap_days % F.lit(21), F.lit(1).cast("bigint"), F.lit(21).cast("bigint"))
        .alias("delivery_days"),
        F.dayofweek("order_date").isin(1, 7).cast("int").alias("is_weekend_order"),
        mask_null((F.lit(1) + F.pmod(key, F.lit(5))).cast("double"), key, rate)
        .alias("rating_given"),
        F.col("line_returned"),
    ]
    scored = with_score(out.select(*columns))
    returned = (bernoulli(F.col("order_id"), F.col("p")) if label == "drawn"
                else F.col("line_returned").cast("int"))
    scored = scored.withColumn("returned", returned).drop("line_returned")
    return scored if score else scored.drop("p")
