"""URL allow and block rules by a sorted sweep over reversed hosts. DataFrame functions only.

A host is written with its labels reversed and a dot behind each (`blog.example.org` ->
`org.example.blog.`), so a rule's host is a prefix of the key of itself and of all its subdomains:
an interval of the key order. Intervals nest or are disjoint. One sort merges rules and pages; the
last rule host at or before a page carries the stack of rules open at that point, and those of the
stack whose interval also reaches the page are the rules of its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import ascii_lower, stored


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host behind the first `://`, ASCII lower case; path up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def reversed_host(host: Column) -> Column:
    return F.when(host == "", "").otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """One row per rule host: its key and all rules open there, those of its enclosing hosts included.

    A host has no more enclosing hosts than labels, so they are found by an equality join.
    """
    rules = rules.select(ascii_lower(F.col("host")).alias("host"), F.col("path"),
                         F.col("verdict")).filter("host is not null and path is not null").distinct()
    # the same host and path with two verdicts: block wins
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")) \
        .withColumn("key", reversed_host(F.col("host")))
    own = rules.groupBy("key").agg(F.collect_list(F.struct("key", "host", "path", "verdict")).alias("own"))
    labels = F.split(F.col("key"), r"\.")
    steps = F.when(F.col("key") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(labels) - 1))
    prefix = F.transform(steps, lambda n: F.when(n == 0, "").otherwise(
        F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))))
    chain = own.select(F.col("key").alias("at"), F.explode(prefix).alias("key"))
    return chain.join(own, "key").groupBy("at").agg(F.flatten(F.collect_list("own")).alias("stack"))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per page; `rule` is null where none fits.

    `rules` has host, path and verdict (allow or block). A rule fits its host and all subdomains if
    the path starts with the rule's; the longest rule text wins (block before allow, then the longer
    host, where lengths tie); pages without a rule get `default`. Pages are range partitioned by
    (key, id), so a host with a third of all pages is spread over many tasks; what a partition
    inherits from those before it is one row per partition.

    Defined cases: null url or url without `://`: host and path are empty, and only a rule with an
    empty host can fit; null ids and repeated pages are rows like any other; no rules: all default.
    """
    kind = pages.schema[id_col].dataType
    host, path = url_parts(F.col(url_col).cast("string"))
    page = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    page = page.select(reversed_host(F.col("host")).alias("key"), F.lit(1).alias("side"), "page_id",
                       "host", "path", F.xxhash64("page_id", "path").alias("spread"))
    stack = rule_stacks(rules)
    stack_type = stack.schema["stack"].dataType
    page = page.withColumn("stack", F.lit(None).cast(stack_type))
    start = stack.select(F.col("at").alias("key"), F.lit(0).alias("side"),
                         F.lit(None).cast(kind).alias("page_id"), F.lit(None).cast("string").alias("host"),
                         F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("spread"), "stack")
    # stored: both uses below must see the same borders
    swept = stored(page.unionByName(start).repartitionByRange("key", "side", "spread")
                   .withColumn("part", F.spark_partition_id()), "urls")
    last = swept.filter("side = 0").groupBy("part").agg(F.max_by("stack", "key").alias("inherited"))
    # at most one row per range partition
    carry = last.select("part", "inherited")
    parts = swept.groupBy("part").agg(F.count("*").alias("n")).select("part")
    carry = parts.join(carry, "part", "left").select(
        "part", F.last("inherited", True).over(
            Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("inherited"))
    order = Window.partitionBy("part").orderBy("key", "side", "spread") \
        .rowsBetween(Window.unboundedPreceding, 0)
    open_at = swept.withColumn("stack", F.last("stack", True).over(order)).filter("side = 1")
    open_at = open_at.join(F.broadcast(carry), "part", "left") \
        .withColumn("stack", F.coalesce("stack", "inherited", F.array().cast(stack_type)))
    fits = F.filter("stack", lambda r: F.col("key").startswith(r["key"]) & F.col("path").startswith(r["path"]))
    # struct order: longest text, then block before allow, then the longer host
    best = F.array_max(F.transform(fits, lambda r: F.struct(
        (F.length(r["host"]) + F.length(r["path"])).alias("size"), r["verdict"].alias("verdict"),
        F.length(r["host"]).alias("host_size"), F.concat(r["host"], r["path"]).alias("rule"))))
    return open_at.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
