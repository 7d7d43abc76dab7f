"""Mixing sources to target weights through a hypergeometric splitting tree. DataFrame functions only.

Every source is an axis of words: its documents are cut into blocks and the blocks are put in a
random order (a hash of id, block and seed). A source that should give `target` words gives all of
its words floor(target / size) times and the first `target mod size` words of its permuted axis once
more. Those exact quotas are halved again and again down a binary tree: at each node the words that
go left are drawn from the multivariate hypergeometric distribution over the sources, so each output
shard ends with a random but exactly known number of words of each source. Shards then take disjoint
consecutive ranges of each permuted axis, and order what they got by another hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import n_words, stored

# ratio of uniforms: the width of the hat over all unimodal tables is WIDE * sqrt(variance + 1/2) + WIDER
WIDE, WIDER = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)
ATTEMPTS = 64
SMALL = 64  # factorials below are looked up


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
            cap: float = 2.0) -> DataFrame:
    """Per source: documents, words, weight and target words.

    Sources in code point order, null last, get the weights in turn. `share` times all words are
    split by weight; no source gives more than `cap` times its words, and the excess goes to the
    others by weight until none is above. That is target = min(cap * size, level * weight) for the
    one level that makes the targets add up, found by sorting the sources by cap * size / weight.
    One row per source goes through single-task windows; the documents do not.
    """
    source = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = source.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("source").isNull(), F.col("source"))))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(turn, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", cap * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    ranked = (ranked
              .withColumn("total", share * F.sum("source_size").over(whole))
              .withColumn("full", F.coalesce(F.sum("most").over(
                  by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
              .withColumn("open", F.sum("weight").over(
                  by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
              .withColumn("level", (F.col("total") - F.col("full")) / F.col("open")))
    # the first source that its level does not fill decides; if share >= cap all are filled
    ranked = ranked.withColumn("seq", F.row_number().over(by_ratio))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("seq", "level"))
    ranked = ranked.withColumn("level", F.min(fits).over(whole)["level"])
    return ranked.select(
        "source", "rank", "n_docs", "source_size", "weight",
        F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def _tail(x: Column) -> Column:
    return 1 / (12 * x) - 1 / (360 * x * x * x)


def _log_factorial(x: Column) -> Column:
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(SMALL)])
    return F.when(x < SMALL, F.element_at(table, x.cast("int") + 1)) \
        .otherwise((x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + _tail(x))


def _log_ratio(a: Column, b: Column) -> Column:
    """ln(a! / b!); for large numbers without the difference of two large logarithms."""
    near = (b + 0.5) * F.log1p((a - b) / b) + (a - b) * (F.log(a) - 1) + _tail(a) - _tail(b)
    return F.when((a >= SMALL) & (b >= SMALL), near).otherwise(_log_factorial(a) - _log_factorial(b))


def _hypergeometric(total: Column, marked: Column, drawn: Column, key: Column) -> Column:
    """Marked units among `drawn` of `total`, of which `marked` are marked; random by `key`.

    Ratio of uniforms, exact at any spread and at the same cost: a point (u, v) gives the candidate
    floor(centre + width * (v - 1/2) / u), which stays if u^2 is at most its probability over that of the
    mode. Nearly three in four do; the mode is taken after ATTEMPTS misses (a chance below 1e-35). Fewer
    than half of all are marked and drawn while drawing, the result is turned back afterwards.
    """
    def halves(p):
        few, take = F.least(p["m"], p["n"] - p["m"]), F.least(p["k"], p["n"] - p["k"])
        return F.struct(p["n"].alias("n"), p["m"].alias("m"), p["k"].alias("k"), p["key"].alias("key"),
                        few.cast("double").alias("few"), take.cast("double").alias("take"),
                        F.greatest(p["n"], F.lit(1)).cast("double").alias("all"))

    def hat(p):
        part = p["few"] / p["all"]
        var = p["take"] * part * (1 - part) * (p["all"] - p["take"]) / F.greatest(p["all"] - 1, F.lit(1.0))
        return _let(F.sqrt(var + 0.5), lambda sd: F.struct(
            p["key"].alias("key"), p["few"].alias("few"), p["take"].alias("take"),
            (p["all"] - p["few"] - p["take"]).alias("rest"), (p["take"] * part + 0.5).alias("centre"),
            (WIDE * sd + WIDER).alias("width"),
            F.floor((p["take"] + 1) * (p["few"] + 1) / (p["all"] + 2)).cast("double").alias("mode"),
            F.least(p["few"] + 1, p["take"] + 1, F.floor(p["take"] * part + 0.5 + 16 * sd).cast("double")).alias("end")))

    def drawn_from(h):
        def odds(x):
            return (_log_ratio(h["mode"], x) + _log_ratio(h["few"] - h["mode"], h["few"] - x)
                    + _log_ratio(h["take"] - h["mode"], h["take"] - x) + _log_ratio(h["rest"] + h["mode"], h["rest"] + x))

        def judge(c):
            inside = (c["w"] >= 0) & (c["w"] < h["end"])
            return F.when(inside, _let(F.floor(c["w"]).cast("double"), lambda x: F.when(2 * F.log(c["u"]) <= odds(x), x)))

        def attempt(found, i):
            u, v = _uniform(h["key"], i, F.lit(0)), _uniform(h["key"], i, F.lit(1))
            return F.when(found.isNotNull(), found).otherwise(
                _let(F.struct(u.alias("u"), (h["centre"] + h["width"] * (v - 0.5) / u).alias("w")), judge))

        got = F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), F.lit(None).cast("double"), attempt)
        return F.coalesce(got, h["mode"])

    def value(p):
        few = F.when(F.least(p["few"], p["take"]) <= 0, F.lit(0.0)).otherwise(_let(hat(p), drawn_from)).cast("long")
        return _let(few, lambda z: _let(
            F.when(2 * p["m"] > p["n"], p["take"].cast("long") - z).otherwise(z),
            lambda x: F.when(2 * p["k"] > p["n"], p["m"] - x).otherwise(x)))

    given = F.struct(*[c.cast("long").alias(name) for c, name in ((total, "n"), (marked, "m"), (drawn, "k"), (key, "key"))])
    return _let(given, lambda g: _let(halves(g), value))


def split_tree(quotas: DataFrame, depth: int, seed: int = 0) -> DataFrame:
    """(shard, source rank, start, end): the word range of each source's axis that each shard takes.

    `quotas` has rank and quota (words). Each level halves every node: the left child's share of all
    words is fixed (half, rounded down) and its words per source are drawn source after source from
    the hypergeometric distribution of what is left, which together is the multivariate one. Only
    one row per node and source exists; a level is one window over nodes.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), "rank", F.col("quota").cast("long").alias("quota"),
                          F.lit(0).cast("long").alias("start"))
    item = F.struct("rank", "quota", "start")
    tree = nodes.groupBy("node").agg(F.array_sort(F.collect_list(item)).alias("items"))
    for level in range(depth):
        total = F.aggregate("items", F.lit(0).cast("long"), lambda a, s: a + s["quota"])
        begin = F.struct(F.col("total"), F.floor(F.col("total") / 2).cast("long").alias("want"),
                         F.array().cast("array<struct<rank:int,quota:bigint,left:bigint,start:bigint>>").alias("done"))

        def draw(state, s):
            key = F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), s["rank"])
            left = _hypergeometric(state["total"], s["quota"], state["want"], key)
            return _let(left, lambda n: F.struct(
                (state["total"] - s["quota"]).alias("total"), (state["want"] - n).alias("want"),
                F.concat(state["done"], F.array(F.struct(
                    s["rank"].cast("int").alias("rank"), s["quota"].alias("quota"), n.alias("left"),
                    s["start"].alias("start")))).alias("done")))

        drawn = tree.withColumn("total", total).withColumn("done", F.aggregate("items", begin, draw)["done"])
        child = lambda node, quota, start: F.struct(
            node.alias("node"), F.transform("done", lambda s: F.struct(
                s["rank"].alias("rank"), quota(s).alias("quota"), start(s).alias("start"))).alias("items"))
        tree = drawn.select(F.explode(F.array(
            child(F.col("node") * 2, lambda s: s["left"], lambda s: s["start"]),
            child(F.col("node") * 2 + 1, lambda s: s["quota"] - s["left"], lambda s: s["start"] + s["left"]))).alias("c"))
        tree = tree.select("c.node", "c.items")
        tree = stored(tree, "split")  # keeps the nested expressions short
    flat = tree.select(F.col("node").alias("shard"), F.explode("items").alias("s"))
    return flat.select("shard", F.col("s.rank").cast("int").alias("rank"), F.col("s.start").alias("start"),
                       (F.col("s.start") + F.col("s.quota")).alias("end"))


def axis_ranges(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """Adds `from`, the words of the block's source that come before it in the permuted order.

    The permutation key is a hash, so equal slices of its range are buckets of equal expected size:
    buckets are summed, summed up per source, and only inside a bucket is a window needed. A source
    with a third of all blocks is spread over all buckets.
    """
    bucket = F.floor((F.col("key").cast("double") / float(1 << 63) + 1) / 2 * n_buckets).cast("int")
    blocks = blocks.withColumn("bucket", bucket)
    sums = blocks.groupBy("rank", "bucket").agg(F.sum("words").alias("n"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "uid", "block") \
        .rowsBetween(Window.unboundedPreceding, -1)
    return blocks.join(sums, ["rank", "bucket"]).withColumn(
        "from", F.col("base") + F.coalesce(F.sum("words").over(inside), F.lit(0)))


def sized_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, uid); uid tells repeated rows of one id apart by their text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       n_words(text).alias("size"), F.xxhash64(F.col(id_col), text).alias("uid"))


def mix_plan(sized: DataFrame, goal: DataFrame, shards: int = 16, block_words: int | None = 1024,
             seed: int = 0) -> DataFrame:
    """The pieces that the extra pass draws: (uid, doc_id, rank, block, words, from, shard, taken, place).

    Documents without words are in no piece. The piece of a block that a border between two shards
    or the end of the quota crosses is cut, so the words drawn per source equal its quota exactly.
    """
    depth = max(0, math.ceil(math.log2(max(1, shards))))
    quotas = goal.select("rank", (F.round(F.col("target")).cast("long")
                                  - F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
                                  * F.col("source_size")).alias("quota"))
    ranges = split_tree(quotas.withColumn("quota", F.greatest(F.col("quota"), F.lit(0))), depth, seed)
    rows = sized.filter("size > 0").join(F.broadcast(goal.select("source", "rank")),
                                         sized["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    step = F.lit(block_words) if block_words else F.col("size")
    blocks = rows.select("doc_id", "uid", "rank", "size", step.alias("step"), F.explode(
        F.sequence(F.lit(0).cast("long"), ((F.col("size") - 1) / step).cast("long"))).alias("block"))
    blocks = blocks.select("doc_id", "uid", "rank", "block",
                           F.least(F.col("step"), F.col("size") - F.col("block") * F.col("step")).cast("long").alias("words"),
                           F.xxhash64(F.lit(seed), "uid", "block").alias("key"))
    blocks = stored(blocks, "blocks")
    placed = axis_ranges(blocks, max(1, blocks.count() // 50_000))
    # a piece of each shard whose range of the axis meets the block's
    per_rank = ranges.filter("end > start").groupBy("rank").agg(
        F.collect_list(F.struct("shard", "start", "end")).alias("ranges"))
    met = placed.join(F.broadcast(per_rank), "rank").select("*", F.explode(F.filter(
        "ranges", lambda r: (r["start"] < F.col("from") + F.col("words")) & (r["end"] > F.col("from")))).alias("r"))
    return met.select(
        "doc_id", "uid", "rank", "block", "words", "from", F.col("r.shard").alias("shard"),
        (F.least(F.col("r.end"), F.col("from") + F.col("words"))
         - F.greatest(F.col("r.start"), F.col("from"))).cast("long").alias("taken"),
        F.xxhash64(F.lit(seed + 2), "uid", "block").alias("place"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
        shards: int = 16, block_words: int | None = 1024, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per input row.

    `taken` counts the words the mix takes of the document, repeats included: its words once per
    full pass over its source, plus its pieces of the last, partial pass. A source's taken words are
    its rounded target; no document exceeds its size times the passes (`cap` = 2: twice).
    `shards` is the number of output shards (rounded up to a power of two). Broadcast are one row per
    source and the shard ranges of each source.

    Defined cases: null text has size 0 and nothing is taken; null sources form one source, last;
    rows that repeat id and text share one identity: the pieces drawn for them are dealt evenly; an
    empty table gives an empty result; other columns are not read.
    """
    sized = stored(sized_documents(docs, id_col, text_col, source_col), "sized")
    goal = stored(targets(sized, weights, share, cap), "targets")
    pieces = mix_plan(sized, goal, shards, block_words, seed)
    drawn = pieces.groupBy("uid").agg(F.sum("taken").alias("drawn"))
    repeats = Window.partitionBy("uid").orderBy(F.lit(1))
    rows = sized.join(drawn, "uid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("uid"))) \
        .withColumn("i", F.row_number().over(repeats))
    goal = goal.select(F.col("source").alias("key"), "source_size", "target")
    joined = rows.join(F.broadcast(goal), rows["source"].eqNullSafe(goal["key"]), "left")
    passes = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    even = F.floor(F.col("drawn") / F.col("n")) + F.when(F.col("i") <= F.col("drawn") % F.col("n"), 1).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target",
                         (passes * F.col("size") + even).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
                    shards: int = 16, seed: int = 0) -> DataFrame:
    """The mix itself: whole documents, all columns, repeated as often as the mix takes them.

    A document is one block. It is in the output once per full pass over its source, and once more
    if the last pass takes at least half of its words, so a source misses its target by half a
    document at most. Copies of the last pass go to the shard that drew them, those of full passes to
    a shard chosen by a hash. The rows of a shard are dealt to partitions at random (by a hash) and
    put in random order there; a partition may hold parts of several shards, one after the other. Same
    defined cases as `mix`; documents without words are left out.
    """
    text = F.col(text_col).cast("string")
    sized = stored(sized_documents(docs, id_col, text_col, source_col), "sized")
    goal = stored(targets(sized, weights, share, cap), "targets")
    pieces = mix_plan(sized, goal, shards, None, seed)
    drawn = pieces.groupBy("uid", "block").agg(
        F.sum("taken").alias("drawn"), F.min("shard").alias("drawn_shard"))
    drawn = drawn.groupBy("uid").agg(F.sum("drawn").alias("drawn"), F.min("drawn_shard").alias("drawn_shard"))
    once = sized.groupBy("uid").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.first("source").alias("source"))
    goal = goal.select(F.col("source").alias("key"), F.floor(
        F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int").alias("passes"))
    plan = once.filter("size > 0").join(F.broadcast(goal), once["source"].eqNullSafe(goal["key"])) \
        .join(drawn, "uid", "left")
    extra = F.round(F.coalesce("drawn", F.lit(0)) / F.col("size"))  # of n rows with one text
    plan = stored(plan.select("uid", "passes", (extra / F.col("n")).alias("extra"), "drawn_shard"), "plan")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col(id_col), text).alias("uid"))
    rows = rows.join(plan, "uid")
    copies = F.col("passes") + F.when(F.col("extra") >= 0.5, 1).otherwise(0)
    rows = rows.select("row", "uid", "passes", "drawn_shard", copies.cast("int").alias("copies")) \
        .filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    n = 1 << max(0, math.ceil(math.log2(max(1, shards))))
    shard = F.when(F.col("copy") > F.col("passes"), F.col("drawn_shard")).otherwise(
        F.pmod(F.xxhash64("uid", "copy", F.lit(seed)), F.lit(n)))
    rows = rows.select("row", shard.alias("shard"), F.xxhash64(F.lit(seed + 3), "uid", "copy").alias("place"))
    # 64 parts of each shard, so that partitions come out even
    return rows.repartition("shard", F.pmod("place", F.lit(64))).sortWithinPartitions("shard", "place").select("row.*")
