"""Screening, intent, routing, context carry and answers for conversation turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import first_match, first_present, percent_text
from .retrieval import GROUNDED_SCORE
from .running import HOT_ROWS, carry_forward

# The phrase lists and answer texts below are fixed values: results depend on them word by word.
INJECTION_PHRASES = [
    "ignore previous instructions", "ignore all rules", "ignore all previous",
    "disregard your instructions", "disregard previous instructions", "pretend you are",
    "pretend to be", "you are now", "forget your instructions", "act as if you have no rules",
    "system prompt", "reveal your prompt",
]
RISK_PHRASES = [
    "return risk", "likely to be returned", "will it be returned", "order #", "order id",
    "order number", "risk score", "return probability", "risk bucket", "that order",
]
IMAGE_PHRASES = [
    "image", "photo", "picture", ".png", ".jpg", "this product photo", "classify this",
    "what category is this",
]
FEW_SHOT = [
    ("What is the return window for a pair of running shoes?", "policy"),
    ("Is order #48213 likely to be returned?", "return_risk"),
    ("What category does this product photo belong to?", "image_classification"),
]
BLOCKED_TEXT = (
    "I can't comply with that request -- it looks like an attempt to override my instructions, "
    "which I'm not able to do. I'm happy to help with a genuine policy, return-risk, or "
    "product-category question instead.")
REFUSAL_TEXT = (
    "I don't have a policy document confident enough to answer that (best match similarity %.4f "
    "is below my %.2f grounding threshold), so rather than guess, I'd recommend checking with a "
    "human support agent for this specific question.")
POLICY_TEXT = "Based on our policy documentation: %s"
RISK_TEXT = ("This order has an estimated return probability of %s, placing it in the '%s' risk "
             "bucket (cut points: %s).")
IMAGE_TEXT = "This product image is classified as '%s' with %s confidence."
NO_ORDER_TEXT = (
    "I don't have an order to reference yet in this conversation -- could you share the order ID "
    "or its details so I can check the return risk?")
NO_IMAGE_TEXT = (
    "I don't have a product image to reference yet in this conversation -- could you point me to "
    "the image file you'd like classified?")
FALLBACK_TEXT = "I couldn't determine how to help with that."


def flag_injection(df: DataFrame, text: str = "user_input", phrases=None) -> DataFrame:
    """Adds blocked and matched_pattern (first phrase of the list that occurs)."""
    lowered = df.withColumn("_lowered", F.lower(F.col(text)))
    out = lowered.withColumn("matched_pattern",
                             first_match(F.col("_lowered"), phrases or INJECTION_PHRASES))
    return out.withColumn("blocked", F.col("matched_pattern").isNotNull()).drop("_lowered")


def intent_of(lowered: Column, risk=None, image=None) -> Column:
    return (F.when(first_match(lowered, risk or RISK_PHRASES).isNotNull(), F.lit("return_risk"))
            .when(first_match(lowered, image or IMAGE_PHRASES).isNotNull(),
                  F.lit("image_classification"))
            .otherwise(F.lit("policy")))


def classify_intent(df: DataFrame, text: str = "user_input", risk=None, image=None) -> DataFrame:
    """Adds intent; the risk list is tried before the image list, `policy` is the default."""
    lowered = df.withColumn("_lowered", F.lower(F.col(text)))
    return lowered.withColumn("intent", intent_of(F.col("_lowered"), risk, image)).drop("_lowered")


def route(df: DataFrame) -> DataFrame:
    """Adds the branch of each turn: respond (blocked), retrieve (policy) or tool."""
    return df.withColumn("route", F.when(F.col("blocked"), F.lit("respond"))
                         .when(F.col("intent") == "policy", F.lit("retrieve"))
                         .otherwise(F.lit("tool")))


def screen_turns(df: DataFrame, text: str = "user_input", *, injection=None, risk=None,
                 image=None) -> DataFrame:
    """flag_injection, classify_intent and route in one projection; blocked turns have no intent.

    Stateless, so the same call serves batch and streaming frames.
    """
    screened = classify_intent(flag_injection(df, text, injection), text, risk, image)
    return route(screened.withColumn("intent", F.when(~F.col("blocked"), F.col("intent"))))


def _given(order: str, kind: T.DataType | None) -> Column:
    """The order input, or null where it is empty: an empty text, or a struct without a value."""
    value = F.col(order)
    if isinstance(kind, T.StructType):
        return F.when(F.coalesce(*[value[f.name].cast("string") for f in kind.fields]).isNotNull(), value)
    return F.when(value.cast("string") != "", value)


def context_writes(order: str, image: str, kind: T.DataType | None = None) -> tuple[Column, Column]:
    """What a turn stores for later turns: only its own tool's input, and only when given.

    `kind` is the order input's type; a struct counts as given when any field is."""
    return (F.when(F.col("intent") == "return_risk", _given(order, kind)),
            F.when(F.col("intent") == "image_classification",
                   first_present(F.col(image), F.lit(None).cast("string"))))


def with_resolution(df: DataFrame, order: str, image: str) -> DataFrame:
    """Adds resolved_order, resolved_image and missing_context from session_order/session_image,
    which already include the turn's own input."""
    risk, picture = F.col("intent") == "return_risk", F.col("intent") == "image_classification"
    return (df.withColumn("resolved_order", F.when(risk, F.col("session_order")))
            .withColumn("resolved_image", F.when(picture, F.col("session_image")))
            .withColumn("missing_context",
                        F.when(risk & F.col("resolved_order").isNull(), F.lit("order"))
                        .when(picture & F.col("resolved_image").isNull(), F.lit("image"))))


def resolve_context(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn",
                    order: str = "order_features", image: str = "image_path",
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Explicit input of the turn, else the last one stored earlier in the conversation.

    `order` may be a key or a struct of features. Adds session_order and session_image (state
    after the turn), resolved_order, resolved_image and missing_context.
    """
    order_write, image_write = context_writes(order, image, df.schema[order].dataType)
    carried = carry_forward(df, conv, turn, {"session_order": order_write,
                                             "session_image": image_write}, hot_rows=hot_rows)
    return with_resolution(carried, order, image)


def policy_evidence(hits: DataFrame, threshold: float = GROUNDED_SCORE) -> DataFrame:
    """Per query: grounded, top_score, threshold, the two best texts joined, their mean score."""
    two = F.col("rank") <= 2
    grouped = hits.groupBy("query_id").agg(
        F.max("score").alias("_top"),
        F.sort_array(F.collect_list(F.when(two, F.struct("rank", "text")))).alias("_two"),
        F.avg(F.when(two, F.col("score"))).alias("_mean"))
    return grouped.select(
        "query_id", (F.col("_top") >= threshold).alias("grounded"),
        F.round("_top", 4).alias("top_score"), F.lit(threshold).alias("threshold"),
        F.array_join(F.transform("_two", lambda h: h["text"]), " ").alias("policy_text"),
        F.round("_mean", 4).alias("policy_confidence"))


def final_answer() -> Column:
    """struct(answer, source, confidence) from the columns of a resolved turn.

    Reads blocked, intent, grounded, top_score, threshold, policy_text, policy_confidence,
    missing_context, return_probability, risk_bucket, cut_points, predicted_category and
    class_confidence.
    """
    def result(answer, source: str, confidence) -> Column:
        text = answer if isinstance(answer, Column) else F.lit(answer)
        score = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(text.alias("answer"), F.lit(source).alias("source"),
                        score.cast("double").alias("confidence"))

    intent, missing = F.col("intent"), F.col("missing_context")
    grounded = F.coalesce(F.col("grounded"), F.lit(False))
    top = F.coalesce(F.col("top_score"), F.lit(0.0))
    bar = F.coalesce(F.col("threshold"), F.lit(GROUNDED_SCORE))
    return (
        F.when(F.col("blocked"), result(BLOCKED_TEXT, "policy_kb", 0.0))
        .when((intent == "policy") & ~grounded,
              result(F.format_string(REFUSAL_TEXT, top, bar), "policy_kb", top))
        .when(intent == "policy", result(F.format_string(POLICY_TEXT, "policy_text"), "policy_kb",
                                         F.col("policy_confidence")))
        .when(missing == "order", result(NO_ORDER_TEXT, "policy_kb", 0.0))
        .when(missing == "image", result(NO_IMAGE_TEXT, "policy_kb", 0.0))
        .when((intent == "return_risk") & F.col("return_probability").isNotNull(),
              result(F.format_string(RISK_TEXT, percent_text(F.col("return_probability")),
                                     "risk_bucket", "cut_points"),
                     "return_risk_tool", F.col("return_probability")))
        .when((intent == "image_classification") & F.col("class_confidence").isNotNull(),
              result(F.format_string(IMAGE_TEXT, "predicted_category",
                                     percent_text(F.col("class_confidence"))),
                     "image_classifier_tool", F.col("class_confidence")))
        .otherwise(result(FALLBACK_TEXT, "policy_kb", 0.0)))


EVIDENCE = {"grounded": "boolean", "top_score": "double", "threshold": "double",
            "policy_text": "string", "policy_confidence": "double"}
RISK_TOOL = {"return_probability": "double", "risk_bucket": "string", "cut_points": "string"}
IMAGE_TOOL = {"predicted_category": "string", "class_confidence": "double"}


def answer_turns(df: DataFrame) -> DataFrame:
    """Adds final_answer; tool or evidence columns that are absent count as null."""
    for name, kind in {**EVIDENCE, **RISK_TOOL, **IMAGE_TOOL}.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.withColumn("final_answer", final_answer())


NULL_SPREAD = 1024


def left_lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, row_id: list[str],
                ) -> DataFrame:
    """Left join with a table that is unique on its key; `table_key` is dropped.

    Most turns have no key for a given tool. Rows without a key get a second join column drawn
    from their own id, so they do not all land in the partition of the null key; rows of one very
    frequent key are split by the adaptive skew join.
    """
    spread_by = F.pmod(F.xxhash64(*row_id), F.lit(NULL_SPREAD))
    left = df.withColumn("_spread", F.when(F.col(key).isNull(), spread_by).otherwise(F.lit(0)))
    right = table.withColumn("_zero", F.lit(0).cast("bigint"))
    return left.join(right, (F.col(key) == F.col(table_key)) & (F.col("_spread") == F.col("_zero")),
                     "left").drop("_spread", "_zero", table_key)


def attach_tools(resolved: DataFrame, *, evidence: DataFrame | None = None,
                 turn_key: str = "turn_key", risk: DataFrame | None = None,
                 images: DataFrame | None = None) -> DataFrame:
    """Joins retrieval evidence by turn, risk scores (risk_key) by resolved_order and image
    classes (image_key) by resolved_image."""
    out = resolved
    if evidence is not None:
        out = out.join(evidence.withColumnRenamed("query_id", turn_key), turn_key, "left")
    if risk is not None:
        out = left_lookup(out, risk, "resolved_order", "risk_key", [turn_key])
    if images is not None:
        out = left_lookup(out, images, "resolved_image", "image_key", [turn_key])
    return out


def debug_block() -> Column:
    """Groundedness for policy turns, stored context otherwise; null fields are left out."""
    policy = F.col("intent") == "policy"
    # nothing retrieved counts as not grounded at 0.0
    found = F.struct(F.coalesce("grounded", F.lit(False)).alias("grounded"),
                     F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
                     F.coalesce("threshold", F.lit(GROUNDED_SCORE)).alias("threshold"))
    return F.struct(
        F.when(policy, found).alias("groundedness"),
        F.when(F.col("session_order").isNotNull(), F.col("session_order")).alias("session_order"),
        F.when(F.col("session_image").isNotNull(), F.col("session_image")).alias("session_image"))


def transcript(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn",
               text: str = "user_input", part_turns: int = 1000) -> DataFrame:
    """Ordered turns per conversation as arrays of (turn, user_input, final_answer, debug).

    A row holds at most `part_turns` consecutive turn numbers; longer conversations continue in
    rows with a higher `part`, so no conversation has to fit into one row.
    """
    entry = F.struct(F.col(turn).alias("turn"), F.col(text).alias("user_input"), "final_answer",
                     debug_block().alias("debug"))
    return (df.groupBy(conv, F.floor(F.col(turn) / F.lit(part_turns)).alias("part"))
            .agg(F.sort_array(F.collect_list(entry)).alias("turns")))


def transcript_json(transcripts: DataFrame) -> DataFrame:
    """The turns of each transcript row as one JSON array."""
    return transcripts.withColumn("turns", F.to_json("turns"))


def few_shot_accuracy(spark, rows=None) -> DataFrame:
    """Share of labelled examples that the phrase lists classify as labelled."""
    examples = spark.createDataFrame(rows or FEW_SHOT, "user_input string, expected string")
    return classify_intent(examples).agg(
        F.avg((F.col("intent") == F.col("expected")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))
