"""One callable (spark, sf_dir) -> DataFrame per registered query."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as L
from ..operators import category_index as CI
from ..operators import confusion as C
from ..operators import hash_tables as HT
from ..operators import metrics as M
from ..operators import postings as PO
from ..operators import prep as P
from ..operators import profile as PR
from ..operators import retrieval as R
from ..operators import routing as RT
from ..operators import running as RN
from ..operators import split as S
from ..operators.topk import exact_top_k
from ..schemas import (CATEGORICAL_FEATURES, CLASS_NAMES, CONVERSATIONS, EVENTS, NUMERIC_FEATURES,
                       ORDERS)
from ..session import work_dir
from ..sources import files as FS
from ..sources.risk_orders import line_distance, risk_orders
from ..sources.tables import table
from ..streaming import (carry_available, read_stream, run_available, run_updates, stream_carry_context,
                         stream_rates, stream_screen)
from . import settings as X

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    from . import model_queries  # noqa: F401  (registers the model queries)
    return dict(_REGISTRY)


def scored(spark, d) -> DataFrame:
    return risk_orders(spark, d, distance=False, score=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a written table, for operators that read their input more than once."""
    return FS.cache_features(df, work_dir(df.sparkSession, name))


def decided(spark, d, threshold=X.DECISION) -> DataFrame:
    return scored(spark, d).withColumn("predicted", L.at_least(F.col("p"), threshold))


# ---- order table and profile ----------------------------------------------------------------

@_query
def q_risk_orders(spark, d):
    return risk_orders(spark, d)


@_query
def q_risk_orders_by_lines(spark, d):
    return (risk_orders(spark, d, label="lines", distance=False)
            .groupBy("product_category").agg(F.count(F.lit(1)).alias("n"),
                                             F.sum(F.col("returned").cast("bigint")).alias("hits")))


@_query
def q_delivery_distance(spark, d):
    return line_distance(
        table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"),
        table(spark, d, "supplier").select("s_suppkey", "s_nationkey"),
        table(spark, d, "orders").select("o_orderkey", "o_custkey"),
        table(spark, d, "customer").select("c_custkey", "c_nationkey"))


@_query
def q_profile(spark, d):
    return PR.table_profile(risk_orders(spark, d), "returned", "rating_given")


@_query
def q_rate_by_category(spark, d):
    return PR.rate_by(risk_orders(spark, d, distance=False), "product_category", "returned")


@_query
def q_rate_by_payment(spark, d):
    return PR.rate_by(risk_orders(spark, d, distance=False), "payment_method", "returned")


@_query
def q_null_share_by_payment(spark, d):
    return PR.null_share_by(risk_orders(spark, d, distance=False), "payment_method",
                            "rating_given")


@_query
def q_missing_gap(spark, d):
    out = PR.missing_gap(risk_orders(spark, d, distance=False), "rating_given",
                         F.col("payment_method") == X.COD_VALUE)
    return out.withColumn("gap_pp", F.round("gap_pp", 6))


@_query
def q_clip_round_ratio(spark, d):
    o = risk_orders(spark, d, distance=False)
    return o.select(
        "order_id",
        L.clip(F.col("discount_pct"), 2.0, 7.5).alias("clipped"),
        L.clip(F.col("customer_tenure_days"), 30).alias("floored"),
        L.clip(F.lit(3).cast("bigint"), F.lit(0).cast("bigint"), F.col("num_previous_orders"))
        .alias("bounded"),
        L.round_to(F.col("price_inr"), 0).alias("rounded"),
        F.round(L.safe_ratio(F.col("num_previous_returns"), F.col("num_previous_orders")), 9)
        .alias("ratio"),
        L.member_flag(F.col("product_category"), X.FIT_CATEGORIES).alias("fit"))


@_query
def q_logit_score(spark, d):
    return scored(spark, d).select("order_id", "p", "returned")


@_query
def q_customer_history(spark, d):
    return risk_orders(spark, d, distance=False).select(
        "order_id", "num_previous_orders", "num_previous_returns", "customer_tenure_days")


@_query
def q_row_key(spark, d):
    """Sequential key 1..N in (date, order) sequence."""
    orders = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return RN.row_numbers(orders, ["day", "o_orderkey"], "row_key").select("o_orderkey", "row_key")


@_query
def q_shuffle_column(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return RN.shuffle_column(orders, "o_orderkey", ["o_totalprice"], X.SEED).select(
        "o_orderkey", "o_totalprice", "shuffled_o_totalprice")


@_query
def q_orders_csv(spark, d):
    """Order table through a CSV file and back."""
    path = work_dir(spark, "orders-csv")
    FS.write_csv(risk_orders(spark, d), path)
    return FS.read_orders_csv(spark, path, ORDERS)


# ---- split, folds, preparation --------------------------------------------------------------

def labelled(spark, d, distance=False) -> DataFrame:
    return stored(risk_orders(spark, d, distance=distance), "orders")


@_query
def q_split(spark, d):
    rows = labelled(spark, d).select("order_id", "returned")
    return S.stratified_split(rows, "returned", "order_id", 0.2, X.SEED)


@_query
def q_split_by_count(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    return (S.stratified_split(rows, "label", "vec_id", 101, X.SEED)
            .groupBy("label", "split").agg(F.count(F.lit(1)).alias("n")))


@_query
def q_folds(spark, d):
    rows = labelled(spark, d).select("order_id", "returned")
    return S.stratified_folds(rows, "returned", "order_id", 5, X.SEED)


def split_orders(spark, d, distance=True) -> DataFrame:
    return stored(S.stratified_split(labelled(spark, d, distance), "returned", "order_id", 0.2,
                                     X.SEED), "split")


def fitted_prep(rows: DataFrame) -> P.OrderPrepModel:
    return P.OrderPrep().fit(rows.filter(F.col("split") == "train"))


@_query
def q_prep_stats(spark, d):
    s = fitted_prep(split_orders(spark, d)).statistics()
    return spark.createDataFrame(
        [(c, s["median"][c], round(s["mean"][c], 6), round(s["std"][c], 6))
         for c in NUMERIC_FEATURES], "feature string, median double, mean double, std double")


@_query
def q_prep_categories(spark, d):
    s = fitted_prep(split_orders(spark, d)).statistics()
    return spark.createDataFrame(
        [(c, v, v == s["mode"][c]) for c in CATEGORICAL_FEATURES for v in s["categories"][c]],
        "feature string, value string, is_mode boolean")


@_query
def q_prep_apply(spark, d):
    rows = split_orders(spark, d)
    encoded = fitted_prep(rows).encoded(rows, ["order_id", "split"])
    return encoded.select("order_id", "split", *[
        F.round(F.col(f"`{c}`"), 6).alias(c) for c in encoded.columns[2:]])


@_query
def q_category_slots(spark, d):
    """Slots of priority and customer of every order, numbered on the training part."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.when(
        F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("string")).alias("customer"))
    prep = CI.IndexedPrep(work_dir(spark, "categories"), categorical=["priority", "customer"])
    model = prep.fit(orders.filter(F.col("o_orderkey") % 3 != 0))
    return model.indexed(orders).select("o_orderkey", "priority_slot", "customer_slot")


# ---- evaluation of the fixed score ----------------------------------------------------------

@_query
def q_class_weights(spark, d):
    return M.balanced_weights(scored(spark, d), "returned").select(
        "returned", "n", F.round("weight", 9).alias("weight"))


@_query
def q_majority_baseline(spark, d):
    out = M.majority_class(scored(spark, d), "returned")
    return out.select("majority", F.round("share", 9).alias("share"))


@_query
def q_negative_share(spark, d):
    return M.negative_share(scored(spark, d), "returned").select(
        F.round("negative_share", 9).alias("negative_share"))


@_query
def q_confusion_counts(spark, d):
    return M.binary_metrics(M.confusion_counts(decided(spark, d), "returned", "predicted"))


@_query
def q_report(spark, d):
    return M.classification_report(decided(spark, d, X.SUBGROUP_DECISION), "returned", "predicted")


@_query
def q_auc(spark, d):
    return M.roc_auc(scored(spark, d), "returned", "p").select(F.round("auc", 9).alias("auc"))


@_query
def q_auc_by_payment(spark, d):
    return M.roc_auc(scored(spark, d), "returned", "p", by=["payment_method"]).select(
        "payment_method", F.round("auc", 9).alias("auc"))


@_query
def q_threshold_sweep(spark, d):
    return M.threshold_sweep(scored(spark, d), "returned", "p").orderBy("threshold")


@_query
def q_best_threshold(spark, d):
    return M.best_threshold(M.threshold_sweep(scored(spark, d), "returned", "p"))


@_query
def q_tradeoff(spark, d):
    return M.threshold_tradeoff(scored(spark, d), "returned", "p").select(
        "threshold", *[F.round(c, 6).alias(c) for c in ("recall_gain_pp", "precision_drop_pp")])


def _subgroups(spark, d):
    return M.subgroup_metrics(decided(spark, d, X.SUBGROUP_DECISION), "returned", "predicted",
                              ["product_category", "payment_method"])


@_query
def q_subgroups(spark, d):
    return _subgroups(spark, d)


@_query
def q_weakest(spark, d):
    return M.weakest_subgroup(_subgroups(spark, d))


@_query
def q_group_thresholds(spark, d):
    return M.group_thresholds(scored(spark, d), "returned", "p", "product_category")


@_query
def q_risk_bucket(spark, d):
    from ..operators.models import with_bucket

    rows = stored(scored(spark, d).select("order_id", "returned", "p"), "scores")
    t_star = M.best_threshold(M.threshold_sweep(rows, "returned", "p")).first()["threshold"]
    path = work_dir(spark, "t-star")
    FS.save_scalar(spark, t_star, path)
    return with_bucket(rows, "p", FS.load_scalar(spark, path)).select(
        "order_id", "risk_bucket", "return_probability", "t_star", "cut_points")


# ---- vectors and classifier evaluation ------------------------------------------------------

def neighbours(spark, d, k=3) -> DataFrame:
    e = table(spark, d, "embeddings")
    return exact_top_k(e, e, k, query_id="vec_id", query_vec="embedding", item_id="vec_id",
                       item_vec="embedding", carry=["label"], exclude_self=True)


def nearest_label(spark, d) -> DataFrame:
    """Every vector with the most common label of its three neighbours (smallest on ties)."""
    votes = neighbours(spark, d).groupBy(F.col("query_id").alias("vec_id")).agg(
        F.mode("label", True).alias("predicted"))
    return table(spark, d, "embeddings").select("vec_id", "label").join(votes, "vec_id")


def nearest_cells(spark, d) -> DataFrame:
    return M.cell_counts(nearest_label(spark, d), "label", "predicted")


LABELS = list(range(X.CLASSES))


@_query
def q_topk(spark, d):
    return neighbours(spark, d).select("query_id", "item_id", "score", "rank")


def approximate_neighbours(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    index = HT.build_hash_index(e, item_id="vec_id", item_vec="embedding", tables=X.TABLES, bucket_rows=X.BUCKET_ROWS,
                                keep=X.KEEP)
    return HT.hash_top_k(e, index, 3, query_id="vec_id", query_vec="embedding", probes=X.PROBES, exclude_self=True)


@_query
def q_approximate_topk(spark, d):
    return approximate_neighbours(spark, d)


@_query
def q_approximate_recall(spark, d):
    """How many of the exact three neighbours the hash tables find."""
    return HT.recall(approximate_neighbours(spark, d), neighbours(spark, d))


@_query
def q_nn_predict(spark, d):
    return nearest_label(spark, d)


@_query
def q_confusion_matrix(spark, d):
    return C.confusion_matrix(nearest_label(spark, d), "label", "predicted", LABELS)


@_query
def q_confusion_cells(spark, d):
    return C.dense_cells(nearest_cells(spark, d), LABELS)


@_query
def q_per_class(spark, d):
    return M.per_class_metrics(nearest_label(spark, d), "label", "predicted")


@_query
def q_metrics_csv(spark, d):
    """Per-class measures through a CSV file and back."""
    rows, path = M.per_class_metrics(nearest_label(spark, d), "label", "predicted"), work_dir(spark, "metrics-csv")
    FS.write_metrics_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@_query
def q_matrix_csv(spark, d):
    """The matrix with class names through a CSV file and back."""
    path = work_dir(spark, "matrix-csv")
    FS.write_matrix_csv(C.confusion_matrix(nearest_label(spark, d), "label", "predicted", LABELS), CLASS_NAMES, path)
    kinds = ", ".join(["class string", *[f"p_{i} bigint" for i in LABELS]])
    return spark.read.schema(kinds).option("header", True).option("enforceSchema", True).csv(path)


@_query
def q_report_files(spark, d):
    """The evaluation report as text files, one folder per section, read back."""
    report = stored(q_evaluation_report(spark, d), "report")
    path = work_dir(spark, "report-text")
    FS.write_report(report, path)
    return spark.read.text(path).select("section", F.col("value").alias("text"))


@_query
def q_inline_names(spark, d):
    """Rows per class name: names from an inline table, counts from the vectors."""
    names = FS.inline_table(spark, list(enumerate(CLASS_NAMES)), "i int, name string")
    n = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return names.join(n, F.col("i") == F.col("label")).select("name", "n")


@_query
def q_accuracy(spark, d):
    from ..operators.models import gate

    return gate(M.accuracy(nearest_label(spark, d), "label", "predicted"))


@_query
def q_confused_pairs(spark, d):
    return C.top_confused_pairs(nearest_cells(spark, d), 5)


def _texts(spark, d) -> DataFrame:
    return C.label_texts(table(spark, d, "embeddings"), "label", CLASS_NAMES, 4)


@_query
def q_pair_text(spark, d):
    return C.explain_pairs(C.top_confused_pairs(nearest_cells(spark, d), 45),
                           _texts(spark, d), CLASS_NAMES)


@_query
def q_evaluation_report(spark, d):
    report = C.evaluation_report(stored(nearest_label(spark, d), "predictions"), "label",
                                 "predicted", CLASS_NAMES, texts=_texts(spark, d))
    return report.select("section", F.col("line_no").cast("bigint").alias("line_no"), "text")


def _probs(spark, d) -> DataFrame:
    # every dimension counts: class i adds up dimensions i, i + 10, i + 20, ...
    v = L.as_doubles(F.col("embedding"))
    logits = F.array(*[reduce(add, [F.element_at(v, j + 1) for j in range(i, X.DIMENSIONS, X.CLASSES)])
                       for i in range(X.CLASSES)])
    return table(spark, d, "embeddings").select(
        "vec_id", "label", L.softmax(F.transform(logits, lambda x: x * 8.0)).alias("probs"))


@_query
def q_softmax_argmax(spark, d):
    from ..operators.models import predict_class

    rows = _probs(spark, d).withColumn("predicted", L.argmax(F.col("probs")))
    return predict_class(rows, CLASS_NAMES).select(
        "vec_id", "predicted", "predicted_category", "confidence",
        F.round(F.element_at("probs", 1), 9).alias("p0"))


@_query
def q_log_loss(spark, d):
    return M.log_loss(_probs(spark, d), "probs", "label").select(
        F.round("log_loss", 9).alias("log_loss"))


@_query
def q_affine(spark, d):
    """Channel constants in turn over all dimensions."""
    turn = lambda c: [c[i % 3] for i in range(X.DIMENSIONS)]
    v = L.affine(F.col("embedding"), turn(X.CHANNEL_MEAN), turn(X.CHANNEL_STD))
    out = table(spark, d, "embeddings").select("vec_id", F.posexplode(v).alias("dim", "x"))
    return out.select("vec_id", "dim", F.round("x", 9).alias("x"))


@_query
def q_normalize_dot(spark, d):
    half = X.DIMENSIONS // 2
    head = F.slice("embedding", 1, half)
    tail = F.slice("embedding", half + 1, half)
    out = table(spark, d, "embeddings").select("vec_id", L.l2_normalize(head).alias("a"),
                                               L.l2_normalize(tail).alias("b"))
    return out.select("vec_id", F.round(L.dot(F.col("a"), F.col("b")), 9).alias("cosine"))


@_query
def q_sample_per_class(spark, d):
    rows = S.sample_per_class(table(spark, d, "embeddings").select("vec_id", "label"), "label",
                              "vec_id")
    return rows.select("vec_id", "label", L.sample_name(
        F.col("label"), L.class_name(F.col("label"), CLASS_NAMES)).alias("file_name"))


@_query
def q_topk_documents(spark, d):
    hits = neighbours(spark, d).withColumn("parent_doc_id", F.floor(F.col("item_id") / 4))
    return R.best_per_document(hits)


@_query
def q_grounded(spark, d):
    return R.groundedness(neighbours(spark, d), table(spark, d, "embeddings"), "vec_id")


@_query
def q_top2_confidence(spark, d):
    return R.top2_confidence(neighbours(spark, d))


def _precision_recall(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    hits = neighbours(spark, d).select("query_id", F.col("item_id").alias("doc"),
                                       F.col("label").alias("doc_class"))
    sizes = e.groupBy(F.col("label").alias("doc_class")).agg(
        F.count(F.lit(1)).alias("class_size"))
    asked = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_class"))
    return R.precision_recall_by_class(hits, asked, sizes)


@_query
def q_precision_recall(spark, d):
    return _precision_recall(spark, d)


@_query
def q_precision_recall_average(spark, d):
    return R.macro_average(_precision_recall(spark, d)).select(
        "n_queries", F.round("precision", 9).alias("precision"),
        F.round("recall", 9).alias("recall"))


# ---- text retrieval -------------------------------------------------------------------------

def chunks_of(spark, d) -> DataFrame:
    return R.chunk_documents(table(spark, d, "documents"))


def text_index(spark, d) -> PO.Index:
    return PO.build_postings(chunks_of(spark, d), work_dir(spark, "index"), ["parent_doc_id", "text"], width=X.WIDTH)


def first_sentences(index: PO.Index) -> DataFrame:
    return index.texts.filter(F.col("chunk_id").endswith("__0"))


@_query
def q_chunks(spark, d):
    return chunks_of(spark, d)


@_query
def q_chunks_json(spark, d):
    """Chunks through JSON files and back."""
    chunks, path = chunks_of(spark, d), work_dir(spark, "chunks-json")
    FS.write_json(chunks, path)
    return FS.read_json(spark, path, chunks.schema, multi_line=False)


@_query
def q_evaluate_retrieval(spark, d):
    """Each document's first sentence asks for all documents that begin with it."""
    index = text_index(spark, d)
    key = first_sentences(index).groupBy(F.col("text").alias("query")).agg(
        F.collect_set("parent_doc_id").alias("relevant_doc_ids"))
    return R.evaluate_text_retrieval(key, index, 3)


@_query
def q_text_topk(spark, d):
    """Best chunks for every benchmark passage."""
    return PO.search_postings(table(spark, d, "benchmark"), text_index(spark, d), 3, key="item_id",
                              carry=["parent_doc_id"]).select("query_id", "chunk_id", "parent_doc_id", "score", "rank")


@_query
def q_known_item(spark, d):
    """Precision and recall when each document is asked for by its first sentence."""
    index = text_index(spark, d)
    asked = first_sentences(index).select(F.col("parent_doc_id").alias("query_id"), "text")
    hits = PO.search_postings(asked, index, 3, carry=["parent_doc_id"])
    got = R.best_per_document(hits).select("query_id", F.col("parent_doc_id").alias("doc"))
    relevant = asked.select("query_id", F.col("query_id").alias("doc"))
    return R.precision_recall(got, relevant)


# ---- conversations --------------------------------------------------------------------------

def turns_of(conversations: DataFrame) -> DataFrame:
    """Turns with the inputs that come along with some of them."""
    low = F.lower("text")
    return conversations.select(
        "conv_id", "turn", F.col("text").alias("user_input"),
        F.when((F.col("role") == "user") & low.contains("an"),
               F.col("conv_id") * 37 + F.col("turn")).alias("order_ref"),
        F.when((F.col("role") == "user") & low.contains("er"),
               (F.col("conv_id") * 4 + F.col("turn")).cast("string"))
        .when(F.col("role") == "system", F.lit("")).alias("image_path"))


PHRASES = {"injection": X.INJECTION, "risk": X.RISK, "image": X.IMAGE}


def screened_turns(spark, d) -> DataFrame:
    return RT.screen_turns(turns_of(table(spark, d, "conversations")), **PHRASES)


@_query
def q_injection(spark, d):
    return RT.flag_injection(turns_of(table(spark, d, "conversations")), phrases=X.INJECTION
                             ).select("conv_id", "turn", "blocked", "matched_pattern")


@_query
def q_intent(spark, d):
    return RT.classify_intent(turns_of(table(spark, d, "conversations")), risk=X.RISK,
                              image=X.IMAGE).select("conv_id", "turn", "intent")


@_query
def q_route(spark, d):
    return screened_turns(spark, d).select("conv_id", "turn", "blocked", "matched_pattern",
                                           "intent", "route")


CONTEXT = ["conv_id", "turn", "session_order", "session_image", "resolved_order",
           "resolved_image", "missing_context"]


@_query
def q_carry_context(spark, d):
    return RT.resolve_context(screened_turns(spark, d), order="order_ref").select(*CONTEXT)


@_query
def q_carry_events(spark, d):
    """Value of the latest purchase of the user at every event."""
    e = table(spark, d, "events")
    return RN.carry_forward(
        e, "user_id", "event_id",
        {"last_purchase": F.when(F.col("event_type") == "purchase", F.col("value"))}
    ).select("event_id", "user_id", "last_purchase")


@_query
def q_missing_context(spark, d):
    out = RT.resolve_context(screened_turns(spark, d), order="order_ref")
    return (out.groupBy("intent", "missing_context").agg(F.count(F.lit(1)).alias("n")))


def answered_turns(spark, d) -> DataFrame:
    """All turns with evidence, tool results and final answers."""
    from ..operators.models import predict_class, with_bucket

    turns = stored(screened_turns(spark, d).withColumn(
        "turn_key", F.concat_ws(":", "conv_id", "turn")), "turns")
    asked = turns.filter(F.col("route") == "retrieve").select("turn_key", "user_input")
    hits = PO.search_postings(asked, text_index(spark, d), 3, key="turn_key", text="user_input", carry=["text"])
    orders = with_bucket(scored(spark, d), "p", 0.25).select(
        F.col("order_id").alias("risk_key"), "return_probability", "risk_bucket", "cut_points")
    images = predict_class(_probs(spark, d), CLASS_NAMES).select(
        F.col("vec_id").cast("string").alias("image_key"), "predicted_category",
        F.col("confidence").alias("class_confidence"))
    resolved = RT.resolve_context(turns, order="order_ref")
    return RT.answer_turns(RT.attach_tools(resolved, evidence=RT.policy_evidence(hits),
                                           risk=orders, images=images))


@_query
def q_answers(spark, d):
    return answered_turns(spark, d).select("conv_id", "turn", "route", "final_answer.*")


@_query
def q_transcript(spark, d):
    rows = RT.transcript(answered_turns(spark, d))
    return rows.select(
        "conv_id", "part", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat_ws(
            "|", t["turn"].cast("string"), t["final_answer"]["source"],
            F.format_string("%.4f", t["final_answer"]["confidence"]),
            F.coalesce(t["debug"]["groundedness"]["grounded"].cast("string"), F.lit("-")),
            t["final_answer"]["answer"])), "\n").alias("log"))


# ---- streams --------------------------------------------------------------------------------

def _turn_stream(spark, d) -> DataFrame:
    return turns_of(read_stream(spark, d, "conversations", CONVERSATIONS))


@_query
def q_stream_screen(spark, d):
    out = stream_screen(_turn_stream(spark, d), **PHRASES)
    return run_available(out.select("conv_id", "turn", "blocked", "matched_pattern", "intent",
                                    "route"), "screen")


@_query
def q_stream_carry(spark, d):
    screened = stream_screen(_turn_stream(spark, d), **PHRASES)
    return carry_available(stream_carry_context(screened), "carry").select(
        "conv_id", "turn", F.col("session_order").cast("bigint").alias("session_order"),
        "session_image", F.col("resolved_order").cast("bigint").alias("resolved_order"),
        "resolved_image", "missing_context")


@_query
def q_stream_rates(spark, d):
    """All windows, those still open at the end of the input included."""
    rates = stream_rates(read_stream(spark, d, "events", EVENTS), delay=None)
    return run_updates(rates, ["window_start", "event_type"], "rates").select(
        F.to_date("window_start").alias("day"), "event_type", "n", "null_share",
        F.round("mean_value", 6).alias("mean_value"))
