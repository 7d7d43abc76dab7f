"""Explicit schemas. Nothing in the library infers types."""

from pyspark.sql import types as T


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# Column names and category names below are fixed values of the data model.
NUMERIC_FEATURES = [
    "price_inr", "discount_pct", "customer_tenure_days", "num_previous_orders",
    "num_previous_returns", "delivery_distance_km", "delivery_days",
    "is_weekend_order", "rating_given",
]
CATEGORICAL_FEATURES = ["product_category", "payment_method"]
TARGET = "returned"
KEY = "order_id"

ORDERS = _struct(
    ("order_id", T.LongType()),
    ("product_category", T.StringType()),
    ("price_inr", T.DoubleType()),
    ("discount_pct", T.DoubleType()),
    ("payment_method", T.StringType()),
    ("customer_tenure_days", T.LongType()),
    ("num_previous_orders", T.LongType()),
    ("num_previous_returns", T.LongType()),
    ("delivery_distance_km", T.DoubleType()),
    ("delivery_days", T.LongType()),
    ("is_weekend_order", T.IntegerType()),
    ("rating_given", T.DoubleType()),
    ("returned", T.IntegerType()),
)

ORDER_FEATURES = T.StructType([f for f in ORDERS.fields if f.name not in (KEY, TARGET)])

POLICY_DOCUMENT = _struct(
    ("doc_id", T.StringType()), ("category", T.StringType()), ("text", T.StringType()))

CHUNK = _struct(
    ("chunk_id", T.StringType()), ("parent_doc_id", T.StringType()),
    ("category", T.StringType()), ("text", T.StringType()))

ANSWER_KEY = _struct(
    ("query", T.StringType()), ("relevant_doc_ids", T.ArrayType(T.StringType())))

FINAL_ANSWER = _struct(
    ("answer", T.StringType()), ("source", T.StringType()), ("confidence", T.DoubleType()))

TURN = _struct(
    ("conv_id", T.LongType()), ("turn", T.LongType()), ("user_input", T.StringType()),
    ("order_features", ORDER_FEATURES), ("image_path", T.StringType()))

CONVERSATIONS = _struct(
    ("conv_id", T.LongType()), ("turn", T.LongType()),
    ("role", T.StringType()), ("text", T.StringType()))

EVENTS = _struct(
    ("event_id", T.LongType()), ("ts", T.TimestampNTZType()), ("user_id", T.LongType()),
    ("event_type", T.StringType()), ("value", T.DoubleType()), ("props", T.StringType()))

# Names of the ten product classes, in label order (fixed values).
CLASS_NAMES = [
    "T-shirt/top", "Trouser", "Pullover", "Dress", "Coat",
    "Sandal", "Shirt", "Sneaker", "Bag", "Ankle boot",
]
