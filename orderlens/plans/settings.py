"""Parameters shared by the registered queries and their SQL."""

from ..sources.risk_orders import COD_VALUE, FIT_CATEGORIES, MISSING_RATES, PRICE_SCALE

DECISION = 0.5          # default decision threshold
SUBGROUP_DECISION = 0.3  # the stand-in scores seldom reach 0.5
SEED = 42
WIDTH = 1 << 30         # slots of words
CLASSES = 10
DIMENSIONS = 64         # of the vectors in the embedding table
TABLES, BUCKET_ROWS, PROBES, KEEP = 12, 64, 3, 16  # hash tables of the approximate search
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)  # fixed values

# stated weights of the stand-in model, by feature
FIXED_WEIGHTS = {"num_previous_returns": 0.25, "discount_pct": 0.0625, "delivery_days": 0.03125,
                 "is_weekend_order": 0.125}

# weights of the stated scores that are compared by cross-validation
CANDIDATES = [
    {"num_previous_returns": 0.25, "discount_pct": 0.0625, "delivery_days": 0.03125},
    {"num_previous_returns": 0.5, "is_weekend_order": 0.125},
    {"discount_pct": 0.125, "delivery_days": 0.0625, "num_previous_orders": -0.03125},
    {"delivery_days": 0.25}]

NEWTON_SCALES = {"discount_pct": 10.0, "delivery_days": 21.0}  # features of the regression and their scales

# Phrases that occur in the conversation table (its texts never contain the default ones).
INJECTION = ["worthl", "der die", "stion of", "que la ", "estha"]
RISK = ["ing th", "tion de", "heit d", "ción"]
IMAGE = ["her", "eux", "ung"]

__all__ = [n for n in globals() if n.isupper()]
