"""Numeric, conditional and hashing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "clip", "round_to", "either", "member_flag", "safe_ratio", "div0", "return_logit", "sigmoid",
    "hash_uniform", "order_hash", "mask_null", "bernoulli", "at_least", "class_name", "pair_low",
    "pair_high", "risk_bucket", "cut_points", "percent_text", "first_present", "nan_to_null",
    "f1_score", "pp_delta",
]


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clip(c: Column, lo=None, hi=None) -> Column:
    """Bound `c` on either side; a bound may be a column, and null stays null."""
    out = c
    if lo is not None:
        out = F.greatest(out, _col(lo))
    if hi is not None:
        out = F.least(out, _col(hi))
    # greatest/least skip nulls, so a missing value would otherwise turn into the bound
    return F.when(c.isNotNull(), out)


def round_to(c: Column, digits: int) -> Column:
    """Half-even rounding."""
    return F.bround(c, digits)


def either(condition: Column, yes, no) -> Column:
    return F.when(condition, _col(yes)).otherwise(_col(no))


def member_flag(c: Column, values) -> Column:
    """1.0 where `c` is one of `values`, else 0.0 (null counts as not a member)."""
    return F.coalesce(c.isin(*values), F.lit(False)).cast("double")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1) when b is positive, else 0."""
    return F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(F.lit(0.0))


def div0(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def f1_score(tp: Column, predicted: Column, actual: Column) -> Column:
    """F1 of integer counts in one division, so every engine gives the same double."""
    return div0(2 * tp, predicted + actual)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def return_logit(prev_returns: Column, prev_orders: Column, category: Column, discount: Column,
                 payment: Column, delivery_days: Column, price: Column, weekend: Column,
                 tenure: Column, *, fit_categories=("Apparel", "Footwear"), cod_value="COD",
                 price_scale: float = 45000.0) -> Column:
    """Fixed eight-term return-risk score; null inputs count as a neutral value.

    The weights are fixed values of the reference score.
    """
    ratio = safe_ratio(prev_returns, prev_orders)
    return (
        F.lit(-2.2)
        + F.lit(1.9) * ratio
        + F.lit(0.55) * member_flag(category, fit_categories)
        + F.lit(0.014) * (F.coalesce(discount, F.lit(20.0)) - F.lit(20.0)) / F.lit(10.0)
        + F.lit(0.9) * member_flag(payment, [cod_value])
        + F.lit(0.10) * (F.coalesce(delivery_days.cast("double"), F.lit(4.5)) - F.lit(4.5))
        / F.lit(2.0)
        + F.lit(0.30) * (price / F.lit(float(price_scale)))
        + F.lit(0.05) * weekend.cast("double")
        - F.lit(0.15) * F.tanh(tenure.cast("double") / F.lit(500.0))
    )


def hash_uniform(key: Column, salt: int = 0) -> Column:
    """A number in [0, 1) that depends on an integer key only, never on partitioning.

    Multiplicative hash modulo 2^32. The product is formed from two 16-bit halves, so no key is
    large enough to overflow a 64-bit integer.
    """
    folded = F.pmod(key.cast("bigint") + F.lit(salt), F.lit(1 << 32).cast("bigint"))
    high = F.shiftright(folded, 16)
    low = folded.bitwiseAND(F.lit(65535).cast("bigint"))
    mult = F.lit(2654435761).cast("bigint")
    carried = (high * mult) % F.lit(65536) * F.lit(65536)
    mixed = (carried + low * mult) % F.lit(1 << 32).cast("bigint")
    return mixed.cast("double") / F.lit(4294967296.0)


def order_hash(key: Column, seed) -> Column:
    """md5 text of `key:seed`; sorting by it gives a reproducible random order."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def mask_null(c: Column, key: Column, rate: Column, salt: int = 1) -> Column:
    """Null out `c` with a per-row probability."""
    return F.when(hash_uniform(key, salt) >= rate, c)


def bernoulli(key: Column, p: Column, salt: int = 0) -> Column:
    return (hash_uniform(key, salt) < p).cast("int")


def at_least(score: Column, threshold) -> Column:
    """Predicted class for an inclusive threshold."""
    return (score >= _col(threshold)).cast("int")


def class_name(index: Column, names) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index.cast("int") + 1)


def pair_low(i: Column, j: Column) -> Column:
    return F.least(i, j)


def pair_high(i: Column, j: Column) -> Column:
    return F.greatest(i, j)


HIGH_MARGIN = 0.15  # fixed value: distance from the Medium to the High cut


def risk_bucket(p: Column, t: Column) -> Column:
    """Low below t, High from t + 0.15, Medium between; compares the unrounded probability."""
    return (F.when(p < t, F.lit("Low"))
            .when(p >= t + F.lit(HIGH_MARGIN), F.lit("High"))
            .when(p.isNotNull(), F.lit("Medium")))


def cut_points(t: Column) -> Column:
    return F.format_string("Low < %.2f <= Medium < %.2f <= High", t, t + F.lit(HIGH_MARGIN))


def percent_text(p: Column) -> Column:
    return F.format_string("%.2f%%", p * F.lit(100.0))


def first_present(explicit: Column, carried: Column) -> Column:
    """The explicit text unless it is missing or empty, else the carried one."""
    return F.coalesce(F.nullif(explicit, F.lit("")), carried)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def pp_delta(after: Column, before: Column) -> Column:
    """Difference in percentage points."""
    return (after - before) * F.lit(100.0)
