"""The same questions in plain SQL for DuckDB, written without the library's shortcuts: one pass
per threshold, full cross products for nearest neighbours, plain windows for history."""

from __future__ import annotations

from ..operators import routing as RT
from ..operators.confusion import NO_TEXT
from ..schemas import CATEGORICAL_FEATURES, CLASS_NAMES, NUMERIC_FEATURES
from . import settings as X


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


_IN_MISSING, _OUT_MISSING = X.MISSING_RATES
_UNIFORM = "(((k + {salt}) * 2654435761) % 4294967296)::DOUBLE / 4294967296.0::DOUBLE"

ORDERS = f"""
line_facts AS (
  SELECT l_orderkey, count(*) AS n_lines,
         sum(CAST(round(l_discount * 100) AS BIGINT)) AS hundredths,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_returned,
         min(l_shipdate) AS first_ship
  FROM lineitem GROUP BY l_orderkey),
top_line AS (
  SELECT l_orderkey, l_partkey FROM (
    SELECT l_orderkey, l_partkey, row_number() OVER (
      PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS rn
    FROM lineitem) WHERE rn = 1),
distance AS (
  SELECT l_orderkey, floor((20 * total + n) / (2 * n))::DOUBLE / 10.0::DOUBLE AS km FROM (
    SELECT l_orderkey, count(*) AS n, sum(100 * abs(c_nationkey - s_nationkey)) AS total
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    GROUP BY l_orderkey)),
placed AS (
  SELECT o_orderkey AS k, o_custkey, o_totalprice, o_orderpriority,
         CAST(o_orderdate AS DATE) AS day, n_lines, hundredths, first_ship, p_type,
         CASE WHEN 2 * n_returned > n_lines THEN 1 ELSE 0 END AS line_returned, km
  FROM orders LEFT JOIN line_facts f ON f.l_orderkey = o_orderkey
  LEFT JOIN top_line t ON t.l_orderkey = o_orderkey
  LEFT JOIN part ON p_partkey = t.l_partkey
  LEFT JOIN distance x ON x.l_orderkey = o_orderkey),
features AS (
  SELECT k AS order_id, p_type AS product_category, o_totalprice AS price_inr,
         floor((20 * hundredths + n_lines) / (2 * n_lines))::DOUBLE / 10.0::DOUBLE AS discount_pct,
         o_orderpriority AS payment_method,
         CAST(day - min(day) OVER (PARTITION BY o_custkey) AS BIGINT) AS customer_tenure_days,
         CAST(count(*) OVER w AS BIGINT) AS num_previous_orders,
         CAST(coalesce(sum(line_returned) OVER w, 0) AS BIGINT) AS num_previous_returns,
         km AS delivery_distance_km,
         CAST(CASE WHEN first_ship IS NULL THEN NULL ELSE
           least(greatest(abs(CAST(first_ship AS DATE) - day) % 21, 1), 21) END AS BIGINT)
           AS delivery_days,
         CASE WHEN dayofweek(day) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend_order,
         CASE WHEN {_UNIFORM.format(salt=1)} >= (CASE WHEN o_orderpriority = {_q(X.COD_VALUE)}
                   THEN {_IN_MISSING} ELSE {_OUT_MISSING} END)::DOUBLE
              THEN (1 + k % 5)::DOUBLE END AS rating_given,
         line_returned, {_UNIFORM.format(salt=0)} AS u
  FROM placed
  WINDOW w AS (PARTITION BY o_custkey ORDER BY day, k
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scored AS (
  SELECT *, CASE WHEN u < p THEN 1 ELSE 0 END AS returned FROM (
    SELECT *, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-z)), 6) AS p FROM (
      SELECT *, -2.2::DOUBLE
        + 1.9::DOUBLE * (CASE WHEN num_previous_orders > 0 THEN
            num_previous_returns::DOUBLE / greatest(num_previous_orders, 1) ELSE 0.0::DOUBLE END)
        + 0.55::DOUBLE * (CASE WHEN product_category IN
            ({", ".join(_q(v) for v in X.FIT_CATEGORIES)}) THEN 1 ELSE 0 END)
        + 0.014::DOUBLE * (coalesce(discount_pct, 20) - 20) / 10
        + 0.9::DOUBLE * (CASE WHEN payment_method = {_q(X.COD_VALUE)} THEN 1 ELSE 0 END)
        + 0.10::DOUBLE * (coalesce(delivery_days::DOUBLE, 4.5::DOUBLE) - 4.5::DOUBLE) / 2
        + 0.30::DOUBLE * (price_inr / {X.PRICE_SCALE}::DOUBLE)
        + 0.05::DOUBLE * is_weekend_order
        - 0.15::DOUBLE * ((exp(2 * (customer_tenure_days::DOUBLE / 500)) - 1)
                          / (exp(2 * (customer_tenure_days::DOUBLE / 500)) + 1)) AS z
      FROM features)))"""

# the score has six decimals; half-even to four, in whole millionths
_FOUR = """((CAST(round(p * 1000000) AS BIGINT) // 100
  + CASE WHEN CAST(round(p * 1000000) AS BIGINT) % 100 > 50
           OR (CAST(round(p * 1000000) AS BIGINT) % 100 = 50
               AND (CAST(round(p * 1000000) AS BIGINT) // 100) % 2 = 1)
         THEN 1 ELSE 0 END)::DOUBLE / 10000)"""

COLUMNS = ("order_id, product_category, price_inr, discount_pct, payment_method, "
           "customer_tenure_days, num_previous_orders, num_previous_returns, "
           "delivery_distance_km, delivery_days, is_weekend_order, rating_given, returned")


def _orders(select: str, more: str = "") -> str:
    return f"WITH {ORDERS}{',' + more if more else ''} {select}"


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END)"


# ---- evaluation -------------------------------------------------------------------------------

def _sweep(group: str = "") -> str:
    """Naive sweep: every row against every threshold."""
    g = f"{group}, " if group else ""
    where = f"WHERE {group} IS NOT NULL" if group else ""
    return f"""
levels AS (SELECT i, 0.10::DOUBLE + i * 0.02::DOUBLE AS t FROM range(41) r(i)),
sweep_counts AS (
  SELECT {g} i, t, sum(CASE WHEN p >= t AND returned = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN p >= t THEN 1 ELSE 0 END) AS pp, sum(returned) AS pos
  FROM scored, levels {where} GROUP BY {g} i, t),
sweep AS (
  SELECT {g} round(t, 2) AS threshold, {_ratio('2 * tp', 'pp + pos')} AS f1,
         {_ratio('tp', 'pos')} AS recall, {_ratio('tp', 'pp')} AS "precision"
  FROM sweep_counts)"""


def _confusion(threshold: float) -> str:
    hit = f"p >= {threshold}::DOUBLE"
    return f"""
counts AS (
  SELECT CAST(sum(CASE WHEN returned = 1 AND {hit} THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN returned = 0 AND {hit} THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN returned = 1 AND NOT {hit} THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(sum(CASE WHEN returned = 0 AND NOT {hit} THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM scored),
measures AS (
  SELECT *, {_ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy,
         {_ratio('tp', 'tp + fp')} AS "precision", {_ratio('tp', 'tp + fn')} AS recall,
         {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM counts)"""


_SUBGROUPS = f"""
decided AS (SELECT *, CASE WHEN p >= {X.SUBGROUP_DECISION}::DOUBLE THEN 1 ELSE 0 END AS yes
            FROM scored),
spread AS (
  SELECT 'product_category' AS dimension, product_category AS value, returned, yes FROM decided
  UNION ALL SELECT 'payment_method', payment_method, returned, yes FROM decided
  UNION ALL SELECT 'overall', 'all', returned, yes FROM decided),
subgroups AS (
  SELECT dimension, value, count(*) AS n, CAST(sum(returned) AS BIGINT) AS n_positive,
         {_ratio('sum(returned * yes)', 'sum(returned)')} AS recall,
         {_ratio('sum(returned * yes)', 'sum(yes)')} AS "precision"
  FROM spread WHERE value IS NOT NULL GROUP BY dimension, value)"""


def _auc(group: str = "") -> str:
    """Rank formula with average ranks for ties."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group}" if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""
SELECT {g} round((sum(CASE WHEN returned = 1 THEN avg_rank ELSE 0 END)
        - sum(returned)::DOUBLE * (sum(returned) + 1) / 2)
       / (sum(returned)::DOUBLE * (count(*) - sum(returned))), 9) AS auc
FROM (SELECT *, rank() OVER ({part} ORDER BY p)
             + (count(*) OVER (PARTITION BY {g} p) - 1) / 2.0::DOUBLE AS avg_rank FROM scored)
{by}"""


_REPORT = f"""
decided AS (SELECT returned AS y, CASE WHEN p >= {X.SUBGROUP_DECISION}::DOUBLE THEN 1 ELSE 0 END
            AS yes FROM scored),
classes AS (
  SELECT c, sum(CASE WHEN y = c AND yes = c THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN y = c THEN 1 ELSE 0 END) AS actual,
         sum(CASE WHEN yes = c THEN 1 ELSE 0 END) AS predicted
  FROM decided, (SELECT unnest([0, 1]) AS c) GROUP BY c),
per_class AS (
  SELECT c, tp, actual, {_ratio('tp', 'predicted')} AS pr, {_ratio('tp', 'actual')} AS re,
         {_ratio('2 * tp', 'predicted + actual')} AS f FROM classes)
SELECT CAST(c AS VARCHAR) AS "row", round(pr, 4) AS "precision", round(re, 4) AS recall,
       round(f, 4) AS f1, CAST(actual AS BIGINT) AS support FROM per_class
UNION ALL SELECT 'accuracy', a, a, a, s FROM (
  SELECT round(sum(tp)::DOUBLE / sum(actual), 4) AS a, CAST(sum(actual) AS BIGINT) AS s
  FROM per_class)
UNION ALL SELECT 'macro avg', round(avg(pr), 4), round(avg(re), 4), round(avg(f), 4),
       CAST(sum(actual) AS BIGINT) FROM per_class
UNION ALL SELECT 'weighted avg', round(sum(pr * actual) / sum(actual), 4),
       round(sum(re * actual) / sum(actual), 4), round(sum(f * actual) / sum(actual), 4),
       CAST(sum(actual) AS BIGINT) FROM per_class"""


_REPORT_OF = _REPORT[_REPORT.index("classes AS ("):]


def _fixed_score(vector: str, donor: str = "") -> str:
    """The stand-in model's score; with `donor`, column f comes from there."""
    value = (lambda i: f"(CASE WHEN f = {i} THEN {donor}[{i + 1}] ELSE {vector}[{i + 1}] END)") if donor \
        else (lambda i: f"{vector}[{i + 1}]")
    return "round(" + " + ".join(f"{w}::DOUBLE * {value(i)}" for i, w in enumerate(X.FIXED_WEIGHTS.values())) + ", 6)"


def _area(keys: str, source: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    same = f"{keys}, p" if keys else "p"
    head = f"{keys}, " if keys else ""
    return f"""SELECT {head} (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y)::DOUBLE * (sum(y) + 1) / 2)
         / (sum(y)::DOUBLE * (count(*) - sum(y))) AS auc
  FROM (SELECT *, rank() OVER ({part} ORDER BY p) + (count(*) OVER (PARTITION BY {same}) - 1) / 2.0::DOUBLE AS r
        FROM {source}) {'GROUP BY ' + keys if keys else ''}"""


_FIXED = f"""
own AS (SELECT order_id AS k, returned AS y, [{', '.join(f'coalesce({c}::DOUBLE, 0)' for c in X.FIXED_WEIGHTS)}] AS v
        FROM parts WHERE split = 'test'),
slots AS (SELECT *, row_number() OVER (ORDER BY md5(k::VARCHAR || ':slot'), k) AS slot FROM own),
draws AS (SELECT rep, v AS donor, row_number() OVER (
            PARTITION BY rep ORDER BY md5(k::VARCHAR || ':42:' || rep), k) AS slot FROM own, range(15) q(rep)),
swapped AS (SELECT y, f, rep, {_fixed_score('v', 'donor')} AS p
            FROM slots JOIN draws USING (slot), range({len(X.FIXED_WEIGHTS)}) q(f)),
plain AS (SELECT y, {_fixed_score('v')} AS p FROM own),
areas AS ({_area('f, rep', 'swapped')}),
lost AS (SELECT f, (SELECT auc FROM ({_area('', 'plain')})) - auc AS d FROM areas),
fixed_features AS (SELECT unnest({_list(X.FIXED_WEIGHTS)}) AS feature, unnest(range({len(X.FIXED_WEIGHTS)})) AS f,
             unnest({[w / sum(X.FIXED_WEIGHTS.values()) for w in X.FIXED_WEIGHTS.values()]}) AS importance),
permuted AS (SELECT feature, max(importance) AS importance, avg(d) AS m, stddev_pop(d) AS s
             FROM lost JOIN fixed_features USING (f) GROUP BY feature)"""


# ---- split and preparation ----------------------------------------------------------------------

_SPLIT = f"""
ordered AS (
  SELECT *, md5(order_id::VARCHAR || ':{X.SEED}') AS h FROM scored),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY returned ORDER BY h) AS rn,
         count(*) OVER (PARTITION BY returned) AS size, count(*) OVER () AS total FROM ordered),
class_sizes AS (
  SELECT returned AS c, count(*) AS size, (SELECT count(*) FROM scored) AS total
  FROM scored GROUP BY returned),
wanted AS (SELECT *, ceil(total * 0.2::DOUBLE - 1e-9)::BIGINT AS n_test FROM class_sizes),
whole AS (SELECT *, (size * n_test) // total AS base, (size * n_test) % total AS rest FROM wanted),
quotas AS (
  SELECT c, base + (CASE WHEN row_number() OVER (ORDER BY rest DESC, c)
                     <= n_test - (SELECT sum(base) FROM whole) THEN 1 ELSE 0 END) AS quota
  FROM whole),
parts AS (
  SELECT n.*, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split
  FROM numbered n JOIN quotas q ON q.c = n.returned)"""

_SPLIT_COUNT = f"""
WITH ordered AS (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label
           ORDER BY md5(vec_id::VARCHAR || ':{X.SEED}')) AS rn FROM embeddings),
sizes AS (SELECT label, count(*) AS size, (SELECT count(*) FROM embeddings) AS total
          FROM embeddings GROUP BY label),
whole AS (SELECT *, (size * 101) // total AS base, (size * 101) % total AS rest FROM sizes),
quotas AS (SELECT label, base + (CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
             <= 101 - (SELECT sum(base) FROM whole) THEN 1 ELSE 0 END) AS quota FROM whole)
SELECT o.label, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split, count(*) AS n
FROM ordered o JOIN quotas q ON q.label = o.label GROUP BY 1, 2"""


def _filled(c: str) -> str:
    return f"coalesce({c}::DOUBLE, (SELECT median({c}::DOUBLE) FROM train))"


_TRAIN = _SPLIT + ", train AS (SELECT * FROM parts WHERE split = 'train')"
_STATS = " UNION ALL ".join(
    f"SELECT {_q(c)} AS feature, (SELECT median({c}::DOUBLE) FROM train) AS median, "
    f"round(avg({_filled(c)}), 6) AS mean, "
    f"round(CASE WHEN stddev_pop({_filled(c)}) = 0 THEN 1 ELSE stddev_pop({_filled(c)}) END, 6) "
    f"AS std FROM train" for c in NUMERIC_FEATURES)
_MODES = " UNION ALL ".join(
    f"SELECT {_q(c)} AS feature, value, value = first(value) OVER (ORDER BY n DESC, value) "
    f"AS is_mode FROM (SELECT {c} AS value, count(*) AS n FROM train WHERE {c} IS NOT NULL "
    f"GROUP BY {c})" for c in CATEGORICAL_FEATURES)

# values of the two category columns in the driver tables, ascending
_CATEGORIES = {
    "product_category": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
    "payment_method": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
}
_MODE_CTE = "".join(
    f", mode_{c} AS (SELECT {c} AS m FROM train WHERE {c} IS NOT NULL GROUP BY {c} "
    f"ORDER BY count(*) DESC, {c} LIMIT 1)" for c in CATEGORICAL_FEATURES)
_STATS_ROW = ", stats AS (SELECT " + ", ".join(
    f"median({c}::DOUBLE) AS med_{c}" for c in NUMERIC_FEATURES) + " FROM train), moments AS (" \
    "SELECT " + ", ".join(
    f"avg(coalesce({c}::DOUBLE, med_{c})) AS avg_{c}, "
    f"stddev_pop(coalesce({c}::DOUBLE, med_{c})) AS std_{c}" for c in NUMERIC_FEATURES) \
    + " FROM train, stats)"
_APPLY = "SELECT order_id, split, " + ", ".join(
    f"round((coalesce({c}::DOUBLE, med_{c}) - avg_{c}) / std_{c}, 6) AS {c}"
    for c in NUMERIC_FEATURES) + ", " + ", ".join(
    f"CASE WHEN coalesce({c}, (SELECT m FROM mode_{c})) = {_q(v)} THEN 1.0::DOUBLE "
    f"ELSE 0.0::DOUBLE END AS \"{c}_{v}\"" for c, vs in _CATEGORIES.items() for v in vs) \
    + " FROM parts, stats, moments"


# ---- vectors ----------------------------------------------------------------------------------

_HASHED = f"""
posted AS (SELECT vec_id, v FROM (
  SELECT vec_id, v, row_number() OVER (PARTITION BY v ORDER BY vec_id) AS copy FROM vectors) WHERE copy <= {X.KEEP}),
bits AS (SELECT greatest(1, CAST(ceil(log2(ceil(count(*) / {X.BUCKET_ROWS}.0))) AS INT)) AS n FROM posted),
signs AS (
  SELECT t, b, list(CASE WHEN md5(t || ':' || b || ':' || d)[1] < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END
                    ORDER BY d) AS s
  FROM range({X.TABLES}) AS a(t), range(30) AS c(b), range({X.DIMENSIONS}) AS e(d), bits WHERE b < n GROUP BY t, b),
sides AS (SELECT vec_id, t, b, list_inner_product(v, s) AS m FROM vectors, signs),
codes AS (SELECT vec_id, t, sum(CASE WHEN m >= 0 THEN 1 << b ELSE 0 END)::BIGINT AS code FROM sides GROUP BY vec_id, t),
looks AS (
  SELECT vec_id, t, code FROM codes UNION ALL
  SELECT vec_id, t, xor(code, (1 << b)::BIGINT) FROM codes JOIN (
    SELECT vec_id, t, b, row_number() OVER (PARTITION BY vec_id, t ORDER BY abs(m), b) AS near FROM sides)
  USING (vec_id, t) WHERE near <= {X.PROBES}),
met AS (
  SELECT DISTINCT l.vec_id AS query_id, c.vec_id AS item_id
  FROM looks l JOIN codes c USING (t, code) JOIN posted p ON p.vec_id = c.vec_id WHERE l.vec_id <> c.vec_id),
met_hits AS (SELECT * FROM (
  SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
  FROM met JOIN pairs USING (query_id, item_id)) WHERE rank <= 3)"""

_NEIGHBOURS = """
vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS item_id, b.label, a.label AS query_class,
         round(list_inner_product(a.v, b.v), 6) AS score
  FROM vectors a, vectors b WHERE a.vec_id <> b.vec_id),
hits AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
  FROM pairs) WHERE rank <= 3),
nearest AS (
  SELECT vec_id, label, predicted FROM embeddings JOIN (
    SELECT query_id, label AS predicted, row_number() OVER (
      PARTITION BY query_id ORDER BY count(*) DESC, label) AS rn
    FROM hits GROUP BY query_id, label) ON query_id = vec_id AND rn = 1),
cells AS (SELECT label AS t, predicted AS p, count(*) AS n FROM nearest GROUP BY 1, 2),
names AS (SELECT CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS i, unnest(l) AS name
          FROM (SELECT """ + _list(CLASS_NAMES) + """ AS l)),
spine AS (SELECT a.i AS t, b.i AS p FROM names a, names b),
dense AS (SELECT s.t, s.p, coalesce(n, 0) AS n FROM spine s LEFT JOIN cells c
          ON c.t = s.t AND c.p = s.p),
ranked_pairs AS (
  SELECT t, p, n, row_number() OVER (PARTITION BY least(t, p), greatest(t, p)
                                     ORDER BY n DESC, t DESC, p DESC) AS rn
  FROM cells WHERE t <> p),
class_rows AS (
  SELECT i AS label, (SELECT coalesce(sum(n), 0) FROM cells WHERE t = i AND p = i) AS tp,
         (SELECT coalesce(sum(n), 0) FROM cells WHERE t = i) AS actual,
         (SELECT coalesce(sum(n), 0) FROM cells WHERE p = i) AS predicted FROM names)"""


def _pairs(n: int) -> str:
    return (f"SELECT t AS true_label, p AS pred_label, n FROM ranked_pairs WHERE rn = 1 "
            f"ORDER BY n DESC, t DESC, p DESC LIMIT {n}")


_TEXTS = """(
    WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT na.name AS a, nb.name AS b, printf('%d rows are %s, %d are %s.', x.n, na.name, y.n, nb.name) AS text
    FROM n x JOIN n y ON y.label > x.label AND y.label - x.label <= 4
    JOIN names na ON na.i = x.label JOIN names nb ON nb.i = y.label) e"""
_PAIR_TEXT = (
    "SELECT true_label, pred_label, n, coalesce(e.text, printf("
    + _q(NO_TEXT) + ", x.name, y.name)) AS explanation FROM ({pairs}) "
    "JOIN names x ON x.i = true_label JOIN names y ON y.i = pred_label "
    "LEFT JOIN " + _TEXTS + " ON least(e.a, e.b) = least(x.name, y.name) "
    "AND greatest(e.a, e.b) = greatest(x.name, y.name)")

_REPORT_LINES = f"""
SELECT 'accuracy' AS section, CAST(line_no AS BIGINT) AS line_no, text FROM (
  SELECT 0 AS line_no, printf('Test accuracy: %.4f (%.2f%%)', acc, acc * 100) AS text
  FROM (SELECT avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc
        FROM nearest)
  UNION ALL SELECT 1, CASE WHEN acc >= 0.80::DOUBLE THEN 'Meets the required accuracy of 0.80.'
         ELSE 'Below the required accuracy of 0.80.' END
  FROM (SELECT avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc
        FROM nearest))
UNION ALL SELECT 'confusion_matrix', t, max(name) || ',' || string_agg(n::VARCHAR, ',' ORDER BY p)
  FROM dense JOIN names ON i = t GROUP BY t
UNION ALL SELECT 'per_class', label, printf('%s precision=%.4f recall=%.4f', name,
    round({_ratio('tp', 'predicted')}, 4), round({_ratio('tp', 'actual')}, 4))
  FROM class_rows JOIN names ON i = label WHERE actual + predicted > 0
UNION ALL SELECT 'confused_pairs', row_number() OVER (
    ORDER BY n DESC, true_label DESC, pred_label DESC) - 1,
    printf('True=%s Predicted=%s count=%d: %s', x2.name, y2.name, n, explanation)
  FROM ({_PAIR_TEXT.format(pairs=_pairs(2))}) JOIN names x2 ON x2.i = true_label
  JOIN names y2 ON y2.i = pred_label"""

_LOGITS = ", ".join("(" + " + ".join(
    f"embedding[{j + 1}]::DOUBLE" for j in range(i, X.DIMENSIONS, X.CLASSES)) + ") * 8"
    for i in range(X.CLASSES))
_PROBS = f"""
raw AS (SELECT vec_id, label, [{_LOGITS}] AS v FROM embeddings),
raised AS (SELECT vec_id, label, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM raw),
probs AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS probs
          FROM raised)"""

# ---- text -------------------------------------------------------------------------------------

_WS = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
_CHUNKS = f"""
pieces AS (
  SELECT doc_id, list_filter(list_transform(
    string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)),
    lambda s: regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')), lambda s: s <> '') AS l
  FROM documents),
chunks AS (
  SELECT doc_id || '__' || (generate_subscripts(l, 1) - 1) AS chunk_id, doc_id AS parent_doc_id,
         unnest(l) AS text FROM pieces)"""


def _slots(source: str, key: str, text: str) -> str:
    return f"""
  SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {X.WIDTH} AS slot, count(*) AS tf
  FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS w
        FROM {source}) WHERE w <> '' GROUP BY 1, 2"""


_INDEX = f"""{_CHUNKS},
chunk_tf AS ({_slots('chunks', 'chunk_id', 'text')}),
idf AS (
  SELECT slot, ln(((SELECT count(*) FROM chunks) + 1)::DOUBLE / (count(*) + 1)) AS w
  FROM chunk_tf GROUP BY slot),
chunk_raw AS (SELECT chunk_id, slot, tf * w AS x FROM chunk_tf JOIN idf USING (slot) WHERE w > 0),
chunk_vec AS (
  SELECT chunk_id, slot, x / sqrt(sum(x * x) OVER (PARTITION BY chunk_id)) AS x FROM chunk_raw)"""


def _search(source: str, key: str, text: str) -> str:
    """Top three chunks for every row of `source`; a chunk without a shared word is no hit."""
    return f"""
query_tf AS ({_slots(source, key, text)}),
query_raw AS (SELECT {key}, slot, tf * w AS x FROM query_tf JOIN idf USING (slot) WHERE w > 0),
query_vec AS (
  SELECT {key}, slot, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM query_raw),
matches AS (
  SELECT q.{key} AS query_id, c.chunk_id, round(sum(q.x * c.x), 6) AS score
  FROM query_vec q JOIN chunk_vec c USING (slot) GROUP BY 1, 2 HAVING round(sum(q.x * c.x), 6) > 0),
found AS (SELECT m.*, c.parent_doc_id, c.text FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM matches) m JOIN chunks c ON c.chunk_id = m.chunk_id WHERE rank <= 3)"""


# ---- conversations ----------------------------------------------------------------------------

def _first(text: str, phrases) -> str:
    return (f"list_extract(list_filter({_list(phrases)}, lambda p: contains(lower({text}), p)), 1)")


_TURNS = f"""
turns AS (
  SELECT conv_id, turn, text AS user_input,
         CASE WHEN role = 'user' AND contains(lower(text), 'an') THEN conv_id * 37 + turn END
           AS order_ref,
         CASE WHEN role = 'user' AND contains(lower(text), 'er')
              THEN (conv_id * 4 + turn)::VARCHAR WHEN role = 'system' THEN '' END AS image_path
  FROM conversations),
flagged AS (
  SELECT *, {_first('user_input', X.INJECTION)} AS matched_pattern,
         CASE WHEN {_first('user_input', X.RISK)} IS NOT NULL THEN 'return_risk'
              WHEN {_first('user_input', X.IMAGE)} IS NOT NULL THEN 'image_classification'
              ELSE 'policy' END AS any_intent FROM turns),
screened AS (
  SELECT *, matched_pattern IS NOT NULL AS blocked,
         CASE WHEN matched_pattern IS NULL THEN any_intent END AS intent,
         CASE WHEN matched_pattern IS NOT NULL THEN 'respond'
              WHEN any_intent = 'policy' THEN 'retrieve' ELSE 'tool' END AS route FROM flagged),
session AS (
  SELECT *, last_value(CASE WHEN intent = 'return_risk' THEN order_ref END IGNORE NULLS)
              OVER w AS session_order,
         last_value(CASE WHEN intent = 'image_classification' THEN nullif(image_path, '') END
              IGNORE NULLS) OVER w AS session_image
  FROM screened WINDOW w AS (PARTITION BY conv_id ORDER BY turn
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
resolved AS (
  SELECT *, CASE WHEN intent = 'return_risk' THEN session_order END AS resolved_order,
         CASE WHEN intent = 'image_classification' THEN session_image END AS resolved_image,
         CASE WHEN intent = 'return_risk' AND session_order IS NULL THEN 'order'
              WHEN intent = 'image_classification' AND session_image IS NULL THEN 'image' END
           AS missing_context FROM session)"""

_CONTEXT = ("SELECT conv_id, turn, session_order, session_image, resolved_order, resolved_image, "
            "missing_context FROM resolved")

_ANSWERS = f"""{_TURNS},{ORDERS},{_PROBS},{_INDEX},
asked AS (SELECT conv_id || ':' || turn AS turn_key, user_input FROM screened
          WHERE route = 'retrieve'),{_search('asked', 'turn_key', 'user_input')},
evidence AS (
  SELECT query_id, max(score) AS top,
         string_agg(CASE WHEN rank <= 2 THEN text END, ' ' ORDER BY rank) AS words,
         round(avg(CASE WHEN rank <= 2 THEN score END), 4) AS mean2 FROM found GROUP BY query_id),
image_classes AS (
  SELECT vec_id::VARCHAR AS image_key,
         {_list(CLASS_NAMES)}[list_position(probs, list_max(probs))] AS name,
         round(list_max(probs), 4) AS c FROM probs),
joined AS (
  SELECT r.*, top, words, mean2, p AS p_raw, {_FOUR} AS p4, name, c
  FROM resolved r LEFT JOIN evidence ON query_id = conv_id || ':' || turn
  LEFT JOIN scored ON order_id = resolved_order
  LEFT JOIN image_classes ON image_key = resolved_image),
answers AS (
  SELECT conv_id, turn, route,
    CASE WHEN intent = 'policy' THEN (coalesce(top, 0) >= 0.35::DOUBLE)::VARCHAR ELSE '-' END AS grounded,
    CASE WHEN blocked THEN {_q(RT.BLOCKED_TEXT)}
         WHEN intent = 'policy' AND coalesce(top, 0) < 0.35::DOUBLE
           THEN printf({_q(RT.REFUSAL_TEXT)}, coalesce(round(top, 4), 0::DOUBLE), 0.35::DOUBLE)
         WHEN intent = 'policy' THEN {_q(RT.POLICY_TEXT[:-2])} || words
         WHEN missing_context = 'order' THEN {_q(RT.NO_ORDER_TEXT)}
         WHEN missing_context = 'image' THEN {_q(RT.NO_IMAGE_TEXT)}
         WHEN intent = 'return_risk' AND p4 IS NOT NULL
           THEN printf({_q(RT.RISK_TEXT)}, printf('%.2f%%', p4 * 100),
                CASE WHEN p_raw < 0.25::DOUBLE THEN 'Low'
                     WHEN p_raw >= 0.25::DOUBLE + 0.15::DOUBLE THEN 'High' ELSE 'Medium' END,
                'Low < 0.25 <= Medium < 0.40 <= High')
         WHEN intent = 'image_classification' AND c IS NOT NULL
           THEN printf({_q(RT.IMAGE_TEXT)}, name, printf('%.2f%%', c * 100))
         ELSE {_q(RT.FALLBACK_TEXT)} END AS answer,
    CASE WHEN blocked OR intent = 'policy' OR missing_context IS NOT NULL THEN 'policy_kb'
         WHEN intent = 'return_risk' AND p4 IS NOT NULL THEN 'return_risk_tool'
         WHEN intent = 'image_classification' AND c IS NOT NULL THEN 'image_classifier_tool'
         ELSE 'policy_kb' END AS source,
    CASE WHEN blocked OR missing_context IS NOT NULL THEN 0.0::DOUBLE
         WHEN intent = 'policy' AND coalesce(top, 0) < 0.35::DOUBLE
           THEN coalesce(round(top, 4), 0::DOUBLE)
         WHEN intent = 'policy' THEN mean2
         WHEN intent = 'return_risk' AND p4 IS NOT NULL THEN p4
         WHEN intent = 'image_classification' AND c IS NOT NULL THEN c
         ELSE 0.0::DOUBLE END AS confidence
  FROM joined)"""

_PRECISION_RECALL = f"""
per_query AS (
  SELECT query_id, CAST(sum(CASE WHEN label = query_class THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         count(DISTINCT item_id) AS n_retrieved,
         max((SELECT count(*) FROM embeddings e WHERE e.label = query_class)) AS n_relevant
  FROM hits GROUP BY query_id),
measured AS (
  SELECT *, round({_ratio('tp', 'n_retrieved')}, 4) AS "precision",
         round({_ratio('tp', 'n_relevant')}, 4) AS recall FROM per_query)"""


def _newton(steps: int = 10) -> str:
    """Newton steps for an intercept and two coefficients, each solved by cofactors."""
    (f1, s1), (f2, s2) = X.NEWTON_SCALES.items()
    out = f"""
points AS (SELECT returned::DOUBLE AS y, coalesce({f1}::DOUBLE, 0) / {s1!r}::DOUBLE AS x1,
                  coalesce({f2}::DOUBLE, 0) / {s2!r}::DOUBLE AS x2,
                  (SELECT count(*) FROM scored)::DOUBLE / (2 * count(*) OVER (PARTITION BY returned)) AS w FROM scored),
b0 AS (SELECT 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c)"""
    for k in range(steps):
        out += f""",
s{k} AS (SELECT max(a) AS a, max(b) AS b, max(c) AS c, sum(w * (p - y)) AS g0, sum(w * (p - y) * x1) + max(b) AS g1,
                sum(w * (p - y) * x2) + max(c) AS g2, sum(v) AS h00, sum(v * x1) AS h01, sum(v * x2) AS h02,
                sum(v * x1 * x1) + 1 AS h11, sum(v * x1 * x2) AS h12, sum(v * x2 * x2) + 1 AS h22
         FROM (SELECT *, w * p * (1 - p) AS v FROM (SELECT *, 1 / (1 + exp(-(a + b * x1 + c * x2))) AS p FROM points, b{k}))),
d{k} AS (SELECT *, h11 * h22 - h12 * h12 AS c00, h02 * h12 - h01 * h22 AS c01, h01 * h12 - h02 * h11 AS c02,
                h00 * h22 - h02 * h02 AS c11, h01 * h02 - h00 * h12 AS c12, h00 * h11 - h01 * h01 AS c22 FROM s{k}),
b{k + 1} AS (SELECT a - (c00 * g0 + c01 * g1 + c02 * g2) / e AS a, b - (c01 * g0 + c11 * g1 + c12 * g2) / e AS b,
                    c - (c02 * g0 + c12 * g1 + c22 * g2) / e AS c
             FROM (SELECT *, h00 * c00 + h01 * c01 + h02 * c02 AS e FROM d{k}))"""
    return out


def oracle_sql() -> dict[str, str]:
    v = f"WITH {_NEIGHBOURS}"
    rate = ("SELECT {g}, round_even(avg(returned::DOUBLE), 4) AS rate, count(*) AS n_rows "
            "FROM scored WHERE {g} IS NOT NULL GROUP BY {g}")
    out = {
        "q_risk_orders": _orders(f"SELECT {COLUMNS} FROM scored"),
        "q_risk_orders_by_lines": _orders(
            "SELECT product_category, count(*) AS n, CAST(sum(line_returned) AS BIGINT) AS hits "
            "FROM scored GROUP BY product_category"),
        "q_delivery_distance": _orders(
            "SELECT l_orderkey AS d_orderkey, km AS delivery_distance_km FROM distance"),
        "q_profile": _orders(
            "SELECT count(*) AS n_rows, 13 AS n_columns, avg(returned::DOUBLE) AS rate, "
            "avg((rating_given IS NULL)::INT::DOUBLE) * 100 AS null_pct FROM scored"),
        "q_rate_by_category": _orders(rate.format(g="product_category")),
        "q_rate_by_payment": _orders(rate.format(g="payment_method")),
        "q_null_share_by_payment": _orders(
            "SELECT payment_method, round_even(avg((rating_given IS NULL)::INT::DOUBLE), 4) "
            "AS null_share FROM scored GROUP BY payment_method"),
        "q_missing_gap": _orders(
            "SELECT a AS share_in, b AS share_out, round((a - b) * 100, 6) AS gap_pp FROM ("
            f"SELECT avg(m) FILTER (payment_method = {_q(X.COD_VALUE)}) AS a, "
            f"avg(m) FILTER (payment_method <> {_q(X.COD_VALUE)}) AS b FROM ("
            "SELECT payment_method, (rating_given IS NULL)::INT::DOUBLE AS m FROM scored))"),
        "q_clip_round_ratio": _orders(
            "SELECT order_id, CASE WHEN discount_pct IS NOT NULL THEN "
            "least(greatest(discount_pct, 2.0::DOUBLE), 7.5::DOUBLE) END AS clipped, "
            "greatest(customer_tenure_days, 30) AS floored, "
            "least(greatest(3, 0), num_previous_orders) AS bounded, "
            "round_even(price_inr, 0) AS rounded, "
            "round(CASE WHEN num_previous_orders > 0 THEN num_previous_returns::DOUBLE "
            "/ num_previous_orders ELSE 0 END, 9) AS ratio, "
            f"CASE WHEN product_category IN ({', '.join(_q(c) for c in X.FIT_CATEGORIES)}) "
            "THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fit FROM scored"),
        "q_logit_score": _orders("SELECT order_id, p, returned FROM scored"),
        "q_customer_history": _orders(
            "SELECT order_id, num_previous_orders, num_previous_returns, customer_tenure_days "
            "FROM scored"),
        "q_row_key": "SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), "
                     "o_orderkey) AS row_key FROM orders",
        "q_shuffle_column": f"""
WITH a AS (SELECT o_orderkey, o_totalprice, row_number() OVER (
             ORDER BY md5(o_orderkey::VARCHAR || ':slot')) AS i FROM orders),
b AS (SELECT o_totalprice AS x, row_number() OVER (
        ORDER BY md5(o_orderkey::VARCHAR || ':{X.SEED}:0')) AS i FROM orders)
SELECT o_orderkey, o_totalprice, x AS shuffled_o_totalprice FROM a JOIN b ON a.i = b.i""",
        "q_split": _orders("SELECT order_id, returned, split FROM parts", _SPLIT),
        "q_split_by_count": _SPLIT_COUNT,
        "q_folds": _orders(
            "SELECT order_id, returned, CAST(((rn - 1) * 5) // size AS INTEGER) AS fold "
            "FROM numbered", _SPLIT),
        "q_prep_stats": _orders(_STATS, _TRAIN),
        "q_prep_categories": _orders(_MODES, _TRAIN),
        "q_prep_apply": _orders(_APPLY, _TRAIN + _MODE_CTE + _STATS_ROW),
        "q_class_weights": _orders(
            "SELECT returned, count(*) AS n, round((SELECT count(*) FROM scored)::DOUBLE / "
            "((SELECT count(DISTINCT returned) FROM scored) * count(*)), 9) AS weight "
            "FROM scored GROUP BY returned"),
        "q_majority_baseline": _orders(
            "SELECT returned AS majority, round(count(*)::DOUBLE / (SELECT count(*) FROM scored), "
            "9) AS share FROM scored GROUP BY returned ORDER BY count(*) DESC, returned LIMIT 1"),
        "q_negative_share": _orders(
            "SELECT round(1 - avg(returned::DOUBLE), 9) AS negative_share FROM scored"),
        "q_confusion_counts": _orders("SELECT * FROM measures", _confusion(X.DECISION)),
        "q_report": f"WITH {ORDERS},{_REPORT}",
        "q_auc": _orders(_auc()),
        "q_auc_by_payment": _orders(_auc("payment_method")),
        "q_threshold_sweep": _orders("SELECT * FROM sweep ORDER BY threshold", _sweep()),
        "q_best_threshold": _orders("SELECT * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1",
                                    _sweep()),
        "q_tradeoff": _orders(
            "SELECT threshold, round((s.recall - m.recall) * 100, 6) AS recall_gain_pp, "
            "round((m.\"precision\" - s.\"precision\") * 100, 6) AS precision_drop_pp "
            "FROM sweep s, measures m ORDER BY s.f1 DESC, threshold LIMIT 1",
            _sweep() + "," + _confusion(X.DECISION)),
        "q_subgroups": _orders("SELECT * FROM subgroups", _SUBGROUPS),
        "q_weakest": _orders(
            "SELECT dimension, value, recall FROM (SELECT *, row_number() OVER (PARTITION BY "
            "dimension ORDER BY recall, value) AS rn FROM subgroups) "
            "WHERE rn = 1 AND dimension <> 'overall'", _SUBGROUPS),
        "q_group_thresholds": _orders(
            "SELECT product_category, threshold, f1, recall, \"precision\" FROM (SELECT *, "
            "row_number() OVER (PARTITION BY product_category ORDER BY f1 DESC, threshold) AS rn "
            "FROM sweep) WHERE rn = 1", _sweep("product_category")),
        "q_risk_bucket": _orders(
            "SELECT order_id, CASE WHEN p < t THEN 'Low' WHEN p >= t + 0.15::DOUBLE THEN 'High' "
            f"ELSE 'Medium' END AS risk_bucket, {_FOUR} AS return_probability, "
            "t AS t_star, printf('Low < %.2f <= Medium < %.2f <= High', t, t + 0.15::DOUBLE) "
            "AS cut_points FROM scored, (SELECT threshold AS t FROM sweep "
            "ORDER BY f1 DESC, threshold LIMIT 1)", _sweep()),
        "q_topk": f"{v} SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM hits",
        "q_approximate_topk": f"{v}, {_HASHED} SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank "
                              "FROM met_hits",
        "q_approximate_recall": f"{v}, {_HASHED} SELECT count(*) AS n_exact, count(m.item_id) AS n_found, "
                                "round(count(m.item_id) / count(*), 6) AS recall "
                                "FROM hits h LEFT JOIN met_hits m USING (query_id, item_id)",
        "q_nn_predict": f"{v} SELECT * FROM nearest",
        "q_confusion_matrix": f"{v} SELECT t AS true_label, " + ", ".join(
            f"CAST(sum(CASE WHEN p = {i} THEN n ELSE 0 END) AS BIGINT) AS p_{i}"
            for i in range(X.CLASSES)) + " FROM dense GROUP BY t",
        "q_confusion_cells": f"{v} SELECT t AS true_label, p AS pred_label, n FROM dense",
        "q_per_class": f"{v} SELECT label, round({_ratio('tp', 'predicted')}, 4) AS \"precision\", "
                       f"round({_ratio('tp', 'actual')}, 4) AS recall FROM class_rows "
                       "WHERE actual + predicted > 0",
        "q_accuracy": f"{v} SELECT a AS accuracy, n AS n_rows, 0.80::DOUBLE AS bar, "
                      "a >= 0.80::DOUBLE AS passed FROM (SELECT avg((label = predicted)::INT"
                      "::DOUBLE) AS a, count(*) AS n FROM nearest)",
        "q_confused_pairs": f"{v} {_pairs(5)}",
        "q_pair_text": f"{v} {_PAIR_TEXT.format(pairs=_pairs(45))}",
        "q_evaluation_report": f"{v} {_REPORT_LINES}",
        "q_softmax_argmax": f"WITH {_PROBS} SELECT vec_id, CAST(list_position(probs, "
                            "list_max(probs)) - 1 AS INTEGER) AS predicted, "
                            f"{_list(CLASS_NAMES)}[list_position(probs, list_max(probs))] "
                            "AS predicted_category, round(list_max(probs), 4) AS confidence, "
                            "round(probs[1], 9) AS p0 FROM probs",
        "q_log_loss": f"WITH {_PROBS} SELECT round(avg(-ln(probs[label + 1])), 9) AS log_loss "
                      "FROM probs",
        "q_affine": "SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round((embedding[i]::DOUBLE - "
                    f"{list(X.CHANNEL_MEAN)}[(i - 1) % 3 + 1]::DOUBLE) / "
                    f"{list(X.CHANNEL_STD)}[(i - 1) % 3 + 1]::DOUBLE, 9) AS x "
                    f"FROM embeddings, range(1, {X.DIMENSIONS + 1}) r(i)",
        "q_normalize_dot": "SELECT vec_id, round(list_cosine_similarity(embedding[1:32]::DOUBLE[], "
                           "embedding[33:64]::DOUBLE[]), 9) AS cosine FROM embeddings",
        "q_sample_per_class": "SELECT min(vec_id) AS vec_id, label, printf('%02d_%s.png', label, "
                              "lower(replace(replace("
                              f"{_list(CLASS_NAMES)}[label + 1], '/', '_'), ' ', '_'))) "
                              "AS file_name FROM embeddings GROUP BY label",
        "q_topk_documents": f"{v} SELECT query_id, item_id // 4 AS parent_doc_id, "
                            "max(score) AS score FROM hits GROUP BY 1, 2",
        "q_grounded": f"{v} SELECT query_id, max(score) >= 0.35::DOUBLE AS grounded, "
                      "round(max(score), 4) AS top_score, 0.35::DOUBLE AS threshold "
                      "FROM hits GROUP BY query_id",
        "q_top2_confidence": f"{v} SELECT query_id, round(avg(score), 4) AS confidence FROM hits "
                             "WHERE rank <= 2 GROUP BY query_id",
        "q_precision_recall": f"{v},{_PRECISION_RECALL} SELECT * FROM measured",
        "q_precision_recall_average": f"{v},{_PRECISION_RECALL} SELECT count(*) AS n_queries, "
                                      "round(avg(\"precision\"), 9) AS \"precision\", "
                                      "round(avg(recall), 9) AS recall FROM measured",
        "q_chunks": f"WITH {_CHUNKS} SELECT * FROM chunks",
        "q_text_topk": f"WITH {_INDEX},{_search('benchmark', 'item_id', 'text')} "
                       "SELECT query_id, chunk_id, parent_doc_id, score, "
                       "CAST(rank AS INTEGER) AS rank FROM found",
        "q_known_item": f"""WITH {_INDEX},
asked AS (SELECT parent_doc_id AS asked_id, text FROM chunks WHERE chunk_id LIKE '%\\_\\_0' ESCAPE '\\'),
{_search('asked', 'asked_id', 'text')},
per_query AS (
  SELECT asked_id AS query_id, CAST(coalesce(sum(DISTINCT CASE WHEN parent_doc_id = asked_id
           THEN 1 ELSE 0 END), 0) AS BIGINT) AS tp,
         count(DISTINCT parent_doc_id) AS n_retrieved, CAST(1 AS BIGINT) AS n_relevant
  FROM asked LEFT JOIN (SELECT query_id AS fq, parent_doc_id FROM found) ON fq = asked_id
  GROUP BY asked_id)
SELECT *, round({_ratio('tp', 'n_retrieved')}, 4) AS "precision", round(tp::DOUBLE, 4) AS recall
FROM per_query""",
        "q_injection": f"WITH {_TURNS} SELECT conv_id, turn, blocked, matched_pattern "
                       "FROM screened",
        "q_intent": f"WITH {_TURNS} SELECT conv_id, turn, any_intent AS intent FROM screened",
        "q_route": f"WITH {_TURNS} SELECT conv_id, turn, blocked, matched_pattern, intent, route "
                   "FROM screened",
        "q_carry_context": f"WITH {_TURNS} {_CONTEXT}",
        "q_carry_events": "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' "
                          "THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY "
                          "event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
                          "AS last_purchase FROM events",
        "q_missing_context": f"WITH {_TURNS} SELECT intent, missing_context, count(*) AS n "
                             "FROM resolved GROUP BY 1, 2",
        "q_answers": f"WITH {_ANSWERS} SELECT * EXCLUDE (grounded) FROM answers",
        "q_transcript": f"WITH {_ANSWERS} SELECT conv_id, turn // 1000 AS part, "
                        "count(*) AS n_turns, string_agg(turn || '|' || source || '|' || printf('%.4f', confidence) "
                        "|| '|' || grounded || '|' || answer, "
                        "chr(10) ORDER BY turn) AS log FROM answers GROUP BY 1, 2",
        "q_stream_rates": """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n,
           avg((value IS NULL)::INT::DOUBLE) AS null_share,
           round(sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / 100 / count(value), 6)
             AS mean_value
         FROM events GROUP BY 1, 2""",
    }
    out["q_orders_csv"] = out["q_risk_orders"]
    out["q_metrics_csv"] = out["q_per_class"]
    out["q_matrix_csv"] = (f"{v} SELECT max(name) AS class, " + ", ".join(
        f"CAST(sum(CASE WHEN p = {i} THEN n ELSE 0 END) AS BIGINT) AS p_{i}" for i in range(X.CLASSES))
        + " FROM dense JOIN names ON i = t GROUP BY t")
    out["q_report_files"] = f"{v} SELECT section, text FROM ({_REPORT_LINES})"
    out["q_inline_names"] = f"{v} SELECT name, count(*) AS n FROM embeddings JOIN names ON i = label GROUP BY name"
    out["q_chunks_json"] = out["q_chunks"]
    out["q_evaluate_retrieval"] = f"""WITH {_INDEX},
first AS (SELECT parent_doc_id, text FROM chunks WHERE chunk_id LIKE '%\\_\\_0' ESCAPE '\\'),
asked AS (SELECT DISTINCT text AS asked_id, text FROM first),
{_search('asked', 'asked_id', 'text')},
wanted AS (SELECT text AS w, count(DISTINCT parent_doc_id) AS n_relevant FROM first GROUP BY text),
got AS (SELECT DISTINCT query_id AS g, parent_doc_id FROM found),
per_query AS (
  SELECT w AS query_id, count(f.parent_doc_id) AS tp, count(g.parent_doc_id) AS n_retrieved, max(n_relevant) AS n_relevant
  FROM wanted LEFT JOIN got g ON g = w
  LEFT JOIN (SELECT DISTINCT parent_doc_id, text FROM first) f ON f.text = w AND f.parent_doc_id = g.parent_doc_id
  GROUP BY w)
SELECT *, round({_ratio('tp', 'n_retrieved')}, 4) AS "precision", round({_ratio('tp', 'n_relevant')}, 4) AS recall
FROM per_query"""
    fixed = f"{_SPLIT},{_FIXED}"
    out["q_permutation_fixed"] = _orders(
        "SELECT feature, round(m, 9) AS perm_importance_mean, round(s, 9) AS perm_importance_std FROM permuted", fixed)
    candidates = ", ".join("(SELECT " + " + ".join(f"coalesce({c}::DOUBLE, 0) * {w!r}::DOUBLE" for c, w in ws.items()) + ")"
                           for ws in X.CANDIDATES)
    out["q_fold_areas_fixed"] = _orders(
        "SELECT position, round(a, 9) AS cv_auc, row_number() OVER (ORDER BY a DESC, position) = 1 AS chosen FROM ("
        "SELECT position, avg(auc) AS a FROM fold_areas GROUP BY position)",
        _SPLIT + f""", long AS (
  SELECT returned AS y, CAST(((rn - 1) * 5) // size AS INTEGER) AS fold,
         CAST(unnest(range({len(X.CANDIDATES)})) AS INTEGER) AS position, unnest([{candidates}]) AS p FROM numbered),
fold_areas AS ({_area('position, fold', 'long')})""")
    names = list(X.NEWTON_SCALES)
    out["q_logistic_newton"] = _orders(
        f"SELECT 'intercept' AS feature, round(a, 6) AS coefficient FROM b10 UNION ALL SELECT {_q(names[0])}, round(b, 6) "
        f"FROM b10 UNION ALL SELECT {_q(names[1])}, round(c, 6) FROM b10", _newton())
    out["q_impurity_fixed"] = _orders(
        "SELECT feature, round(importance::DOUBLE, 9) AS importance, CASE feature " + " ".join(
            f"WHEN {_q(c)} THEN (SELECT avg(({c} IS NULL)::INT::DOUBLE) FROM scored)" for c in X.FIXED_WEIGHTS)
        + " END AS null_share FROM fixed_features", fixed)
    out["q_importance_comparison_fixed"] = _orders(
        "SELECT feature, round(importance::DOUBLE, 9) AS impurity_importance, perm_rank, "
        "round(m, 9) AS perm_importance, low = 1 AS lost_most FROM ("
        "SELECT *, row_number() OVER (ORDER BY m DESC, feature) AS perm_rank FROM permuted) "
        "JOIN (SELECT feature, row_number() OVER (ORDER BY m, feature) AS low FROM ("
        "SELECT * FROM permuted ORDER BY importance DESC, feature LIMIT 3)) USING (feature)", fixed)
    out["q_risk_scores_fixed"] = _orders(
        f"SELECT order_id, {_FOUR} AS return_probability, CASE WHEN p < t THEN 'Low' "
        "WHEN p >= t + 0.15::DOUBLE THEN 'High' ELSE 'Medium' END AS risk_bucket, "
        "printf('Low < %.2f <= Medium < %.2f <= High', t, t + 0.15::DOUBLE) AS cut_points "
        "FROM scored, (SELECT threshold AS t FROM sweep ORDER BY f1 DESC, threshold LIMIT 1)",
        _SPLIT + ", tested AS (SELECT * FROM parts WHERE split = 'test')," + _sweep().replace("FROM scored", "FROM tested"))
    out["q_stream_score_fixed"] = _orders(
        f"SELECT order_id, {_FOUR} AS return_probability, CASE WHEN p < 0.25::DOUBLE THEN 'Low' "
        "WHEN p >= 0.25::DOUBLE + 0.15::DOUBLE THEN 'High' ELSE 'Medium' END AS risk_bucket FROM scored")
    out["q_score_vectors_fixed"] = """
WITH parts AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
cells AS (SELECT label, i, round(avg(x), 6) AS m FROM parts GROUP BY 1, 2),
means AS (SELECT label AS c, list(m ORDER BY i) AS m FROM cells GROUP BY 1),
scores AS (SELECT vec_id, label, c, list_inner_product(embedding::DOUBLE[], m) - 0.5 * list_inner_product(m, m) AS s
           FROM embeddings, means)
SELECT vec_id, label, CAST(arg_max(c, s) AS INTEGER) AS predicted FROM scores GROUP BY 1, 2"""
    out["q_select_artifact_fixed"] = (
        f"{v} SELECT 'finetuned' AS stage, CAST(label AS INTEGER) AS step, metric, 'class-' || label AS path FROM ("
        f"SELECT label, round({_ratio('tp', 'actual')}, 4) AS metric FROM class_rows WHERE actual + predicted > 0 "
        "AND label % 2 = 0) ORDER BY metric DESC, label LIMIT 1")
    out["m_majority"] = (
        f"WITH {ORDERS},{_SPLIT}, majority AS (SELECT returned AS m FROM parts WHERE split = 'train' GROUP BY 1 "
        "ORDER BY count(*) DESC, 1 LIMIT 1), decided AS (SELECT returned AS y, m AS yes FROM parts, majority "
        f"WHERE split = 'test'), {_REPORT_OF}")
    out["m_reload_parity"] = "SELECT count(*) AS n_rows, 0.0::DOUBLE AS max_diff FROM orders"
    out["q_category_slots"] = """
WITH rows AS (SELECT o_orderkey, o_orderpriority AS priority,
                     CASE WHEN o_custkey % 7 <> 0 THEN o_custkey::VARCHAR END AS customer FROM orders),
train AS (SELECT * FROM rows WHERE o_orderkey % 3 <> 0),
a AS (SELECT priority AS v, count(*) AS n, row_number() OVER (ORDER BY priority) - 1 AS slot FROM train
      WHERE priority IS NOT NULL GROUP BY priority),
b AS (SELECT customer AS v, count(*) AS n, row_number() OVER (ORDER BY customer) - 1 AS slot FROM train
      WHERE customer IS NOT NULL GROUP BY customer)
SELECT o_orderkey, a.slot AS priority_slot, b.slot AS customer_slot FROM rows
LEFT JOIN a ON a.v = coalesce(priority, (SELECT v FROM a ORDER BY n DESC, v LIMIT 1))
LEFT JOIN b ON b.v = coalesce(customer, (SELECT v FROM b ORDER BY n DESC, v LIMIT 1))"""
    out["q_stream_screen"] = out["q_route"]
    out["q_stream_carry"] = out["q_carry_context"]
    return out
