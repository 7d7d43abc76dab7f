"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (hosts, jaccard, lines, lm, mix, pack, permutation, quality, repair, runs, spans, token_counts,
               urls)
from .base import GAP, read

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm.lm_score(read(spark, folder, "documents"))


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, folder, "documents"), shingle=3, percent=90)


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = lines.line_dedup(read(spark, folder, "documents"))
    return done.select("doc_id", "text", "n_lines", "n_removed")


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql("VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)).toDF("host", "path", "verdict")
    return urls.url_filter(read(spark, folder, "pages"), rules)


def op5_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mix(read(spark, folder, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op6_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack.pack_documents(read(spark, folder, "documents"), tokenizer_path(), capacity=4096, end_id=1)


def op7_span_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = spans.span_dedup(read(spark, folder, "documents"))
    return done.select("doc_id", "text", "n_sentences", "n_removed", "removed")


def op8_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    done = hosts.host_rules(read(spark, folder, "documents"))
    return done.withColumn("host_rate", F.round("host_rate", 6))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_classifier(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op10_permutation_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    return permutation.permutation_search(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def counting_tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(read(spark, folder, "documents"), counting_tokenizer_path(), limit=512)


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): about a tenth of the documents repeat a stretch of words to their end.

    With h the crc32 of the id (null: of the empty text) and g = h div 10, documents with h mod 10 = 0
    and n > 0 words keep those before a = g mod n and repeat the next 1 + (n - a) div (3 + g mod 8).
    """
    n, g = F.size("words"), F.col("g")
    a = (g % n).cast("int")
    period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / period).cast("int")
    periodic = F.concat(F.slice("words", F.lit(1), a),
                        F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, period), times)), F.lit(1), n - a))
    keyed = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"))
    chosen = keyed.select("doc_id", "text", F.floor(F.col("h") / 10).cast("long").alias("g"), F.when(
        F.col("h") % 10 == 0, F.array_remove(F.split(F.coalesce("text", F.lit("")), GAP), "")).alias("words"))
    return chosen.select("doc_id", F.when(n > 0, F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def op12_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_digests(with_periods(read(spark, folder, "documents")), least=12)


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Rows with `copies`: by crc32 of `conv_id:turn` modulo 20 a row is dropped (0 copies), emptied,
    robbed of its `.!?`, doubled or given to the user. Nulls are one space."""
    space = F.lit(" ")
    lot = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                           F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.coalesce(F.col("text").cast("string"), space)
    return turns.select("conv_id", "turn", lot.alias("lot"), "role", text.alias("text")).select(
        "conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("lot") == 0, 0).when(F.col("lot") == 3, 2).otherwise(1).alias("copies"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_conversations(damaged_turns(read(spark, folder, "conversations")), copies_col="copies")


def queries():
    return {f.__name__: f for f in (
        op1_lm_score, op2_jaccard_join, op3_line_dedup, op4_url_filter, op5_mix, op6_pack, op7_span_dedup,
        op8_host_rules, op9_quality, op10_permutation_search, op11_token_counts, op12_word_runs,
        op13_conversation_repair)}


OP4_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES
    ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
parts AS (
    SELECT row_number() OVER () AS n, page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest),
fits AS (
    SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
           arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM parts p JOIN rules r
      ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)
"""


OP2_SQL = r"""
WITH RECURSIVE lists AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
tokens AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM lists),
windows AS (
    SELECT doc_id, w || ' ' || lead(w, 1) OVER (PARTITION BY doc_id ORDER BY i) || ' '
               || lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM tokens),
shingles AS (
    SELECT DISTINCT doc_id, s FROM windows WHERE s IS NOT NULL
    UNION SELECT doc_id, array_to_string(words, ' ') FROM lists WHERE len(words) BETWEEN 1 AND 2),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (s)
    WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
    SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * c >= 90 * (p.n + q.n - c)),
either AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
    SELECT doc_id, doc_id AS r FROM documents
    UNION SELECT e.y, reached.r FROM reached JOIN either e ON e.x = reached.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY 1) USING (doc_id)
"""

OP8_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
lists AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM docs),
tokens AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM lists),
windows AS (
    SELECT rid, i, w, lead(w, 1) OVER (PARTITION BY rid ORDER BY i) AS w1,
           lead(w, 2) OVER (PARTITION BY rid ORDER BY i) AS w2 FROM tokens),
counted AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w1, w2) AS c FROM windows WHERE w2 IS NOT NULL),
repeated AS (
    SELECT rid, count(DISTINCT i + k) AS n FROM counted, range(3) r(k) WHERE c > 1 GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs),
doubled AS (
    SELECT rid, sum(c - 1) AS n FROM (
        SELECT rid, count(*) AS c FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line)
    GROUP BY rid),
counts AS (
    SELECT l.rid, doc_id, host, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
    FROM lists l LEFT JOIN doubled d USING (rid) LEFT JOIN repeated r USING (rid)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
hosts AS (SELECT host, count(*) AS n_docs, CAST(sum(base_failed::INT) AS BIGINT) AS n_failed FROM failed GROUP BY host),
total AS (
    SELECT sum(n_docs)::DOUBLE AS n, sum(n_failed)::DOUBLE AS f, count(*) AS h,
           sum(n_failed::DOUBLE * n_failed / n_docs) AS ff, sum(n_docs::DOUBLE * n_docs) AS nn FROM hosts),
spread AS (
    SELECT f / n AS m, (f / n) * (1 - f / n) AS within,
           greatest(0.0::DOUBLE, (ff - n * (f / n) * (f / n) - (h - 1) * (f / n) * (1 - f / n))
                    / greatest(n - nn / n, 1e-9)) AS apart FROM total),
prior AS (
    SELECT least(greatest(m, 1e-6), 1 - 1e-6) AS m,
           CASE WHEN apart > 0 THEN least(greatest(within / apart - 1, 1.0::DOUBLE), 10000.0::DOUBLE)
                ELSE 10000.0::DOUBLE END AS strength FROM spread),
rates AS (SELECT h.*, (n_failed + m * strength) / (n_docs + strength) AS rate FROM hosts h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= 0.5 AS kept, f.host, n_docs, n_failed, round(rate, 6) AS host_rate
FROM failed f JOIN rates r ON f.host IS NOT DISTINCT FROM r.host
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": OP2_SQL, "op4_url_filter": OP4_SQL, "op8_host_rules": OP8_SQL}
