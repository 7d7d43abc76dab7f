"""Quality rules by host: failures per host, rates shrunk by a beta prior, verdicts joined back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .base import mix, owner, row_sums, seen_before, slices, stored, words

RULE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, counted by text."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    flat = lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    worded = pc.match_substring_regex(flat.dictionary, r"[^\x20\x09-\x0D]") \
        .to_numpy(zero_copy_only=False)
    later, _ = seen_before(owner(offsets) * np.int64(len(flat.dictionary)) + codes)
    return row_sums((later & worded[codes]).astype(np.int64), offsets)


def _repeated(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words inside 3-word windows that occur at least twice in their text, counted by text."""
    doc = owner(offsets)
    cover = np.zeros(len(codes), bool)
    if len(codes) > 2:
        whole = doc[2:] == doc[:-2]
        at = np.flatnonzero(whole)
        _, twice = seen_before(mix(doc[at], codes[at], codes[at + 1], codes[at + 2]))
        hit = at[twice]
        for step in range(3):
            cover[hit + step] = True
    return row_sums(cover.astype(np.int64), offsets)


def _measure(batches):
    for batch in slices(batches, "text"):
        text = batch.column("text")
        codes, offsets, values = words(text, lower=False)
        chars = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        symbols = pc.fill_null(pc.count_substring_regex(text, r"[#*$%&|<>]"), 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("host"),
             pa.array(np.diff(offsets)), pa.array(row_sums(chars[codes], offsets)),
             symbols.cast(pa.int64()), pa.array(_lines(text)), pa.array(_repeated(codes, offsets))],
            names=["doc_id", "host", *RULE_COLUMNS])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            host_col: str = "source") -> DataFrame:
    """The counts that the rules look at, one row per document: nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(host_col).cast("string").alias("host"))
    fields = ", ".join(f"{c} long" for c in RULE_COLUMNS)
    return rows.mapInArrow(_measure, f"doc_id {kind}, host string, {fields}")


def base_failed(min_words: int = 50, max_repeat_percent: int = 50):
    return (F.col("n_words") < min_words) | \
        (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_rates(measured: DataFrame) -> DataFrame:
    """Per host: documents, failures and the failure rate shrunk towards the mean of all hosts.

    The beta prior is fitted by moments over the hosts' rates: its strength is m(1-m)/v - 1, where m
    is the overall rate and v the between-host variance left after taking off the sampling variance.
    Hosts that do not differ beyond sampling noise get a strong prior (10,000 documents at most),
    and a host of few documents never gets far from m.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"),
                                         F.sum(F.col("failed").cast("long")).alias("n_failed"))
    hosts = stored(hosts, "hosts")
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"),
                      F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("ff"),
                      F.count("*").alias("h"),
                      F.sum(F.col("n_docs") * F.col("n_docs").cast("double")).alias("nn")).first()
    mean, strength = 0.0, 10_000.0
    if total["n"]:
        n, h = float(total["n"]), total["h"]
        mean = total["f"] / n
        within = mean * (1 - mean)
        spread = total["ff"] - n * mean * mean          # sum of n_h (rate_h - mean)^2
        between = max(0.0, (spread - (h - 1) * within) / max(n - total["nn"] / n, 1e-9))
        if between > 0:
            strength = float(np.clip(within / between - 1, 1.0, 10_000.0))
    # a prior that is neither certain of failure nor of success
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return hosts.select(
        "host", "n_docs", "n_failed",
        ((F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)).alias("host_rate"))


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               host_col: str = "source", max_host_rate: float = 0.5, **rules) -> DataFrame:
    """Rule counts, `base_failed`, the host's shrunk failure rate and `kept`, one row per input row.

    A document is kept if it passes the rules itself and its host's shrunk rate does not exceed
    `max_host_rate`: by default a host falls only when most of its documents fail. Failures are
    counted before the shuffle, so a host with a third of all documents sends one row per task.

    Defined cases: null text is empty (0 words, fails); null hosts form one host of their own; rows
    with equal or null ids are separate rows; an empty table gives an empty result; other columns
    are not read.
    """
    measured = stored(measure(docs, id_col, text_col, host_col)
                      .withColumn("failed", base_failed(**rules)), "rules")
    rates = host_rates(measured)
    joined = measured.alias("d").join(rates.alias("h"), F.expr("d.host <=> h.host"), "left")
    return joined.select(
        "d.doc_id", *RULE_COLUMNS, F.col("failed").alias("base_failed"),
        (~F.col("failed") & (F.col("host_rate") <= max_host_rate)).alias("kept"),
        F.col("d.host").alias("host"), "n_docs", "n_failed", "host_rate")
