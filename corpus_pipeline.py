"""Raw documents to packed training sequences in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.llm import jaccard, lines, mix, pack, quality
from orderlens.llm.base import n_words, read, stored
from orderlens.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.quality_filter(docs, read(spark, sf_dir, "labels"))


def with_row_key(docs: DataFrame) -> DataFrame:
    """Adds `row_key`, a number per row. Stages read written tables, whose rows keep it on every reading."""
    return docs.withColumn("row_key", F.monotonically_increasing_id())


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated line chunks are cut out, the row with the smallest id keeps them; a document of which no
    word is left goes. Rows that share an id, or have none, are documents of their own."""
    keyed = with_row_key(docs).withColumn("row_key", F.struct("doc_id", "row_key"))
    done = lines.line_dedup(keyed, id_col="row_key")
    done = done.filter((F.col("n_removed") == 0) | (n_words(F.col("text")) > 0))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) one row stays: the smallest id, null last."""
    keyed = with_row_key(docs)
    found = jaccard.jaccard_components(keyed, id_col="row_key", shingle=5, percent=80)
    groups = found.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1").select("component_id")
    members = stored(found.join(groups, "component_id").select(F.col("doc_id").alias("row_key"), "component_id"), "copies")
    named = keyed.select("row_key", "doc_id").join(members, "row_key")
    first = F.min_by("row_key", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    stays = named.groupBy("component_id").agg(first.alias("row_key")).select("row_key")
    gone = members.join(stays, "row_key", "left_anti").select("row_key")
    return keyed.join(gone, "row_key", "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document may come twice."""
    return mix.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens in sequences of at most 4096."""
    return pack.pack_documents(docs, tokenizer_path(), capacity=4096, end_id=1)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage),
          ("mix", mix_stage), ("pack", pack_stage)]

ORACLE_SQL = None  # neither the classifier nor the packing can be put in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between stages the documents are written and read back."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
