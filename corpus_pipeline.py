"""Corpus pipeline: five filtering stages over `documents`, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateforge.llm import near_dedup, packing, runtime, secrets, suffix_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more, by a model of all labels, go. Null and empty texts score 0 and stay, as do rows without a doc_id."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked from Jaccard 0.80 on stays: the one of the smallest doc_id, once. Rows without a doc_id stay."""
    return near_dedup.drop_near_duplicates(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 200 bytes go, the first stays; a character that a cut divides goes whole.

    A document of which nothing is left goes.
    """
    found = suffix_dedup.strip_repeats(docs, keep_first=True)
    text = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(F.col("kept_text"))
    rest = found.where("size(spans) = 0 or octet_length(kept) > 0").withColumn("new", text)
    return rest.select(*(F.col("new").alias(c) if c == "text" else F.length("new").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each run of secrets, linked parts included, becomes a mark; no document goes."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies: bins of one piece a source and a duplicate cluster."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Trained scores and Arrow kernels have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of documents; an empty table gives none. Every stage's table is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = runtime.materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
