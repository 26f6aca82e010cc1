"""Corpus cleaning: five stages, each one operator over all rows that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again for the next one. All but
the last return the columns of documents; the last gives a row for each document left, with its tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm import bpe, decontaminate, line_dedup, near_copies, toxicity
from tidebars.llm.common import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of at least a half go."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, scorer, out_col="_score").where("_score < 0.5").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, or nearly repeat, an earlier one are cut out; every document stays."""
    out = line_dedup.without_repeats(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of 5-word shingles at least 0.8) one row stays, that with the smallest id;
    a row without an id stays only if no row of its group has one and no other such row comes first."""
    return near_copies.one_of_each(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go."""
    found = decontaminate.contained(docs, table(spark, sf_dir, "benchmark"), keep=("lang", "source", "n_chars", "text"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text that they decode to."""
    return bpe.encode(docs, keep=("text", "lang", "source", "n_chars"), full=True)


STAGES = [("toxicity", drop_toxic), ("lines", dedup_lines), ("near_copies", drop_near_copies), ("decontaminate", drop_contaminated), ("encode", encode)]

#: Scores, fingerprints and tokens can't be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
