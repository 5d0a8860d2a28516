"""A corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, SentencePiece ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of documents.

All stages take null texts as empty ones and keep rows without doc_id and rows that share one as rows of their own; an
empty table gives an empty result; columns other than those of documents are left out. An empty ``labels`` or ``benchmark``
rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, line_dedup, pieces, simhash, toxicity
from lodestone.llm.common import materialise
from lodestone.llm.registry import model_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).filter("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in ten or more of them."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, once.

    A row is named by its doc_id and text together. Rows without doc_id give way to those that have one.
    """
    named = docs.withColumn("__row", F.xxhash64("text", "doc_id"))
    groups = simhash.near_duplicates(named.select(F.col("__row").alias("doc_id"), "text"))
    members = groups.select(F.col("doc_id").alias("__row"), "component_id").distinct().join(named.select("__row", "doc_id").distinct(), "__row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    first = members.groupBy("component_id").agg(F.min_by("__row", order).alias("__row")).select("__row")
    return named.join(first, "__row", "left_semi").dropDuplicates(["__row"]).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of the whole text, and whether they decode to it."""
    return pieces.round_trip(docs, pieces.load(model_path(spark)))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: The learned, hashed and latent stages have no SQL; tests hold each, and all in a row, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
