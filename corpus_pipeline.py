"""From raw documents to packed training sequences: five stages, each of them one of the corpus operators.

Every stage reads what the one before kept. All but the last return the columns of ``documents``.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import near_copies, packing, pii, quality_classifier, toxicity
from tideline.llm.common import stash, table

#: Fuzzy groups and a fitted discriminant cannot be stated in SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold. Null and empty texts have the score of no words."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.toxicity_score(F.col("text"), model) < toxicity.THRESHOLD)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the quality threshold; all of them if there are no labels to learn from."""
    model = quality_classifier.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_classifier.quality_score(F.col("text"), model) >= quality_classifier.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, five-word shingles alike to 0.8 or more, the document with the smallest id."""
    return near_copies.one_of_each_group(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, and their new lengths; a null text stays null and so does its length."""
    hidden = docs.withColumn("text", pii.redacted(F.col("text")))
    return hidden.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("personal_data", hide_personal_data), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
