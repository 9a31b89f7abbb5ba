"""The corpus pipeline: quality, near-duplicates, benchmark decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept
and is written and read again before the next. Rows whose document id repeats
are one document for the stages that drop by id; a row without an id is kept
by those stages, as it can't be named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomespark.llm import common, decontamination, near_dedup, packing, pii, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, and only they.

    A null or empty text is scored as an empty one, rows that repeat are scored
    each, rows without an id are scored but not learned from, and without any
    positive label all stay. All columns stay as they are.
    """
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Null, empty and blank texts and rows without an id are linked with nothing
    and stay; rows that share the id of a document that goes, go with it. All
    columns stay as they are.
    """
    dropped = near_dedup.near_duplicates(docs, words=5, similarity=0.8).filter(~F.col("kept")).select("doc_id").distinct()
    return common.without(docs, common.written(dropped, "near-duplicates"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, and only they.

    Null and empty texts hold none and stay; so do rows without an id, which
    can't be named; rows that share the id of a document that goes, go with it.
    All columns stay as they are.
    """
    return decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; n_chars, where there is one, counts the new text.

    Every row stays, a null text stays null, and rows that repeat are masked each.
    """
    masked = pii.mask_personal_data(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens.

    A null or empty text is its end id alone; rows that repeat have pieces each.
    """
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the classifier, the tokenizer and the packing; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
