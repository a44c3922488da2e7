"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage gets what the one before kept, applies one operator of evidmill.llm
to all of it, and its decisions take effect.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidmill.llm import ngram_join, packing, pii, quality_rules, weak_classifier
from evidmill.llm.common import table, written


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the newest policy over the rule ledger."""
    return quality_rules.ledger(docs).where(quality_rules.passes("v2")).select(*docs.columns)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer fitted on weak labels keeps."""
    return weak_classifier.classify(docs).where("kept").select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join."""
    return ngram_join.jaccard_classes(docs).where("kept").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    found = pii.spans(docs, into="__pii").withColumn("text", pii.redacted(F.col("text"), F.col("__pii"))).drop("__pii")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier is fitted by iteration and the packing is sequential: SQL expresses neither; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
