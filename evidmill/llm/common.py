"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidmill.operators.graph import connected_components, discard, shared_dir, written

__all__ = ["WORD", "connected_components", "discard", "shared_dir", "table", "tokenizer_path", "words", "written"]

#: ASCII white space; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != F.lit(""))
