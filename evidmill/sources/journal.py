"""Append-only journals with a hash chain per branch."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS = "0" * 64
SCHEMA = "branch string, seq bigint, tick int, kind string, payload string, previous_hash string, hash string"


def digest(previous: str, branch: str, seq: int, payload: str) -> str:
    return hashlib.sha256(f"{previous}|{branch}|{seq}|{payload}".encode()).hexdigest()


def commit(events: DataFrame) -> DataFrame:
    """Chains the events (branch, seq, tick, kind, payload) of each branch; sequential within a branch, parallel across."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, prev, a, b = pdf.sort_values("seq"), GENESIS, [], []
        for r in pdf.itertuples():
            a.append(prev)
            prev = digest(prev, r.branch, r.seq, r.payload)
            b.append(prev)
        return pdf.assign(previous_hash=a, hash=b)[["branch", "seq", "tick", "kind", "payload", "previous_hash", "hash"]]

    return events.groupBy("branch").applyInPandas(one, SCHEMA)


def verify(journal: DataFrame) -> DataFrame:
    """branch, records, first_bad (seq of the first record whose number, link or hash is wrong), last_payload; parallel, nothing replayed."""
    w = W.partitionBy("branch").orderBy("seq")
    own = F.sha2(F.concat_ws("|", "previous_hash", "branch", F.col("seq").cast("string"), "payload"), 256)
    bad = (F.col("hash") != own) | (F.col("previous_hash") != F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))) | (F.col("seq") != F.coalesce(F.lag("seq").over(w) + 1, F.col("seq")))
    return journal.withColumn("bad", bad).groupBy("branch").agg(F.count("*").alias("records"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("first_bad"), F.max_by("payload", "seq").alias("last_payload"))
