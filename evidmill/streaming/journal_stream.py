"""Verification of a journal as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from evidmill.sources.journal import GENESIS, SCHEMA, digest

VERDICT = "branch string, records bigint, first_bad bigint"
STATE = "previous string, next bigint, records bigint, first_bad bigint"


def verified(journal: DataFrame) -> DataFrame:
    """Streaming verdicts per branch and trigger; state is the last hash, the next number and the first fault.

    Records of a trigger are taken in order of seq; a file source with one file
    per tick keeps the order across triggers.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        prev, nxt, n, bad = state.get if state.exists else (GENESIS, -1, 0, -1)
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            ok = r.previous_hash == prev and r.hash == digest(prev, r.branch, r.seq, r.payload) and nxt in (-1, r.seq)
            bad = int(r.seq) if bad < 0 and not ok else bad
            prev, nxt, n = r.hash, int(r.seq) + 1, n + 1
        state.update((prev, nxt, n, bad))
        yield pd.DataFrame({"branch": [key[0]], "records": [n], "first_bad": [None if bad < 0 else bad]}).astype({"first_bad": "Int64"})

    return journal.groupBy("branch").applyInPandasWithState(step, VERDICT, STATE, "update", "NoTimeout")


def stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)
