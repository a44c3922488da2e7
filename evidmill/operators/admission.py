"""Admission of reservations to budgets with several limits at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOTALS = ["logical", "attempts", "input_tokens", "output_tokens"]
#: Reasons of refusal, in the order in which limits are looked at.
REASONS = ["no_limits", "walltime", "calls", "input_tokens", "output_tokens", "cost"]
LIMITS = "max_logical bigint, max_attempts bigint, max_input bigint, max_output bigint, walltime double"
OUT = "seq bigint, accepted boolean, reason string, logical bigint, attempts bigint, input_tokens bigint, output_tokens bigint, cost bigint"


class Budget:
    """The totals of one ledger, and what a reservation does to them."""

    def __init__(self, limits: tuple | None, costs_most: dict | None, totals: list[int], costs: dict[str, int]) -> None:
        self.limits, self.most, self.totals, self.costs = limits, costs_most or {}, totals, costs

    def reserve(self, http: bool, tokens_in: int, tokens_out: int, currency: str | None, cost: int, elapsed: float | None) -> str | None:
        """None if the reservation fits all limits and was added to all totals; else the reason, and nothing was added."""
        if self.limits is None:
            return "no_limits"
        logical, attempts, tin, tout, wall = self.limits
        if wall is not None and elapsed is not None and elapsed > wall:
            return "walltime"
        now = [self.totals[0] + (not http), self.totals[1] + http, self.totals[2] + tokens_in, self.totals[3] + tokens_out]
        if now[0] > logical or now[1] > attempts:
            return "calls"
        if now[2] > tin:
            return "input_tokens"
        if now[3] > tout:
            return "output_tokens"
        if currency:
            total = self.costs.get(currency, 0) + cost
            if currency not in self.most or total > self.most[currency]:
                return "cost"
            self.costs[currency] = total
        self.totals = now
        return None


def admitted(requests: DataFrame, limits: DataFrame, saved: DataFrame | None = None, ledger: str = "ledger_id") -> DataFrame:
    """Each reservation with accepted, reason and the ledger's totals after it: ledger_id, seq, ...

    ``requests`` has the ledger, seq, http (else a logical call), input_tokens,
    output_tokens, currency, cost (a long, in the currency's smallest unit) and
    elapsed (seconds since the ledger began); ``limits`` a row per ledger with
    max_logical, max_attempts, max_input, max_output, walltime (null: none) and
    costs, a map of currency to limit: a currency that isn't there is refused.
    ``saved`` holds totals to go on from: the ledger, TOTALS and spent (a map).
    cost is that of the request's currency so far, null without one.

    A refused reservation adds nothing to any total, so whether one fits depends
    on all before it and no prefix sum tells: a ledger's rows pass one task in
    order of seq, sorted by Spark outside memory, batch by batch, and a state of
    a few numbers is carried on.  Rows of one seq go by their other columns.
    Null tokens and costs are 0, a null http is false, a null elapsed is within
    any walltime; null ledgers are a ledger.  One without limits refuses all.
    """
    kind = requests.schema[ledger].dataType
    part = requests.select(F.col(ledger).alias("l"), F.lit(1).alias("part"), F.col("seq").cast("bigint").alias("seq"), F.coalesce("http", F.lit(False)).alias("http"), *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cost")], "currency", F.col("elapsed").cast("double").alias("elapsed"))
    heads = limits.select(F.col(ledger).alias("l"), F.lit(0).alias("part"), F.struct(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in LIMITS.split(", ")]).alias("most"), F.map_entries("costs").alias("costs"))
    if saved is not None:
        old = saved.select(F.col(ledger).alias("sl"), F.struct(*[F.col(c).cast("bigint").alias(c) for c in TOTALS]).alias("totals"), F.map_entries("spent").alias("spent"))
        heads = heads.join(old, F.col("l").eqNullSafe(F.col("sl")), "left").drop("sl")
    stream = part.unionByName(heads, allowMissingColumns=True)
    for c, t in (("totals", "struct<" + ",".join(f"{c}:bigint" for c in TOTALS) + ">"), ("spent", "array<struct<key:string,value:bigint>>")):
        if c not in stream.columns:
            stream = stream.withColumn(c, F.lit(None).cast(t))
    order = ["seq", "http", "input_tokens", "output_tokens", "currency", "cost", "elapsed"]
    stream = stream.select("l", "part", *order, "most", "costs", "totals", "spent").repartition("l").sortWithinPartitions("l", "part", *order)
    pairs = lambda entries: {e["key"]: e["value"] for e in entries or ()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, budget = None, None
        for batch in batches:
            out: list[tuple] = []
            for l, part, seq, http, tin, tout, currency, cost, elapsed, most, costs, totals, spent in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: E741
                if budget is None or l != key:
                    key, budget = l, Budget(None, None, [0] * 4, {})
                if part == 0:
                    budget = Budget(tuple(most.values()), pairs(costs), list(totals.values()) if totals else [0] * 4, pairs(spent))
                    continue
                why = budget.reserve(http, tin, tout, currency, cost, elapsed)
                out.append((l, seq, why is None, why, *budget.totals, budget.costs.get(currency, 0) if currency else None))
            columns = list(zip(*out, strict=True)) or [()] * 9
            kinds = [batch.schema.field(0).type, pa.int64(), pa.bool_(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["l", "seq", "accepted", "reason", *TOTALS, "cost"])

    return stream.mapInArrow(run, f"l {kind.simpleString()}, {OUT}").withColumnRenamed("l", ledger)
