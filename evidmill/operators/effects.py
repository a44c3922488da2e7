"""Paired effects, difference in differences and bootstrap intervals."""

from __future__ import annotations

import hashlib
import json
import math
import random
import statistics

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ["outputs", "effort", "completed", "started"]


def _long(branches: DataFrame) -> DataFrame:
    return branches.select("seed", "policy", "network", F.expr(f"stack({len(METRICS)}, " + ", ".join(f"'{m}', cast({m} as double)" for m in METRICS) + ") AS (metric, value)"))


def paired_differences(branches: DataFrame) -> DataFrame:
    """comparison, stratum, treatment, metric, seed, diff: policies against balanced within networks, open against closed within policies, and their interaction."""
    v = _long(branches)
    base = v.where("policy = 'balanced'").select("seed", "network", "metric", F.col("value").alias("control"))
    policy = v.where("policy <> 'balanced'").join(base, ["seed", "network", "metric"]).select(F.lit("policy").alias("comparison"), F.col("network").alias("stratum"), F.col("policy").alias("treatment"), "metric", "seed", (F.col("value") - F.col("control")).alias("diff"))
    closed = v.where("network = 'closed'").select("seed", "policy", "metric", F.col("value").alias("control"))
    network = v.where("network = 'open'").join(closed, ["seed", "policy", "metric"]).select(F.lit("network").alias("comparison"), F.col("policy").alias("stratum"), F.lit("open").alias("treatment"), "metric", "seed", (F.col("value") - F.col("control")).alias("diff"))
    return policy.union(network).union(did(policy))


def did(policy: DataFrame) -> DataFrame:
    """(treatment - balanced) in the open network minus the same in the closed one; seeds with all four cells only."""
    both = policy.groupBy("treatment", "metric", "seed").pivot("stratum", ["open", "closed"]).agg(F.first("diff")).where("open is not null and closed is not null")
    return both.select(F.lit("policy_x_network").alias("comparison"), F.lit("difference_in_differences").alias("stratum"), "treatment", "metric", "seed", (F.col("open") - F.col("closed")).alias("diff"))


def effects(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("comparison", "stratum", "treatment", "metric").agg(F.count("*").alias("n_pairs"), F.round(F.avg("diff"), 6).alias("mean_difference"))


def arithmetic_bootstrap(diffs: DataFrame, replicates: int = 200) -> DataFrame:
    """Percentile interval of the mean over replicates whose draws follow from arithmetic, so any engine repeats them."""
    keys = ["comparison", "stratum", "treatment", "metric"]
    g = diffs.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("seed", "diff"))), lambda x: x["diff"]).alias("d"))
    n = F.size("d")
    mean = lambda rep: F.round(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, p: a + F.get("d", ((rep * 7919 + p * 104729) % n).cast("int"))) / n, 6)
    means = F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), mean))
    lo, hi = max(0, math.floor(0.025 * replicates) - 1), min(replicates - 1, math.ceil(0.975 * replicates) - 1)
    return g.select(*keys, n.cast("bigint").alias("n_pairs"), F.get(means, F.lit(lo)).alias("ci_low"), F.get(means, F.lit(hi)).alias("ci_high"))


def keyed_random(seed: int, *keys: object) -> random.Random:
    """Generator seeded by the first 16 hexadecimal digits of the SHA-256 of the keys as JSON."""
    text = json.dumps([seed, *keys], ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return random.Random(int(hashlib.sha256(text.encode()).hexdigest()[:16], 16))


COLUMNS = ["comparison", "stratum", "treatment", "metric", "n_pairs", "ci_low", "ci_high", "status"]


def bootstrap(diffs: DataFrame, seed: int = 202, replicates: int = 2000, seeds: list[int] | None = None) -> DataFrame:
    """Percentile interval of the mean difference of each effect, and status: complete or incomplete.

    With ``seeds``, the seeds of the experiment, an effect is complete only if
    it has one known difference for each of them and no other; an incomplete
    one keeps its count but gets no interval, so that no part passes for the
    whole.  Fewer than two values have no interval either.  The resampling
    generator is keyed by the effect, whose differences (one a seed) are one task's.
    """
    wanted = None if seeds is None else sorted(seeds)

    def interval(key: tuple, values: list[float]) -> tuple[float, float]:
        source = keyed_random(seed, *map(str, key))
        means = sorted(statistics.mean(source.choices(values, k=len(values))) for _ in range(replicates))
        low, high = max(0, math.floor(0.025 * replicates) - 1), min(replicates - 1, math.ceil(0.975 * replicates) - 1)
        return means[low], means[high]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf.dropna(subset=["diff"]).sort_values("seed")
        whole = wanted is None or known["seed"].tolist() == wanted
        ends = interval(key, known["diff"].tolist()) if whole and len(known) > 1 else (None, None)
        return pd.DataFrame([[*key, len(known), *ends, "complete" if whole else "incomplete"]], columns=COLUMNS).astype({"ci_low": "float64", "ci_high": "float64"})

    return diffs.groupBy("comparison", "stratum", "treatment", "metric").applyInPandas(one, "comparison string, stratum string, treatment string, metric string, n_pairs bigint, ci_low double, ci_high double, status string")


def flow_decomposition(branches: DataFrame) -> DataFrame:
    """Change of completed against balanced, split into the change of starts and the rest; the parts add up."""
    b = branches.where("policy = 'balanced'").select("seed", "network", F.col("started").alias("s0"), F.col("completed").alias("c0"))
    j = branches.where("policy <> 'balanced'").join(b, ["seed", "network"])
    delta, starts = F.col("completed") - F.col("c0"), F.col("started") - F.col("s0")
    return j.select("seed", "network", "policy", delta.alias("delta_completed"), starts.alias("delta_started"), (delta - starts).alias("delta_rest"))
