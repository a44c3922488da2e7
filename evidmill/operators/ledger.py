"""Effort accounting over merge chains, flows and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def terminals(merges: DataFrame, depth: int = 64) -> DataFrame:
    """project_id, terminal at the end of each merge chain; a chain longer than ``depth`` is a cycle and raises."""
    out = merges.sparkSession.sql(f"""WITH RECURSIVE chain(project_id, at, n) MAX RECURSION LEVEL {depth + 2} AS (
        SELECT project_id, project_id, 0 FROM {{merges}} UNION ALL
        SELECT c.project_id, m.merged_into, c.n + 1 FROM chain c JOIN {{merges}} m ON m.project_id = c.at WHERE m.merged_into IS NOT NULL AND c.n <= {depth})
        SELECT project_id, max_by(at, n) AS terminal, max(n) AS steps FROM chain GROUP BY project_id""", merges=merges)
    return out.withColumn("terminal", F.when(F.col("steps") > depth, F.raise_error(F.lit("merge chain has a cycle"))).otherwise(F.col("terminal"))).drop("steps")


def effort_by_final_project(ledger: DataFrame, merges: DataFrame) -> DataFrame:
    """terminal, agent_id, units: summed per project first, so the chain table meets few rows."""
    per = ledger.groupBy("project_id", "agent_id").agg(F.sum("units").alias("units"))
    return per.join(terminals(merges), "project_id").groupBy("terminal", "agent_id").agg(F.sum("units").alias("units"))


def credits(ledger: DataFrame, merges: DataFrame) -> DataFrame:
    """terminal, agent_id, credit: share of a positive contributor in the units of a project; a project's credits add to 1."""
    e = effort_by_final_project(ledger, merges).where("units > 0")
    return e.withColumn("credit", F.round(F.col("units") / F.sum("units").over(W.partitionBy("terminal")), 9)).select("terminal", "agent_id", "credit")


def project_flow(ledger: DataFrame, merges: DataFrame) -> DataFrame:
    """status, projects, units, residual of conservation; merged projects by chain, abandoned those whose last action is an error or exit."""
    t = terminals(merges)
    last = ledger.groupBy("project_id").agg(F.max_by("action", F.struct("tick", "entry_id")).alias("last"), F.sum("units").alias("units"))
    status = F.when(F.col("terminal") != F.col("project_id"), "merged").when(F.col("last").isin("error", "exit"), "abandoned").otherwise("completed")
    return last.join(t, "project_id").groupBy(status.alias("status")).agg(F.count("*").alias("projects"), F.sum("units").alias("units"))


def accounting_checks(ledger: DataFrame, merges: DataFrame) -> DataFrame:
    """check, passed: unique entries, conserved projects and units, credits of 1."""
    flow = project_flow(ledger, merges).agg(F.sum("projects").alias("p"), F.sum("units").alias("u"))
    total = ledger.agg(F.countDistinct("project_id").alias("p0"), F.sum("units").alias("u0"), (F.count("*") == F.countDistinct("entry_id")).alias("unique"))
    ones = credits(ledger, merges).groupBy("terminal").agg(F.abs(F.sum("credit") - 1).alias("d")).agg(F.max("d").alias("d"))
    one = flow.crossJoin(total).crossJoin(ones)
    row = lambda name, ok: F.struct(F.lit(name).alias("check"), ok.alias("passed"))
    return one.select(F.explode(F.array(row("unique_entries", F.col("unique")), row("projects_conserved", F.col("p") == F.col("p0")), row("units_conserved", F.col("u") == F.col("u0")), row("credits_one", F.col("d") < 1e-6))).alias("r")).select("r.*")


def entropy(df: DataFrame, group: str, value: str) -> DataFrame:
    """Natural-log Shannon entropy of the values in each group."""
    c = df.groupBy(group, value).agg(F.count("*").alias("c"))
    p = c.withColumn("p", F.col("c") / F.sum("c").over(W.partitionBy(group)))
    return p.groupBy(group).agg(F.round(-F.sum(F.col("p") * F.log("p")), 6).alias("entropy"))


def action_rates(ledger: DataFrame) -> DataFrame:
    """Per project: share of each kind of action, 0 where it never occurs, and effort per 100 entries."""
    g = ledger.groupBy("project_id").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "purchase").alias("a"), F.count_if(F.col("action") == "click").alias("c"), F.sum("units").alias("u"))
    return g.select("project_id", F.round(F.coalesce(F.try_divide(F.col("a"), F.col("a") + F.col("c")), F.lit(0.0)), 6).alias("acceptance_rate"), F.round(100 * F.col("n") / F.when(F.col("u") > 0, F.col("u")), 6).alias("outputs_per_100_effort"))


def trajectory(ledger: DataFrame, ticks: int = 6) -> DataFrame:
    """project_id, cycle, units so far: running sums over cycles of ``ticks`` ticks."""
    c = ledger.groupBy("project_id", F.floor(F.col("tick") / ticks).cast("int").alias("cycle")).agg(F.sum("units").alias("units"))
    w = W.partitionBy("project_id").orderBy("cycle").rowsBetween(W.unboundedPreceding, W.currentRow)
    return c.select("project_id", "cycle", F.sum("units").over(w).alias("units_so_far"))


def successors(ledger: DataFrame) -> DataFrame:
    """project_id, successor: of the members other than the owner (smallest id) the one with most units, then smallest id."""
    m = ledger.groupBy("project_id", "agent_id").agg(F.sum("units").alias("units"))
    w = W.partitionBy("project_id")
    rest = m.withColumn("owner", F.min("agent_id").over(w)).where("agent_id <> owner")
    return rest.groupBy("project_id").agg(F.max_by("agent_id", F.struct("units", -F.col("agent_id"))).alias("successor"))


def budget_breach(ledger: DataFrame, limit: int) -> DataFrame:
    """project_id, breach_entry: the first entry at which the running units exceed the limit; null if none does."""
    w = W.partitionBy("project_id").orderBy("entry_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    r = ledger.withColumn("run", F.sum("units").over(w))
    return r.groupBy("project_id").agg(F.min(F.when(F.col("run") > limit, F.col("entry_id"))).alias("breach_entry"))


def last_actions(ledger: DataFrame, n: int = 12) -> DataFrame:
    """agent_id, memory: kinds of the last n entries, oldest first."""
    w = W.partitionBy("agent_id").orderBy(F.desc("entry_id"))
    r = ledger.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    return r.groupBy("agent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entry_id", "action"))), lambda x: x["action"]), ",").alias("memory"))


def policy_term(novelty: Column, recognition: Column, strength: float = 0.5) -> Column:
    return strength * (F.col("w_novelty") * novelty + F.col("w_recognition") * recognition)
