"""Measures of a process up to each cycle that do not add up over cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENDLESS = (1 << 31) - 1


def held_by(merges: DataFrame, depth: int = 64) -> DataFrame:
    """branch, project_id, root, since, until: which project a project counts as from cycle since to before until.

    ``merges`` has branch, project_id, merged_into and cycle, the cycle of the
    merge (both null for a project that is never merged).  A project counts as
    itself, then as what it was merged into from that merge on, and so on along
    the chain; holds of no length are left out.  Longer chains than ``depth`` raise.
    """
    out = merges.sparkSession.sql(
        f"""WITH RECURSIVE held(branch, project_id, root, since, until, next, n) MAX RECURSION LEVEL {depth + 2} AS (
        SELECT branch, project_id, project_id, 0, coalesce(cycle, {ENDLESS}), merged_into, 0 FROM {{merges}} UNION ALL
        SELECT h.branch, h.project_id, m.project_id, h.until, greatest(h.until, coalesce(m.cycle, {ENDLESS})), m.merged_into, h.n + 1 FROM held h JOIN {{merges}} m ON m.branch = h.branch AND m.project_id = h.next WHERE h.n <= {depth})
        SELECT branch, project_id, root, since, until, n FROM held WHERE until > since OR n > {depth}""",
        merges=merges,
    )
    return out.withColumn("root", F.when(F.col("n") > depth, F.raise_error(F.lit("merge chain has a cycle"))).otherwise(F.col("root"))).drop("n")


def _plogp(c: Column) -> Column:
    return F.when(c > 0, c * F.log(c.cast("double"))).otherwise(0.0)


def trajectories(entries: DataFrame, merges: DataFrame, last_cycle: int, value: str = "topic_id") -> DataFrame:
    """branch, cycle: entries, units, distinct values, their entropy, live projects, contributors a project, all up to and with the cycle.

    ``entries`` has branch, cycle (from 0), project_id, agent_id, units and a
    value; rows after last_cycle are left out, null values count as none.  Every
    cycle of a branch with any entry is returned.

    Nothing is computed anew per cycle.  Values: their first cycle adds one to
    the distinct ones, and with c entries so far a value has c ln c in the
    entropy ln N - (sum of c ln c) / N, so a cycle adds differences.  Agents:
    one counts for whatever project its own counts as at a time (held_by()).
    Holds of one root all end when that root is merged, so those of an agent
    make up one interval, from the earliest start: it adds one, and later takes
    one away.  Rows are combined by branch, cycle and value, or by project and
    agent, before any shuffle.
    """
    e = entries.where((F.col("cycle") >= 0) & (F.col("cycle") <= last_cycle))
    dim = ["branch", "cycle"]
    # values
    per = e.groupBy(*dim, value).agg(F.count("*").alias("n"), F.sum("units").alias("units"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("branch", value).orderBy("cycle").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("c0", before).withColumn("known", F.col(value).isNotNull())
    k = F.col("known")
    values = per.groupBy(*dim).agg(
        F.sum("n").alias("entries"), F.sum("units").alias("units"), F.count_if(k & (F.col("c0") == 0)).alias("distinct"), F.coalesce(F.sum(F.when(k, F.col("n"))), F.lit(0)).alias("named"),
        F.coalesce(F.sum(F.when(k, _plogp(F.col("c0") + F.col("n")) - _plogp(F.col("c0")))), F.lit(0.0)).alias("plogp"),
    )
    # contributors
    first = e.where("units > 0").groupBy("branch", "project_id", "agent_id").agg(F.min("cycle").alias("first"))
    held = first.join(held_by(merges), ["branch", "project_id"]).where(F.col("first") < F.col("until"))
    pairs = held.groupBy("branch", "root", "agent_id").agg(F.min(F.greatest("since", "first")).alias("start"), F.max("until").alias("until"))
    roots = pairs.groupBy("branch", "root").agg(F.min("start").alias("start"), F.max("until").alias("until"))

    def changes(rows: DataFrame, name: str) -> DataFrame:
        both = F.explode(F.array(F.struct(F.col("start").alias("cycle"), F.lit(1).alias("by")), F.struct(F.col("until").alias("cycle"), F.lit(-1).alias("by")))).alias("x")
        return rows.select("branch", both).select("branch", "x.*").where(F.col("cycle") <= last_cycle).groupBy(*dim).agg(F.sum("by").alias(name))

    every = values.select("branch").distinct().select("branch", F.explode(F.sequence(F.lit(0), F.lit(last_cycle))).alias("cycle"))
    rows = every.join(values, dim, "left").join(changes(pairs, "pairs"), dim, "left").join(changes(roots, "roots"), dim, "left").na.fill(0)
    w = W.partitionBy("branch").orderBy("cycle").rowsBetween(W.unboundedPreceding, 0)
    s = {c: F.sum(c).over(w) for c in ("entries", "units", "distinct", "named", "plogp", "pairs", "roots")}
    return rows.select(
        *dim, s["entries"].alias("entries"), s["units"].alias("units"), s["distinct"].alias("distinct_values"), F.round(F.when(s["named"] > 0, F.log(s["named"].cast("double")) - s["plogp"] / s["named"]).otherwise(0.0), 6).alias("entropy"),
        s["roots"].alias("live_projects"), F.round(F.coalesce(F.try_divide(s["pairs"], s["roots"]), F.lit(0.0)), 6).alias("mean_contributors"),
    )
