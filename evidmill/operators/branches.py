"""The measures of a branch of a process at its end: flows, effort, teams, texts, topics, invitations and exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidmill.operators.checks import text_diversity
from evidmill.operators.trajectories import ENDLESS, held_by

MEASURES = (
    "candidate_ideas_generated drafts_created projects_started projects_merged projects_abandoned projects_completed projects_censored final_outputs solo_outputs team_outputs total_effort_units outputs_per_100_effort "
    "team_size_discounted_outputs mean_contributors_per_output mean_active_team_size_at_completion lexical_novelty_proxy community_attention_proxy text_diversity selected_topic_entropy reading_topic_entropy "
    "invitation_acceptance_rate invitation_conflict_rate candidate_shortfall_rate exit_rate cross_field_output_rate current_cross_field_rate mean_simulated_reputation"
).split()
SHORT = 3


def _facts(df: DataFrame, fact: str, key: Column, n: Column | int = 1, v: Column | int = 0) -> DataFrame:
    as_col = lambda x, t: (F.lit(x) if isinstance(x, int) else x).cast(t)
    return df.select("branch", F.lit(fact).alias("fact"), key.cast("string").alias("key"), as_col(n, "bigint").alias("n"), as_col(v, "double").alias("v"))


def outputs(projects: DataFrame, effort: DataFrame, agents: DataFrame, start_cycle: int) -> DataFrame:
    """Completed projects begun from start_cycle on, with contributors, their fields and those of the members at completion.

    Effort from start_cycle on counts for what its project was merged into, as
    things stand at the branch's end; who gave none in sum is no contributor.
    """
    # as of the end only the last hold of a project matters
    last = held_by(projects.select("branch", "project_id", "merged_into", F.when(F.col("merged_into").isNotNull(), 0).alias("cycle"))).where(F.col("until") == ENDLESS)
    per = effort.where(F.col("cycle") >= start_cycle).groupBy("branch", "project_id", "agent_id").agg(F.sum("units").alias("units"))
    per = per.join(last.select("branch", "project_id", "root"), ["branch", "project_id"]).groupBy("branch", "root", "agent_id").agg(F.sum("units").alias("units")).where("units > 0")
    of = agents.select("branch", "agent_id", "field")
    teams = per.join(of, ["branch", "agent_id"], "left").groupBy("branch", F.col("root").alias("project_id")).agg(F.count("*").alias("contributors"), F.count_distinct("field").alias("fields"))
    done = projects.where((F.col("status") == "completed") & (F.col("created_cycle") >= start_cycle))
    members = done.select("branch", "project_id", F.explode("members").alias("agent_id")).join(of, ["branch", "agent_id"], "left").groupBy("branch", "project_id").agg(F.count_distinct("field").alias("member_fields"))
    out = done.join(teams, ["branch", "project_id"], "left").join(members, ["branch", "project_id"], "left")
    return out.select("branch", "project_id", "words", "novelty", "attention", F.greatest(F.size("members"), F.lit(0)).alias("team"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("contributors", "fields", "member_fields")])


def measures(drafts: DataFrame, projects: DataFrame, effort: DataFrame, invitations: DataFrame, audits: DataFrame, agents: DataFrame, reads: DataFrame, start_cycle: int) -> DataFrame:
    """One row per branch that has agents, with the 27 MEASURES.

    Inputs have branch and: drafts cycle, candidate_count, topic_id; projects
    project_id, status (merged, abandoned, completed, active, censored),
    created_cycle, merged_into, members (agents at completion), novelty, attention, words (of
    its card, without repeats); effort cycle, project_id, agent_id, units; invitations cycle,
    target, status; audits cycle, stage (invitation or exit), offered_count,
    selected_action; agents agent_id, field, reputation; reads topic_id.
    All but agents, reads and the merge chains count from start_cycle on.

    A rate or mean over nothing is 0, outputs_per_100_effort null.  Facts of all
    kinds go through one tree of two aggregations, by key (topic, target, ...)
    and by branch, combined before each shuffle: entropies need the counts of
    topics, conflicts the loads of targets.
    """
    late = lambda df, c="cycle": df.where(F.col(c) >= start_cycle)
    of = F.col
    facts = [
        _facts(late(drafts), "draft", of("topic_id"), 1, of("candidate_count")),
        _facts(reads, "read", of("topic_id")),
        _facts(late(projects, "created_cycle"), "project", of("status")),
        _facts(late(effort), "effort", F.lit(None), 1, of("units")),
        _facts(late(invitations), "invite", of("target"), 1, (of("status") == "accepted").cast("int")),
        _facts(late(audits).where("stage = 'invitation' and offered_count is not null"), "short", F.lit(None), 1, (of("offered_count") < SHORT).cast("int")),
        _facts(late(audits).where("stage = 'exit'"), "exit", F.lit(None), 1, (of("selected_action") == "exit").cast("int")),
        _facts(agents, "agent", F.lit(None), 1, of("reputation")),
    ]
    every = facts[0]
    for f in facts[1:]:
        every = every.unionByName(f)
    by_key = every.groupBy("branch", "fact", "key").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    pick = lambda fact, c, key=None: F.coalesce(F.sum(F.when((of("fact") == fact) & (F.lit(True) if key is None else of("key").isin(key)), c)), F.lit(0))
    sums = {f"n_{f}": pick(f, of("n")) for f in ("draft", "read", "project", "invite", "short", "exit", "agent")} | {f"v_{f}": pick(f, of("v")) for f in ("draft", "effort", "invite", "short", "exit", "agent")}
    sums |= {f"s_{s}": pick("project", of("n"), [s]) for s in ("merged", "abandoned", "completed")} | {"s_open": pick("project", of("n"), ["active", "censored"])}
    sums |= {f"h_{f}": pick(f, of("n") * F.log(of("n").cast("double"))) for f in ("draft", "read")}
    sums |= {"targets": F.count_if(of("fact") == "invite"), "loaded": F.count_if((of("fact") == "invite") & (of("n") > 1))}
    flat = by_key.groupBy("branch").agg(*[c.alias(n) for n, c in sums.items()])
    done = outputs(projects, effort, agents, start_cycle)
    c = of("contributors")
    teams = done.groupBy("branch").agg(
        F.count("*").alias("outputs"), F.count_if(c == 1).alias("solo"), F.count_if(c >= 2).alias("team"), F.sum(F.when(c > 0, 1 / c).otherwise(0.0)).alias("discounted"), F.avg(c).alias("contributors"), F.avg("team").alias("active"),
        F.avg("novelty").alias("novelty"), F.avg("attention").alias("attention"), F.avg((of("fields") > 1).cast("int")).alias("crossed"), F.avg((of("member_fields") > 1).cast("int")).alias("current"),
    )
    texts = text_diversity(done.select("branch", F.col("project_id").alias("id"), F.col("words").alias("w")), "branch")
    x = agents.select("branch").distinct().join(flat, "branch").join(teams.withColumnRenamed("team", "teams"), "branch", "left").join(texts, "branch", "left")
    r = lambda v: F.round(v, 6)
    rate = lambda n, d: r(F.coalesce(F.try_divide(of(n), of(d)), F.lit(0.0)))
    zero = lambda name, t="double": F.coalesce(of(name).cast(t), F.lit(0).cast(t))
    entropy = lambda n, h: r(F.when(of(n) > 0, F.log(of(n).cast("double")) - of(h) / of(n)).otherwise(0.0))
    values = [
        of("v_draft").cast("bigint"), of("n_draft"), of("n_project"), of("s_merged"), of("s_abandoned"), of("s_completed"), of("s_open"), zero("outputs", "bigint"), zero("solo", "bigint"), zero("teams", "bigint"),
        r(of("v_effort")), r(F.try_divide(100 * zero("outputs"), F.when(of("v_effort") != 0, of("v_effort")))), r(zero("discounted")), r(zero("contributors")), r(zero("active")), r(zero("novelty")), r(zero("attention")), r(zero("diversity")),
        entropy("n_draft", "h_draft"), entropy("n_read", "h_read"), rate("v_invite", "n_invite"), rate("loaded", "targets"), rate("v_short", "n_short"), rate("v_exit", "n_exit"), r(zero("crossed")), r(zero("current")), rate("v_agent", "n_agent"),
    ]
    return x.select("branch", *[v.alias(m) for v, m in zip(values, MEASURES, strict=True)])
