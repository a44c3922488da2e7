"""Evaluation by (query, document) judgements."""

import pytest
from pyspark.sql import functions as F

from evidmill.operators import audits, evaluate, judged

RUN = [(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 2)]


@pytest.fixture()
def qrels(spark):
    return spark.createDataFrame([(1, "a", 2), (1, "b", 0), (2, "a", 0), (2, "b", 2)], "query_id int, id string, grade int")


def test_older_operators_take_grades_by_query(spark, qrels):
    run = spark.createDataFrame(RUN, "query_id int, id string, rank int")
    got = {r["query_id"]: r for r in evaluate.ranked_metrics(run, qrels, 2).collect()}
    assert [(got[q]["returned"], got[q]["precision_at_k"], got[q]["recall"]) for q in (1, 2)] == [(2, 0.5, 1.0)] * 2
    assert got[1]["ndcg"] == 1 and got[2]["ndcg"] == round(1 / 1.584962500721156, 6)
    fam = spark.createDataFrame([("a", "f"), ("b", "g")], "id string, family string")
    assert {(r["query_id"], r["family_recall"], r["document_precision"]) for r in evaluate.selection_metrics(run, qrels, fam, 1).collect()} == {(1, 1.0, 1.0), (2, 0.0, 0.0)}
    rec = {(r["query_id"], r["k"]): r["recall"] for r in evaluate.candidate_recall(run, qrels, spark.createDataFrame([("a",)], "id string"), ks=(1,)).where("grade_rule = 2").collect()}
    assert rec == {(1, "1"): 1.0, (2, "1"): 0.0, (1, "all"): 1.0, (2, "all"): 0.0}
    top = evaluate.cutoffs(run.withColumn("topic_id", F.lit("t")), qrels, (1,)).where("topic_id = 't'").first()
    assert (top["n_queries"], top["mean_precision"]) == (2, 0.5)
    flipped = run.withColumn("rank", 3 - F.col("rank"))
    delta = {r["query_id"]: r["delta_dcg"] for r in evaluate.ranking_regression(run, flipped, qrels).collect()}
    assert delta[1] == -delta[2] < 0
    trace = run.select("query_id", "id", F.when(F.col("rank") == 2, "final_topk").alias("reason"))
    lost = {r["query_id"]: r["lost_relevant"] for r in evaluate.loss_by_stage(trace, qrels, "query_id").where("stage = 'final_topk'").collect()}
    assert lost == {1: 0, 2: 1}
    runs = run.withColumn("ranker", F.lit("r")).withColumn("topic_id", F.lit("t"))
    view = audits.view_metrics(runs, qrels.withColumn("view", F.lit("v")), 1).where("topic_id = 't'").first()
    assert view["mean_precision"] == 0.5


def test_metrics_tell_unjudged_unsure_and_empty_apart(spark):
    runs = spark.createDataFrame([("r", 1, "a", 1), ("r", 1, "b", 2), ("r", 1, "c", 3), ("r", 2, "a", 1)], "ranker string, query_id int, id string, rank int")
    cases = spark.createDataFrame([("r", 1, "t"), ("r", 2, "t"), ("r", 3, "u")], "ranker string, query_id int, topic_id string")
    grades = spark.createDataFrame([("v", 1, "a", 2), ("v", 1, "b", None), ("v", 2, "a", 1), ("v", 2, "z", 2), ("w", 1, "a", 0)], "view string, query_id int, id string, grade int")
    rows = judged.metrics(runs, cases, grades, ks=(3,))
    got = {(r["view"], r["query_id"]): r for r in rows.collect()}
    assert len(got) == 6
    one = got["v", 1]
    assert (one["judged"], one["unjudged"], one["unsure"], one["precision_at_k"], one["ndcg_null_reason"]) == (1, 1, 1, None, "incomplete_scope")
    assert (one["precision_lower"], one["precision_upper"]) == (round(1 / 3, 6), 1.0)
    two = got["v", 2]
    assert (two["recall"], two["strict_recall"], two["shortfall"]) == (0.5, 0.0, 2)
    assert two["ndcg"] == round(1 / (3 + 1 / 1.584962500721156), 6) and two["candidate_recall"] == 0.5
    assert got["w", 1]["ndcg_null_reason"] == "no_relevant_supply" and got["w", 2]["ndcg_null_reason"] == "incomplete_scope"
    none = got["v", 3]
    assert (none["empty"], none["precision_at_k"], none["returned"], none["recall_null_reason"]) == (True, 0.0, 0, "incomplete_scope")
    s = {(r["view"], r["topic_id"]): r for r in judged.summary(rows).collect()}
    assert (s["v", "all"]["n_queries"], s["v", "all"]["null_ndcg"], s["v", "u"]["empty_rate"]) == (3, 2, 1.0)


def test_ideal_gain_of_many_equal_grades(spark):
    grades = spark.range(1000).select(F.lit("v").alias("view"), F.lit(1).alias("query_id"), F.col("id").cast("string").alias("id"), (F.col("id") % 3).cast("int").alias("grade"))
    got = judged.scopes(grades, ["view", "query_id"], (3, 500)).first()
    import math

    ideal = lambda k: sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(sorted((i % 3 for i in range(1000)), reverse=True)[:k]))
    assert abs(got["idcg_3"] - ideal(3)) < 1e-9 and abs(got["idcg_500"] - ideal(500)) < 1e-9 and (got["supply_1"], got["supply_2"]) == (666, 333)


def test_losses_refuse_unknown_stages_and_changes_are_conserved(spark):
    grades = spark.createDataFrame([("v", 1, "a", 2), ("v", 1, "b", 1)], "view string, query_id int, id string, grade int")
    trace = spark.createDataFrame([("r", 1, "a", "gate"), ("r", 1, "b", None), ("r", 1, "c", "top")], "ranker string, query_id int, id string, reason string")
    got = {r["stage"]: r for r in judged.stage_losses(trace, grades, ["gate", "top"]).collect()}
    assert (got["gate"]["entered"], got["gate"]["lost_relevant"], got["gate"]["conditional_loss"], got["top"]["entered"], got["top"]["cumulative_retention"], got["top"]["returned"]) == (3, 1, 0.5, 2, 0.5, 1)
    with pytest.raises(ValueError):
        judged.stage_losses(trace, grades, ["gate"])
    runs = spark.createDataFrame([("x", 1, "a", 2), ("x", 1, "c", 1), ("y", 1, "a", 1), ("y", 1, "b", 2)], "ranker string, query_id int, id string, rank int")
    cases = spark.createDataFrame([("x", 1, "t"), ("y", 1, "t")], "ranker string, query_id int, topic_id string")
    changes = judged.rank_changes(runs, grades, "x")
    assert {(r["id"], r["base_rank"], r["new_rank"]) for r in changes.collect()} == {("a", 2, 1), ("b", None, 2), ("c", 1, None)}
    t = judged.rank_change_totals(changes, judged.metrics(runs, cases, grades, ks=(5,)), "x").first()
    assert t["conserved"] and t["entered_top3"] == 1 and t["exited_top3"] == 1 and t["dcg_difference"] > 0
    with pytest.raises(ValueError):
        judged.views_of(spark.range(101).select(F.col("id").cast("string").alias("view")))
