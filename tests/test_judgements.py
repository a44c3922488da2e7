"""Hand-computed values for imports, decisions, memory, reading history and audits."""

import pytest
from pyspark.sql import functions as F

from evidmill.operators import audits, judgements, retrieval


def test_import_follows_the_order_of_the_records(spark):
    rows = [
        (1, "a", "t one", "x", 2000, "10.1/A", None),
        (2, "b", "t two", "x", 2000, "doi:10.1/a", "2401.00001"),  # alias of a by DOI: its arXiv number isn't taken
        (3, "c", "t three", "x", 2000, None, "arXiv:2401.00001v2"),
        (4, "d", "t four", "x", 2000, "10.1/a", "2401.00001"),  # the arXiv number goes before the DOI
        (5, "e", "T  ONE", "x", 2000, None, None),  # text of a
        (6, "f", "new", "x", 2030, None, None),
        (7, "g", " ", "x", 2000, None, None),
        (8, "h", "t two", "x", 2000, "", ""),  # the text of an alias isn't taken either
    ]
    df = spark.createDataFrame(rows, "place long, id string, title string, abstract string, year int, doi string, arxiv string")
    got = {r["id"]: r["reason"] for r in judgements.imported(df, 2026).collect()}
    assert got == {"a": None, "b": "duplicate_of:a", "c": None, "d": "duplicate_of:c", "e": "duplicate_of:a", "f": "year_not_before_cutoff", "g": "missing:title", "h": None}
    assert judgements.imported(df.limit(0), 2026).count() == 0


def test_one_text_in_many_records(spark):
    df = spark.range(3000).select(F.col("id").alias("place"), F.col("id").cast("string").alias("id"), F.lit("same").alias("title"), F.lit("text").alias("abstract"), F.lit(2000).alias("year"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("arxiv"))
    got = judgements.imported(df, 2026)
    assert got.where("accepted").count() == 1 and got.where("canonical_id = '0'").count() == 2999


def test_ratings_are_appended_or_refused(spark):
    kind = "item_id string, reviewer int, score int, unsure boolean, rationale string, rated_at string, revision int, change_reason string"
    history = spark.createDataFrame([("a", 1, 1, False, "r", "d", 1, "")], kind)
    new = [("a", 1, 1, False, "r", "d", 9, ""), ("b", 1, 2, False, "r", "d", 1, None), ("b", 2, None, True, "r", "d", 1, None), ("c", 1, 3, False, "r", "d", 1, None), ("d", 1, 1, False, "r", "d", 2, None), ("z", 1, 1, False, "r", "d", 1, None), ("d", 2, 1, False, "r", " ", 1, None)]
    allowed = spark.createDataFrame([(i, r) for i in "abcd" for r in (1, 2)], "item_id string, reviewer int")
    got = {(r["item_id"], r["reviewer"]): r["status"] for r in judgements.rating_import(history, spark.createDataFrame(new, kind), allowed).collect()}
    assert got == {("a", 1): "unchanged", ("b", 1): "appended", ("b", 2): "appended", ("c", 1): "incomplete", ("d", 1): "first_revision_not_one", ("z", 1): "unknown_item", ("d", 2): "incomplete"}
    later = spark.createDataFrame([("a", 1, 1, False, "r", "e", 1, "x")], kind)
    assert judgements.rating_import(history, later, allowed).first()["status"] == "revision_not_higher"
    other = later.withColumn("pool_version", F.lit("p2"))
    assert judgements.rating_import(history, other, allowed, "p1").first()["status"] == "unknown_item"
    assert judgements.with_ratings(history, spark.createDataFrame(new[:3], kind), allowed).count() == 3
    with pytest.raises(Exception, match="incomplete"):
        judgements.with_ratings(history, spark.createDataFrame(new[3:4], kind), allowed).collect()


def test_reading_history_and_memory(spark):
    pool = spark.createDataFrame([("q", "1", "a b", ""), ("r", "1", "a b", "")], "topic_id string, id string, title string, abstract string")
    reads = spark.createDataFrame([("q", ["a", "b"]), ("q", ["c"])], "topic_id string, w array<string>")
    got = {r["topic_id"]: r["exploration"] for r in retrieval.explored(pool, reads, ["topic_id"]).collect()}
    assert got == {"q": 0.5, "r": 0.5} and retrieval.explored(pool, reads.limit(1), ["topic_id"]).where("topic_id = 'q'").first()["exploration"] == 0
    topics = spark.createDataFrame([("agent_memory", "what agents keep", ["memory"], ["long memories"], [["recall"]])], "topic_id string, description string, keywords array<string>, phrases array<string>, concept_groups array<array<string>>")
    memory = spark.createDataFrame([("q", "Agent-Memory", None), ("q", None, "x_y agents")], "topic_id string, m_topic string, m_text string")
    words = lambda v: sorted(retrieval.memory_words(memory, topics, v).first()["words"])
    assert words("relevance") == ["agent", "agents", "memory", "x_y"]
    assert words("fixed") == ["agent", "agents", "keep", "memory", "what", "x", "y"]
    assert words("repaired") == ["agent", "keep", "long", "memories", "recall", "what", "x", "y"]
    assert {r["status"] for r in retrieval.memory_status(memory, topics).collect()} == {"resolved_topic", "unknown_literal"}


def test_words_of_an_alternative_in_any_order(spark):
    papers = spark.createDataFrame([("1", "f", "t", "gamma lies beta. rest")], "id string, field string, title string, abstract string")
    kind = "topic_id string, field string, phrases array<string>, concept_groups array<array<string>>, generic array<string>, sentence_only boolean"
    topic = spark.createDataFrame([("x", "f", [], [["beta gamma"], ["rest"]], [], False)], kind)
    assert [retrieval.evidence(papers, topic, b).first()["evidence"] for b in (True, False)] == [0.0, 0.8]


def test_unknown_mode_and_leaking_export_raise(spark):
    with pytest.raises(ValueError):
        retrieval.retrieve("other", None, None, None, None, None)
    cards = spark.createDataFrame([("project-77", "about project-77")], "project string, title string")
    with pytest.raises(Exception, match="secret"):
        audits.blind_export(cards, ["project"], ["title"], "s")[0].collect()
    public, key = audits.blind_export(cards.withColumn("title", F.lit("clean")), ["project"], ["title"], "s")
    assert public.columns == ["review_id", "title"] and public.first()["review_id"] == key.first()["review_id"]


def test_duplicates_of_branches_count_equal_texts_with_unlike_sets(spark):
    rows = [("p", "1", "x y", ["x_y"]), ("p", "2", "x y", ["x", "y"]), ("p", "3", "q", ["q"]), ("r", "4", "q", ["q"])]
    got = {r["branch"]: r.asDict() for r in audits.branch_duplicates(spark.createDataFrame(rows, "branch string, id string, key string, w array<string>"), "branch", 0.8).collect()}
    assert got["p"]["unique_clusters"] == 2 and got["p"]["near_duplicate_pair_rate"] == got["p"]["exact_duplicate_pair_rate"] == round(1 / 3, 6)
    assert got["r"]["near_duplicate_pair_rate"] is None and got["r"]["unique_clusters"] == 1


def test_audits_refuse_what_they_must(spark):
    means = spark.createDataFrame([("new", "t", 0.9, 0, 0)], "ranker string, topic_id string, mean_capacity_coverage double, empty_results long, all_irrelevant_returns long")
    gates = {r["check"]: (r["value"], r["passed"]) for r in audits.quality_gates(means, "base", "new", "t", 0.8, 0.5, 0.05).collect()}
    assert gates["baseline_drop"] == (None, False) and gates["macro"] == (0.9, True)
    template = spark.createDataFrame([("a", "t", "f", 1, None), ("b", "t", "g", 1, "Some text")], "review_id string, topic_id string, family string, old_grade int, text string")
    row = lambda i, **kw: tuple((dict(review_id=i, review_version="v1", decision="retain", grade=None, rationale="r", excerpt="some", reviewer_id="x", reviewed_at="d", base_hash="h") | kw).values())
    kind = "review_id string, review_version string, decision string, grade int, rationale string, excerpt string, reviewer_id string, reviewed_at string, base_hash string"
    fault = lambda *r: judgements.decided(template, spark.createDataFrame([row(*r[:1], **(r[1] if len(r) > 1 else {}))], kind), "v1", "h").first()["fault"]
    assert [fault("a"), fault("b"), fault("b", dict(reviewed_at=None)), fault("b", dict(base_hash="g")), fault("b", dict(base_hash=None))] == ["excerpt_not_in_text", None, "incomplete", "unknown_review", "unknown_review"]
    twice = spark.createDataFrame([(1, "a", "t", "x", 2000, None, None), (2, "a", "u", "y", 2000, None, None)], "place long, id string, title string, abstract string, year int, doi string, arxiv string")
    with pytest.raises(ValueError, match="two records have the id a"):
        judgements.imported(twice, 2026)
    for value, title in (("p1", "work of P1, mostly"), ("novelty", "a novelty-led group"), ("42", "answer: 42.")):
        with pytest.raises(Exception, match="secret"):
            audits.blind_export(spark.createDataFrame([(value, title)], "s string, title string"), ["s"], ["title"], "x")[0].collect()
    assert audits.blind_export(spark.createDataFrame([("p1", "p12 up1"), (None, "any")], "s string, title string"), ["s"], ["title"], "x")[0].count() == 2
    blind = spark.createDataFrame([("o1", 1, "d"), ("o2", 2, "d")], "old_id string, query_id int, id string")
    queries, papers = spark.createDataFrame([(1, "q")], "query_id int, query string"), spark.createDataFrame([("d", "t", "a", 2000)], "id string, title string, abstract string, year int")
    with pytest.raises(Exception, match="incomplete migration"):
        judgements.migrated(blind, queries, papers, "s").collect()
    assert {r["status"] for r in judgements.migrated(blind, queries, papers, "s", partial=True).collect()} == {"matched", "unmatched"}
    assert judgements.migrated(blind.where("query_id = 1"), queries, papers, "s").count() == 1


def test_an_effect_without_all_seeds_has_no_interval(spark):
    from evidmill.operators import effects

    rows = [("c", "s", "t", m, k, float(k)) for m, n in (("all", 3), ("part", 2)) for k in range(n)] + [("c", "s", "t", "null", k, None if k == 1 else 1.0) for k in range(3)]
    df = spark.createDataFrame(rows, "comparison string, stratum string, treatment string, metric string, seed int, diff double")
    got = {r["metric"]: (r["n_pairs"], r["ci_low"] is None, r["status"]) for r in effects.bootstrap(df, replicates=50, seeds=[0, 1, 2]).collect()}
    assert got == {"all": (3, False, "complete"), "part": (2, True, "incomplete"), "null": (2, True, "incomplete")}


def test_gates_of_isolation_and_negatives(spark):
    gold = spark.createDataFrame([("t", f"d{i}", i % 3) for i in range(9)], "topic_id string, id string, grade int")
    mixed = audits.permuted(gold, "topic_id", "id", "grade")
    assert sorted(r["grade"] for r in mixed.collect()) == sorted(r["grade"] for r in gold.collect()) and mixed.exceptAll(gold).count() > 0
    blind = lambda g: spark.createDataFrame([("t", "d1", 1), ("t", "d2", 2)], "topic_id string, id string, rank int")
    peeking = lambda g: g.where("grade = 2").select("topic_id", "id")
    assert audits.gold_changes(blind, gold, "topic_id", "id", "grade").first()["value"] == 0
    assert audits.gold_changes(peeking, gold, "topic_id", "id", "grade").first()["value"] > 0
    rows = spark.createDataFrame([("generic_negative", True, True), ("context_negative", False, True), ("positive", True, True)], "challenge_type string, eligible boolean, evidence_passed boolean")
    assert audits.negative_passes(rows).first()["value"] == 1 and audits.negative_passes(rows.where("not eligible")).first()["value"] is None
    means = spark.createDataFrame([(r, "t", 0.9, 0, 0) for r in ("new", "base")], "ranker string, topic_id string, mean_capacity_coverage double, empty_results long, all_irrelevant_returns long")
    further = audits.negative_passes(rows.where("not eligible")).unionByName(audits.gold_changes(blind, gold, "topic_id", "id", "grade"))
    gates = {r["check"]: r["passed"] for r in audits.quality_gates(means, "base", "new", "t", 0.8, 0.5, 0.05, further).collect()}
    assert gates == {"named_topic": True, "macro": True, "minimum_topic": True, "baseline_drop": True, "zero_relevant_returns": True, "generic_negatives": False, "gold_isolation": True}


def test_estimates_are_carried_up_from_strata(spark):
    from evidmill.operators import review

    rows = [(i, s, r, *([v] * 4)) for i, s, v in (("a", 0, 5), ("b", 0, 1), ("c", 1, 3), ("d", 2, None)) for r in (1, 2)]
    ratings = spark.createDataFrame(rows, "item_id string, stratum int, reviewer int, d0 int, d1 int, d2 int, d3 int")
    sample = spark.createDataFrame([("a", 0, 10, "p", "solo"), ("b", 0, 10, "p", "solo"), ("c", 1, 4, "p", "team"), ("d", 2, 6, "q", "team")], "item_id string, stratum int, population int, policy string, output_type string")
    got = {(r["policy"], r["output_type"]): r for r in review.analysis(sample, review.pairs(ratings), ["policy"]).where("scheme = 'equal'").collect()}
    assert (got["p", "solo"]["estimated_total"], got["p", "team"]["estimated_total"], got["p", "all"]["estimated_total"], got["p", "all"]["estimated_mean"]) == (5.0, 2.0, 7.0, 0.5)
    assert got["q", "team"]["estimated_total"] is None and got["all", "all"]["estimated_total"] is None
    assert (got["all", "all"]["lower_bound"], got["all", "all"]["upper_bound"], got["all", "team"]["missing"]) == (7.0, 13.0, 1)
    apart = spark.createDataFrame([("a", 0, 1, 1, 2, 3, 4), ("a", 0, 2, 3, 3, 3, 1)], ratings.schema)
    assert sorted(r["dim"] for r in review.disagreements(review.pairs(apart)).collect()) == ["d0", "d3"]
