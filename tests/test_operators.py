"""Hand-computed values and brute force for the retrieval-evaluation operators."""

import json

import pytest
from pyspark.sql import functions as F

from evidmill.functions import text as T
from evidmill.operators import dedup, evaluate, ledger, matrix, retrieval, review, simulate
from evidmill.sources import corpus, journal


def one(df, c):
    return df.select(c.alias("x")).first()["x"]


def test_text_functions(spark):
    df = spark.createDataFrame([("Agents' policies_x-ray! Class glass tests",)], "t string")
    assert one(df, T.token_set(F.col("t"))) == ["agents", "policies_x", "ray", "class", "glass", "tests"]
    assert one(df, T.normalized(F.col("t"))) == "agents policies x ray class glass tests"
    assert one(df, T.folded_words(F.col("t"))) == ["agent", "policie", "x", "ray", "class", "glass", "test"]
    assert one(df, T.mapped_words(F.col("t"))) == ["agent", "policy", "x", "ray", "class", "glass", "tests"]
    w = F.array(*map(F.lit, "a b c".split()))
    assert [one(df, T.phrase_in(w, F.array(*map(F.lit, p)))) for p in (["b", "c"], ["a", "c"])] == [True, False]
    assert one(df, T.phrase_in(w, F.array().cast("array<string>"))) is False
    none = F.array().cast("array<string>")
    assert one(df, T.jaccard(none, none)) == 0 and one(df, T.overlap(none, none)) is None


def test_ranked_metrics_by_hand(spark):
    grades = spark.createDataFrame([("a", 2), ("c", 0)], "id string, grade int")
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, id string, rank int")
    r = evaluate.ranked_metrics(run, grades, 3).first()
    assert r["precision_at_k"] is None and r["precision_judged"] == 0.5 and r["ndcg_null_reason"] == "incomplete_scope"
    assert (r["precision_lower"], r["precision_upper"]) == (round(1 / 3, 6), round(2 / 3, 6))
    grades = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "id string, grade int")
    r = evaluate.ranked_metrics(run, grades, 3).first()
    assert r["dcg"] == 3.5 and r["ndcg"] == round(0.9639404333166532, 6) and r["recall"] == 1


def test_kappa_quality_and_estimates(spark):
    rows = [(f"i{k}", 0, r, *([k % 5 + 1] * 4)) for k in range(10) for r in (1, 2)]
    ratings = spark.createDataFrame(rows, "item_id string, stratum int, reviewer int, d0 int, d1 int, d2 int, d3 int")
    assert {r["quadratic_kappa"] for r in review.agreement(review.pairs(ratings)).collect()} == {1.0}
    flat = ratings.withColumn("d0", F.lit(3))
    assert review.agreement(review.pairs(flat)).where("dim = 'd0'").first()["quadratic_kappa"] is None
    q = review.quality_scores(review.pairs(spark.createDataFrame([("x", 0, 1, 5, 5, 5, 5), ("x", 0, 2, 3, 3, 3, 3), ("y", 0, 1, 5, 5, 5, None), ("y", 0, 2, 5, 5, 5, 5)], ratings.schema)))
    assert [(r["item_id"], r["quality"]) for r in q.collect()] == [("x", 0.75)]
    s = spark.createDataFrame([("a", 0, 10), ("b", 0, 10)], "item_id string, stratum int, population int")
    full = spark.createDataFrame([("a", 0.2), ("b", 0.4)], "item_id string, quality double")
    assert review.ht_estimates(s, full).first()["estimated_total"] == 3.0
    part = review.ht_estimates(s, full.where("item_id = 'a'")).first()
    assert (part["estimated_total"], part["lower_bound"], part["upper_bound"]) == (None, 1.0, 6.0)


def test_greedy_clusters_are_not_transitive(spark):
    rows = [(1, "a", "w1 w2 w3 w4", ""), (1, "b", "w1 w2 w3 w5", ""), (1, "c", "w1 w2 w5 w6", ""), (1, "d", "w1 w2 w3 w4", "")]
    df = spark.createDataFrame(rows, "q int, id string, title string, abstract string")
    got = {r["id"]: r["cluster_id"] for r in retrieval.pool_clusters(df, ["q"], 0.6).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "a"}


def test_similar_sets_by_brute_force(spark):
    import random

    rng = random.Random(0)
    sets = {f"{k:03d}": {f"t{rng.randrange(12)}" for _ in range(rng.randrange(1, 14))} for k in range(120)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id string, w array<string>")
    for t in (0.6, 0.8):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}
        assert {(r["a"], r["b"]) for r in dedup.similar_sets(df, t).collect()} == want


def _alike(rng, count, sizes, pool):
    """Sets of unlike size, most with a near copy."""
    sets = []
    while len(sets) < count:
        w = set(rng.sample(pool, rng.choice(sizes)))
        sets.append(w)
        for _ in range(rng.randrange(3)):
            sets.append(set(rng.sample(sorted(w), len(w) - rng.randrange(max(1, len(w) // 5)))) | set(rng.sample(pool, rng.randrange(1, max(2, len(w) // 8)))))
    return {f"{k:04d}": w for k, w in enumerate(sets)}


def test_similar_sets_in_blocks_by_brute_force(spark, monkeypatch):
    import random

    from evidmill.operators import similar

    monkeypatch.setattr(similar, "TOKEN_BLOCK", 5)
    monkeypatch.setattr(similar, "SET_BLOCK", 3)
    monkeypatch.setattr(similar, "FREQUENT", 300)
    sets = _alike(random.Random(1), 150, [1, 2, 5, 30, 300, 390, 420, 1700, 2000], [f"w{k}" for k in range(9000)])
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id string, w array<string>").repartition(5)
    for t in (0.8, 0.9):
        score = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        want = {(a, b): score(a, b) for a in sets for b in sets if a < b and score(a, b) >= t - 1e-12 and sets[a] != sets[b]}
        got = [(r["a"], r["b"], r["score"]) for r in similar.similar_sets(df, t).where("score < 1").collect()]
        assert len(want) > 3 and len(got) == len(want) and all(abs(want[a, b] - s) < 1e-8 for a, b, s in got)


def test_unlike_sets_of_one_prefix_are_not_shuffled(spark):
    import random

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rng = random.Random(2)
    rows = [(f"{k:04d}", sorted({f"r{x}" for x in rng.sample(range(40), 20)} | {f"f{x}" for x in rng.sample(range(400), 60)})) for k in range(1500)]
    df = spark.createDataFrame(rows, "id string, w array<string>")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = shuffled()
    try:
        assert dedup.similar_sets(df, 0.8).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled() - before < 8_000_000


def test_chains_and_cycles(spark):
    m = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, None)], "project_id long, merged_into long")
    assert {r["project_id"]: r["terminal"] for r in ledger.terminals(m).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    with pytest.raises(Exception):
        ledger.terminals(spark.createDataFrame([(0, 1), (1, 0)], m.schema)).collect()


def test_journal_tampering(spark):
    rows = spark.createDataFrame([("x", k, k, "e", f"p{k}") for k in range(6)], "branch string, seq long, tick int, kind string, payload string")
    good = journal.commit(rows)
    assert journal.verify(good).first()["first_bad"] is None
    bad = good.withColumn("payload", F.when(F.col("seq") == 3, "other").otherwise(F.col("payload")))
    assert journal.verify(bad).first()["first_bad"] == 3
    assert journal.verify(good.where("seq <> 2")).first()["first_bad"] == 3


def test_worlds_conserve_projects(spark):
    b = spark.createDataFrame([(42, "balanced", "open"), (42, "novelty", "closed")], "seed int, policy string, network string")
    assert {r["residual"] for r in simulate.flow(simulate.simulate(b)).collect()} == {0}
    assert simulate.world(42, "balanced", "open") == simulate.world(42, "balanced", "open")


def test_choices_follow_probabilities(spark):
    df = spark.createDataFrame([(g, o, u) for g in range(40) for o, u in (("a", 0.0), ("b", 5.0))], "g int, o string, u double")
    assert {r["chosen"] for r in matrix.keyed_choice(df, "g", "o", "u", 1).collect()} == {"b"}


def test_sources(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    row = {"id": "1", "title": "t", "abstract": "a", "year": 2020, "field": "f", "synthetic": True}
    p.write_text("\n".join(json.dumps(row | {"id": str(k), "year": 2020 + k}) for k in range(6)))
    assert corpus.read_corpus(spark, str(p), 2024).count() == 4
    with pytest.raises(ValueError, match="synthetic"):
        corpus.read_corpus(spark, str(p), 2024, allow_synthetic=False)
    p.write_text('{"a": 1, "a": 2}\n{"b": NaN}\n{"c": 1}\n')
    assert corpus.strict_faults(spark, str(p)).count() == 2
    df = spark.createDataFrame([("1", "", "true")], "n string, x string, b string")
    assert corpus.typed(df, ["n"], ["x"], ["b"]).first() == (1, None, True)
    with pytest.raises(Exception):
        corpus.typed(spark.createDataFrame([("01",)], "n string"), ["n"]).collect()
    out = str(tmp_path / "frozen")
    ids = spark.range(5)
    corpus.write_frozen(ids, out, "id")
    corpus.write_frozen(ids.repartition(3), out, "id")
    with pytest.raises(ValueError, match="frozen"):
        corpus.write_frozen(spark.range(6), out, "id")
    names = spark.createDataFrame([("a/b",), ("../x",), ("/x",), ("a\\b",)], "name string")
    assert corpus.unsafe_members(names).count() == 3


def test_streamed_journal(spark, tmp_path):
    from evidmill.streaming import journal_stream

    rows = spark.createDataFrame([(b, k, k, "e", f"p{k}") for b in "xy" for k in range(8)], "branch string, seq long, tick int, kind string, payload string")
    good = journal.commit(rows)
    bad = good.withColumn("hash", F.when((F.col("branch") == "y") & (F.col("seq") == 5), "0").otherwise(F.col("hash")))
    path = str(tmp_path / "journal")
    bad.coalesce(1).write.parquet(path)
    q = journal_stream.verified(journal_stream.stream(spark, path)).writeStream.format("memory").queryName("verdicts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["branch"]: (r["records"], r["first_bad"]) for r in spark.table("verdicts").collect()}
    assert got == {"x": (8, None), "y": (8, 5)}


def test_text_diversity_of_all_papers_by_brute_force(spark, monkeypatch):
    from itertools import combinations

    from evidmill.functions import text as T
    from evidmill.operators import checks
    from evidmill.operators import retrieval as R
    from evidmill.plans import adapters as A
    from evidmill.plans import check_queries as Q

    sf = "/root/testdata/sf0.001"

    def want(rows):
        out = {}
        for f in {r["field"] for r in rows}:
            j = [round(len(a & b) / max(1, len(a | b)), 9) for a, b in combinations([set(r["w"]) for r in rows if r["field"] == f], 2)]
            out[f] = 1 - sum(j) / len(j) if j else 0.0
        return out

    rows = A.papers(spark, sf).select("field", "id", T.token_set(R.content()).alias("w")).collect()
    for block in (512, 9):
        monkeypatch.setattr(checks, "SETS", block)
        got = {r["field"]: r["diversity"] for r in Q.QUERIES["text_diversity"](spark, sf).collect()}
        assert set(got) == {r["field"] for r in rows} and all(abs(got[f] - x) < 2e-6 for f, x in want(rows).items())


def test_pairs_whose_texts_agree_but_not_their_token_sets(spark):
    rows = [("a", "", "x_y"), ("b", "", "x y"), ("c", "", "p q r"), ("d", "", "p q r"), ("e", "", "r q p")]
    r = dedup.pair_quality(spark.createDataFrame(rows, "id string, title string, abstract string")).first()
    # a and b are one family in two sets; c, d, e one set of two families
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) == (1, 2, 1, round(1 / 3, 6), 0.5)
    r = dedup.pair_quality(spark.createDataFrame(rows[:2], "id string, title string, abstract string")).first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) == (0, 0, 1, None, 0.0)


def test_empty_groups_and_phrases_are_no_evidence(spark):
    papers = spark.createDataFrame([("1", "f", "alpha", "beta gamma. delta")], "id string, field string, title string, abstract string")
    kind = "topic_id string, field string, phrases array<string>, concept_groups array<array<string>>, generic array<string>, sentence_only boolean"
    topics = [("none", "f", [], [], [], True), ("blank", "f", ["--"], [], ["!"], False), ("one", "f", [], [["gamma"]], [], True), ("window", "f", [], [["alpha"], ["delta"]], [], False), ("phrase", "f", ["beta gamma"], [], [], True)]
    for bounded in (True, False):
        got = {r["topic_id"]: (r["evidence"], r["generic_only"]) for r in retrieval.evidence(papers, spark.createDataFrame(topics, kind), bounded).collect()}
        # bounded, a topic without groups that isn't sentence-only counts for any text
        assert got == {"none": (0.0, False), "blank": (0.8 if bounded else 0.0, False), "one": (0.8, False), "window": (0.8, False), "phrase": (0.9, False)}


def test_recall_counts_what_the_run_has_not(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, id string, rank int")
    grades = spark.createDataFrame([("a", 2), ("b", 0), ("far", 2), ("off", 1)], "id string, grade int")
    got = {(r["k"], r["grade_rule"]): r["recall"] for r in evaluate.candidate_recall(run, grades, grades).collect()}
    assert got == {("10", 1): round(1 / 3, 6), ("20", 1): round(1 / 3, 6), ("all", 1): 1.0, ("10", 2): 0.5, ("20", 2): 0.5, ("all", 2): 1.0}
    m = evaluate.ranked_metrics(run, grades, 2).first()
    assert m["recall"] == round(1 / 3, 6) and m["ndcg"] == round(3 / (3 + 3 / 1.584962500721156), 6)
    families = spark.createDataFrame([("a", "f"), ("b", "g"), ("far", "f"), ("off", "h")], "id string, family string")
    s = evaluate.selection_metrics(run, grades, families).first()
    assert (s["family_recall"], s["capacity_coverage"]) == (0.5, 0.5)


def test_bootstrap_of_one_value_has_no_interval(spark):
    from evidmill.operators import effects

    rows = [("c", "s", "t", "one", 1, 2.0)] + [("c", "s", "t", "two", k, float(k)) for k in range(3)]
    got = {r["metric"]: (r["n_pairs"], r["ci_low"], r["ci_high"]) for r in effects.bootstrap(spark.createDataFrame(rows, "comparison string, stratum string, treatment string, metric string, seed int, diff double"), replicates=50).collect()}
    assert got["one"] == (1, None, None) and got["two"][1] <= 1.0 <= got["two"][2]


def test_long_document_numbers_stay_apart(spark, tmp_path):
    from evidmill.plans import adapters

    spark.createDataFrame([(123456789012, "a. b"), (123456789013, "a. c")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert adapters.papers(spark, str(tmp_path)).select("id").distinct().count() == 2
