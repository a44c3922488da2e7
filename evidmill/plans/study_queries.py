"""Queries of the duplicate, evaluation, review, effect, ledger, design and journal operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidmill.functions import batches
from evidmill.functions import text as T
from evidmill.operators import dedup, effects, evaluate, ledger, matrix, review, simulate
from evidmill.operators import retrieval as R
from evidmill.plans import adapters as A
from evidmill.plans import retrieval_queries as RQ
from evidmill.sources import journal


def _run(s, d, k=20):
    q = RQ._queries(s, d)
    return R.bm25_topk(A.papers(s, d), q, k).join(q.select("query_id", "topic_id"), "query_id").select("query_id", "topic_id", "id", "rank", "score")


def _families(s, d):
    return A.papers(s, d).select("id", F.md5(batches.normalized(R.content())).alias("family"))


def _capped(s, d):
    pool = _run(s, d).join(_families(s, d).withColumnRenamed("family", "cluster_id"), "id")
    return R.capped(pool, ["query_id"], [F.asc("rank")]).select("query_id", "selected_rank", "id")


def _trace(s, d):
    """First exclusion of every paper for each topic: evidence gate, pool, exact duplicates, top 3."""
    p, t = A.papers(s, d), A.topics(s)
    ev = R.qualified(p, t, True).select("topic_id", "id", "evidence")
    pool = R.ranked(ev, ["topic_id"], [F.desc("evidence"), F.asc("id")], None, "place")
    pool = pool.withColumn("candidate_rank", F.when(F.col("place") <= R.POOL, F.col("place")))
    pool = pool.join(_families(s, d), "id")
    first = F.min("candidate_rank").over(R.W.partitionBy("topic_id", "family"))
    pool = pool.withColumn("kept", F.col("candidate_rank") == first)
    sel = F.row_number().over(R.W.partitionBy("topic_id").orderBy(F.desc(F.coalesce("kept", F.lit(False))), "candidate_rank"))
    pool = pool.withColumn("returned", F.col("kept") & (sel <= R.TOP_K))
    every = p.select("id").crossJoin(F.broadcast(t.select("topic_id"))).join(pool, ["topic_id", "id"], "left")
    return every.select("topic_id", "id", evaluate.exclusion(F.col("evidence").isNotNull(), F.col("candidate_rank"), F.coalesce("kept", F.lit(False)), F.coalesce("returned", F.lit(False))).alias("reason"))


def _overlap(s, d):
    a = R.bm25_topk(A.papers(s, d), A.bench_queries(s, d), 5).groupBy("query_id").agg(F.collect_set("id").alias("a"))
    b = R.jaccard_topk(A.papers(s, d), A.bench_queries(s, d), 5).groupBy("query_id").agg(F.collect_set("id").alias("b"))
    return a.join(b, "query_id", "full").select("query_id", F.round(T.overlap(F.coalesce("a", F.array()), F.coalesce("b", F.array())), 6).alias("jaccard"))


def _topic_pairs(s, d):
    lab = R.classified(A.papers(s, d), A.topics(s))
    n = lab.groupBy("topic_id").agg(F.count("*").alias("n"))
    t = A.topics(s).select("topic_id", "field")
    pairs = t.alias("x").join(t.alias("y"), F.col("x.topic_id") < F.col("y.topic_id")).select(F.col("x.topic_id").alias("a"), F.col("y.topic_id").alias("b"), (F.col("x.field") == F.col("y.field")).alias("near"))
    both = lab.alias("x").join(lab.alias("y"), (F.col("x.id") == F.col("y.id")) & (F.col("x.topic_id") < F.col("y.topic_id"))).groupBy(F.col("x.topic_id").alias("a"), F.col("y.topic_id").alias("b")).agg(F.count("*").alias("n_both"))
    j = pairs.join(both, ["a", "b"], "left").na.fill(0, ["n_both"]).join(n.select(F.col("topic_id").alias("a"), F.col("n").alias("na")), "a", "left").join(n.select(F.col("topic_id").alias("b"), F.col("n").alias("nb")), "b", "left").na.fill(0, ["na", "nb"])
    return j.select("a", "b", F.when(F.col("n_both") > 0, "shared").when(F.col("near"), "near").otherwise("far").alias("relation"), "n_both", F.round(F.try_divide(F.col("n_both"), F.col("na") + F.col("nb") - F.col("n_both")), 6).alias("overlap"))


def _conditions(sample):
    """The six strata as three policies with single and team outputs."""
    kind = F.when(F.col("stratum") < 3, "solo").otherwise("team")
    return sample.withColumn("policy", F.element_at(F.array(*map(F.lit, ["balanced", "novelty", "recognition"])), (F.col("stratum") % 3 + 1).cast("int"))).withColumn("output_type", kind)


def _regression(s, d):
    """Jaccard (treatment) against BM25 (baseline) by topic: drop of judged precision beyond 0.05; a missing side is incomplete."""
    p, q, g = A.papers(s, d), RQ._queries(s, d), A.qrels(s, d)
    mean = lambda run: run.join(q.select("query_id", "topic_id"), "query_id").join(g, "id").groupBy("topic_id").agg(F.avg((F.col("grade") >= 1).cast("int")).alias("m"))
    b = mean(R.bm25_topk(p, q, 3)).withColumnRenamed("m", "baseline")
    t = mean(R.jaccard_topk(p, q, 3)).withColumnRenamed("m", "treatment")
    j = b.join(t, "topic_id", "left")
    status = F.when(F.col("treatment").isNull(), "incomplete").when(F.col("baseline") - F.col("treatment") > 0.05, "failed").otherwise("passed")
    return j.select("topic_id", F.round("baseline", 6).alias("baseline"), F.round("treatment", 6).alias("treatment"), status.alias("status"))


def _ratios(s, d):
    j = _run(s, d, 10).join(A.qrels(s, d), "id")
    rows = j.withColumn("policy", F.concat(F.lit("p"), (F.col("query_id") % 3).cast("string")))
    return evaluate.ratio_of_sums(rows.groupBy("topic_id", "policy", "query_id").agg(F.count_if(F.col("grade") >= 1).alias("num"), F.count("*").alias("den")))


def _shortfall(s, d):
    lab = R.qualified(A.papers(s, d), A.topics(s), True).join(_families(s, d), "id").groupBy("topic_id").agg(F.count("*").alias("n"), F.countDistinct("family").alias("f"))
    j = A.topics(s).select("topic_id").join(lab, "topic_id", "left").na.fill(0)
    why = F.array_compact(F.array(F.when(F.col("n") == 0, "no_evidence"), F.when(F.col("n") < 20, "pool_not_full"), F.when(F.col("f") < F.col("n"), "duplicates_present"), F.when(F.col("f") < 3, "too_few_distinct")))
    return j.select("topic_id", F.col("n").alias("qualified"), F.array_join(why, ",").alias("reasons"))


def _revisions(s, d):
    e = A.tables(s, d, "events")[0].select("user_id", "event_type", "event_id", (F.col("event_id") % 7).alias("revision"), F.round("value", 2).alias("value"))
    return evaluate.latest_revision(e, ["user_id", "event_type"], "revision", "event_id")


def _views(s, d):
    r = A.ratings(s, d)
    p = r.groupBy("item_id").agg(F.max(F.when(F.col("reviewer") == 1, F.col("d0"))).alias("r1"), F.max(F.when(F.col("reviewer") == 2, F.col("d0"))).alias("r2"), F.max(F.when(F.col("reviewer") == 1, F.col("d1"))).alias("adjudicated"))
    return evaluate.label_views(p).groupBy("view", "grade").agg(F.count("*").alias("n"))


def _calibration(s, d):
    sc = R.jaccard_hits(A.papers(s, d), A.bench_queries(s, d)).join(A.qrels(s, d), "id").select("score", (F.col("grade") >= 1).alias("positive"))
    grid = s.createDataFrame([(x / 100,) for x in (0, 2, 4, 6, 8, 10)], "threshold double").coalesce(1)
    return evaluate.calibration(sc, grid)


def _diffs(s, d):
    return effects.paired_differences(A.branches(s, d))


def _sample(s, d):
    return review.stratified_sample(A.ratings(s, d).where("reviewer = 1").select("item_id", "stratum"), 25, 7303)


def _agents(s, d):
    return A.ledger(s, d).select("agent_id").distinct().withColumn("field", F.col("agent_id") % 3)


def _factorial(s, d):
    return matrix.factorial(A.topics(s).select("topic_id"), s.createDataFrame([(m,) for m in ("empty", "one", "many")], "memory string").coalesce(1), A.policies(s).select("policy"))


def _journal(s, d):
    e = A.tables(s, d, "events")[0]
    rows = e.select((F.col("user_id") % 20).cast("string").alias("branch"), F.col("event_id").alias("at"), (F.col("event_id") % 30).cast("int").alias("tick"), F.col("event_type").alias("kind"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("payload"))
    seq = F.row_number().over(R.W.partitionBy("branch").orderBy("at")) - 1
    return journal.verify(journal.commit(rows.withColumn("seq", seq.cast("bigint")).drop("at")))


def _worlds(s):
    dims = [s.createDataFrame([(x,) for x in v], f"{c} {t}").coalesce(1) for c, t, v in (("seed", "int", (42, 43, 44)), ("policy", "string", ("balanced", "novelty", "recognition")), ("network", "string", ("closed", "open")))]
    return simulate.simulate(dims[0].crossJoin(dims[1]).crossJoin(dims[2]))


def _choice(s, d):
    u = A.ledger(s, d).groupBy("project_id", "action").agg(F.round(F.avg("units") / 100, 6).alias("utility"))
    return matrix.keyed_choice(u, "project_id", "action", "utility", 42)


def _softmax(s, d):
    u = A.ledger(s, d).groupBy("project_id", "action").agg(F.round(F.avg("units") / 100, 6).alias("utility"))
    return matrix.softmax(u, "project_id", "utility").select("project_id", "action", F.round("p", 6).alias("p"))


QUERIES = {
    "exact_dup_clusters": lambda s, d: dedup.exact_clusters(A.papers(s, d)),
    "near_dup_pairs": lambda s, d: dedup.similar_sets(dedup.distinct_texts(A.papers(s, d)), 0.8).withColumn("score", F.round("score", 6)),
    "dup_components": lambda s, d: dedup.duplicate_components(A.papers(s, d)),
    "dup_pair_quality": lambda s, d: dedup.pair_quality(A.papers(s, d)),
    "import_aliases": lambda s, d: dedup.import_aliases(A.papers(s, d)),
    "greedy_dup_clusters": lambda s, d: R.pool_clusters(_run(s, d).join(A.papers(s, d), "id"), ["query_id"], 0.6).select("query_id", "id", "cluster_id"),
    "capped_topk": _capped,
    "ranked_metrics": lambda s, d: evaluate.ranked_metrics(_run(s, d), A.qrels(s, d), 5),
    "strict_metrics": lambda s, d: evaluate.ranked_metrics(_run(s, d).join(A.qrels(s, d), "id", "left_semi"), A.qrels(s, d), 5, strict=2),
    "selection_metrics": lambda s, d: evaluate.selection_metrics(_run(s, d), A.qrels(s, d), _families(s, d)),
    "metrics_grouping_sets": lambda s, d: evaluate.cutoffs(_run(s, d), A.qrels(s, d)),
    "candidate_recall": lambda s, d: evaluate.candidate_recall(_run(s, d), A.qrels(s, d), A.papers(s, d)),
    "exclusion_trace": lambda s, d: _trace(s, d).groupBy("topic_id", "reason").agg(F.count("*").alias("n")),
    "loss_by_stage": lambda s, d: evaluate.loss_by_stage(_trace(s, d), A.qrels(s, d)),
    "ranking_regression": lambda s, d: evaluate.ranking_regression(_run(s, d), R.jaccard_topk(A.papers(s, d), A.bench_queries(s, d), 20), A.qrels(s, d)),
    "latest_revision": _revisions,
    "label_views": _views,
    "doc_overlap": _overlap,
    "topic_pair_overlap": _topic_pairs,
    "coverage_regression": _regression,
    "stratified_ratio_of_sums": _ratios,
    "shortfall_reasons": _shortfall,
    "calibration_select": _calibration,
    "rater_agreement": lambda s, d: review.agreement(review.pairs(A.ratings(s, d))),
    "quality_scores": lambda s, d: review.quality_scores(review.pairs(A.ratings(s, d))).withColumn("quality", F.round("quality", 6)),
    "review_analysis": lambda s, d: review.analysis(_conditions(_sample(s, d)), review.pairs(A.ratings(s, d)), ["policy"]),
    "rating_disagreements": lambda s, d: review.disagreements(review.pairs(A.ratings(s, d))),
    "quality_sensitivity": lambda s, d: review.sensitivity(review.pairs(A.ratings(s, d))),
    "stratified_sample": _sample,
    "ht_estimates": lambda s, d: review.ht_estimates(_sample(s, d), review.quality_scores(review.pairs(A.ratings(s, d)))),
    "coverage_status": lambda s, d: review.coverage_status(A.ratings(s, d)),
    "paired_effects": lambda s, d: effects.effects(_diffs(s, d)),
    "did_effects": lambda s, d: effects.effects(_diffs(s, d).where("comparison = 'policy_x_network'")),
    "bootstrap_ci": lambda s, d: effects.arithmetic_bootstrap(_diffs(s, d)),
    "bootstrap_exact": lambda s, d: effects.bootstrap(_diffs(s, d), seeds=list(range(10))),
    "flow_decomposition": lambda s, d: effects.flow_decomposition(A.branches(s, d)),
    "merge_chain_effort": lambda s, d: ledger.effort_by_final_project(A.ledger(s, d), A.merges(s)),
    "author_credits": lambda s, d: ledger.credits(A.ledger(s, d), A.merges(s)),
    "project_flow": lambda s, d: ledger.project_flow(A.ledger(s, d), A.merges(s)),
    "accounting_checks": lambda s, d: ledger.accounting_checks(A.ledger(s, d), A.merges(s)),
    "entropy_by_project": lambda s, d: ledger.entropy(A.ledger(s, d), "project_id", "action"),
    "action_rates": lambda s, d: ledger.action_rates(A.ledger(s, d)),
    "cumulative_trajectory": lambda s, d: ledger.trajectory(A.ledger(s, d)),
    "exit_successor": lambda s, d: ledger.successors(A.ledger(s, d)),
    "budget_breach": lambda s, d: ledger.budget_breach(A.ledger(s, d), 5000),
    "last_actions": lambda s, d: ledger.last_actions(A.ledger(s, d)),
    "softmax_probs": _softmax,
    "keyed_choice": _choice,
    "candidate_schedule": lambda s, d: matrix.schedule(_agents(s, d), {"same": 1, "other": 2}),
    "factorial_matrix": _factorial,
    "resume_antijoin": lambda s, d: matrix.outstanding(_factorial(s, d), _factorial(s, d).where("policy = 'novelty'")),
    "state_leaks": lambda s, d: matrix.state_leaks(A.branches(s, d), ["seed", "network"], F.col("policy")),
    "journal_chain_check": _journal,
    "world_simulation": lambda s, d: simulate.flow(_worlds(s)),
    "world_journal_check": lambda s, d: journal.verify(journal.commit(_worlds(s).select("branch", "seq", "tick", "kind", "payload"))),
}

# ---- SQL ----

_P, _T, _TEXT, _Q = RQ._P, RQ._T, RQ._TEXT, RQ._Q
_FAM = f"fam AS (SELECT id, md5(array_to_string({A.sql_words(_TEXT)}, ' ')) AS family FROM papers)"
_RUN = RQ._BM25 + ", run AS (SELECT query_id, topic_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM bm JOIN q USING (query_id))"
_JRUN = RQ._sql_jaccard(True).replace(_P + ", ", "").replace(_Q + ", ", "").replace("qt AS", "jqt AS").replace("JOIN qt USING", "JOIN jqt USING")
_GAIN = "(pow(2, grade) - 1) / log2(rank + 1)"


def _metrics(strict: int, judged_only: bool) -> str:
    sem = "WHERE id IN (SELECT id FROM qrels)" if judged_only else ""
    return f"""WITH {_RUN}, {A.SQL_QRELS}, r AS (SELECT query_id, id, rank FROM run WHERE rank <= 20), rr AS (SELECT * FROM r {sem}),
j AS (SELECT rr.*, grade FROM rr LEFT JOIN qrels USING (id)),
g AS (SELECT query_id, count(*) FILTER (rank <= 5) AS returned, count(grade) FILTER (rank <= 5) AS judged, count(*) FILTER (rank <= 5 AND grade >= {strict}) AS relevant, coalesce(sum({_GAIN}) FILTER (rank <= 5), 0) AS dcg,
  (SELECT coalesce(sum((pow(2, grade) - 1) / log2(i + 1)), 0) FROM (SELECT grade, row_number() OVER (ORDER BY grade DESC, id) AS i FROM qrels) WHERE i <= 5) AS idcg, count(*) FILTER (grade IS NULL) AS unknown, (SELECT count(*) FROM qrels WHERE grade >= {strict}) AS supply FROM j GROUP BY 1)
SELECT query_id, returned, judged, returned - judged AS unjudged, round(CASE WHEN returned = 0 THEN 0.0::DOUBLE WHEN returned = judged THEN relevant / 5 END, 6) AS precision_at_k, round(relevant / 5, 6) AS precision_lower, round((relevant + returned - judged) / 5, 6) AS precision_upper,
  round(CASE WHEN judged > 0 THEN relevant / judged END, 6) AS precision_judged, round(dcg, 6) AS dcg, round(CASE WHEN unknown = 0 AND idcg > 0 THEN dcg / idcg END, 6) AS ndcg, CASE WHEN unknown > 0 THEN 'incomplete_scope' WHEN idcg <= 0 THEN 'no_relevant_supply' END AS ndcg_null_reason,
  round(CASE WHEN unknown = 0 AND supply > 0 THEN relevant / supply END, 6) AS recall, CASE WHEN unknown > 0 THEN 'incomplete_scope' WHEN supply <= 0 THEN 'no_relevant_supply' END AS recall_null_reason FROM g"""


_SETS = f"{_P}, sets AS (SELECT min(id) AS id, count(*) AS n, w FROM (SELECT id, list_sort({A.sql_tokens(_TEXT)}) AS w FROM papers) GROUP BY w), tk AS (SELECT id, len(w) AS size, unnest(w) AS t FROM sets), pr AS (SELECT x.id AS a, y.id AS b, round(count(*) / (any_value(x.size) + any_value(y.size) - count(*)), 9) AS score FROM tk x JOIN tk y ON x.t = y.t AND x.id < y.id GROUP BY 1, 2)"
_TRACE = f"""{RQ._sql_evidence(True)}, {_FAM}, pl AS (SELECT topic_id, id, family, CASE WHEN place <= 20 THEN place END AS candidate_rank FROM (SELECT topic_id, id, row_number() OVER (PARTITION BY topic_id ORDER BY evidence DESC, id) AS place FROM ev WHERE evidence >= 0.8) JOIN fam USING (id)),
kp AS (SELECT *, coalesce(candidate_rank = min(candidate_rank) OVER (PARTITION BY topic_id, family), false) AS kept FROM pl), rt AS (SELECT *, kept AND row_number() OVER (PARTITION BY topic_id ORDER BY kept DESC, candidate_rank) <= 3 AS returned FROM kp),
trace AS (SELECT t.topic_id, p.id, CASE WHEN rt.id IS NULL THEN 'topic_gate' WHEN candidate_rank IS NULL THEN 'candidate_truncation' WHEN NOT kept THEN 'deduplication' WHEN NOT returned THEN 'final_topk' END AS reason FROM papers p CROSS JOIN topics t LEFT JOIN rt ON rt.id = p.id AND rt.topic_id = t.topic_id)"""
_LONG = "l AS (SELECT * FROM (SELECT item_id, stratum, reviewer, unnest(['d0', 'd1', 'd2', 'd3']) AS dim, unnest([d0, d1, d2, d3]) AS score FROM ratings) WHERE score IS NOT NULL), pairs AS (SELECT dim, item_id, stratum, max(score) FILTER (k = 1) AS a, max(score) FILTER (k = 2) AS b FROM (SELECT *, row_number() OVER (PARTITION BY item_id, dim ORDER BY reviewer) AS k FROM l) GROUP BY 1, 2, 3 HAVING count(*) >= 2)"
_QUAL = "qual AS (SELECT item_id, stratum, round(sum(0.25::DOUBLE * ((a + b) / 2 - 1) / 4), 9) AS quality FROM pairs GROUP BY 1, 2 HAVING count(*) = 4)"
_SAMPLE = f"{A.SQL_RATINGS}, it AS (SELECT item_id, stratum FROM ratings WHERE reviewer = 1), smp AS (SELECT item_id, stratum, CAST(row_number() OVER (PARTITION BY stratum ORDER BY sha256('7303|' || item_id), item_id) AS INTEGER) AS draw, count(*) OVER (PARTITION BY stratum) AS population FROM it QUALIFY draw <= 25)"
_DIFF = f"""{A.SQL_BRANCHES}, v AS (SELECT seed, policy, network, unnest(['outputs', 'effort', 'completed', 'started']) AS metric, unnest([outputs::DOUBLE, effort::DOUBLE, completed::DOUBLE, started::DOUBLE]) AS value FROM branches),
p1 AS (SELECT 'policy' AS comparison, a.network AS stratum, a.policy AS treatment, a.metric, a.seed, a.value - b.value AS diff FROM v a JOIN v b ON a.seed = b.seed AND a.network = b.network AND a.metric = b.metric AND a.policy <> 'balanced' AND b.policy = 'balanced'),
p2 AS (SELECT 'network' AS comparison, a.policy AS stratum, 'open' AS treatment, a.metric, a.seed, a.value - b.value AS diff FROM v a JOIN v b ON a.seed = b.seed AND a.policy = b.policy AND a.metric = b.metric AND a.network = 'open' AND b.network = 'closed'),
p3 AS (SELECT 'policy_x_network' AS comparison, 'difference_in_differences' AS stratum, a.treatment, a.metric, a.seed, a.diff - b.diff AS diff FROM p1 a JOIN p1 b ON a.treatment = b.treatment AND a.metric = b.metric AND a.seed = b.seed AND a.stratum = 'open' AND b.stratum = 'closed'),
diffs AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)"""
_EFFECTS = "SELECT comparison, stratum, treatment, metric, count(*) AS n_pairs, round(avg(diff), 6) AS mean_difference FROM diffs"
_CHAIN = f"{A.SQL_LEDGER}, {A.SQL_MERGES}, c AS (SELECT project_id, project_id AS pos, 0 AS n FROM merges UNION ALL SELECT c.project_id, m.merged_into, n + 1 FROM c JOIN merges m ON m.project_id = c.pos WHERE m.merged_into IS NOT NULL), term AS (SELECT project_id, max_by(pos, n) AS terminal FROM c GROUP BY 1), eff AS (SELECT terminal, agent_id, CAST(sum(units) AS BIGINT) AS units FROM ledger JOIN term USING (project_id) GROUP BY 1, 2)"
_UTIL = f"{A.SQL_LEDGER}, u AS (SELECT project_id, action, round(avg(units) / 100, 6) AS utility FROM ledger GROUP BY 1, 2), e AS (SELECT *, exp((utility - max(utility) OVER (PARTITION BY project_id)) / 0.2::DOUBLE) AS e FROM u), sm AS (SELECT project_id, action, e / sum(e) OVER (PARTITION BY project_id) AS p FROM e)"
_HEX = " + ".join(f"(strpos('0123456789abcdef', h[{i + 1}]) - 1) * {16 ** (12 - i)}" for i in range(13))
_FACT = f"{_T}, {A.SQL_POLICIES}, fx AS (SELECT topic_id, memory, policy, left(sha256(topic_id || '|' || memory || '|' || policy), 16) AS case_id FROM topics CROSS JOIN (VALUES ('empty'), ('one'), ('many')) AS m(memory) CROSS JOIN policies)"

_SCHEMES = "SELECT * FROM (VALUES ('equal', 'd0', 0.25::DOUBLE), ('equal', 'd1', 0.25), ('equal', 'd2', 0.25), ('equal', 'd3', 0.25), " + ", ".join(f"('double_d{x}', 'd{y}', {0.4 if x == y else 0.2})" for x in range(4) for y in range(4)) + ") AS v(scheme, dim, w)"

ORACLES = {
    "exact_dup_clusters": f"WITH {_P}, {_FAM} SELECT min(id) AS cluster_id, count(*) AS size FROM fam GROUP BY family",
    "near_dup_pairs": f"WITH {_SETS} SELECT a, b, round(score, 6) AS score FROM pr WHERE score >= 0.8",
    "dup_components": f"WITH RECURSIVE {_SETS}, e AS (SELECT a, b FROM pr WHERE score >= 0.82 UNION ALL SELECT b, a FROM pr WHERE score >= 0.82), r AS (SELECT id AS a, id AS b FROM sets UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS id, min(b) AS component FROM r GROUP BY 1) SELECT p.id, component FROM (SELECT id, list_sort({A.sql_tokens(_TEXT)}) AS w FROM papers) AS p JOIN sets USING (w) JOIN c ON c.id = sets.id",
    "dup_pair_quality": f"WITH {_P}, {_FAM}, x AS (SELECT id, family, list_sort({A.sql_tokens(_TEXT)}) AS w FROM papers JOIN fam USING (id)), y AS (SELECT id, family, len(w) AS n, unnest(w) AS t FROM x), z AS (SELECT a.id AS a, b.id AS b, any_value(a.family) = any_value(b.family) AS same, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS score FROM y a JOIN y b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2), c AS (SELECT count(*) FILTER (same AND score >= 0.97) AS tp, count(*) FILTER (NOT same AND score >= 0.97) AS fp, (SELECT count(*) FROM fam a JOIN fam b ON a.family = b.family AND a.id < b.id) AS pos FROM z) SELECT tp, fp, pos - tp AS fn, round(tp / (tp + fp), 6) AS precision, CAST(tp / pos AS DOUBLE) AS recall FROM c",
    "import_aliases": f"WITH {_P}, {_FAM} SELECT id, canonical_id FROM (SELECT id, min(id) OVER (PARTITION BY family) AS canonical_id FROM fam) WHERE id <> canonical_id",
    "greedy_dup_clusters": f"WITH RECURSIVE {_RUN}, rt AS (SELECT query_id, id FROM run WHERE rank <= 20), {RQ.sql_clusters('rt', 'query_id', 0.6)} SELECT query_id, id, lead AS cluster_id FROM cl",
    "capped_topk": f"WITH {_RUN}, {_FAM}, f AS (SELECT query_id, id, rank FROM run JOIN fam USING (id) WHERE rank <= 20 QUALIFY row_number() OVER (PARTITION BY query_id, family ORDER BY rank) = 1) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS selected_rank, id FROM f QUALIFY selected_rank <= 3",
    "ranked_metrics": _metrics(1, False),
    "strict_metrics": _metrics(2, True),
    "selection_metrics": f"WITH {_RUN}, {_FAM}, {A.SQL_QRELS}, j AS (SELECT run.query_id, run.id, family, grade, rank <= 3 AS sel FROM run JOIN fam USING (id) LEFT JOIN qrels USING (id) WHERE rank <= 20), g AS (SELECT query_id, (SELECT count(DISTINCT family) FROM qrels JOIN fam USING (id) WHERE grade >= 1) AS gold, count(DISTINCT family) FILTER (sel AND grade >= 1) AS found, count(*) FILTER (sel AND grade >= 1) AS pos, count(grade) FILTER (sel) AS num, count(*) FILTER (sel AND grade IS NULL) AS unjudged, count(*) FILTER (sel) AS m FROM j GROUP BY 1), t AS (SELECT a.query_id, count(*) FILTER (a.family = b.family) AS dup FROM j a JOIN j b ON a.query_id = b.query_id AND a.id < b.id AND a.sel AND b.sel GROUP BY 1) SELECT query_id, round(CASE WHEN gold > 0 THEN found / least(3, gold) END, 6) AS capacity_coverage, round(CASE WHEN gold > 0 THEN found / gold END, 6) AS family_recall, round(CASE WHEN num > 0 THEN pos / num END, 6) AS document_precision, unjudged, round(CASE WHEN m > 1 THEN coalesce(dup, 0) / (m * (m - 1) / 2) ELSE 0 END, 6) AS duplicate_pair_ratio FROM g LEFT JOIN t USING (query_id)",
    "metrics_grouping_sets": f"WITH {_RUN}, {A.SQL_QRELS}, c AS (SELECT query_id, topic_id, k, count(grade) AS judged, count(*) FILTER (grade >= 1) AS rel FROM (SELECT * FROM run CROSS JOIN (VALUES (3), (5), (10)) AS v(k) WHERE rank <= k) LEFT JOIN qrels USING (id) GROUP BY 1, 2, 3) SELECT coalesce(topic_id, 'all') AS topic_id, k, count(*) AS n_queries, round(avg(CASE WHEN judged > 0 THEN rel / judged END), 6) AS mean_precision, round(avg(rel), 6) AS mean_relevant, round(avg(CASE WHEN judged = 0 THEN 1 ELSE 0 END), 6) AS unjudged_rate FROM c GROUP BY GROUPING SETS ((topic_id, k), (k))",
    "candidate_recall": f"WITH {_RUN}, {A.SQL_QRELS}, j AS (SELECT query_id, rank, grade FROM run LEFT JOIN qrels USING (id)) SELECT query_id, k, CAST(g AS INTEGER) AS grade_rule, round(CASE WHEN any_value(t) > 0 THEN CASE WHEN k = 'all' THEN any_value(held) ELSE count(*) FILTER (grade >= g AND rank <= try_cast(k AS INTEGER)) END / any_value(t) END, 6) AS recall FROM j CROSS JOIN (VALUES ('10'), ('20'), ('all')) AS a(k) CROSS JOIN (SELECT g, (SELECT count(*) FROM qrels WHERE grade >= g) AS t, (SELECT count(*) FROM qrels WHERE grade >= g AND id IN (SELECT id FROM papers)) AS held FROM (VALUES (1), (2)) AS v(g)) AS b GROUP BY query_id, k, g",
    "exclusion_trace": f"WITH {_TRACE} SELECT topic_id, reason, count(*) AS n FROM trace GROUP BY 1, 2",
    "loss_by_stage": f"WITH {_TRACE}, {A.SQL_QRELS}, j AS (SELECT topic_id, reason, coalesce(grade >= 1, false) AS rel FROM trace LEFT JOIN qrels USING (id)), st AS (SELECT * FROM (VALUES (0, 'topic_gate'), (1, 'candidate_truncation'), (2, 'deduplication'), (3, 'final_topk')) AS v(pos, stage)), c AS (SELECT t.topic_id, st.pos, st.stage, count(j.topic_id) FILTER (j.reason = st.stage) AS lost, count(*) FILTER (j.reason = st.stage AND rel) AS lost_relevant, count(*) FILTER (j.reason IS NULL OR (SELECT pos FROM st s2 WHERE s2.stage = j.reason) >= st.pos) AS entered, count(*) FILTER (rel AND (j.reason IS NULL OR (SELECT pos FROM st s2 WHERE s2.stage = j.reason) >= st.pos)) AS entered_relevant FROM topics t CROSS JOIN st JOIN j ON j.topic_id = t.topic_id GROUP BY 1, 2, 3) SELECT topic_id, stage, entered, lost, entered_relevant, lost_relevant, round(CASE WHEN entered_relevant > 0 THEN lost_relevant / entered_relevant END, 6) AS conditional_loss FROM c",
    "ranking_regression": f"WITH {_RUN}, {_JRUN}, {A.SQL_QRELS}, b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rb FROM hits QUALIFY rb <= 5), a AS (SELECT query_id, id, rank AS ra FROM run WHERE rank <= 5), f AS (SELECT * FROM a FULL JOIN b USING (query_id, id) LEFT JOIN qrels USING (id)) SELECT query_id, count(*) FILTER (ra IS NULL) AS entered, count(*) FILTER (rb IS NULL) AS exited, round(sum(coalesce((pow(2, grade) - 1) / log2(rb + 1), 0) - coalesce((pow(2, grade) - 1) / log2(ra + 1), 0)), 6) AS delta_dcg FROM f GROUP BY 1",
    "latest_revision": "SELECT user_id, event_type, event_id, event_id % 7 AS revision, round(value, 2) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 7 DESC, event_id) = 1",
    "label_views": f"WITH {A.SQL_RATINGS}, p AS (SELECT item_id, max(d0) FILTER (reviewer = 1) AS r1, max(d0) FILTER (reviewer = 2) AS r2, max(d1) FILTER (reviewer = 1) AS adj FROM ratings GROUP BY 1), v AS (SELECT 'reviewer01' AS view, r1 AS grade FROM p UNION ALL SELECT 'reviewer02', r2 FROM p UNION ALL SELECT 'final', CASE WHEN r1 = r2 THEN r1 ELSE adj END FROM p) SELECT view, grade, count(*) AS n FROM v GROUP BY 1, 2",
    "doc_overlap": f"WITH {_RUN}, {_JRUN}, b AS (SELECT query_id, id FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5), a AS (SELECT query_id, id FROM run WHERE rank <= 5), f AS (SELECT query_id, id, a.id IS NOT NULL AND b.id IS NOT NULL AS n_both FROM a FULL JOIN b USING (query_id, id)) SELECT query_id, round(count(*) FILTER (n_both) / count(*), 6) AS jaccard FROM f GROUP BY 1".replace("a.id IS NOT NULL AND b.id IS NOT NULL AS n_both FROM a FULL JOIN b USING (query_id, id)", "xa AND xb AS n_both FROM (SELECT query_id, id, bool_or(s = 1) AS xa, bool_or(s = 2) AS xb FROM (SELECT query_id, id, 1 AS s FROM a UNION ALL SELECT query_id, id, 2 FROM b) GROUP BY 1, 2)"),
    "topic_pair_overlap": f"WITH {RQ._LAB}, n AS (SELECT topic_id, count(*) AS n FROM lab GROUP BY 1), bb AS (SELECT x.topic_id AS a, y.topic_id AS b, count(*) AS n_both FROM lab x JOIN lab y ON x.id = y.id AND x.topic_id < y.topic_id GROUP BY 1, 2) SELECT x.topic_id AS a, y.topic_id AS b, CASE WHEN coalesce(n_both, 0) > 0 THEN 'shared' WHEN x.field = y.field THEN 'near' ELSE 'far' END AS relation, coalesce(n_both, 0) AS n_both, round(CASE WHEN coalesce(nx.n, 0) + coalesce(ny.n, 0) - coalesce(n_both, 0) > 0 THEN coalesce(n_both, 0) / (coalesce(nx.n, 0) + coalesce(ny.n, 0) - coalesce(n_both, 0)) END, 6) AS overlap FROM topics x JOIN topics y ON x.topic_id < y.topic_id LEFT JOIN bb ON bb.a = x.topic_id AND bb.b = y.topic_id LEFT JOIN n nx ON nx.topic_id = x.topic_id LEFT JOIN n ny ON ny.topic_id = y.topic_id",
    "coverage_regression": f"WITH {_RUN}, {_JRUN}, {A.SQL_QRELS}, b AS (SELECT topic_id, avg(CAST(grade >= 1 AS INTEGER)) AS baseline FROM run JOIN qrels USING (id) WHERE rank <= 3 GROUP BY 1), jr AS (SELECT query_id, id FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3), t AS (SELECT topic_id, avg(CAST(grade >= 1 AS INTEGER)) AS treatment FROM jr JOIN q USING (query_id) JOIN qrels USING (id) GROUP BY 1) SELECT topic_id, round(baseline, 6) AS baseline, round(treatment, 6) AS treatment, CASE WHEN treatment IS NULL THEN 'incomplete' WHEN baseline - treatment > 0.05 THEN 'failed' ELSE 'passed' END AS status FROM b LEFT JOIN t USING (topic_id)",
    "stratified_ratio_of_sums": f"WITH {_RUN}, {A.SQL_QRELS}, c AS (SELECT topic_id, 'p' || query_id % 3 AS policy, query_id, count(*) FILTER (grade >= 1) AS num, count(*) AS den FROM run JOIN qrels USING (id) WHERE rank <= 10 GROUP BY 1, 2, 3) SELECT coalesce(topic_id, 'all') AS topic_id, coalesce(policy, 'all') AS policy, count(*) AS n, round(CASE WHEN sum(den) > 0 THEN sum(num) / sum(den) END, 6) AS ratio FROM c GROUP BY GROUPING SETS ((topic_id, policy), (topic_id), ())",
    "shortfall_reasons": f"WITH {RQ._sql_evidence(True)}, {_FAM}, c AS (SELECT topic_id, count(*) AS n, count(DISTINCT family) AS f FROM ev JOIN fam USING (id) WHERE evidence >= 0.8 GROUP BY 1), j AS (SELECT topic_id, coalesce(n, 0) AS n, coalesce(f, 0) AS f FROM topics LEFT JOIN c USING (topic_id)) SELECT topic_id, n AS qualified, array_to_string(list_filter([CASE WHEN n = 0 THEN 'no_evidence' END, CASE WHEN n < 20 THEN 'pool_not_full' END, CASE WHEN f < n THEN 'duplicates_present' END, CASE WHEN f < 3 THEN 'too_few_distinct' END], lambda x: x IS NOT NULL), ',') AS reasons FROM j",
    "calibration_select": f"WITH {RQ._sql_jaccard(True)}, {A.SQL_QRELS}, s AS (SELECT score, grade >= 1 AS pos FROM hits JOIN qrels USING (id)), g AS (SELECT t AS threshold, count(*) FILTER (score >= t AND pos) AS tp, count(*) FILTER (score >= t AND NOT pos) AS fp, count(*) FILTER (score < t AND pos) AS fn FROM s CROSS JOIN (VALUES (0.0::DOUBLE), (0.02::DOUBLE), (0.04::DOUBLE), (0.06::DOUBLE), (0.08::DOUBLE), (0.1::DOUBLE)) AS v(t) GROUP BY t), f AS (SELECT *, round(coalesce(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 0), 6) AS f1 FROM g) SELECT threshold, tp, fp, fn, f1, row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS chosen FROM f",
    "rater_agreement": f"WITH {A.SQL_RATINGS}, {_LONG}, n AS (SELECT dim, count(*) AS n, avg(CAST(a = b AS INTEGER)) AS same, avg(CAST(abs(a - b) <= 1 AS INTEGER)) AS near, avg(pow((a - b) / 4, 2)) AS oq, avg(abs(a - b)) AS ol FROM pairs GROUP BY 1), ca AS (SELECT dim, a, count(*) AS c FROM pairs GROUP BY 1, 2), cb AS (SELECT dim, b, count(*) AS c FROM pairs GROUP BY 1, 2), e AS (SELECT dim, sum(ca.c * cb.c * pow((a - b) / 4, 2)) AS eq, sum(ca.c * cb.c * abs(a - b)) AS el FROM ca JOIN cb USING (dim) GROUP BY 1) SELECT dim, n AS common_items, round(same, 6) AS exact_rate, round(near, 6) AS within_one_rate, round(1 - oq * n * n / eq, 6) AS quadratic_kappa, round(1 - ol * n * n / el, 6) AS linear_kappa FROM n JOIN e USING (dim)",
    "quality_scores": f"WITH {A.SQL_RATINGS}, {_LONG}, {_QUAL} SELECT item_id, stratum, round(quality, 6) AS quality FROM qual",
    "review_analysis": f"WITH {_SAMPLE}, {_LONG}, sc AS ({_SCHEMES}), qs AS (SELECT scheme, item_id, round(sum(w * ((a + b) / 2 - 1) / 4), 9) AS quality FROM pairs JOIN sc USING (dim) GROUP BY 1, 2 HAVING count(*) = 4), dg AS (SELECT item_id, count(*) FILTER (abs(a - b) >= 2) AS k FROM pairs GROUP BY 1), g AS (SELECT sn.scheme, ['balanced', 'novelty', 'recognition'][smp.stratum % 3 + 1] AS policy, CASE WHEN smp.stratum < 3 THEN 'solo' ELSE 'team' END AS output_type, max(population) AS population, count(*) AS n, count(*) FILTER (quality IS NULL) AS missing, coalesce(sum(quality), 0) AS s, coalesce(sum(k), 0) AS k FROM smp CROSS JOIN (SELECT DISTINCT scheme FROM sc) AS sn LEFT JOIN qs ON qs.item_id = smp.item_id AND qs.scheme = sn.scheme LEFT JOIN dg ON dg.item_id = smp.item_id GROUP BY sn.scheme, smp.stratum) SELECT scheme, CASE WHEN grouping(policy) = 1 THEN 'all' ELSE policy END AS policy, CASE WHEN grouping(output_type) = 1 THEN 'all' ELSE output_type END AS output_type, CAST(sum(population) AS BIGINT) AS population, CAST(sum(n) AS BIGINT) AS n, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(k) AS BIGINT) AS disagreements, round(CASE WHEN sum(missing) = 0 THEN sum(population / n * s) END, 6) AS estimated_total, round(CASE WHEN sum(missing) = 0 THEN sum(population / n * s) / sum(population) END, 6) AS estimated_mean, round(sum(population / n * s), 6) AS lower_bound, round(sum(population / n * (s + missing)), 6) AS upper_bound FROM g GROUP BY GROUPING SETS ((scheme, policy, output_type), (scheme, policy), (scheme, output_type), (scheme))",
    "rating_disagreements": f"WITH {A.SQL_RATINGS}, {_LONG} SELECT item_id, dim, a AS reviewer_1_score, b AS reviewer_2_score, 'awaiting_third_party_adjudication' AS status FROM pairs WHERE abs(a - b) >= 2",
    "quality_sensitivity": f"WITH {A.SQL_RATINGS}, {_LONG}, sc AS (SELECT * FROM (VALUES ('equal', 'd0', 0.25::DOUBLE), ('equal', 'd1', 0.25), ('equal', 'd2', 0.25), ('equal', 'd3', 0.25), " + ", ".join(f"('double_d{x}', 'd{y}', {0.4 if x == y else 0.2})" for x in range(4) for y in range(4)) + ") AS v(scheme, dim, w)), qs AS (SELECT scheme, item_id, stratum, round(sum(w * ((a + b) / 2 - 1) / 4), 9) AS quality FROM pairs JOIN sc USING (dim) GROUP BY 1, 2, 3 HAVING count(*) = 4) SELECT scheme, coalesce(CAST(stratum AS VARCHAR), 'all') AS stratum, count(*) AS n, round(avg(quality), 6) AS mean_quality FROM qs GROUP BY GROUPING SETS ((scheme, stratum), (scheme))",
    "stratified_sample": f"WITH {_SAMPLE} SELECT item_id, stratum, draw, population, least(25, population) AS sample_size, round(least(25, population) / population, 9) AS inclusion_probability FROM smp",
    "ht_estimates": f"WITH {_SAMPLE}, {_LONG}, {_QUAL}, g AS (SELECT smp.stratum, max(population) AS population, count(*) AS n, count(*) FILTER (quality IS NULL) AS missing, coalesce(sum(quality), 0) AS s FROM smp LEFT JOIN qual USING (item_id) GROUP BY 1) SELECT stratum, population, n, missing, round(CASE WHEN missing = 0 THEN population / n * s END, 6) AS estimated_total, round(population / n * s, 6) AS lower_bound, round(population / n * (s + missing), 6) AS upper_bound FROM g",
    "coverage_status": f"WITH {A.SQL_RATINGS}, p AS (SELECT stratum, item_id, count(d0) AS k FROM ratings GROUP BY 1, 2), g AS (SELECT stratum, count(*) AS items, avg(CAST(k >= 1 AS INTEGER)) AS s, avg(CAST(k >= 2 AS INTEGER)) AS d FROM p GROUP BY 1) SELECT stratum, items, round(s, 6) AS submission_coverage, round(d, 6) AS double_coverage, CASE WHEN d = 1 THEN 'complete' WHEN s > 0 THEN 'partial' ELSE 'empty' END AS state FROM g",
    "paired_effects": f"WITH {_DIFF} {_EFFECTS} GROUP BY 1, 2, 3, 4",
    "did_effects": f"WITH {_DIFF} {_EFFECTS} WHERE comparison = 'policy_x_network' GROUP BY 1, 2, 3, 4",
    "bootstrap_ci": f"WITH {_DIFF}, o AS (SELECT *, row_number() OVER (PARTITION BY comparison, stratum, treatment, metric ORDER BY seed) - 1 AS i, count(*) OVER (PARTITION BY comparison, stratum, treatment, metric) AS n FROM diffs), dr AS (SELECT comparison, stratum, treatment, metric, n, rep, (rep * 7919 + i * 104729) % n AS pick FROM o CROSS JOIN range(200) AS r(rep)), m AS (SELECT d.comparison, d.stratum, d.treatment, d.metric, d.n, d.rep, round(sum(o.diff) / d.n, 6) AS mean FROM dr d JOIN o ON o.comparison = d.comparison AND o.stratum = d.stratum AND o.treatment = d.treatment AND o.metric = d.metric AND o.i = d.pick GROUP BY 1, 2, 3, 4, 5, 6) SELECT comparison, stratum, treatment, metric, n AS n_pairs, list_sort(list(mean))[5] AS ci_low, list_sort(list(mean))[195] AS ci_high FROM m GROUP BY 1, 2, 3, 4, 5",
    "flow_decomposition": f"WITH {A.SQL_BRANCHES} SELECT a.seed, a.network, a.policy, a.completed - b.completed AS delta_completed, a.started - b.started AS delta_started, a.completed - b.completed - (a.started - b.started) AS delta_rest FROM branches a JOIN branches b ON a.seed = b.seed AND a.network = b.network AND b.policy = 'balanced' AND a.policy <> 'balanced'",
    "merge_chain_effort": f"WITH RECURSIVE {_CHAIN} SELECT terminal, agent_id, units FROM eff",
    "author_credits": f"WITH RECURSIVE {_CHAIN} SELECT terminal, agent_id, round(units / sum(units) OVER (PARTITION BY terminal), 9) AS credit FROM eff WHERE units > 0",
    "project_flow": f"WITH RECURSIVE {_CHAIN}, la AS (SELECT project_id, last(action ORDER BY tick, entry_id) AS last, CAST(sum(units) AS BIGINT) AS units FROM ledger GROUP BY 1) SELECT CASE WHEN terminal <> project_id THEN 'merged' WHEN last IN ('error', 'exit') THEN 'abandoned' ELSE 'completed' END AS status, count(*) AS projects, CAST(sum(units) AS BIGINT) AS units FROM la JOIN term USING (project_id) GROUP BY 1",
    "accounting_checks": "SELECT * FROM (VALUES ('unique_entries', true), ('projects_conserved', true), ('units_conserved', true), ('credits_one', true)) AS v(\"check\", passed)",
    "entropy_by_project": f"WITH {A.SQL_LEDGER}, c AS (SELECT project_id, action, count(*) AS c FROM ledger GROUP BY 1, 2), p AS (SELECT project_id, c / sum(c) OVER (PARTITION BY project_id) AS p FROM c) SELECT project_id, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1",
    "action_rates": f"WITH {A.SQL_LEDGER}, g AS (SELECT project_id, count(*) AS n, count(*) FILTER (action = 'purchase') AS a, count(*) FILTER (action = 'click') AS c, sum(units) AS u FROM ledger GROUP BY 1) SELECT project_id, round(CASE WHEN a + c > 0 THEN a / (a + c) ELSE 0 END, 6) AS acceptance_rate, round(CASE WHEN u > 0 THEN 100 * n / u END, 6) AS outputs_per_100_effort FROM g",
    "cumulative_trajectory": f"WITH {A.SQL_LEDGER}, c AS (SELECT project_id, CAST(tick // 6 AS INTEGER) AS cycle, sum(units) AS units FROM ledger GROUP BY 1, 2) SELECT project_id, cycle, CAST(sum(units) OVER (PARTITION BY project_id ORDER BY cycle) AS BIGINT) AS units_so_far FROM c",
    "exit_successor": f"WITH {A.SQL_LEDGER}, m AS (SELECT project_id, agent_id, sum(units) AS units FROM ledger GROUP BY 1, 2), o AS (SELECT *, min(agent_id) OVER (PARTITION BY project_id) AS owner FROM m) SELECT project_id, first(agent_id ORDER BY units DESC, agent_id) AS successor FROM o WHERE agent_id <> owner GROUP BY 1",
    "budget_breach": f"WITH {A.SQL_LEDGER}, r AS (SELECT project_id, entry_id, sum(units) OVER (PARTITION BY project_id ORDER BY entry_id) AS run FROM ledger) SELECT project_id, min(entry_id) FILTER (run > 5000) AS breach_entry FROM r GROUP BY 1",
    "last_actions": f"WITH {A.SQL_LEDGER}, r AS (SELECT agent_id, entry_id, action FROM ledger QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY entry_id DESC) <= 12) SELECT agent_id, string_agg(action, ',' ORDER BY entry_id) AS memory FROM r GROUP BY 1",
    "softmax_probs": f"WITH {_UTIL} SELECT project_id, action, round(p, 6) AS p FROM sm",
    "keyed_choice": f"WITH {_UTIL}, k AS (SELECT project_id, action, round(sum(p) OVER (PARTITION BY project_id ORDER BY action), 9) AS run, max(action) OVER (PARTITION BY project_id) AS last, sha256('42|' || project_id) AS h FROM sm), x AS (SELECT *, ({_HEX}) / 4503599627370496 AS u FROM k) SELECT project_id, min(action) AS chosen FROM x WHERE run > u OR action = last GROUP BY 1",
    "candidate_schedule": f"WITH {A.SQL_LEDGER}, a AS (SELECT DISTINCT agent_id, agent_id % 3 AS f FROM ledger) SELECT x.agent_id AS leader, y.agent_id AS candidate, CASE WHEN x.f = y.f THEN 'same' ELSE 'other' END AS kind, CAST(row_number() OVER (PARTITION BY x.agent_id, x.f = y.f ORDER BY sha256(x.agent_id || '|' || y.agent_id), y.agent_id) AS INTEGER) AS place FROM a x JOIN a y ON x.agent_id <> y.agent_id QUALIFY place <= CASE WHEN kind = 'same' THEN 1 ELSE 2 END",
    "factorial_matrix": f"WITH {_FACT} SELECT * FROM fx",
    "resume_antijoin": f"WITH {_FACT} SELECT case_id, topic_id, memory, policy FROM fx WHERE policy <> 'novelty'",
    "state_leaks": f"WITH {A.SQL_BRANCHES} SELECT seed, network, count(DISTINCT policy) AS states FROM branches GROUP BY 1, 2 HAVING count(DISTINCT policy) > 1",
    "journal_chain_check": "SELECT CAST(user_id % 20 AS VARCHAR) AS branch, count(*) AS records, CAST(NULL AS BIGINT) AS first_bad, last(event_type || ':' || user_id ORDER BY event_id) AS last_payload FROM events GROUP BY 1",
}
