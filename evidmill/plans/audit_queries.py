"""Queries of the judgement and audit operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidmill.functions import text as T
from evidmill.operators import audits as U
from evidmill.operators import judgements as J
from evidmill.operators import ledger, matrix, review
from evidmill.operators import retrieval as R
from evidmill.operators.graph import written
from evidmill.plans import adapters as A
from evidmill.plans import retrieval_queries as RQ
from evidmill.plans import study_queries as SQ

CASES = ("relevance", "repaired")
POLICIES = ["novelty", "recognition"]


def _topic(c):
    return F.concat(F.lit("t"), F.lpad((c % 12).cast("string"), 2, "0"))


def _gold(s, d, families=None):
    """topic_id, family, grade: the best grade of a family's labelled papers, each of the topic of its number."""
    j = A.qrels(s, d).join(SQ._families(s, d) if families is None else families, "id")
    return j.groupBy(_topic(F.col("id").cast("bigint")).alias("topic_id"), "family").agg(F.max("grade").alias("grade"))


def _template(s, d):
    p = A.papers(s, d).select("id", R.content().alias("text"))
    j = A.qrels(s, d).join(SQ._families(s, d), "id").join(p, "id")
    return j.select(F.col("id").alias("review_id"), _topic(F.col("id").cast("bigint")).alias("topic_id"), "family", F.col("grade").alias("old_grade"), "text")


def _decisions(s, d):
    """Decisions of all kinds, right and wrong, by the number of the paper."""
    p = A.papers(s, d).select(F.col("id").alias("review_id"), F.col("id").cast("bigint").alias("n"), "title")
    kind = F.element_at(F.array(*map(F.lit, ["retain", "revise", "insufficient_information", "other"])), F.least(F.lit(4), F.col("n") % 10 + 1).cast("int"))
    kind = F.when(F.col("n") % 10 > 4, "revise").otherwise(kind)
    return p.select("review_id", F.when(F.col("n") % 13 == 0, "old").otherwise("v1").alias("review_version"), kind.alias("decision"), (F.col("n") % 4).cast("int").alias("grade"), F.when(F.col("n") % 11 != 0, "seen").alias("rationale"), F.when(F.col("n") % 17 == 0, "nowhere to be found").otherwise(F.upper(F.left("title", F.lit(12)))).alias("excerpt"), F.lit("r1").alias("reviewer_id"), F.when(F.col("n") % 23 != 0, "2026-01-01").alias("reviewed_at"), F.when(F.col("n") % 31 == 0, "other").otherwise("qrels-1").alias("base_hash"))


def _decided(s, d):
    return J.decided(_template(s, d), _decisions(s, d), "v1", "qrels-1")


def _history(s, d):
    r = A.ratings(s, d).distinct()
    return r.where("d0 <= 3").select("item_id", "reviewer", (F.col("d0") - 1).alias("score"), F.lit(False).alias("unsure"), F.lit("first").alias("rationale"), F.lit("day 1").alias("rated_at"), F.lit(1).alias("revision"), F.lit("").alias("change_reason"))


def _incoming(s, d):
    r = A.ratings(s, d).distinct()
    out = r.select("item_id", "reviewer", F.when(F.col("d1") <= 4, F.col("d1") - 1).alias("score"), F.col("d1").isNull().alias("unsure"), F.when(F.col("d2") != 5, "first").otherwise(F.when(F.col("d3") != 2, "later")).alias("rationale"), F.when(F.col("stratum") != 4, F.when(F.col("d3") != 4, "day 1").otherwise("day 2")).alias("rated_at"), F.coalesce(F.col("d3") % 3 + 1, F.lit(1)).alias("revision"), F.when(F.col("d3") > 2, "seen again").alias("change_reason"))
    return out.union(out.where("reviewer = 1 and score = 2 and revision = 3"))


def _rated(s, d):
    got = J.rating_import(_history(s, d), _incoming(s, d), A.ratings(s, d).where("stratum <> 5").select("item_id", "reviewer"))
    return got.groupBy("status").agg(F.count("*").alias("n"))


def _lifecycle(s, d):
    r = A.ratings(s, d).select("stratum", "item_id", "reviewer", "d0")
    received = r.where("stratum = 1 or (stratum > 1 and d0 is not null)").where("stratum <> 2 or reviewer = 1")
    return J.lifecycle(r, received, "stratum", ["item_id", "reviewer"])


def _blind(s, d):
    run = SQ._run(s, d)
    q = A.bench_queries(s, d)
    return J.migrated(run.select(F.concat_ws("-", F.col("query_id").cast("string"), "id").alias("old_id"), "query_id", "id"), q.where("query_id <> 3"), A.papers(s, d), "scope-1", partial=True)


def _records(s, d):
    n = F.col("place")
    p = A.papers(s, d).withColumn("place", F.col("id").cast("bigint"))
    doi = F.when(n % 5 == 0, F.concat(F.lit("https://doi.org/10.1/A"), F.floor(n / 15).cast("string"))).when(n % 7 == 0, F.concat(F.lit("10.1/a"), (n % 9).cast("string")))
    arxiv = F.when(n % 4 == 0, F.concat(F.lit("arXiv:2401."), F.lpad(F.floor(n / 12).cast("string"), 5, "0"), F.lit("v2")))
    return p.select("place", "id", "title", "abstract", "year", doi.alias("doi"), arxiv.alias("arxiv"))


def _family_map(s, d):
    f = SQ._families(s, d)
    first = F.min("id").over(R.W.partitionBy("family"))
    return f.withColumn("canonical", F.col("id") == first).withColumn("split", F.element_at(F.array(F.lit("dev"), F.lit("test")), (F.col("id").cast("bigint") % 2 + 1).cast("int")))


def _cases(s, d):
    families, sides = written(SQ._families(s, d), "families"), RQ._sides(s, d)
    gold = written(_gold(s, d, families).where("grade >= 1"), "gold")
    every = A.topics(s).select("topic_id").crossJoin(A.policies(s).select("policy"))
    out = None
    for v in CASES:
        base = RQ._base(s, d, v)
        part = U.case_metrics(RQ._selected(s, d, v, base, sides), base, families, gold, every).withColumn("ranker", F.lit(v))
        out = part if out is None else out.union(part)
    return written(out, "cases")


def _means(s, d):
    names = ["selected", "capacity_coverage", "family_recall", "document_precision", "candidate_family_coverage", "duplicate_pair_ratio"]
    return U.condition_means(_cases(s, d), ["ranker", "policy"], names)


def _challenge_rows(s, d):
    p = A.papers(s, d).withColumn("n", F.col("id").cast("bigint"))
    ev = R.qualified(p, A.topics(s), True).select("id", "topic_id", F.lit(True).alias("ok"))
    j = p.join(A.qrels(s, d), "id").withColumn("topic_id", _topic(F.col("n"))).join(ev, ["id", "topic_id"], "left")
    kinds = F.element_at(F.array(*map(F.lit, ["positive", "generic_negative", "context_negative"])), (F.col("n") % 3 + 1).cast("int"))
    return j.select(kinds.alias("challenge_type"), (F.col("year") < 2024).alias("eligible"), (F.col("grade") >= 1).alias("expected_positive"), F.coalesce("ok", F.lit(False)).alias("evidence_passed"))


def _challenges(s, d):
    return U.challenge_gate(_challenge_rows(s, d))


def _all_gates(s, d):
    """The seven gates; the ranking is of papers by evidence for each topic."""
    rank = lambda gold: R.ranked(R.qualified(A.papers(s, d), A.topics(s), True).select("topic_id", "id", "evidence"), ["topic_id"], [F.desc("evidence"), F.asc("id")], R.POOL)
    further = U.gold_changes(rank, _gold(s, d), "topic_id", "family", "grade").unionByName(U.negative_passes(_challenge_rows(s, d)))
    return U.quality_gates(U.topic_means(_cases(s, d)), "relevance", "repaired", "t03", 0.8, 0.5, 0.05, further)


def _runs(s, d):
    q = RQ._queries(s, d)
    j = R.jaccard_topk(A.papers(s, d), A.bench_queries(s, d), 20).join(q.select("query_id", "topic_id"), "query_id")
    cols = lambda r, name: r.select(F.lit(name).alias("ranker"), "query_id", "topic_id", "id", "rank")
    soft = R.soft_rerank(A.papers(s, d), q, A.topics(s)).join(q.select("query_id", "topic_id"), "query_id")
    return cols(SQ._run(s, d), "bm25").union(cols(j, "jaccard")).union(cols(soft, "soft"))


def _label_views(s, d):
    t = A.tables(s, d, "labels")[0].select(F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("id"), (F.col("quality") * 2).cast("int").alias("r1"), (F.col("quality") * (2 - F.col("toxic"))).cast("int").alias("r2"))
    final = F.when(F.col("r1") == F.col("r2"), F.col("r1"))
    return t.withColumn("final", final).select("id", F.expr("stack(3, 'reviewer01', r1, 'reviewer02', r2, 'final', final) AS (view, grade)"))


def _decision(s, d):
    runs, views = written(_runs(s, d), "runs"), _label_views(s, d)
    return U.decision_rule(U.view_metrics(runs, views, 5), U.view_metrics(runs, views, 3), "bm25")


def _peaks(s, d):
    q = RQ._queries(s, d)
    found = R.Evidenced(A.papers(s, d), q, A.topics(s))
    top = written(found.top(R.CANDIDATES), "top")
    # the largest score of a query is among its first candidates
    return U.denominators(top, top, found.evidence(), q), found


def _counterfactual(s, d):
    peaks, found = _peaks(s, d)
    return found.reranked(peaks.where("denominator_changed"))


def _branch_dups(s, d):
    p = A.papers(s, d).join(A.tables(s, d, "documents")[0].select(F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("id"), F.coalesce("lang", F.lit("none")).alias("branch")), "id")
    return U.branch_duplicates(p.select("branch", "id", T.normalized(R.content()).alias("key"), T.token_set(R.content()).alias("w")), "branch", 0.8)


def _agents(s, d):
    """Worlds are runs of 20 numbers, by whole division: as doubles, numbers beyond 2 ** 53 would fall into a neighbour's world.  Reputations are rounded as doubles, as in SQL: 323 / 80 has 4.037, its digits 4.038."""
    return A.ledger(s, d).groupBy("agent_id").agg((F.col("agent_id") % 3).alias("field"), (F.round(F.avg("units") * 1000) / 1000).alias("reputation"), F.countDistinct("action").alias("topics"), F.sum("units").alias("energy"), (F.max_by("action", "entry_id") != "error").alias("available"), F.expr("agent_id div 20").alias("world"))


def _offers(s, d):
    return matrix.schedule(SQ._agents(s, d), {"same": 1, "other": 2})


def _actionable(s, d):
    return U.actionable(_offers(s, d), _agents(s, d).select("agent_id", F.col("available").alias("active")))


def _requests(s, d):
    e = A.tables(s, d, "events")[0]
    pol = F.element_at(F.array(F.lit("balanced"), F.lit("novelty"), F.lit("recognition")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select((F.col("user_id") % 2).alias("model"), pol.alias("policy"), F.col("event_type").alias("stage"), F.floor(F.col("event_id") / 3).alias("draw"), F.when(F.col("value") < 90, "validated").otherwise("missing").alias("status"), (F.col("value") < 70).alias("first_pass"), F.col("value").between(70, 80).alias("repaired"), F.col("value").alias("latency"), F.round("value").cast("bigint").alias("tokens"), F.when(F.col("event_id") % 5 != 0, (F.col("user_id") % 3).cast("string")).alias("action"))


def _live(s, d):
    """A log of seeds, policies and networks: the query of a topic's reader, another one for the novelty policy of odd topics."""
    base = RQ._base(s, d, "relevance")
    sel = RQ._selected(s, d, "relevance", base).groupBy("topic_id", "policy").agg(F.array_sort(F.collect_list(F.struct("selected_rank", "id")))["id"].alias("selected"))
    n = F.substring("topic_id", 2, 2).cast("int")
    dims = s.createDataFrame([(x, net) for x in (42, 43) for net in ("closed", "open")], "seed int, network string").coalesce(1)
    query = F.when((n % 2 == 1) & (F.col("policy") == "novelty"), F.concat("topic_id", F.lit("x"))).otherwise(F.col("topic_id"))
    log = sel.crossJoin(F.broadcast(dims)).where((F.col("seed") != 43) | (F.col("policy") != "balanced") | (n != 4))
    log = log.select(F.format_string("seed_%d/%s_%s", "seed", "policy", "network").alias("branch"), F.when(n == 7, "topic").otherwise("retrieval").alias("stage"), F.lit("0.3").alias("schema_version"), n.alias("agent"), F.lit(6).alias("tick"), query.alias("query"), "selected")
    return U.live_diagnostics(log)


def _population(s, d):
    eff = ledger.effort_by_final_project(A.ledger(s, d), A.merges(s)).withColumnRenamed("terminal", "project_id")
    last = A.ledger(s, d).groupBy("project_id").agg(F.max_by("action", F.struct("tick", "entry_id")).alias("last"))
    proj = last.join(ledger.terminals(A.merges(s)), "project_id").select("project_id", F.when(F.col("terminal") != F.col("project_id"), "merged").when(F.col("last") == "error", "abandoned").otherwise("completed").alias("status"))
    return U.population(eff, proj, A.papers(s, d).select(F.col("id").cast("bigint").alias("project_id"), F.col("title").alias("text")))


def _export(s, d):
    p = A.papers(s, d).withColumn("abstract", F.left("abstract", F.lit(40)))
    public, key = U.blind_export(p.select("id", "field", "year", "title"), ["id", "field", "year"], ["title"], "round-1", sought=["id", "field"])
    return public.join(key, "review_id")


def _registry(s, d):
    p = A.papers(s, d)
    return U.registry(p.where("year < 2024"), p.withColumn("title", F.when(F.col("year") == 2016, F.lit("changed")).otherwise(F.col("title"))))


def _flat(s, d):
    g = A.ledger(s, d).groupBy("project_id").agg(F.array_sort(F.collect_set("agent_id")).alias("members"), F.array_sort(F.collect_list("entry_id")).alias("entries"), F.sum("units").alias("units"))
    return U.flattened(g)


QUERIES = {
    "gold_expansion": lambda s, d: J.expanded(_gold(s, d), SQ._families(s, d), A.papers(s, d), A.topics(s)),
    "gold_decisions": _decided,
    "gold_overlay": lambda s, d: J.overlaid(_gold(s, d), _decided(s, d)),
    "rating_import": _rated,
    "review_lifecycle": _lifecycle,
    "annotation_migration": _blind,
    "import_corpus": lambda s, d: J.imported(_records(s, d), 2026),
    "canonical_papers": lambda s, d: J.canonical(A.papers(s, d), _family_map(s, d)).select("id", "family"),
    "family_map_faults": lambda s, d: J.family_faults(_family_map(s, d)),
    "query_import_checks": lambda s, d: J.query_faults(RQ._queries(s, d).withColumn("split", F.when(F.col("query_id") % 9 == 0, "none").otherwise("test")), A.topics(s).where("topic_id <> 't05'"), ["dev", "test"]),
    "case_metrics": _cases,
    "topic_metrics": lambda s, d: U.topic_means(_cases(s, d)),
    "condition_means": _means,
    "quality_gates": lambda s, d: U.quality_gates(U.topic_means(_cases(s, d)), "relevance", "repaired", "t03", 0.8, 0.5, 0.05),
    "closure_gates": _all_gates,
    "historical_regression": lambda s, d: U.regression_slice(_cases(s, d), "relevance", "t03"),
    "challenge_gate": _challenges,
    "view_ranker_metrics": lambda s, d: U.view_metrics(_runs(s, d), _label_views(s, d), 5),
    "decision_rule": _decision,
    "normalization_denominators": lambda s, d: _peaks(s, d)[0],
    "counterfactual_ranking": _counterfactual,
    "branch_duplicates": _branch_dups,
    "candidate_pool_audit": lambda s, d: U.pool_audit(_offers(s, d), _agents(s, d)),
    "actionable_candidates": _actionable,
    "behaviour_metrics": lambda s, d: U.behaviour(_requests(s, d), ["model", "policy", "stage"]),
    "policy_changes": lambda s, d: U.policy_changes(_requests(s, d), ["model", "draw"], POLICIES),
    "live_retrieval_diagnostics": _live,
    "population_freeze": _population,
    "blind_export": _export,
    "observations": lambda s, d: U.observations(_agents(s, d), "world"),
    "dataset_registry": _registry,
    "sample_validation": lambda s, d: U.sample_faults(SQ._sample(s, d), "item_id"),
    "mock_reviews": lambda s, d: U.mock_reviews(A.bench_queries(s, d), ["mock_a", "mock_b"], "query_id"),
    "ledger_flat": _flat,
}

# ---- SQL ----

_P, _T, _TEXT, _Q, _FAM = RQ._P, RQ._T, RQ._TEXT, RQ._Q, SQ._FAM
_TID = "'t' || lpad(CAST(CAST(id AS BIGINT) % 12 AS VARCHAR), 2, '0')"
_GOLD = f"gold AS (SELECT {_TID} AS topic_id, family, max(grade) AS grade FROM qrels JOIN fam USING (id) GROUP BY 1, 2)"
_DEC = f"""{_P}, {_FAM}, {A.SQL_QRELS}, {_GOLD}, tp AS (SELECT id AS review_id, {_TID} AS topic_id, family, grade AS old_grade, {_TEXT} AS text FROM qrels JOIN fam USING (id) JOIN papers USING (id)),
dc AS (SELECT id AS review_id, CASE WHEN n % 13 = 0 THEN 'old' ELSE 'v1' END AS ver, CASE WHEN n % 10 > 4 THEN 'revise' ELSE ['retain', 'revise', 'insufficient_information', 'other'][least(4, n % 10 + 1)] END AS decision, CAST(n % 4 AS INTEGER) AS grade, n % 11 <> 0 AS why, trim(CASE WHEN n % 17 = 0 THEN 'nowhere to be found' ELSE upper(left(title, 12)) END) AS excerpt FROM (SELECT *, CAST(id AS BIGINT) AS n FROM papers)),
df AS (SELECT dc.*, topic_id, family, old_grade, CASE WHEN tp.review_id IS NULL OR ver <> 'v1' OR CAST(dc.review_id AS BIGINT) % 31 = 0 THEN 'unknown_review' WHEN decision = 'other' THEN 'invalid_decision' WHEN decision = 'revise' AND grade = 3 THEN 'invalid_grade' WHEN NOT why OR excerpt = '' OR CAST(dc.review_id AS BIGINT) % 23 = 0 THEN 'incomplete' WHEN NOT contains(lower(text), lower(excerpt)) THEN 'excerpt_not_in_text' END AS fault FROM dc LEFT JOIN tp USING (review_id)),
dd AS (SELECT review_id, topic_id, family, fault, CASE WHEN fault IS NULL THEN CASE decision WHEN 'retain' THEN old_grade WHEN 'revise' THEN grade END END AS proposed_grade FROM df)"""


def _sql_case(v: str) -> str:
    """cs: the cases of one variant."""
    return f"""SELECT * FROM (WITH RECURSIVE {RQ.sql_gated(v)}, {_FAM}, {A.SQL_QRELS}, {_GOLD}, gf AS (SELECT DISTINCT topic_id, family FROM gold WHERE grade >= 1), sj AS (SELECT sel.*, fam.family, gf.family IS NOT NULL AS rel FROM sel JOIN fam USING (id) LEFT JOIN gf ON gf.topic_id = sel.topic_id AND gf.family = fam.family),
sg AS (SELECT topic_id, policy, count(*) AS selected, CAST(sum(CAST(rel AS INTEGER)) AS BIGINT) AS relevant, count(DISTINCT family) FILTER (rel) AS found, count(*) - count(DISTINCT family) AS extra FROM sj GROUP BY 1, 2),
dpw AS (SELECT a.topic_id, a.policy, count(*) FILTER (a.family = b.family) / count(*) AS r FROM sj a JOIN sj b ON a.topic_id = b.topic_id AND a.policy = b.policy AND a.selected_rank < b.selected_rank GROUP BY 1, 2),
pl AS (SELECT topic_id, count(DISTINCT family) AS pooled FROM base JOIN fam USING (id) JOIN gf USING (topic_id, family) GROUP BY 1), sp AS (SELECT topic_id, count(*) AS gfn FROM gf GROUP BY 1),
j AS (SELECT topic_id, policy, coalesce(gfn, 0) AS gold_families, coalesce(selected, 0) AS selected, coalesce(relevant, 0) AS relevant, coalesce(found, 0) AS found, coalesce(pooled, 0) AS pooled, r FROM topics CROSS JOIN policies LEFT JOIN sp USING (topic_id) LEFT JOIN pl USING (topic_id) LEFT JOIN sg USING (topic_id, policy) LEFT JOIN dpw USING (topic_id, policy))
SELECT topic_id, policy, gold_families, selected, relevant, CASE WHEN gold_families > 0 THEN round(found / least(3, gold_families), 6) END AS capacity_coverage, CASE WHEN gold_families > 0 THEN round(found / gold_families, 6) END AS family_recall, CASE WHEN selected > 0 THEN round(relevant / selected, 6) END AS document_precision, CASE WHEN gold_families > 0 THEN round(pooled / gold_families, 6) END AS candidate_family_coverage, round(coalesce(r, 0), 6) AS duplicate_pair_ratio, selected = 0 AS empty_result, selected > 0 AND relevant = 0 AS all_irrelevant, '{v}' AS ranker FROM j)"""


_CASES = "cs AS (" + " UNION ALL ".join(_sql_case(v) for v in CASES) + ")"
_TMEANS = "tm AS (SELECT ranker, topic_id, count(*) AS n, count(capacity_coverage) AS coverage_denominator, round(avg(capacity_coverage), 6) AS mean_capacity_coverage, round(avg(document_precision), 6) AS mean_document_precision, CASE WHEN sum(selected) > 0 THEN round(sum(relevant) / sum(selected), 6) END AS micro_document_precision, count(*) FILTER (document_precision IS NULL) AS precision_null_count, count(*) FILTER (empty_result) AS empty_results, count(*) FILTER (all_irrelevant) AS all_irrelevant_returns FROM cs GROUP BY 1, 2)"
_METRICS = ["selected", "capacity_coverage", "family_recall", "document_precision", "candidate_family_coverage", "duplicate_pair_ratio"]
_VIEWS = "views AS (SELECT id, unnest(['reviewer01', 'reviewer02', 'final']) AS view, unnest([r1, r2, CASE WHEN r1 = r2 THEN r1 END]) AS grade FROM (SELECT lpad(CAST(doc_id AS VARCHAR), 19, '0') AS id, CAST(quality * 2 AS INTEGER) AS r1, CAST(quality * (2 - toxic) AS INTEGER) AS r2 FROM labels))"
_RUNS = f"""{RQ._SOFT.removeprefix('WITH ').rstrip()}, {SQ._JRUN}, run AS (SELECT 'bm25' AS ranker, query_id, topic_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm JOIN q USING (query_id) QUALIFY rank <= 20
UNION ALL SELECT 'jaccard', query_id, topic_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hits JOIN q USING (query_id) QUALIFY rank <= 20
UNION ALL SELECT 'soft', query_id, topic_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rank FROM (SELECT r.query_id, q.topic_id, r.id, r.rerank_score FROM r JOIN q USING (query_id)) QUALIFY rank <= 10), {_VIEWS}"""


def _sql_views(k: int, name: str) -> str:
    g = lambda p: f"(pow(2, grade) - 1) / log2({p} + 1)"
    return f"""{name}a AS (SELECT *, row_number() OVER (PARTITION BY view, ranker, query_id ORDER BY rank) AS place, row_number() OVER (PARTITION BY view, ranker, query_id ORDER BY grade DESC, rank) AS ideal FROM run JOIN views USING (id) WHERE grade IS NOT NULL),
{name}b AS (SELECT view, ranker, query_id, topic_id, coalesce(sum({g('place')}) FILTER (place <= {k}), 0) AS dcg, coalesce(sum({g('ideal')}) FILTER (ideal <= {k}), 0) AS idcg, count(*) FILTER (place <= {k} AND grade >= 1) / {k} AS p FROM {name}a GROUP BY 1, 2, 3, 4),
{name} AS (SELECT view, ranker, coalesce(topic_id, 'all') AS topic_id, count(*) AS n_queries, round(avg(CASE WHEN idcg > 0 THEN round(dcg / idcg, 9) END), 6) AS mean_ndcg, round(avg(p), 6) AS mean_precision FROM {name}b GROUP BY GROUPING SETS ((view, ranker, topic_id), (view, ranker)))"""


_PEAKS = f"""{RQ._sql_evidence(True)}, {RQ._BM25.replace(_P + ', ', '')}, tk AS (SELECT query_id, topic_id, id, score FROM bm JOIN q USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20),
pe AS (SELECT query_id, max(score) AS kb, max(coalesce(ev.evidence, 0)) AS kt FROM tk LEFT JOIN ev ON ev.topic_id = tk.topic_id AND ev.id = tk.id GROUP BY 1), al AS (SELECT query_id, max(score) AS ab FROM bm GROUP BY 1), mt AS (SELECT topic_id, max(evidence) AS atp FROM ev GROUP BY 1),
dn AS (SELECT query_id, topic_id, coalesce(kb, 0) AS kb, coalesce(ab, 0) AS ab, coalesce(kt, 0) AS kt, coalesce(atp, 0) AS atp FROM q LEFT JOIN pe USING (query_id) LEFT JOIN al USING (query_id) LEFT JOIN mt USING (topic_id)),
dc AS (SELECT *, abs(kb - ab) > 1e-9 OR abs(kt - atp) > 1e-9 AS ch FROM dn)"""
_AGENTS = f"{A.SQL_LEDGER}, ag AS (SELECT agent_id, agent_id % 3 AS field, round(avg(units), 3) AS reputation, count(DISTINCT action) AS topics, CAST(sum(units) AS BIGINT) AS energy, last(action ORDER BY entry_id) <> 'error' AS available, agent_id // 20 AS world FROM ledger GROUP BY 1)"
_OFFERS = f"{_AGENTS}, fa AS (SELECT DISTINCT agent_id, agent_id % 3 AS f FROM ledger), of AS (SELECT x.agent_id AS leader, y.agent_id AS candidate, CASE WHEN x.f = y.f THEN 'same' ELSE 'other' END AS kind, row_number() OVER (PARTITION BY x.agent_id, x.f = y.f ORDER BY sha256(x.agent_id || '|' || y.agent_id), y.agent_id) AS place FROM fa x JOIN fa y ON x.agent_id <> y.agent_id QUALIFY place <= CASE WHEN kind = 'same' THEN 1 ELSE 2 END)"
_REQ = "rq AS (SELECT user_id % 2 AS model, ['balanced', 'novelty', 'recognition'][event_id % 3 + 1] AS policy, event_type AS stage, event_id // 3 AS draw, value < 90 AS ok, value < 70 AS fp, value BETWEEN 70 AND 80 AS rp, value AS latency, CAST(round(value) AS BIGINT) AS tokens, CASE WHEN event_id % 5 <> 0 THEN CAST(user_id % 3 AS VARCHAR) END AS action FROM events)"
ORACLES = {
    "gold_expansion": f"WITH {_P}, {_T}, {_FAM}, {A.SQL_QRELS}, {_GOLD}, j AS (SELECT topic_id, papers.id, family, grade, contains(lower({_TEXT}), keywords[1]) AND contains(lower({_TEXT}), keywords[2]) AS ok FROM gold JOIN fam USING (family) JOIN papers ON papers.id = fam.id JOIN topics USING (topic_id) WHERE grade >= 1) SELECT topic_id, id, family, grade AS old_grade, CASE WHEN ok THEN 'supported' ELSE 'ambiguous' END AS status, CASE WHEN ok THEN grade END AS proposed_grade FROM j",
    "gold_decisions": f"WITH {_DEC} SELECT * FROM dd",
    "gold_overlay": f"WITH {_DEC}, o AS (SELECT topic_id, family, min(proposed_grade) AS new FROM dd WHERE fault IS NULL AND proposed_grade IS NOT NULL GROUP BY 1, 2 HAVING min(proposed_grade) = max(proposed_grade)) SELECT topic_id, family, coalesce(new, grade) AS grade, CASE WHEN new IS NULL THEN 'unreviewed_retained' ELSE 'revised' END AS decision_status FROM gold LEFT JOIN o USING (topic_id, family)",
    "rating_import": f"""WITH {A.SQL_RATINGS}, rt AS (SELECT DISTINCT * FROM ratings), h AS (SELECT item_id, reviewer, d0 - 1 AS score FROM rt WHERE d0 <= 3), i0 AS (SELECT item_id, stratum, reviewer, CASE WHEN d1 <= 4 THEN d1 - 1 END AS score, d1 IS NULL AS unsure, CASE WHEN d2 <> 5 THEN 'first' WHEN d3 <> 2 THEN 'later' END AS rationale, coalesce(d3 % 3 + 1, 1) AS revision, d3 > 2 AS changed, CASE WHEN stratum <> 4 THEN CASE WHEN d3 <> 4 THEN 'day 1' ELSE 'day 2' END END AS rated FROM rt),
inc AS (SELECT * FROM i0 UNION ALL SELECT * FROM i0 WHERE reviewer = 1 AND score = 2 AND revision = 3), j AS (SELECT inc.*, count(*) OVER (PARTITION BY inc.item_id, inc.reviewer) AS k, h.score AS os, h.item_id IS NOT NULL AS old FROM inc LEFT JOIN h ON h.item_id = inc.item_id AND h.reviewer = inc.reviewer)
SELECT CASE WHEN k > 1 THEN 'duplicate_row' WHEN stratum = 5 THEN 'unknown_item' WHEN (NOT unsure AND NOT coalesce(score IN (0, 1, 2), false)) OR rationale IS NULL OR rated IS NULL THEN 'incomplete' WHEN old AND score IS NOT DISTINCT FROM os AND NOT unsure AND rationale = 'first' AND rated = 'day 1' THEN 'unchanged' WHEN NOT old AND revision <> 1 THEN 'first_revision_not_one' WHEN old AND revision <= 1 THEN 'revision_not_higher' WHEN old AND NOT coalesce(changed, false) THEN 'no_change_reason' ELSE 'appended' END AS status, count(*) AS n FROM j GROUP BY 1""",
    "review_lifecycle": f"WITH {A.SQL_RATINGS}, g AS (SELECT stratum, count(*) AS requested, count(*) FILTER ((stratum = 1 OR (stratum > 1 AND d0 IS NOT NULL)) AND (stratum <> 2 OR reviewer = 1)) AS received FROM (SELECT DISTINCT stratum, item_id, reviewer, d0 FROM ratings) GROUP BY 1) SELECT *, CASE WHEN received = 0 THEN 'awaiting_external_reviews' WHEN received = requested THEN 'reviews_imported_complete' ELSE 'reviews_partially_imported' END AS status FROM g",
    "annotation_migration": f"WITH {SQ._RUN} SELECT run.query_id || '-' || run.id AS old_id, CASE WHEN run.query_id <> 3 THEN left(sha256(sha256(query) || '|' || sha256(title || '|' || abstract || '|' || year) || '|scope-1'), 24) END AS new_pair_id, run.query_id, run.id, CASE WHEN run.query_id <> 3 THEN 'matched' ELSE 'unmatched' END AS status FROM run JOIN q USING (query_id) JOIN papers ON papers.id = run.id WHERE rank <= 20",
    "canonical_papers": f"WITH {_P}, {_FAM} SELECT min(id) AS id, family FROM fam GROUP BY family",
    "family_map_faults": f"WITH {_P}, {_FAM} SELECT family, count(DISTINCT CAST(id AS BIGINT) % 2) AS splits, CAST(1 AS BIGINT) AS leaders FROM fam GROUP BY 1 HAVING count(DISTINCT CAST(id AS BIGINT) % 2) > 1",
    "query_import_checks": f"WITH {_Q}, o AS (SELECT count(*) FILTER (trim(coalesce(query, '')) = '') AS a, count(*) FILTER (topic_id = 't05') AS b, count(*) FILTER (query_id % 9 = 0) AS c, count(*) - count(DISTINCT query_id) AS d FROM q), r AS (SELECT unnest(['complete', 'known_topics', 'known_splits', 'distinct_ids']) AS \"check\", unnest([a, b, c, d]) AS n FROM o) SELECT \"check\", n = 0 AS passed, n FROM r",
    "case_metrics": f"WITH {_CASES} SELECT * FROM cs",
    "topic_metrics": f"WITH {_CASES}, {_TMEANS} SELECT * FROM tm",
    "condition_means": f"WITH {_CASES}, l AS (SELECT ranker, policy, unnest([{', '.join(repr(m) for m in _METRICS)}]) AS metric, unnest([{', '.join(f'CAST({m} AS DOUBLE)' for m in _METRICS)}]) AS value FROM cs) SELECT ranker, policy, metric, count(*) AS n, round(avg(value), 6) AS mean, CASE WHEN count(value) = 0 THEN 'no_defined_denominator' END AS null_reason FROM l GROUP BY 1, 2, 3",
    "quality_gates": f"WITH {_CASES}, {_TMEANS}, o AS (SELECT max(n.mean_capacity_coverage) FILTER (n.topic_id = 't03') AS a, avg(n.mean_capacity_coverage) AS b, min(n.mean_capacity_coverage) AS c, greatest(0, max(CASE WHEN x.mean_capacity_coverage >= 0.8 THEN x.mean_capacity_coverage - n.mean_capacity_coverage END)) AS d, CAST(sum(CASE WHEN n.mean_capacity_coverage IS NOT NULL THEN n.empty_results + n.all_irrelevant_returns END) AS DOUBLE) AS e FROM tm n LEFT JOIN tm x ON x.ranker = 'relevance' AND x.topic_id = n.topic_id WHERE n.ranker = 'repaired'), r AS (SELECT unnest(['named_topic', 'macro', 'minimum_topic', 'baseline_drop', 'zero_relevant_returns']) AS \"check\", unnest([a, b, c, d, e]) AS v, unnest([a >= 0.8, b >= 0.8, c >= 0.5, d <= 0.05, e = 0]) AS ok FROM o) SELECT \"check\", round(v, 6) AS value, coalesce(ok, false) AS passed FROM r",
    "historical_regression": f"WITH {_CASES} SELECT count(*) AS rows, round(avg(capacity_coverage), 6) AS mean_capacity_coverage, count(*) FILTER (capacity_coverage = 0) AS zero_cases FROM cs WHERE ranker = 'relevance' AND topic_id = 't03'",
    "challenge_gate": f"WITH {RQ._sql_evidence(True)}, {A.SQL_QRELS}, c AS (SELECT ['positive', 'generic_negative', 'context_negative'][CAST(papers.id AS BIGINT) % 3 + 1] AS ty, year < 2024 AS el, grade >= 1 AS ep, coalesce(evidence >= 0.8, false) AS ok FROM papers JOIN qrels USING (id) LEFT JOIN ev ON ev.id = papers.id AND ev.topic_id = 't' || lpad(CAST(CAST(papers.id AS BIGINT) % 12 AS VARCHAR), 2, '0')) SELECT coalesce(ty, 'all') AS challenge_type, count(*) AS annotations, count(*) FILTER (el) AS eligible, count(*) FILTER (el AND ep) AS expected_positive, count(*) FILTER (el AND ok) AS gate_passed, count(*) FILTER (el AND NOT ok) AS gate_rejected, round(CASE WHEN count(*) FILTER (el AND ep) > 0 THEN count(*) FILTER (el AND ep AND ok) / count(*) FILTER (el AND ep) END, 6) AS gate_recall, round(CASE WHEN count(*) FILTER (el AND NOT ep) > 0 THEN count(*) FILTER (el AND NOT ep AND ok) / count(*) FILTER (el AND NOT ep) END, 6) AS false_positive_rate FROM c GROUP BY GROUPING SETS ((ty), ())",
    "view_ranker_metrics": f"WITH {_RUNS}, {_sql_views(5, 'v5')} SELECT * FROM v5",
    "decision_rule": f"WITH {_RUNS}, {_sql_views(5, 'v5')}, {_sql_views(3, 'v3')}, f AS (SELECT x.ranker, x.topic_id, x.mean_ndcg - b.mean_ndcg AS d, coalesce(x.mean_ndcg + 1e-9 >= b.mean_ndcg, b.mean_ndcg IS NULL) AS ok FROM v5 x LEFT JOIN v5 b ON b.view = 'final' AND b.ranker = 'bm25' AND b.topic_id = x.topic_id WHERE x.view = 'final' AND x.ranker <> 'bm25'), g AS (SELECT ranker, max(d) FILTER (topic_id = 'all') AS d5, bool_and(ok OR topic_id = 'all') AS ok FROM f GROUP BY 1), p AS (SELECT x.ranker, x.mean_precision - b.mean_precision AS d3 FROM v3 x JOIN v3 b ON b.view = 'final' AND b.ranker = 'bm25' AND b.topic_id = 'all' WHERE x.view = 'final' AND x.topic_id = 'all') SELECT ranker, round(d5, 6) AS ndcg_at_5_difference, round(d3, 6) AS p_at_3_difference, ok AS all_topics_noninferior, d5 > 1e-9 AND d3 + 1e-9 >= 0 AND ok AS candidate FROM g JOIN p USING (ranker)",
    "normalization_denominators": f"WITH {_PEAKS} SELECT query_id, topic_id, round(kb, 6) AS k_bm25, round(ab, 6) AS all_bm25, round(kt, 6) AS k_topic, round(atp, 6) AS all_topic, ch AS denominator_changed, CASE WHEN ch THEN 'computed' ELSE 'not_needed' END AS counterfactual_status FROM dc",
    "counterfactual_ranking": f"WITH {_PEAKS}, x AS (SELECT dc.query_id, pw.id, round(CASE WHEN round(kb, 6) > 0 THEN coalesce(score, 0) / round(kb, 6) ELSE 0 END + 0.1::DOUBLE * CASE WHEN kt > 0 THEN coalesce(evidence, 0) / kt ELSE 0 END, 5) AS rerank_score FROM dc CROSS JOIN pw LEFT JOIN bm ON bm.query_id = dc.query_id AND bm.id = pw.id LEFT JOIN ev ON ev.topic_id = dc.topic_id AND ev.id = pw.id AND evidence > 0 WHERE ch AND (score IS NOT NULL OR evidence IS NOT NULL)) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS INTEGER) AS rank, id, rerank_score FROM x QUALIFY rank <= 10",
    "branch_duplicates": f"""WITH RECURSIVE {_P}, {_FAM}, b AS (SELECT papers.id, coalesce(lang, 'none') AS branch, family, {A.sql_tokens(_TEXT)} AS w FROM papers JOIN documents ON lpad(CAST(doc_id AS VARCHAR), 19, '0') = papers.id JOIN fam ON fam.id = papers.id),
pr AS (SELECT x.branch, x.id AS a, y.id AS b, x.family = y.family AS exact, round({RQ._JAC.format(a='x.w', b='y.w')}, 9) AS j FROM b x JOIN b y ON x.branch = y.branch AND x.id < y.id), e AS (SELECT a, b FROM pr WHERE exact OR j >= 0.8 UNION ALL SELECT b, a FROM pr WHERE exact OR j >= 0.8),
r AS (SELECT id AS a, id AS b FROM b UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a AS id, min(b) AS root FROM r GROUP BY 1), k AS (SELECT branch, root, count(*) AS n FROM b JOIN c USING (id) GROUP BY 1, 2), kc AS (SELECT branch, CAST(sum(n) AS BIGINT) AS outputs, count(*) AS unique_clusters, max(n) AS largest_cluster FROM k GROUP BY 1), pc AS (SELECT branch, count(*) AS m, count(*) FILTER (exact) AS x, count(*) FILTER (exact OR j >= 0.8) AS y FROM pr GROUP BY 1)
SELECT branch, outputs, round(x / m, 6) AS exact_duplicate_pair_rate, round(y / m, 6) AS near_duplicate_pair_rate, unique_clusters, largest_cluster, round((outputs - unique_clusters) / outputs, 6) AS redundant_output_rate FROM kc LEFT JOIN pc USING (branch)""",
    "candidate_pool_audit": f"WITH {_OFFERS} SELECT leader, count(*) AS offered_count, string_agg(CAST(candidate AS VARCHAR), ';' ORDER BY kind, place) AS candidate_ids, count(*) FILTER (kind = 'same') AS same_field_count, count(*) FILTER (kind <> 'same') AS other_field_count, round(avg(reputation), 6) AS mean_reputation, round(avg(topics), 6) AS mean_public_topic_count FROM of JOIN ag ON ag.agent_id = candidate GROUP BY 1",
    "actionable_candidates": f"WITH {_OFFERS} SELECT leader, count(*) AS offered_count, count(*) FILTER (available) AS actionable_count FROM of JOIN ag ON ag.agent_id = candidate GROUP BY 1",
    "behaviour_metrics": f"WITH {_REQ} SELECT model, policy, stage, count(*) AS n, count(*) FILTER (ok) AS valid, round(avg(CAST(coalesce(ok, false) AS INTEGER)), 6) AS valid_rate, round(avg(CAST(coalesce(fp, false) AS INTEGER)), 6) AS first_pass_rate, round(avg(CAST(coalesce(rp, false) AS INTEGER)), 6) AS repair_rate, round(1 - avg(CAST(coalesce(ok, false) AS INTEGER)), 6) AS missing_rate, round(avg(latency), 6) AS mean_latency, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM rq GROUP BY 1, 2, 3",
    "policy_changes": f"WITH {_REQ}, g AS (SELECT model, draw, max(action) FILTER (policy = 'balanced') AS c, max(action) FILTER (policy = 'novelty') AS n, max(action) FILTER (policy = 'recognition') AS r FROM rq WHERE action IS NOT NULL GROUP BY 1, 2) SELECT model, draw, unnest(['novelty', 'recognition']) AS treatment, unnest([n IS DISTINCT FROM c, r IS DISTINCT FROM c]) AS changed FROM g",
    "live_retrieval_diagnostics": f"""WITH RECURSIVE {RQ.sql_gated("relevance")}, sl AS (SELECT CAST(topic_id[2:] AS INTEGER) AS agent, policy, list(id) AS ids FROM sel GROUP BY 1, 2), lg AS (SELECT seed, network, agent, 6 AS tick, policy, agent % 2 = 1 AND policy = 'novelty' AS other, ids FROM sl CROSS JOIN (VALUES (42), (43)) AS a(seed) CROSS JOIN (VALUES ('closed'), ('open')) AS b(network) WHERE agent <> 7 AND NOT (seed = 43 AND policy = 'balanced' AND agent = 4)),
j AS (SELECT l.*, c.ids AS i0, CASE WHEN l.policy = 'balanced' OR c.ids IS NULL THEN 'control_or_missing_pair' WHEN l.other THEN 'query_changed_in_live_trajectory' END AS reason FROM lg l LEFT JOIN lg c ON c.policy = 'balanced' AND c.seed = l.seed AND c.network = l.network AND c.agent = l.agent)
SELECT seed, network, agent, tick, policy, CASE WHEN reason IS NULL THEN round(len(list_intersect(ids, i0)) / (len(ids) + len(i0) - len(list_intersect(ids, i0))), 6) END AS jaccard, CASE WHEN reason IS NULL THEN round(len(list_intersect(ids, i0)) / least(len(ids), len(i0)), 6) END AS intersection_over_min, reason FROM j""",
    "population_freeze": f"WITH RECURSIVE {SQ._CHAIN}, {_P}, la AS (SELECT project_id, last(action ORDER BY tick, entry_id) AS last FROM ledger GROUP BY 1), cb AS (SELECT terminal AS project_id, count(DISTINCT agent_id) AS k FROM eff WHERE units > 0 GROUP BY 1) SELECT la.project_id, CASE WHEN coalesce(k, 0) >= 2 THEN 'team' ELSE 'solo' END AS output_type, coalesce(k, 0) AS contributors, sha256(coalesce(title, '')) AS text_hash FROM la JOIN term USING (project_id) LEFT JOIN cb USING (project_id) LEFT JOIN papers ON CAST(papers.id AS BIGINT) = la.project_id WHERE terminal = la.project_id AND last <> 'error'",
    "blind_export": f"WITH {_P} SELECT 'rvw_' || left(sha256('round-1|' || id || '|' || field || '|' || year), 24) AS review_id, title, id, field, year FROM papers",
    "observations": f"WITH {_AGENTS} SELECT a.agent_id, a.energy, count(*) AS peers, count(*) FILTER (b.available) AS available_peers, string_agg(b.agent_id || ':' || b.field || ':' || CAST(b.reputation AS VARCHAR), ';' ORDER BY b.agent_id) AS public FROM ag a JOIN ag b ON a.world = b.world AND a.agent_id <> b.agent_id GROUP BY 1, 2",
    "dataset_registry": f"WITH {_P} SELECT * FROM (SELECT 'old' AS dataset, count(*) FILTER (year < 2024) AS documents FROM papers UNION ALL SELECT 'mixed', count(*) FROM papers UNION ALL SELECT 'challenge_only', count(*) FILTER (year >= 2024) FROM papers UNION ALL SELECT 'old_rows_altered', count(*) FILTER (year = 2016 AND title <> 'changed') FROM papers)",
    "sample_validation": f"WITH {SQ._SAMPLE}, o AS (SELECT count(*) - count(DISTINCT item_id) AS a, count(*) FILTER (draw > least(25, population)) AS b FROM smp) SELECT unnest(['distinct_ids', 'probabilities', 'draws', 'sizes']) AS \"check\", unnest([a = 0, true, b = 0, true]) AS passed, unnest([a, 0, b, 0]) AS n FROM o",
    "mock_reviews": "WITH r AS (SELECT item_id AS query_id, unnest(['mock_a', 'mock_b']) AS reviewer FROM benchmark), h AS (SELECT *, sha256(query_id || '|' || reviewer) AS h FROM r) SELECT query_id, reviewer, CAST(1 + (" + " + ".join(f"(strpos('0123456789abcdef', h[{i + 1}]) - 1) * {16 ** (3 - i)}" for i in range(4)) + ") % 5 AS INTEGER) AS score, true AS is_mock FROM h",
    "ledger_flat": f"WITH {A.SQL_LEDGER} SELECT project_id, array_to_string(list_sort(list(DISTINCT agent_id)), ';') AS members, array_to_string(list_sort(list(entry_id)), ';') AS entries, CAST(sum(units) AS BIGINT) AS units FROM ledger GROUP BY 1",
}

#: A ranking that doesn't look at judgements has no changed row.
ORACLES["closure_gates"] = (
    f"SELECT * FROM ({ORACLES['quality_gates']}) UNION ALL SELECT 'generic_negatives', v, coalesce(v = 0, false) FROM (WITH {RQ._sql_evidence(True)}, {A.SQL_QRELS} SELECT CAST(sum(CASE WHEN coalesce(evidence >= 0.8, false) THEN 1 ELSE 0 END) AS DOUBLE) AS v FROM papers JOIN qrels USING (id) "
    "LEFT JOIN ev ON ev.id = papers.id AND ev.topic_id = 't' || lpad(CAST(CAST(papers.id AS BIGINT) % 12 AS VARCHAR), 2, '0') WHERE year < 2024 AND CAST(papers.id AS BIGINT) % 3 <> 0) AS g UNION ALL SELECT 'gold_isolation', 0.0, true"
)
