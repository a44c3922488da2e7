"""Queries of the evaluation by (query, document) judgements over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidmill.operators import judged as J
from evidmill.operators import retrieval as R
from evidmill.operators.graph import written
from evidmill.plans import adapters as A
from evidmill.plans import retrieval_queries as RQ
from evidmill.plans import study_queries as SQ

RANKERS = ("bm25", "jaccard")


def grades(s, d, r):
    """view, query_id, id, grade: the first 8 of every ranking in ``r``, and labelled papers whose number fits the query's modulo 10.

    Two reviewers' grades follow from quality, toxicity and both numbers; some
    are unsure; the final grade is the common one, or else an adjudicated one,
    which some pairs lack.
    """
    lab, q = A.tables(s, d, "labels", "benchmark")
    pairs = lab.join(q.select(F.col("item_id").alias("query_id")), F.col("doc_id") % 10 == F.col("query_id") * 3 % 10).select("query_id", "doc_id")
    pool = r.where("rank <= 8").select("query_id", F.col("id").cast("bigint").alias("doc_id"))
    pairs = pairs.union(pool).distinct().join(lab, "doc_id", "left").na.fill({"quality": 1, "toxic": 0})
    n = F.col("doc_id") + F.col("query_id")
    r1 = F.when(n % 129 != 0, (F.col("quality") * 2 + n) % 3)
    r2 = F.when(n % 131 != 0, (F.col("quality") * (2 - F.col("toxic")) + n + F.when(n % 5 == 0, 1).otherwise(0)) % 3)
    x = pairs.select("query_id", F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("id"), r1.cast("int").alias("r1"), r2.cast("int").alias("r2"), F.when(n % 19 != 0, n % 3).cast("int").alias("adjudicated"))
    final = F.when(F.col("r1") == F.col("r2"), F.col("r1")).otherwise(F.col("adjudicated"))
    return written(x.withColumn("final", final).select("query_id", "id", F.expr("stack(3, 'reviewer01', r1, 'reviewer02', r2, 'final', final) AS (view, grade)")), "grades")


def cases(s, d):
    every = RQ._queries(s, d).select("query_id", "topic_id")
    return every.select(F.explode(F.array(*map(F.lit, RANKERS))).alias("ranker"), "query_id", "topic_id")


def runs(s, d):
    q = RQ._queries(s, d)
    cut = lambda r, name: r.select(F.lit(name).alias("ranker"), "query_id", "id", "rank")
    bm25 = R.bm25_topk(A.papers(s, d), q, 20)
    return written(cut(bm25, "bm25").union(cut(R.jaccard_topk(A.papers(s, d), A.bench_queries(s, d), 20), "jaccard")), "runs")


def _both(s, d):
    r = runs(s, d)
    return r, grades(s, d, r)


def _rows(s, d, both=None):
    r, g = both or _both(s, d)
    return J.metrics(r, cases(s, d), g)


def _losses(s, d):
    """First exclusion of each judged or ranked paper: not among the 20 ranked, an equal text before it, not among the first 3."""
    r, g = _both(s, d)
    r = r.join(SQ._families(s, d), "id")
    r = r.withColumn("kept", F.col("rank") == F.min("rank").over(R.W.partitionBy("ranker", "query_id", "family")))
    r = r.withColumn("place", F.sum(F.col("kept").cast("int")).over(R.W.partitionBy("ranker", "query_id").orderBy("rank")))
    every = g.select("query_id", "id").distinct().join(cases(s, d).select("ranker", "query_id"), "query_id")
    reason = F.when(F.col("rank").isNull(), "candidate_truncation").when(~F.col("kept"), "deduplication").when(F.col("place") > 3, "final_topk")
    trace = r.join(every, ["ranker", "query_id", "id"], "full").select("ranker", "query_id", "id", reason.alias("reason"))
    return J.stage_losses(written(trace, "trace"), g, STAGES)


def _changes(s, d):
    r, g = _both(s, d)
    return J.rank_change_totals(written(J.rank_changes(r, g, "bm25"), "changes"), _rows(s, d, (r, g)), "bm25")


def _recall(s, d):
    r, g = _both(s, d)
    return J.candidate_recall(r, A.papers(s, d), cases(s, d), g)


def _selection(s, d):
    r, g = _both(s, d)
    return J.selection(r, cases(s, d), SQ._families(s, d), g)


STAGES = ["candidate_truncation", "deduplication", "final_topk"]

QUERIES = {
    "judged_metrics": _rows,
    "judged_summary": lambda s, d: J.summary(_rows(s, d)),
    "judged_outcomes": lambda s, d: J.outcomes(_rows(s, d), "bm25"),
    "judged_candidate_recall": _recall,
    "judged_stage_losses": _losses,
    "judged_rank_changes": _changes,
    "judged_selection": _selection,
}

# ---- SQL ----

_GRADES = """pp AS (SELECT item_id AS query_id, doc_id FROM labels JOIN benchmark ON doc_id % 10 = item_id * 3 % 10 UNION SELECT query_id, CAST(id AS BIGINT) FROM rns WHERE rank <= 8),
pr AS (SELECT query_id, lpad(CAST(doc_id AS VARCHAR), 19, '0') AS id, coalesce(quality, 1) AS quality, coalesce(toxic, 0) AS toxic, doc_id + query_id AS n FROM pp LEFT JOIN labels USING (doc_id)),
rv AS (SELECT query_id, id, CAST(CASE WHEN n % 129 <> 0 THEN (quality * 2 + n) % 3 END AS INTEGER) AS r1, CAST(CASE WHEN n % 131 <> 0 THEN (quality * (2 - toxic) + n + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END) % 3 END AS INTEGER) AS r2, CAST(CASE WHEN n % 19 <> 0 THEN n % 3 END AS INTEGER) AS adj FROM pr),
gr AS (SELECT 'reviewer01' AS view, query_id, id, r1 AS grade FROM rv UNION ALL SELECT 'reviewer02', query_id, id, r2 FROM rv UNION ALL SELECT 'final', query_id, id, CASE WHEN r1 = r2 THEN r1 ELSE adj END FROM rv),
vw AS (SELECT * FROM (VALUES ('reviewer01'), ('reviewer02'), ('final')) AS v(view)),
sup AS (SELECT view, query_id, count(*) FILTER (grade >= 1) AS s1, count(*) FILTER (grade >= 2) AS s2, count(*) AS pairs, count(*) FILTER (grade IS NULL) AS open FROM gr GROUP BY 1, 2),
idl AS (SELECT view, query_id, k, sum((pow(2, grade) - 1) / log2(i + 1)) AS idcg, sum(CASE WHEN grade >= 2 THEN 1 / log2(i + 1) END) AS sidcg FROM (SELECT *, row_number() OVER (PARTITION BY view, query_id ORDER BY grade DESC, id) AS i FROM gr WHERE grade IS NOT NULL) CROSS JOIN (VALUES (3), (5), (10)) AS ks(k) WHERE i <= k GROUP BY 1, 2, 3)"""
_RUNS = f"{SQ._RUN}, {SQ._JRUN}, rns AS (SELECT 'bm25' AS ranker, query_id, id, rank FROM run WHERE rank <= 20 UNION ALL SELECT 'jaccard', query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM hits QUALIFY rank <= 20), cs AS (SELECT ranker, query_id, topic_id FROM q CROSS JOIN (VALUES ('bm25'), ('jaccard')) AS v(ranker))"
_ROWS = f"""{_RUNS}, {_GRADES},
jn AS (SELECT vw.view, rns.*, grade, gr.id IS NOT NULL AS seen FROM rns CROSS JOIN vw LEFT JOIN gr USING (view, query_id, id)),
ag AS (SELECT view, ranker, query_id, k, count(*) FILTER (rank <= k) AS returned, count(grade) FILTER (rank <= k) AS judged, count(*) FILTER (rank <= k AND seen AND grade IS NULL) AS unsure, count(*) FILTER (rank <= k AND grade >= 1) AS relevant, count(*) FILTER (rank <= k AND grade >= 2) AS strict,
  sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= k) AS dcg, sum(1 / log2(rank + 1)) FILTER (rank <= k AND grade >= 2) AS sdcg, count(*) FILTER (grade >= 1) AS hits FROM jn CROSS JOIN (VALUES (3), (5), (10)) AS ks(k) GROUP BY 1, 2, 3, 4),
fl AS (SELECT vw.view, cs.ranker, cs.query_id, cs.topic_id, ks.k, coalesce(returned, 0) AS returned, coalesce(judged, 0) AS judged, coalesce(unsure, 0) AS unsure, coalesce(relevant, 0) AS relevant, coalesce(strict, 0) AS strict, coalesce(dcg, 0) AS dcg, coalesce(sdcg, 0) AS sdcg, coalesce(hits, 0) AS hits, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2, coalesce(idcg, 0) AS idcg, coalesce(sidcg, 0) AS sidcg, coalesce(pairs, 0) > 0 AND open = 0 AS complete
  FROM cs CROSS JOIN vw CROSS JOIN (VALUES (3), (5), (10)) AS ks(k) LEFT JOIN ag ON ag.view = vw.view AND ag.ranker = cs.ranker AND ag.query_id = cs.query_id AND ag.k = ks.k LEFT JOIN sup ON sup.view = vw.view AND sup.query_id = cs.query_id LEFT JOIN idl ON idl.view = vw.view AND idl.query_id = cs.query_id AND idl.k = ks.k),
met AS (SELECT view, ranker, query_id, topic_id, k, returned, k - returned AS shortfall, returned = 0 AS empty, judged, returned - judged - unsure AS unjudged, unsure, s1 AS supply,
  round(CASE WHEN returned = 0 THEN 0.0::DOUBLE WHEN returned = judged THEN relevant / k END, 6) AS precision_at_k, round(relevant / k, 6) AS precision_lower, round((relevant + returned - judged) / k, 6) AS precision_upper, round(CASE WHEN judged > 0 THEN relevant / judged END, 6) AS precision_judged, round(dcg, 6) AS dcg,
  round(CASE WHEN complete AND idcg > 0 THEN dcg / idcg END, 6) AS ndcg, CASE WHEN NOT coalesce(complete, false) THEN 'incomplete_scope' WHEN idcg <= 0 THEN 'no_relevant_supply' END AS ndcg_null_reason,
  round(CASE WHEN complete AND s1 > 0 THEN relevant / s1 END, 6) AS recall, CASE WHEN NOT coalesce(complete, false) THEN 'incomplete_scope' WHEN s1 = 0 THEN 'no_relevant_supply' END AS recall_null_reason,
  round(CASE WHEN returned = judged THEN strict / k END, 6) AS strict_precision, round(CASE WHEN complete AND s2 > 0 THEN sdcg / sidcg END, 6) AS strict_ndcg, round(CASE WHEN complete AND s2 > 0 THEN strict / s2 END, 6) AS strict_recall,
  CASE WHEN NOT coalesce(complete, false) THEN 'incomplete_scope' WHEN s2 = 0 THEN 'no_strict_supply' END AS strict_null_reason, round(CASE WHEN complete AND s1 > 0 THEN hits / s1 END, 6) AS candidate_recall FROM fl)"""
_FAMS = f"fam AS (SELECT id, md5(array_to_string({A.sql_words(SQ._TEXT)}, ' ')) AS family FROM papers)"

ORACLES = {
    "judged_metrics": f"WITH {_ROWS} SELECT * FROM met",
    "judged_summary": f"WITH {_ROWS} SELECT view, CASE WHEN grouping(topic_id) = 1 THEN 'all' ELSE topic_id END AS topic_id, ranker, k, count(*) AS n_queries, {', '.join(f'round(avg({m}), 9) AS mean_{m}' for m in J.MEANS)}, round(avg(CASE WHEN empty THEN 1 ELSE 0 END), 9) AS empty_rate, count(*) FILTER (ndcg IS NULL) AS null_ndcg, count(*) FILTER (precision_at_k IS NULL) AS null_precision FROM met GROUP BY GROUPING SETS ((view, topic_id, ranker, k), (view, ranker, k))",
    "judged_outcomes": f"WITH {_ROWS} SELECT a.view, a.query_id, a.topic_id, a.ranker, round(a.ndcg - b.ndcg, 6) AS ndcg_difference, round(a.precision_at_k - b.precision_at_k, 6) AS precision_difference, CASE WHEN a.ndcg - b.ndcg > 1e-12 THEN 'win' WHEN a.ndcg - b.ndcg < -1e-12 THEN 'loss' WHEN a.ndcg - b.ndcg IS NOT NULL THEN 'tie' END AS outcome FROM met a JOIN met b ON a.view = b.view AND a.query_id = b.query_id AND a.k = 5 AND b.k = 5 AND a.ranker = 'jaccard' AND b.ranker = 'bm25'",
    "judged_candidate_recall": f"WITH {_RUNS}, {_GRADES}, c AS (SELECT vw.view, cs.ranker, cs.query_id, kk AS k, g AS grade_rule FROM cs CROSS JOIN vw CROSS JOIN (VALUES ('10', 10), ('20', 20), ('all', NULL)) AS a(kk, kn) CROSS JOIN (VALUES (1), (2)) AS b(g)), h AS (SELECT view, ranker, query_id, k, grade_rule, count(gr.id) AS retrieved FROM c JOIN gr USING (view, query_id) LEFT JOIN rns USING (ranker, query_id, id) WHERE grade >= grade_rule AND CASE WHEN k = 'all' THEN gr.id IN (SELECT id FROM papers) ELSE rank <= try_cast(k AS INTEGER) END GROUP BY ALL), t AS (SELECT c.*, coalesce(CASE grade_rule WHEN 1 THEN s1 ELSE s2 END, 0) AS relevant_total, coalesce(retrieved, 0) AS retrieved, coalesce(open, 0) AS unsure, coalesce(pairs, 0) > 0 AND open = 0 AS complete FROM c LEFT JOIN sup USING (view, query_id) LEFT JOIN h USING (view, ranker, query_id, k, grade_rule)) SELECT view, ranker, query_id, k, grade_rule, relevant_total, retrieved, round(CASE WHEN complete AND relevant_total > 0 THEN retrieved / relevant_total END, 6) AS recall, CASE WHEN NOT coalesce(complete, false) THEN 'partial' WHEN relevant_total > 0 THEN 'complete' ELSE 'no_relevant_supply' END AS status, unsure FROM t",
    "judged_stage_losses": f"WITH {_RUNS}, {_GRADES}, {_FAMS}, kp AS (SELECT rns.*, rank = min(rank) OVER (PARTITION BY ranker, query_id, family) AS kept FROM rns JOIN fam USING (id)), pl AS (SELECT *, sum(CASE WHEN kept THEN 1 ELSE 0 END) OVER (PARTITION BY ranker, query_id ORDER BY rank) AS place FROM kp), ev AS (SELECT DISTINCT ranker, query_id, id FROM (SELECT DISTINCT query_id, id FROM gr) JOIN cs USING (query_id)), tr AS (SELECT ranker, query_id, id, CASE WHEN rank IS NULL THEN 1 WHEN NOT kept THEN 2 WHEN place > 3 THEN 3 ELSE 4 END AS pos FROM pl FULL JOIN ev USING (ranker, query_id, id)), x AS (SELECT vw.view, tr.*, coalesce(grade >= 1, false) AS rel FROM tr CROSS JOIN vw LEFT JOIN gr USING (view, query_id, id)), sg AS (SELECT * FROM (VALUES (1, 'candidate_truncation'), (2, 'deduplication'), (3, 'final_topk')) AS v(p, stage)), a AS (SELECT view, query_id, ranker, stage, count(*) FILTER (pos >= p) AS entered, count(*) FILTER (pos > p) AS retained, count(*) FILTER (pos = p) AS lost, count(*) FILTER (pos >= p AND rel) AS entered_relevant, count(*) FILTER (pos = p AND rel) AS lost_relevant, count(*) FILTER (pos > p AND rel) AS left_rel, count(*) FILTER (rel) AS nrel, count(*) FILTER (pos = 4) AS returned FROM x CROSS JOIN sg GROUP BY 1, 2, 3, 4) SELECT view, query_id, ranker, stage, entered, retained, lost, entered_relevant, lost_relevant, round(CASE WHEN entered_relevant > 0 THEN lost_relevant / entered_relevant END, 6) AS conditional_loss, CASE WHEN entered_relevant = 0 THEN 'no_entering_relevant_documents' END AS conditional_null_reason, round(CASE WHEN nrel > 0 THEN left_rel / nrel END, 6) AS cumulative_retention, CASE WHEN nrel = 0 THEN 'no_relevant_documents' END AS cumulative_null_reason, returned FROM a",
    "judged_rank_changes": f"WITH {_ROWS}, d AS (SELECT query_id, id, max(rank) FILTER (ranker = 'bm25') AS ra, max(rank) FILTER (ranker = 'jaccard') AS rb FROM rns GROUP BY 1, 2), e AS (SELECT vw.view, d.*, round(CASE WHEN rb <= 5 THEN coalesce((pow(2, grade) - 1) / log2(rb + 1), 0) ELSE 0 END - CASE WHEN ra <= 5 THEN coalesce((pow(2, grade) - 1) / log2(ra + 1), 0) ELSE 0 END, 6) AS delta FROM d CROSS JOIN vw LEFT JOIN gr USING (view, query_id, id)), t AS (SELECT view, query_id, {', '.join(f'count(*) FILTER (rb <= {n} AND coalesce(ra > {n}, true)) AS entered_top{n}, count(*) FILTER (ra <= {n} AND coalesce(rb > {n}, true)) AS exited_top{n}' for n in (3, 5))}, sum(delta) AS total FROM e GROUP BY 1, 2) SELECT a.view, a.ranker, a.query_id, {', '.join(f'coalesce({w}_top{n}, 0) AS {w}_top{n}' for n in (3, 5) for w in ('entered', 'exited'))}, round(coalesce(total, 0), 4) AS dcg_difference, abs(coalesce(total, 0) - (a.dcg - b.dcg)) < 1e-4 AS conserved FROM met a JOIN met b ON a.view = b.view AND a.query_id = b.query_id AND a.k = 5 AND b.k = 5 AND a.ranker = 'jaccard' AND b.ranker = 'bm25' LEFT JOIN t ON t.view = a.view AND t.query_id = a.query_id",
    "judged_selection": f"WITH {_RUNS}, {_GRADES}, {_FAMS}, gd AS (SELECT view, query_id, count(DISTINCT family) AS gold FROM gr JOIN fam USING (id) WHERE grade >= 1 GROUP BY 1, 2), jn AS (SELECT vw.view, rns.*, family, grade, gr.id IS NOT NULL AS seen FROM rns CROSS JOIN vw LEFT JOIN fam USING (id) LEFT JOIN gr USING (view, query_id, id)), a AS (SELECT view, ranker, query_id, count(DISTINCT family) FILTER (rank <= 3 AND grade >= 1) AS found, count(DISTINCT family) FILTER (grade >= 1) AS cand, count(*) FILTER (rank <= 3) AS m, count(grade) FILTER (rank <= 3) AS num, count(*) FILTER (rank <= 3 AND grade >= 1) AS pos, count(*) FILTER (rank <= 3 AND seen AND grade IS NULL) AS unsure, count(*) FILTER (rank <= 3 AND NOT seen) AS unjudged FROM jn GROUP BY 1, 2, 3), tw AS (SELECT x.view, x.ranker, x.query_id, count(*) AS twins FROM jn x JOIN jn y ON x.view = y.view AND x.ranker = y.ranker AND x.query_id = y.query_id AND x.family = y.family AND x.rank < y.rank AND y.rank <= 3 GROUP BY 1, 2, 3), f AS (SELECT vw.view, cs.ranker, cs.query_id, coalesce(gold, 0) AS gold, coalesce(found, 0) AS found, coalesce(cand, 0) AS cand, coalesce(m, 0) AS m, coalesce(num, 0) AS num, coalesce(pos, 0) AS pos, coalesce(unsure, 0) AS unsure, coalesce(unjudged, 0) AS unjudged, coalesce(twins, 0) AS twins FROM cs CROSS JOIN vw LEFT JOIN a ON a.view = vw.view AND a.ranker = cs.ranker AND a.query_id = cs.query_id LEFT JOIN gd ON gd.view = vw.view AND gd.query_id = cs.query_id LEFT JOIN tw ON tw.view = vw.view AND tw.ranker = cs.ranker AND tw.query_id = cs.query_id) SELECT view, ranker, query_id, gold AS gold_families, round(CASE WHEN gold > 0 THEN found / least(3, gold) END, 6) AS capacity_coverage, round(CASE WHEN gold > 0 THEN found / gold END, 6) AS family_recall, round(CASE WHEN gold > 0 THEN cand / gold END, 6) AS candidate_family_recall, round(CASE WHEN num > 0 THEN pos / num END, 6) AS document_precision, unjudged, unsure, m AS selected, m = 0 AS empty, m > 0 AND num = m AND pos = 0 AS all_irrelevant, round(CASE WHEN m > 1 THEN twins / (m * (m - 1) / 2) ELSE 0 END, 6) AS duplicate_pair_ratio FROM f",
}
