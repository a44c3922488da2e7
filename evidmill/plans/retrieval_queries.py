"""Queries of the retrieval operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidmill.functions import text as T
from evidmill.operators import retrieval as R
from evidmill.operators.graph import written
from evidmill.plans import adapters as A


def _labels(s, d):
    return R.classified(A.papers(s, d), A.topics(s))


def _queries(s, d):
    n = len(A.TOPICS)
    return A.bench_queries(s, d).withColumn("topic_id", F.concat(F.lit("t"), F.lpad((F.col("query_id") % n).cast("string"), 2, "0")))


def _pool(variant):
    return lambda s, d: R.gate_pool(A.papers(s, d), A.topics(s), variant, A.memory(s)).select("topic_id", "id", "candidate_rank", F.round("evidence", 6).alias("evidence"), F.round("raw", 6).alias("raw"), F.round("relevance", 6).alias("relevance"))


def _base(s, d, variant):
    return written(R.base_pool(A.papers(s, d), A.topics(s), variant, A.memory(s)), "pool")


def _sides(s, d):
    """Labels, and what readers have read: written, as every selection needs the same."""
    return written(_labels(s, d), "labels"), written(A.reads(s, d), "reads")


def _selected(s, d, variant, base, sides=None):
    labels, reads = sides or _sides(s, d)
    return R.gated(A.papers(s, d), A.topics(s), A.policies(s), R.attention(labels, A.topics(s)), labels, variant, reads, A.memory(s), base)


def _gated(mode):
    def run(s, d):
        labels, reads = _sides(s, d)
        return R.retrieve(mode, A.papers(s, d), A.topics(s), A.policies(s), R.attention(labels, A.topics(s)), labels, reads, A.memory(s))

    return run


def _fallbacks(s, d):
    out, sides = None, _sides(s, d)
    for variant in ("relevance", "fixed", "guarded", "repaired"):
        base = _base(s, d, variant)
        part = R.fallbacks(base, _selected(s, d, variant, base, sides), A.topics(s), A.policies(s), variant).withColumn("variant", F.lit(variant))
        out = part if out is None else out.union(part)
    return out


def _memories(s, d):
    out = None
    for variant in ("relevance", "fixed", "repaired"):
        part = R.memory_words(A.memory(s), A.topics(s), variant).select(F.lit(variant).alias("variant"), "topic_id", F.array_join(F.array_sort("words"), " ").alias("words"))
        out = part if out is None else out.union(part)
    return out


def _built(s, d):
    out = None
    for fixed in (False, True):
        q = R.built_queries(A.topics(s), A.memory(s), fixed)
        part = q.select(F.lit("fixed" if fixed else "relevance").alias("variant"), "topic_id", *[F.array_join(F.array_sort(c), " ").alias(n) for c, n in (("qt", "topic_words"), ("qf", "field_words"), ("qm", "memory_words"))])
        out = part if out is None else out.union(part)
    return out


def _probes(s, d):
    """Overlap of selections: one query under two policies, two topics, and two spellings of one free query."""
    base = _base(s, d, "relevance")
    sel = written(_selected(s, d, "relevance", base), "selected")
    ids = lambda t, p: sel.where((F.col("topic_id") == t) & (F.col("policy") == p)).agg(F.array_sort(F.collect_list(F.struct("selected_rank", "id")))["id"].alias("ids"))
    words = ["ther", "thon", "agents"]
    free = s.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words, words[::-1]))], "query_id int, query string").coalesce(1)
    top = written(R.jaccard_topk(A.papers(s, d), free), "selected")
    legacy = lambda i: top.where(F.col("query_id") == i).agg(F.array_sort(F.collect_list(F.struct("rank", "id")))["id"].alias("ids"))
    sides = [
        ("same_query_balanced_vs_novelty", ids("t00", "balanced"), ids("t00", "novelty")),
        ("same_query_balanced_vs_recognition", ids("t00", "balanced"), ids("t00", "recognition")),
        ("changed_topic", ids("t00", "balanced"), ids("t01", "balanced")),
        ("legacy_equivalent_expression", legacy(0), legacy(1)),
    ]
    out = None
    for name, left, right in sides:
        j = left.withColumnRenamed("ids", "a").crossJoin(right.withColumnRenamed("ids", "b"))  # a row each
        part = j.select(F.lit(name).alias("comparison"), *T.overlaps(F.col("a"), F.col("b")), F.array_join("a", ";").alias("left_selected"), F.array_join("b", ";").alias("right_selected"))
        out = part if out is None else out.union(part)
    return out


def _recognition(s, d):
    labels = _labels(s, d)
    return R.recognition(A.papers(s, d), labels, R.attention(labels, A.topics(s)))


def _audit(s, d):
    base = _base(s, d, "relevance")
    sel = written(_selected(s, d, "relevance", base), "selected")
    return R.audit_metrics(base, sel, _labels(s, d), R.fallbacks(base, sel, A.topics(s), A.policies(s), "relevance"))


def _evidence(bounded):
    return lambda s, d: R.evidence(A.papers(s, d), A.topics(s), bounded).where("evidence > 0 or generic_only").select("topic_id", "id", "evidence", "generic_only")


QUERIES = {
    "token_sets": lambda s, d: A.papers(s, d).select("id", F.array_join(F.sort_array(T.token_set(R.content())), " ").alias("tokens")),
    "normalize_text": lambda s, d: A.papers(s, d).select("id", T.normalized(R.content()).alias("text")),
    "plural_fold": lambda s, d: A.papers(s, d).select("id", F.array_join(T.folded_words(R.content()), " ").alias("words")),
    "mapped_words": lambda s, d: A.papers(s, d).select("id", F.array_join(T.mapped_words(R.content()), " ").alias("words")),
    "identifier_norm": lambda s, d: A.papers(s, d).select("id", T.identifier(F.concat(F.lit(" https://doi.org/10.1/"), F.upper("id"))).alias("doi"), T.identifier(F.concat(F.lit("arXiv:2401."), F.right("id", F.lit(5)), F.lit("v2"))).alias("arxiv")),
    "jaccard_pairs": lambda s, d: R.jaccard_hits(A.papers(s, d), A.bench_queries(s, d)).withColumn("score", F.round("score", 6)),
    "jaccard_topk": lambda s, d: R.jaccard_topk(A.papers(s, d), A.bench_queries(s, d)),
    "novelty_max": lambda s, d: R.novelty(A.bench_queries(s, d), A.papers(s, d)),
    "bm25_scores": lambda s, d: R.bm25(A.papers(s, d), A.bench_queries(s, d)).withColumn("score", F.round("score", 6)),
    "bm25_topk": lambda s, d: R.bm25_topk(A.papers(s, d), A.bench_queries(s, d)).withColumn("score", F.round("score", 6)),
    "topic_classify": _labels,
    "topic_attention": lambda s, d: R.attention(_labels(s, d), A.topics(s)),
    "topic_recognition": _recognition,
    "legacy_policy_topk": lambda s, d: R.legacy_topk(A.papers(s, d), A.bench_queries(s, d), _recognition(s, d), A.policies(s), reads=A.reads(s, d, _queries(s, d))),
    "evidence_semantic": _evidence(False),
    "evidence_token_bounded": _evidence(True),
    "relevance_pool": _pool("relevance"),
    "fixed_pool": _pool("fixed"),
    "guarded_pool": _pool("guarded"),
    "repaired_pool": _pool("repaired"),
    "relevance_gated_topk": _gated("relevance_gated"),
    "stage_fixed_topk": _gated("stage_a_fixed"),
    "semantic_guarded_topk": _gated("stage_a_semantic_guarded"),
    "repaired_topk": _gated("stage_a_repaired_v1"),
    "soft_rerank": lambda s, d: R.soft_rerank(A.papers(s, d), _queries(s, d), A.topics(s)),
    "soft_lambda0_equiv": lambda s, d: R.soft_rerank(A.papers(s, d), _queries(s, d), A.topics(s), 0.0).select("query_id", "rank", "id"),
    "bm25_gate_hybrid": lambda s, d: R.hybrid(A.papers(s, d), _queries(s, d), A.topics(s)),
    "audit_metrics": _audit,
    "fallback_reasons": _fallbacks,
    "gate_reasons": lambda s, d: R.gate_reasons(A.papers(s, d), A.topics(s)),
    "memory_expansion": _memories,
    "memory_status": lambda s, d: R.memory_status(A.memory(s), A.topics(s)),
    "query_builder": _built,
    "query_probes": _probes,
    "text_recognition": lambda s, d: R.recognition(A.papers(s, d), R.classified(A.papers(s, d), A.topics(s), same_field=False), R.attention(_labels(s, d), A.topics(s))),
}

# ---- SQL ----

_P, _T = A.SQL_PAPERS, A.SQL_TOPICS
_TEXT = "title || ' ' || abstract"
_Q = "q AS (SELECT item_id AS query_id, text AS query, 't' || lpad(CAST(item_id % 12 AS VARCHAR), 2, '0') AS topic_id FROM benchmark)"


def _sql_fold(x: str) -> str:
    return f"list_transform({A.sql_words(x)}, lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END)"


def _sql_map(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.PLURALS.items())
    return f"list_transform({A.sql_words(x)}, lambda w: CASE w {cases} ELSE w END)"


def _sql_jaccard(field: bool) -> str:
    text = f"field || ' ' || {_TEXT}" if field else _TEXT
    return f"""{_P}, {_Q}, dt AS (SELECT id, unnest({A.sql_tokens(text)}) AS t FROM papers), qt AS (SELECT query_id, unnest({A.sql_tokens('query')}) AS t FROM q),
nd AS (SELECT id, count(*) AS n FROM dt GROUP BY 1), nq AS (SELECT query_id, count(*) AS n FROM qt GROUP BY 1),
hits AS (SELECT query_id, id, round(count(*) / (any_value(nd.n) + any_value(nq.n) - count(*)), 9) AS score FROM dt JOIN qt USING (t) JOIN nd USING (id) JOIN nq USING (query_id) GROUP BY 1, 2)"""


_BM25 = f"""{_P}, {_Q}, dw AS (SELECT id, {A.sql_words(_TEXT)} AS w FROM papers), st AS (SELECT count(*) AS n, avg(len(w)) AS m FROM dw),
tf AS (SELECT id, t, count(*) AS tf, any_value(l) AS l FROM (SELECT id, len(w) AS l, unnest(w) AS t FROM dw) GROUP BY id, t),
qt AS (SELECT query_id, t, count(*) AS times FROM (SELECT query_id, unnest({A.sql_words('query')}) AS t FROM q) GROUP BY 1, 2),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
bm AS (SELECT query_id, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / m))), 9) AS score FROM tf JOIN qt USING (t) JOIN df USING (t) CROSS JOIN st GROUP BY 1, 2)"""
_LAB = f"""{_P}, {_T}, lab AS (SELECT DISTINCT id, topic_id FROM (SELECT id, field, unnest({A.sql_tokens(_TEXT)}) AS t FROM papers) AS p JOIN (SELECT topic_id, field, unnest(keywords) AS t FROM topics) AS k USING (t, field))"""
_ATT = f"""{_LAB}, cnt AS (SELECT topic_id, coalesce(sum(share), 0) AS c FROM topics LEFT JOIN (SELECT topic_id, 1 / count(*) OVER (PARTITION BY id) AS share FROM lab) USING (topic_id) GROUP BY 1),
att AS (SELECT topic_id, round(p / max(p) OVER (), 9) AS attention FROM (SELECT topic_id, (c + 1) / (sum(c) OVER () + 12) AS p FROM cnt)),
rec AS (SELECT papers.id, round(coalesce(avg(attention), 0), 9) AS recognition FROM papers LEFT JOIN lab USING (id) LEFT JOIN att USING (topic_id) GROUP BY 1)"""


def _sql_evidence(bounded: bool) -> str:
    ws = _sql_map if bounded else _sql_fold
    pad = lambda x: f"' ' || array_to_string({x}, ' ') || ' '"
    text = (lambda x: pad(ws(x))) if bounded else (lambda x: f"array_to_string({ws(x)}, ' ')")
    alt = lambda i: pad(ws(f"keywords[{i}]"))
    phrase = lambda x: text(x)
    generic = "alls" if bounded else "tt || ' ' || aa"
    return f"""{_P}, {_T}, pw AS (SELECT id, field, {text('title')} AS tt, {text('abstract')} AS aa, {pad(ws(_TEXT))} AS alls, {ws(_TEXT)} AS w,
  list_transform(list_filter(regexp_split_to_array(title || '. ' || abstract, '[.!?;]+'), lambda s: trim(s) <> ''), lambda s: {pad(ws('s'))}) AS ss FROM papers),
tw AS (SELECT topic_id, field AS topic_field, sentence_only, {phrase("keywords[1] || ' ' || keywords[2]")} AS p1, {phrase("'the ' || keywords[1]")} AS p2, {alt(1)} AS g1, {alt(2)} AS g2, {phrase("'the'")} AS gen FROM topics),
hit AS (SELECT *, CASE WHEN contains(tt, p1) OR contains(tt, p2) THEN 1.0 WHEN contains(aa, p1) OR contains(aa, p2) THEN 0.9
  WHEN len(list_filter(ss, lambda s: contains(s, g1) AND contains(s, g2))) > 0 THEN 0.8
  WHEN NOT sentence_only AND contains(alls, g1) AND contains(alls, g2) AND len(list_filter(list_filter(range(1, len(w) + 1), lambda i: w[i] = trim(g1) OR w[i] = trim(g2)), lambda i: contains({pad('w[i : i + 17]')}, g1) AND contains({pad('w[i : i + 17]')}, g2))) > 0 THEN 0.8
  ELSE 0.0 END::DOUBLE AS evidence FROM pw CROSS JOIN tw),
ev AS (SELECT id, field, topic_id, topic_field, evidence, evidence = 0 AND contains({generic}, gen) AS generic_only FROM hit)"""


_JAC = "round(len(list_intersect({a}, {b})) / greatest(1, len({a}) + len({b}) - len(list_intersect({a}, {b}))), 18)"
_KEY = "regexp_replace(lower(trim({v})), '[_\\-\\s]+', '_', 'g')"


def _sql_memory(variant: str) -> str:
    """mw(topic_id, words), with memory and topics at hand."""
    value = "coalesce(m_topic, m_text, '')" if variant == "repaired" else "coalesce(m_text, m_topic, '')"
    if variant == "relevance":
        words = A.sql_tokens(value)
    elif variant == "fixed":
        words = A.sql_words(value + " || coalesce(' ' || k.description || ' ' || array_to_string(k.keywords, ' '), '')")
    else:
        words = _sql_map(f"coalesce(k.description || ' ' || k.keywords[1] || ' ' || k.keywords[2] || ' the ' || k.keywords[1] || ' ' || array_to_string(k.keywords, ' '), {value})")
    return f"mw AS (SELECT m.topic_id, list_distinct(flatten(list({words}))) AS words FROM memory m LEFT JOIN topics k ON k.topic_id = {_KEY.format(v=value)} GROUP BY 1)"


def _sql_built(fixed: bool) -> str:
    """bq(topic_id, field, qt, qf, qm)."""
    words = (lambda x: f"list_distinct({A.sql_words(x)})") if fixed else A.sql_tokens
    text = "array_to_string(keywords, ' ')" if fixed else "replace(topic_id, '_', ' ') || ' ' || description || ' ' || array_to_string(keywords, ' ')"
    return f"{_sql_memory('fixed' if fixed else 'relevance')}, bq AS (SELECT topic_id, field, {words(text)} AS qt, {words('field')} AS qf, coalesce(words, []) AS qm FROM topics LEFT JOIN mw USING (topic_id))"


def _sql_base(variant: str) -> str:
    """CTEs up to base(topic_id, id, candidate_rank, evidence, raw, relevance, share, qualified)."""
    if variant in ("guarded", "repaired"):
        bounded = variant == "repaired"
        head = f"{_sql_evidence(bounded)}, {A.SQL_MEMORY}, {_sql_memory('repaired')}"
        order = "evidence DESC, id" if bounded else "evidence DESC, ctx DESC, id"
        cut = f"ct AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY {order}) AS INTEGER) AS candidate_rank FROM (SELECT *, 0.05::DOUBLE * CAST(field = topic_field AS INTEGER) AS ctx FROM ev WHERE evidence >= 0.8) QUALIFY candidate_rank <= 20)"
        if not bounded:
            return f"{head}, {cut}, base AS (SELECT topic_id, id, candidate_rank, evidence, ctx AS raw, evidence AS relevance, 0.75::DOUBLE AS share, true AS qualified FROM ct)"
        return f"""{head}, {cut}, mm AS (SELECT ct.*, CASE WHEN len(words) > 0 THEN round(len(list_intersect(words, list_distinct(w))) / len(words), 9) ELSE 0 END AS raw, CASE WHEN len(words) > 0 THEN 0.1::DOUBLE ELSE 0 END AS beta FROM ct JOIN pw USING (id) LEFT JOIN mw ON mw.topic_id = ct.topic_id),
base AS (SELECT topic_id, id, candidate_rank, evidence, raw, round((1 - 0.05::DOUBLE - beta) * evidence + 0.05::DOUBLE * CAST(field = topic_field AS INTEGER) + beta * raw, 9) AS relevance, 0.75::DOUBLE AS share, true AS qualified FROM mm)"""
    fixed = variant == "fixed"
    words = f"list_distinct({A.sql_words('field || chr(32) || ' + _TEXT)})" if fixed else A.sql_tokens("field || chr(32) || " + _TEXT)
    order = "evidence DESC, raw DESC, id" if fixed else "raw DESC, id"
    gate = "evidence" if fixed else "raw"
    peak = "FILTER (evidence >= 0.08)" if fixed else ""
    cov = lambda q: f"CASE WHEN len({q}) > 0 THEN len(list_intersect({q}, w)) / len({q}) ELSE 0 END"
    return f"""{_P}, {_T}, {A.SQL_MEMORY}, {_sql_built(fixed)}, dw0 AS (SELECT id, {words} AS w FROM papers),
sc AS (SELECT topic_id, id, CAST({cov('qt')} AS DOUBLE) AS evidence, CAST({cov('qf')} AS DOUBLE) AS f, CAST({cov('qm')} AS DOUBLE) AS m FROM dw0 CROSS JOIN bq),
rw AS (SELECT topic_id, id, evidence, round(0.7::DOUBLE * evidence + 0.2::DOUBLE * f + 0.1::DOUBLE * m, 9) AS raw FROM sc),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY {order}) AS INTEGER) AS candidate_rank FROM rw QUALIFY candidate_rank <= 20),
pk AS (SELECT *, max(raw) {peak} OVER (PARTITION BY topic_id) AS peak FROM rk),
base AS (SELECT topic_id, id, candidate_rank, evidence, raw, CASE WHEN peak > 0 THEN raw / peak ELSE 0 END AS relevance, 0.75::DOUBLE AS share, {gate} >= 0.08 AS qualified FROM pk)"""


def _sql_pool(variant: str) -> str:
    return f"WITH {_sql_base(variant)} SELECT topic_id, id, candidate_rank, round(evidence, 6) AS evidence, round(raw, 6) AS raw, round(relevance, 6) AS relevance FROM base WHERE qualified"


def sql_clusters(rows: str, by: str, threshold: float) -> str:
    """Recursive CTE cl(by, id, lead) over rows of a table with ``by`` and id: greedy leaders in order of id."""
    near = _JAC.format(a="x.w", b="s.w")
    return f"""sq AS (SELECT r.{by}, r.id, array_to_string({A.sql_words(_TEXT)}, ' ') AS k, {A.sql_tokens(_TEXT)} AS w, row_number() OVER (PARTITION BY r.{by} ORDER BY r.id) AS i FROM {rows} r JOIN papers USING (id)),
cl AS (SELECT {by}, i, id, id AS lead, [{{'id': id, 'w': w}}] AS leaders, [{{'k': k, 'lead': id}}] AS ks FROM sq WHERE i = 1 UNION ALL
SELECT {by}, i, id, lead, CASE WHEN lead = id THEN list_append(leaders, {{'id': id, 'w': w}}) ELSE leaders END, list_append(ks, {{'k': k, 'lead': lead}})
FROM (SELECT s.*, c.leaders, c.ks, coalesce(list_filter(c.ks, lambda x: x.k = s.k)[1].lead, list_filter(c.leaders, lambda x: {near} >= {threshold})[1].id, s.id) AS lead FROM cl c JOIN sq s ON s.{by} = c.{by} AND s.i = c.i + 1))"""


def sql_gated(variant: str) -> str:
    """CTEs up to sel, the selections of a variant; needs WITH RECURSIVE."""
    ties = {"relevance": "raw DESC, ", "fixed": "evidence DESC, raw DESC, "}.get(variant, "evidence DESC, ")
    order = f"final_score DESC, {ties}id"
    head = _sql_base(variant)
    labels = _ATT.replace(f"{_P}, {_T}, ", "")
    return f"""{head}, {labels}, {A.SQL_POLICIES}, {A.SQL_READS}, pool AS (SELECT * FROM base WHERE qualified), {sql_clusters('pool', 'topic_id', 0.97)},
ex AS (SELECT sq.topic_id, sq.id, round(avg(1 - {_JAC.format(a='sq.w', b='rd.w')}), 9) AS exploration FROM sq JOIN rd USING (topic_id) GROUP BY 1, 2),
fs AS (SELECT pool.*, policy, cl.lead AS cluster_id, round(share * relevance + (1 - share) * (w_novelty * coalesce(exploration, 0.5) + w_recognition * recognition), 9) AS final_score FROM pool JOIN cl USING (topic_id, id) JOIN rec USING (id) LEFT JOIN ex USING (topic_id, id) CROSS JOIN policies),
sel AS (SELECT topic_id, policy, CAST(row_number() OVER (PARTITION BY topic_id, policy ORDER BY {order}) AS INTEGER) AS selected_rank, id, evidence, raw, final_score, cluster_id FROM (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY topic_id, policy, cluster_id ORDER BY {order}) = 1) QUALIFY selected_rank <= 3)"""


def sql_fallbacks(variant: str) -> str:
    """CTEs up to fb(topic_id, policy, selected_count, fallback), after sql_gated()."""
    if variant in ("guarded", "repaired"):
        why = "WHEN passed = 0 THEN 'no_qualified_evidence' ELSE 'insufficient_distinct_evidence'"
    else:
        first = "WHEN passed = 0 AND NOT something THEN 'all_evidence_relevance_zero' WHEN passed = 0 THEN 'no_qualified_evidence'" if variant == "fixed" else "WHEN NOT something THEN 'all_relevance_zero'"
        why = first + " WHEN passed < 3 THEN 'insufficient_relevant_documents' ELSE 'near_duplicate_limit'"
    score = "evidence" if variant == "fixed" else "raw"
    return f"""bs AS (SELECT topic_id, count(*) FILTER (qualified) AS passed, max({score}) > 0 AS something FROM base GROUP BY 1), sn AS (SELECT topic_id, policy, count(*) AS n FROM sel GROUP BY 1, 2),
fb AS (SELECT topic_id, policy, selected_count, CASE WHEN selected_count >= 3 THEN NULL {why} END AS fallback FROM (SELECT topic_id, policy, coalesce(n, 0) AS selected_count, coalesce(passed, 0) AS passed, coalesce(something, false) AS something FROM topics CROSS JOIN policies LEFT JOIN bs USING (topic_id) LEFT JOIN sn USING (topic_id, policy)))"""


_SEL = "SELECT topic_id, policy, selected_rank, id, round(evidence, 9) AS evidence, raw, final_score, cluster_id FROM sel"


_SOFT = f"""WITH {_sql_evidence(True)}, {_BM25.replace(_P + ', ', '')},
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS bm25_rank FROM bm QUALIFY bm25_rank <= 20),
j AS (SELECT top.*, coalesce(ev.evidence, 0) AS e FROM top JOIN q USING (query_id) LEFT JOIN ev ON ev.id = top.id AND ev.topic_id = q.topic_id),
r AS (SELECT *, round(CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END + 0.1::DOUBLE * CASE WHEN max(e) OVER w > 0 THEN e / max(e) OVER w ELSE 0 END, 9) AS rerank_score FROM j WINDOW w AS (PARTITION BY query_id))
"""
ORACLES = {
    "token_sets": f"WITH {_P} SELECT id, array_to_string(list_sort({A.sql_tokens(_TEXT)}), ' ') AS tokens FROM papers",
    "normalize_text": f"WITH {_P} SELECT id, array_to_string({A.sql_words(_TEXT)}, ' ') AS text FROM papers",
    "plural_fold": f"WITH {_P} SELECT id, array_to_string({_sql_fold(_TEXT)}, ' ') AS words FROM papers",
    "mapped_words": f"WITH {_P} SELECT id, array_to_string({_sql_map(_TEXT)}, ' ') AS words FROM papers",
    "identifier_norm": f"WITH {_P} SELECT id, '10.1/' || lower(id) AS doi, '2401.' || right(id, 5) AS arxiv FROM papers",
    "jaccard_pairs": f"WITH {_sql_jaccard(True)} SELECT query_id, id, round(score, 6) AS score FROM hits",
    "jaccard_topk": f"WITH {_sql_jaccard(True)} SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM hits QUALIFY rank <= 3",
    "novelty_max": f"WITH {_sql_jaccard(False)} SELECT q.query_id, round(1 - coalesce(max(score), 0), 9) AS novelty FROM q LEFT JOIN hits USING (query_id) GROUP BY 1",
    "bm25_scores": f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score FROM bm",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm.score DESC, id) AS INTEGER) AS rank FROM bm QUALIFY rank <= 10",
    "topic_classify": f"WITH {_LAB} SELECT id, topic_id FROM lab",
    "topic_attention": f"WITH {_ATT} SELECT topic_id, attention FROM att",
    "topic_recognition": f"WITH {_ATT} SELECT id, recognition FROM rec",
    "legacy_policy_topk": f"WITH {_sql_jaccard(True)}, {_ATT.replace(_P + ', ', '')}, {A.SQL_POLICIES}, pool AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20), {A.SQL_READS}, pt AS (SELECT query_id, topic_id, id, {A.sql_tokens("field || ' ' || " + _TEXT)} AS w FROM pool JOIN papers USING (id) JOIN q USING (query_id)), ex AS (SELECT query_id, pt.id, round(avg(1 - {_JAC.format(a="pt.w", b="rd.w")}), 9) AS exploration FROM pt JOIN rd USING (topic_id) GROUP BY 1, 2), s AS (SELECT query_id, policy, id, round(0.5 * score + 0.5 * (w_novelty * coalesce(exploration, 0.5) + w_recognition * recognition), 9) AS retrieval_score FROM pool JOIN rec USING (id) LEFT JOIN ex USING (query_id, id) CROSS JOIN policies) SELECT query_id, policy, CAST(row_number() OVER (PARTITION BY query_id, policy ORDER BY retrieval_score DESC, id) AS INTEGER) AS rank, id, retrieval_score FROM s QUALIFY rank <= 3",
    "evidence_semantic": f"WITH {_sql_evidence(False)} SELECT topic_id, id, evidence, generic_only FROM ev WHERE evidence > 0 OR generic_only",
    "evidence_token_bounded": f"WITH {_sql_evidence(True)} SELECT topic_id, id, evidence, generic_only FROM ev WHERE evidence > 0 OR generic_only",
    "relevance_pool": _sql_pool("relevance"),
    "fixed_pool": _sql_pool("fixed"),
    "guarded_pool": _sql_pool("guarded"),
    "repaired_pool": _sql_pool("repaired"),
    "soft_rerank": _SOFT + "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS INTEGER) AS rank, id, bm25_rank, rerank_score FROM r QUALIFY rank <= 10",
    "soft_lambda0_equiv": f"WITH {_BM25} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id FROM bm QUALIFY rank <= 10",
    "bm25_gate_hybrid": f"WITH {_sql_evidence(True)}, {_BM25.replace(_P + ', ', '')}, h AS (SELECT q.query_id, ev.id, evidence, coalesce(score, 0) AS score FROM ev JOIN q USING (topic_id) LEFT JOIN bm ON bm.query_id = q.query_id AND bm.id = ev.id WHERE evidence >= 0.8), r AS (SELECT *, round(evidence + CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN 0.2::DOUBLE * score / max(score) OVER (PARTITION BY query_id) ELSE 0 END, 9) AS hybrid_score FROM h) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, id) AS INTEGER) AS rank, id, evidence, hybrid_score FROM r QUALIFY rank <= 20",
    **{name: f"WITH RECURSIVE {sql_gated(v)} {_SEL}" for name, v in (("relevance_gated_topk", "relevance"), ("stage_fixed_topk", "fixed"), ("semantic_guarded_topk", "guarded"), ("repaired_topk", "repaired"))},
    "audit_metrics": f"""WITH RECURSIVE {sql_gated("relevance")}, {sql_fallbacks("relevance")}, ow AS (SELECT id, list(topic_id) AS topics FROM lab GROUP BY 1), sj AS (SELECT sel.*, topics FROM sel LEFT JOIN ow USING (id)),
ps AS (SELECT topic_id, round(min(raw), 6) AS pool_min, round(max(raw), 6) AS pool_max, round(list_sort(list(raw))[len(list(raw)) // 2 + 1], 6) AS pool_median, round(avg(CAST(raw = 0 AS INTEGER)), 6) AS pool_zero_rate, round(avg(CAST(qualified AS INTEGER)), 6) AS pool_qualified_rate FROM base GROUP BY 1),
tw AS (SELECT a.topic_id, a.policy, count(*) FILTER (a.cluster_id = b.cluster_id) / count(*) AS r FROM sel a JOIN sel b ON a.topic_id = b.topic_id AND a.policy = b.policy AND a.selected_rank < b.selected_rank GROUP BY 1, 2),
g AS (SELECT topic_id, policy, count(*) AS selected_count, round(avg(CASE WHEN topics IS NOT NULL THEN CAST(list_contains(topics, topic_id) AS INTEGER) END), 6) AS topic_match_rate, count(*) FILTER (topics IS NULL) AS unlabeled_selected, CAST(len(list_distinct(flatten(list(topics) FILTER (topics IS NOT NULL)))) AS INTEGER) AS topic_coverage, round(avg(raw), 6) AS selected_relevance_mean, round(count(DISTINCT cluster_id) / count(*), 6) AS unique_cluster_ratio FROM sj GROUP BY 1, 2)
SELECT g.topic_id, g.policy, selected_count, topic_match_rate, unlabeled_selected, coalesce(topic_coverage, 0) AS topic_coverage, selected_relevance_mean, unique_cluster_ratio, pool_min, pool_max, pool_median, pool_zero_rate, pool_qualified_rate, round(r, 6) AS near_duplicate_pair_rate, selected_count < 3 AS retrieval_shortfall, fallback FROM g JOIN ps USING (topic_id) JOIN (SELECT topic_id, policy, fallback FROM fb) AS fb2 USING (topic_id, policy) LEFT JOIN tw USING (topic_id, policy)""",
    "fallback_reasons": " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {sql_gated(v)}, {sql_fallbacks(v)} SELECT topic_id, policy, selected_count, fallback, '{v}' AS variant FROM fb)" for v in ("relevance", "fixed", "guarded", "repaired")),
    "gate_reasons": f"WITH {_sql_evidence(True)} SELECT topic_id, CASE WHEN evidence >= 0.8 THEN 'passed_semantic_evidence' WHEN generic_only THEN 'generic_only' ELSE 'no_semantic_evidence' END AS gate_reason, count(*) AS n FROM ev GROUP BY 1, 2",
    "memory_expansion": " UNION ALL ".join(f"SELECT * FROM (WITH {_T}, {A.SQL_MEMORY}, {_sql_memory(v)} SELECT '{v}' AS variant, topic_id, array_to_string(list_sort(words), ' ') AS words FROM mw)" for v in ("relevance", "fixed", "repaired")),
    "memory_status": f"WITH {_T}, {A.SQL_MEMORY}, m AS (SELECT topic_id, coalesce(m_topic, m_text) AS input, {_KEY.format(v='coalesce(m_topic, m_text)')} AS k FROM memory) SELECT m.topic_id, input, CASE WHEN t.topic_id IS NULL THEN 'unknown_literal' ELSE 'resolved_topic' END AS status, t.topic_id AS resolved FROM m LEFT JOIN topics t ON t.topic_id = k",
    "query_builder": " UNION ALL ".join(f"SELECT * FROM (WITH {_T}, {A.SQL_MEMORY}, {_sql_built(x)} SELECT '{n}' AS variant, topic_id, array_to_string(list_sort(qt), ' ') AS topic_words, array_to_string(list_sort(qf), ' ') AS field_words, array_to_string(list_sort(qm), ' ') AS memory_words FROM bq)" for n, x in (("relevance", False), ("fixed", True))),
    "query_probes": f"""WITH RECURSIVE {sql_gated("relevance")}, fw AS (SELECT id, {A.sql_tokens("field || ' ' || " + _TEXT)} AS fw FROM papers), fr AS (SELECT id, len(list_intersect(fw, ['ther', 'thon', 'agents'])) AS n, len(fw) AS m FROM fw), lg AS (SELECT id, row_number() OVER (ORDER BY round(n / (m + 3 - n), 9) DESC, id) AS r FROM fr WHERE n > 0 QUALIFY r <= 3),
ls AS (SELECT topic_id || policy AS k, list(id ORDER BY selected_rank) AS ids FROM sel GROUP BY 1 UNION ALL SELECT 'legacy', list(id ORDER BY r) FROM lg),
pr AS (SELECT * FROM (VALUES ('same_query_balanced_vs_novelty', 't00balanced', 't00novelty'), ('same_query_balanced_vs_recognition', 't00balanced', 't00recognition'), ('changed_topic', 't00balanced', 't01balanced'), ('legacy_equivalent_expression', 'legacy', 'legacy')) AS v(comparison, x, y)),
j AS (SELECT comparison, coalesce(a.ids, []) AS a, coalesce(b.ids, []) AS b FROM pr LEFT JOIN ls a ON a.k = x LEFT JOIN ls b ON b.k = y)
SELECT comparison, CASE WHEN len(a) + len(b) > 0 THEN round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) END AS jaccard, CASE WHEN least(len(a), len(b)) > 0 THEN round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) END AS intersection_over_min, CASE WHEN len(a) + len(b) = 0 THEN 'both_empty' WHEN least(len(a), len(b)) = 0 THEN 'one_empty' END AS reason, array_to_string(a, ';') AS left_selected, array_to_string(b, ';') AS right_selected FROM j""",
    "text_recognition": f"WITH {_ATT}, al AS (SELECT DISTINCT id, topic_id FROM (SELECT id, unnest({A.sql_tokens(_TEXT)}) AS t FROM papers) AS p JOIN (SELECT topic_id, unnest(keywords) AS t FROM topics) AS k USING (t)) SELECT papers.id, round(coalesce(avg(attention), 0), 9) AS recognition FROM papers LEFT JOIN al USING (id) LEFT JOIN att USING (topic_id) GROUP BY 1",
}
