"""Queries of the checks over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidmill.functions import text as T
from evidmill.operators import checks as K
from evidmill.operators import retrieval as R
from evidmill.plans import adapters as A
from evidmill.plans import retrieval_queries as RQ
from evidmill.sources import fingerprints


def _pairs(s, d):
    r = A.ratings(s, d)
    return r.groupBy("item_id").agg(F.max(F.when(F.col("reviewer") == 1, F.col("d0"))).alias("r1"), F.max(F.when(F.col("reviewer") == 2, F.col("d0"))).alias("r2"), F.countDistinct("reviewer").alias("rated"))


def _graded_families(s, d):
    return A.papers(s, d).join(A.qrels(s, d), "id").select(F.md5(T.normalized(R.content())).alias("family"), "grade")


def _agents(s, d):
    return A.ledger(s, d).select("agent_id").distinct().withColumn("field", F.col("agent_id") % 3)


def _cards(s, d):
    e = A.tables(s, d, "events")[0]
    refs = F.array((F.col("event_id") % 5).cast("string"))
    ok = K.valid_card(F.col("event_type"), refs, F.array(F.lit("0"), F.lit("1"), F.lit("2")), F.col("value") / 100)
    return e.groupBy("event_type", ok.alias("valid")).agg(F.count("*").alias("n"))


def _compared(s, d):
    a = A.branches(s, d).select("seed", "policy", "network", (F.col("effort") / 3).alias("x"))
    b = a.where("seed <> 3").withColumn("x", F.when(F.col("seed") == 1, F.col("x") + 1).otherwise(F.col("x")))
    return K.compared(a, b, ["seed", "policy", "network"], "x")


def _diversity(s, d):
    p = A.papers(s, d)
    return K.text_diversity(p.select("field", "id", T.token_set(R.content()).alias("w")), "field")


def _canonical(s, d):
    """Events as JSON in two layouts, by number; one in 50 repeats a key, one in 70 isn't finite, one in 90 is broken."""
    e = A.tables(s, d, "events")[0]
    n, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id").cast("string")
    tags = F.concat(F.lit("["), n.cast("string"), F.lit(",null,true]"))
    wide = F.concat(F.lit('\ufeff{ "user" : '), user, F.lit(', "props": '), F.col("props"), F.lit(', "tags": '), tags, F.lit(',\r\n "kind": "'), kind, F.lit('\\r\\nend" }'))
    tight = F.concat(F.lit('{"kind":"'), kind, F.lit('\\nend","props":'), F.col("props"), F.lit(',"tags":'), tags, F.lit(',"user":'), user, F.lit("}"))
    text = F.when(n % 50 == 0, '{"a":1,"a":2}').when(n % 70 == 0, '{"a":[NaN]}').when(n % 90 == 0, '{"a":').when(n % 2 == 0, wide).otherwise(tight)
    return e.select("event_id", fingerprints.canonical_json(text).alias("c")).select("event_id", "c.*")


def _nested(s, d):
    """Documents as nested cards: a map of their source and, for some, a network; parts with notes and, for some, an agent."""
    t = A.tables(s, d, "documents")[0]
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("network"), F.when(n % 7 == 0, F.lit("open")))
    parts = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("note"), F.when(n % 5 == 0, n).alias("agent_id")))
    return t.select("doc_id", F.struct(F.struct(F.col("lang").alias("lang"), meta.alias("meta")).alias("head"), parts.alias("parts")).alias("card"))


QUERIES = {
    "adjudication_queue": lambda s, d: K.adjudication_queue(_pairs(s, d)),
    "gold_conflicts": lambda s, d: K.conflicts(_graded_families(s, d), "family", "grade"),
    "evidence_proposals": lambda s, d: K.proposals(A.papers(s, d), A.topics(s)),
    "alternating_roles": lambda s, d: K.roles(_agents(s, d), 3),
    "topic_offset": lambda s, d: K.shifted(A.topics(s)),
    "keyed_uniform": lambda s, d: K.keyed_uniforms(_agents(s, d), "agent_id", 7),
    "fixture_corpus": lambda s, d: K.fixture(s, 6, A.topics(s)),
    "leak_scan": lambda s, d: K.leaks(A.papers(s, d), ["title", "abstract"], ["token", "license", "@"]),
    "response_validation": _cards,
    "baseline_compare": _compared,
    "metric_span": lambda s, d: K.spans(A.branches(s, d), "policy", "effort"),
    "text_diversity": _diversity,
    "canonical_records": _canonical,
    "nested_leaks": lambda s, d: K.nested_leaks(_nested(s, d), ["network", "agent_id"], ["license", "@"], ["doc_id"]),
}

_HEX = " + ".join(f"(strpos('0123456789abcdef', h[{i + 1}]) - 1) * {16 ** (12 - i)}" for i in range(13))
ORACLES = {
    "adjudication_queue": f"WITH {A.SQL_RATINGS}, p AS (SELECT item_id, max(d0) FILTER (reviewer = 1) AS r1, max(d0) FILTER (reviewer = 2) AS r2, count(DISTINCT reviewer) AS rated FROM ratings GROUP BY 1) SELECT item_id, r1, r2 FROM p WHERE rated = 2 AND (r1 IS NULL OR r2 IS NULL OR r1 <> r2)",
    "gold_conflicts": f"WITH {RQ._P}, {A.SQL_QRELS} SELECT md5(array_to_string({A.sql_words(RQ._TEXT)}, ' ')) AS family, count(DISTINCT grade) AS grades FROM papers JOIN qrels USING (id) GROUP BY 1 HAVING count(DISTINCT grade) > 1",
    "evidence_proposals": f"WITH {RQ._P}, {RQ._T}, j AS (SELECT topic_id, contains(lower({RQ._TEXT}), keywords[1]) AS a, contains(lower({RQ._TEXT}), keywords[2]) AS b FROM papers CROSS JOIN topics) SELECT topic_id, CASE WHEN a AND b THEN 'supported' ELSE 'ambiguous' END AS status, count(*) AS n FROM j WHERE a OR b GROUP BY 1, 2",
    "alternating_roles": f"WITH {A.SQL_LEDGER}, a AS (SELECT DISTINCT agent_id FROM ledger) SELECT agent_id, CASE WHEN (row_number() OVER (PARTITION BY agent_id % 3 ORDER BY agent_id) - 1 + 3) % 2 = 0 THEN 'leader' ELSE 'follower' END AS role FROM a",
    "topic_offset": f"WITH {RQ._T} SELECT topic_id, 't' || lpad(CAST((CAST(topic_id[2:] AS INTEGER) + 6) % 12 AS VARCHAR), 2, '0') AS partner FROM topics",
    "keyed_uniform": f"WITH {A.SQL_LEDGER}, x AS (SELECT agent_id, sha256('7|' || agent_id) AS h FROM (SELECT DISTINCT agent_id FROM ledger)) SELECT agent_id, round(({_HEX}) / 4503599627370496, 9) AS u FROM x",
    "fixture_corpus": f"WITH {RQ._T} SELECT topic_id || '_f' || lpad(CAST(k AS VARCHAR), 3, '0') AS id, array_to_string(keywords, ' ') || ' variant ' || k AS title, field, CAST(k % 5 AS INTEGER) AS year_offset FROM topics CROSS JOIN range(6) AS r(k)",
    "leak_scan": f"WITH {RQ._P}, c AS (SELECT 'title' AS \"column\", lower(title) AS t FROM papers UNION ALL SELECT 'abstract', lower(abstract) FROM papers) SELECT \"column\", count(*) FILTER (contains(t, 'token') OR contains(t, 'license') OR contains(t, '@')) AS n FROM c GROUP BY 1",
    "response_validation": "SELECT event_type, coalesce(length(trim(event_type)) > 0 AND event_id % 5 <= 2 AND value / 100 BETWEEN 0 AND 1, false) AS valid, count(*) AS n FROM events GROUP BY 1, 2",
    "baseline_compare": f"WITH {A.SQL_BRANCHES} SELECT CASE WHEN seed = 3 THEN 'missing' WHEN seed = 1 THEN 'changed' ELSE 'equal' END AS status, count(*) AS n FROM branches GROUP BY 1",
    "metric_span": f"WITH {A.SQL_BRANCHES} SELECT policy, max(effort) - min(effort) AS span FROM branches GROUP BY 1",
    "text_diversity": f"WITH {RQ._P}, w AS (SELECT field, id, {A.sql_tokens(RQ._TEXT)} AS w FROM papers), p AS (SELECT a.field, round(len(list_intersect(a.w, b.w)) / greatest(1, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 9) AS j FROM w a JOIN w b ON a.field = b.field AND a.id < b.id) SELECT f.field, round(coalesce(1 - sum(j) / count(j), 0), 6) AS diversity FROM (SELECT DISTINCT field FROM w) AS f LEFT JOIN p USING (field) GROUP BY 1",
    "canonical_records": """WITH t AS (SELECT event_id, event_id % 50 = 0 AS twice, event_id % 70 = 0 AS nan, event_id % 90 = 0 AS broken, '{"kind":"' || event_type || '\\nend","props":' || replace(props, ': ', ':') || ',"tags":[' || event_id || ',null,true],"user":' || user_id || '}' AS c FROM events)
SELECT event_id, CASE WHEN NOT (twice OR nan OR broken) THEN c END AS canonical, CASE WHEN NOT (twice OR nan OR broken) THEN sha256(c) END AS sha256, CASE WHEN twice THEN 'repeated key' WHEN nan THEN 'non-finite number' WHEN broken THEN 'not JSON' END AS fault FROM t""",
    "nested_leaks": """WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS note, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents), m AS (SELECT *, CASE WHEN contains(lower(note), 'license') THEN 'license' WHEN contains(note, '@') THEN '@' END AS found FROM p)
SELECT doc_id, '$.card.head.meta.network' AS path, 'key' AS kind, 'network' AS found FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id, '$.card.parts[' || i || '].agent_id', 'key', 'agent_id' FROM p WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, '$.card.parts[' || i || '].note', 'marker', found FROM m WHERE found IS NOT NULL
UNION ALL SELECT doc_id, '$.card.head.lang', 'marker', CASE WHEN contains(lower(lang), 'license') THEN 'license' ELSE '@' END FROM documents WHERE contains(lower(lang), 'license') OR contains(lang, '@')
UNION ALL SELECT doc_id, '$.card.head.meta.source', 'marker', CASE WHEN contains(lower(source), 'license') THEN 'license' ELSE '@' END FROM documents WHERE contains(lower(source), 'license') OR contains(source, '@')""",
}
