"""Queries of budgets, trajectories, branch measures and review imports over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidmill.functions import text as T
from evidmill.operators import admission, branches, review_import, runs, trajectories
from evidmill.operators.graph import shared_dir
from evidmill.plans import adapters as A


# budgets


def _requests(s, d):
    """Events as reservations of 40 ledgers: purchases and errors are attempts, the others logical calls; a third has a currency."""
    e = A.tables(s, d, "events")[0]
    n = F.col("event_id")
    currency = F.when(n % 9 < 4, "USD").when(n % 9 == 4, "EUR").when(n % 97 == 0, "XXX")
    return e.select((F.col("user_id") % 40).alias("ledger_id"), n.alias("seq"), F.col("event_type").isin("purchase", "error").alias("http"), F.round("value").cast("bigint").alias("input_tokens"), (n * 7 % 50).alias("output_tokens"), currency.alias("currency"), F.round(F.col("value") * 10).cast("bigint").alias("cost"), (n * 1.0).alias("elapsed"))


def _limits(s, d):
    """Shares of what each ledger asks for, so that each limit refuses somewhere and later, smaller requests fit again."""
    r = _requests(s, d).groupBy("ledger_id").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.sum("cost").alias("c"), F.max("seq").alias("last"))
    part = lambda c, by: F.floor(F.col(c) * by / 10).cast("bigint")
    costs = F.create_map(F.lit("USD"), part("c", 2), F.lit("EUR"), F.floor(F.col("c") / 20).cast("bigint"))
    return r.select("ledger_id", part("n", 5).alias("max_logical"), part("n", 3).alias("max_attempts"), part("i", 6).alias("max_input"), part("o", 7).alias("max_output"), F.when(F.col("ledger_id") % 5 == 0, F.col("last") * 0.5).alias("walltime"), costs.alias("costs"))


# trajectories

CYCLES = 20


def _entries(s, d):
    e = A.tables(s, d, "events")[0]
    n, topic = F.col("event_id"), (F.col("event_id") * 31 + F.col("user_id")) % 23
    return e.select((n % 6).alias("branch"), (F.floor(n / 7) % (CYCLES + 2)).cast("int").alias("cycle"), (F.col("user_id") * 7 % 40).alias("project_id"), F.col("user_id").alias("agent_id"), F.when(n % 13 != 0, F.round("value").cast("bigint")).otherwise(0).alias("units"), F.when(n % 17 != 0, topic).alias("topic_id"))


def _merges(s, d):
    """Project p merges into p div 2 where p % 3 is not 0, at a cycle of its number and branch; some merge before what they hold."""
    p = A.tables(s, d, "events")[0].select((F.col("event_id") % 6).alias("branch")).distinct().crossJoin(F.broadcast(s.range(40).withColumnRenamed("id", "project_id")))
    merged = (F.col("project_id") % 3 != 0) & (F.col("project_id") > 0)
    return p.select("branch", "project_id", F.when(merged, F.floor(F.col("project_id") / 2)).alias("merged_into"), F.when(merged, 1 + (F.col("project_id") * 5 + F.col("branch")) % 16).cast("int").alias("cycle"))


# measures of branches

START = 4


def _world(s, d):
    """Six branches from events: three users of a row share three projects, of which some end merged, abandoned, open or completed; their cards are documents."""
    e, docs = A.tables(s, d, "events", "documents")
    n, u, b = F.col("event_id"), F.col("user_id"), F.col("branch")
    e = e.select((n % 6).alias("branch"), (F.floor(n / 7) % 22).cast("int").alias("cycle"), n.alias("event_id"), u.alias("user_id"), "event_type", "value", ((n * 31 + u) % 23).alias("topic_id"))
    kind = lambda *k: e.where(F.col("event_type").isin(*k))
    agents = e.select("branch", "user_id").distinct().select("branch", F.col("user_id").alias("agent_id"), (F.floor(u / 2) % 3).alias("field"), ((u * 17 + b) % 50 / 10).alias("reputation"))
    p, k = F.col("project_id"), F.col("project_id") % 10
    status = F.when(k.isin(1, 2), "merged").when(k == 3, "abandoned").when(k == 4, "active").when(k == 5, "censored").otherwise("completed")
    first = p - p % 3
    members = F.filter(F.transform(F.sequence(first, first + 2), lambda a: F.when((a + b) % 2 == 0, a)), lambda a: a.isNotNull())
    projects = agents.select("branch", F.col("agent_id").alias("project_id"), (F.col("agent_id") * 6 + b).alias("doc_id")).join(docs.select("doc_id", "text"), "doc_id", "left").select(
        "branch", "project_id", status.alias("status"), ((p * 3 + b) % 22).cast("int").alias("created_cycle"), F.when(k.isin(1, 2), p - 1).alias("merged_into"), members.alias("members"),
        ((p * 13 + b) % 100 / 100).alias("novelty"), ((p * 29 + b) % 100 / 100).alias("attention"), T.token_set(F.coalesce("text", F.lit(""))).alias("words"),
    )
    effort = e.select("branch", "cycle", (u - u % 3 + n % 3).alias("project_id"), u.alias("agent_id"), F.when(n % 13 != 0, F.round("value").cast("bigint")).otherwise(0).alias("units"))
    drafts = kind("view", "click").select("branch", "cycle", (1 + n % 5).alias("candidate_count"), "topic_id")
    invitations = kind("purchase").select("branch", "cycle", (n % 1009).alias("target"), F.when(F.col("value") < 50, "accepted").otherwise("declined").alias("status"))
    audits = kind("error", "signup").select("branch", "cycle", F.when(F.col("event_type") == "error", "invitation").otherwise("exit").alias("stage"), F.when((F.col("event_type") == "error") & (n % 11 != 0), n % 5).alias("offered_count"), F.when(n % 4 == 0, "exit").otherwise("stay").alias("selected_action"))
    return drafts, projects, effort, invitations, audits, agents, kind("view").select("branch", "topic_id")


# reviews

DIMENSIONS = ["novelty", "rigour"]


def _submission(s, d):
    """Two reviews of every line of an order, some of them faulty by its number, some twice; with the items, the pairs asked for and those imported before."""
    li = A.tables(s, d, "lineitem")[0]
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    item = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    items = li.groupBy(item.alias("review_id"), k.alias("k")).agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    items = items.withColumn("reference_ids", F.array(F.concat(F.lit("p"), F.col("part").cast("string")), F.concat(F.lit("s"), F.col("supp").cast("string"))))
    both = items.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("w"))
    who = F.concat(F.lit("r"), F.col("w").cast("string"))
    by = lambda m, r, odd, plain: F.when(F.col("k") % m == r, odd).otherwise(plain)
    score = lambda j: by(61, j, F.lit("7"), by(67, j, F.lit("x"), by(71, j, F.lit(" "), F.concat(F.lit(" "), (F.col("k") * (j + 1) % 5 + 1).cast("string")))))
    per = [c.alias(n) for j, dim in enumerate(DIMENSIONS) for n, c in ((f"{dim}_score", score(j)), (f"{dim}_reason", by(73, j, F.lit(""), F.lit("as read"))), (f"{dim}_evidence_id", by(79, j, F.lit("p0"), by(3, j, F.lit(""), F.concat(F.lit("p"), F.col("part").cast("string"))))))]
    rows = both.select(
        (F.col("k") * 2 + F.col("w")).alias("line"), by(31, 1, F.lit("none"), F.col("review_id")).alias("review_id"), by(37, 1, F.lit("r9"), who).alias("reviewer_id"), by(41, 1, F.lit("v0"), F.lit("v1")).alias("rubric_version"), by(43, 1, F.lit("True"), F.lit("false")).alias("is_mock"),
        by(47, 1, F.lit("lost"), by(71, 0, F.lit("unassessable"), F.lit("available"))).alias("evidence_access_status"), by(53, 1, F.lit(None).cast("string"), F.lit("TRUE")).alias("references_valid"), *per,
    )
    asked = both.where("k % 23 <> 0").select("review_id", who.alias("reviewer_id"))
    old = both.where("k % 19 = 0 and w = 1").select("review_id", who.alias("reviewer_id"))
    again = rows.where("line % 29 = 0").withColumn("line", F.col("line") + 1_000_000_000_000)
    return rows.union(again), items, s.createDataFrame([("r1",), ("r2",)], "reviewer_id string").coalesce(1), asked, old, "v1", DIMENSIONS


def _review_faults(s, d):
    checked = review_import.faults(*_submission(s, d))
    return checked.groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


def _review_lifecycle(s, d):
    rows, items, who, asked, old, rubric, dims = _submission(s, d)
    good = review_import.faults(rows, items, who, asked, old, rubric, dims).where("fault is null")
    return review_import.lifecycle(asked, old.select("review_id", "reviewer_id").union(good.select("review_id", "reviewer_id")))


# runs


def _topic_cells(s, d, changed=False):
    """Cells of 12 topics and 3 policies, with a digest of the topic's documents; ``changed`` alters those of topic 3."""
    t = A.tables(s, d, "documents")[0].select((F.col("doc_id") % 12).alias("topic"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    body = F.when((F.col("topic") == 3) & F.lit(changed), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    t = t.withColumn("text", body)
    digest = t.groupBy("topic").agg(F.bit_xor(F.xxhash64("doc_id", "text")).alias("input"))
    return t, digest.crossJoin(F.broadcast(A.policies(s).select("policy", "w_novelty")))


def _by_dependency(s, d):
    """Results of all cells after the documents of one topic changed: only its cells are computed again."""
    store = runs.ResultStore(s, f"{shared_dir(s)}/evidmill/cells-{uuid.uuid4().hex}")

    def once(changed):
        t, cells = _topic_cells(s, d, changed)
        words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
        compute = lambda todo: todo.join(t.groupBy("topic").agg(F.count("*").alias("n"), F.sum(words).alias("words"), F.sum(F.length("text")).alias("chars")), "topic").select("dep_key", "n", "words", F.round(F.col("chars") * F.col("w_novelty"), 3).alias("score"))
        return store.get(cells, ["topic", "policy", "input"], {"code": "1"}, compute)

    once(False)
    return once(True).select("topic", "policy", "n", "words", "score", "hit")


def _log(s, d):
    e = A.tables(s, d, "events")[0]
    n = F.col("event_id")
    kind = F.when(F.col("event_type").isin("view", "purchase"), "started").when(F.col("event_type") == "error", F.when((n % 501 == 0) & (F.col("user_id") % 5 < 3), "fatal").otherwise("failed")).otherwise("completed")
    return e.select((F.col("user_id") % 5).cast("int").alias("model"), F.concat_ws("-", F.col("user_id").cast("string"), (n % 31).cast("string")).alias("cell_id"), n.alias("seq"), (n * 2).alias("at"), kind.alias("event"))


def _resume(s, d):
    """The plan for 40 cells of every user, of whose events some began, ended or blocked cells."""
    users = A.tables(s, d, "events")[0].select("user_id").distinct()
    schedule = users.select((F.col("user_id") % 5).cast("int").alias("model"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("c"), "user_id").select("model", F.concat_ws("-", F.col("user_id").cast("string"), F.col("c").cast("string")).alias("cell_id"))
    return runs.resume_plan(schedule, runs.cell_states(_log(s, d)), now=15_000, lease=5_000)


QUERIES = {
    "admission_ledger": lambda s, d: admission.admitted(_requests(s, d), _limits(s, d)),
    "branch_trajectories": lambda s, d: trajectories.trajectories(_entries(s, d), _merges(s, d), CYCLES),
    "branch_measures": lambda s, d: branches.measures(*_world(s, d), START),
    "review_import_faults": _review_faults,
    "dependency_results": _by_dependency,
    "resume_plan": _resume,
    "review_import_lifecycle": _review_lifecycle,
}

# ---- SQL ----

_CURRENCY = "CASE WHEN event_id % 9 < 4 THEN 'USD' WHEN event_id % 9 = 4 THEN 'EUR' WHEN event_id % 97 = 0 THEN 'XXX' END"
_WHY = """CASE WHEN elapsed > walltime THEN 'walltime' WHEN lg + CASE WHEN http THEN 0 ELSE 1 END > max_logical OR ac + CASE WHEN http THEN 1 ELSE 0 END > max_attempts THEN 'calls' WHEN ti + input_tokens > max_input THEN 'input_tokens' WHEN tt + output_tokens > max_output THEN 'output_tokens'
  WHEN rq.currency = 'USD' AND usd + cost > max_usd OR rq.currency = 'EUR' AND eur + cost > max_eur OR rq.currency = 'XXX' THEN 'cost' END"""
_E6 = f"e AS (SELECT event_id % 6 AS branch, CAST(event_id // 7 % {CYCLES + 2} AS INTEGER) AS cycle, user_id * 7 % 40 AS project_id, user_id AS agent_id, CASE WHEN event_id % 13 <> 0 THEN CAST(round(value) AS BIGINT) ELSE 0 END AS units, CASE WHEN event_id % 17 <> 0 THEN (event_id * 31 + user_id) % 23 END AS topic_id FROM events)"

_by = lambda m, r, odd, plain: f"CASE WHEN k % {m} = {r} THEN {odd} ELSE {plain} END"
_score = lambda j: _by(61, j, "'7'", _by(67, j, "'x'", _by(71, j, "' '", f"' ' || (k * {j + 1} % 5 + 1)")))
_DIMS = ", ".join(f"trim({_score(j)}) AS s{j}, {_by(73, j, chr(39) * 2, chr(39) + 'as read' + chr(39))} AS r{j}, {_by(79, j, chr(39) + 'p0' + chr(39), _by(3, j, chr(39) * 2, 'refs[1]'))} AS e{j}" for j in range(2))
_TESTS = " ".join(f"WHEN s{j} = '' AND access <> 'unassessable' THEN 'missing_score' WHEN s{j} <> '' AND NOT regexp_full_match(s{j}, '[+-]?[0-9]+') THEN 'invalid_score' WHEN s{j} <> '' AND CAST(s{j} AS INTEGER) NOT BETWEEN 1 AND 5 THEN 'score_outside' WHEN s{j} <> '' AND r{j} = '' THEN 'missing_reason' WHEN s{j} <> '' AND e{j} <> '' AND NOT coalesce(list_contains(own, e{j}), false) THEN 'foreign_evidence'" for j in range(2)).replace("CAST(s0 AS INTEGER)", "try_cast(s0 AS INTEGER)").replace("CAST(s1 AS INTEGER)", "try_cast(s1 AS INTEGER)").replace("try_try_", "try_")
_REVIEWS = f"""it AS (SELECT l_orderkey || '-' || l_linenumber AS item, ['p' || min(l_partkey), 's' || min(l_suppkey)] AS refs, l_orderkey * 7 + l_linenumber AS k FROM lineitem GROUP BY 1, l_orderkey, l_linenumber), bo AS (SELECT *, 'r' || w AS who FROM it CROSS JOIN (VALUES (1), (2)) AS v(w)),
rw0 AS (SELECT k * 2 + w AS line, {_by(31, 1, "'none'", "item")} AS review_id, {_by(37, 1, "'r9'", "who")} AS reviewer_id, {_by(41, 1, "'v0'", "'v1'")} AS rubric, {_by(43, 1, "true", "false")} AS mock, {_by(47, 1, "'lost'", _by(71, 0, "'unassessable'", "'available'"))} AS access, k % 53 <> 1 AS valid, {_DIMS} FROM bo),
rw AS (SELECT *, row_number() OVER (PARTITION BY review_id, reviewer_id ORDER BY line, rubric) AS nth FROM (SELECT * FROM rw0 UNION ALL SELECT * REPLACE (line + 1000000000000 AS line) FROM rw0 WHERE line % 29 = 0)),
fx AS (SELECT rw.review_id, rw.reviewer_id, line, CASE WHEN nth > 1 OR od.item IS NOT NULL THEN 'duplicate_identity' WHEN own IS NULL OR reviewer_id = 'r9' OR ak.item IS NULL THEN 'unknown_identity' WHEN rubric <> 'v1' OR mock THEN 'wrong_rubric_or_mock' WHEN access = 'lost' OR NOT valid THEN 'invalid_access_status' {_TESTS} END AS fault
  FROM rw LEFT JOIN (SELECT item, refs AS own FROM it) AS o ON o.item = review_id LEFT JOIN bo AS od ON od.item = review_id AND od.who = reviewer_id AND od.k % 19 = 0 AND od.w = 1 LEFT JOIN bo AS ak ON ak.item = review_id AND ak.who = reviewer_id AND ak.k % 23 <> 0)"""

ORACLES = {
    "admission_ledger": f"""WITH RECURSIVE rq AS (SELECT user_id % 40 AS ledger_id, event_id AS seq, event_type IN ('purchase', 'error') AS http, CAST(round(value) AS BIGINT) AS input_tokens, event_id * 7 % 50 AS output_tokens, {_CURRENCY} AS currency, CAST(round(value * 10) AS BIGINT) AS cost, event_id * 1.0::DOUBLE AS elapsed, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS n FROM events),
lm AS (SELECT ledger_id, count(*) * 5 // 10 AS max_logical, count(*) * 3 // 10 AS max_attempts, CAST(sum(input_tokens) AS BIGINT) * 6 // 10 AS max_input, CAST(sum(output_tokens) AS BIGINT) * 7 // 10 AS max_output, CAST(sum(cost) AS BIGINT) * 2 // 10 AS max_usd, CAST(sum(cost) AS BIGINT) // 20 AS max_eur, CASE WHEN ledger_id % 5 = 0 THEN max(seq) * 0.5 END AS walltime FROM rq GROUP BY 1),
st(ledger_id, n, seq, currency, why, lg, ac, ti, tt, usd, eur) AS (SELECT ledger_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM lm
 UNION ALL SELECT ledger_id, n, seq, currency, why, CASE WHEN why IS NULL AND NOT http THEN lg + 1 ELSE lg END, CASE WHEN why IS NULL AND http THEN ac + 1 ELSE ac END, CASE WHEN why IS NULL THEN ti + input_tokens ELSE ti END, CASE WHEN why IS NULL THEN tt + output_tokens ELSE tt END, CASE WHEN why IS NULL AND currency = 'USD' THEN usd + cost ELSE usd END, CASE WHEN why IS NULL AND currency = 'EUR' THEN eur + cost ELSE eur END
 FROM (SELECT rq.*, lg, ac, ti, tt, usd, eur, {_WHY} AS why FROM st JOIN rq ON rq.ledger_id = st.ledger_id AND rq.n = st.n + 1 JOIN lm ON lm.ledger_id = rq.ledger_id))
SELECT ledger_id, seq, why IS NULL AS accepted, why AS reason, lg AS logical, ac AS attempts, ti AS input_tokens, tt AS output_tokens, CASE currency WHEN 'USD' THEN usd WHEN 'EUR' THEN eur WHEN 'XXX' THEN 0 END AS cost FROM st WHERE n > 0""",
    "branch_trajectories": f"""WITH RECURSIVE {_E6}, m AS (SELECT branch, p AS project_id, CASE WHEN p % 3 <> 0 THEN p // 2 END AS merged_into, CASE WHEN p % 3 <> 0 THEN 1 + (p * 5 + branch) % 16 END AS cycle FROM (SELECT DISTINCT branch FROM e) CROSS JOIN range(40) AS r(p)),
t AS (SELECT DISTINCT branch, c AS cycle FROM e CROSS JOIN range({CYCLES + 1}) AS r(c) WHERE e.cycle <= {CYCLES}),
ch(branch, cycle, project_id, pos, k) AS (SELECT t.branch, t.cycle, project_id, project_id, 0 FROM t JOIN m ON m.branch = t.branch UNION ALL SELECT ch.branch, ch.cycle, ch.project_id, m.merged_into, k + 1 FROM ch JOIN m ON m.branch = ch.branch AND m.project_id = ch.pos AND m.cycle <= ch.cycle),
root AS (SELECT branch, cycle, project_id, max_by(pos, k) AS root FROM ch GROUP BY 1, 2, 3),
a AS (SELECT t.branch, t.cycle, count(e.branch) AS entries, coalesce(CAST(sum(units) AS BIGINT), 0) AS units FROM t LEFT JOIN e ON e.branch = t.branch AND e.cycle <= t.cycle GROUP BY 1, 2),
v AS (SELECT branch, cycle, count(*) AS distinct_values, sum(c) AS n, sum(c * ln(c)) AS s FROM (SELECT t.branch, t.cycle, topic_id, count(*) AS c FROM t JOIN e ON e.branch = t.branch AND e.cycle <= t.cycle WHERE topic_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
g AS (SELECT branch, cycle, count(*) AS live, sum(c) AS pairs FROM (SELECT t.branch, t.cycle, root, count(DISTINCT agent_id) AS c FROM t JOIN e ON e.branch = t.branch AND e.cycle <= t.cycle AND units > 0 JOIN root ON root.branch = t.branch AND root.cycle = t.cycle AND root.project_id = e.project_id GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT a.branch, CAST(a.cycle AS INTEGER) AS cycle, entries, units, coalesce(distinct_values, 0) AS distinct_values, round(coalesce(ln(n) - s / n, 0), 6) + 0.0 AS entropy, coalesce(live, 0) AS live_projects, round(coalesce(pairs / live, 0), 6) AS mean_contributors FROM a LEFT JOIN v USING (branch, cycle) LEFT JOIN g USING (branch, cycle)""",
    "branch_measures": f"""WITH RECURSIVE e AS (SELECT event_id % 6 AS branch, CAST(event_id // 7 % 22 AS INTEGER) AS cycle, event_id AS n, user_id AS u, event_type, value, (event_id * 31 + user_id) % 23 AS topic_id FROM events),
ag AS (SELECT DISTINCT branch, u AS agent_id, u // 2 % 3 AS field, (u * 17 + branch) % 50 / 10 AS reputation FROM e),
pj AS (SELECT branch, agent_id AS p, CASE WHEN agent_id % 10 IN (1, 2) THEN 'merged' WHEN agent_id % 10 = 3 THEN 'abandoned' WHEN agent_id % 10 = 4 THEN 'active' WHEN agent_id % 10 = 5 THEN 'censored' ELSE 'completed' END AS status, (agent_id * 3 + branch) % 22 >= {START} AS late, list_filter([agent_id - agent_id % 3, agent_id - agent_id % 3 + 1, agent_id - agent_id % 3 + 2], lambda a: (a + branch) % 2 = 0) AS members, (agent_id * 13 + branch) % 100 / 100 AS novelty, (agent_id * 29 + branch) % 100 / 100 AS attention, {A.sql_tokens("text")} AS w FROM ag LEFT JOIN documents ON doc_id = agent_id * 6 + branch),
ch(branch, p, pos, k) AS (SELECT branch, p, p, 0 FROM pj UNION ALL SELECT ch.branch, ch.p, pos - 1, k + 1 FROM ch JOIN pj ON pj.branch = ch.branch AND pj.p = ch.pos - 1 WHERE ch.pos % 10 IN (1, 2)),
rt AS (SELECT branch, p, max_by(pos, k) AS root FROM ch GROUP BY 1, 2),
ef AS (SELECT branch, u - u % 3 + n % 3 AS p, u AS agent_id, CASE WHEN n % 13 <> 0 THEN CAST(round(value) AS BIGINT) ELSE 0 END AS units FROM e WHERE cycle >= {START}),
ct AS (SELECT branch, root, count(*) AS c, count(DISTINCT field) AS f FROM (SELECT ef.branch, root, agent_id, sum(units) AS units FROM ef JOIN rt ON rt.branch = ef.branch AND rt.p = ef.p GROUP BY 1, 2, 3 HAVING sum(units) > 0) AS g JOIN ag USING (branch, agent_id) GROUP BY 1, 2),
mf AS (SELECT branch, p, count(DISTINCT field) AS f FROM (SELECT branch, p, unnest(members) AS agent_id FROM pj) JOIN ag USING (branch, agent_id) GROUP BY 1, 2),
dn AS (SELECT pj.branch, pj.p, coalesce(c, 0) AS c, coalesce(ct.f, 0) AS f, coalesce(mf.f, 0) AS m, len(members) AS team, novelty, attention, w FROM pj LEFT JOIN ct ON ct.branch = pj.branch AND ct.root = pj.p LEFT JOIN mf ON mf.branch = pj.branch AND mf.p = pj.p WHERE status = 'completed' AND late),
tx AS (SELECT a.branch, 1 - sum(round(len(list_intersect(a.w, b.w)) / greatest(1, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 9)) / count(*) AS d FROM dn a JOIN dn b ON a.branch = b.branch AND a.p < b.p GROUP BY 1),
o AS (SELECT branch, count(*) AS outputs, count(*) FILTER (c = 1) AS solo, count(*) FILTER (c >= 2) AS teams, sum(CASE WHEN c > 0 THEN 1 / c ELSE 0 END) AS disc, avg(c) AS c, avg(team) AS team, avg(novelty) AS novelty, avg(attention) AS attention, avg(CASE WHEN f > 1 THEN 1 ELSE 0 END) AS cf, avg(CASE WHEN m > 1 THEN 1 ELSE 0 END) AS cm FROM dn GROUP BY 1),
dr AS (SELECT branch, sum(cand) AS cand, sum(c) AS n, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM (SELECT branch, topic_id, sum(1 + n % 5) AS cand, count(*) AS c FROM e WHERE cycle >= {START} AND event_type IN ('view', 'click') GROUP BY 1, 2) GROUP BY 1),
rd AS (SELECT branch, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM (SELECT branch, topic_id, count(*) AS c FROM e WHERE event_type = 'view' GROUP BY 1, 2) GROUP BY 1),
ps AS (SELECT branch, count(*) AS started, count(*) FILTER (status = 'merged') AS merged, count(*) FILTER (status = 'abandoned') AS abandoned, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status IN ('active', 'censored')) AS censored FROM pj WHERE late GROUP BY 1),
iv AS (SELECT branch, sum(acc) / sum(c) AS acc, avg(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS conflict FROM (SELECT branch, n % 1009 AS target, count(*) AS c, count(*) FILTER (value < 50) AS acc FROM e WHERE cycle >= {START} AND event_type = 'purchase' GROUP BY 1, 2) GROUP BY 1),
au AS (SELECT branch, avg(CASE WHEN n % 5 < 3 THEN 1 ELSE 0 END) FILTER (event_type = 'error' AND n % 11 <> 0) AS short, avg(CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END) FILTER (event_type = 'signup') AS ex FROM e WHERE cycle >= {START} GROUP BY 1),
te AS (SELECT branch, CAST(sum(units) AS DOUBLE) AS units FROM ef GROUP BY 1), rp AS (SELECT branch, avg(reputation) AS rep FROM ag GROUP BY 1)
SELECT branch, CAST(coalesce(cand, 0) AS BIGINT) AS candidate_ideas_generated, CAST(coalesce(dr.n, 0) AS BIGINT) AS drafts_created, coalesce(started, 0) AS projects_started, coalesce(merged, 0) AS projects_merged, coalesce(abandoned, 0) AS projects_abandoned, coalesce(completed, 0) AS projects_completed, coalesce(censored, 0) AS projects_censored, coalesce(outputs, 0) AS final_outputs, coalesce(solo, 0) AS solo_outputs, coalesce(teams, 0) AS team_outputs,
 round(coalesce(units, 0), 6) AS total_effort_units, round(CASE WHEN units <> 0 THEN 100 * coalesce(outputs, 0) / units END, 6) AS outputs_per_100_effort, round(coalesce(disc, 0), 6) AS team_size_discounted_outputs, round(coalesce(o.c, 0), 6) AS mean_contributors_per_output, round(coalesce(team, 0), 6) AS mean_active_team_size_at_completion, round(coalesce(novelty, 0), 6) AS lexical_novelty_proxy, round(coalesce(attention, 0), 6) AS community_attention_proxy, round(coalesce(round(d, 6), 0), 6) AS text_diversity,
 round(coalesce(dr.h, 0), 6) AS selected_topic_entropy, round(coalesce(rd.h, 0), 6) AS reading_topic_entropy, round(coalesce(acc, 0), 6) AS invitation_acceptance_rate, round(coalesce(conflict, 0), 6) AS invitation_conflict_rate, round(coalesce(short, 0), 6) AS candidate_shortfall_rate, round(coalesce(ex, 0), 6) AS exit_rate, round(coalesce(cf, 0), 6) AS cross_field_output_rate, round(coalesce(cm, 0), 6) AS current_cross_field_rate, round(rep, 6) AS mean_simulated_reputation
FROM rp LEFT JOIN dr USING (branch) LEFT JOIN rd USING (branch) LEFT JOIN ps USING (branch) LEFT JOIN iv USING (branch) LEFT JOIN au USING (branch) LEFT JOIN te USING (branch) LEFT JOIN o USING (branch) LEFT JOIN tx USING (branch)""",
    "review_import_faults": f"WITH {_REVIEWS} SELECT coalesce(fault, 'none') AS fault, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM fx GROUP BY 1",
    "review_import_lifecycle": f"WITH {_REVIEWS}, g AS (SELECT review_id, reviewer_id FROM fx WHERE fault IS NULL UNION SELECT item, who FROM bo WHERE k % 19 = 0 AND w = 1), c AS (SELECT count(*) AS requested, count(g.review_id) AS imported FROM (SELECT DISTINCT item, who FROM bo WHERE k % 23 <> 0) AS a LEFT JOIN g ON g.review_id = a.item AND g.reviewer_id = a.who) SELECT requested, imported, requested - imported AS remaining, CASE WHEN imported = 0 THEN 'awaiting_reviews' WHEN requested = imported THEN 'reviews_imported_complete' ELSE 'reviews_partially_imported' END AS status FROM c",
    "dependency_results": f"WITH {A.SQL_POLICIES}, t AS (SELECT doc_id % 12 AS topic, coalesce(text, '') || CASE WHEN doc_id % 12 = 3 THEN '!' ELSE '' END AS text FROM documents) SELECT topic, policy, count(*) AS n, CAST(sum(len(list_filter(string_split(text, ' '), lambda w: w <> ''))) AS BIGINT) AS words, round(CAST(sum(length(text)) AS BIGINT) * any_value(w_novelty), 3) AS score, topic <> 3 AS hit FROM t CROSS JOIN policies GROUP BY topic, policy",
    "resume_plan": """WITH l AS (SELECT CAST(user_id % 5 AS INTEGER) AS model, user_id || '-' || event_id % 31 AS cell_id, event_id AS seq, event_id * 2 AS at_, CASE WHEN event_type IN ('view', 'purchase') THEN 'started' WHEN event_type = 'error' THEN CASE WHEN event_id % 501 = 0 AND user_id % 5 < 3 THEN 'fatal' ELSE 'failed' END ELSE 'completed' END AS event FROM events),
f AS (SELECT model, cell_id, min(seq) AS s FROM l WHERE event = 'started' GROUP BY 1, 2), x AS (SELECT l.model, l.cell_id, arg_min(event, seq) AS outcome FROM l JOIN f ON f.model = l.model AND f.cell_id = l.cell_id WHERE event <> 'started' AND seq > s GROUP BY 1, 2),
b AS (SELECT DISTINCT model FROM x WHERE outcome = 'fatal'), sc AS (SELECT CAST(user_id % 5 AS INTEGER) AS model, user_id || '-' || c AS cell_id FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN range(40) AS r(c)),
p AS (SELECT sc.*, outcome, CASE WHEN outcome = 'completed' THEN 'completed' WHEN outcome IS NOT NULL THEN 'failed' WHEN s * 2 + 5000 > 15000 THEN 'in_flight' WHEN s IS NOT NULL THEN 'interrupted' WHEN b.model IS NOT NULL THEN 'blocked' ELSE 'to_run' END AS status FROM sc LEFT JOIN f USING (model, cell_id) LEFT JOIN x USING (model, cell_id) LEFT JOIN b ON b.model = sc.model)
SELECT model, cell_id, status, CASE status WHEN 'blocked' THEN 'model' WHEN 'failed' THEN outcome WHEN 'interrupted' THEN 'in_flight_unknown' END AS reason FROM p""",
}
