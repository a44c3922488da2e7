"""Queries over small tables that the given ones don't resemble: other letters, large keys, many rows."""

import os

import duckdb
import pytest

from pyspark.sql import functions as F

from evidmill.operators import judgements
from evidmill.plans import registry
from tests.test_queries import SF, TABLES, rows


@pytest.fixture
def same(spark, tmp_path):
    """Checks a query against its SQL over the smallest tables, some of them replaced by a selection from themselves."""

    def check(name, **selections):
        c = duckdb.connect()
        for t in TABLES:
            path = f"{tmp_path}/{t}.parquet"
            if t in selections:
                c.execute(f"COPY (SELECT {selections[t]} FROM '{SF}/{t}.parquet') TO '{path}' (FORMAT parquet)")
            else:
                os.symlink(f"{SF}/{t}.parquet", path)
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
        a, b = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), c.execute(registry.ORACLES[name]).df()
        assert len(b) and sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)

    return check


def test_responses_are_those_of_events(same):
    same("response_validation")


def test_worlds_of_large_numbers(same):
    same("observations", events="* REPLACE (user_id + 9007199254740993 AS user_id)")


def test_reputations_are_rounded_as_doubles(same):
    """Agents of 80 entries whose mean has four digits, the last of them 5."""
    same("observations", events="* REPLACE (event_id // 80 AS user_id, CAST(event_id // 80 * 8 + 4 + CASE WHEN event_id % 80 < 3 THEN 1 ELSE 0 END AS DOUBLE) AS value)")


def test_peers_without_a_reputation_are_counted_but_not_shown(spark):
    from evidmill.operators import audits

    agents = spark.createDataFrame([(1, 0, 2.5, True, 7, 0), (2, 1, None, True, None, 0), (3, 2, 1.0, False, 9, 0)], "agent_id long, field int, reputation double, available boolean, energy long, world int")
    assert sorted(tuple(r) for r in audits.observations(agents.where("agent_id < 3"), "world").collect()) == [(1, 7, 1, 1, None), (2, None, 1, 1, "1:0:2.5")]
    assert audits.observations(agents, "world").where("agent_id = 1").first()["public"] == "3:2:1.0"


def test_excerpts_in_capitals(spark):
    t = spark.createDataFrame([("a", "t", "f", 1, "Die Straße ist naß"), ("b", "t", "g", 1, "Die Strasse")], "review_id string, topic_id string, family string, old_grade int, text string")
    row = lambda r, x: (r, "v", "retain", 1, "seen", x, "r1", "today")
    d = spark.createDataFrame([row("a", "STRASSE IST NASS"), row("b", "STRASSE"), row("a", "straße ist"), row("a", "strase")], "review_id string, review_version string, decision string, grade int, rationale string, excerpt string, reviewer_id string, reviewed_at string")
    got = [(r.review_id, r.fault) for r in judgements.decided(t, d, "v").collect()]
    assert sorted(got, key=str) == [("a", "excerpt_not_in_text"), ("a", None), ("a", None), ("b", None)]


def test_scores_need_no_shuffle_and_all_blocks_count(spark, monkeypatch):
    """Queries in several blocks, texts held one at a time, ties by id: the same pairs as by hand; only ranking shuffles."""
    from evidmill.operators import retrieval, scoring

    texts = [(f"{i:03d}", "", " ".join(f"w{j}" for j in range(i % 7, i % 7 + 5)) + (" x x" if i % 5 == 0 else "")) for i in range(60)]
    asked = [(q, f"w{q} w{q + 1} x w{q}") for q in range(9)]
    p, q = spark.createDataFrame(texts, "id string, title string, abstract string"), spark.createDataFrame(asked, "query_id long, query string")
    every = {(a, i): len(set(x.split()) & set(t.split())) / len(set(x.split()) | set(t.split())) for a, x in asked for i, _, t in texts}
    monkeypatch.setattr(scoring, "BLOCK_WORDS", 7)
    monkeypatch.setattr(scoring, "HELD", 10)
    pairs = retrieval.jaccard_hits(p, q, field=False)
    assert {(r.query_id, r.id): r.score for r in pairs.collect()} == {x: pytest.approx(s, abs=1e-9) for x, s in every.items() if s}
    assert "Exchange hash" not in pairs._jdf.queryExecution().executedPlan().toString()
    top = retrieval.jaccard_hits(p, q, field=False, k=2).groupBy("query_id", "id").count()
    best = {(a, i) for a, _ in asked for i in sorted([i for i, _, _ in texts if every[a, i]], key=lambda i: (-every[a, i], i))[:2]}
    assert best <= {(r.query_id, r.id) for r in top.collect()} and top.count() <= 2 * len(asked) * p.rdd.getNumPartitions()
    both = retrieval.bm25_topk(p, q, 3).orderBy("query_id", "rank").collect()
    whole = retrieval.ranked(retrieval.bm25(p, q), ["query_id"], [F.desc("score"), F.asc("id")], 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.score) for r in both] == [(r.query_id, r.id, r.score) for r in whole] and both


def test_index_is_written_in_small_row_groups(spark, tmp_path):
    """More than a hundred segments of a task don't wait for one another in the writer."""
    import glob

    import pyarrow.parquet as pq

    from evidmill.llm import decontaminate

    docs = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 60000), i -> hex(xxhash64(i, id))), ' ') AS text")
    found = decontaminate.index(docs, size=1 << 20)
    groups = [pq.ParquetFile(f).metadata.row_group(g).num_rows for f in glob.glob(found._evidmill_path.removeprefix("file://") + "/*.parquet") for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert sum(groups) == 40 and max(groups) <= 20


def test_schedule_keeps_few_pairs_and_completes_short_leaders(spark):
    """Bounds that let 64 or only a few pass give what sorting all pairs gives, also without a field."""
    import hashlib

    from evidmill.operators import matrix

    agents = [(i, None if i % 50 == 0 else i % 3 if i else 7) for i in range(300)]
    df = spark.createDataFrame(agents, "agent_id long, field int")
    want = set()
    for i, f in agents:
        for kind, n in (("same", 1), ("other", 2)):
            of = sorted((hashlib.sha256(f"{i}|{j}".encode()).hexdigest(), j) for j, g in agents if j != i and (f is not None and f == g) == (kind == "same"))
            want |= {(i, j, kind, p + 1) for p, (_, j) in enumerate(of[:n])}
    for through in (64, 1):
        out = matrix.schedule(df, {"same": 1, "other": 2}, through)
        assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)


def test_diversity_sends_no_copies_of_sets_through_a_shuffle(spark, monkeypatch):
    """Many blocks in several passes give the mean over all pairs; sets aren't repeated for the blocks they meet."""
    from evidmill.operators import checks

    monkeypatch.setattr(checks, "SETS", 6)
    monkeypatch.setattr(checks, "SENT", 2, raising=False)
    sets = [(i % 2, i, [f"w{j}" for j in range(i % 9, i % 9 + i % 4)]) for i in range(40)]
    got = checks.text_diversity(spark.createDataFrame(sets, "g int, id long, w array<string>"), "g")
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    for g, d in got.collect():
        w = [set(x) for h, _, x in sets if h == g]
        j = [len(a & b) / max(1, len(a | b)) for k, a in enumerate(w) for b in w[:k]]
        assert d == pytest.approx(1 - sum(j) / len(j), abs=2e-6)


def test_hybrid_joins_and_broadcasts_no_pairs(spark, monkeypatch):
    """Rows as by hand, also for queries without a common word or a topic, with texts and queries in several blocks; pairs of the score meet no join."""
    from evidmill.operators import retrieval, scoring

    monkeypatch.setattr(scoring, "BLOCK_WORDS", 3)
    monkeypatch.setattr(scoring, "HELD", 10)
    topics = spark.createDataFrame([(f"t{i}", "f", [f"red {c}"], [[f"red {c}"]], [], False) for i, c in enumerate("abc")], "topic_id string, field string, phrases array<string>, concept_groups array<array<string>>, generic array<string>, sentence_only boolean")
    texts = [(f"{i:03d}", "f", f"red {'abcd'[i % 4]}" if i % 5 else "none", " ".join(f"w{j % 7}" for j in range(i % 9)) + " red b" * (i % 3 == 0)) for i in range(50)]
    papers, asked = spark.createDataFrame(texts, "id string, field string, title string, abstract string"), [(0, "t0", "w1 w2"), (1, "t1", "w3 w3 w5"), (2, "t2", "zzz"), (3, "t9", "w1"), (4, "t1", "red b")]
    queries = spark.createDataFrame(asked, "query_id long, topic_id string, query string")
    got = retrieval.hybrid(papers, queries, topics)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan
    ev = {(r.topic_id, r.id): r.evidence for r in retrieval.evidence(papers, topics, True).collect() if r.evidence >= 0.8}
    score = {(r.query_id, r.id): r.score for r in retrieval.bm25(papers, queries).collect()}
    want = set()
    for q, t, _ in asked:
        own = {i: (e, score.get((q, i), 0.0)) for (x, i), e in ev.items() if x == t}
        top = max([s for _, s in own.values()], default=0.0)
        total = {i: round(e + (0.2 * s / top if top > 0 else 0.0), 9) for i, (e, s) in own.items()}
        want |= {(q, n, i, own[i][0], total[i]) for n, i in enumerate(sorted(total, key=lambda i: (-total[i], i))[: retrieval.POOL], 1)}
    assert {tuple(r) for r in got.collect()} == want and {r[0] for r in want} == {0, 1, 2, 4}


def test_diversity_sends_no_blocks_through_the_driver(spark, monkeypatch):
    """Blocks of sets are broadcast nowhere: they grow with the documents."""
    from evidmill.operators import checks

    monkeypatch.setattr(checks, "SETS", 6)
    sets = spark.createDataFrame([(i % 3 or None, i, [f"w{j}" for j in range(i % 9)]) for i in range(90)], "g int, id long, w array<string>")
    got = checks.text_diversity(sets, "g")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "BroadcastNestedLoopJoin" not in plan and plan.count("BroadcastExchange") <= 1  # one row a group
    assert {r["g"] for r in got.collect()} == {None, 1, 2}


def test_blocks_of_frequent_and_rare_words(monkeypatch):
    """Sums over two blocks as by hand, whether words meet in matrices or pair by pair."""
    import random

    import pyarrow as pa

    from evidmill.operators import checks

    monkeypatch.setattr(checks, "COLUMNS", 7)
    monkeypatch.setattr(checks, "COUNTED", 50)
    draw = random.Random(1)
    words = lambda: {f"wörd{int(draw.paretovariate(0.4))}" for _ in range(draw.randrange(12))}
    a, b, none = [words() for _ in range(300)], [words() for _ in range(170)], [set(), {"a"}]
    packed = lambda x: [pa.py_buffer(y) for y in checks._packed(pa.array([sorted(s) for s in x], pa.list_(pa.string())))]
    j = lambda x, y: round(len(x & y) / max(1, len(x | y)), 9)
    for x, y in ((a, b), (b, a), (a, none), (none, [set()])):
        assert checks._similarity(packed(x), packed(y), False) == pytest.approx(sum(j(s, t) for s in x for t in y), abs=1e-6)
    assert checks._similarity(packed(a), packed(a), True) == pytest.approx(sum(j(s, t) for i, s in enumerate(a) for t in a[:i]), abs=1e-6)
