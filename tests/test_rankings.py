"""Rankings whose pairs are met where a text is."""

import glob
import math

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidmill.operators import audits, retrieval, scoring
from evidmill.plans import adapters


@pytest.mark.parametrize("block", [1 << 17, 3])
def test_counterfactual_meets_pairs_where_postings_are(spark, monkeypatch, block):
    """The same rows as all pairs by hand, papers without a common word among them; no table of pairs is written."""
    topic = ("t0", "f", "", ["deep", "net"], ["deep net"], [["deep"], ["net"]], ["the"], False)
    topics = spark.createDataFrame([topic], "topic_id string, field string, description string, keywords array<string>, phrases array<string>, concept_groups array<array<string>>, generic array<string>, sentence_only boolean")
    texts = [(f"{i:02d}", "Deep-Net" if i % 9 == 7 else "title", "apple " * (i % 5) + "pear. Deep, a net" * (i % 4 == 1) + " word" * (i % 3)) for i in range(40)]
    papers = spark.createDataFrame([(i, "f", t, a) for i, t, a in texts], "id string, field string, title string, abstract string")
    asked = [(1, "apple", "t0"), (2, "APPLE pear apple", "none"), (3, "word", "t0"), (4, "nowhere", "t0")]
    queries = spark.createDataFrame(asked, "query_id long, query string, topic_id string")
    monkeypatch.setattr(scoring, "BLOCK_WORDS", block)
    monkeypatch.setattr(scoring, "HELD", 20)
    found = retrieval.Evidenced(papers, queries, topics)
    score = {(r.query_id, r.id): r.score for r in retrieval.bm25(papers, queries).collect()}
    gain = {r.id: r.evidence for r in retrieval.evidence(papers, topics, True).where("evidence > 0").collect()}
    assert {(r.topic_id, r.id): r.evidence for r in found.evidence().collect()} == {("t0", i): e for i, e in gain.items()} and gain
    peaks = audits.denominators(found.top(3), found.top(3), found.evidence(), queries)
    known = {r.query_id: r for r in peaks.collect()}
    got = {}
    for r in found.reranked(peaks.where("query_id <> 3"), k=12).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.rerank_score))
    for q, _, topic in asked:
        part = lambda x, d: x / d if d > 0 else 0.0
        g = gain if topic == "t0" else {}
        every = [(i, math.floor((part(score.get((q, i), 0), known[q].k_bm25) + 0.1 * part(g.get(i, 0), known[q].k_topic)) * 1e5 + 0.5) / 1e5) for i, *_ in texts if (q, i) in score or i in g]
        assert got.get(q, []) == ([] if q == 3 else sorted(every, key=lambda x: (-x[1], x[0]))[:12])
    assert {c for _, hits, _ in found.index for c in hits.columns} == {"id", "length", "codes", "counts", "gains"} and all(hits.count() == 40 for _, hits, _ in found.index)


def test_papers_are_not_split_by_expressions(spark):
    """Texts meet queries as bytes: words of every paper are never made into Spark's arrays."""
    p = spark.createDataFrame([("a", "One two", "three_4 É One"), ("b", None, None)], "id string, title string, abstract string")
    q = spark.createDataFrame([(1, "one ONE three 4"), (2, "three_4 two"), (3, None)], "query_id long, query string")
    pairs = retrieval.jaccard_hits(p, q, field=False)
    assert sorted((r.query_id, r.id, r.score) for r in pairs.collect()) == [(1, "a", 0.2), (2, "a", 0.666666667)]
    assert "regexp_extract_all" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {(r.query_id, r.id) for r in retrieval.bm25(p, q).collect()} == {(1, "a"), (2, "a")}


def test_a_large_table_in_one_file_is_dealt(spark, tmp_path):
    spark.range(2000).coalesce(1).write.parquet(str(tmp_path / "one"))
    pq.write_table(pq.read_table(glob.glob(str(tmp_path / "one" / "*.parquet"))[0]), str(tmp_path / "one.parquet"))
    got = adapters.spread(spark.read.parquet(str(tmp_path / "one.parquet")), "id", least=0)
    cores = spark.sparkContext.defaultParallelism
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() == cores > 1
    spark.range(2000).repartition(cores).write.parquet(str(tmp_path / "many"))
    many = adapters.spread(spark.read.parquet(str(tmp_path / "many")), "id", least=0)
    assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()
