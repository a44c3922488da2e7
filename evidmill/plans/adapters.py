"""The test tables seen as papers, queries, judgements, ledgers and ratings, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidmill.functions import text as T
from evidmill.operators.graph import written

_KEYS = ["ther thon", "thre thes", "erin anea", "eren thtion", "thing erst", "anon attion", "onre ernt", "ersh ertion", "onan erth", "ened inea", "stth heer", "tian anre"]
FIELDS = ["agents", "learning", "science"]
#: (topic_id, field, keywords, sentence_only)
TOPICS = [(f"t{i:02d}", FIELDS[i % 3], k.split(), i % 3 == 0) for i, k in enumerate(_KEYS)]


def tables(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf}/{n}.parquet") for n in names]


def spread(df: DataFrame, key: str, least: int = 16 << 20) -> DataFrame:
    """Deals the rows of an input with less than ``least`` bytes a core, or in fewer files than cores, over all cores: its few row groups would keep most of them idle.

    Other inputs are left as their files are split, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, size >> 26), key) if size < least * cores or len(df.inputFiles()) < cores else df


def papers(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(tables(spark, sf, "documents")[0].select("doc_id", "text"), "doc_id")
    title = F.substring_index(F.coalesce("text", F.lit("")), ".", 1)  # split_part() would split the whole text
    return d.select(
        F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("id"),
        title.alias("title"),
        F.expr("substr(coalesce(text, ''), length(substring_index(coalesce(text, ''), '.', 1)) + 2)").alias("abstract"),
        (F.lit(2015) + F.col("doc_id") % 12).cast("int").alias("year"),
        F.element_at(F.array(*[F.lit(f) for f in FIELDS]), (F.col("doc_id") % 3 + 1).cast("int")).alias("field"),
    )


def topics(spark: SparkSession) -> DataFrame:
    """The 12 frozen topics with their profiles: a dimension of fixed size."""
    rows = [(t, f, f"{k[0]} beside {k[1]}", k, [" ".join(k), "the " + k[0]], [[k[0]], [k[1]]], ["the"], s) for t, f, k, s in TOPICS]
    return spark.createDataFrame(rows, "topic_id string, field string, description string, keywords array<string>, phrases array<string>, concept_groups array<array<string>>, generic array<string>, sentence_only boolean").coalesce(1)


#: (topic_id, topic named, text) of the memory terms of the twelve readers; some have none.
MEMORY = [(t, f"T{(i + 6) % 12:02d} ", None) for i, (t, *_) in enumerate(TOPICS) if i % 3 != 2] + [(t, f"T{(i + 1) % 12:02d}" if i % 2 else None, "the onan-erth") for i, (t, *_) in enumerate(TOPICS) if i % 4 == 1]


def memory(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MEMORY, "topic_id string, m_topic string, m_text string").coalesce(1)


def reads(spark: SparkSession, sf: str, by: DataFrame | None = None) -> DataFrame:
    """topic_id, id, w: what the reader of each topic (the user of its number) has viewed or clicked; with ``by``, for its query_id instead."""
    e = tables(spark, sf, "events")[0].where(F.col("event_type").isin("view", "click"))
    topic = F.concat(F.lit("t"), F.lpad(F.col("user_id").cast("string"), 2, "0"))
    seen = e.where(F.col("user_id") < len(TOPICS)).select(topic.alias("topic_id"), F.lpad(F.col("event_id").cast("string"), 19, "0").alias("id"))
    seen = written(seen, "seen")
    few = F.broadcast(seen) if seen.count() <= 500_000 else seen
    # words only of what has been read
    seen = few.join(papers(spark, sf).select("id", "title", "abstract"), "id").select("topic_id", "id", T.token_set(F.concat_ws(" ", "title", "abstract")).alias("w"))
    return seen if by is None else seen.join(by.select("query_id", "topic_id"), "topic_id").drop("topic_id")


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("balanced", 0.5, 0.5), ("novelty", 1.0, 0.0), ("recognition", 0.0, 1.0)], "policy string, w_novelty double, w_recognition double").coalesce(1)


def bench_queries(spark: SparkSession, sf: str) -> DataFrame:
    b = tables(spark, sf, "benchmark")[0]
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Graded documents; a document that isn't here is unjudged."""
    d = tables(spark, sf, "labels")[0]
    return d.select(F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("id"), (F.col("quality") * (2 - F.col("toxic"))).cast("int").alias("grade"))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Effort entries from events: 40 projects, agents as users, ticks in seconds from the epoch modulo 30."""
    e = tables(spark, sf, "events")[0]
    return e.select(
        F.col("event_id").alias("entry_id"),
        F.col("user_id").alias("agent_id"),
        (F.col("user_id") % 40).alias("project_id"),
        F.col("event_type").alias("action"),
        F.round("value").cast("bigint").alias("units"),
        (F.col("event_id") % 30).cast("int").alias("tick"),
    )


def merges(spark: SparkSession) -> DataFrame:
    """Project p merges into p div 2 where p % 3 = 1; the others end their chain."""
    return spark.range(40).select(F.col("id").alias("project_id"), F.when(F.col("id") % 3 == 1, F.floor(F.col("id") / 2)).alias("merged_into"))


def branches(spark: SparkSession, sf: str) -> DataFrame:
    """Branch metrics by seed, policy and network from orders and customers."""
    o, c = tables(spark, sf, "orders", "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    policy = F.element_at(F.array(*[F.lit(x) for x in ("balanced", "novelty", "recognition")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    network = F.when(F.col("o_custkey") % 2 == 0, "closed").otherwise("open")
    return j.groupBy((F.col("c_nationkey") % 10).cast("int").alias("seed"), policy.alias("policy"), network.alias("network")).agg(
        F.count("*").alias("outputs"), F.sum((F.col("o_totalprice") * 100).cast("bigint")).alias("effort"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.count_if(F.col("o_orderstatus") == "O").alias("started")
    )


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Two reviewers' scores 1..5 on four dimensions, some missing, in strata."""
    li = tables(spark, sf, "lineitem")[0]
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    item = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    base = li.select(item.alias("item_id"), (F.col("l_orderkey") % 6).cast("int").alias("stratum"), k.alias("k"))
    reviewer = F.explode(F.array(F.lit(1), F.lit(2))).alias("reviewer")
    rows = base.select("item_id", "stratum", "k", reviewer)
    dims = [F.when((F.col("k") + d) % 17 == 0, None).otherwise((F.col("k") * (d + 1) + F.when((F.col("k") + d) % 4 == 0, F.col("reviewer")).otherwise(0)) % 5 + 1).cast("int").alias(f"d{d}") for d in range(4)]
    return rows.select("item_id", "stratum", "reviewer", *dims)


_G = "['agents', 'learning', 'science']"
SQL_PAPERS = f"papers AS (SELECT lpad(CAST(doc_id AS VARCHAR), 19, '0') AS id, split_part(coalesce(text, ''), '.', 1) AS title, substr(coalesce(text, ''), length(split_part(coalesce(text, ''), '.', 1)) + 2) AS abstract, CAST(2015 + doc_id % 12 AS INTEGER) AS year, {_G}[doc_id % 3 + 1] AS field FROM documents)"
SQL_TOPICS = "topics AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{f}', ['{k[0]}', '{k[1]}'], {str(s).lower()}, '{k[0]} beside {k[1]}')" for t, f, k, s in TOPICS) + ") AS v(topic_id, field, keywords, sentence_only, description))"
SQL_MEMORY = "memory AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in MEMORY) + ") AS v(topic_id, m_topic, m_text))"
SQL_POLICIES = "policies AS (SELECT * FROM (VALUES ('balanced', 0.5::DOUBLE, 0.5::DOUBLE), ('novelty', 1.0::DOUBLE, 0.0::DOUBLE), ('recognition', 0.0::DOUBLE, 1.0::DOUBLE)) AS v(policy, w_novelty, w_recognition))"
SQL_QRELS = "qrels AS (SELECT lpad(CAST(doc_id AS VARCHAR), 19, '0') AS id, CAST(quality * (2 - toxic) AS INTEGER) AS grade FROM labels)"
SQL_LEDGER = "ledger AS (SELECT event_id AS entry_id, user_id AS agent_id, user_id % 40 AS project_id, event_type AS action, CAST(round(value) AS BIGINT) AS units, CAST(event_id % 30 AS INTEGER) AS tick FROM events)"
SQL_MERGES = "merges AS (SELECT i AS project_id, CASE WHEN i % 3 = 1 THEN i // 2 END AS merged_into FROM range(40) AS r(i))"
SQL_BRANCHES = "branches AS (SELECT CAST(c_nationkey % 10 AS INTEGER) AS seed, ['balanced', 'novelty', 'recognition'][o_orderkey % 3 + 1] AS policy, CASE WHEN o_custkey % 2 = 0 THEN 'closed' ELSE 'open' END AS network, count(*) AS outputs, CAST(sum(CAST(trunc(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS effort, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS completed, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS started FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"
SQL_RATINGS = "ratings AS (SELECT item_id, stratum, reviewer, " + ", ".join(f"CAST(CASE WHEN (k + {d}) % 17 = 0 THEN NULL ELSE (k * {d + 1} + CASE WHEN (k + {d}) % 4 = 0 THEN reviewer ELSE 0 END) % 5 + 1 END AS INTEGER) AS d{d}" for d in range(4)) + " FROM (SELECT l_orderkey || '-' || l_linenumber AS item_id, CAST(l_orderkey % 6 AS INTEGER) AS stratum, l_orderkey * 7 + l_linenumber AS k FROM lineitem) CROSS JOIN (VALUES (1), (2)) AS v(reviewer))"


def sql_words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


def sql_tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9_]+'))"


#: Needs papers; rd has the words of what each topic's reader has read.
SQL_READS = f"rd AS (SELECT 't' || lpad(CAST(user_id AS VARCHAR), 2, '0') AS topic_id, papers.id, {sql_tokens("title || ' ' || abstract")} AS w FROM events JOIN papers ON papers.id = lpad(CAST(event_id AS VARCHAR), 19, '0') WHERE user_id < 12 AND event_type IN ('view', 'click'))"
