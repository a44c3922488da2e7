"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from evidmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["token_sets", "bm25_topk", "jaccard_topk", "topic_recognition", "evidence_token_bounded", "repaired_pool", "ranked_metrics", "loss_by_stage", "paired_effects", "merge_chain_effort", "rater_agreement", "keyed_choice"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted(str([f"{v:.6g}" if isinstance(v, float) else v for v in r]) for r in df.values.tolist())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    a, b = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def test_oracles_name_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry_works_without_optional_parts():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
