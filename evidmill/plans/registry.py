"""Named queries over the test tables, and the equivalent SQL of each."""

from __future__ import annotations

from evidmill.plans import audit_queries, check_queries, flow_queries, judged_queries, retrieval_queries, study_queries

_PARTS = (retrieval_queries, study_queries, check_queries, audit_queries, judged_queries, flow_queries)
QUERIES: dict = {name: run for part in _PARTS for name, run in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
