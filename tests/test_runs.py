"""Contracts, results by dependency key, and resumed runs."""

import pytest
from pyspark.sql import functions as F

from evidmill.operators import runs


def test_only_changed_cells_are_computed_again(spark, tmp_path):
    store = runs.ResultStore(spark, str(tmp_path / "s"))
    cells = spark.createDataFrame([(t, p, f"in{t}") for t in range(5) for p in "ab"], "topic int, policy string, input string")
    asked = []

    def compute(todo):
        asked.append(sorted((r["topic"], r["policy"]) for r in todo.collect()))
        return todo.select("dep_key", F.concat_ws("/", "input", "policy").alias("result"))

    on, v = ["topic", "policy", "input"], {"code": "1"}
    of = lambda df: sorted((r["topic"], r["policy"], r["result"]) for r in df.collect())
    cold = of(store.get(cells, on, v, compute))
    hot = store.get(cells, on, v, compute)
    assert of(hot) == cold and hot.where("hit").count() == 10 and len(asked) == 1
    changed = cells.withColumn("input", F.when(F.col("topic") == 3, "new").otherwise(F.col("input")))
    again = store.get(changed, on, v, compute)
    assert asked[1] == [(3, "a"), (3, "b")] and again.where("not hit").count() == 2
    assert of(again) == of(runs.ResultStore(spark, str(tmp_path / "other")).get(changed, on, v, compute))
    store.get(cells, on, {"code": "2"}, compute)
    assert len(asked[-1]) == 10
    twin = cells.union(cells.limit(1))
    assert store.get(twin, on, v, compute).count() == 11 and len(asked) == 4


def test_results_that_are_missing_are_not_kept(spark, tmp_path):
    store = runs.ResultStore(spark, str(tmp_path / "s"))
    cells = spark.createDataFrame([(1,), (2,)], "topic int")
    with pytest.raises(ValueError, match="2 cells computed, but 1 results"):
        store.get(cells, ["topic"], {}, lambda t: t.where("topic = 1").select("dep_key", F.lit(1).alias("r")))
    assert store.get(cells, ["topic"], {}, lambda t: t.select("dep_key", F.lit(1).alias("r"))).where("not hit").count() == 2
    assert store.get(cells.limit(0), ["topic"], {}, lambda t: t.select("dep_key", F.lit(1).alias("r"))).count() == 0


def test_a_contract_is_held(spark, tmp_path):
    c = {"production": {"corpus": "a", "code": "b"}, "evaluation": {"qrels": "c"}}
    runs.hold_contract(spark, str(tmp_path / "r"), c)
    runs.hold_contract(spark, str(tmp_path / "r"), {k: dict(reversed(v.items())) for k, v in c.items()})
    with pytest.raises(ValueError, match="evaluation.qrels"):
        runs.hold_contract(spark, str(tmp_path / "r"), c | {"evaluation": {"qrels": "d"}})
    with pytest.raises(ValueError, match="production.code"):
        runs.hold_contract(spark, str(tmp_path / "r"), c | {"production": {"corpus": "a"}})


LOG = "model string, cell_id string, seq long, at long, event string"
EVENTS = [
    ("m", "done", 1, 10, "started"), ("m", "done", 2, 11, "completed"), ("m", "done", 9, 50, "started"), ("m", "done", 10, 51, "failed"),
    ("m", "early", 3, 12, "completed"), ("m", "early", 4, 13, "started"), ("n", "bad", 5, 14, "started"), ("n", "bad", 6, 15, "fatal"), ("n", "late", 7, 95, "started"), ("m", "soft", 8, 16, "started"), ("m", "soft", 11, 17, "failed"),
]


def test_states_and_plan(spark):
    log = spark.createDataFrame(EVENTS, LOG)
    schedule = spark.createDataFrame([("m", c) for c in ("done", "early", "soft", "new")] + [("n", c) for c in ("bad", "late", "other")], "model string, cell_id string")
    plan = lambda x: {(r["model"], r["cell_id"]): (r["status"], r["reason"]) for r in runs.resume_plan(schedule, runs.cell_states(x), now=100, lease=10).collect()}
    want = {("m", "done"): ("completed", None), ("m", "early"): ("interrupted", "in_flight_unknown"), ("m", "soft"): ("failed", "failed"), ("m", "new"): ("to_run", None), ("n", "bad"): ("failed", "fatal"), ("n", "late"): ("in_flight", None), ("n", "other"): ("blocked", "model")}
    assert plan(log) == want
    stopped = log.union(spark.createDataFrame([("m", "x", 20, 60, "started"), ("m", "x", 21, 61, "budget")], LOG))
    assert plan(stopped)[("m", "new")] == ("blocked", "budget") and plan(stopped)[("n", "other")] == ("blocked", "budget")
    assert set(plan(log.limit(0)).values()) == {("to_run", None)}


def test_the_stream_gives_the_table_of_the_batch(spark, tmp_path):
    src, out = tmp_path / "in", []
    for part in (EVENTS[:1] + EVENTS[4:6], EVENTS[1:2] + EVENTS[6:9], EVENTS[2:4] + EVENTS[9:]):
        spark.createDataFrame(sorted(part, key=lambda r: r[2]), LOG).coalesce(1).write.mode("append").parquet(str(src))
        q = runs.followed_states(spark.readStream.schema(LOG).parquet(str(src))).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    latest = {r[:2]: r for r in out}
    assert sorted(latest.values(), key=str) == sorted((tuple(r) for r in runs.cell_states(spark.createDataFrame(EVENTS, LOG)).collect()), key=str)
