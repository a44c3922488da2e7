"""Runs that are taken up again: contracts, results by dependency, and cells as states over a log."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidmill.sources.fingerprints import normalised


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def hold_contract(spark: SparkSession, path: str, contract: dict[str, dict]) -> None:
    """Writes the contract of a run, or raises if the folder was begun under another one.

    ``contract`` has named parts (production, evaluation, ...) of names and
    digests; the parts are held apart, and the error names what changed in which.
    """
    file = f"{path.rstrip('/')}/contract"
    p, fs = _fs(spark, file)
    text = {part: json.dumps(items, sort_keys=True) for part, items in contract.items()}
    if not fs.exists(p):
        spark.createDataFrame(sorted(text.items()), "part string, items string").coalesce(1).write.parquet(file)
        return
    old = {r["part"]: r["items"] for r in spark.read.parquet(file).collect()}
    changed = []
    for part in sorted(old.keys() | text.keys()):
        a, b = json.loads(old.get(part, "{}")), json.loads(text.get(part, "{}"))
        changed += [f"{part}.{k}" for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)]
    if changed or old.keys() != text.keys():
        raise ValueError("begun under another contract: " + ", ".join(changed or sorted(old.keys() ^ text.keys())))


def dependency_key(cells: DataFrame, on: list[str], versions: dict[str, str]) -> Column:
    """SHA-256 of all that a cell's result depends on: its columns ``on`` (any types) and the versions of code and settings."""
    body = F.struct(*[normalised(F.col(c), cells.schema[c].dataType).alias(c) for c in sorted(on)])
    return F.sha2(F.concat_ws("\u0000", F.to_json(body, {"ignoreNullFields": "false"}), F.lit(json.dumps(versions, sort_keys=True))), 256)


class ResultStore:
    """Results of cells, kept by dependency key in a folder per run below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _stored(self) -> DataFrame | None:
        p, fs = _fs(self.spark, f"{self.path}/results")
        return self.spark.read.parquet(f"{self.path}/results") if fs.exists(p) and len(fs.listStatus(p)) else None

    def get(self, cells: DataFrame, on: list[str], versions: dict[str, str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The cells with their results and hit: whether the result was there already.

        ``compute`` gets only the cells whose key isn't stored, with the column
        dep_key, one cell a key, and returns a row for each with dep_key and the
        results; cells of one key share a result.  A key without a row raises,
        before anything is kept.  New results are written before they are used,
        so a run that breaks off loses none that are done.
        """
        keyed = cells.withColumn("dep_key", dependency_key(cells, on, versions))
        old = self._stored()
        todo = keyed.dropDuplicates(["dep_key"])
        if old is not None:
            todo = todo.join(old.select("dep_key"), "dep_key", "left_anti")
        want = todo.count()
        new = None
        if want or old is None:
            name = uuid.uuid4().hex
            made = compute(todo)
            made.write.parquet(f"{self.path}/open/{name}")
            new = self.spark.read.schema(made.schema).parquet(f"{self.path}/open/{name}")
            n = new.agg(F.count("*").alias("n"), F.count_distinct("dep_key").alias("k")).first()
            src, fs = _fs(self.spark, f"{self.path}/open/{name}")
            if n["n"] != want or n["k"] != want:
                fs.delete(src, True)
                raise ValueError(f"{want} cells computed, but {n['n']} results for {n['k']} of them")
            fs.mkdirs(_fs(self.spark, f"{self.path}/results")[0])
            fs.rename(src, _fs(self.spark, f"{self.path}/results/run={name}")[0])
            new = self.spark.read.schema(made.schema).parquet(f"{self.path}/results/run={name}").withColumn("hit", F.lit(False))
        known = new if old is None else old.drop("run").withColumn("hit", F.lit(True))
        if old is not None and new is not None:
            known = known.unionByName(new)
        return keyed.join(known, "dep_key", "left")


#: What the log of a run says of a cell; budget and fatal are failures that block what hasn't begun: everything, or the cell's model.
ENDS = ["completed", "failed", "fatal", "budget"]


def cell_states(log: DataFrame) -> DataFrame:
    """model, cell_id, started, ended, outcome of every cell with a start: its first start, and the first end after it.

    ``log`` is append-only: model, cell_id, seq (rising), at, event (started or
    one of ENDS).  What follows the end of a cell, or comes before its start,
    doesn't count: a cell runs once.
    """
    first = log.where("event = 'started'").groupBy("model", "cell_id").agg(F.min_by("seq", "seq").alias("s"), F.min_by("at", "seq").alias("started"))
    ends = log.where(F.col("event").isin(ENDS)).join(first.select("model", "cell_id", "s"), ["model", "cell_id"]).where(F.col("seq") > F.col("s"))
    last = ends.groupBy("model", "cell_id").agg(F.min_by("at", "seq").alias("ended"), F.min_by("event", "seq").alias("outcome"))
    return first.drop("s").join(last, ["model", "cell_id"], "left").select("model", "cell_id", "started", "ended", "outcome")


STATE = "started bigint, ended bigint, outcome string"


def followed_states(log: DataFrame) -> DataFrame:
    """cell_states() of a streamed log, as updates: the state of a cell is its start and its end, and is told whenever it changes.

    Events of a cell have to arrive in order of seq, as an append-only log gives
    them; those of one micro-batch are sorted.
    """
    kinds = {f.name: f.dataType.simpleString() for f in log.schema.fields}

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, ended, outcome = state.get if state.exists else (None, None, None)
        was = (started, ended, outcome)
        for r in pd.concat(list(parts)).sort_values("seq").itertuples():
            if started is None and r.event == "started":
                started = int(r.at)
            elif started is not None and outcome is None and r.event in ENDS:
                ended, outcome = int(r.at), r.event
        state.update((started, ended, outcome))
        if (started, ended, outcome) != was:
            yield pd.DataFrame({"model": [key[0]], "cell_id": [key[1]], "started": pd.array([started], "Int64"), "ended": pd.array([ended], "Int64"), "outcome": [outcome]})

    out = f"model {kinds['model']}, cell_id {kinds['cell_id']}, {STATE}"
    return log.groupBy("model", "cell_id").applyInPandasWithState(step, out, STATE, "update", GroupStateTimeout.NoTimeout)


def resume_plan(schedule: DataFrame, states: DataFrame, now: int, lease: int) -> DataFrame:
    """Every scheduled cell with its status, and what keeps it from running.

    completed and failed cells stay so: a failure isn't tried again.  A begun
    cell without an end is in_flight while its lease runs, then interrupted: the
    request may have been charged, so it isn't repeated.  Of the cells never
    begun, those of a model with a fatal end, or all after a budget end, are
    blocked; the others are to run.
    """
    blocks = states.where("outcome = 'fatal'").groupBy("model").agg(F.min("ended").alias("blocked_at"))
    everything = states.agg(F.min(F.when(F.col("outcome") == "budget", F.col("ended"))).alias("stopped_at"))
    j = schedule.select("model", "cell_id").distinct().join(states, ["model", "cell_id"], "left").join(blocks, "model", "left").crossJoin(F.broadcast(everything))  # a row
    begun = F.col("started").isNotNull()
    status = F.when(F.col("outcome") == "completed", "completed").when(F.col("outcome").isNotNull(), "failed")
    status = status.when(begun & (F.col("started") + lease > now), "in_flight").when(begun, "interrupted")
    status = status.when(F.col("stopped_at").isNotNull() | F.col("blocked_at").isNotNull(), "blocked").otherwise("to_run")
    why = F.when(status == "blocked", F.when(F.col("stopped_at").isNotNull(), "budget").otherwise("model")).when(status == "failed", F.col("outcome")).when(status == "interrupted", "in_flight_unknown")
    return j.select("model", "cell_id", status.alias("status"), why.alias("reason"))
