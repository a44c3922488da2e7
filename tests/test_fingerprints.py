"""Fingerprints, nested leak scan and the strict reader's line numbers."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evidmill.operators import checks
from evidmill.sources import corpus, fingerprints


def test_layout_order_and_line_ends_do_not_count(spark):
    rows = [("a", '{"b":2,"a":"x\\r\\ny"}'), ("b", '﻿{\n  "a": "x\\ny",\r\n  "b": 2\n}\n'), ("c", '{"b":2,"a":"x\\nz"}'), ("d", '{"a":1,"a":1}'), ("e", '{"a":-Infinity}'), ("f", "[1"), ("g", None), ("h", '[1.50, "é", {}]'), ("i", '{"a":1e999}'), ("j", '{"x\\ry":1,"x\\ny":2}'), ("k", "[" * 100_000)]
    got = {r["k"]: r["c"] for r in spark.createDataFrame(rows, "k string, t string").select("k", fingerprints.canonical_json(F.col("t")).alias("c")).collect()}
    assert got["a"]["sha256"] == got["b"]["sha256"] != got["c"]["sha256"]
    assert got["a"]["canonical"] == '{"a":"x\\ny","b":2}' and got["h"]["canonical"] == '[1.5,"é",{}]'
    assert [got[k]["fault"] for k in "defgik"] == ["repeated key", "non-finite number", "not JSON", None, "non-finite number", "not JSON"] and got["g"]["sha256"] is None
    assert got["a"]["sha256"] == hashlib.sha256(json.dumps({"a": "x\ny", "b": 2}, separators=(",", ":")).encode()).hexdigest()


def test_rows_fingerprint(spark):
    kind = "id string, t string, s struct<b:int,a:string>, m map<string,int>"
    a = spark.createDataFrame([("1", "x\r\ny", (1, "q"), {"k": 1, "j": 2}), ("2", "z", None, None)], kind)
    b = spark.createDataFrame([("2", "z", None, None), ("1", "x\ny", (1, "q"), {"j": 2, "k": 1})], kind).select("s", "m", "t", "id").repartition(3)
    c = a.withColumn("t", F.upper("t"))
    d = a.withColumn("m", F.when(F.col("id") == "1", F.create_map(F.lit("j"), F.lit(2), F.lit("k"), F.lit(3))))
    one = fingerprints.rows_fingerprint(a, "id")
    assert one == fingerprints.rows_fingerprint(b, "id") and one["records"] == 2
    assert len({one["sha256"], fingerprints.rows_fingerprint(c, "id")["sha256"], fingerprints.rows_fingerprint(d, "id")["sha256"]}) == 3
    renamed = spark.createDataFrame([("1", "x\r\ny", ("q", 1), {"k": 1, "j": 2}), ("2", "z", None, None)], "id string, t string, s struct<a:string,b:int>, m map<string,int>")
    assert one == fingerprints.rows_fingerprint(renamed, "id")
    with pytest.raises(ValueError, match="missing or repeated key"):
        fingerprints.rows_fingerprint(a.union(a), "id")
    with pytest.raises(Exception, match="non-finite"):
        fingerprints.rows_fingerprint(spark.createDataFrame([("1", float("nan"))], "id string, x double"))
    parts = {"a": one, "b": fingerprints.rows_fingerprint(c, "id")}
    assert fingerprints.combined(parts) == fingerprints.combined(dict(reversed(parts.items()))) != fingerprints.combined({"a": one})


def test_order_counts_if_asked_for(spark):
    rows = [(i, "same" if i in (5, 900) else f"t{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "n int, t string")
    # the order is of n; what is hashed are the texts in that order
    swap = df.withColumn("n", F.when(F.col("n") == 3, 4).when(F.col("n") == 4, 3).otherwise(F.col("n")))
    of = lambda x: fingerprints.rows_fingerprint(x, ordered_by=["n"])["sha256"]
    assert of(df) == of(df.repartition(7)) != of(swap)
    assert of(df.where("n < 999")) != of(df)


def test_source_fingerprints(spark, tmp_path):
    for name, body in (("a.py", b"x=1\r\ny=2\r\n"), ("b.py", b"\xef\xbb\xbfx=1\ny=2\n"), ("c.py", b"x=1\ny=3\n")):
        (tmp_path / name).write_bytes(body)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r["path"][-4:]: r for r in fingerprints.source_fingerprints(files).collect()}
    assert got["a.py"]["source_sha256"] == got["b.py"]["source_sha256"] != got["c.py"]["source_sha256"]
    assert len({r["raw_sha256"] for r in got.values()}) == 3


def test_nested_leaks(spark):
    kind = "id int, a struct<seed:int,b:array<struct<note:string,network:string>>>, m map<string,array<string>>, seed string, t string"
    rows = [(1, (7, [("fine", None), ("Seed_42/open", "open")]), {"policy": ["x"], "ok": ["y", "novelty_OPEN"]}, "s", "t"), (2, None, None, None, None), (3, (None, []), {}, None, "clean"), (4, (None, [None]), {"policy": None, "k": [None]}, None, "")]
    df = spark.createDataFrame(rows, kind)
    got = {tuple(r) for r in checks.nested_leaks(df, ["seed", "network", "policy"], ["seed_", "novelty_open"], ["id"]).collect()}
    assert got == {(1, "$.a.seed", "key", "seed"), (1, "$.a.b[1].note", "marker", "seed_"), (1, "$.a.b[1].network", "key", "network"), (1, "$.m.policy", "key", "policy"), (1, "$.m.ok[1]", "marker", "novelty_open"), (1, "$.seed", "key", "seed")}
    assert checks.nested_leaks(df, [], [], ["id"]).count() == 0
    assert checks.nested_leaks(df.select("id"), ["x"], ["y"], ["id"]).count() == 0


def test_strict_faults_have_line_numbers(spark, tmp_path):
    lines = [json.dumps({"n": i, "pad": "x" * 200}) for i in range(3000)]
    for i in (0, 1234, 2999):
        lines[i] = '{"a": 1, "a": 2}'
    lines[77] = "  "
    (tmp_path / "big.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "small.jsonl").write_text('﻿{"a": 1}\n{"a": NaN}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = sorted((r["file"].rsplit("/", 1)[1], r["number"], r["fault"]) for r in corpus.strict_faults(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [("big.jsonl", 1, "repeated key"), ("big.jsonl", 1235, "repeated key"), ("big.jsonl", 3000, "repeated key"), ("small.jsonl", 2, "non-finite number NaN")]
