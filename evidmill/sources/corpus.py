"""Readers and writers: corpora, typed CSV, strict JSON lines, manifests, write-once tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAPER = "id string, title string, abstract string, year int, field string, synthetic boolean, topic_ids array<string>, doi string, source_url string"


def read_corpus(spark: SparkSession, path: str, cutoff: int, allow_synthetic: bool = True, least: int = 3) -> DataFrame:
    """Papers before the cutoff year; malformed lines, blank texts, repeated ids, unwanted synthetic rows and too few rows raise."""
    df = spark.read.schema(PAPER).option("mode", "FAILFAST").json(path).where(F.col("year") < cutoff)
    blank = F.lit(False)
    for c in ("id", "title", "abstract"):
        blank = blank | F.col(c).isNull() | (F.trim(F.col(c)) == "")
    facts = df.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(blank).alias("blank"), F.count_if(F.coalesce("synthetic", F.lit(False))).alias("synthetic")).first()
    for fault, text in ((facts["blank"], "blank field"), (facts["n"] != facts["ids"], "repeated id"), (facts["synthetic"] and not allow_synthetic, "synthetic row"), (facts["n"] < least, "too few papers")):
        if fault:
            raise ValueError(f"{path}: {text}")
    return df


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header or JSON lines, by the name's ending; all CSV columns are strings."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    if path.endswith((".jsonl", ".json")):
        return spark.read.option("mode", "FAILFAST").json(path)
    raise ValueError(f"{path}: neither .csv nor .jsonl")


def typed(df: DataFrame, integers: Iterable[str] = (), floats: Iterable[str] = (), booleans: Iterable[str] = ()) -> DataFrame:
    """Casts columns by name; an empty text is null, and what doesn't parse, or an integer like 01, raises."""
    ints, flo, boo = set(integers), set(floats) - set(integers), set(booleans)
    cols = []
    for c in df.columns:
        v = F.nullif(F.col(c), F.lit(""))
        if c in ints:
            v = F.when(v.isNull() | v.rlike(r"^-?(0|[1-9][0-9]*)$"), v.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit(f"{c}: not an integer: "), v)))
        elif c in flo:
            v = v.cast("double")
        elif c in boo:
            v = v.cast("boolean")
        cols.append(v.alias(c))
    return df.select(*cols)


def strict_line(line: str) -> str | None:
    """None if the line is JSON without repeated keys or non-finite numbers, else what is wrong."""

    def pairs(items: list) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("repeated key")
        return dict(items)

    def constant(x: str) -> float:
        raise ValueError(f"non-finite number {x}")

    try:
        json.loads(line, object_pairs_hook=pairs, parse_constant=constant)
    except ValueError as e:
        return str(e)
    return None


def strict_faults(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 1), line, fault of every line of JSON-lines files that the strict reader would reject; blank lines are none.

    A file is read in blocks.  A line's number is its place in its block and the
    lines of the blocks before it, of which there is a row each: no file goes
    through one task.
    """

    @F.arrow_udf("string")
    def fault(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([strict_line(x) if x.strip() else None for x in part.to_pylist()], pa.string())

    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select(*block, F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "^\ufeff", "").alias("line"))
    blocks = lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bad = lines.withColumn("fault", fault("line")).where("fault is not null")
    j = bad.join(blocks.withColumn("before", before), ["file", "start"])
    return j.select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("number"), "line", "fault")


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def unsafe_members(names: DataFrame, column: str = "name") -> DataFrame:
    """Archive member names that are absolute, climb upwards or hold backslashes."""
    c = F.col(column)
    return names.where(c.startswith("/") | c.contains("\\") | c.rlike(r"(^|/)\.\.(/|$)") | c.rlike("^[A-Za-z]:"))


def fingerprint(df: DataFrame, key: str) -> str:
    """SHA-256 over the rows as JSON in order of key, by sums of row hashes: independent of partitioning."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    part = lambda a: F.sum(F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(38,0)"))
    r = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("k"), *[part(1 + 12 * i).alias(f"s{i}") for i in range(5)]).first()
    if r["n"] != r["k"]:
        raise ValueError(f"{key}: missing or repeated key")
    import hashlib

    return hashlib.sha256("|".join(str(x) for x in r).encode()).hexdigest()


def write_frozen(df: DataFrame, path: str, key: str) -> None:
    """Writes once; a second write must bring the same rows."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        if fingerprint(spark.read.parquet(path).select(*df.columns), key) != fingerprint(df, key):
            raise ValueError(f"{path}: frozen with other rows")
        return
    df.write.mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with columns in order of name and nulls kept."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").option("ignoreNullFields", False).json(path)
