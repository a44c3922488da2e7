"""Fingerprints of what records mean, whatever their key order, layout, line ends or byte order mark."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidmill.operators.graph import written

VERSION = "1"


def _lines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _once(items: list) -> dict:
    if len({k for k, _ in items}) < len(items):
        raise ValueError("repeated key")
    return dict(items)


def _finite(name: str) -> float:
    raise ValueError("non-finite number")


def _plain(value: object) -> object:
    if isinstance(value, str):
        return _lines(value)
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return _once([(k, _plain(v)) for k, v in value.items()])
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("non-finite number")
    return value


def canonical_text(text: str) -> str:
    """JSON with keys in order, no spaces and \\n line ends in its strings; ValueError for what isn't strict JSON."""
    value = json.loads(text.removeprefix("\ufeff"), object_pairs_hook=_once, parse_constant=_finite)
    return json.dumps(_plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def canonical_json(text: Column) -> Column:
    """Struct of canonical, sha256 and fault, in one Arrow pass.

    A repeated key, a non-finite number or broken JSON has a fault and nothing
    else; a null text has neither.
    """

    @F.arrow_udf("struct<canonical:string,sha256:string,fault:string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("canonical", pa.string()), ("sha256", pa.string()), ("fault", pa.string())])
        for part in parts:
            rows = []
            for x in part.to_pylist():
                row = {"canonical": None, "sha256": None, "fault": None}
                if x is not None:
                    try:
                        row["canonical"] = canonical_text(x)
                        row["sha256"] = hashlib.sha256(row["canonical"].encode("utf-8", "surrogatepass")).hexdigest()
                    except (ValueError, RecursionError) as e:
                        row["fault"] = str(e) if str(e) in ("repeated key", "non-finite number") else "not JSON"
                rows.append(row)
            yield pa.array(rows, kind)

    return run(text)


def normalised(value: Column, kind: T.DataType) -> Column:
    """A value of any nested type with struct fields and map entries in order of name, \\n line ends and finite numbers (others raise)."""
    if isinstance(kind, T.StringType):
        return F.regexp_replace(value, "\r\n?", "\n")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit("non-finite number")).cast(kind)).otherwise(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: normalised(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(normalised(e["key"], kind.keyType).alias("key"), normalised(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    if isinstance(kind, T.StructType):
        fields = [normalised(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    return value


def rows_fingerprint(df: DataFrame, key: str | None = None, ordered_by: list[str] | None = None) -> dict:
    """sha256 over the rows' meaning, records, and version.

    Columns count by name, not place.  With ``key``, every row needs one of its
    own, and the order of rows doesn't count; ``ordered_by`` makes the position
    in that order count (it has to tell all rows apart).  Rows are hashed where
    they are and their hashes added up; only with ``ordered_by`` are they sorted, in ranges.
    """
    if key is not None:
        one = df.agg(F.count("*").alias("n"), F.count_distinct(F.nullif(F.col(key).cast("string"), F.lit(""))).alias("k")).first()
        if one["n"] != one["k"]:
            raise ValueError(f"{key}: missing or repeated key")
    columns = sorted(f.name for f in df.schema.fields)
    body = F.struct(*[normalised(F.col(c), df.schema[c].dataType).alias(c) for c in columns])
    text = F.to_json(body, {"ignoreNullFields": "false"})
    if ordered_by:
        # a row is hashed with the one before it; where ranges of rows meet, the last of one goes before the first of the next
        rows = df.select(*ordered_by, text.alias("__json")).repartitionByRange(*ordered_by).sortWithinPartitions(*ordered_by).withColumn("__id", F.monotonically_increasing_id())
        rows = written(rows.select("__id", F.shiftright("__id", 33).alias("__part"), "__json"), "rows")
        before = F.lag("__json").over(W.partitionBy("__part").orderBy("__id"))
        ends = rows.groupBy("__part").agg(F.max_by("__json", "__id").alias("__end"))
        ends = ends.select(F.lead("__part").over(W.orderBy("__part")).alias("__part"), "__end")  # a row per range
        rows = rows.withColumn("__before", before).join(ends, "__part", "left").select(F.concat_ws("\u0000", F.coalesce("__before", "__end", F.lit("")), "__json").alias("__json"))
    else:
        rows = df.select(text.alias("__json"))
    h = F.sha2("__json", 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    r = rows.agg(F.count("*").alias("n"), *[part(i).alias(f"s{i}") for i in range(5)]).first()
    return {"sha256": hashlib.sha256("|".join([*columns, *map(str, r)]).encode()).hexdigest(), "records": r["n"], "version": VERSION}


def source_fingerprints(files: DataFrame) -> DataFrame:
    """path, raw_sha256, source_sha256 of files (path, content): the second without a byte order mark, with \\n line ends."""
    text = F.regexp_replace(F.regexp_replace(F.decode("content", "utf-8"), "^\ufeff", ""), "\r\n?", "\n")
    return files.select("path", F.sha2("content", 256).alias("raw_sha256"), F.sha2(text, 256).alias("source_sha256"))


def combined(parts: dict[str, dict]) -> str:
    """One fingerprint of several, by name."""
    return hashlib.sha256(canonical_text(json.dumps({"version": VERSION, "parts": parts})).encode()).hexdigest()
