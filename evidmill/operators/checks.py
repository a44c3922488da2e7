"""Queues, conflicts, validation and comparison of records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidmill.functions.text import uniform
from evidmill.operators.graph import SMALL_GROUPS, written


def adjudication_queue(pairs: DataFrame) -> DataFrame:
    """Items both reviewers rated where one is unsure (a null score) or the scores differ (columns item_id, r1, r2, rated: ratings received)."""
    return pairs.where("rated >= 2 and (r1 is null or r2 is null or r1 <> r2)").select("item_id", "r1", "r2")


def conflicts(grades: DataFrame, key: str, grade: str) -> DataFrame:
    """Keys with more than one distinct grade."""
    return grades.groupBy(key).agg(F.countDistinct(grade).alias("grades")).where("grades > 1")


def proposals(papers: DataFrame, topics: DataFrame) -> DataFrame:
    """topic_id, status, n: supported where all of more than one keyword occur in the text, else ambiguous if one does."""
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    j = papers.select("id", text.alias("t")).crossJoin(F.broadcast(topics.select("topic_id", "keywords")))
    every = (F.size("keywords") > 1) & F.forall("keywords", lambda k: F.col("t").contains(F.lower(k)))
    some = F.exists("keywords", lambda k: F.col("t").contains(F.lower(k)))
    return j.where(some).withColumn("status", F.when(every, "supported").otherwise("ambiguous")).groupBy("topic_id", "status").agg(F.count("*").alias("n"))


def roles(agents: DataFrame, cycle: int) -> DataFrame:
    """agent_id, role: leaders and followers alternate by place within the field and cycle."""
    place = F.row_number().over(W.partitionBy("field").orderBy("agent_id")) - 1
    return agents.select("agent_id", F.when((place + cycle) % 2 == 0, "leader").otherwise("follower").alias("role"))


def shifted(topics: DataFrame) -> DataFrame:
    """topic_id, partner: the topic half the list further, cyclically."""
    n = topics.count()
    t = topics.select("topic_id").withColumn("i", F.row_number().over(W.orderBy("topic_id")) - 1)  # 12 rows
    return t.alias("x").join(t.alias("y"), F.pmod(F.col("x.i") + n // 2, F.lit(n)) == F.col("y.i")).select(F.col("x.topic_id").alias("topic_id"), F.col("y.topic_id").alias("partner"))


def keyed_uniforms(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.select(key, F.round(uniform(F.lit(str(seed)), F.col(key).cast("string")), 9).alias("u"))


def fixture(spark, families: int, topics: DataFrame) -> DataFrame:
    """Deterministic corpus: every topic by family, with a variant number that text normalisation removes."""
    n = topics.count()
    t = topics.select("topic_id", "field", "keywords").withColumn("i", F.row_number().over(W.orderBy("topic_id")) - 1)
    base = spark.range(families * n).withColumn("i", (F.col("id") % n).cast("int")).join(F.broadcast(t), "i")
    family = F.floor(F.col("id") / n)
    return base.select(F.concat(F.col("topic_id"), F.lit("_f"), F.lpad(family.cast("string"), 3, "0")).alias("id"), F.concat(F.array_join("keywords", " "), F.lit(" variant "), family.cast("string")).alias("title"), "field", F.pmod(family, F.lit(5)).cast("int").alias("year_offset"))


def leaks(df: DataFrame, columns: list[str], banned: list[str]) -> DataFrame:
    """column, n: rows whose text holds a banned word, by column."""
    hit = lambda c: F.exists(F.array(*map(F.lit, banned)), lambda b: F.lower(F.col(c)).contains(b))
    one = df.agg(*[F.count_if(hit(c)).alias(c) for c in columns])
    return one.select(F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', {c}" for c in columns) + ") AS (column, n)"))


HIT = "array<struct<path:string,kind:string,found:string>>"


def hits(value: Column, kind: T.DataType, keys: list[str], markers: list[str], path: Column) -> Column:
    """Array of (path, kind, found) of what a value of any nested type must not hold.

    ``keys`` are banned names of struct fields and keys of maps, unless their
    value is null; ``markers`` banned parts of strings, whatever their case; a
    string has the first marker it holds.  Made from the schema: one
    expression, however deep.
    """
    none = F.array().cast(HIT)
    hit = lambda at, what, found: F.array(F.struct(at.alias("path"), F.lit(what).alias("kind"), found.alias("found"))).cast(HIT)
    flat = lambda parts: F.coalesce(F.filter(F.flatten(parts), lambda h: h.isNotNull()), none)
    if isinstance(kind, T.StringType):
        first = F.coalesce(*[F.when(F.lower(value).contains(m), F.lit(m)) for m in markers]) if markers else F.lit(None).cast("string")
        return F.when(first.isNotNull(), hit(path, "marker", first)).otherwise(none)
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind.fields:
            at, v = F.concat(path, F.lit("." + f.name)), value[f.name]
            if f.name in keys:
                parts.append(F.when(v.isNotNull(), hit(at, "key", F.lit(f.name))).otherwise(none))
            parts.append(hits(v, f.dataType, keys, markers, at))
        return F.concat(*parts) if parts else none
    if isinstance(kind, T.ArrayType):
        return flat(F.transform(value, lambda x, i: hits(x, kind.elementType, keys, markers, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
    if isinstance(kind, T.MapType):

        def entry(e: Column) -> Column:
            name = e["key"].cast("string")
            at = F.concat(path, F.lit("."), name)
            return F.concat(F.when(name.isin(keys) & e["value"].isNotNull(), hit(at, "key", name)).otherwise(none), hits(e["value"], kind.valueType, keys, markers, at))

        return flat(F.transform(F.map_entries(value), entry))
    return none


def nested_leaks(df: DataFrame, keys: list[str], markers: list[str], by: list[str]) -> DataFrame:
    """``by``, path, kind, found: every banned key and marker of every row, in all columns but ``by``, at any depth.

    Paths are as in $.refs[2].note.  A null holds nothing.
    """
    parts = []
    for f in df.schema.fields:
        if f.name not in by:
            at = F.lit("$." + f.name)
            if f.name in keys:
                parts.append(F.when(F.col(f.name).isNotNull(), F.array(F.struct(at.alias("path"), F.lit("key").alias("kind"), F.lit(f.name).alias("found"))).cast(HIT)).otherwise(F.array().cast(HIT)))
            parts.append(hits(F.col(f.name), f.dataType, keys, markers, at))
    every = F.concat(*parts) if parts else F.array().cast(HIT)
    return df.select(*by, F.explode(every).alias("hit")).select(*by, "hit.*")


def valid_card(text: Column, references: Column, visible: Column, score: Column) -> Column:
    """A response is legal: text of at most 8000 characters that isn't blank, references among the visible, score in [0, 1]."""
    return F.coalesce((F.length(F.trim(text)) > 0) & (F.length(text) <= 8000) & (F.size(F.array_except(references, visible)) == 0) & score.between(0.0, 1.0), F.lit(False))


def compared(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """status, n over a full outer join: equal within the tolerance, changed, or only on one side; nulls equal each other."""
    x = a.select(*keys, F.col(value).alias("va"), F.lit(True).alias("ina"))
    y = b.select(*keys, F.col(value).alias("vb"), F.lit(True).alias("inb"))
    same = F.col("va").eqNullSafe(F.col("vb")) | F.coalesce(F.abs(F.col("va") - F.col("vb")) <= tolerance, F.lit(False))
    status = F.when(F.col("inb").isNull(), "missing").when(F.col("ina").isNull(), "new").when(same, "equal").otherwise("changed")
    return x.join(y, keys, "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def spans(df: DataFrame, by: str, value: str) -> DataFrame:
    """Largest minus smallest value of each group; null where none is known."""
    return df.groupBy(by).agg(F.round(F.max(value) - F.min(value), 6).alias("span"))


#: Token sets of a block; every two blocks of a group meet once.  Common words at once in a matrix, and pairs counted at once one by one.
SETS, COLUMNS, COUNTED = 1024, 2048, 1 << 21
#: A block in bytes: the sizes of its sets, its distinct words (and where each ends), and the sets that hold each word (and where they end).
_BLOCK = ["size", "words", "letters", "sets", "ends"]


def _packed(sets: pa.ListArray) -> list[bytes]:
    """_BLOCK of token sets."""
    size = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int32)
    coded = sets.flatten().cast(pa.binary()).dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    held = np.repeat(np.arange(len(size), dtype=np.int32), size)[np.argsort(code, kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(words)))]).astype(np.int32)
    letters = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False))]).astype(np.int32)
    return [size.tobytes(), b"".join(words.to_pylist()), letters.tobytes(), held.tobytes(), ends.tobytes()]


def _similarity(a: list[pa.Buffer], b: list[pa.Buffer], one: bool) -> float:
    """Sum of the Jaccard similarities, at 9 digits each, of the pairs of two blocks, or (``one``) within one.

    Of the words that both hold, frequent ones meet in matrices; sets with a
    rare one are counted pair by pair, where that is less work.
    """
    size, held, ends = ([np.frombuffer(x[k], np.int32) for x in (a, b)] for k in (0, 3, 4))
    words = [pa.Array.from_buffers(pa.binary(), len(x[2]) // 4 - 1, [None, x[2], x[1]]) for x in (a, b)]
    at = pc.fill_null(pc.index_in(words[1], value_set=words[0]), -1).to_numpy(zero_copy_only=False)
    term = [at[at >= 0], np.flatnonzero(at >= 0)]
    many = [e[t + 1].astype(np.int64) - e[t] for e, t in zip(ends, term, strict=True)]
    rows, columns = map(len, size)
    dense = many[0] * many[1] * 200 > rows * columns

    def holders(k: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the word and set, of all sets of side k that hold one of the chosen words."""
        n = many[k][chosen]
        first = ends[k][term[k][chosen]] - np.cumsum(n) + n
        return np.repeat(np.arange(len(n)), n), held[k][np.arange(n.sum()) + np.repeat(first, n)]

    both = np.zeros((rows, columns), np.float32)
    often = np.flatnonzero(dense)
    for k in range(0, len(often), COLUMNS):
        chosen, m = often[k : k + COLUMNS], []
        for side, n in enumerate((rows, columns)):
            word, x = holders(side, chosen)
            m.append(np.zeros((n, len(chosen)), np.float32))
            m[-1][x, word] = 1
        both += m[0] @ m[1].T
    rare = np.flatnonzero(~dense)
    part = np.cumsum(many[0][rare] * many[1][rare]) // COUNTED
    for chosen in np.split(rare, np.flatnonzero(np.diff(part)) + 1):
        (word, x), (_, y) = holders(0, chosen), holders(1, chosen)
        n = many[1][chosen]
        first, n = (np.cumsum(n) - n)[word], n[word]
        pair = np.repeat(x.astype(np.int64) * columns, n) + y[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)]
        both += np.bincount(pair, minlength=rows * columns).reshape(rows, columns)
    j = size[0][:, None].astype(np.float64) + size[1][None, :] - both
    np.divide(both, np.maximum(j, 1, out=j), out=j)
    j *= 1e9
    j += 0.5
    np.floor(j, out=j)
    return float((np.triu(j, 1) if one else j).sum()) / 1e9


def text_diversity(sets: DataFrame, by: str) -> DataFrame:
    """Mean of 1 - Jaccard over all pairs of a group's token sets (columns by, id, w without repeats), by pairs of blocks.

    Each set is written once, in a block.  A task reads two parts of the written
    blocks and compares those of one group, so that no block goes through the
    driver or a shuffle; the number of pairs stays the square of a group.
    """
    n = sets.groupBy(by).agg(F.count("*").alias("n"))
    blocks = -(-(n.agg(F.max("n")).first()[0] or 0) // SETS) or 1
    dealt = sets.select(F.col(by).alias("g"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), "w").groupBy("g", "b").agg(F.collect_list("w").alias("w"))
    kind = sets.schema[by].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                packed = [pa.array([x], pa.binary()) for x in _packed(batch.column(2)[i].values)]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns[:2]), *packed], ["g", "b", *_BLOCK])

    dealt = written(dealt.mapInArrow(pack, f"g {kind.simpleString()}, b int, " + ", ".join(f"{c} binary" for c in _BLOCK)), "blocks", **SMALL_GROUPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            j = []
            for i in range(batch.num_rows):
                block = [c[i].as_buffer() for c in batch.columns[2:]]
                j.append(_similarity(block[: len(_BLOCK)], block[len(_BLOCK) :], batch.column(1)[i].as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(j, pa.float64())], ["g", "j"])

    # every part of the files meets every part where it is read; Spark would broadcast a side that it deems small
    other = dealt.select(*[F.col(c).alias(f"o_{c}") for c in dealt.columns])
    met = dealt.hint("shuffle_replicate_nl").join(other, F.col("g").eqNullSafe(F.col("o_g")) & (F.col("b") <= F.col("o_b")))
    sums = met.select("g", (F.col("b") == F.col("o_b")).alias("one"), *_BLOCK, *[f"o_{c}" for c in _BLOCK]).mapInArrow(run, f"g {kind.simpleString()}, j double")
    shared = sums.groupBy(F.col("g").alias(by)).agg(F.sum("j").alias("j"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return n.join(shared, by, "left").select(by, F.round(F.coalesce(1 - F.try_divide(F.coalesce("j", F.lit(0.0)), pairs), F.lit(0.0)), 6).alias("diversity"))
