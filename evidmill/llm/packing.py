"""Packing of tokenised documents into sequences by sums of squares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidmill.llm.bpe import encoding, packed
from evidmill.llm.common import table, tokenizer_path, written

PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than size."""
    head = n % size
    starts = ([0] if head else []) + list(range(head, n, size))
    return [(s, head if head and s == 0 else size) for s in starts]


def pieces_udf(tokenizer: str, size: int, end_id: int = 0):
    """Arrow UDF: text to the pieces of its ids followed by the end id."""

    @F.arrow_udf(PIECES)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc, end = encoding(tokenizer_path(tokenizer)), int(end_id).to_bytes(4, "little")
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        for part in parts:
            out = []
            for x in part:
                raw = packed(enc, x.as_py() or "") + end
                out.append([{"piece": i, "start": s, "length": k, "ids_crc32": zlib.crc32(raw[4 * s : 4 * (s + k)])} for i, (s, k) in enumerate(cut(len(raw) // 4, size))])
            yield pa.array(out, kind)

    return run


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item.

    Items go in falling order of length, each into the open bin that leaves the
    sum over gaps g of N(g)^2 smallest, N(g) being the number of open bins with
    g tokens free; a bin is opened only where none has room.  Ties go to the
    smallest gap.  Among bins of one gap the last opened is taken.
    """
    order = np.argsort(-lengths, kind="stable")
    count = np.zeros(size + 1, dtype=np.int64)
    bins: list[list[int]] = [[] for _ in range(size + 1)]
    where, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in order:
        n = int(lengths[i])
        gaps = np.flatnonzero(count[n:]) + n
        if len(gaps):
            after = gaps - n
            # N(g)^2 - (N(g)-1)^2 is lost and, unless the bin is full, (N(g-n)+1)^2 - N(g-n)^2 is gained
            change = np.where(after > 0, 2 * count[after] + 2, 1) - 2 * count[gaps]
            g = int(gaps[change.argmin()])
            b = bins[g].pop()
            count[g] -= 1
        else:
            g, b, used = size, used, used + 1
        where[i], offset[i] = b, size - g
        if g > n:
            bins[g - n].append(b)
            count[g - n] += 1
    return where, offset


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", size: int = 2048, group_sequences: int = 4096) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of docs is a document of its own, even if keys or texts repeat
    or the key is null; a null text is an empty one, which has the end id alone.
    Full pieces are sequences by themselves.  The others are dealt at random,
    by row number, to groups of about ``group_sequences`` sequences and 64
    times as many pieces at most, and each group is packed alone by
    sum_of_squares(), so no task holds more than one group; a group wastes less
    than about one sequence.  Other columns of docs are left out.
    """
    kept = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    made = kept.select("__key", F.explode(pieces_udf(tokenizer, size)(F.col("__text"))).alias("p")).select("__key", "p.*")
    made = written(made.withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    part = made.where(F.col("length") < size)
    sums = part.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count("*").alias("pieces")).first()
    groups = max(1, -(-sums["tokens"] // (size * group_sequences)), -(-sums["pieces"] // (64 * group_sequences)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_no", kind="stable")
        where, at = sum_of_squares(pdf["length"].to_numpy(), size)
        pdf["sequence_id"] = pdf["grp"].to_numpy() * (1 << 32) + where
        pdf["offset"] = at
        return pdf[["__key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    kind = made.schema["__key"].dataType.simpleString()
    dealt = part.withColumn("grp", F.pmod(F.xxhash64("row_no"), F.lit(groups))).groupBy("grp").applyInPandas(one, f"__key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    full = made.where(F.col("length") == size).select("__key", "piece", "start", "length", "ids_crc32", (-1 - F.col("row_no")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return dealt.unionByName(full).withColumnRenamed("__key", key)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
