"""Token counts by overlap resynchronisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidmill.llm.bpe import SURE, encoding, ids_of, packed
from evidmill.llm.common import table, tokenizer_path


def _encode(enc, text: str) -> list[int]:
    return ids_of(enc, text).tolist()


def _ends(enc, lengths: dict[int, int], ids: list[int]) -> np.ndarray:
    """Byte offset at which each token ends."""
    for i in ids:
        if i not in lengths:
            lengths[i] = len(enc.decode_single_token_bytes(i))
    return np.cumsum([lengths[i] for i in ids], dtype=np.int64)


def count_long(enc, text: str, chunk: int, overlap: int, log: list | None = None) -> int:
    """Tokens of a text longer than a chunk, as one encoding of the whole text would give them.

    The text is encoded in chunks that overlap.  Two neighbours are spliced at
    a position in their overlap that (1) ends a token in both encodings and (2)
    is proven stable: white space after a non-space always begins a pre-token,
    and what follows a pre-token boundary doesn't depend on what precedes it.
    A margin of the longest special token keeps such tokens from being cut.
    If no position serves, the overlap is doubled, up to the whole rest of the
    text.  ``log`` gets the overlap of each splice.
    """
    lengths: dict[int, int] = {}
    margin = max(map(len, enc.special_tokens_set), default=0) + 2
    total, start, n = 0, 0, len(text)
    while True:
        size, lap = chunk, overlap
        while True:
            end = min(n, start + size)
            left = _encode(enc, text[start:end])
            if end == n:
                return total + len(left)
            lap_from = max(start + 1, end - lap)
            right_end = min(n, end + margin)
            right = _encode(enc, text[lap_from:right_end])
            left_ends = _ends(enc, lengths, left)
            base = len(text[start:lap_from].encode("utf-8", "surrogatepass"))
            right_ends = set((_ends(enc, lengths, right) + base).tolist())
            # candidates: (character, byte) positions in the overlap, the last first
            cut = None
            inside = text[lap_from : end - margin]
            spots = [m.start() for m in SURE.finditer(inside) if m.start() and not inside[m.start() - 1].isspace()]
            byte = base
            at, where = 0, []
            for p in spots:
                byte += len(inside[at:p].encode("utf-8", "surrogatepass"))
                at = p
                where.append((lap_from + p, byte))
            for char, b in reversed(where):
                k = int(np.searchsorted(left_ends, b))
                if k < len(left_ends) and left_ends[k] == b and b in right_ends:
                    cut = (char, k + 1)
                    break
            if cut:
                if log is not None:
                    log.append(lap)
                total += cut[1]
                start = cut[0]
                break
            lap, size = lap * 2, size + lap


def counter(path_name: str, chunk: int, overlap: int):
    """Arrow UDF: text to number of tokens."""

    @F.arrow_udf("bigint")
    def n_tokens(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(tokenizer_path(path_name))
        for part in parts:
            out = []
            for x in part:
                t = x.as_py() or ""
                out.append(len(packed(enc, t)) // 4 if len(t) <= chunk else count_long(enc, t, chunk, overlap))
            yield pa.array(out, pa.int64())

    return n_tokens


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 512, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to every row of docs.

    A null text counts as empty (0 bytes, 0 tokens).  Rows repeat as they come.
    Columns of those names in docs are replaced.  Special strings inside a text
    count as their one token, the library's default.
    """
    t: Column = F.col(text)
    out = docs.withColumn("n_tokens", counter(tokenizer, chunk, overlap)(t)).withColumn("n_bytes", F.octet_length(F.coalesce(t, F.lit(""))).cast("long"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
