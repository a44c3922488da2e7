"""SentencePiece encoding and decoding through a table of distinct chunks."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidmill.llm.common import table, tokenizer_path

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@functools.lru_cache(maxsize=4)
def processor(path: str):
    """The model, after a proof that chunks may be segmented alone: past its first other character, no piece has a marker."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(sp.get_piece_size()):
        if MARK in sp.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"{path}: the piece {sp.id_to_piece(i)!r} crosses a marker")
    return sp


class ChunkCodec:
    """Segments each distinct marked word once and joins the ids back by position.

    A marked word is a run of markers and the characters up to the next marker.
    Merges never cross the place where a marker follows another character, so
    the text's ids are its chunks' ids in order.  The table holds at most
    ``limit`` chunks and starts anew when full.
    """

    def __init__(self, path: str, limit: int = 300_000):
        self.sp, self.limit, self.seen = processor(path), limit, {}
        #: Chunks that decode to something else.
        self.odd: dict[str, str] = {}
        #: A marker that nothing follows; only its missing first marker would be encoded.
        self.bare = str(self.sp.piece_to_id(MARK))
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.marked = np.array([p[0] == MARK for p in pieces])
        self.decimal = [str(i) for i in range(len(pieces))]

    def _learn(self, chunks: list[str]) -> dict[str, str]:
        """Decimal ids of each chunk; notes the chunks that decode to something else."""
        plain = [c for c in chunks if c and c[0] != MARK]
        rest = [c for c in chunks if c and c[0] == MARK]
        out = {"": self.bare}
        groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        joined = [" ".join(g) for g in groups]
        coded = self.sp.encode(joined, num_threads=1) if joined else []
        for group, text, ids, back in zip(groups, joined, coded, self.sp.decode(coded, num_threads=1) if coded else []):
            starts = np.flatnonzero(self.marked[ids]).tolist()
            if len(starts) != len(group) or back != text:
                rest += group
                continue
            digits = list(map(self.decimal.__getitem__, ids))
            for c, a, b in zip(group, starts, [*starts[1:], len(ids)]):
                out[c] = " ".join(digits[a:b])
        ids = self.sp.encode(rest, num_threads=1) if rest else []
        for c, i, back in zip(rest, ids, self.sp.decode(ids, num_threads=1) if rest else []):
            out[c] = " ".join(map(str, i))
            if back != c.replace(MARK, " "):
                self.odd[c] = back
        return out

    def texts(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids as decimal text, decoded text) of each text, without the end id."""
        step = 256
        for k in range(0, len(texts), step):
            rows, missing = [], set()
            for text in texts[k : k + step]:
                norm = self.sp.normalize(text)
                if norm[:1] != MARK:
                    rows.append((text, None, None))
                    continue
                chunks = norm[1:].split(MARK) if MARK + MARK not in norm and norm[-1] != MARK else [c[1:] for c in CHUNK.findall(norm)]
                got = list(map(self.seen.get, chunks))
                if None in got:
                    missing.update([c for c, e in zip(chunks, got) if e is None])
                rows.append((norm, chunks, got))
            if len(self.seen) > self.limit:
                self.seen = {}
            if len(self.odd) > self.limit:
                self.seen, self.odd = {}, {}
                missing.update(*[x[1] for x in rows if x[1]])
            fresh = self._learn(list(missing)) if missing else {}
            for norm, chunks, got in rows:
                if got is None:
                    ids = self.sp.encode(norm)
                    yield len(ids), " ".join(map(str, ids)), self.sp.decode(ids)
                    continue
                if None in got:
                    got = [fresh[c] if e is None else e for c, e in zip(chunks, got)]
                ids = " ".join(got)
                odd = self.odd and any(c in self.odd for c in chunks)
                yield ids.count(" ") + 1, ids, " ".join([self.odd.get(c, c.replace(MARK, " ")) for c in chunks]) if odd else norm[1:].replace(MARK, " ")
            self.seen.update(x for x in fresh.items() if len(x[0]) < 64)

    def encode(self, text: str) -> list[int]:
        s = next(self.texts([text]))[1]
        return list(map(int, s.split(" "))) if s else []


def encode_decode(model: str = "piece_bpe_32k.model", end_id: int = 2):
    """Arrow UDF: text to (n_tokens, ids with the end id, decoded text)."""

    @F.arrow_udf("struct<n_tokens:bigint,ids:array<int>,decoded:string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = ChunkCodec(tokenizer_path(model))
        for part in parts:
            rows = list(codec.texts([x or "" for x in part.to_pylist()]))
            ids = [[*map(int, r[1].split(" ")), end_id] if r[1] else [end_id] for r in rows]
            yield pa.StructArray.from_arrays([pa.array([r[0] + 1 for r in rows], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())], names=["n_tokens", "ids", "decoded"])

    return run


def digests(model: str = "piece_bpe_32k.model", end_id: int = 2):
    """Arrow UDF: text to (n_tokens, SHA-256 of the ids' decimal text, SHA-256 of the decoded text); the ids never leave the worker."""

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec, sha = ChunkCodec(tokenizer_path(model)), hashlib.sha256
        for part in parts:
            n, a, b = [], [], []
            for k, ids, back in codec.texts([x or "" for x in part.to_pylist()]):
                n.append(k + 1)
                a.append(sha(f"{ids} {end_id}".encode() if ids else str(end_id).encode()).hexdigest())
                b.append(sha(back.encode()).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def spm_encode(docs: DataFrame, text: str = "text", model: str = "piece_bpe_32k.model", as_digests: bool = False) -> DataFrame:
    """Adds n_tokens, ids and decoded (or the two digests) to every row.

    A null text is an empty one: only the end id, decoded to an empty text.
    Repeated rows repeat.  Columns of those names in docs are replaced.
    """
    udf = (digests if as_digests else encode_decode)(model)
    out = docs.withColumn("__spm", udf(F.col(text)))
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if as_digests else ["n_tokens", "ids", "decoded"]
    return out.select(*[c for c in docs.columns if c not in names], *[F.col(f"__spm.{c}").alias(c) for c in names])


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spm_encode(docs, as_digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
