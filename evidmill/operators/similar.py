"""Pairs of similar token sets, exactly, without shuffling sets for candidates.

Rows of a prefix filter carry a bitmap of their set instead of the set.  What
bitmaps can't tell apart is linked to stars, and only the sets of one connected
group of stars meet to be verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidmill.operators.graph import connected_components, discard, written

#: Tokens whose frequency orders prefixes; the others count as equally rare.
FREQUENT = 100_000
#: Rows of one token, and sets of one group, that meet in one block at most; rows of a bin; words of bitmaps compared at once.
TOKEN_BLOCK, SET_BLOCK, BIN, HELD = 16_384, 1024, 60_000, 1 << 22
#: 64-bit words of a bitmap, for sets of up to so many tokens.
WIDTHS = [(4, 400), (16, 1800), (64, 1 << 31)]


def tokens_key(w: Column) -> Column:
    """Digest of a sorted token set."""
    return F.unhex(F.sha2(F.array_join(w, " "), 256))


def _bitmap(h: np.ndarray) -> np.ndarray:
    """Parities of the numbers of tokens on each bit: sets that differ in d tokens differ in d bits at most."""
    width = next(n for n, most in WIDTHS if len(h) <= most)
    bits = np.bincount((h & (width * 64 - 1)).astype(np.int64), minlength=width * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists without nulls."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = one.offsets.to_numpy()
    return one.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def _described(order: np.ndarray, threshold: float, id_type: pa.DataType) -> Callable:
    """(cls, id, h) to (cls, id, size, prefix, bits); ``order`` has the hashes of frequent tokens from rare to frequent."""
    by = np.argsort(order)
    known = order[by]
    kind = pa.schema([("cls", pa.int64()), ("id", id_type), ("size", pa.int32()), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = _lists(batch.column(2))
            rank = np.full(len(values), -1, np.int64)
            if len(known):
                k = np.minimum(np.searchsorted(known, values), len(known) - 1)
                rank = np.where(known[k] == values, by[k], -1)
            prefix, bits = [], []
            for a, b in zip(at, at[1:]):
                n = int(b - a)
                first = n - int(np.ceil((threshold - 1e-9) * n - 1e-9)) + 1
                prefix.append(values[a:b][np.lexsort((values[a:b], rank[a:b]))[:first]])
                bits.append(_bitmap(values[a:b]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(id_type), pa.array(np.diff(at), pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())], schema=kind)

    return run


class _Rows:
    """Sets of a block in order of group and size, and the pairs of them that may be similar."""

    def __init__(self, table: pa.Table, threshold: float) -> None:
        col = lambda c: table[c].to_numpy()
        group, size = [col(c) for c in ("part", "low", "high")], col("size").astype(np.int64)
        self.order = np.lexsort((size, *group[::-1]))
        group, self.size, self.block = [g[self.order] for g in group], size[self.order], col("block")[self.order]
        n, self.t = len(self.size), threshold - 1e-6
        start = np.ones(n, bool)
        if n:
            start[1:] = np.any([g[1:] != g[:-1] for g in group], axis=0)
        self.group, self.split = np.cumsum(start), (group[1] != group[2])
        raw = table["bits"].combine_chunks().take(pa.array(self.order))
        self.kind = np.searchsorted([8 * w for w, _ in WIDTHS], pc.binary_length(raw).to_numpy())
        self.bits = []
        for c, (words, _) in enumerate(WIDTHS):
            # longer bitmaps fold to shorter ones
            where, rows = np.full(n, -1), []
            for k in range(c, len(WIDTHS)):
                own = np.flatnonzero(self.kind == k)
                if len(own):
                    m = np.frombuffer(b"".join(raw.take(pa.array(own)).to_pylist()), "<u8").reshape(len(own), -1, words)
                    where[own] = np.arange(len(own)) + sum(map(len, rows))
                    rows.append(np.bitwise_xor.reduce(m, axis=1))
            self.bits.append((where, np.concatenate(rows) if rows else np.empty((0, words), np.uint64)))

    def pairs(self, place: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) of pairs that size, bitmaps and, of a prefix's token, its place in both sets don't exclude."""
        n, t = len(self.size), self.t
        key = self.group << 32 | self.size
        last = np.searchsorted(key, self.group << 32 | np.minimum((self.size / t + 1e-6).astype(np.int64), (1 << 32) - 1), "right")
        many = np.maximum(last - np.arange(n) - 1, 0)
        done = np.concatenate([[0], np.cumsum(many)])
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(done, done[a] + (1 << 20), "right")) - 1)
            i = np.repeat(np.arange(a, b), many[a:b])
            j = i + 1 + np.arange(len(i)) - np.repeat(done[a:b] - done[a], many[a:b])
            a = b
            keep = ~self.split[i] | (self.block[i] != self.block[j])
            both = self.size[i] + self.size[j]
            if place is not None:
                keep &= np.minimum(self.size[i] - place[i], self.size[j] - place[j]) >= t / (1 + t) * both - 1e-6
            i, j, most = i[keep], j[keep], (1 - t) / (1 + t) * both[keep] + 1e-6
            for c, (where, m) in enumerate(self.bits):
                own = np.flatnonzero(self.kind[i] == c)  # the smaller set has the shorter bitmap
                for s in range(0, len(own), max(1, HELD // m.shape[1])):
                    x = own[s : s + max(1, HELD // m.shape[1])]
                    near = np.bitwise_count(m[where[i[x]]] ^ m[where[j[x]]]).sum(axis=1, dtype=np.int64) <= most[x]
                    if near.any():
                        yield i[x[near]], j[x[near]]


def _stars(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of the edges x - y but the smallest of its component, and that one."""
    name, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    p, q = at[: len(x)], at[len(x) :]
    label = np.arange(len(name))
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            leaf = label != np.arange(len(name))
            return name[leaf], name[label[leaf]]
        label = new


def _linked(threshold: float) -> Callable:
    """Prefix rows of a bin to stars of the sets that may be similar."""

    def run(table: pa.Table) -> pa.Table:
        rows = _Rows(table, threshold)
        cls, place = (table[c].to_numpy()[rows.order] for c in ("cls", "place"))
        x, y = np.empty(0, np.int64), np.empty(0, np.int64)
        for i, j in rows.pairs(place):
            x, y = _stars(np.concatenate([x, cls[i]]), np.concatenate([y, cls[j]]))
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return run


def _verified(threshold: float, id_type: pa.DataType) -> Callable:
    """Sets of a bin to their pairs with common tokens enough: ids, the number of common tokens, sizes."""

    def run(table: pa.Table) -> pa.Table:
        rows = _Rows(table, threshold)
        ids = table["id"].combine_chunks().take(pa.array(rows.order))
        values, at = _lists(table["h"].combine_chunks().take(pa.array(rows.order)))
        name, code = np.unique(values, return_inverse=True)
        mark, found = np.zeros(len(name), bool), []
        for i, j in rows.pairs():
            by = np.argsort(i, kind="stable")
            i, j = i[by], j[by]
            cut = np.flatnonzero(np.diff(i)) + 1
            for a, b in zip([0, *cut], [*cut, len(i)]):
                own, others = code[at[i[a]] : at[i[a] + 1]], j[a:b]
                mark[own] = True
                n = rows.size[others]
                begin = np.cumsum(n) - n
                both = np.add.reduceat(mark[code[np.repeat(at[others] - begin, n) + np.arange(n.sum())]], begin, dtype=np.int64)
                mark[own] = False
                good = both >= rows.t * (len(own) + n - both)
                found.append((i[a:b][good], others[good], both[good]))
        i, j, both = (np.concatenate(c) if found else np.empty(0, np.int64) for c in (zip(*found) if found else ((),) * 3))
        return pa.table({"x": ids.take(pa.array(i, pa.int64())).cast(id_type), "y": ids.take(pa.array(j, pa.int64())).cast(id_type), "both": pa.array(both, pa.int64()), "nx": pa.array(rows.size[i], pa.int64()), "ny": pa.array(rows.size[j], pa.int64())})

    return run


def _blocks(rows: DataFrame, block: int, bins: int) -> DataFrame:
    """Rows of parts (columns part, members, cls) dealt to bins: a part beyond one block goes by pairs of blocks, low and high, to as many bins."""
    rows = rows.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    to = F.pmod(F.xxhash64("part") + F.col("low").cast("bigint") * F.col("blocks") + F.col("high"), F.lit(bins))
    return rows.withColumn("bin", to).drop("blocks", "other", "members")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """a < b, score: pairs of different sets (columns id, w) with a Jaccard similarity of ``threshold`` or more; exact.

    Prefix filter: with tokens from rare to frequent, sets that similar share a
    token among their first |w| - ceil(threshold * |w|) + 1.  Tokens are hashed
    by a function that keeps all of them apart.  Pairs of unlike size, with too
    little left behind the token, or whose bitmaps differ in more bits than
    their sets may in tokens are no candidates.  A token with many rows is
    worked off by pairs of blocks.
    """
    spark = sets.sparkSession
    base = written(sets.where(F.size("w") > 0).select("id", "w").withColumn("cls", F.monotonically_increasing_id()), "words")
    id_type, seed = to_arrow_type(base.schema["id"].dataType), 0
    while True:
        h = lambda w: F.xxhash64(F.lit(seed), w)  # noqa: B023, E731
        tokens = base.select(F.explode("w").alias("w")).groupBy(h(F.col("w")).alias("part")).agg(F.count("*").alias("n"), (F.min("w") != F.max("w")).alias("clash"))
        tokens = written(tokens, "tokens")
        if not tokens.where("clash").limit(1).count():
            break
        discard(tokens)
        seed += 1
    order = np.array([r["part"] for r in tokens.where("n > 1").orderBy(F.desc("n"), "part").limit(FREQUENT).collect()][::-1], np.int64)
    hashed = F.transform("w", lambda x: F.xxhash64(F.lit(seed), x)).alias("h")
    schema = f"cls bigint, id {base.schema['id'].dataType.simpleString()}, size int, prefix array<bigint>, bits binary"
    prefixes = written(base.select("cls", "id", hashed).mapInArrow(_described(order, threshold, id_type), schema), "prefixes")
    rows = prefixes.select("cls", "size", "bits", F.posexplode("prefix").alias("place", "part"))
    # only a token of many sets can be one of many prefixes: those few are counted and broadcast
    often = F.broadcast(tokens.where(F.col("n") > TOKEN_BLOCK).select("part"))
    hot = written(rows.select("part").join(often, "part", "left_semi").groupBy("part").agg(F.count("*").alias("members")).where(F.col("members") > TOKEN_BLOCK), "hot")
    rows = rows.join(F.broadcast(hot), "part", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    bins = lambda n: max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n or 0) // BIN))
    total = prefixes.agg(F.sum(F.size("prefix"))).first()[0]
    dealt = _blocks(rows, TOKEN_BLOCK, bins(total))
    edges = written(dealt.groupBy("bin").applyInArrow(_linked(threshold), "a bigint, b bigint"), "candidates")
    groups = written(connected_components(edges).select(F.col("node").alias("cls"), F.col("root").alias("part")), "groups")
    members = groups.groupBy("part").agg(F.count("*").alias("members"))
    meet = base.select("cls", hashed).join(prefixes.select("cls", "id", "size", "bits"), "cls").join(groups, "cls").join(members, "part")
    dealt = _blocks(meet, SET_BLOCK, bins(20 * groups.count()))
    kind = base.schema["id"].dataType.simpleString()
    found = dealt.groupBy("bin").applyInArrow(_verified(threshold, id_type), f"x {kind}, y {kind}, both bigint, nx bigint, ny bigint")
    score = F.round(F.col("both") / (F.col("nx") + F.col("ny") - F.col("both")), 9)
    out = written(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), score.alias("score")).where(F.col("score") >= threshold), "similar")
    discard(base, tokens, prefixes, hot, edges, groups)
    return out
