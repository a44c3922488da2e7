"""Embedding near-duplicates through a pivot-permutation index.

Every vector is described by its nearest pivots, in order.  An inverted list
per pivot holds the vectors that have it among the first of this order.  In a
list the shared pivots of two whole descriptions are counted; pairs that share
enough are candidates, and only their cosine is computed, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidmill.llm.common import connected_components, discard, table, written

#: Pivots nearest to a vector that describe it, the first of them in whose lists it is, shared pivots of a candidate pair, and rows of a block.
NEAREST, POSTED, SHARED, BLOCK = 12, 6, 3, 1024
#: Bound of the sample of vectors that become pivots; it grows with the square root of the input up to it.
MOST_PIVOTS = 16_384


def _unit(vectors: list, dim: int) -> np.ndarray:
    m = np.array(vectors, dtype=np.float64).reshape(len(vectors), dim)
    top = np.abs(m).max(axis=1, keepdims=True)
    m = m / np.where(top > 0, top, 1)  # so that squares neither vanish nor overflow
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def usable(vector: str):
    """Not null, no null, NaN or infinite component, and not zero."""
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def apart(pivots: np.ndarray, most: float = 0.8) -> np.ndarray:
    """The pivots in order, without those whose cosine with a kept one exceeds ``most``.

    So a crowd of near copies has one pivot in its midst, first for all of
    them, instead of many whose order is chance.
    """
    open_, kept = np.ones(len(pivots), bool), []
    for k in range(len(pivots)):
        if open_[k]:
            kept.append(k)
            open_ &= pivots @ pivots[k] <= most
    return pivots[kept]


def nearest_pivots(pivots: np.ndarray, nearest: int):
    """Arrow UDF: vector to the numbers of its nearest pivots, nearest first, ties by number."""
    dim = pivots.shape[1]

    @F.arrow_udf("array<int>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out, rows = [], part.to_pylist()
            for k in range(0, len(rows), 512):
                near = -(_unit(rows[k : k + 512], dim) @ pivots.T)
                take = min(nearest, near.shape[1])
                top = np.argpartition(near, take - 1, axis=1)[:, :take]
                order = np.lexsort((top, np.take_along_axis(near, top, 1)), axis=1)
                out += np.take_along_axis(top, order, 1).tolist()
            yield pa.array(out, pa.list_(pa.int32()))

    return run


def _marks(descriptions: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """A row per description and a column per pivot given: 1 where it occurs."""
    out = np.zeros((len(descriptions), len(pivots) + 1), np.float32)
    at = np.minimum(np.searchsorted(pivots, descriptions), len(pivots) - 1)
    out[np.arange(len(descriptions))[:, None], np.where(pivots[at] == descriptions, at, len(pivots))] = 1
    return out[:, :-1]


def _pairs(pdf: pd.DataFrame, pivot: int, diagonal: bool, least: float, shared: int, posted: int) -> pd.DataFrame:
    """Links of one list's block, or of two blocks: partial counts per vector, and edges of a spanning forest of what is linked here."""
    a = pdf if diagonal else pdf[pdf["block"] == pdf["low"]]
    b = pdf if diagonal else pdf[pdf["block"] != pdf["low"]]
    if not len(a) or not len(b):
        return pd.DataFrame({"node": [], "n": [], "root": []})
    dim = len(a["vector"].iloc[0])
    ua = _unit(a["vector"].tolist(), dim)
    ub = ua if diagonal else _unit(b["vector"].tolist(), dim)
    pa_, pb = np.array(a["pivots"].tolist()), np.array(b["pivots"].tolist())
    common = np.intersect1d(pa_, pb)  # holds the list's own pivot
    ma, mb = _marks(pa_, common), _marks(pb, common)
    ida, idb, na, nb = a["cls"].to_numpy(), b["cls"].to_numpy(), a["n"].to_numpy(), b["n"].to_numpy()
    count_a, count_b, parent = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for s in range(0, len(a), 256):
        candidate = ma[s : s + 256] @ mb.T >= shared
        if candidate.mean() > 0.1:  # so many that one product of the rows costs less than gathering them
            candidate &= ua[s : s + 256] @ ub.T >= least - 1e-12
        i, j = np.nonzero(candidate)
        i = i + s
        if diagonal:
            i, j = i[i < j], j[i < j]
        for t in range(0, len(i), 65_536):
            ii, jj = i[t : t + 65_536], j[t : t + 65_536]
            exact = (ua[ii] * ub[jj]).sum(axis=1) >= least
            ii, jj = ii[exact], jj[exact]
            heads = pa_[ii, :posted]
            meet = (heads[:, :, None] == pb[jj, None, :posted]).any(axis=2)
            # a pair belongs to the smallest list alone of those that hold both
            own = np.where(meet, heads, np.iinfo(np.int32).max).min(axis=1) == pivot
            ii, jj = ii[own], jj[own]
            np.add.at(count_a, ii, nb[jj])
            np.add.at(count_b, jj, na[ii])
            for x, y in set(zip(ida[ii].tolist(), idb[jj].tolist())) if len(ii) < 4096 else _forest(ida[ii], idb[jj]):
                parent[find(x)] = find(y)
    n = dict.fromkeys(parent, 0)
    for ids, count in ((ida, count_a), (idb, count_b)):
        for k in np.flatnonzero(count):
            n[int(ids[k])] = n.get(int(ids[k]), 0) + int(count[k])
    nodes = list(n)
    return pd.DataFrame({"node": nodes, "n": [n[x] for x in nodes], "root": [find(x) for x in nodes]})


def _worker(least: float, shared: int, posted: int):
    return lambda group, pdf: _pairs(pdf, int(group[0]), bool(group[1] == group[2]), least, shared, posted)


def _forest(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that connect what the given ones connect, one per vertex at most: labels spread until they rest."""
    ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    p, q = at[: len(x)], at[len(x) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            return iter([(int(ids[k]), int(ids[r])) for k, r in enumerate(label)])
        label = new


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, nearest: int = NEAREST, posted: int = POSTED, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: key, n_links, component_id, kept.

    n_links counts the other rows whose cosine with this one is ``least`` or
    more; component_id is the smallest key reachable by links.  A vector that
    is null or zero, or holds null, NaN or infinite components, links with
    nothing, as does one with no other of its length.  Rows with equal vectors
    are compared once and counted each; so are repeated keys.  A null key takes
    part, but names no component unless all of its keys are null.

    Pivots are a sample of at most MOST_PIVOTS vectors, 4 * sqrt(rows) of them,
    drawn by hash and thinned by apart(); every vector is indexed, in the lists
    of the first ``posted`` of its ``nearest`` pivots.  Candidates share at least
    ``shared`` of ``nearest``.  A list longer than ``block`` is worked off by
    pairs of blocks, each a task of its own, and a pair is counted only in the
    list of the smallest pivot among those that hold both.  Recall against brute
    force is measured in the tests.  Other columns of ``vectors`` are left out.
    """
    base = vectors.select(F.col(key).alias("key"), F.when(usable(vector), F.col(vector)).alias("vector"))
    good = base.where("vector is not null").groupBy("vector").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    classes = written(good.withColumn("cls", F.monotonically_increasing_id()), "vectors")
    dims = [r["d"] for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("c")).where("c > 1").collect()]
    links, spent = None, []
    for d in sorted(dims):
        part = classes.where(F.size("vector") == d)
        total = part.count()
        want = min(MOST_PIVOTS, total, math.ceil(4 * math.sqrt(total)))
        drawn = part.orderBy(F.xxhash64("vector"), "cls").limit(want).select("vector").collect()
        pivots = apart(_unit([r["vector"] for r in drawn], d))
        take = min(shared, len(pivots))
        described = written(part.withColumn("pivots", nearest_pivots(pivots, nearest)(F.col("vector"))), "described")
        spent.append(described)
        heads = F.slice("pivots", 1, posted)
        rows = described.select("cls", "n", "vector", "pivots", F.explode(heads).alias("pivot"))
        sizes = described.select(F.explode(heads).alias("pivot")).groupBy("pivot").agg(F.count("*").alias("size")).where("size > 1")
        sizes = F.broadcast(sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")))  # a row per pivot, MOST_PIVOTS at most
        rows = rows.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        found = rows.select("pivot", "low", "high", "block", "cls", "n", "vector", "pivots").repartition(tasks, "pivot", "low", "high").groupBy("pivot", "low", "high").applyInPandas(_worker(least, take, posted), "node bigint, n bigint, root bigint")
        links = found if links is None else links.union(found)
    out = classes.select("cls", "key", F.col("n").alias("copies"), "vector")
    if links is not None:
        links = written(links, "links")
        discard(*spent)
        roots = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
        counts = links.groupBy("node").agg(F.sum("n").alias("n"))
        out = out.join(roots.withColumnRenamed("node", "cls"), "cls", "left").join(counts.withColumnRenamed("node", "cls"), "cls", "left")
    else:
        out = out.withColumn("root", F.lit(None).cast("bigint")).withColumn("n", F.lit(None).cast("bigint"))
    out = out.withColumn("root", F.coalesce("root", "cls"))
    names = out.groupBy("root").agg(F.min("key").alias("component_id"))
    out = out.join(names, "root").select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = base.where("vector is null").select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"))
    whole = base.where("vector is not null").join(out, "vector").select("key", "n_links", "component_id").union(alone)
    return whole.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY 1)
SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = v.r) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (r)
"""
