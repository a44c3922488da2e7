"""N-gram Jaccard join by chosen paths.

Texts are sets of word shingles.  A run splits them recursively: at a node,
every set chooses some sampled tokens (its minimum under the node's hash
functions), and sets that choose the same token go on together.  Similar sets
keep meeting, others part.  Small buckets are compared by brute force, buckets
that no longer shrink by pairs of blocks, and runs are repeated until the bound
on recall reaches the target.  Only pairs verified on their whole shingle sets
count.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidmill.llm.common import WORD, connected_components, discard, table, written

_WORD = re.compile(WORD)
#: Hash functions of a set's sketch, hash functions of the first level, and children per set at deeper levels.
SKETCH, RUN_TOKENS, BRANCH = 128, 3, 3
#: Hash functions kept for the first levels of all runs.
TOKENS = 12
#: Sets of a bucket compared by brute force, and of a block in buckets that stay larger; levels until then; texts of a block.
BUCKET, BLOCK, DEPTH, TEXTS = 1024, 1024, 6, 512
#: Rows of a side without texts or sketches that is broadcast at most (about 60 MB), so that texts and sketches travel once; more are joined.
PICKED = 500_000
#: Below this estimate of similarity from the sketch, over 4 standard errors under 0.8, a pair is no candidate.
LEAST_ESTIMATE = 0.65


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``size`` words; a text with fewer words, but any, is one shingle."""
    words = _WORD.findall(text)
    if not words:
        return np.empty(0, np.uint64)
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    h = np.array([zlib.crc32(w) | zlib.adler32(w) << 32 for w in raw], dtype=np.uint64)
    long = np.array([len(w) for w in raw], dtype=np.uint64)
    h = _mixed(h + (long << np.uint64(20)))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(h))):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


_SEEDS = _mixed(np.arange(1, SKETCH + TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minima(h: np.ndarray, first: int, count: int) -> np.ndarray:
    """Smallest hash of the set under each of ``count`` functions: its sampled tokens."""
    out = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 2048):
        out = np.minimum(out, _mixed(h[a : a + 2048][None, :] ^ _SEEDS[first : first + count, None]).min(axis=1))
    return out


def described(size: int):
    """Arrow UDF: text to (set fingerprint, set size, sketch of 2 bytes per function, tokens of the first level)."""

    @F.arrow_udf("struct<fp:binary,size:int,sketch:binary,tokens:array<bigint>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            rows = []
            for x in part:
                h = shingles(x.as_py() or "", size)
                if not len(h):
                    rows.append(None)
                    continue
                low = minima(h, 0, SKETCH + TOKENS)
                rows.append({"fp": hashlib.blake2b(h.tobytes(), digest_size=16).digest(), "size": len(h), "sketch": low[:SKETCH].astype("<u2").tobytes(), "tokens": low[SKETCH:].view(np.int64).tolist()})
            yield pa.array(rows, pa.struct([("fp", pa.binary()), ("size", pa.int32()), ("sketch", pa.binary()), ("tokens", pa.list_(pa.int64()))]))

    return run


def _sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column.tolist()), "<u2").reshape(len(column), SKETCH)


def _stars(ids: np.ndarray, i: list, j: list) -> pd.DataFrame:
    """Columns a, b: each vertex of the edges ids[i] - ids[j], and the smallest id it reaches."""
    if not i:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    p, q = np.concatenate(i), np.concatenate(j)
    used = np.unique(np.concatenate([p, q]))
    name = np.sort(ids[used])
    x, y = np.searchsorted(name, ids[p]), np.searchsorted(name, ids[q])
    label = np.arange(len(name))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return pd.DataFrame({"a": name, "b": name[label]})
        label = new


def _parted(run):
    """A grouped-map function over bins that hold whole parts: runs on each part, one (part, low, high)."""

    def bins(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([run(p) for _, p in pdf.groupby(["part", "low", "high"], sort=False)], ignore_index=True)

    return bins


def _candidates(least: float):
    """Sets of one bucket (or pair of blocks) to a star of edges per group that the sketches link."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, size, sketch = pdf["cls"].to_numpy(), pdf["size"].to_numpy(np.float64), _sketches(pdf["sketch"])
        left = np.flatnonzero((pdf["block"] == pdf["low"]).to_numpy())
        right = np.flatnonzero((pdf["block"] == pdf["high"]).to_numpy())
        columns = np.ascontiguousarray(sketch.T)
        found_i, found_j = [], []
        for s in range(0, len(left), 256):
            rows = left[s : s + 256]
            ratio = size[rows][:, None] / size[right][None, :]
            same = np.zeros(ratio.shape, np.uint8)
            for c in columns:
                same += c[rows][:, None] == c[right][None, :]
            i, j = np.nonzero((same >= LEAST_ESTIMATE * SKETCH) & (ratio >= least) & (ratio <= 1 / least) & (rows[:, None] != right[None, :]))
            if len(i):
                found_i.append(rows[i])
                found_j.append(right[j])
        return _stars(ids, found_i, found_j)

    return run


def _verified(least: float, size: int):
    """Texts of one group (or pair of blocks) to partial link counts and stars of the links found here."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, copies = pdf["cls"].to_numpy(), pdf["n"].to_numpy()
        sets = [shingles(t, size) for t in pdf["text"]]
        sizes = np.array([len(s) for s in sets])
        left = np.flatnonzero((pdf["block"] == pdf["low"]).to_numpy())
        right = np.flatnonzero((pdf["block"] == pdf["high"]).to_numpy())
        diagonal = pdf["low"].iloc[0] == pdf["high"].iloc[0]
        # number the shingles that more than one set holds; the others meet nothing
        every, count = np.unique(np.concatenate(sets), return_counts=True)
        every = every[count > 1]
        where = []
        for one in sets:
            at = np.minimum(np.searchsorted(every, one), max(len(every) - 1, 0))
            where.append(at[every[at] == one] if len(every) else at[:0])
        links = np.zeros(len(ids), np.int64)
        found_i, found_j = [], []
        for s in range(0, len(left), 128):
            rows = left[s : s + 128]
            for t in range(0, len(right), 128):
                cols = right[t : t + 128]
                both = np.zeros((len(rows), len(cols)), np.float32)
                for c in range(0, len(every), 8192):
                    m = np.zeros((len(rows), min(8192, len(every) - c)), np.float32)
                    k = np.zeros((len(cols), m.shape[1]), np.float32)
                    for x, members in ((m, rows), (k, cols)):
                        for r, one in enumerate(members):
                            w = where[one]
                            x[r, w[np.searchsorted(w, c) : np.searchsorted(w, c + 8192)] - c] = 1
                    both += m @ k.T
                either = sizes[rows][:, None] + sizes[cols][None, :] - both
                i, j = np.nonzero((both >= least * either - 1e-6) & (rows[:, None] != cols[None, :]))
                if not len(i):
                    continue
                b, e = both[i, j].astype(np.int64), either[i, j].astype(np.int64)
                sure = b * 1_000_000 >= round(least * 1_000_000) * e
                i, j = rows[i[sure]], cols[j[sure]]
                np.add.at(links, i, copies[j])
                if not diagonal:  # within one block both directions come by themselves
                    np.add.at(links, j, copies[i])
                found_i.append(i)
                found_j.append(j)
        stars = _stars(ids, found_i, found_j)
        total = pd.Series(links, index=ids)
        return pd.DataFrame({"cls": stars["a"], "links": total[stars["a"]].to_numpy(), "root": stars["b"]}, dtype="int64")

    return run


def _binned(rows: DataFrame, block: int) -> DataFrame:
    """Rows of parts (columns part, members, cls), ready for _parted() by bin.

    A part beyond one block is worked off by pairs of blocks, and each row goes
    to as many pairs as its part has blocks.  A bin holds whole pairs; there is
    one for every two blocks of rows so repeated, and the pairs of one part go
    to bins one after the other, so that a hot part spreads evenly.
    """
    rows = rows.withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    total = rows.agg(F.sum("blocks")).first()[0] or 0
    bins = max(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    first = F.pmod(F.xxhash64("part"), F.lit(bins))
    return rows.withColumn("bin", F.pmod(first + F.col("low").cast("bigint") * F.col("blocks") + F.col("high"), F.lit(bins))).drop("blocks", "other", "members")


def _picked(wide: DataFrame, narrow: DataFrame) -> DataFrame:
    """wide (one row per cls, with texts or sketches) joined with narrow, by broadcast if narrow's counted rows allow it."""
    return wide.join(F.broadcast(narrow) if narrow.count() <= PICKED else narrow, "cls")


def _one_run(sets: DataFrame, grouped: DataFrame, run: int, least: float, bucket: int, depth: int) -> tuple[DataFrame, int]:
    """Candidate edges (a, b) of one run, and the number of its levels."""
    sketches = sets.select(F.col("__row").alias("cls"), F.col("__size").alias("size"), F.col("__sketch").alias("sketch"))
    own = F.slice("__tokens", run * RUN_TOKENS + 1, RUN_TOKENS)
    light = sets.where("__fp is not null").select("__fp", F.posexplode(own).alias("k", "token")).select("__fp", F.xxhash64(F.lit(run), "k", "token").alias("part")).distinct()
    counts = light.groupBy("part").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("__fp")).alias("who")).where("members > 1")
    # buckets of the same sets are compared once
    small = counts.where(F.col("members") <= bucket).groupBy("who", "members").agg(F.min("part").alias("part")).select("part", "members")
    chosen = small.union(counts.where(F.col("members") > bucket).select("part", "members"))
    first = written(light.join(chosen, "part").join(grouped.select("__fp", "cls"), "__fp").select("part", "members", "cls"), "buckets")
    todo, spent = [first.where(F.col("members") <= bucket)], [first]
    level = 1
    large = first.where(F.col("members") > bucket)
    if large.limit(1).count():
        now = written(_picked(sketches, large), "level")
        spent.append(now)
        while True:
            if level == depth:
                todo.append(now)
                break
            level += 1
            # a child per set and chosen hash function of the node: the sets that agree on its token
            at = F.pmod(F.xxhash64("part", "branch"), F.lit(SKETCH)).cast("int")
            token = F.hex(F.substring("sketch", at * 2 + 1, F.lit(2)))
            kids = now.withColumn("branch", F.explode(F.array(*[F.lit(b) for b in range(BRANCH)]))).withColumn("kid", F.xxhash64("part", "branch", token))
            sizes = written(kids.groupBy("part", "members", "kid").agg(F.count("*").alias("held"), F.bit_xor(F.xxhash64("cls")).alias("who")).where("held > 1"), "kids")
            spent.append(sizes)
            # where half of a node stays together, splitting it on would not part it: its sets are alike
            dense = sizes.where(F.col("held") * 2 >= F.col("members")).select("part").distinct()
            todo.append(now.join(dense, "part"))
            rest = sizes.join(dense, "part", "left_anti").select("kid", F.col("held").alias("members"), "who")
            small = rest.where(F.col("members") <= bucket).groupBy("who", "members").agg(F.min("kid").alias("part")).select("part", "members")
            children = kids.select("cls", "size", "sketch", F.col("kid").alias("part"))
            todo.append(children.join(small, "part"))
            big = rest.where(F.col("members") > bucket).select(F.col("kid").alias("part"), "members")
            if not big.limit(1).count():
                break
            now = written(children.join(big, "part"), "level")
            spent.append(now)
    rows = None
    for t in todo:
        t = t.select("part", "members", "cls")
        rows = t if rows is None else rows.union(t)
    # who meets whom is written without the sketches, which then travel once, to the bins
    meet = written(rows, "meet")
    found = _picked(sketches, _binned(meet, BLOCK)).groupBy("bin").applyInPandas(_parted(_candidates(least)), "a bigint, b bigint")
    edges = written(found, "candidates")
    discard(meet, *spent)
    return edges, level


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, size: int = 5, target_recall: float = 0.999, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """Adds class_id, n_links and kept to every row of docs.

    Documents link where their sets of ``size``-word shingles have a Jaccard
    similarity of ``least`` or more.  n_links counts the other documents linked
    with this one, class_id is the smallest key that links reach, and kept is
    true for one row of each class, the first with that key.  Documents of one
    shingle set are compared once, and each counts.  A text of fewer words than
    ``size`` is one shingle; null texts and texts without words link with
    nothing and are kept.  Null keys take part, but name a class only if all
    its keys are null.  Columns of those names in docs are replaced.

    Of a pair at ``least``, a level of ``BRANCH`` sampled tokens loses
    (1 - least) ** BRANCH, so a run of d levels finds it with probability
    (1 - (1 - least) ** BRANCH) ** d or more; runs are repeated until the bound
    over all of them reaches ``target_recall``.
    """
    docs = docs.drop("class_id", "n_links", "kept")
    rows = docs.withColumn("__d", described(size)(F.col(text)))
    rows = rows.select(*docs.columns, *[F.col(f"__d.{c}").alias(f"__{c}") for c in ("fp", "size", "sketch", "tokens")])
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "sets")
    k = F.col(key)
    first = F.min(F.struct(k.isNull().alias("none"), k.alias("key"), F.col("__row").alias("row"))).alias("rep")
    grouped = rows.where("__fp is not null").groupBy("__fp").agg(F.count("*").alias("n"), F.min("__row").alias("cls"), first)
    grouped = written(grouped, "classes")
    edges, made, miss, run = None, [], 1.0, 0
    while miss > 1 - target_recall:
        if (run + 1) * RUN_TOKENS > TOKENS:
            raise ValueError("target_recall needs more hash functions than a set has")
        here, levels = _one_run(rows, grouped, run, least, bucket, depth)
        made.append(here)
        edges = here if edges is None else edges.union(here)
        miss *= 1 - (1 - (1 - least) ** BRANCH) ** levels
        run += 1
    groups = written(connected_components(edges), "groups")
    discard(*made)
    groups = groups.withColumnRenamed("root", "part").withColumnRenamed("node", "cls")
    members = groups.groupBy("part").agg(F.count("*").alias("members"))
    texts = rows.select(F.col("__row").alias("cls"), F.col(text).alias("text"))
    dealt = _binned(groups.join(members, "part").join(grouped.select("cls", "n"), "cls"), TEXTS)
    links = _picked(texts, dealt).groupBy("bin").applyInPandas(_parted(_verified(least, size)), "cls bigint, links bigint, root bigint")
    links = written(links, "links")
    roots = connected_components(links.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    counted = links.groupBy("cls").agg(F.sum("links").alias("links"))
    classes = grouped.join(roots, "cls", "left").join(counted, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    heads = classes.where("links is not null").groupBy("root").agg(F.min("rep").alias("head"))
    classes = classes.join(heads, "root", "left").select("__fp", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("head", "rep").alias("head"))
    out = rows.join(classes, "__fp", "left")
    return out.select(*docs.columns, F.when(F.col("head").isNull(), F.col(key)).otherwise(F.col("head.key")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("head.row") == F.col("__row"), F.lit(True)).alias("kept"))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "kept")


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS both FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE 10 * p.both >= 8 * (x.n + y.n - p.both)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a AS r, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = reach.b GROUP BY 1)
SELECT d.doc_id, c.class_id, CAST((SELECT count(*) FROM l WHERE l.a = d.r) AS BIGINT) AS n_links, d.doc_id = c.class_id AS kept FROM d JOIN c USING (r)
"""
