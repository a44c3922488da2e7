"""Hard negatives by ball trees whose bounds on inner products prune nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidmill.llm.common import table, written

#: Components from here on have no place: products of 2048 of them would leave a long.
LIMIT = float(1 << 18)
LOW, HIGH = -(1 << 63), (1 << 63) - 1
TREE = "shard bigint, dim int, id array<bigint>, row_no array<bigint>, label array<int>, v array<int>, lo array<int>, hi array<int>, left array<int>, centre array<double>, radius array<double>, label_lo array<int>, label_hi array<int>"


def grown(v: np.ndarray, label: np.ndarray, leaf: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Order of the rows, and the nodes of a ball tree over them.

    A node holds the rows from lo to hi of that order; its second child follows
    the first at ``left`` (0 in a leaf; children come after their parent, the
    first right after it).  Nodes of more than ``leaf`` rows are cut at the
    median of their widest component.  centre and radius are the mean and the
    largest distance from it.
    """
    order = np.arange(len(v))
    nodes: list[list] = []

    def grow(a: int, b: int) -> int:
        at, rows = len(nodes), v[order[a:b]]
        centre = rows.mean(0)
        radius = float(np.sqrt(((rows - centre) ** 2).sum(1)).max()) if v.shape[1] else 0.0
        of = label[order[a:b]]
        nodes.append([a, b, 0, centre, radius, of.min(), of.max()])
        if b - a > leaf:
            spread = rows.max(0) - rows.min(0) if v.shape[1] else np.zeros(1)
            if spread.max() > 0:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, spread.argmax()], mid)]
                grow(a, a + mid)
                nodes[at][2] = grow(a + mid, b)
        return at

    grow(0, len(v))
    names = ("lo", "hi", "left", "centre", "radius", "label_lo", "label_hi")
    return order, {n: np.array([x[i] for x in nodes]) for i, n in enumerate(names)}


def trees(vectors: DataFrame, tree_rows: int, leaf: int) -> DataFrame:
    """Vectors dealt by row number to shards of about ``tree_rows`` rows, each a ball tree in one row; written.

    A label or a group of copies is spread over all shards; vectors of one length share a tree.
    """
    shards = max(1, -(-vectors.count() // tree_rows))
    dealt = vectors.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("row_no"), F.lit(shards)))

    def build(part: pa.Table) -> pa.Table:
        dim = part["dim"][0].as_py()
        v = part["v"].combine_chunks().flatten().to_numpy().reshape(part.num_rows, dim)
        columns = {c: part[c].to_numpy() for c in ("vec_id", "row_no", "label")}
        order, nodes = grown(v.astype(float), columns["label"], leaf)
        out = {"shard": part["shard"][:1], "dim": part["dim"][:1]}
        lists = {"id": columns["vec_id"][order], "row_no": columns["row_no"][order], "label": columns["label"][order], "v": v[order].ravel(), **nodes | {"centre": nodes["centre"].ravel()}}
        for name, kind in (("id", pa.int64()), ("row_no", pa.int64()), ("label", pa.int32()), ("v", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("left", pa.int32()), ("centre", pa.float64()), ("radius", pa.float64()), ("label_lo", pa.int32()), ("label_hi", pa.int32())):
            values = pa.array(lists[name], kind)
            out[name] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.table(out)

    return written(dealt.select("shard", "dim", "vec_id", "row_no", "label", "v").groupBy("dim", "shard").applyInArrow(build, TREE), "trees")


class Best:
    """The best k rows so far of each of some slots: higher scores first, then smaller ids, then smaller row numbers."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.full = k, np.zeros(slots, bool)
        self.kth = np.full(slots, LOW)
        self.slot, self.score, self.id, self.row_no = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, row_no: np.ndarray) -> None:
        slot, score, ids, row_no = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids), (self.row_no, row_no)))
        order = np.lexsort((row_no, ids, -score, slot))
        slot, score, ids, row_no = (x[order] for x in (slot, score, ids, row_no))
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = place == self.k - 1
        self.kth[slot[last]], self.full[slot[last]] = score[last], True
        top = place < self.k
        self.slot, self.score, self.id, self.row_no = slot[top], score[top], ids[top], row_no[top]


def look(tree: dict[str, np.ndarray], q: dict[str, np.ndarray], best: Best) -> tuple[int, int]:
    """Adds to best the rows of a tree that slots ask for; returns how many (slot, row) pairs were scored and how many there are.

    A slot asks for rows of its own label (same) or of another, but not its own
    row, with a score from lo to hi.  By the ball around a node's rows scores
    lie within |q| * radius of q's product with the centre: nodes outside lo to
    hi, strictly beneath the k-th score so far, or without a fitting label are
    passed over.  Equal scores are never pruned, as smaller ids come first.
    """
    dim = q["v"].shape[1]
    v = tree["v"].reshape(len(tree["id"]), dim)
    length = np.sqrt((q["v"].astype(float) ** 2).sum(1))
    centre = tree["centre"].reshape(len(tree["radius"]), dim)
    mid = q["v"].astype(float) @ centre.T
    reach = length[:, None] * tree["radius"] * (1 + 1e-9) + np.abs(mid) * 1e-9 + length[:, None] * np.sqrt((centre**2).sum(1)) * 1e-9 + 1e-6
    above, below = mid + reach, mid - reach
    exact = float(np.abs(q["v"]).max(initial=0)) * float(np.abs(v).max(initial=0)) * dim < 2.0**53
    number = np.float64 if exact else np.int64
    qv, rows = q["v"].astype(number), v.astype(number)
    scored, todo = 0, [(0, np.arange(len(length)))]
    while todo:
        n, at = todo.pop()
        fits = np.where(q["same"][at], (q["label"][at] >= tree["label_lo"][n]) & (q["label"][at] <= tree["label_hi"][n]), (q["label"][at] != tree["label_lo"][n]) | (q["label"][at] != tree["label_hi"][n]))
        at = at[fits & (above[at, n] >= q["lo"][at]) & (below[at, n] <= q["hi"][at]) & (~best.full[at] | (above[at, n] >= best.kth[at]))]
        if not len(at):
            continue
        if tree["left"][n]:
            kids = [n + 1, int(tree["left"][n])]
            kids.sort(key=lambda c: above[at, c].mean())
            todo += [(c, at) for c in kids]  # the child that promises more goes first
            continue
        s = np.s_[tree["lo"][n] : tree["hi"][n]]
        score = (qv[at] @ rows[s].T).astype(np.int64)
        scored += score.size
        ask = (q["label"][at][:, None] == tree["label"][s]) == q["same"][at][:, None]
        ask &= (score >= q["lo"][at][:, None]) & (score <= q["hi"][at][:, None]) & (score >= best.kth[at][:, None]) & (q["row_no"][at][:, None] != tree["row_no"][s])
        a, b = np.nonzero(ask)
        if len(a):
            best.add(at[a], score[a, b], tree["id"][s][b], tree["row_no"][s][b])
    return scored, len(length) * len(v)


def nearest(grove: DataFrame, slots: DataFrame, k: int, block_numbers: int = 1 << 16, pass_blocks: int = 64) -> DataFrame:
    """The best k rows of all trees for each slot: slot, place (from 1), id, row_no, score.

    ``slots`` has slot, row_no, label, same, lo, hi and v.  They meet the trees
    in blocks of about ``block_numbers`` components, ``pass_blocks`` blocks (a
    bounded broadcast) a pass.  A task carries the k-th scores of a block from
    tree to tree and hands on k rows a slot at most; those of all tasks are then
    ranked by slot.
    """
    slots = written(slots, "slots")
    size = slots.agg(F.coalesce(F.sum(F.size("v") + 1), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_numbers))
    blocks = written(slots.groupBy(F.size("v").alias("d"), F.pmod(F.xxhash64("slot"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("slot", "row_no", "label", "same", "lo", "hi", "v")).alias("asks")), "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[dict, Best]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                name = batch["block"][r].as_py(), batch["d"][r].as_py()
                if name not in known:
                    asks = batch["asks"][r].values
                    q = {c: asks.field(c).to_numpy(zero_copy_only=False) for c in ("slot", "row_no", "label", "same", "lo", "hi")}
                    q["v"] = asks.field("v").flatten().to_numpy().reshape(len(asks), name[1])
                    known[name] = q, Best(len(asks), k)
                tree = {c: batch[c][r].values.to_numpy(zero_copy_only=False) for c in ("id", "row_no", "label", "v", "lo", "hi", "left", "centre", "radius", "label_lo", "label_hi")}
                look(tree, *known[name])
        for q, best in known.values():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q["slot"][best.slot], best.id, best.row_no, best.score)], ["slot", "id", "row_no", "score"])

    found = None
    for p in range(0, n_blocks, pass_blocks):
        part = F.broadcast(blocks.where(F.col("block").between(p, p + pass_blocks - 1)))
        one = grove.join(part, F.col("dim") == F.col("d")).mapInArrow(run, "slot bigint, id bigint, row_no bigint, score bigint")
        found = one if found is None else found.unionByName(one)
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "id", "row_no"))), 1, k)
    return found.groupBy("slot").agg(top.alias("top")).select("slot", F.posexplode("top").alias("i", "t")).select("slot", (F.col("i") + 1).alias("place"), "t.id", "t.row_no", (-F.col("t.m")).alias("score"))


def mined(
    vectors: DataFrame, anchor: Column, key: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256, tree_rows: int = 2048, leaf: int = 64
) -> DataFrame:
    """Hard negatives of the rows for which ``anchor`` holds: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); scores are inner products as longs.  An
    anchor's positives are the best ``positives`` other rows of its label; of
    each the first ``negatives`` rows of other labels follow whose score lies
    within ``window`` per cent of the positive's, both ends included.  Higher
    scores come first, ties by smaller key; rows that share a key are rows of
    their own, told apart by row number (an anchor is no positive of itself, its
    copy is).  Rows with a null key, label or vector, or with a null or
    non-finite component or one of 2^18 and above take no part; vectors meet
    only those of their length.  A positive score below 0 has no window, so no
    negatives.  Other columns are left out.
    """
    x = F.transform(F.col(embedding), lambda e: e.cast("double"))
    whole = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LIMIT)), F.lit(False))
    kept = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull() & whole)
    kept = kept.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).cast("int").alias("label"), F.transform(x, lambda e: F.floor(e * scale).cast("int")).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = written(kept.withColumn("row_no", F.monotonically_increasing_id()), "vectors")
    grove = trees(rows.drop("anchor"), tree_rows, leaf)
    asks = rows.where("anchor").select(F.col("row_no").alias("slot"), "row_no", "label", F.lit(True).alias("same"), F.lit(LOW).cast("bigint").alias("lo"), F.lit(HIGH).cast("bigint").alias("hi"), "v", "vec_id")
    liked = written(nearest(grove, asks.drop("vec_id"), positives), "positives")
    pairs = liked.select((F.col("slot") * positives + F.col("place") - 1).alias("pair"), F.col("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    low, high = window
    slots = pairs.where("positive_score >= 0").join(asks.select("slot", "row_no", "label", "v"), "slot").select(
        F.col("pair").alias("slot"),
        "row_no",
        "label",
        F.lit(False).alias("same"),
        F.expr(f"({low} * positive_score + 99) div 100").alias("lo"),
        F.expr(f"({high} * positive_score) div 100").alias("hi"),
        "v",
    )
    worse = nearest(grove, slots, negatives)
    named = pairs.join(asks.select("slot", F.col("vec_id").alias("anchor_id")), "slot")
    return named.join(worse, named["pair"] == worse["slot"]).select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(moved, F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(coalesce(list_dot_product(a.v, b.v), 0) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3
"""
