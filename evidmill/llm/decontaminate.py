"""Benchmark passages in training documents, found in a positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidmill.llm.common import table, written
from evidmill.operators.graph import SMALL_GROUPS

#: Bytes of a text: A-Z become a-z, what stands between words becomes a space; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: The same words in Spark.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Places left free between the documents of a segment, so that no phrase reaches into the next one.
GAP = 32
END = b"\x01"


def words(text: Column) -> Column:
    """Array of the words of a text, A-Z lower-cased; a null text has none."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(folded, BETWEEN), lambda w: w != F.lit(""))


def postings(texts: list[bytes | None]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Words of each text; distinct words of all; places of each word; all places by word, rising, as differences."""
    blob = (b" " + END + b" ").join([(x or b"").translate(FOLD) for x in texts]) + b" " + END
    found = pa.array(blob.split(), pa.binary()).dictionary_encode()
    code, terms = found.indices.to_numpy(), found.dictionary
    end = pc.index(terms, pa.scalar(END, pa.binary())).as_py()
    ends = np.flatnonzero(code == end)
    n_words = np.diff(ends, prepend=-1) - 1
    place = np.arange(len(code)) + np.repeat(np.arange(len(texts)) * (GAP - 1), n_words + 1)
    counts = np.bincount(code, minlength=len(terms))
    by_word = place[np.argsort(code, kind="stable")]
    before = int(counts[:end].sum())
    by_word = np.delete(by_word, np.s_[before : before + len(texts)])
    keep = np.arange(len(terms)) != end
    return n_words, terms.filter(pa.array(keep)), counts[keep], np.diff(by_word, prepend=0)


def _lists(kind: pa.DataType, rows: list) -> pa.Array:
    """List column of one list a row, from arrays."""
    parts = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x in rows]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in parts]), pa.int32()), pa.concat_arrays(parts))


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4 << 20) -> DataFrame:
    """The positional index, written in the shared folder: a row per segment of documents.

    A segment holds documents read one after another, up to ``size`` bytes of
    text or else one document: ids (the keys of its documents), n_words of each,
    its distinct terms, the number of places of each, and the places, rising for
    each term, as differences from the place before.  It is kept by document, so
    that postings are never shuffled and no common word meets in one task.  Row
    groups hold a few segments, so that neither writing nor reading needs memory
    that grows with a task's input.
    Every row is a document, even if keys or texts repeat; a null key stays, a
    null text has no words.  Other columns of docs are left out.
    """
    of_key = to_arrow_type(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
                n, terms, counts, places = postings(texts[a:b].to_pylist())
                columns = [pa.array([number], pa.int64()), _lists(of_key, [ids[a:b]]), _lists(pa.int32(), [n]), _lists(pa.binary(), [terms]), _lists(pa.int32(), [counts]), _lists(pa.int32(), [places])]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "ids", "n_words", "terms", "counts", "places"])
                number, a = number + 1, b

    kind = docs.schema[key].dataType.simpleString()
    return written(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, f"segment bigint, ids array<{kind}>, n_words array<int>, terms array<binary>, counts array<int>, places array<int>"), "postings", **SMALL_GROUPS)


class Phrases:
    """The distinct windows of some items, as rows of word numbers; -1 fills those of short items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], width: int) -> None:
        number: dict[bytes, int] = {}
        windows: dict[tuple, int] = {}
        pairs = set()
        for i, (_, ws) in enumerate(items):
            codes = [number.setdefault(w, len(number)) for w in ws]
            for s in range(max(1, len(codes) - width + 1) if codes else 0):
                w = codes[s : s + width]
                pairs.add((windows.setdefault(tuple(w + [-1] * (width - len(w))), len(windows)), i))
        self.words = pa.array(list(number), pa.binary())
        self.rows = np.array(list(windows), np.int64).reshape(-1, width)
        self.length = (self.rows >= 0).sum(1)
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.first, self.item = np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1)), pairs[:, 1]
        self.ids = [k for k, _ in items]

    def items_of(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in window, item) for every item of every window given."""
        n = self.first[window + 1] - self.first[window]
        at = np.repeat(np.arange(len(window)), n)
        return at, self.item[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + self.first[window][at]]


def intersect(phrases: Phrases, terms: pa.Array, counts: np.ndarray, places: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, place of its rarest word) of all starts from which each word stands at most slop places off its own.

    The rarest word of a window proposes starts; the lists of the others, less
    their offsets, are met with them from the rarest on.
    """
    none = np.zeros(0, np.int64)
    if not len(phrases.rows) or not len(terms):
        return none, none, none
    here = pc.fill_null(pc.index_in(phrases.words, value_set=terms), -1).to_numpy().astype(np.int64)
    width = phrases.rows.shape[1]
    start_of = np.cumsum(counts) - counts
    padded = phrases.rows < 0
    code = np.where(padded, -1, here[phrases.rows])
    alive = np.flatnonzero(((code >= 0) | padded).all(1))
    rarity = np.where(padded[alive], np.iinfo(np.int64).max, counts[code[alive]])
    order = np.argsort(rarity, axis=1, kind="stable")
    t = code[alive, order[:, 0]]
    n = counts[t]
    window = np.repeat(np.arange(len(alive)), n)
    anchor = places[np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + start_of[t][window]]
    start = anchor - order[window, 0]
    if slop:
        moves = np.arange(-slop, slop + 1)
        window, anchor, start = np.repeat(window, len(moves)), np.repeat(anchor, len(moves)), (start[:, None] + moves).ravel()
    margin = width + slop
    span = int(places.max()) + 2 * margin + 1
    keys = np.repeat(np.arange(len(terms)), counts) * span + places + margin
    for k in range(1, width):
        if not len(window):
            break
        off = order[window, k]
        t = code[alive[window], off]
        want = t * span + start + off + margin
        at = np.searchsorted(keys, want - slop)
        ok = (t < 0) | (keys[np.minimum(at, len(keys) - 1)] <= want + slop) & (at < len(keys))
        window, anchor, start = window[ok], anchor[ok], start[ok]
    return alive[window], start, anchor


def _spans(doc: np.ndarray, a: np.ndarray, b: np.ndarray, of: int) -> list[list[dict]]:
    """For each of so many documents its ranges, overlapping ones joined."""
    out: list[list[dict]] = [[] for _ in range(of)]
    for d, x, y in sorted(set(zip(doc.tolist(), a.tolist(), b.tolist(), strict=True))):
        if out[d] and x <= out[d][-1]["end"]:
            out[d][-1]["end"] = max(y, out[d][-1]["end"])
        else:
            out[d].append({"start": x, "end": y})
    return out


def search(segments: DataFrame, bench: DataFrame, item: str = "item_id", text: str = "text", width: int = 10, slop: int = 1, block_words: int = 1 << 17) -> DataFrame:
    """One row per document of index(): __key, n_words, hits, items, near_items.

    A window is ``width`` consecutive words of an item; an item of fewer words,
    but not none, is one window.  hits are the ranges of words, start to end
    (exclusive), that lie inside exact occurrences of windows; items the
    ids whose windows occur; near_items those with a window whose words all
    stand at most ``slop`` words off their places in it, counted from one start
    (slop <= 15).  Windows are looked up in each segment by itself, from the
    word that is rarest there.

    Items go in blocks of about ``block_words`` words, 16 blocks (a bounded
    broadcast) a pass; a very long item is cut into runs that share width - 1
    words.  Only with more blocks than one are the rows of a document brought
    together, by its place in the index.  Items with one id count once; those
    without an id make hits but are not listed; null texts have no words.
    """
    if not 0 <= slop <= (GAP - 2) // 2:
        raise ValueError(f"slop must be from 0 to {(GAP - 2) // 2}")
    step, id_type, key_type = block_words // 2, bench.schema[item].dataType, segments.schema["ids"].dataType.elementType
    of_item, of_key = to_arrow_type(id_type), to_arrow_type(key_type)
    w = bench.select(F.col(item).alias("id"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    runs = w.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("ws") - width, F.lit(0)), F.lit(step)), lambda i: F.slice("ws", i + 1, F.lit(step + width - 1)))).alias("ws"))
    runs = written(runs.withColumn("no", F.monotonically_increasing_id()), "runs")
    n_blocks = max(1, -(-(runs.agg(F.sum(F.size("ws"))).first()[0] or 0) // block_words))
    dealt = runs.groupBy(F.pmod(F.xxhash64("no"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("id", F.transform("ws", lambda x: x.cast("binary")).alias("ws"))).alias("runs"))
    blocks = written(segments.sparkSession.range(n_blocks).withColumnRenamed("id", "block").join(dealt, "block", "left"), "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Phrases] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                block = batch["block"][r].as_py()
                if block not in known:
                    known[block] = Phrases([(x["id"], x["ws"]) for x in batch["runs"][r].as_py() or ()], width)
                phrases = known[block]
                flat = {c: batch[c][r].values for c in ("ids", "n_words", "terms", "counts", "places")}
                n, counts = flat["n_words"].to_numpy().astype(np.int64), flat["counts"].to_numpy().astype(np.int64)
                places = np.cumsum(flat["places"].to_numpy().astype(np.int64))
                first = np.cumsum(n + GAP) - n - GAP
                win, start, anchor = intersect(phrases, flat["terms"], counts, places, slop)
                doc = np.searchsorted(first, anchor, "right") - 1
                exact = np.ones(len(win), bool)
                if slop:  # starts of exact ones are those that hold without slop
                    ewin, estart, eanchor = intersect(phrases, flat["terms"], counts, places, 0)
                    edoc = np.searchsorted(first, eanchor, "right") - 1
                else:
                    ewin, estart, edoc = win[exact], start[exact], doc[exact]
                hits = _spans(edoc, estart - first[edoc], estart - first[edoc] + phrases.length[ewin], len(n))
                named = []
                for of_doc, of_win in ((edoc, ewin), (doc, win)):
                    at, it = phrases.items_of(of_win)
                    rows: list[set] = [set() for _ in range(len(n))]
                    for d, i in set(zip(of_doc[at].tolist(), it.tolist(), strict=True)):
                        if phrases.ids[i] is not None:
                            rows[d].add(phrases.ids[i])
                    named.append([sorted(x) for x in rows])
                keep = np.flatnonzero(np.array([block == 0 or bool(h) or bool(x) for h, x in zip(hits, named[1], strict=True)], bool))
                ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                columns = [
                    pa.array(np.full(len(keep), batch["segment"][r].as_py()), pa.int64()), pa.array(keep, pa.int64()), flat["ids"].take(pa.array(keep)).cast(of_key), pa.array(n[keep], pa.int64()),
                    pa.array([hits[i] for i in keep], ranges), *(pa.array([x[i] for i in keep], pa.list_(of_item)) for x in named),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "at", "__key", "n_words", "hits", "items", "near_items"])

    kind, of = key_type.simpleString(), id_type.simpleString()
    schema = f"segment bigint, at bigint, __key {kind}, n_words bigint, hits array<struct<start:bigint,end:bigint>>, items array<{of}>, near_items array<{of}>"
    out = None
    for p in range(0, n_blocks, 16):
        part = F.broadcast(blocks.where(F.col("block").between(p, p + 15)))
        found = segments.crossJoin(part).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if n_blocks > 1:
        whole = [F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items"))]
        out = out.groupBy("segment", "at").agg(F.first("__key").alias("__key"), F.first("n_words").alias("n_words"), *whole)
    return out.select("__key", "n_words", "hits", "items", "near_items")


def covered(hits: Column) -> Column:
    """Number of words in at least one of the ranges, which are in order."""
    start = F.struct(F.lit(0).cast("bigint").alias("to"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(hits, start, lambda a, r: F.struct(F.greatest(a["to"], r["end"]).alias("to"), (a["n"] + F.greatest(r["end"] - F.greatest(a["to"], r["start"]), F.lit(0))).alias("n")))["n"]


def contaminated(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10, slop: int = 1) -> DataFrame:
    """One row per document: key, n_words, hits, items, near_items; see index() and search()."""
    return search(index(docs, key, text), bench, item, item_text, width, slop).withColumnRenamed("__key", key)


def op11_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        covered(F.col("hits")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(named, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"),
    )


_WORDS = r"list_filter(string_split_regex(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS ws FROM benchmark),
win AS (SELECT item_id, s, list_slice(ws, s, s + 9) AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0)),
wid AS (SELECT w, CAST(row_number() OVER (ORDER BY w) AS INTEGER) AS wno FROM (SELECT DISTINCT w FROM win)),
wt AS (SELECT wno, len(w) AS width, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM wid),
tok AS (SELECT * FROM (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS p FROM d) WHERE t IN (SELECT t FROM wt)),
near AS (SELECT DISTINCT doc_id, wno, width, p - i + m AS s, i, m FROM tok JOIN wt USING (t) CROSS JOIN (VALUES (-1), (0), (1)) AS v(m)),
found AS (SELECT doc_id, wno, s, width, count(DISTINCT i) FILTER (m = 0) = width AS exact FROM near GROUP BY doc_id, wno, s, width HAVING count(DISTINCT i) = width),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items, count(DISTINCT item_id) FILTER (exact) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) FILTER (exact) AS listed FROM found JOIN wid USING (wno) JOIN win USING (w) GROUP BY doc_id),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + width)) AS q FROM found WHERE exact) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
