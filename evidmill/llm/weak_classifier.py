"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  The documents
are counted by their pattern of votes, expectation-maximisation over those
counts estimates how often each labeller is right, and the posterior of each
pattern becomes the target of a linear scorer over hashed features.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidmill.llm.common import discard, table, written

#: Measurements of a text: its words (runs of anything but ASCII white space), how many of them are of some kind, and its symbols.
MEASURES = ["words", "symbols", "upper", "lower", "distinct", "echo", "bars", "runs", "stops"]
#: (name, condition of a good vote, condition of a bad vote) over columns of measurements; neither: no vote.
LABELLERS: list[tuple[str, Callable, Callable]] = [
    ("symbols", lambda m: 50 * m["symbols"] < m["words"], lambda m: 5 * m["symbols"] > m["words"]),
    ("capitals", lambda m: 10 * m["upper"] < m["words"], lambda m: 2 * m["upper"] > m["words"]),
    ("variety", lambda m: (m["words"] >= 50) & (100 * m["distinct"] > 40 * np.minimum(m["words"], 2000)), lambda m: (m["words"] >= 50) & (100 * m["distinct"] < 20 * np.minimum(m["words"], 2000))),
    ("echo", lambda m: (m["words"] >= 20) & (50 * m["echo"] < m["words"]), lambda m: (m["words"] >= 20) & (4 * m["echo"] > m["words"])),
    ("bars", lambda m: (m["words"] >= 20) & (m["bars"] == 0), lambda m: 10 * m["bars"] > m["words"]),
    ("runs", lambda m: (m["words"] >= 20) & (50 * m["runs"] < m["words"]), lambda m: 5 * m["runs"] > m["words"]),
    ("sentences", lambda m: (m["words"] >= 50) & (60 * m["stops"] > m["words"]) & (3 * m["stops"] < m["words"]), lambda m: (m["words"] >= 50) & (300 * m["stops"] < m["words"])),
    ("casing", lambda m: (m["words"] >= 20) & (2 * m["lower"] > m["words"]), lambda m: (m["words"] >= 20) & (4 * m["lower"] < m["words"])),
]
#: Buckets of the hashed features; documents of the training sample at most; words a worker remembers.
BUCKETS, SAMPLE, REMEMBERED = 1 << 14, 20_000, 400_000

_SYMBOLS = b"#*$%&|<>{}[]\\^~=_"
#: Kinds of words, a bit each: capitals alone (two or more), small letter before any capital, a bar, a doubled sign, an end of a sentence.
KINDS = [re.compile(x) for x in (rb"[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*\Z", rb"[^A-Z]*[a-z]", rb"\|\Z", rb"(?s:.*)([!?#*$%&])\1", rb"(?s:.*)[a-z][.!?]\Z")]
_BITS = (np.arange(1 << len(KINDS))[:, None] >> np.arange(len(KINDS)) & 1).astype(np.float64)


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


_SHAPE = {**{c: ord("A") for c in range(65, 91)}, **{c: ord("a") for c in range(97, 123)}, **{c: ord("0") for c in range(48, 58)}, **{c: ord("A") for c in (*range(0xC0, 0xD7), *range(0xD8, 0xDF))}, **{c: ord("a") for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))}}


def shape(word: str) -> str:
    """The word with letters as a or A and digits as 0; of long ones both ends and whether they are very long."""
    s = word.translate(_SHAPE)
    return s if len(s) <= 3 else s[:2] + ("+" if len(s) < 8 else "*") + s[-2:]


def described(word: bytes) -> int:
    """Kinds of a word (low 5 bits), the bucket of the word (14 bits) and of its shape (14 bits)."""
    text = word.decode("utf-8", "replace")
    kinds = sum(1 << k for k, p in enumerate(KINDS) if p.match(word))
    return kinds | _bucket("w" + text) << 5 | _bucket("s" + shape(text)) << 19


class Words(dict):
    """described() of each word asked for, once; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = described(word)
        if len(word) <= 64:
            self[word] = out
        return out


@functools.cache
def _known() -> Words:
    return Words()


class Text:
    """One text's distinct words, their counts and its measurements."""

    __slots__ = ("count", "info", "measures")

    def __init__(self, raw: bytes | None):
        raw = raw or b""
        words = raw.split()
        counts = Counter(words)
        n = len(counts)
        self.count = np.fromiter(counts.values(), np.float64, n)
        self.info = np.fromiter(map(_known().__getitem__, counts), np.int64, n)
        kinds = np.bincount(self.info & 31, weights=self.count, minlength=32) @ _BITS
        echo = sum(map(bytes.__eq__, words, words[1:]))
        self.measures = (len(words), len(raw) - len(raw.translate(None, _SYMBOLS)), kinds[0], kinds[1], n, echo, kinds[2], kinds[3], kinds[4])

    def features(self) -> np.ndarray:
        """Square roots of the shares of words and of word shapes in each bucket, and bins of how much repeats; unit length."""
        total = max(self.measures[0], 1)
        out = np.sqrt(np.bincount(self.info >> 5 & BUCKETS - 1, weights=self.count, minlength=BUCKETS) / total)
        out += np.sqrt(np.bincount(self.info >> 19, weights=self.count, minlength=BUCKETS) / total)
        top = self.count.max(initial=0) / total
        for name, value in ((f"d{10 * len(self.count) // total}", 1.0), (f"t{int(10 * top)}", 1.0), (f"e{10 * self.measures[5] // total}", 1.0), (f"n{min(total, 1 << 20).bit_length()}", 0.3)):
            out[_bucket(name)] += value
        return out / np.sqrt(out @ out)


def patterns(texts: list[Text]) -> list[str]:
    """The votes on each text, a character per labeller: g, b or -."""
    if not texts:
        return []
    m = dict(zip(MEASURES, np.array([t.measures for t in texts], dtype=np.int64).T))
    votes = np.stack([np.where(bad(m), "b", np.where(good(m), "g", "-")) for _, good, bad in LABELLERS], axis=1)
    return ["".join(v) for v in votes]


def fit_labels(counts: dict[str, int], steps: int = 200, tol: float = 1e-9) -> dict:
    """Expectation-maximisation of two classes with independent labellers.

    ``counts`` has the number of documents by pattern (as many entries as
    patterns exist, 3 ** labellers at most).  Starts from a belief that one bad
    vote outweighs good ones, as each labeller knows one fault.  An abstention
    says nothing about the class, as it depends on length alone.  Returns prior
    (of good), rates[labeller][class][vote b, -, g], accuracy by labeller, and
    posterior by pattern.
    """
    if not counts:
        return {"prior": 0.5, "rates": np.empty((0, 2, 3)), "accuracy": {}, "posterior": {}}
    names = sorted(counts)
    n = np.array([counts[p] for p in names], dtype=np.float64)
    v = np.array([["b-g".index(c) for c in p] for p in names]).reshape(len(names), -1)
    bad = (v == 0).sum(axis=1)
    good = np.where(bad == 0, 0.95, np.where(bad == 1, 0.15, 0.03))
    labellers = v.shape[1]
    seen, prior, rates = None, 0.5, np.full((labellers, 2, 3), 1 / 3)
    for _ in range(steps):
        total = n.sum()
        prior = float(np.clip((n * good).sum() / max(total, 1), 1e-3, 1 - 1e-3))
        for k in range(labellers):
            for c, weight in enumerate((n * (1 - good), n * good)):
                h = np.bincount(v[:, k], weights=weight, minlength=3) + 0.01 * max(total, 1) ** 0.5
                h[1] = 0
                rates[k, c] = h / h.sum()
        logs = np.log([1 - prior, prior])[None, :] + sum(np.where(v[:, k : k + 1] == 1, 0.0, np.log(np.maximum(rates[k].T[v[:, k]], 1e-300))) for k in range(labellers))
        good = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        if seen is not None and np.abs(good - seen).max() < tol:
            break
        seen = good
    accuracy = {}
    for k in range(labellers):
        said = [rates[k, c, 0] + rates[k, c, 2] for c in (0, 1)]
        accuracy[k] = float(((1 - prior) * rates[k, 0, 0] + prior * rates[k, 1, 2]) / max((1 - prior) * said[0] + prior * said[1], 1e-12))
    return {"prior": prior, "rates": rates, "accuracy": accuracy, "posterior": dict(zip(names, good.tolist()))}


def fit_scorer(rows: list[tuple], target: np.ndarray, epochs: int = 12, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by mini-batches in the given order, with AdaGrad steps; (weights, bias)."""
    w, b, g2, gb2 = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    size = 256
    batches = []
    for k in range(0, len(rows), size):
        part = rows[k : k + size]
        at = np.concatenate([np.full(len(i), r, np.uint8) for r, (i, _) in enumerate(part)])
        batches.append((at, np.concatenate([i for i, _ in part]), np.concatenate([v for _, v in part]), target[k : k + size]))
    for _ in range(epochs):
        for at, idx, val, y in batches:
            z = np.bincount(at, weights=w[idx] * val, minlength=len(y)) + b
            d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
            g = np.bincount(idx, weights=d[at] * val, minlength=BUCKETS) + decay * w
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
            gb = d.sum()
            gb2 += gb * gb
            b -= rate * gb / np.sqrt(gb2)
    return w, float(b)


def fitted(posterior: dict[str, float]):
    """The sample's rows (votes, i, v), all in one task and in order, to one row (w, b) of fit_scorer(); none to none."""
    kind = pa.schema([("w", pa.binary()), ("b", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, target = [], []
        for batch in batches:
            target += [posterior[v] for v in batch.column(0).to_pylist()]
            rows += [(np.frombuffer(i.as_py(), np.int16), np.frombuffer(v.as_py(), np.float32)) for i, v in zip(batch.column(1), batch.column(2))]
        if rows:
            w, b = fit_scorer(rows, np.array(target))
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b], pa.float64())], schema=kind)

    return run


def drawn_and_counted(cut: int):
    """(place, text) to rows of counts (votes, n) and, for places below ``cut``, rows of features (votes, place, buckets, values)."""
    kind = pa.schema([("votes", pa.string()), ("n", pa.int64()), ("place", pa.int64()), ("i", pa.binary()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            places = batch.column(0).to_pylist()
            texts = [Text(x.as_py()) for x in batch.column(1).cast(pa.binary())]
            names = patterns(texts)
            total.update(names)
            rows = []
            for place, text, name in zip(places, texts, names):
                if place < cut:
                    f = text.features()
                    at = np.flatnonzero(f)
                    rows.append((name, None, place, at.astype(np.int16).tobytes(), f[at].astype(np.float32).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)
        if total:
            none = [None] * len(total)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip((list(total), list(total.values()), none, none, none), kind)], schema=kind)

    return run


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict:
    """The model: labels as of fit_labels(), and the scorer's weights w and bias b.

    One pass over all documents counts the vote patterns and describes the
    sample, a share of the documents by a hash of key and length.
    """
    total = docs.count()
    place = F.pmod(F.xxhash64(F.col(key), F.length(text)), F.lit(1 << 32))
    cut = min(1 << 32, (sample << 32) // max(total, 1) + 1)
    found = written(docs.select(place.alias("place"), F.col(text).cast("string").alias("text")).mapInArrow(drawn_and_counted(cut), "votes string, n bigint, place bigint, i binary, v binary"), "votes")
    counts = {r["votes"]: r["n"] for r in found.where("n is not null").groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    model = fit_labels(counts)
    # the limit holds the bound where chance or repeated keys exceed it; a task fits, so that the driver sees the weights alone
    drawn = found.where("n is null").orderBy("place", "votes", "i").limit(sample).select("votes", "i", "v")
    got = drawn.coalesce(1).mapInArrow(fitted(model["posterior"]), "w binary, b double").first()
    discard(found)
    w, b = (np.frombuffer(got["w"]), got["b"]) if got else (np.zeros(BUCKETS), 0.0)
    return model | {"w": w, "b": b}


def scorer_udf(posterior: dict[str, float], w: np.ndarray, b: float):
    """Arrow UDF: text to its votes, their posterior and the probability of being good."""
    kind = pa.struct([("votes", pa.string()), ("weak_score", pa.float64()), ("score", pa.float64())])

    @F.arrow_udf("struct<votes:string,weak_score:double,score:double>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            texts = [Text(x.as_py()) for x in part.cast(pa.binary())]
            names = patterns(texts)
            z = np.array([t.features() @ w for t in texts], dtype=np.float64) + b
            score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array([posterior.get(x) for x in names], pa.float64()), pa.array(score, pa.float64())], fields=list(kind))

    return run


def apply(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds votes, weak_score, score and kept to every row, as of classify()."""
    docs = docs.drop("votes", "weak_score", "score", "kept")
    out = docs.withColumn("__s", scorer_udf(model["posterior"], model["w"], model["b"])(F.col(text).cast("string")))
    return out.select(*docs.columns, "__s.votes", "__s.weak_score", "__s.score", (F.col("__s.score") >= threshold).alias("kept"))


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """Adds votes (text, a character per labeller), weak_score, score and kept to every row.

    Vote patterns are counted over all documents; the scorer is fitted on at
    most ``sample`` documents, a share of all by a hash of key and length, and
    scores all.  ``kept`` is true from ``threshold`` on.  Null texts are
    empty ones; a document without words has only its bias and length to be
    judged by.  Repeated rows count each.  Columns of those names are replaced.
    Without documents nothing is fitted, and nothing returned.
    """
    return apply(docs, fit(docs, key, text, sample), text, threshold)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "votes", "weak_score", "score", "kept")
