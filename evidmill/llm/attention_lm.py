"""Language-model scores from a causal self-attention model trained in numpy.

A text is its words, lower-cased for A-Z, and an end.  Words are split into
subword ids by a public byte-level BPE.  The model factors a subword: one layer
of causal self-attention over classes of the preceding subwords gives the next
class, and counts over all training documents give the id within its class.
Classes come from the neighbours of every subword in all training documents.
The layer starts from a sample and then goes once over every subword of every
training document, in shards whose parameters are averaged.  A word's
probability is a mixture of what the layer spells and of its share of all
training words, so what the model knows grows with the corpus.
Scoring slides overlapping windows over each text in batches; every token is
scored in one window only, with the overlap as context.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidmill.llm.bpe import encoding
from evidmill.llm.common import discard, table, tokenizer_path, written

#: Classes of subwords (the last is the end), head width, window, and tokens of a window that only give context.
CLASSES, WIDTH, WINDOW, OVERLAP = 48, 16, 32, 8
END = CLASSES - 1
#: Documents of the sample the layer starts from, and of a shard of the pass over all; steps of 64 windows on the sample.
SAMPLE, STEPS = 1500, 300
#: The layer's part in the mixture.
MIX = 0.25
#: Words whose counts every worker holds; the counts of all others are joined.
HEAD = 200_000
#: Windows scored together; more of them don't stay in a core's cache.
TOGETHER = 64
#: White space that splits no words.
OTHER = re.compile(r"[^\S ]")
#: The end as a word; no word is empty.
END_WORD = b""


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z lower-cased; bytes.split() splits at ASCII white space alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Subwords:
    """Ids of words, each with a space before it."""

    def __init__(self, path: str):
        self.enc = encoding(path)
        self.size = np.array([len(self.enc.decode_single_token_bytes(i)) for i in range(self.enc.n_vocab)], dtype=np.int64)

    def _encoded(self, text: str) -> list[int]:
        """Ids of a text, in parts where a run of white space is too long for the matcher."""
        try:
            return self.enc.encode(text, disallowed_special=())
        except ValueError:
            return [i for a in range(0, len(text), 65_536) for i in self.enc.encode(text[a : a + 65_536], disallowed_special=())]

    def _alone(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [self._encoded(" " + w.decode("utf-8", "replace")) for w in words]
        return np.array([i for g in got for i in g], np.int64), np.array([len(g) for g in got], np.int64)

    def flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has.

        One call for a group of words, as a space before a non-space always
        begins a pre-token; groups with other white space go word by word.
        """
        ids, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), 512):
            part = words[a : a + 512]
            try:
                text = (b" " + b" ".join(part)).decode()
            except UnicodeDecodeError:
                text = "\n"
            if OTHER.search(text):
                got, counts = self._alone(part)
            else:
                got = self.enc.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
                ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
                counts = np.diff(np.searchsorted(np.cumsum(self.size[got]), ends) + 1, prepend=0)
            ids.append(got)
            many.append(counts)
        return np.concatenate(ids), np.concatenate(many)

    def ids(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        flat, many = self.flat(words)
        return np.split(flat, np.cumsum(many)[:-1]) if words else []


# ---- counting ---------------------------------------------------------------


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to words and their counts, combined until 200,000 distinct words are held; the end counts once per text."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

    for batch in batches:
        for x in batch.column(0):
            seen.update(words_of(x.as_py()))
            seen[END_WORD] += 1
            if len(seen) > 200_000:
                yield out()
                seen = Counter()
    if seen:
        yield out()


def count_subwords(tokenizer: str):
    """Words with counts to subword ids with counts, combined per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = Subwords(tokenizer_path(tokenizer))
        total = np.zeros(len(sub.size), np.int64)
        for batch in batches:
            rows = [(w, c) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w != END_WORD]
            if not rows:
                continue
            flat, many = sub.flat([w for w, _ in rows])
            total += np.bincount(flat, weights=np.repeat([c for _, c in rows], many), minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "c"])

    return run


# ---- the model --------------------------------------------------------------


#: Neighbours told apart on each side (the others are one), occurrences from which an id is clustered, and dimensions kept.
NEAR, LEAST, DIMS = 400, 20, 24


def _pairs_counted(freq: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(id, column, count) of neighbours (left ids, right ids, weights): followers of each id in columns 0 to NEAR, predecessors after them."""
    vocab, width = len(freq), 2 * (NEAR + 1)
    near = np.full(vocab + 1, NEAR)
    often = np.argsort(-freq, kind="stable")[:NEAR]
    near[often] = np.arange(len(often))
    ids = np.flatnonzero(freq >= LEAST)
    row = np.full(vocab + 1, len(ids))  # a row per id asked for, and one for all others
    row[ids] = np.arange(len(ids))
    total = np.zeros((len(ids) + 1) * width, np.int64)  # 50,000 ids by 802 columns at most: 322 MB
    for x, y, n in parts:
        np.add.at(total, row[x] * width + near[y], n)
        np.add.at(total, row[y] * width + NEAR + 1 + near[x], n)
    at = np.flatnonzero(total[: len(ids) * width])
    for a in range(0, len(at), 200_000):
        part = at[a : a + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[part // width], pa.int64()), pa.array(part % width, pa.int64()), pa.array(total[part], pa.int64())], names=["id", "col", "c"])


def neighbours_in_words(tokenizer: str, freq: np.ndarray):
    """Words with counts to the neighbours inside them: exact over all training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = Subwords(tokenizer_path(tokenizer))

        def parts():
            for batch in batches:
                rows = [(w, c) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w != END_WORD]
                if rows:
                    flat, many = sub.flat([w for w, _ in rows])
                    left = np.ones(len(flat), bool)
                    left[np.cumsum(many) - 1] = False
                    left = np.flatnonzero(left)
                    yield flat[left], flat[left + 1], np.repeat(np.array([c for _, c in rows]), many - 1)

        yield from _pairs_counted(freq, parts())

    return run


def neighbours_of_words(freq: np.ndarray, starts: np.ndarray):
    """Texts as ids to the neighbours across words: exact over all training documents."""
    begins = np.append(starts, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    # from the end of a text to the start of the next is no neighbourhood of any id
                    ids = np.frombuffer(b"".join(batch.column(0).slice(k, 256).to_pylist()), np.int32)
                    at = np.flatnonzero(begins[ids[1:]])
                    yield ids[at], ids[at + 1], 1

        yield from _pairs_counted(freq, parts())

    return run


def _profiles(batch: pa.RecordBatch) -> np.ndarray:
    """Square roots of the shares of each id's neighbours."""
    p = np.zeros((batch.num_rows, 2 * (NEAR + 1)))
    for k, (cols, cs) in enumerate(zip(batch.column(1), batch.column(2))):
        p[k, np.array(cols.values)] = np.array(cs.values)
    return np.sqrt(p / np.maximum(p.sum(1, keepdims=True), 1))


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, square = 0, np.zeros(2 * (NEAR + 1)), np.zeros((2 * (NEAR + 1),) * 2)
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            p = _profiles(batch.slice(k, 1024))
            n, total, square = n + len(p), total + p.sum(0), square + p.T @ p
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([square.tobytes()], pa.binary())], names=["n", "total", "square"])


def projected(mean: np.ndarray, basis: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                x = ((_profiles(part) - mean) @ basis).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])

    return run


def subword_classes(counts: DataFrame, windows: DataFrame, tokenizer: str, freq: np.ndarray, starts: np.ndarray, seed: int = 1) -> np.ndarray:
    """Class of every id: clusters of all ids seen LEAST times by their neighbours; the others by whether they begin a word.

    Neighbours inside words come from the counts of all words, those across
    words from the windows of all training documents and the texts of the sample.
    """
    rng = np.random.default_rng(seed)
    out = np.where(starts, CLASSES - 3, CLASSES - 2)
    if (freq >= LEAST).sum() < CLASSES:
        return out
    kind = "id bigint, col bigint, c bigint"
    inside = counts.mapInArrow(neighbours_in_words(tokenizer, freq), kind)
    across = windows.select("seq").mapInArrow(neighbours_of_words(freq, starts), kind)
    pairs = inside.union(across).groupBy("id", "col").agg(F.sum("c").alias("c"))
    by_id = pairs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("col", "c"))).alias("r"))
    rows = written(by_id.select("id", "r.col", "r.c"), "neighbours").coalesce(4)  # a row per id of the vocabulary at most
    n, total, square = 0, 0.0, 0.0
    for r in rows.mapInArrow(moments, "n bigint, total binary, square binary").toLocalIterator():
        n, total, square = n + r["n"], total + np.frombuffer(r["total"]), square + np.frombuffer(r["square"])
    mean = total / n
    basis = np.linalg.eigh(square.reshape(len(mean), -1) / n - np.outer(mean, mean))[1][:, ::-1][:, :DIMS]
    got = sorted((r["id"], bytes(r["x"])) for r in rows.mapInArrow(projected(mean, basis), "id bigint, x binary").collect())
    common = np.array([i for i, _ in got])
    x = np.frombuffer(b"".join([v for _, v in got]), np.float32).reshape(len(common), -1).astype(np.float64)
    k = CLASSES - 3
    weight = np.sqrt(freq[common])
    centre = x[rng.choice(len(x), k, replace=False, p=weight / weight.sum())]
    for _ in range(25):
        near = ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1)
        for c in range(k):
            if (near == c).any():
                centre[c] = np.average(x[near == c], axis=0, weights=weight[near == c])
    out[common] = near
    return out


def train(sequences: list[np.ndarray], steps: int = STEPS, seed: int = 1, rate: float = 0.02) -> dict[str, np.ndarray]:
    """Parameters of the attention layer, by Adam on windows drawn from the class sequences (start first, end last).

    a: class-pair attention logits; r: logits by distance; v: values; o: output;
    s: skip connection from the present class; b: bias.
    """
    rng = np.random.default_rng(seed)
    n, c, h = WINDOW, CLASSES, WIDTH
    par = {"a": np.zeros((c, c)), "r": np.zeros(n), "v": rng.normal(0, 0.3, (c, h)), "o": rng.normal(0, 0.3, (h, c)), "s": np.zeros((c, c)), "b": np.zeros(c)}
    usable = [q for q in sequences if len(q) > 1]
    if not usable:
        return par
    whole, real = laid_out(usable)
    return descend(par, whole, real, (rng.integers(0, len(whole) - n, 64) for _ in range(steps)), steps, rate)


def laid_out(usable: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences one after the other, each filled up to a window, and which places are theirs."""
    n = WINDOW
    whole = np.concatenate([np.concatenate([q, np.full(max(0, n + 1 - len(q)), END)]) for q in usable])
    real = np.concatenate([np.concatenate([np.ones(len(q)), np.zeros(max(0, n + 1 - len(q)))]) for q in usable])
    return whole, real


def one_pass(par: dict[str, np.ndarray], sequences: list[np.ndarray], seed: int = 1, rate: float = 0.005) -> dict[str, np.ndarray]:
    """Goes on from ``par`` over every place of the sequences (uint8) once, in single precision: windows next to one another, the last of a text filled up."""
    n = WINDOW
    lengths = np.array([len(q) for q in sequences])
    many = -(-(lengths - 1) // n)  # windows: every place but a text's first is asked for in one
    base = np.cumsum(lengths) - lengths
    first = np.repeat(base - n * (np.cumsum(many) - many), many) + n * np.arange(many.sum())
    left = np.repeat(base + lengths, many) - first  # places of the text from there on
    whole = np.concatenate([*sequences, np.full(n, END, np.uint8)])
    order = np.random.default_rng(seed).permutation(len(first))
    real = lambda k: (np.arange(n + 1) < left[order[k : k + 64], None]).astype(np.float32)
    batches = ((first[order[k : k + 64]], real(k)) for k in range(0, len(order), 64))
    return descend({k: v.astype(np.float32) for k, v in par.items()}, whole, None, batches, -(-len(order) // 64), rate)


def descend(par: dict[str, np.ndarray], whole: np.ndarray, real: np.ndarray | None, batches, steps: int, rate: float) -> dict[str, np.ndarray]:
    """Adam over batches of first places of windows, with a falling rate; without ``real`` a batch brings along which places count."""
    n, c, kind = WINDOW, CLASSES, par["a"].dtype
    far = np.arange(n)[:, None] - np.arange(n)[None, :]
    mask, eye, near = (far >= 0).astype(kind), np.eye(c, dtype=kind), np.maximum(far, 0).ravel()
    ones = np.ones((c, 1), kind)
    m1 = {k: np.zeros_like(x) for k, x in par.items()}
    m2 = {k: np.zeros_like(x) for k, x in par.items()}
    for step, batch in enumerate(batches, 1):
        at = batch if real is not None else batch[0]
        idx = at[:, None] + np.arange(n + 1)
        seq = whole[idx].astype(np.int64)
        good = (real[idx] if real is not None else batch[1])[:, 1:]
        x, y = seq[:, :-1], seq[:, 1:].ravel()
        # weights before their sums: logits are a part of two classes and a part of the distance
        pair = np.exp(par["a"] - par["a"].max(1, keepdims=True)).ravel()
        place = (x * c)[:, :, None] + x[:, None, :]
        w = np.take(pair, place)
        w *= np.exp(par["r"] - par["r"].max())[near].reshape(n, n) * mask
        v = np.concatenate([par["v"], ones], axis=1)[x]
        hid = w @ v
        size = np.maximum(hid[:, :, -1:], 1e-30)
        hid = hid[:, :, :-1] / size
        rows = hid.reshape(-1, hid.shape[2])
        z = rows @ par["o"]
        z += (par["s"] + par["b"])[x.ravel()]
        # what the layer adds is a mean of values, so logits have a bound; under it exp() needs no shift
        if np.abs(par["v"]).max() * np.abs(par["o"]).sum(0).max() + np.abs(par["s"] + par["b"]).max() > 60:
            z -= z.max(1, keepdims=True)
        d = np.exp(z, out=z)
        d /= d @ ones
        d[np.arange(len(y)), y] -= 1
        d *= (good / kind.type(max(good.sum(), 1))).reshape(-1, 1)
        e = eye[x.ravel()]
        # by hid over its sums: ds = w * (dh v' - dh hid) / size, dv = w' (dh / size)
        dh = (d @ par["o"].T).reshape(hid.shape) / size
        ds = np.concatenate([dh, -(dh * hid).sum(2, keepdims=True)], axis=2) @ v.transpose(0, 2, 1)
        ds *= w
        dv = w.transpose(0, 2, 1) @ dh
        skip = e.T @ d
        grad = {
            "a": np.bincount(place.ravel(), ds.ravel(), c * c).reshape(c, c).astype(kind),
            "r": np.bincount(near, ds.sum(0).ravel(), n).astype(kind),
            "v": e.T @ dv.reshape(-1, dv.shape[2]),
            "o": rows.T @ d,
            "s": skip,
            "b": skip.sum(0),
        }
        lr = rate * min(1, step / 20) * (1 - step / (steps + 1)) ** 0.5
        for k, g in grad.items():
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            par[k] -= lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return par


def whole_texts(tokenizer: str):
    """(shard, text) to (shard, ids): all subwords of every document between its start and its end, ids of their own past the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = Subwords(tokenizer_path(tokenizer))
        edge = np.array([len(sub.size)], np.int32)
        for batch in batches:
            shards, texts, done, n = batch.column(0), batch.column(1), 0, batch.num_rows
            while done < n:
                first, words, lengths = done, [], []
                while done < n and len(words) < 65_536:
                    ws = words_of(texts[done].as_py())
                    words += ws
                    lengths.append(len(ws))
                    done += 1
                flat, many = sub.flat(words)
                cuts = np.append(0, np.cumsum(many))[np.cumsum([0, *lengths])].tolist()
                flat = flat.astype(np.int32)
                seqs = [np.concatenate([edge, flat[a:b], edge]).tobytes() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([shards.slice(first, done - first), pa.array(seqs, pa.binary())], names=["shard", "seq"])

    return run


def as_classes(classes: np.ndarray):
    """(shard, ids) to (shard, classes as bytes)."""
    of = np.append(classes, END).astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                seqs = [of[np.frombuffer(x, np.int32)].tobytes() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(seqs, pa.binary())], names=["shard", "seq"])

    return run


def fit_shard(par: dict[str, np.ndarray]):
    """A shard's texts as classes to its positions and its parameters times them."""
    names = sorted(par)

    def run(shard: pa.Table) -> pa.Table:
        seqs = [np.frombuffer(x, np.uint8) for x in sorted(shard.column("seq").to_pylist())]
        n = sum(map(len, seqs))
        got = one_pass(par, seqs)
        flat = np.concatenate([got[k].ravel() for k in names]).astype(np.float64) * n
        return pa.table({"shard": pa.array([shard.column("shard")[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "flat": pa.array([flat.tobytes()], pa.binary())})

    return run


def add_shards(part: pa.Table) -> pa.Table:
    rows = sorted(zip(part.column("shard").to_pylist(), part.column("n").to_pylist(), part.column("flat").to_pylist()))
    flat = sum(np.frombuffer(f) for _, _, f in rows)
    return pa.table({"n": pa.array([sum(n for _, n, _ in rows)], pa.int64()), "lane": pa.array([rows[0][0] % 16], pa.int64()), "flat": pa.array([flat.tobytes()], pa.binary())})


def all_windows(training: DataFrame, tokenizer: str, shards: int) -> DataFrame:
    """shard, seq: all training documents (columns key, text) as ids, dealt to shards by hash."""
    dealt = training.select(F.pmod(F.xxhash64("key", "text"), F.lit(shards)).cast("bigint").alias("shard"), "text")
    return dealt.mapInArrow(whole_texts(tokenizer), "shard bigint, seq binary")


def refined(windows: DataFrame, par: dict[str, np.ndarray], classes: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters after a pass over all training documents: fitted in each shard from ``par``, averaged by positions."""
    bare = windows.select("shard", "seq").mapInArrow(as_classes(classes), "shard bigint, seq binary")
    fitted = bare.groupBy("shard").applyInArrow(fit_shard(par), "shard bigint, n bigint, flat binary")
    rows = fitted.groupBy(F.col("shard") % 16).applyInArrow(add_shards, "n bigint, lane bigint, flat binary").collect()
    rows.sort(key=lambda r: r["lane"])
    flat = sum(np.frombuffer(r["flat"]) for r in rows) / sum(r["n"] for r in rows)
    out, at = {}, 0
    for k in sorted(par):
        out[k] = flat[at : at + par[k].size].reshape(par[k].shape)
        at += par[k].size
    return out


def class_scores(par: dict[str, np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each place of the class sequences (without start and end, uint8), one after the other, each with its end.

    A window asks for WINDOW - OVERLAP tokens, and sees OVERLAP more before
    them; a text's first window has nothing before them to see.
    """
    return flat_scores(par, np.concatenate([np.append(t, END) for t in texts]), np.array([len(t) + 1 for t in texts]))


def flat_scores(par: dict[str, np.ndarray], goals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """class_scores() of sequences one after the other, each with its end, and their lengths."""
    n, c = WINDOW, CLASSES
    step = n - OVERLAP
    y = np.concatenate([goals, np.full(n, END)]).astype(np.int64)
    x = np.concatenate([[END], y[:-1]])
    base = np.cumsum(lengths) - lengths
    windows = -(-lengths // step)
    doc = np.repeat(np.arange(len(lengths)), windows)
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    first = base[doc] + turn * step
    left = lengths[doc] - turn * step
    far = np.arange(OVERLAP, n)[:, None] - np.arange(n)[None, :]
    decay = np.where(far >= 0, np.exp(par["r"] - par["r"].max())[np.maximum(far, 0)], 0).astype(np.float32)
    alone = np.where(np.arange(n) < OVERLAP, np.float32(0), decay)
    pair = np.exp(par["a"] - par["a"].max(1, keepdims=True)).astype(np.float32).ravel()
    value = np.concatenate([par["v"], np.ones((c, 1))], axis=1).astype(np.float32)
    out_w, skip = par["o"].astype(np.float32), (par["s"] + par["b"]).astype(np.float32)
    # what the layer adds is a mean of values, so logits have a bound; under it exp() needs no shift
    bounded = np.abs(par["v"]).max() * np.abs(par["o"]).sum(0).max() + np.abs(skip).max() < 60
    got, asked, seen = np.zeros(len(x), np.float32), np.arange(step), np.arange(-OVERLAP, step)
    for group, mask in ((np.flatnonzero(turn == 0), alone), (np.flatnonzero(turn > 0), decay)):
        for k in range(0, len(group), TOGETHER):
            at = group[k : k + TOGETHER]
            xk = x[np.clip(first[at][:, None] + seen, 0, len(x) - 1)]
            xq = xk[:, OVERLAP:]
            w = np.take(pair, (xq * c)[:, :, None] + xk[:, None, :])
            w *= mask
            hid = w @ value[xk]
            z = (hid[:, :, :-1] / np.maximum(hid[:, :, -1:], 1e-30)) @ out_w
            z += skip[xq]
            if not bounded:
                z -= z.max(2, keepdims=True)
            goal = np.minimum(first[at][:, None] + asked, len(x) - 1)
            score = np.take_along_axis(z, y[goal][:, :, None], 2)[:, :, 0]
            score -= np.log(np.exp(z, out=z).sum(2))
            own = asked < left[at][:, None]
            got[goal[own]] = score[own]
    return got[: len(x) - n]


# ---- scoring ----------------------------------------------------------------

_TABLES: dict = {}


class WordTable:
    """What a worker knows of words, by number: classes of their subwords, log10 within classes, counts, and whether they are among the counted ones here.

    The counted words and the end stay; at most HEAD others are remembered.
    """

    def __init__(self, model: dict):
        self.sub = Subwords(tokenizer_path(model["tokenizer"]))
        self.classes, self.per_id = model["classes"].astype(np.uint8), model["within"]
        self.number: dict[bytes, int] = {END_WORD: 0}
        self.flat, self.many, self.within = np.array([END], np.uint8), np.ones(1, np.int64), np.zeros(1)
        words = [w for w in model["words"] if w != END_WORD]
        for a in range(0, len(words), 65_536):
            self._learn(words[a : a + 65_536])
        self.kept = len(self.number)
        self.count = np.array([model["end_count"], *model["counts"]], np.float64)
        self.starts = np.cumsum(self.many) - self.many

    def _learn(self, words: list[bytes]) -> None:
        flat, many = self.sub.flat(words)
        self.number.update(zip(words, range(len(self.many), len(self.many) + len(words))))
        self.within = np.append(self.within, np.add.reduceat(self.per_id[flat], np.cumsum(many) - many))
        self.flat, self.many = np.append(self.flat, self.classes[flat]), np.append(self.many, many)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        got = list(map(self.number.get, words))
        if None in got:
            if len(self.number) - self.kept > HEAD:
                self.number = dict(list(self.number.items())[: self.kept])
                end = int(self.many[: self.kept].sum())
                self.flat, self.many, self.within = self.flat[:end], self.many[: self.kept], self.within[: self.kept]
                got = list(map(self.number.get, words))
            missing = [k for k, g in enumerate(got) if g is None]
            self._learn(list({words[k] for k in missing}))
            self.starts = np.cumsum(self.many) - self.many
            for k in missing:
                got[k] = self.number[words[k]]
        return np.array(got, np.int64)

    def sequences(self, numbers: np.ndarray) -> np.ndarray:
        """Classes of the words' subwords, one word after the other."""
        many = self.many[numbers]
        return self.flat[np.repeat(self.starts[numbers] - np.cumsum(many) + many, many) + np.arange(many.sum())]


def scorer(model_ref, uid: str):
    """Arrow UDF: text to counts and sums over the words counted here, and the words counted elsewhere with what the layer gives them."""
    kind = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("tail", pa.list_(pa.struct([("word", pa.binary()), ("log", pa.float32())])))])

    @F.arrow_udf("struct<n_tokens:bigint,n_known:bigint,logs:double,score:double,tail:array<struct<word:binary,log:float>>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_ref.value
        if uid not in _TABLES:
            _TABLES.clear()
            _TABLES[uid] = WordTable(model)
        known, par, mix, every = _TABLES[uid], model["par"], model["mix"], model["every"]
        end_known = int(model["end_count"] > 0)
        log = np.log10(known.count + 1)
        share = (1 - mix) * (known.count + 1) / every
        for part in parts:
            done, n, k = [], len(part), 0
            while k < n:
                words, lengths = [], []
                while k < n and len(words) < 65_536:
                    ws = words_of(part[k].as_py())
                    words += ws
                    words.append(END_WORD)
                    lengths.append(len(ws) + 1)
                    k += 1
                numbers, lengths = known.numbers(words), np.array(lengths)
                many, first = known.many[numbers], np.cumsum(lengths) - lengths
                places = np.cumsum(many) - many
                logs = flat_scores(par, known.sequences(numbers), np.add.reduceat(many, first))
                # the layer's log10 of each word: of its subwords' classes and of the ids within them
                spelt = np.add.reduceat(logs.astype(np.float64), places) / np.log(10) + known.within[numbers]
                here = numbers < known.kept
                at = np.where(here, numbers, 0)
                total = np.where(here, np.log10(share[at] + mix * 10**spelt), 0.0)
                away = np.flatnonzero(~here)
                tail = pa.StructArray.from_arrays([pa.array([words[i] for i in away.tolist()], pa.binary()), pa.array(spelt[away], pa.float32())], names=["word", "log"])
                cuts = np.append(np.searchsorted(away, first), len(away))
                n_known = np.add.reduceat(here.astype(np.int64), first) - 1 + end_known
                sums = [np.add.reduceat(v, first) for v in (np.where(here, log[at], 0.0), total)]
                done.append(pa.StructArray.from_arrays([pa.array(lengths), pa.array(n_known), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), tail)], fields=list(kind)))
            yield pa.concat_arrays(done) if done else pa.array([], kind)

    return run


def held_out(key: str):
    """True where crc32 of the key as text leaves 2 modulo 7; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(False))


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", sample: int = SAMPLE, steps: int = STEPS, head: int = HEAD, mix: float = MIX) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts, classes and the attention layer are fitted on all documents that are
    not held out; the layer starts from ``sample`` of them and then goes once
    over every subword of all, in shards of about ``sample``.
    A word's probability is ``mix`` of what the layer spells and the rest of its
    add-one share of all training tokens, as in the base score.  Null
    texts are empty ones and have the end alone.  Repeated rows count each.
    Without training documents every count is 0 and the model is uniform over
    classes, and within them over ids.  Other columns of docs are left out.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), held_out(key).alias("held_out"))
    training = base.where("not held_out")
    counted = training.select("text").mapInArrow(count_words, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    counts = written(counted, "words")
    stats = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.length("word") == 0, F.col("c"))), F.lit(0)).alias("ends")).first()
    # the most frequent words, by classes of count an eighth of a doubling wide: as many classes from the top as hold ``head`` words at most
    size = F.floor(F.log2("c") * 8)
    classes_of = counts.where(F.length("word") > 0).groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()
    held, least = 0, None
    for r in sorted(classes_of, key=lambda r: -r["size"]):
        held += r["n"]
        if held > head:
            break
        least = r["size"]
    top = counts.where((F.length("word") > 0) & (size >= least)).collect() if least is not None else []
    ids = counts.mapInArrow(count_subwords(tokenizer), "id bigint, c bigint").groupBy("id").agg(F.sum("c").alias("c")).collect()

    sub = Subwords(tokenizer_path(tokenizer))
    vocab = len(sub.size)
    place = F.pmod(F.xxhash64("key", F.length("text"), F.lit(6)), F.lit(1 << 32))
    drawn = training.withColumn("place", place).where(F.col("place") < min(1 << 32, (sample << 32) // max(stats["ends"], 1) + 1))
    texts = [r["text"] for r in drawn.select("place", "text").orderBy("place", "text").limit(sample).collect()]
    encoded = [np.concatenate(i) if (i := sub.ids(words_of(t))) else np.zeros(0, np.int64) for t in texts]
    starts = np.array([sub.enc.decode_single_token_bytes(i)[:1] == b" " for i in range(vocab)])
    freq = np.zeros(vocab)
    for r in ids:
        freq[r["id"]] = r["c"]
    windows = written(all_windows(training, tokenizer, max(1, -(-stats["ends"] // sample))), "windows")
    classes = subword_classes(counts, windows, tokenizer, freq, starts)
    par = train([np.concatenate([[END], classes[t], [END]]) for t in encoded], steps)
    if stats["ends"] and steps:
        par = refined(windows, par, classes)
    discard(windows)
    per_class = np.bincount(classes, weights=freq + 0.1, minlength=CLASSES)
    within = np.log10((freq + 0.1) / per_class[classes])
    model = {"tokenizer": tokenizer, "classes": classes, "within": within, "par": par, "words": [bytes(r["word"]) for r in top], "counts": [r["c"] for r in top], "end_count": stats["ends"], "mix": mix, "every": float(stats["n"] + stats["v"] + 1)}
    ref = spark.sparkContext.broadcast(model)  # bounded by ``head`` words and the vocabulary

    scored = base.select("key", "held_out", scorer(ref, uuid.uuid4().hex)("text").alias("s")).select("key", "held_out", "s.*")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # more than ``head`` words are as frequent as any here, but for an eighth of a doubling, so none holds much over 1 / head of all words
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.log").join(counts, "word", "left")
    share = (F.coalesce("c", F.lit(0)) + 1.0) * ((1 - mix) / (stats["n"] + stats["v"] + 1))
    more = tail.groupBy("row").agg(F.count("c").alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("more_logs"), F.sum(F.log10(share + mix * F.pow(F.lit(10.0), F.col("log").cast("double")))).alias("more_score"))
    full = scored.drop("tail").join(more, "row", "left")
    spread = float(np.log10(stats["n"] + stats["v"] + 1))
    return full.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(stats["n"]).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
