"""Weak labels, language model and pipeline."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evidmill.llm import attention_lm as LM
from evidmill.llm import weak_classifier as C

SF = "/root/testdata/sf0.001"


def test_em_finds_the_accuracies():
    rng = random.Random(1)
    rates, counts, truth = [0.95, 0.9, 0.85, 0.8], Counter(), []
    for _ in range(6000):
        y = rng.random() < 0.8
        votes = "".join("-" if rng.random() < 0.2 else "gb"[y != (rng.random() < r)] for r in rates)
        counts[votes] += 1
        truth.append((votes, y))
    m = C.fit_labels(dict(counts))
    assert abs(m["prior"] - 0.8) < 0.05
    assert all(abs(m["accuracy"][k] - r) < 0.06 for k, r in enumerate(rates))
    assert sum((m["posterior"][v] > 0.5) == y for v, y in truth) > 0.93 * len(truth)
    assert C.fit_labels({})["posterior"] == {}


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = C.classify(docs).select("doc_id", "kept").toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    good = got[got.quality == 1]
    bad = got[got.quality == 0]
    assert good.kept.mean() > 0.995 and bad.kept.mean() < 0.05


def test_classifier_edges(spark):
    rows = [(1, None, "x", 1), (None, "", "y", 2), (1, "word", "z", 3), (1, "word", "z", 3), (2, "a b c. " * 4000, "q", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, votes string, kept int")
    assert C.classify(df).count() == 5 and C.classify(df, sample=2).count() == 5
    assert C.classify(df.limit(0)).count() == 0


def plain(t):
    """Measurements, votes and features of a text, a step at a time."""
    t = t or ""
    ws = [w for w in re.split("[ \t\n\x0b\x0c\r]+", t) if w]
    n = len(ws)
    cap, low = (lambda w: re.findall("[A-Z]", w)), (lambda w: re.findall("[a-z]", w))
    symbols = sum(t.count(c) for c in "#*$%&|<>{}[]\\^~=_")
    upper = sum(len(cap(w)) > 1 and not low(w) for w in ws)
    lower = sum(bool(re.match("[^A-Z]*[a-z]", w)) for w in ws)
    distinct, echo = len(set(ws)), sum(a == b for a, b in zip(ws, ws[1:]))
    bars, runs = ws.count("|"), sum(any(c + c in w for c in "!?#*$%&") for w in ws)
    stops = sum(w[-1] in ".!?" and len(w) > 1 and "a" <= w[-2] <= "z" for w in ws)
    vote = lambda good, bad: "b" if bad else "g" if good else "-"
    votes = "".join(
        [
            vote(50 * symbols < n, 5 * symbols > n),
            vote(10 * upper < n, 2 * upper > n),
            vote(n >= 50 and 100 * distinct > 40 * min(n, 2000), n >= 50 and 100 * distinct < 20 * min(n, 2000)),
            vote(n >= 20 and 50 * echo < n, n >= 20 and 4 * echo > n),
            vote(n >= 20 and bars == 0, 10 * bars > n),
            vote(n >= 20 and 50 * runs < n, 5 * runs > n),
            vote(n >= 50 and 60 * stops > n > 3 * stops, n >= 50 and 300 * stops < n),
            vote(n >= 20 and 2 * lower > n, n >= 20 and 4 * lower < n),
        ]
    )
    of = lambda name: zlib.crc32(name.encode()) % C.BUCKETS
    f, k = Counter(), max(n, 1)
    for names in (["w" + w for w in ws], ["s" + C.shape(w) for w in ws]):
        for b, c in Counter(map(of, names)).items():
            f[b] += math.sqrt(c / k)
    top = max(Counter(ws).values(), default=0)
    for name, v in ((f"d{10 * distinct // k}", 1), (f"t{10 * top // k}", 1), (f"e{10 * echo // k}", 1), (f"n{k.bit_length()}", 0.3)):
        f[of(name)] += v
    size = math.sqrt(sum(v * v for v in f.values()))
    return votes, {b: v / size for b, v in f.items()}


def test_classifier_by_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = ["", None, "| | |", "A!! B## aB.", "x\xa0y \u2003 z", "w. " * 300, "DO NOT. " * 40, "a<b>[c]{d}\\^~=_ " * 30, "é" * 5000]
    docs = docs.union(spark.createDataFrame(list(enumerate(odd, 10_000)), docs.schema))
    model = C.fit(docs)
    rows = docs.collect()
    want = {r["doc_id"]: plain(r["text"]) for r in rows}
    assert model["posterior"].keys() == {v for v, _ in want.values()}
    for r in C.apply(docs, model).collect():
        votes, f = want[r["doc_id"]]
        z = sum(v * model["w"][b] for b, v in f.items()) + model["b"]
        assert r["votes"] == votes and r["weak_score"] == model["posterior"][votes]
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9 and r["kept"] == (r["score"] >= 0.5)


def test_every_distinct_word_is_a_feature():
    words = [f"word{k}" for k in range(200)]
    a, b = (C.Text(" ".join(x).encode()).features() for x in (words, words[::-1]))
    assert all(a[zlib.crc32(f"w{w}".encode()) % C.BUCKETS] > 0 for w in words) and np.allclose(a, b)


def test_windows_score_each_token_once():
    rng = np.random.default_rng(0)
    par = {"a": rng.normal(size=(LM.CLASSES,) * 2), "r": rng.normal(size=LM.WINDOW), "v": rng.normal(size=(LM.CLASSES, LM.WIDTH)), "o": rng.normal(size=(LM.WIDTH, LM.CLASSES)), "s": rng.normal(size=(LM.CLASSES,) * 2), "b": rng.normal(size=LM.CLASSES)}
    texts = [rng.integers(0, LM.END, n).astype(np.uint8) for n in (0, 1, 30, 31, 32, 33, 55, 56, 57, 200)]
    got = LM.class_scores(par, texts)
    assert len(got) == sum(len(t) + 1 for t in texts)
    at = 0
    for t in texts:
        x, y = [LM.END, *t], [*t, LM.END]
        for i in range(len(x)):
            step = LM.WINDOW - LM.OVERLAP
            start = max(0, i // step * step - LM.OVERLAP)
            ctx = x[start : i + 1]
            w = np.array([math.exp(par["a"][x[i], c] + par["r"][i - start - j]) for j, c in enumerate(ctx)])
            z = (w / w.sum()) @ par["v"][ctx] @ par["o"] + par["s"][x[i]] + par["b"]
            assert abs(z[y[i]] - math.log(np.exp(z).sum()) - got[at + i]) < 1e-3
        at += len(x)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(3)
    seqs = [np.concatenate([[LM.END], np.tile([1, 2, 3, 4, 5], 30)[rng.integers(0, 5) :], [LM.END]]) for _ in range(40)]
    new, old = LM.train(seqs, 60), LM.train(seqs, 0)
    body = [s[1:-1].astype(np.uint8) for s in seqs]
    assert LM.class_scores(new, body).sum() > 0.3 * LM.class_scores(old, body).sum()


def test_scores_against_counts(spark):
    rows = [(k, t) for k, t in enumerate(["The cat sat.\nthe CAT", "a b c " * 300, "", None, "Été é\xa0x", "the the the"] * 6)] + [(None, "the end"), (3, "again")]
    df = spark.createDataFrame([(a, b, 0.0) for a, b in rows], "doc_id long, text string, score double")
    got = LM.lm_scores(df, steps=5, head=3).collect()
    toks = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    c = Counter(w for k, t in rows if not held(k) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(k), held(k), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)), 6)) for k, t in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert LM.lm_scores(df.limit(0)).count() == 0


def test_model_beats_the_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base, score = LM.lm_scores(docs).where("held_out").groupBy().sum("base_score", "score").first()
    assert score > base + 2000


def test_a_long_word_of_other_white_space():
    sub = LM.Subwords(LM.tokenizer_path("byte_bpe_50k.json"))
    for t in ("\xa0" * 1_200_000, "\u3000x" * 100_000):
        ids = sub.ids(LM.words_of(t))
        assert b"".join(sub.enc.decode_single_token_bytes(i) for i in ids[0].tolist()) == (" " + t).encode()


def test_scores_mix_the_layer_and_the_shares(spark):
    """With a head of one word, all others are scored by the join; both ways give the same sums."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = ({r["doc_id"]: r for r in LM.lm_scores(docs, steps=20, head=h).collect()} for h in (1, 1 << 20))
    assert all(abs(a[k]["score"] - b[k]["score"]) < 1e-4 * abs(b[k]["score"]) and abs(a[k]["base_score"] - b[k]["base_score"]) < 1e-6 * abs(b[k]["base_score"]) and a[k]["n_known"] == b[k]["n_known"] for k in a)
    none = {r["doc_id"]: r for r in LM.lm_scores(docs, steps=0, mix=0.0).collect()}
    assert all(abs(r["score"] - r["base_score"]) < 1e-6 * abs(r["score"]) for r in none.values())


def test_model_is_fitted_on_all_training_documents(spark):
    rng = random.Random(5)
    # every document has words of its own, so a sample of 20 knows few of them
    rows = [(k, " ".join(rng.choice([f"w{k}x alpha", f"w{k}x beta", "gamma"]) for _ in range(60))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tok = "byte_bpe_50k.json"
    sub = LM.Subwords(LM.tokenizer_path(tok))
    freq = np.zeros(len(sub.size))
    for _, t in rows:
        np.add.at(freq, np.concatenate(sub.ids(LM.words_of(t))), 1)
    starts = np.array([sub.enc.decode_single_token_bytes(i)[:1] == b" " for i in range(len(freq))])
    counts = spark.createDataFrame([(bytes(w), c) for w, c in Counter(w for _, t in rows for w in LM.words_of(t)).items()], "word binary, c long")
    docs = df.withColumnRenamed("doc_id", "key")
    windows = LM.all_windows(docs, tok, 4)
    classes = LM.subword_classes(counts, windows, tok, freq, starts)
    assert (classes[freq >= LM.LEAST] < LM.CLASSES - 3).all() and (classes[freq < LM.LEAST] >= LM.CLASSES - 3).all()
    # every document has a window, and it is a run of its subwords
    text = {b"".join([np.int32(len(freq)).tobytes(), *[i.astype(np.int32).tobytes() for i in sub.ids(LM.words_of(t))], np.int32(len(freq)).tobytes()]) for _, t in rows}
    got = [bytes(r["seq"]) for r in windows.collect()]
    assert len(got) == len(rows) and all(sum(g in t for t in text) == 1 for g in got)
    seqs = [np.concatenate([[LM.END], classes[np.concatenate(sub.ids(LM.words_of(t)))], [LM.END]]) for _, t in rows]
    start = LM.train(seqs[:3], 20)
    got = LM.refined(windows, start, classes)
    again = LM.refined(LM.all_windows(docs.repartition(7), tok, 4), start, classes)
    body = [q[1:-1].astype(np.uint8) for q in seqs]
    assert LM.class_scores(got, body).sum() > LM.class_scores(start, body).sum()
    assert all(np.array_equal(got[k], again[k]) for k in got)


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    base = spark.read.parquet(f"{SF}/documents.parquet")
    bad = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (7, "word " * 60, "en", "s", 300)], base.schema)
    docs = base.union(bad)
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
        if k < len(P.STAGES) - 1:
            assert out.columns == base.columns
            docs = P.written(out, "test")
            assert docs.count() <= base.count() + 3
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert left and all(labels.get(x, 1) == 1 for x in left)


@pytest.mark.parametrize("name", ["op1_embedding_near_dedup", "op2_quality_rules", "op3_ngram_jaccard_join", "op9_pii"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from evidmill.llm import queries as Q

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a = Q.queries()[name](spark, SF).toPandas()
    b = con.execute(Q.oracle_sql()[name]).df()
    key = sorted(a.columns)
    assert sorted(b.columns) == key
    assert sorted(map(str, a[key].values.tolist())) == sorted(map(str, b[key].values.tolist()))


def test_every_operator_is_registered():
    from evidmill.llm import queries as Q

    assert {n.split("_")[0] for n in Q.queries()} == {f"op{k}" for k in range(1, 11)}
    assert os.path.isdir(SF) and list(itertools.islice(Q.oracle_sql(), 1))


def test_the_sample_of_the_classifier_stays_out_of_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"Line {k} of a plain text with words w{k % 7} and v{k % 5}. ") for k in range(400)], "doc_id bigint, text string")
    taken, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: taken.append(collect(self)) or taken[-1])
    model = C.fit(docs)
    assert model["w"].any() and max(map(len, taken)) < 100
