"""The language model learns from every place of every training document."""

from collections import Counter

import numpy as np

from evidmill.llm import attention_lm as LM

TOK = "byte_bpe_50k.json"


def test_texts_are_learned_from_as_a_whole(spark):
    rows = [(1, "one two " * 3000), (2, None), (3, "Ab\nc"), (4, "caf\xe9 　x"), (5, ""), (6, "z" * 70)]
    docs = spark.createDataFrame(rows, "key long, text string")
    sub = LM.Subwords(LM.tokenizer_path(TOK))
    edge = np.array([len(sub.size)])
    want = Counter(np.concatenate([edge, *sub.ids(LM.words_of(t)), edge]).astype(np.int32).tobytes() for _, t in rows)
    assert Counter(bytes(r["seq"]) for r in LM.all_windows(docs, TOK, 3).collect()) == want


def test_every_place_is_asked_for_once(monkeypatch):
    rng = np.random.default_rng(0)
    seqs = [np.array([LM.END, *rng.integers(0, LM.END, n), LM.END], np.uint8) for n in (0, 1, 30, 31, 32, 33, 63, 500)]
    asked = []

    def seen(par, whole, real, batches, steps, rate):
        for first, good in batches:
            asked.extend((f + k) for f, g in zip(first.tolist(), good) for k in range(1, LM.WINDOW + 1) if g[k])
        return par

    monkeypatch.setattr(LM, "descend", seen)
    LM.one_pass({"a": np.zeros(1)}, seqs)
    starts = set(np.cumsum([0, *map(len, seqs)]).tolist())
    assert sorted(asked) == [k for k in range(sum(map(len, seqs))) if k not in starts]


def test_neighbours_across_words_are_all_counted():
    starts, freq = np.array([True, True, False, False]), np.full(4, 50.0)
    texts = [[4, 0, 2, 1, 3, 0, 4], [4, 4], [4, 1, 0, 1, 0, 1, 4]]
    batch = LM.pa.RecordBatch.from_arrays([LM.pa.array([np.array(t, np.int32).tobytes() for t in texts], LM.pa.binary())], names=["seq"])
    got = Counter()
    for b in LM.neighbours_of_words(freq, starts)(iter([batch])):
        got.update(dict(zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2).to_pylist())))
    place, after, before = {0: 0, 1: 1, 2: 2, 3: 3, 4: LM.NEAR}, 0, LM.NEAR + 1
    want = Counter()
    for t in texts:
        for a, b in zip(t, t[1:]):
            if b == 4 or starts[b]:
                want.update([(a, after + place[b])] * (a < 4) + [(b, before + place[a])] * (b < 4))
    assert got == want
