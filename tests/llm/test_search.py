"""Decontamination, conversation repair and hard negatives against brute force."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidmill.llm import conversation_repair as C
from evidmill.llm import decontaminate as D
from evidmill.llm import hard_negatives as H
from evidmill.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted(str(list(r)) for r in df.values.tolist())


@pytest.mark.parametrize("name", ["op11_benchmark_decontamination", "op12_conversation_repair", "op13_hard_negatives"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


# decontamination


def plain_words(text):
    out, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isdigit() and c < "\x7f" or "a" <= c <= "z" or c > "\x7f":
            word += c
        else:
            out, word = out + [word] * bool(word), ""
    return out + [word] * bool(word)


def plain_hits(docs, bench, width, slop):
    result = []
    for key, text in docs:
        ws, hit, items, near = plain_words(text), set(), set(), set()
        for item, passage in bench:
            p = plain_words(passage)
            for s in range(max(1, len(p) - width + 1) if p else 0):
                w = p[s : s + width]
                for at in range(-slop, len(ws) + slop):
                    if ws[at : at + len(w)] == w and at >= 0:
                        hit |= set(range(at, at + len(w)))
                        items |= {item} - {None}
                    if all(x in ws[max(0, at + i - slop) : max(0, at + i + slop + 1)] for i, x in enumerate(w)):
                        near |= {item} - {None}
        result.append((key, len(ws), len(hit), sorted(items), sorted(near)))
    return sorted(result, key=str)


def found_hits(spark, docs, bench, **kw):
    d = spark.createDataFrame(docs, "doc_id int, text string").withColumn("hits", F.lit(1)).withColumn("segment", F.lit(2))
    b = spark.createDataFrame(bench, "item_id int, text string").withColumn("n_words", F.lit(1))
    out = D.search(D.index(d, size=kw.pop("size", 64)), b, **kw)
    return sorted(((r["__key"], r.n_words, r.n, r["items"], r.near_items) for r in out.withColumn("n", D.covered(F.col("hits"))).collect()), key=str)


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_phrases_equal_brute_force(spark, slop):
    rng = random.Random(slop)
    draw = lambda n: " ".join(rng.choice("a b c d Ä e1".split()) for _ in range(n))
    docs = [(i, draw(rng.randint(0, 40))) for i in range(60)] + [(1, "A, b!c\x01d"), (None, "a b c"), (7, None), (8, ""), (9, "a b c " * 3000)]
    bench = [(i, draw(rng.choice([0, 1, 2, 5, 9]))) for i in range(20)] + [(3, "a b c d e1"), (None, "c c a"), (5, None), (6, "b")]
    assert found_hits(spark, docs, bench, width=4, slop=slop) == plain_hits(docs, bench, 4, slop)


def test_blocks_of_items_and_long_items_change_nothing(spark):
    rng = random.Random(5)
    draw = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    docs, bench = [(i, draw(30)) for i in range(30)], [(i, draw(6)) for i in range(25)] + [(99, draw(200))]
    assert found_hits(spark, docs, bench, width=3, block_words=20) == plain_hits(docs, bench, 3, 1)


def test_no_phrase_crosses_documents_and_empty_tables(spark):
    assert [r[2] for r in found_hits(spark, [(1, "a b"), (2, "c d")], [(1, "b c")], width=2, slop=2, size=1 << 20)] == [0, 0]
    assert found_hits(spark, [], [(1, "a")]) == []
    assert found_hits(spark, [(1, "a b")], []) == [(1, 2, 0, [], [])]
    with pytest.raises(ValueError):
        D.search(D.index(spark.createDataFrame([(1, "a")], "doc_id int, text string")), spark.createDataFrame([(1, "a")], "item_id int, text string"), slop=99)


def test_a_common_passage_and_a_very_long_text(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(i, f"x {passage} y") for i in range(200)] + [(999, "lorem " * 400_000 + passage)]
    got = found_hits(spark, docs, [(1, passage)], size=1 << 20)
    assert [(r[0], r[2], r[3]) for r in got] == sorted([(i, 12, [1]) for i, _ in docs], key=str)


# conversation repair


def cheapest(seq):
    """Least (cost, audit) over all edit strings with at most five inserts, by enumeration."""
    best = (1 << 60, "")
    options = []
    for initial, fault in seq:
        extra = 5 if fault == C.CUT else 0
        options.append([("D", 2, "")] + ([] if fault in (C.BLANK, C.DUPLICATE) else [("K", extra, initial), ("R", 1 + extra, "u"), ("R", 1 + extra, "a")]))
    gaps = [list(itertools.product("ua", repeat=n)) for n in range(3)]
    for choice in itertools.product(*options):
        for ins in itertools.product([x for g in gaps for x in g], repeat=len(seq) + 1):
            cost = sum(c for _, c, _ in choice) + 5 * sum(map(len, ins))
            if cost > best[0]:
                continue
            out, audit = "".join(ins[0]), "I" * len(ins[0])
            for (label, _, x), more in zip(choice, ins[1:], strict=True):
                out, audit = out + x + "".join(more), audit + label + "I" * len(more)
            body = out[1:] if out[:1] == "s" else out
            if (out == "" or body and body == "ua" * (len(body) // 2)) and (cost, audit) < best:
                best = (cost, audit)
    return best


def test_shortest_path_equals_enumeration():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4):
        for _ in range(12 if n < 4 else 4):
            seq = [(rng.choice("suat").replace("t", "?"), rng.choice([0, 0, C.BLANK, C.DUPLICATE, C.CUT])) for _ in range(n)]
            assert C.shortest(seq) == cheapest(seq), seq


def plain_repair(turns):
    """Counts and hash of one conversation given as (turn, role, text) in order, nulls filled."""
    seen, seq, n = set(), [], {C.BLANK: 0, C.DUPLICATE: 0, C.CUT: 0}
    for _, role, text in turns:
        body = text.rstrip(C.SPACE)
        fault = C.BLANK if not body else C.DUPLICATE if (role, text) in seen else C.CUT if body[-1] not in ".!?" else 0
        seen.add((role, text))
        n[fault] = n.get(fault, 0) + 1
        seq.append((role[:1] if role[:1] in ("s", "u", "a") else "?", fault))
    cost, audit = cheapest(seq)
    out, it = [], iter(turns)
    for label in audit:
        _, role, text = (None, "", "") if label == "I" else next(it)
        if label != "D":
            head = 1 if out and out[0].startswith("s") else 0
            out.append((role if label == "K" else ("user", "assistant")[(len(out) - head) % 2]) + ":" + text)
    t = {x for x, _, _ in turns if x is not None}
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(seq))
    return (max(t) - min(t) + 1 - len(t) if t else 0, n[C.BLANK], n[C.DUPLICATE], n[C.CUT], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_repair_equals_brute_force(spark):
    rng = random.Random(11)
    data = []
    for conv in [None, *range(25)]:
        for turn in range(rng.randint(0, 4)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None])
            data.append((conv, None if rng.random() < 0.1 and not turn else turn * rng.choice([1, 1, 2]), role, rng.choice(["Hi.", "Hi.", "what", "  \t", "", None, "Ünd?\n"])))
    # one row a turn, so that the order is the turns'
    data = [r for i, r in enumerate(data) if not any(r[:2] == q[:2] for q in data[:i])]
    df = spark.createDataFrame(data, "conv_id int, turn int, role string, text string").withColumn("audit", F.lit("x")).withColumn("part", F.lit(7))
    known = C.audits(df)
    got = {r.conv_id: tuple(r)[1:] for r in C.digested(df, known).collect()}
    want = {}
    for conv in {r[0] for r in data}:
        turns = sorted((r for r in data if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        want[conv] = plain_repair([(t, " " if role is None else role, " " if text is None else text) for _, t, role, text in turns])
    assert got == want
    kept = C.repaired(df, known).orderBy("conv_id", "place").collect()
    for conv, w in want.items():
        body = "\n".join(f"{r.role}:{r.text}" for r in kept if r.conv_id == conv)
        assert hashlib.sha256(body.encode()).hexdigest() == w[-1]


def test_dropped_tied_long_and_no_conversations(spark):
    df = spark.createDataFrame([(1, 0, "user", "x."), (2, 0, "user", "a."), (2, 0, "user", "a."), (2, 1, "assistant", "b" * 2_000_000 + ".")], "conv_id int, turn int, role string, text string")
    out = {r.conv_id: r for r in C.digested(df, C.audits(df, present=F.col("conv_id") != 1), present=F.col("conv_id") != 1).collect()}
    assert tuple(out[1])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (out[2].duplicate, out[2].gaps, out[2].audit) == (1, 0, "KDK")
    assert C.digested(df.limit(0), C.audits(df.limit(0))).count() == 0


def test_a_conversation_of_many_turns(spark):
    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    out = C.digested(df, C.audits(df)).first()
    assert out.audit == "K" * 20_000 and out.cost == 0


def test_damage_follows_the_checksum(spark):
    data = [(c, t, "assistant", "Good. Day!") for c in range(8) for t in range(12)] + [(None, None, None, None)]
    got = sorted((tuple(r) for r in C.damaged(spark.createDataFrame(data, "conv_id int, turn int, role string, text string")).collect()), key=str)
    want = []
    for c, t, role, text in data:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else text.replace(".", "").replace("!", "") if kind == 2 else text, kind != 0)
        want += [row] * (2 if kind == 3 else 1)
    assert got == sorted(want, key=str)


# hard negatives


def plain_mined(data, every, positives=5, negatives=3):
    kept = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in data if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, lab, v) in enumerate(kept):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m, other) for m, (j, other, w) in enumerate(kept) if m != n and len(w) == len(v))
        for s, j, _, _ in [x for x in scored if x[3] == lab][:positives]:
            fit = [(k, t) for t, k, _, other in scored if other != lab and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, r + 1, k, -s, -t) for r, (k, t) in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_mining_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, 8))
    data = [(i, [float(np.float32(x)) for x in base[i % 6] + rng.normal(size=8) * 0.3], int(rng.integers(0, 4))) for i in range(300)]
    data += [(300 + i, data[0][1], data[0][2]) for i in range(40)] + [(400 + i, data[5][1], 9) for i in range(40)]  # copies, so ties
    data += [(500, None, 1), (501, [1.0, None] * 4, 1), (502, [float("nan")] * 8, 1), (503, [float("inf")] * 8, 1), (504, data[1][1], None), (None, data[2][1], 1), (505, [0.0] * 8, 2), (600, [1.0, 2.0], 1), (602, [1.0, 1.5], 1), (603, [1.0, 1.0], 2), (610, [], 1), (611, [], 1)]
    df = spark.createDataFrame(data, "vec_id int, embedding array<float>, label int").withColumn("slot", F.lit(1)).withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in H.mined(df, F.col("vec_id") % 10 == 0, tree_rows=64, leaf=8).collect())
    assert got == plain_mined(data, 10) and len(got) > 300


def test_repeated_ids_are_rows_of_their_own(spark):
    data = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (3, [0.75, 0.0], 2)]
    got = sorted(tuple(r) for r in H.mined(spark.createDataFrame(data, "vec_id int, embedding array<float>, label int"), F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 0, 1, 3, 65536, 49152)] * 2


def test_mining_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id int, embedding array<float>, label int")
    assert H.mined(empty, F.col("vec_id") % 50 == 0).count() == 0


def test_blocks_of_slots_change_nothing_and_trees_prune(spark):
    rng = np.random.default_rng(7)
    data = [(i, [float(np.float32(x)) for x in np.eye(4)[i % 4] * 3 + rng.normal(size=4) * 0.05], i % 4) for i in range(2000)]
    ints = np.floor(256 * np.array([v for _, v, _ in data])).astype(np.int64)
    label = np.array([x for _, _, x in data])
    order, nodes = H.grown(ints.astype(float), label, 32)
    tree = nodes | {"id": order, "row_no": order, "label": label[order], "v": ints[order].ravel(), "centre": nodes["centre"].ravel()}
    q = {"slot": np.arange(50), "row_no": np.arange(50), "label": label[:50], "same": np.ones(50, bool), "lo": np.full(50, H.LOW), "hi": np.full(50, H.HIGH), "v": ints[:50]}
    best = H.Best(50, 5)
    scored, pairs = H.look(tree, q, best)
    assert scored < pairs / 2 and len(best.slot) == 250
    df = spark.createDataFrame(data, "vec_id int, embedding array<float>, label int")
    rows_ = H.written(df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vec_id").cast("bigint").alias("row_no"), "label", F.transform("embedding", lambda e: F.floor(e * 256).cast("int")).alias("v")), "v")
    slots = rows_.where("vec_id < 50").select(F.col("vec_id").alias("slot"), "row_no", "label", F.lit(True).alias("same"), F.lit(H.LOW).cast("bigint").alias("lo"), F.lit(H.HIGH).cast("bigint").alias("hi"), "v")
    got = H.nearest(H.trees(rows_, 256, 16), slots, 5, block_numbers=20, pass_blocks=3)
    assert sorted((r.slot, r.id, r.score) for r in got.collect()) == sorted(zip(best.slot.tolist(), best.id.tolist(), best.score.tolist(), strict=True))
