"""Near-duplicate operators against brute force."""

import random

import numpy as np

from evidmill.llm import embed_dedup, ngram_join


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(30, 16))
    x = np.concatenate([rng.normal(size=(150, 16)), np.repeat(centre, 5, 0) + 0.12 * rng.normal(size=(150, 16)), np.tile(rng.normal(size=(1, 16)), (150, 1)) + 0.05 * rng.normal(size=(150, 16))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] + [1.0] * 15), (504, []), (505, [1.0, 2.0]), (506, rows[0][1]), (507, [1e-200 * t for t in rows[0][1]]), (None, rows[1][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, component_id string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df, block=64).collect()), key=str)
    good = [k for k, (_, v) in enumerate(rows) if v and len(v) == 16 and all(t is not None and np.isfinite(t) for t in v) and any(v)]
    m = np.array([rows[k][1] for k in good])
    m /= np.abs(m).max(1, keepdims=True)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= 0.95
    np.fill_diagonal(link, False)
    n, pairs = [0] * len(rows), []
    for a, b in zip(*np.nonzero(link)):
        n[good[a]] += 1
        pairs.append((good[a], good[b]))
    root = components(len(rows), pairs)
    low = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            low[r] = min(low.get(r, 1 << 60), rows[k][0])
    want = sorted(((rows[k][0], n[k], low[root[k]], rows[k][0] == low[root[k]]) for k in range(len(rows))), key=str)
    same = sum(a == b for a, b in zip(got, want))
    assert len(got) == len(want) and sum(w[1] for w in want) > 10_000
    assert sum(g[1] for g in got) >= 0.999 * sum(w[1] for w in want) and same >= 0.99 * len(want)
    assert [g for g in got if g[0] in (500, 501, 502, 503, 504, 505)] == [(k, 0, k, True) for k in range(500, 506)]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_at_the_threshold_are_found(spark):
    """Pairs of cosine 0.951 in 64 dimensions, with nothing else near them: recall as the README states."""
    rng = np.random.default_rng(3)
    y, z = rng.normal(size=(2, 1500, 64))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z -= (z * y).sum(1, keepdims=True) * y
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    both = np.concatenate([y, 0.951 * y + np.sqrt(1 - 0.951**2) * z])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(both)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect()}
    assert sum(got[k + 1500] == (1, k) for k in range(1500)) >= 0.999 * 1500 and all(n <= 1 for n, _ in got.values())


def test_candidates_share_pivots_before_cosines_count():
    """Equal vectors whose descriptions share too little are no candidates; those that share enough are counted in one list alone."""
    pdf = embed_dedup.pd.DataFrame({"block": [0, 0, 0], "low": [0, 0, 0], "cls": [1, 2, 3], "n": [1, 1, 1], "vector": [[1.0, 0.0]] * 3, "pivots": [[5, 7, 8], [7, 5, 8], [5, 9, 6]]})
    found = {p: embed_dedup._pairs(pdf, p, True, 0.95, 2, 2) for p in (5, 7)}
    assert sorted(zip(found[5]["node"], found[5]["n"])) == [(1, 1), (2, 1)] and not len(found[7])


def test_pivots_stand_apart():
    p = embed_dedup.apart(np.array([[1.0, 0], [0.99, 0.14], [0, 1.0]]))
    assert p.tolist() == [[1.0, 0], [0, 1.0]]


def sets(t):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    passage = " ".join(word() for _ in range(60))
    out = [" ".join(word() for _ in range(rng.randrange(20, 120))) for _ in range(60)]
    out += [passage + " " + " ".join(word() for _ in range(rng.randrange(15, 60))) for _ in range(80)]
    for base in out[:12] + [passage + " " + passage[::-1]] * 5:
        for _ in range(8):
            w = base.split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return out + [None, "", " \n", "one two", "one two", "one  two", "one two three", "z " * 4000]


def check(spark, **how):
    t = texts()
    keys = [None if k == 4 else k for k in range(len(t))]
    df = spark.createDataFrame([(k, x, "c", 1) for k, x in zip(keys, t)], "doc_id long, text string, kept string, __x int")
    got = {r["text"]: [] for r in df.collect()}
    rows = ngram_join.jaccard_classes(df, **how).collect()
    s = [sets(x) for x in t]
    links = [(i, j) for i in range(len(t)) for j in range(i) if s[i] and s[j] and 10 * len(s[i] & s[j]) >= 8 * len(s[i] | s[j])]
    n = [0] * len(t)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    root = components(len(t), links)
    low = {}
    for k, r in enumerate(root):
        if keys[k] is not None:
            low[r] = min(low.get(r, 1 << 60), keys[k])
    want = sorted(((keys[k], n[k], low.get(root[k]), ) for k in range(len(t))), key=str)
    assert sorted(((r["doc_id"], r["n_links"], r["class_id"]) for r in rows), key=str) == want
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len(set(root)) and all(r["doc_id"] == r["class_id"] for r in kept)
    assert got is not None and len(links) > 300


def test_join_by_brute_force(spark):
    check(spark)


def test_join_with_recursion(spark):
    check(spark, bucket=8, depth=4)


def test_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_classes(df).count() == 0
    assert ngram_join.jaccard_classes(spark.createDataFrame([(1, None), (1, None)], df.schema)).where("kept").count() == 2


def test_one_large_group_of_near_copies(spark):
    """Copies that differ in their last word alone, so all link."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(base[:-1] + [f"x{rng.randrange(10**9)}-{k}"])) for k in range(4000)] + [(k, f"lone text number {k} of its own words {k}") for k in range(4000, 4100)]
    got = {r["doc_id"]: r for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k]["n_links"] == 3999 and got[k]["class_id"] == 0 and got[k]["kept"] == (k == 0) for k in range(4000))
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(4000, 4100))
