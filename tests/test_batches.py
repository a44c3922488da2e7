"""Words by Arrow batches are those of the columns of text.py."""

from pyspark.sql import functions as F

from evidmill.functions import batches
from evidmill.functions import text as T
from evidmill.operators import retrieval

PHRASES = "topic_id string, field string, phrases array<string>, concept_groups array<array<string>>, generic array<string>, sentence_only boolean"


def test_words_of_all_characters(spark):
    """Some characters beyond ASCII have lower case letters of ASCII."""
    runs = [range(a, min(a + 512, 0xD800 if a < 0xD800 else 0x110000)) for a in (*range(0, 0xD800, 512), *range(0xE000, 0x110000, 512))]
    texts = spark.createDataFrame([(" ".join(f"Aa{chr(c)}b_{chr(c)} s{chr(c)}" for c in r),) for r in runs] + [("",), (None,), ("agents Systems glass bus cats",)], "x string")
    got = texts.select(T.normalized(F.col("x")).alias("a"), batches.normalized(F.col("x")).alias("b"), F.sort_array(T.token_set(F.col("x"))).alias("set"), F.sort_array(batches.held(F.col("x"), ["aak", "b_k", "sk", "si", "aa", "glass", "b_"])).alias("held"))
    for r in got.collect():
        assert r["a"] == r["b"]
        assert r["held"] == [w for w in r["set"] if w in ("aak", "b_k", "sk", "si", "aa", "glass", "b_")]
    words = "agents systems glass bus cats s ss was as policies".split()
    one = spark.createDataFrame([(" ".join(words),)], "x string").select(T.folded_words(F.col("x")).alias("f"), T.mapped_words(F.col("x")).alias("m")).first()
    coded = [w.encode() for w in words]
    assert [w.decode() for w in batches.folded(coded)] == one["f"] and [w.decode() for w in batches.mapped(coded)] == one["m"]


def test_evidence_by_sentences_and_windows(spark):
    far = " ".join(["x"] * 20)
    papers = spark.createDataFrame(
        [("1", "f", "red fox", "none"), ("2", "f", "none", "a red fox!"), ("3", "f", "none", f"red {far} fox. red or fox"), ("4", "f", "none", f"red. a fox {far}"), ("5", "f", "none", f"red {far}. fox"), ("6", "f", "only", "Old fo"), ("7", "f", "red", None)], "id string, field string, title string, abstract string"
    )
    topics = spark.createDataFrame([("t", "f", ["red fox"], [["red", "scarlet bird"], ["fox"]], ["old"], False), ("s", "f", ["red fox"], [["red"], ["fox"]], ["old"], True), ("n", "g", [], [], [], True)], PHRASES)
    for bounded in (True, False):
        got = {(r["id"], r["topic_id"]): (r["evidence"], r["generic_only"]) for r in retrieval.evidence(papers, topics, bounded).collect()}
        assert [got[i, "t"][0] for i in "1234567"] == [1.0, 0.9, 0.8, 0.8, 0.0, 0.0, 0.0]
        assert [got[i, "s"][0] for i in "1234567"] == [1.0, 0.9, 0.8, 0.0, 0.0, 0.0, 0.0]
        assert {got[i, "n"] for i in "1234567"} == {(0.0, False)}
        assert [i for i in "1234567" if got[i, "t"][1]] == ["6"]


def test_a_text_is_split_once_for_all_topics(spark):
    """Texts met each topic in a cross join, where their words were made anew for every topic and use."""
    papers = spark.createDataFrame([("1", "f", "red fox", "none")], "id string, field string, title string, abstract string")
    topics = spark.createDataFrame([("t", "f", ["red fox"], [["red"], ["fox"]], ["old"], False, ["red"])], PHRASES + ", keywords array<string>")
    for df in (retrieval.evidence(papers, topics, True), retrieval.classified(papers, topics)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "regexp_extract_all" not in plan
        assert plan.split("Initial Plan")[0].count("ArrowEvalPython") == 1
