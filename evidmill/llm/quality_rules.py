"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document; the ledger keeps the measurements
and one bit per failed rule.  A policy is a mask over those bits, so a new
version, or a study of what each rule does, never reads the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidmill.llm.common import table, words

#: (name, condition of failure over the measurements), the bit being the place in the list.  New rules go to the end.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("shouting", "2 * n_upper_words > n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Masks by version; a version is never changed, only followed by another.
POLICIES: dict[str, int] = {
    "base": BIT["few_words"] | BIT["repeated_windows"],
    "v1": BIT["few_words"] | BIT["repeated_windows"] | BIT["symbols"] | BIT["repeated_lines"],
    "v2": sum(BIT.values()),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper_words", "n_repeat_words"]


def _repeat_words(df: DataFrame) -> DataFrame:
    """From __w, adds n_repeat_words: words in 3-word windows that the text has twice or more.

    Windows are compared by a 64-bit hash of their words.  Only texts in which
    some hash repeats pay for a sort of (hash, place).
    """
    w, h, s, p = (F.col(f"__{c}") for c in "whsp")
    empty = F.array().cast("array<bigint>")
    df = df.withColumn("__h", F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(empty))
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct(h)) < F.size(h), pairs))
    same = lambda x, other: F.coalesce(F.get(s, other)["h"] == x["h"], F.lit(False))
    again = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
    df = df.withColumn("__p", F.when(s.isNotNull(), F.sort_array(F.transform(again, lambda x: x["p"]))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("e"))
    covered = F.aggregate(p, start, lambda a, x: F.struct((a["n"] + x + 3 - F.greatest(x, a["e"])).alias("n"), (x + 3).alias("e")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__h", "__s", "__p")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns MEASURES; a null text has no words, an existing column of such a name is replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    drop = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    df = docs.withColumn("__w", words(F.col(text))).withColumn("__l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w = F.col("__w")
    out = {
        "n_words": F.size(w),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")),
        "n_symbols": drop("#*$%&|<>"),
        "n_lines": F.size("__l"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_upper_words": F.size(F.filter(w, lambda x: x.rlike("[A-Z][^a-z]*[A-Z]") & ~x.rlike("[a-z]"))),
    }
    df = df.withColumns({k: v.cast("long") for k, v in out.items()})
    return _repeat_words(df).drop("__w", "__l")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements and fail_bits (long; bit k set if RULES[k] fails) to every row."""
    bits = F.lit(0).cast("long")
    for k, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    df = measured(docs, text)
    # a generator keeps a policy's filter above it; pushed down, the filter would repeat every measurement's expression many times over
    return df.select(*[c for c in df.columns if c != "fail_bits"], F.explode(F.array(bits)).alias("fail_bits"))


def passes(version: str) -> Column:
    """Verdict of a policy over a ledger's fail_bits."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0


def ablations(book: DataFrame, version: str) -> DataFrame:
    """What each rule of a policy does: rule, n_failed, n_only (documents that no other rule rejects), n_kept_without.

    One pass of bitwise aggregation over the ledger; no rows give no counts but 0.
    """
    mask = POLICIES[version]
    got = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    names = [(n, BIT[n]) for n, _ in RULES if BIT[n] & mask]
    aggs = [F.count_if(got.bitwiseAND(F.lit(b).cast("long")) != 0).alias(f"f{b}") for _, b in names] + [F.count_if(got == b).alias(f"o{b}") for _, b in names]
    one = book.agg(F.count_if(got == 0).alias("kept"), *aggs)
    row = lambda n, b: F.struct(F.lit(n).alias("rule"), F.col(f"f{b}").alias("n_failed"), F.col(f"o{b}").alias("n_only"), (F.col("kept") + F.col(f"o{b}")).alias("n_kept_without"))
    return one.select(F.explode(F.array(*[row(n, b) for n, b in names])).alias("r")).select("r.*")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base"]).cast("long")) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes("v2").alias("kept"), "fail_bits")


OP2_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
p AS (SELECT DISTINCT doc_id, i + k AS pos FROM g JOIN d USING (doc_id, g) CROSS JOIN (VALUES (0), (1), (2)) AS v(k)),
r AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(len(list_filter(w, lambda x: regexp_matches(x, '[A-Z][^a-z]*[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS BIGINT) AS n_upper_words,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST(""" + " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, (_, c) in enumerate(RULES)) + f""" AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {POLICIES["base"]}) <> 0 AS base_failed,
       (fail_bits & {POLICIES["v2"]}) = 0 AS kept, fail_bits FROM f
"""
