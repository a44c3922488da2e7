"""Evaluation against judgements of (query, document) pairs, under several label views.

A judgement table has view, query_id, id and grade.  A pair without a row is
unjudged, one with a null grade unsure: neither counts as irrelevant.  The scope
of a query is the pairs judged for it in a view; it is complete if none of them
is unsure.  A rate over nothing is null and says why.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGITS = 6


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def discounts(n: Column, k: int) -> Column:
    """Sum of 1 / log2(rank + 1) over the first n ranks, at most k."""
    sums = [0.0]
    for i in range(1, k + 1):
        sums.append(sums[-1] + 1 / math.log2(i + 1))
    return F.element_at(F.array(*map(F.lit, sums)), F.least(n, F.lit(k)).cast("int") + 1)


def scopes(grades: DataFrame, keys: list[str], ks: tuple[int, ...], rules: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Per key: pairs, unsure, supply of each rule, ideal gain and ideal binary gain of each rule at each k.

    Works on counts by grade: no query's judgements are sorted or brought
    together, however many it has.
    """
    n = grades.groupBy(*keys, "grade").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy(F.col("grade").desc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("before", before)
    known = F.col("grade").isNotNull()
    ideal = [F.coalesce(F.sum(F.when(known, (F.pow(F.lit(2.0), "grade") - 1) * (discounts(F.col("before") + F.col("n"), k) - discounts(F.col("before"), k)))), F.lit(0.0)).alias(f"idcg_{k}") for k in ks]
    supply = [F.coalesce(F.sum(F.when(F.col("grade") >= r, F.col("n"))), F.lit(0)).alias(f"supply_{r}") for r in rules]
    return n.groupBy(*keys).agg(F.sum("n").alias("pairs"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unsure_pairs"), *supply, *ideal)


def views_of(grades: DataFrame, most: int = 100) -> DataFrame:
    """The label views: a dimension of at most ``most`` rows, as it is broadcast."""
    views = grades.select("view").distinct()
    if len(found := views.limit(most + 1).collect()) > most:
        raise ValueError(f"more than {most} label views")
    return grades.sparkSession.createDataFrame(found, views.schema).coalesce(1)


def _r(c: Column) -> Column:
    return F.round(c, DIGITS)


def _rate(n: Column, of: Column, ok: Column) -> Column:
    return _r(F.when(ok, F.try_divide(n, of)))


def metrics(runs: DataFrame, cases: DataFrame, grades: DataFrame, ks: tuple[int, ...] = (3, 5, 10), strict: int = 2) -> DataFrame:
    """One row per view, ranker, query and k, also for rankings that returned nothing.

    ``runs`` has ranker, query_id, id and rank (all ranks from 1; candidates, of
    which the first k are returned), ``cases`` ranker, query_id and topic_id.
    precision_at_k is 0 of an empty return and null if any returned pair has no
    grade; its bounds take those as irrelevant and as relevant.  nDCG and recall
    need a complete scope with something to find.  Binary (strict) values count
    grades from ``strict`` on.  candidate_recall is over the whole ranking.
    """
    views = views_of(grades)
    sc = scopes(grades, ["view", "query_id"], ks, (1, strict))
    rows = runs.crossJoin(F.broadcast(views)).join(grades.withColumn("judgement", F.lit(True)), ["view", "query_id", "id"], "left")
    g, rank, pos, top = F.col("grade"), F.col("rank"), F.col("grade") >= 1, F.col("grade") >= strict
    parts = [F.count_if(pos).alias("candidate_hits")]
    for k in ks:
        i = rank <= k
        parts += [
            F.count_if(i).alias(f"returned_{k}"),
            F.count_if(i & g.isNotNull()).alias(f"judged_{k}"),
            F.count_if(i & g.isNull() & F.col("judgement").isNotNull()).alias(f"unsure_{k}"),
            F.count_if(i & pos).alias(f"relevant_{k}"),
            F.count_if(i & top).alias(f"strict_{k}"),
            F.coalesce(F.sum(F.when(i, gain(g, rank))), F.lit(0.0)).alias(f"dcg_{k}"),
            F.coalesce(F.sum(F.when(i & top, 1 / F.log2(rank + 1))), F.lit(0.0)).alias(f"sdcg_{k}"),
        ]
    agg = rows.groupBy("view", "ranker", "query_id").agg(*parts)
    full = cases.crossJoin(F.broadcast(views)).join(agg, ["view", "ranker", "query_id"], "left").join(sc, ["view", "query_id"], "left")
    names = ["returned", "judged", "unsure", "relevant", "strict", "dcg", "sdcg"]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.coalesce(f"{n}_{k}", F.lit(0.0 if n.endswith("dcg") else 0)).alias(n) for n in names], F.coalesce(f"idcg_{k}", F.lit(0.0)).alias("idcg"), discounts(F.coalesce(f"supply_{strict}", F.lit(0)), k).alias("sidcg")) for k in ks]))
    supply, strict_supply = F.coalesce("supply_1", F.lit(0)).alias("supply"), F.coalesce(f"supply_{strict}", F.lit(0)).alias("strict_supply")
    x = full.select("view", "ranker", "query_id", "topic_id", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("unsure_pairs", F.lit(0)).alias("open"), supply, strict_supply, F.coalesce("candidate_hits", F.lit(0)).alias("hits"), each.alias("e"))
    x = x.select("*", "e.*").drop("e")
    unknown, k = F.col("returned") - F.col("judged"), F.col("k")
    complete = (F.col("pairs") > 0) & (F.col("open") == 0)
    why = lambda ok, none: F.when(~complete, "incomplete_scope").when(~ok, none)
    some, much = F.col("supply") > 0, F.col("strict_supply") > 0
    return x.select(
        "view", "ranker", "query_id", "topic_id", "k", "returned", (k - F.col("returned")).alias("shortfall"), (F.col("returned") == 0).alias("empty"), "judged",
        (unknown - F.col("unsure")).alias("unjudged"), "unsure", "supply",
        _r(F.when(F.col("returned") == 0, 0.0).when(unknown == 0, F.col("relevant") / k)).alias("precision_at_k"),
        _r(F.col("relevant") / k).alias("precision_lower"),
        _r((F.col("relevant") + unknown) / k).alias("precision_upper"),
        _rate(F.col("relevant"), F.col("judged"), F.lit(True)).alias("precision_judged"),
        _r(F.col("dcg")).alias("dcg"),
        _rate(F.col("dcg"), F.col("idcg"), complete & (F.col("idcg") > 0)).alias("ndcg"),
        why(F.col("idcg") > 0, "no_relevant_supply").alias("ndcg_null_reason"),
        _rate(F.col("relevant"), F.col("supply"), complete & some).alias("recall"),
        why(some, "no_relevant_supply").alias("recall_null_reason"),
        _rate(F.col("strict"), k, unknown == 0).alias("strict_precision"),
        _rate(F.col("sdcg"), F.col("sidcg"), complete & much).alias("strict_ndcg"),
        _rate(F.col("strict"), F.col("strict_supply"), complete & much).alias("strict_recall"),
        why(much, "no_strict_supply").alias("strict_null_reason"),
        _rate(F.col("hits"), F.col("supply"), complete & some).alias("candidate_recall"),
    )


MEANS = ["precision_at_k", "ndcg", "recall", "strict_precision", "strict_ndcg", "candidate_recall"]


def summary(rows: DataFrame) -> DataFrame:
    """Means of metrics() by view, topic, ranker and k, and over all topics, with counts of queries, empty returns and null nDCG (grouping sets)."""
    means = ", ".join(f"round(avg({m}), 9) AS mean_{m}" for m in MEANS)
    return rows.sparkSession.sql(
        f"""SELECT view, if(grouping(topic_id) = 1, 'all', topic_id) AS topic_id, ranker, k, count(*) AS n_queries, {means}, round(avg(if(empty, 1, 0)), 9) AS empty_rate,
        count_if(ndcg IS NULL) AS null_ndcg, count_if(precision_at_k IS NULL) AS null_precision FROM {{rows}} GROUP BY GROUPING SETS ((view, topic_id, ranker, k), (view, ranker, k))""",
        rows=rows,
    )


def outcomes(rows: DataFrame, base: str, k: int = 5, tolerance: float = 1e-12) -> DataFrame:
    """Per view, query and other ranker: differences of nDCG and precision at k from the base, and win, loss or tie; null where either is unknown."""
    at = rows.where(F.col("k") == k)
    b = at.where(F.col("ranker") == base).select("view", "query_id", F.col("ndcg").alias("bn"), F.col("precision_at_k").alias("bp"))
    d = F.col("ndcg") - F.col("bn")
    j = at.where(F.col("ranker") != base).join(b, ["view", "query_id"], "left")
    return j.select("view", "query_id", "topic_id", "ranker", _r(d).alias("ndcg_difference"), _r(F.col("precision_at_k") - F.col("bp")).alias("precision_difference"), F.when(d > tolerance, "win").when(d < -tolerance, "loss").when(d.isNotNull(), "tie").alias("outcome"))


def candidate_recall(runs: DataFrame, corpus: DataFrame, cases: DataFrame, grades: DataFrame, ks: tuple[int, ...] = (10, 20), rules: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Per view, ranker, query, k and grade rule: relevant_total, retrieved, recall, status, unjudged.

    ``runs`` needs the first max(ks) ranks.  k "all" is the whole ranking, which
    holds every document of ``corpus`` (id): a relevant pair whose document is not there
    is not retrieved.
    """
    views = views_of(grades)
    held = grades.join(corpus.select("id").distinct(), "id", "left_semi")
    at_all = held.groupBy("view", "query_id").agg(*[F.count_if(F.col("grade") >= g).alias(f"all_{g}") for g in rules])
    sc = scopes(grades, ["view", "query_id"], (1,), rules)
    j = runs.join(grades, ["query_id", "id"]).groupBy("view", "ranker", "query_id").agg(*[F.count_if((F.col("rank") <= k) & (F.col("grade") >= g)).alias(f"f{k}_{g}") for k in ks for g in rules])
    full = cases.crossJoin(F.broadcast(views)).join(j, ["view", "ranker", "query_id"], "left").join(sc, ["view", "query_id"], "left").join(at_all, ["view", "query_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    row = lambda k, g, c: F.struct(F.lit(str(k)).alias("k"), F.lit(g).alias("grade_rule"), zero(f"supply_{g}").alias("relevant_total"), zero(c).alias("retrieved"))
    cols = [row(k, g, f"f{k}_{g}") for k in ks for g in rules] + [row("all", g, f"all_{g}") for g in rules]
    complete = (F.coalesce("pairs", F.lit(0)) > 0) & (zero("unsure_pairs") == 0)
    x = full.select("view", "ranker", "query_id", complete.alias("complete"), zero("unsure_pairs").alias("unsure"), F.explode(F.array(*cols)).alias("r")).select("*", "r.*").drop("r")
    some = F.col("relevant_total") > 0
    return x.select("view", "ranker", "query_id", "k", "grade_rule", "relevant_total", "retrieved", _rate(F.col("retrieved"), F.col("relevant_total"), F.col("complete") & some).alias("recall"), F.when(~F.col("complete"), "partial").when(some, "complete").otherwise("no_relevant_supply").alias("status"), "unsure")


def stage_losses(trace: DataFrame, grades: DataFrame, stages: list[str], keys: tuple[str, ...] = ("query_id", "ranker")) -> DataFrame:
    """Per view, query, ranker and stage: entered, retained and lost, those known to be relevant, conditional loss, cumulative retention.

    ``trace`` has the keys, id and reason: the stage that drops a document first,
    null if it is returned.  Raises if a reason is none of the stages: losses
    and returns then would not make up the documents.
    """
    odd = trace.where(F.col("reason").isNotNull() & ~F.col("reason").isin(stages)).limit(1).count()
    if odd:
        raise ValueError("losses and returns don't make up the documents: a reason is none of the stages")
    spark = trace.sparkSession
    dim = spark.createDataFrame(list(enumerate(stages)), "pos int, stage string").coalesce(1)
    views = views_of(grades)
    by = ["view", *keys]
    # documents without a judgement are counted once, not per view
    n = trace.groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    rel = trace.join(grades.where("grade >= 1"), ["query_id", "id"]).groupBy(*by, "reason").agg(F.count("*").alias("nrel"))
    rel = rel.withColumn("reason", F.coalesce("reason", F.lit("")))
    counts = n.withColumn("reason", F.coalesce("reason", F.lit(""))).crossJoin(F.broadcast(views)).join(rel, [*by, "reason"], "left").na.fill(0, ["nrel"])
    totals = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("nrel").alias("nrel"), F.sum(F.when(F.col("reason") == "", F.col("n")).otherwise(0)).alias("returned"))
    lost = counts.select(*by, F.col("reason").alias("stage"), F.col("n").alias("lost"), F.col("nrel").alias("lost_relevant"))
    full = totals.crossJoin(F.broadcast(dim)).join(lost, [*by, "stage"], "left").na.fill(0, ["lost", "lost_relevant"])
    w = W.partitionBy(*by).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    gone, gone_rel = F.sum("lost").over(w), F.sum("lost_relevant").over(w)
    x = full.withColumn("entered", F.col("n") - gone + F.col("lost")).withColumn("entered_relevant", F.col("nrel") - gone_rel + F.col("lost_relevant")).withColumn("left_relevant", F.col("nrel") - gone_rel)
    return x.select(
        *by, "stage", "entered", (F.col("entered") - F.col("lost")).alias("retained"), "lost", "entered_relevant", "lost_relevant",
        _r(F.try_divide("lost_relevant", "entered_relevant")).alias("conditional_loss"), F.when(F.col("entered_relevant") == 0, "no_entering_relevant_documents").alias("conditional_null_reason"),
        _r(F.try_divide("left_relevant", "nrel")).alias("cumulative_retention"), F.when(F.col("nrel") == 0, "no_relevant_documents").alias("cumulative_null_reason"), "returned",
    )


def rank_changes(runs: DataFrame, grades: DataFrame, base: str, k: int = 5) -> DataFrame:
    """Per view, query, other ranker and document whose rank or gain differs: both ranks, grade, change of DCG at k.

    ``runs`` has ranker, query_id, id, rank.  The changes of a query add up to
    the difference of the two DCGs; see rank_change_totals().
    """
    b = runs.where(F.col("ranker") == base).select("query_id", "id", F.col("rank").alias("base_rank"))
    others = runs.where(F.col("ranker") != base).select("ranker").distinct()
    t = runs.where(F.col("ranker") != base).select("ranker", "query_id", "id", F.col("rank").alias("new_rank"))
    j = b.crossJoin(F.broadcast(others)).join(t, ["ranker", "query_id", "id"], "full").where(~F.col("base_rank").eqNullSafe(F.col("new_rank")))
    j = j.crossJoin(F.broadcast(views_of(grades))).join(grades, ["view", "query_id", "id"], "left")
    at = lambda c: F.coalesce(F.when(F.col(c) <= k, gain(F.col("grade"), F.col(c))), F.lit(0.0))
    return j.select("view", "ranker", "query_id", "id", "base_rank", "new_rank", "grade", _r(at("new_rank") - at("base_rank")).alias("dcg_delta"))


def rank_change_totals(changes: DataFrame, rows: DataFrame, base: str, k: int = 5, tops: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Per view, query and other ranker: documents that entered and left each top, summed change of DCG, and whether it equals the difference in metrics()."""
    into = [F.count_if((F.col("new_rank") <= n) & ~F.coalesce(F.col("base_rank") <= n, F.lit(False))).alias(f"entered_top{n}") for n in tops]
    out = [F.count_if((F.col("base_rank") <= n) & ~F.coalesce(F.col("new_rank") <= n, F.lit(False))).alias(f"exited_top{n}") for n in tops]
    total = changes.groupBy("view", "ranker", "query_id").agg(*into, *out, F.sum("dcg_delta").alias("total"))
    at = rows.where(F.col("k") == k)
    b = at.where(F.col("ranker") == base).select("view", "query_id", F.col("dcg").alias("b"))
    j = at.where(F.col("ranker") != base).select("view", "ranker", "query_id", "dcg").join(b, ["view", "query_id"]).join(total, ["view", "ranker", "query_id"], "left")
    names = [f"{w}_top{n}" for n in tops for w in ("entered", "exited")]
    j = j.na.fill(0, [*names, "total"])
    return j.select("view", "ranker", "query_id", *names, F.round("total", 4).alias("dcg_difference"), (F.abs(F.col("total") - (F.col("dcg") - F.col("b"))) < 1e-4).alias("conserved"))


def selection(runs: DataFrame, cases: DataFrame, families: DataFrame, grades: DataFrame, k: int = 3) -> DataFrame:
    """Per view, ranker and query: families found among the first k over min(k, relevant families) and over all of them, in the ranking too, precision over graded rows, counts by status, equal-family pairs.

    A family is relevant to a query if one of its documents is (grade 1 or more).
    """
    views = views_of(grades)
    gold = grades.where("grade >= 1").join(families, "id").groupBy("view", "query_id").agg(F.count_distinct("family").alias("gold"))
    j = runs.join(families, "id", "left").crossJoin(F.broadcast(views)).join(grades.withColumn("judgement", F.lit(True)), ["view", "query_id", "id"], "left")
    sel, pos, g = F.col("rank") <= k, F.col("grade") >= 1, F.col("grade")
    per_family = j.groupBy("view", "ranker", "query_id", "family").agg(
        F.count_if(sel).alias("m"), F.count_if(sel & pos).alias("pos"), F.count_if(pos).alias("cand"), F.count_if(sel & g.isNotNull()).alias("num"), F.count_if(sel & g.isNull() & F.col("judgement").isNotNull()).alias("unsure"), F.count_if(sel & F.col("judgement").isNull()).alias("unjudged")
    )
    fam = F.col("family").isNotNull()
    per = per_family.groupBy("view", "ranker", "query_id").agg(
        F.count_if((F.col("pos") > 0) & fam).alias("found"), F.count_if((F.col("cand") > 0) & fam).alias("candidates"), *[F.sum(c).alias(c) for c in ("m", "pos", "num", "unsure", "unjudged")], F.sum(F.when(fam, F.col("m") * (F.col("m") - 1) / 2).otherwise(0.0)).alias("twins")
    )
    x = cases.crossJoin(F.broadcast(views)).join(per, ["view", "ranker", "query_id"], "left").join(gold, ["view", "query_id"], "left").na.fill(0)
    n, pairs = F.col("gold"), F.col("m") * (F.col("m") - 1) / 2
    return x.select(
        "view", "ranker", "query_id", n.alias("gold_families"), _r(F.try_divide(F.col("found"), F.least(F.lit(k), n))).alias("capacity_coverage"), _r(F.try_divide(F.col("found"), n)).alias("family_recall"),
        _r(F.try_divide(F.col("candidates"), n)).alias("candidate_family_recall"), _r(F.try_divide(F.col("pos"), F.col("num"))).alias("document_precision"), "unjudged", "unsure", F.col("m").alias("selected"), (F.col("m") == 0).alias("empty"),
        ((F.col("m") > 0) & (F.col("num") == F.col("m")) & (F.col("pos") == 0)).alias("all_irrelevant"), _r(F.coalesce(F.try_divide(F.col("twins"), pairs), F.lit(0.0))).alias("duplicate_pair_ratio"),
    )
