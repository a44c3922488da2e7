"""Evaluation of rankings against graded, partly missing judgements.

Throughout, a missing grade is unknown, not 0; a rate over nothing is null.
Judgements have id and grade, and whatever else they are keyed by: with
query_id (or topic_id) a grade holds for that query alone, without for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidmill.operators.judged import gain, scopes


def keys_of(grades: DataFrame) -> list[str]:
    """What judgements are keyed by besides the document."""
    return [c for c in grades.columns if c not in ("id", "grade")]


def _with(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of judgements beside each row: those of its key, or the one row over all."""
    return df.join(totals, keys, "left") if keys else df.crossJoin(F.broadcast(totals))


def ranked_metrics(run: DataFrame, grades: DataFrame, k: int, by: str = "query_id", strict: int = 1) -> DataFrame:
    """Per group: returned, judged, unjudged, precision_at_k with bounds, precision_judged, dcg, ndcg, recall, null reasons.

    ``run`` has the group, rank and id; judgements are by id or by query_id and id.  The scope of a
    group is its whole run; nDCG and recall are null unless all of it is judged,
    and compare with all judgements of the query, in the run or not.  ``by`` must
    hold what judgements are keyed by.
    ``strict`` is the grade from which a document is relevant.
    """
    keys = keys_of(grades)
    j = run.join(grades, [*keys, "id"], "left")
    best = scopes(grades, keys, (k,), (strict,)).select(*keys, F.col(f"idcg_{k}").alias("idcg"), F.col(f"supply_{strict}").alias("supply"))
    inside, rel = F.col("rank") <= k, F.col("grade") >= strict
    g = j.groupBy(by).agg(
        F.count_if(inside).alias("returned"),
        F.count_if(inside & F.col("grade").isNotNull()).alias("judged"),
        F.count_if(inside & rel).alias("relevant"),
        F.coalesce(F.sum(F.when(inside, gain(F.col("grade"), F.col("rank")))), F.lit(0.0)).alias("dcg"),
        F.count_if(F.col("grade").isNull()).alias("unknown"),
    )
    g = _with(g, best, keys).na.fill({"idcg": 0.0, "supply": 0})
    un = F.col("returned") - F.col("judged")
    complete = F.col("unknown") == 0
    r = lambda c: F.round(c, 6)
    why = lambda ok: F.when(~complete, "incomplete_scope").when(~ok, "no_relevant_supply")
    return g.select(
        by,
        "returned",
        "judged",
        un.alias("unjudged"),
        r(F.when(F.col("returned") == 0, 0.0).when(un == 0, F.col("relevant") / k)).alias("precision_at_k"),
        r(F.col("relevant") / k).alias("precision_lower"),
        r((F.col("relevant") + un) / k).alias("precision_upper"),
        r(F.try_divide(F.col("relevant"), F.col("judged"))).alias("precision_judged"),
        r(F.col("dcg")).alias("dcg"),
        r(F.when(complete & (F.col("idcg") > 0), F.col("dcg") / F.col("idcg"))).alias("ndcg"),
        why(F.col("idcg") > 0).alias("ndcg_null_reason"),
        r(F.when(complete & (F.col("supply") > 0), F.col("relevant") / F.col("supply"))).alias("recall"),
        why(F.col("supply") > 0).alias("recall_null_reason"),
    )


def selection_metrics(run: DataFrame, grades: DataFrame, families: DataFrame, k: int = 3) -> DataFrame:
    """Per query: families found over min(3, all relevant families), recall over all of them, precision over judged rows, duplicate pair ratio."""
    keys = keys_of(grades)
    j = run.join(families, "id").join(grades, [*keys, "id"], "left").withColumn("sel", F.col("rank") <= k)
    gold = grades.where("grade >= 1").join(families, "id").groupBy(*keys).agg(F.countDistinct("family").alias("gold"))
    found = F.countDistinct(F.when(F.col("sel") & (F.col("grade") >= 1), F.col("family")))
    twins = j.where("sel").groupBy("query_id", "family").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("dup"), F.sum("n").alias("m"))
    g = j.groupBy("query_id").agg(found.alias("found"), F.count_if(F.col("sel") & (F.col("grade") >= 1)).alias("pos"), F.count_if(F.col("sel") & F.col("grade").isNotNull()).alias("num"), F.count_if(F.col("sel") & F.col("grade").isNull()).alias("unjudged"))
    pairs = F.col("m") * (F.col("m") - 1) / 2
    return _with(g.join(twins, "query_id"), gold, keys).na.fill(0, ["gold"]).select(
        "query_id",
        F.round(F.try_divide(F.col("found"), F.least(F.lit(3), F.col("gold"))), 6).alias("capacity_coverage"),
        F.round(F.try_divide(F.col("found"), F.col("gold")), 6).alias("family_recall"),
        F.round(F.try_divide(F.col("pos"), F.col("num")), 6).alias("document_precision"),
        "unjudged",
        F.round(F.coalesce(F.try_divide(F.col("dup"), pairs), F.lit(0.0)), 6).alias("duplicate_pair_ratio"),
    )


def cutoffs(run: DataFrame, grades: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Mean judged precision, mean relevant and share without judgements, by topic and k and over all topics (grouping sets)."""
    spark = run.sparkSession
    dim = spark.createDataFrame([(k,) for k in ks], "k int").coalesce(1)
    per = run.crossJoin(F.broadcast(dim)).where(F.col("rank") <= F.col("k")).join(grades, [*keys_of(grades), "id"], "left").groupBy("query_id", "topic_id", "k").agg(F.count("grade").alias("judged"), F.count_if(F.col("grade") >= 1).alias("rel"))
    return spark.sql("""SELECT coalesce(topic_id, 'all') AS topic_id, k, count(*) AS n_queries, round(avg(try_divide(rel, judged)), 6) AS mean_precision,
        round(avg(rel), 6) AS mean_relevant, round(avg(if(judged = 0, 1, 0)), 6) AS unjudged_rate FROM {per} GROUP BY GROUPING SETS ((topic_id, k), (k))""", per=per)


def candidate_recall(run: DataFrame, grades: DataFrame, corpus: DataFrame | None = None, ks: tuple[int, ...] = (10, 20)) -> DataFrame:
    """query_id, k, grade_rule, recall: relevant documents within k over all judged relevant ones; k "all" is the whole ranking.

    ``run`` needs the first ``max(ks)`` ranks.  A whole ranking holds every
    document of ``corpus`` (id), those that share no token last; relevant ones that
    are not there lower it.  Without a corpus there is no "all".
    """
    rules, keys = (1, 2), keys_of(grades)
    count = lambda name: [F.count_if(F.col("grade") >= g).alias(f"{name}{g}") for g in rules]
    total = grades.groupBy(*keys).agg(*count("t"))
    j = run.join(grades, [*keys, "id"], "left")
    found = _with(j.groupBy("query_id").agg(*[F.count_if((F.col("rank") <= k) & (F.col("grade") >= g)).alias(f"f{k}_{g}") for k in ks for g in rules]), total, keys)
    row = lambda k, g, n: F.struct(F.lit(str(k)).alias("k"), F.lit(g).alias("grade_rule"), F.round(F.try_divide(n, F.col(f"t{g}")), 6).alias("recall"))
    cols = [row(k, g, F.col(f"f{k}_{g}")) for k in ks for g in rules]
    if corpus is not None:
        held = grades.join(corpus.select("id").distinct(), "id", "left_semi").groupBy(*keys).agg(*count("a"))
        found = _with(found, held, keys)
        cols += [row("all", g, F.coalesce(f"a{g}", F.lit(0))) for g in rules]
    return found.select("query_id", F.explode(F.array(*cols)).alias("r")).select("query_id", "r.*")


def exclusion(gate: Column, candidate_rank: Column, kept: Column, returned: Column) -> Column:
    """First stage that drops a document; null for returned ones."""
    return F.when(~gate, "topic_gate").when(candidate_rank.isNull(), "candidate_truncation").when(~kept, "deduplication").when(~returned, "final_topk")


STAGES = ["topic_gate", "candidate_truncation", "deduplication", "final_topk"]


def loss_by_stage(trace: DataFrame, grades: DataFrame, by: str = "topic_id") -> DataFrame:
    """Per group and stage: entered, lost, and the same of relevant documents with their conditional loss rate."""
    spark = trace.sparkSession
    dim = spark.createDataFrame(list(enumerate(STAGES)), "pos int, stage string").coalesce(1)
    j = trace.join(grades, [*keys_of(grades), "id"], "left").withColumn("rel", F.coalesce(F.col("grade") >= 1, F.lit(False)))
    lost = j.groupBy(by, F.col("reason").alias("stage")).agg(F.count("*").alias("lost"), F.count_if("rel").alias("lost_relevant"))
    total = j.groupBy(by).agg(F.count("*").alias("n"), F.count_if("rel").alias("nrel"))
    full = total.crossJoin(F.broadcast(dim)).join(lost, [by, "stage"], "left").na.fill(0, ["lost", "lost_relevant"])
    before = W.partitionBy(by).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    full = full.withColumn("entered", F.col("n") - F.coalesce(F.sum("lost").over(before), F.lit(0))).withColumn("entered_relevant", F.col("nrel") - F.coalesce(F.sum("lost_relevant").over(before), F.lit(0)))
    return full.select(by, "stage", "entered", "lost", "entered_relevant", "lost_relevant", F.round(F.try_divide(F.col("lost_relevant"), F.col("entered_relevant")), 6).alias("conditional_loss"))


def ranking_regression(base: DataFrame, other: DataFrame, grades: DataFrame, k: int = 5) -> DataFrame:
    """Per query: documents that entered and left the first k, and the change of DCG."""
    a = base.where(F.col("rank") <= k).select("query_id", "id", F.col("rank").alias("ra"))
    b = other.where(F.col("rank") <= k).select("query_id", "id", F.col("rank").alias("rb"))
    j = a.join(b, ["query_id", "id"], "full").join(grades, [*keys_of(grades), "id"], "left")
    part = lambda r: F.when(F.col(r).isNotNull(), F.coalesce(gain(F.col("grade"), F.col(r)), F.lit(0.0))).otherwise(0.0)
    return j.groupBy("query_id").agg(F.count_if(F.col("ra").isNull()).alias("entered"), F.count_if(F.col("rb").isNull()).alias("exited"), F.round(F.sum(part("rb") - part("ra")), 6).alias("delta_dcg"))


def latest_revision(log: DataFrame, key: list[str], revision: str, order: str) -> DataFrame:
    """Last revision per key; of equal revisions the first in file order."""
    w = W.partitionBy(*key).orderBy(F.desc(revision), F.asc(order))
    return log.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def label_views(pairs: DataFrame) -> DataFrame:
    """item_id, view, grade from columns r1, r2, adjudicated: each reviewer, and the agreed or adjudicated grade."""
    final = F.when(F.col("r1") == F.col("r2"), F.col("r1")).otherwise(F.col("adjudicated"))
    return pairs.withColumn("final", final).select("item_id", F.expr("stack(3, 'reviewer01', r1, 'reviewer02', r2, 'final', final) AS (view, grade)"))


def ratio_of_sums(rows: DataFrame) -> DataFrame:
    """Coverage as a ratio of sums per topic and policy, per topic, and overall (grouping sets)."""
    return rows.sparkSession.sql("""SELECT coalesce(topic_id, 'all') AS topic_id, coalesce(policy, 'all') AS policy, count(*) AS n, round(try_divide(sum(num), sum(den)), 6) AS ratio
        FROM {rows} GROUP BY GROUPING SETS ((topic_id, policy), (topic_id), ())""", rows=rows)


def calibration(scores: DataFrame, grid: DataFrame) -> DataFrame:
    """threshold, f1, n, chosen: F1 of relevance at each threshold; the best, then smallest, is chosen."""
    j = scores.crossJoin(F.broadcast(grid)).withColumn("hit", F.col("score") >= F.col("threshold"))
    g = j.groupBy("threshold").agg(F.count_if(F.col("hit") & F.col("positive")).alias("tp"), F.count_if(F.col("hit") & ~F.col("positive")).alias("fp"), F.count_if(~F.col("hit") & F.col("positive")).alias("fn"))
    g = g.withColumn("f1", F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 6))
    first = F.row_number().over(W.orderBy(F.desc("f1"), F.asc("threshold")))  # a row per grid point
    return g.withColumn("chosen", first == 1).select("threshold", "tp", "fp", "fn", "f1", "chosen")
