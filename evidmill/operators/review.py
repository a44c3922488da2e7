"""Rater agreement, quality scores, sampling and estimation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIMS = ["d0", "d1", "d2", "d3"]


def pairs(ratings: DataFrame) -> DataFrame:
    """dim, item_id, a, b: the first two scores that aren't missing of each item and dimension, in order of reviewer."""
    long = ratings.select("item_id", "stratum", "reviewer", F.expr("stack(4, " + ", ".join(f"'{d}', {d}" for d in DIMS) + ") AS (dim, score)")).where("score is not null")
    n = F.row_number().over(W.partitionBy("item_id", "dim").orderBy("reviewer"))
    p = long.withColumn("n", n).where("n <= 2").groupBy("dim", "item_id", "stratum").agg(F.max(F.when(F.col("n") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("n") == 2, F.col("score"))).alias("b"))
    return p.where("b is not null")


def agreement(p: DataFrame) -> DataFrame:
    """Per dimension: items, exact and within-one rates, quadratic and linear weighted kappa.

    Expected disagreement comes from the marginals of the 5 x 5 table, so raw
    ratings are aggregated once.  Kappa is null for constant ratings.
    """
    cells = p.groupBy("dim", "a", "b").agg(F.count("*").alias("c"))
    total = cells.groupBy("dim").agg(
        F.sum("c").alias("n"),
        F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"),
        F.sum(F.when(F.abs(F.col("a") - F.col("b")) <= 1, F.col("c")).otherwise(0)).alias("near"),
        F.sum(F.col("c") * F.pow((F.col("a") - F.col("b")) / 4, F.lit(2))).alias("oq"),
        F.sum(F.col("c") * F.abs(F.col("a") - F.col("b"))).alias("ol"),
        F.countDistinct("a").alias("da"),
        F.countDistinct("b").alias("db"),
    )
    left = cells.groupBy("dim", "a").agg(F.sum("c").alias("ca"))
    right = cells.groupBy("dim", "b").agg(F.sum("c").alias("cb"))
    expected = left.join(right, "dim").groupBy("dim").agg(F.sum(F.col("ca") * F.col("cb") * F.pow((F.col("a") - F.col("b")) / 4, F.lit(2))).alias("eq"), F.sum(F.col("ca") * F.col("cb") * F.abs(F.col("a") - F.col("b"))).alias("el"))
    kappa = lambda o, e: F.when((F.col("da") > 1) & (F.col("db") > 1), 1 - F.try_divide(F.col(o) * F.col("n"), F.col(e)))
    j = total.join(expected, "dim")
    return j.select("dim", F.col("n").alias("common_items"), F.round(F.col("same") / F.col("n"), 6).alias("exact_rate"), F.round(F.col("near") / F.col("n"), 6).alias("within_one_rate"), F.round(kappa("oq", "eq"), 6).alias("quadratic_kappa"), F.round(kappa("ol", "el"), 6).alias("linear_kappa"))


def quality_scores(p: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """item_id, stratum, quality: weighted mean over the four dimensions scaled to [0, 1]; only items with two scores in each."""
    w = weights or [0.25] * 4
    of = F.create_map(*[x for d, v in zip(DIMS, w) for x in (F.lit(d), F.lit(float(v)))])
    m = p.withColumn("part", F.element_at(of, F.col("dim")) * ((F.col("a") + F.col("b")) / 2 - 1) / 4)
    return m.groupBy("item_id", "stratum").agg(F.round(F.sum("part"), 9).alias("quality"), F.count("*").alias("dims")).where("dims = 4").drop("dims")


#: The weight schemes of the sensitivity analysis, equal first, then each dimension doubled.
SCHEMES = {"equal": [0.25] * 4} | {f"double_{d}": [0.4 if x == d else 0.2 for x in DIMS] for d in DIMS}


def scored(p: DataFrame, apart: int = 2) -> DataFrame:
    """item_id, stratum, dims, disagreements (dimensions whose scores are ``apart`` or more), and qualities: the quality under every scheme, null unless all dimensions have two scores.

    One aggregation of the pairs, a sum per scheme.
    """
    half = ((F.col("a") + F.col("b")) / 2 - 1) / 4
    sums = []
    for name, w in SCHEMES.items():
        of = F.element_at(F.create_map(*[x for d, v in zip(DIMS, w) for x in (F.lit(d), F.lit(float(v)))]), F.col("dim"))
        sums.append(F.round(F.sum(of * half), 9).alias(name))
    g = p.groupBy("item_id", "stratum").agg(F.count("*").alias("dims"), F.count_if(F.abs(F.col("a") - F.col("b")) >= apart).alias("disagreements"), *sums)
    whole = F.col("dims") == len(DIMS)
    return g.select("item_id", "stratum", "dims", "disagreements", F.array(*[F.struct(F.lit(n).alias("scheme"), F.when(whole, F.col(n)).alias("quality")) for n in SCHEMES]).alias("qualities"))


def sensitivity(p: DataFrame) -> DataFrame:
    """scheme, stratum (or 'all'), n, mean_quality under every weight scheme."""
    each = scored(p).where(F.col("dims") == len(DIMS)).select("stratum", F.explode("qualities").alias("q")).select("stratum", "q.*")
    g = each.rollup("scheme", "stratum").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.grouping("scheme").alias("g"))
    return g.where("g = 0").select("scheme", F.coalesce(F.col("stratum").cast("string"), F.lit("all")).alias("stratum"), "n", "mean_quality")


def disagreements(p: DataFrame, apart: int = 2) -> DataFrame:
    """item_id, dim, both scores and status of the pairs that a third party has to settle."""
    return p.where(F.abs(F.col("a") - F.col("b")) >= apart).select("item_id", "dim", F.col("a").alias("reviewer_1_score"), F.col("b").alias("reviewer_2_score"), F.lit("awaiting_third_party_adjudication").alias("status"))


def analysis(sample: DataFrame, p: DataFrame, conditions: list[str], kind: str = "output_type") -> DataFrame:
    """Estimated totals of quality, with bounds, under every scheme, for every condition by kind of output and over all kinds, and over all conditions.

    ``sample`` has item_id, stratum, population (of the stratum), the conditions
    and the kind, both fixed within a stratum.  A stratum's Horvitz-Thompson
    total is population / sample size times the sum; it is null if a sampled item has no
    quality, and the bounds take those as 0 and 1.  Totals of strata add up;
    one that is null makes those above it null.  Ratings are read once: an item has one
    row with all its qualities; what is carried up are strata, by grouping sets.
    """
    j = sample.join(scored(p).drop("stratum"), "item_id", "left")
    none = F.array(*[F.struct(F.lit(n).alias("scheme"), F.lit(None).cast("double").alias("quality")) for n in SCHEMES])
    j = j.select("stratum", *conditions, kind, "population", F.coalesce("disagreements", F.lit(0)).alias("disagreements"), F.explode(F.coalesce("qualities", none)).alias("q")).select("*", "q.*")
    w = F.col("population") / F.col("n")
    g = j.groupBy("scheme", "stratum", *conditions, kind).agg(F.max("population").alias("population"), F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0.0)).alias("s"), F.count_if(F.col("quality").isNull()).alias("missing"), F.sum("disagreements").alias("disagreements"))
    g = g.select("scheme", *conditions, kind, "population", "n", "missing", "disagreements", (w * F.col("s")).alias("low"), (w * (F.col("s") + F.col("missing"))).alias("high"))
    by = ", ".join(conditions)
    names = ", ".join(f"if(grouping({c}) = 1, 'all', cast({c} AS string)) AS {c}" for c in [*conditions, kind])
    return g.sparkSession.sql(
        f"""SELECT scheme, {names}, sum(population) AS population, sum(n) AS n, sum(missing) AS missing, sum(disagreements) AS disagreements, round(if(sum(missing) = 0, sum(low), NULL), 6) AS estimated_total,
        round(if(sum(missing) = 0, sum(low) / sum(population), NULL), 6) AS estimated_mean, round(sum(low), 6) AS lower_bound, round(sum(high), 6) AS upper_bound
        FROM {{g}} GROUP BY GROUPING SETS ((scheme, {by}, {kind}), (scheme, {by}), (scheme, {kind}), (scheme))""",
        g=g,
    )


def stratified_sample(items: DataFrame, n: int, seed: int, key: str = "item_id", stratum: str = "stratum") -> DataFrame:
    """The first n of each stratum in order of a keyed hash, with population, sample size and inclusion probability."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key)), 256)
    sizes = items.groupBy(stratum).agg(F.count("*").alias("population"))
    drawn = items.withColumn("__o", order).withColumn("draw", F.row_number().over(W.partitionBy(stratum).orderBy("__o", key))).where(F.col("draw") <= n)
    size = F.least(F.lit(n), F.col("population"))
    return drawn.join(F.broadcast(sizes), stratum).select(key, stratum, "draw", "population", size.alias("sample_size"), F.round(size / F.col("population"), 9).alias("inclusion_probability"))


def ht_estimates(sample: DataFrame, values: DataFrame, low: float = 0.0, high: float = 1.0, key: str = "item_id", stratum: str = "stratum") -> DataFrame:
    """Per stratum: Horvitz-Thompson total of values (null if one is missing) and bounds with missing values at both ends."""
    j = sample.join(values.select(key, "quality"), key, "left")
    g = j.groupBy(stratum).agg(F.max("population").alias("population"), F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0.0)).alias("s"), F.count_if(F.col("quality").isNull()).alias("missing"))
    w = F.col("population") / F.col("n")
    r = lambda c: F.round(c, 6)
    return g.select(stratum, "population", "n", "missing", r(F.when(F.col("missing") == 0, w * F.col("s"))).alias("estimated_total"), r(w * (F.col("s") + F.col("missing") * low)).alias("lower_bound"), r(w * (F.col("s") + F.col("missing") * high)).alias("upper_bound"))


def coverage_status(ratings: DataFrame) -> DataFrame:
    """Per stratum: items, share with two numeric ratings in the first dimension, and the lifecycle state."""
    per = ratings.groupBy("stratum", "item_id").agg(F.count("d0").alias("k"))
    g = per.groupBy("stratum").agg(F.count("*").alias("items"), F.avg((F.col("k") >= 1).cast("int")).alias("s"), F.avg((F.col("k") >= 2).cast("int")).alias("d"))
    state = F.when(F.col("d") == 1, "complete").when(F.col("s") > 0, "partial").otherwise("empty")
    return g.select("stratum", "items", F.round("s", 6).alias("submission_coverage"), F.round("d", 6).alias("double_coverage"), state.alias("state"))


def kappa_of(c: Column) -> Column:
    """Agreement band of a kappa value."""
    return F.when(c.isNull(), "undefined").when(c < 0.2, "slight").when(c < 0.4, "fair").when(c < 0.6, "moderate").when(c < 0.8, "substantial").otherwise("high")
