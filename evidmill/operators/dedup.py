"""Duplicate pairs, components and import aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidmill.functions import text as T
from evidmill.operators.graph import connected_components, written
from evidmill.operators.retrieval import content
from evidmill.operators.similar import similar_sets, tokens_key


def distinct_texts(papers: DataFrame) -> DataFrame:
    """id (smallest), n, w: one row per token set of title and abstract, with its tokens sorted."""
    w = F.sort_array(T.token_set(content()))
    return papers.select("id", w.alias("w")).groupBy("w").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def duplicate_components(papers: DataFrame, threshold: float = 0.82) -> DataFrame:
    """id, component: papers linked by equal texts or token sets of Jaccard ``threshold`` or more, transitively."""
    base = written(papers.select("id", F.sort_array(T.token_set(content())).alias("w")).withColumn("key", tokens_key(F.col("w"))), "papers")
    roots = connected_components(similar_sets(base.groupBy("w").agg(F.min("id").alias("id")), threshold))
    named = base.groupBy("key").agg(F.min("id").alias("first")).join(roots.withColumnRenamed("node", "first"), "first", "left").select("key", F.coalesce("root", "first").alias("component"))
    return base.select("id", "key").join(named, "key").select("id", "component")


def exact_clusters(papers: DataFrame) -> DataFrame:
    """cluster_id (smallest id), size, of papers with one normalised text."""
    return papers.groupBy(F.md5(T.normalized(content())).alias("key")).agg(F.min("id").alias("cluster_id"), F.count("*").alias("size")).select("cluster_id", "size")


def import_aliases(papers: DataFrame) -> DataFrame:
    """id, canonical_id of every paper that repeats an earlier one's normalised text."""
    first = F.min("id").over(W.partitionBy(F.md5(T.normalized(content()))))
    return papers.withColumn("canonical_id", first).where("id <> canonical_id").select("id", "canonical_id")


def pair_quality(papers: DataFrame, threshold: float = 0.97) -> DataFrame:
    """tp, fp, fn, precision, recall of predicted duplicate pairs against families of one normalised text.

    Pairs within a set or family are counted by its size, not emitted.
    """
    base = papers.select("id", F.sort_array(T.token_set(content())).alias("w"), F.md5(T.normalized(content())).alias("family"))
    base = written(base.withColumn("key", tokens_key(F.col("w"))), "papers")
    pairs = lambda n: n * (n - 1) / 2
    parts = base.groupBy("key", "family").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    by_set = parts.groupBy("key").agg(F.sum("n").alias("n"), F.min("id").alias("id"), F.sum(pairs(F.col("n"))).alias("same"))
    by_set = written(by_set, "sets")
    cross = similar_sets(base.groupBy("w").agg(F.min("id").alias("id")), threshold).select("a", "b")
    of = lambda c: by_set.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"))
    across = cross.join(of("a"), "a").join(of("b"), "b").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("x"))
    # texts of one family have one token set but for underscores, at which normalising splits; so few families lie in several sets
    held = parts.join(by_set.select("key", F.col("id").alias("set")), "key").select("family", "set", "n")
    split = held.join(held.groupBy("family").agg(F.count("*").alias("sets")).where("sets > 1").select("family"), "family", "left_semi")
    one_side = lambda c: split.select("family", F.col("set").alias(c), F.col("n").alias(f"n{c}"))
    met = cross.join(one_side("a"), "a").join(one_side("b"), ["family", "b"]).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("m"))
    inside = by_set.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("p"), F.coalesce(F.sum("same"), F.lit(0.0)).alias("s"))
    true = base.groupBy("family").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("t"))
    one = inside.crossJoin(across).crossJoin(met).crossJoin(true)
    tp, predicted = F.col("s") + F.col("m"), F.col("p") + F.col("x")
    return one.select(tp.cast("long").alias("tp"), (predicted - tp).cast("long").alias("fp"), (F.col("t") - tp).cast("long").alias("fn"), F.round(F.try_divide(tp, predicted), 6).alias("precision"), F.try_divide(tp.cast("double"), F.col("t").cast("double")).alias("recall"))
