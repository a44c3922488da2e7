"""Import of outside reviews: whole batches that keep every rule, appended once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Rules in the order in which a row is held against them.
FAULTS = ["duplicate_identity", "unknown_identity", "wrong_rubric_or_mock", "invalid_access_status", "missing_score", "invalid_score", "score_outside", "missing_reason", "foreign_evidence"]
KEY = ["review_id", "reviewer_id"]


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def faults(submitted: DataFrame, items: DataFrame, reviewers: DataFrame, requested: DataFrame, existing: DataFrame, rubric: str, dimensions: list[str]) -> DataFrame:
    """The submitted rows with fault: the first rule that a row breaks, null if none.

    ``submitted`` has line (its place), review_id, reviewer_id, rubric_version,
    is_mock, evidence_access_status, references_valid and, per dimension, _score,
    _reason and _evidence_id, all as read.  Known are review_id and reference_ids of
    ``items``, reviewer_id of ``reviewers``, the pairs ``requested`` and those ``existing``.
    Of rows with one pair the first by line (then by rubric) is not a duplicate.
    A missing score needs the status unassessable; a score is a whole number from 1 to 5 and
    needs a reason; evidence, if any, has to be among the item's references.
    """
    nth = F.row_number().over(W.partitionBy(*KEY).orderBy("line", "rubric_version"))
    x = submitted.withColumn("__nth", nth)
    x = x.join(existing.select(*KEY).distinct().withColumn("__old", F.lit(True)), KEY, "left")
    x = x.join(requested.select(*KEY).distinct().withColumn("__asked", F.lit(True)), KEY, "left")
    x = x.join(items.select("review_id", F.col("reference_ids").alias("__refs"), F.lit(True).alias("__item")).dropDuplicates(["review_id"]), "review_id", "left")
    x = x.join(reviewers.select("reviewer_id").distinct().withColumn("__who", F.lit(True)), "reviewer_id", "left")
    has = lambda c: F.col(c).isNotNull()
    access = _text("evidence_access_status")
    why = F.when(has("__old") | (F.col("__nth") > 1), FAULTS[0])
    why = why.when((_text("review_id") == "") | (_text("reviewer_id") == "") | ~(has("__item") & has("__who") & has("__asked")), FAULTS[1])
    why = why.when((_text("rubric_version") != rubric) | (F.lower(_text("is_mock")) == "true"), FAULTS[2])
    why = why.when(~access.isin("available", "unassessable") | ~F.lower(_text("references_valid")).isin("true", "false"), FAULTS[3])
    for d in dimensions:
        raw, cited = _text(f"{d}_score"), _text(f"{d}_evidence_id")
        there = raw != ""
        why = why.when(~there & (access != "unassessable"), FAULTS[4])
        why = why.when(there & ~raw.rlike(r"^[+-]?[0-9]+$"), FAULTS[5])
        why = why.when(there & ~raw.rlike(r"^\+?0*[1-5]$"), FAULTS[6])
        why = why.when(there & (_text(f"{d}_reason") == ""), FAULTS[7])
        why = why.when(there & (cited != "") & ~F.coalesce(F.array_contains("__refs", cited), F.lit(False)), FAULTS[8])
    return x.select(*submitted.columns, why.alias("fault"))


def normalised(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Rows without faults, scores as ints (null where missing)."""
    scores = {f"{d}_score": F.when(_text(f"{d}_score") != "", _text(f"{d}_score").try_cast("int")) for d in dimensions}
    return rows.where("fault is null").drop("fault").withColumns(scores)


def lifecycle(requested: DataFrame, imported: DataFrame) -> DataFrame:
    """One row: requested, imported, remaining and status."""
    r, i = requested.select(*KEY).distinct(), imported.select(*KEY).distinct()
    n = r.join(i.withColumn("__in", F.lit(True)), KEY, "left").agg(F.count("*").alias("requested"), F.count("__in").alias("imported"))
    left = F.col("requested") - F.col("imported")
    return n.select("requested", "imported", left.alias("remaining"), F.when(F.col("imported") == 0, "awaiting_reviews").when(left == 0, "reviews_imported_complete").otherwise("reviews_partially_imported").alias("status"))


class ReviewStore:
    """Reviews imported so far, a folder per batch below ``path``.

    A batch with any faulty row is refused whole: only its faults are kept.  A
    batch is written to the folder of its id, replacing what is there, and not
    held against itself: doing it again, as after a failure, changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, items: DataFrame, reviewers: DataFrame, requested: DataFrame, rubric: str, dimensions: list[str]) -> None:
        self.spark, self.path, self.rules = spark, path.rstrip("/"), (items, reviewers, requested)
        self.rubric, self.dimensions = rubric, dimensions

    def _read(self, part: str, like: DataFrame) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], like.schema).withColumn("batch", F.lit(None).cast("bigint"))
        return self.spark.read.schema(like.withColumn("batch", F.lit(0).cast("bigint")).schema).parquet(f"{self.path}/{part}")

    def reviews(self, like: DataFrame) -> DataFrame:
        """All imported rows with their batch; ``like`` has the columns of submissions."""
        return self._read("reviews", normalised(like.withColumn("fault", F.lit(None).cast("string")), self.dimensions))

    def add(self, submitted: DataFrame, batch: int) -> bool:
        """Whether the batch was imported; an empty one isn't."""
        items, reviewers, requested = self.rules
        before = self.reviews(submitted).where(F.col("batch") != batch)
        checked = faults(submitted, items, reviewers, requested, before, self.rubric, self.dimensions).persist()
        try:
            rows, bad = checked.agg(F.count("*"), F.count("fault")).first()
            if bad:
                checked.where("fault is not null").write.mode("overwrite").parquet(f"{self.path}/refused/batch={batch}")
            elif rows:
                normalised(checked, self.dimensions).write.mode("overwrite").parquet(f"{self.path}/reviews/batch={batch}")
            return bool(rows) and not bad
        finally:
            checked.unpersist()

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """The same for each micro-batch of a stream, by its id; a replayed one adds nothing."""
        return stream.writeStream.foreachBatch(lambda df, batch: self.add(df, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
