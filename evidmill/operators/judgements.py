"""Judgements: expansion, decisions, overlays, imports of ratings and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidmill.functions import text as T
from evidmill.operators.graph import discard, written
from evidmill.operators.retrieval import content


def expanded(qrels: DataFrame, families: DataFrame, papers: DataFrame, topics: DataFrame) -> DataFrame:
    """topic_id, id, family, old_grade, status, proposed_grade of every paper of a family judged relevant for a topic.

    ``supported`` are papers that hold all keywords of the topic, if it has more
    than one; the others are ``ambiguous`` and propose no grade.
    """
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    j = qrels.where("grade >= 1").join(families, "family").join(papers.select("id", text.alias("t")), "id").join(F.broadcast(topics.select("topic_id", "keywords")), "topic_id")
    every = (F.size("keywords") > 1) & F.forall("keywords", lambda k: F.col("t").contains(F.lower(k)))
    return j.select("topic_id", "id", "family", F.col("grade").alias("old_grade"), F.when(every, "supported").otherwise("ambiguous").alias("status"), F.when(every, F.col("grade")).alias("proposed_grade"))


def decided(template: DataFrame, decisions: DataFrame, version: str, base: str | None = None) -> DataFrame:
    """review_id, topic_id, family, fault, proposed_grade of every decision; a fault is null or the first rule broken.

    ``template`` has review_id, topic_id, family, old_grade and text;
    ``decisions`` review_id, review_version, decision, grade, rationale,
    excerpt, reviewer_id, reviewed_at and, if ``base`` is given, base_hash, which
    must equal it: a decision on other judgements is an unknown review.  retain
    keeps the old grade, revise needs 0, 1 or 2, insufficient_information has
    none; an excerpt must occur in the text, whatever its case, so a template
    without a text accepts none.
    """
    d = decisions.withColumn("excerpt", F.trim(F.coalesce("excerpt", F.lit("")))).join(template.withColumn("__known", F.lit(True)), "review_id", "left")
    blank = F.lit(False)
    for c in ("rationale", "excerpt", "reviewer_id", "reviewed_at"):
        blank = blank | (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
    other = F.lit(False) if base is None else ~F.col("base_hash").eqNullSafe(F.lit(base))
    # in capitals: lower case doesn't bring SS back to the sharp s that it is the capital of
    fault = (
        F.when(F.col("__known").isNull() | ~F.col("review_version").eqNullSafe(F.lit(version)) | other, "unknown_review")
        .when(~F.coalesce(F.col("decision").isin("retain", "revise", "insufficient_information"), F.lit(False)), "invalid_decision")
        .when((F.col("decision") == "revise") & ~F.coalesce(F.col("grade").isin(0, 1, 2), F.lit(False)), "invalid_grade")
        .when(blank, "incomplete")
        .when(~F.coalesce(F.upper("text").contains(F.upper("excerpt")), F.lit(False)), "excerpt_not_in_text")
    )
    grade = F.when(F.col("decision") == "retain", F.col("old_grade")).when(F.col("decision") == "revise", F.col("grade"))
    return d.withColumn("fault", fault).select("review_id", "topic_id", "family", "fault", F.when(F.col("fault").isNull(), grade).alias("proposed_grade"))


def overlaid(qrels: DataFrame, decisions: DataFrame) -> DataFrame:
    """topic_id, family, grade, decision_status: legacy grades, replaced where the accepted decisions of a family agree on one."""
    one = decisions.where("fault is null and proposed_grade is not null").groupBy("topic_id", "family").agg(F.min("proposed_grade").alias("new"), F.max("proposed_grade").alias("__most"))
    j = qrels.join(one.where("new = __most").drop("__most"), ["topic_id", "family"], "left")
    return j.select("topic_id", "family", F.coalesce("new", "grade").alias("grade"), F.when(F.col("new").isNull(), "unreviewed_retained").otherwise("revised").alias("decision_status"))


RATED = ("score", "unsure", "rationale", "rated_at")


def rating_import(history: DataFrame, incoming: DataFrame, allowed: DataFrame, pool: str | None = None) -> DataFrame:
    """Every incoming rating (item_id, reviewer, score, unsure, rationale, rated_at, revision, change_reason) with its status.

    appended; unchanged if it repeats the last one; or a fault: duplicate_row,
    unknown_item, incomplete (no score of 0 to 2 though not unsure, no
    rationale or no rated_at), first_revision_not_one, revision_not_higher,
    no_change_reason.  ``allowed`` has the pairs item_id, reviewer that were asked
    for; with ``pool``, rows of another pool_version are unknown items too.
    """
    key = ["item_id", "reviewer"]
    last = history.groupBy(*key).agg(F.max_by(F.struct(*RATED, "revision"), "revision").alias("old"))
    j = incoming.withColumn("__n", F.count("*").over(W.partitionBy(*key))).join(last, key, "left").join(allowed.select(*key).distinct().withColumn("__asked", F.lit(True)), key, "left")
    unsure = F.coalesce("unsure", F.lit(False))
    same = F.lit(True)
    for c in RATED:
        same = same & F.col(c).eqNullSafe(F.col(f"old.{c}"))
    new = F.col("old").isNull()
    status = (
        F.when(F.col("__n") > 1, "duplicate_row")
        .when(F.col("__asked").isNull() | (F.lit(False) if pool is None else ~F.col("pool_version").eqNullSafe(F.lit(pool))), "unknown_item")
        .when((~unsure & ~F.coalesce(F.col("score").isin(0, 1, 2), F.lit(False))) | (F.trim(F.coalesce("rationale", F.lit(""))) == "") | (F.trim(F.coalesce(F.col("rated_at").cast("string"), F.lit(""))) == ""), "incomplete")
        .when(~new & same, "unchanged")
        .when(new & (F.col("revision") != 1), "first_revision_not_one")
        .when(~new & (F.col("revision") <= F.col("old.revision")), "revision_not_higher")
        .when(~new & (F.trim(F.coalesce("change_reason", F.lit(""))) == ""), "no_change_reason")
        .otherwise("appended")
    )
    return j.select(*incoming.columns, status.alias("status"))


def with_ratings(history: DataFrame, incoming: DataFrame, allowed: DataFrame) -> DataFrame:
    """The history with the incoming ratings appended; all or nothing: any fault raises when the result is read."""
    got = rating_import(history, incoming, allowed)
    bad = F.when(~F.col("status").isin("appended", "unchanged"), F.raise_error(F.concat(F.lit("rating import: "), F.col("status")))).otherwise(F.col("status"))
    return history.unionByName(got.withColumn("status", bad).where("status = 'appended'").select(*history.columns))


def lifecycle(requested: DataFrame, received: DataFrame, by: str, key: list[str]) -> DataFrame:
    """Per group: requested and received ratings and awaiting, partial or complete; a rating nobody asked for doesn't count."""
    j = requested.select(by, *key).distinct().join(received.select(*key).distinct().withColumn("__in", F.lit(1)), key, "left")
    g = j.groupBy(by).agg(F.count("*").alias("requested"), F.count("__in").alias("received"))
    state = F.when(F.col("received") == 0, "awaiting_external_reviews").when(F.col("received") == F.col("requested"), "reviews_imported_complete").otherwise("reviews_partially_imported")
    return g.select(by, "requested", "received", state.alias("status"))


def migrated(blind: DataFrame, queries: DataFrame, papers: DataFrame, scope: str, partial: bool = False) -> DataFrame:
    """old_id, new_pair_id, query_id, id, status: blind rows under ids made of the hashes of query, document and scope.

    A row whose query or document is gone is unmatched: with ``partial`` it is
    returned so, else the migration is incomplete and raises when read.
    """
    q = queries.select("query_id", F.sha2("query", 256).alias("qh"))
    p = papers.select("id", F.sha2(F.concat_ws("|", "title", "abstract", F.col("year").cast("string")), 256).alias("ph"))
    j = blind.join(q, "query_id", "left").join(p, "id", "left")
    whole = F.col("qh").isNotNull() & F.col("ph").isNotNull()
    pair = F.when(whole, F.left(F.sha2(F.concat_ws("|", "qh", "ph", F.lit(scope)), 256), F.lit(24)))
    status = F.when(whole, "matched").otherwise(F.lit("unmatched") if partial else F.raise_error(F.concat(F.lit("incomplete migration: no counterpart of "), F.coalesce(F.col("old_id").cast("string"), F.lit("a row")))))
    return j.select("old_id", pair.alias("new_pair_id"), "query_id", "id", status.alias("status"))


def imported(records: DataFrame, cutoff: int) -> DataFrame:
    """id, accepted, canonical_id, reason: papers in order of ``place``, each accepted unless an accepted earlier one has its DOI, arXiv number or text.

    ``records`` has place, id, title, abstract, year, doi, arxiv.  An id that
    two records have raises.  Rows without id, title, abstract or year, or from
    the cutoff year on, are excluded first; the reason names the columns that
    are missing.
    The alias of a row is the paper of its arXiv number, else of its DOI, else
    of its text; an alias adds no keys.  Rounds settle all rows whose earlier
    rivals are settled; each writes a table, and a key shared by many rows is
    combined map-side.
    """
    twice = records.where(F.trim(F.coalesce("id", F.lit(""))) != "").groupBy("id").count().where("count > 1").select("id").limit(1).collect()
    if twice:
        raise ValueError(f"two records have the id {twice[0]['id']}")
    gone = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in ("id", "title", "abstract", "year")]
    names = F.array_join(F.filter(F.array(*gone), lambda c: c.isNotNull()), "+")
    why = F.when(names != "", F.concat(F.lit("missing:"), names)).when(F.col("year") >= cutoff, "year_not_before_cutoff")
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.nullif(c, F.lit("")).alias("key"))
    keys = F.array(key(0, T.identifier(F.col("arxiv"))), key(1, T.identifier(F.col("doi"))), key(2, F.sha2(T.normalized(content()), 256)))
    rows = written(records.select("place", "id", why.alias("why"), F.filter(keys, lambda k: k["key"].isNotNull()).alias("keys")), "records")
    of = lambda r: r.select("place", F.explode("keys").alias("k")).select("place", "k.kind", "k.key")
    spark, state = records.sparkSession, None
    todo = written(rows.where("why is null").select("place", "id", "keys", F.lit(None).cast("boolean").alias("ok")), "open")
    while True:
        k = of(todo.where("ok is null or ok"))
        first = k.groupBy("kind", "key").agg(F.min("place").alias("first"))
        took = of(todo.where("ok")).groupBy("kind", "key").agg(F.min("place").alias("owner"))
        mine = of(todo.where("ok is null")).join(first, ["kind", "key"]).join(took, ["kind", "key"], "left")
        seen = mine.groupBy("place").agg(F.min((F.col("first") == F.col("place")).cast("int")).alias("leads"), F.max((F.col("owner") < F.col("place")).cast("int")).alias("owned"))
        verdict = F.when(F.col("ok").isNotNull(), F.col("ok")).when(F.col("owned") == 1, False).when(F.col("leads") == 1, True)
        nxt = written(todo.join(seen, "place", "left").select("place", "id", "keys", verdict.alias("ok")), "open")
        discard(todo)
        todo, left = nxt, nxt.where("ok is null").count()
        if left == 0:
            break
        if left == state:
            raise ValueError("import does not settle: places must be distinct")
        state = left
    owners = of(todo.where("ok")).join(todo.where("ok").select("place", F.col("id").alias("owner")), "place").select("kind", "key", "owner", F.col("place").alias("at"))
    alias = of(todo.where("not ok")).join(owners, ["kind", "key"]).where("at < place").groupBy("place").agg(F.min_by("owner", "kind").alias("canonical_id"))
    done = rows.select("place", "id", "why").join(alias, "place", "left")
    reason = F.coalesce("why", F.when(F.col("canonical_id").isNotNull(), F.concat(F.lit("duplicate_of:"), F.col("canonical_id"))))
    return done.select("id", reason.isNull().alias("accepted"), "canonical_id", reason.alias("reason"))


def canonical(papers: DataFrame, families: DataFrame) -> DataFrame:
    """The papers that lead their family (columns id, family, canonical); a leader that isn't among the papers raises."""
    j = families.where("canonical").select("id", "family").join(papers.withColumn("__in", F.lit(True)), "id", "left")
    there = F.when(F.col("__in").isNull(), F.raise_error(F.concat(F.lit("family map names a missing document: "), F.col("id")))).otherwise(F.col("__in"))
    return j.withColumn("__in", there).where("__in").drop("__in")


def family_faults(families: DataFrame) -> DataFrame:
    """family, splits, leaders of families that cross splits or have not exactly one canonical paper."""
    g = families.groupBy("family").agg(F.countDistinct("split").alias("splits"), F.count_if("canonical").alias("leaders"))
    return g.where("splits <> 1 or leaders <> 1")


def query_faults(queries: DataFrame, topics: DataFrame, splits: list[str]) -> DataFrame:
    """check, passed, n (rows at fault): no blank columns, known topics and splits, distinct ids."""
    blank: Column = F.lit(False)
    for c in ("query_id", "topic_id", "query", "split"):
        blank = blank | (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
    j = queries.join(F.broadcast(topics.select("topic_id").withColumn("__known", F.lit(True))), "topic_id", "left")
    one = j.agg(F.count_if(blank).alias("complete"), F.count_if(F.col("__known").isNull()).alias("known_topics"), F.count_if(~F.coalesce(F.col("split").isin(splits), F.lit(False))).alias("known_splits"), (F.count("*") - F.countDistinct("query_id")).alias("distinct_ids"))
    return checks(one, ["complete", "known_topics", "known_splits", "distinct_ids"])


def checks(one: DataFrame, names: list[str]) -> DataFrame:
    """check, passed, n from one row of counts of faults."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), (F.col(n) == 0).alias("passed"), F.col(n).cast("long").alias("n")) for n in names])).alias("r")).select("r.*")
