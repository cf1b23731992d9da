"""The library: listings, filters, reading state, shelves, usage, retention and merges of its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.functions import scalars as S
from readlake.functions import text as X
from readlake.functions import urls as U
from readlake.operators.ranking import newest_per_key

SORTS = {
    "newest": lambda: [F.col("created_at").desc(), F.col("document_id")],
    "updated": lambda: [F.col("updated_at").desc(), F.col("document_id")],
    "title": lambda: [F.lower("title"), F.col("document_id")],
}
HEAVY = ("content_clean", "source_map", "content_aside", "figure_notes", "chart_data")
JOB_MINUTES = 15
DRAFT_DAYS, ACTIVITY_DAYS = 30, 90


def owned(df: DataFrame, owner, column: str = "user_id") -> DataFrame:
    """Only one owner's rows. First in every plan, so it reaches the scan as a pushed filter."""
    return df.filter(F.col(column) == owner)


def list_documents(df: DataFrame, source: str | None = None, sort: str = "newest") -> DataFrame:
    """Every column but the heavy ones, optionally of one source, in one of three orders."""
    light = df.drop(*HEAVY)
    if source:
        light = light.filter(F.col("source_type") == source)
    return light.orderBy(*SORTS[sort]())


def heavy(df: DataFrame, key: str, column: str) -> DataFrame:
    """One heavy column on its own: the scan reads the key and that column only."""
    return df.select(key, column)


def derived(df: DataFrame) -> DataFrame:
    """The listing's computed columns."""
    kind = S.file_type(F.col("source_type"), F.col("original_filename"))
    pct = S.progress(F.col("is_read"), F.col("last_read_page"), F.col("page_count"), F.col("read_fraction"))
    origin = F.when(F.col("source_type") == "manual", F.coalesce(U.domain(F.col("url")), F.lit("Link")))
    out = df.withColumn("file_type", kind).withColumn("progress", pct)
    return (
        out.withColumn("state", S.read_state(F.col("progress")))
        .withColumn("origin", F.coalesce(origin, "original_filename", F.lit("Uploaded file")))
        .withColumn("reading_minutes", S.reading_minutes(F.col("word_count")))
        .withColumn("no_derivatives", S.no_derivatives(F.col("license")))
        .withColumn("readable", S.readable(F.col("extraction_status"), F.col("file_type")))
    )


def equal_filters(df: DataFrame, **wanted) -> DataFrame:
    """Optional equality filters: a value of None leaves its column alone."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def filter_documents(
    df: DataFrame, collection=None, source=None, state=None, file_type=None, topic=None, query: str = ""
) -> DataFrame:
    """The library's filters together, over `derived` rows."""
    out = equal_filters(df, collection_id=collection, source_type=source, state=state, file_type=file_type)
    if topic:
        out = out.filter(F.array_contains("topics", topic))
    needle = X.fold_text(query.strip())
    if needle:
        out = out.filter(F.contains(X.fold(F.concat_ws(" ", "title", "origin")), F.lit(needle)))
    return out


def on_shelf(highlights: DataFrame, documents: DataFrame, collection) -> DataFrame:
    """Highlights of the documents on one shelf."""
    shelf = documents.filter(F.col("collection_id") == collection).select("document_id")
    return highlights.join(shelf, "document_id", "left_semi")


def with_topics(documents: DataFrame, articles: DataFrame) -> DataFrame:
    """Topics and licence by address: the catalogue's, else the publisher's rule."""
    known = articles.select("url", "topics", F.col("license").alias("_article_license"))
    # Uploads have no address: they stay out of the join, where they would all be one key.
    placed = documents.filter("url IS NOT NULL").join(known, "url", "left")
    joined = placed.unionByName(documents.filter("url IS NULL"), allowMissingColumns=True)
    return joined.withColumn("license", U.known_license(F.col("_article_license"), F.col("url"))).drop("_article_license")


def count_children(parents: DataFrame, children: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Parents with their number of children, zeros kept. Children are counted before the join, so a parent
    with very many children costs one row."""
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def continue_reading(df: DataFrame, n: int = 3) -> DataFrame:
    """Started and unfinished, last touched first; only when there is none, the newest unread one."""
    open_ = df.filter("readable")
    started = open_.filter((F.col("progress") > 0) & (F.col("progress") < 100))
    first = started.orderBy(F.col("updated_at").desc(), "document_id").limit(n)
    any_started = started.limit(1).agg(F.count(F.lit(1))).scalar()
    unread = open_.filter(~F.col("is_read")).orderBy(F.col("created_at").desc(), "document_id").limit(1)
    return first.unionByName(unread.filter(any_started == 0))


def continue_reading_each(df: DataFrame, n: int = 3) -> DataFrame:
    """The same for every user at once: the two branches are ranks, limited before the shuffle."""
    open_ = df.filter("readable")
    started = open_.filter((F.col("progress") > 0) & (F.col("progress") < 100))
    first = newest_per_key(started, ["user_id"], [F.col("updated_at").desc(), F.col("document_id")], n)
    unread = newest_per_key(
        open_.filter(~F.col("is_read")), ["user_id"], [F.col("created_at").desc(), F.col("document_id")], 1
    )
    return first.unionByName(unread.join(first.select("user_id"), "user_id", "left_anti"))


def read_counts(df: DataFrame) -> DataFrame:
    """Documents per reading state, and in all."""
    rolled = df.rollup("state").agg(F.count(F.lit(1)).alias("n"), F.grouping("state").alias("_g"))
    return rolled.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("state")).alias("state"), "n")


def usage(
    documents: DataFrame, highlights: DataFrame, notes: DataFrame, results: DataFrame, links: DataFrame, linked: DataFrame
) -> DataFrame:
    """What deleting each document would touch. Every side is one grouped row per document before it joins;
    the notebooks are the distinct ones of links and of cited highlights."""
    marks = highlights.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("highlights"), F.count_if(F.col("note") != "").alias("_noted")
    )
    free = notes.groupBy("document_id").agg(F.count(F.lit(1)).alias("_free"))
    made = results.select("document_id").distinct().withColumn("has_result", F.lit(True))
    books = (
        links.select("document_id", "notebook_id")
        .union(linked.select("document_id", "notebook_id"))
        .distinct()
        .groupBy("document_id")
        .agg(F.count(F.lit(1)).alias("notebooks"))
    )
    out = documents.select("document_id")
    for side in (marks, free, made, books):
        out = out.join(side, "document_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "document_id",
        zero("highlights").alias("highlights"),
        (zero("_noted") + zero("_free")).alias("notes"),
        F.coalesce("has_result", F.lit(False)).alias("has_result"),
        zero("notebooks").alias("notebooks"),
    )


def stale_reason(digest: Column, now_digest: Column, revision: Column, now_revision, model: Column, now_model) -> Column:
    """Why a stored result is out of date; the text outranks the prompt, the prompt the model."""
    return (
        F.when(~digest.eqNullSafe(now_digest), "content")
        .when(~revision.eqNullSafe(F.lit(now_revision)), "prompt")
        .when(~model.eqNullSafe(F.lit(now_model)), "model")
    )


def claimable(state: Column, started: Column, now: Column) -> Column:
    """A job may be claimed: none yet, not running, or running for too long."""
    return state.isNull() | (state != "running") | (started < now - F.expr(f"INTERVAL {JOB_MINUTES} MINUTES"))


def expired_drafts(notebooks: DataFrame, posts: DataFrame, today: Column) -> DataFrame:
    """AI drafts nobody opened or edited for a month and no post came from."""
    cutoff = F.date_sub(today, DRAFT_DAYS)
    idle = notebooks.filter(
        (F.col("status") == "draft")
        & F.col("ai_model").isNotNull()
        & (F.col("opened_on") < cutoff)
        & (F.col("updated_on") < cutoff)
    )
    return idle.join(posts.filter(F.col("notebook_id").isNotNull()).select("notebook_id"), "notebook_id", "left_anti")


def expired_activity(activity: DataFrame, today: Column, days: int = ACTIVITY_DAYS) -> DataFrame:
    return activity.filter(F.col("day") < F.date_sub(today, days))


def in_order(wanted: DataFrame, rows: DataFrame, key: str, position: str) -> DataFrame:
    """The wanted keys' rows in the caller's order, then live rows the caller did not name."""
    placed = wanted.join(rows, key)
    rest = rows.join(wanted.select(key), key, "left_anti").withColumn(position, F.lit(None).cast("bigint"))
    return placed.unionByName(rest).orderBy(F.col(position).asc_nulls_last(), key)


def unique_addresses(df: DataFrame, url: str, order: list[Column], keep: int | None = None) -> DataFrame:
    """Near-identical addresses once, the first kept, optionally only the first few of all."""
    keyed = df.withColumn("_key", U.same_page_key(F.col(url)))
    rest = [c for c in df.columns]
    first = keyed.groupBy("_key").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select("r.*")
    return first.orderBy(*order).limit(keep) if keep else first


def position_errors(highlights: DataFrame, documents: DataFrame) -> DataFrame:
    """Highlights with a page on something that is no PDF, or beyond its last page."""
    joined = highlights.filter(F.col("page_number").isNotNull()).join(
        documents.select("document_id", "file_type", "page_count"), "document_id"
    )
    wrong = F.when(F.col("file_type") != "pdf", "not_a_pdf").when(
        (F.col("page_number") < 1) | (F.col("page_number") > F.col("page_count")), "no_such_page"
    )
    return joined.withColumn("problem", wrong).filter(F.col("problem").isNotNull())
