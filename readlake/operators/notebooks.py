"""Notebooks: groups per document, numbered sources, versions, the export's reading order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from readlake.functions import text as X
from readlake.operators.anchors import sentence_around
from readlake.operators.highlights import common_notebooks
from readlake.operators.merge import join_notes
from readlake.operators.ranking import WHOLE, large_keys, newest_per_key, numbered

MAX_SOURCES, MAX_VERSIONS, MAX_CONVERSATIONS, HISTORY = 100, 50, 50, 8


def groups(documents: DataFrame, highlights: DataFrame, notes: DataFrame) -> DataFrame:
    """Documents with a highlight or a note: counts and the last activity. Both sides are grouped before the
    joins; a document with neither is dropped."""
    marks = highlights.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("note") != "").alias("_noted"),
        F.max("updated_at").alias("_hl_last"),
    )
    free = notes.groupBy("document_id").agg(
        F.count_if(F.col("origin") == "user").alias("_own"),
        F.count_if(F.col("origin") == "ai_saved").alias("_ai"),
        F.max("updated_at").alias("_nt_last"),
    )
    both = documents.join(marks, "document_id", "left").join(free, "document_id", "left")
    both = both.filter(F.col("_n").isNotNull() | F.col("_own").isNotNull())
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        *documents.columns,
        zero("_n").alias("highlight_count"),
        (zero("_noted") + zero("_own")).alias("note_count"),
        zero("_ai").alias("insight_count"),
        F.greatest("_hl_last", "_nt_last").alias("last_activity_at"),
    )


def notebook_list(notebooks: DataFrame, links: DataFrame, linked: DataFrame) -> DataFrame:
    """Each notebook with its number of sources and of documents drawn on, directly or through a highlight."""
    sources = links.groupBy("notebook_id").agg(F.count("highlight_id").alias("source_count"))
    drawn = (
        linked.select("notebook_id", "document_id")
        .union(links.select("notebook_id", "document_id"))
        .distinct()
        .groupBy("notebook_id")
        .agg(F.count(F.lit(1)).alias("document_count"))
    )
    out = notebooks.join(sources, "notebook_id", "left").join(drawn, "notebook_id", "left")
    return out.fillna(0, ["source_count", "document_count"])


def sources_of(links: DataFrame, highlights: DataFrame, documents: DataFrame, more: tuple = ()) -> DataFrame:
    """Link ⋈ highlight ⋈ document; `more` are further columns of the highlights."""
    marks = highlights.select("highlight_id", "selected_text", "color", "page_number", "start_at", "created_at", *more)
    titles = documents.select("document_id", "title")
    return links.join(marks, "highlight_id").join(titles, "document_id")


def number_sources(rows: DataFrame, key: str = "notebook_id", whole: bool = False) -> DataFrame:
    """Sources 1..n by title, document, whether placed, where, page and age; slice by slice of a document's
    stretches, so a notebook or a document holding much of the table is still many tasks. `whole`: each notebook
    is small enough for one task, and its rows are shuffled once, by notebook, before they are numbered."""
    order = [
        F.lower("title"),
        F.col("document_id").cast("string"),
        F.col("start_at").isNull(),
        F.coalesce("start_at", F.lit(0)),
        F.coalesce("page_number", F.lit(0)),
        F.col("created_at"),
        F.col("highlight_id"),
    ]
    if whole:
        # What the order is made of is shuffled, not the order's own columns.
        return rows.repartition(F.col(key)).withColumn("number", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("bigint"))
    stretch = F.floor(F.coalesce("start_at", F.lit(0)) / 4096)
    slices = F.struct(order[0].alias("t"), order[1].alias("d"), order[2].alias("u"), stretch.alias("s"))
    return numbered(rows, [key], slices, order, "number")


def by_notebook(rows: DataFrame, links: DataFrame, made: Callable[[DataFrame, bool], DataFrame], key: str = "notebook_id", most: int = WHOLE) -> DataFrame:
    """`made` of the numbered sources: of notebooks that fit one task whole, each dealt once by notebook and made there without another
    shuffle; of notebooks with more than `most` links slice by slice. `made` is told which (sources, whole)."""
    large = large_keys(links, [key], most)
    if large is None:
        return made(number_sources(rows, key, whole=True), True)
    named = F.broadcast(large.withColumnRenamed(key, "_large"))
    same = F.col(key).eqNullSafe(F.col("_large"))
    small = made(number_sources(rows.join(named, same, "left_anti"), key, whole=True), True)
    return small.unionByName(made(number_sources(rows.join(named, same, "left_semi"), key), False))


def new_numbers(links: DataFrame, cited: DataFrame, wanted: DataFrame) -> DataFrame:
    """Kept sources keep their number; new ones get numbers no link and no [n] in the text ever used."""
    top = (
        links.select("notebook_id", "position")
        .union(cited.select("notebook_id", "position"))
        .groupBy("notebook_id")
        .agg(F.max("position").alias("_top"))
    )
    kept = wanted.join(links, ["notebook_id", "highlight_id"], "left")
    new = kept.filter(F.col("position").isNull()).drop("position").join(top, "notebook_id", "left")
    coarse = F.floor(F.col("asked") / 1000)
    fresh = numbered(new, ["notebook_id"], coarse, [F.col("asked"), F.col("highlight_id")], "_i")
    fresh = fresh.withColumn("position", (F.coalesce("_top", F.lit(0)) + F.col("_i")).cast("int")).drop("_i", "_top")
    return kept.filter(F.col("position").isNotNull()).unionByName(fresh)


def keep_newest(df: DataFrame, parent: str, newest: str, key: str, limit: int) -> DataFrame:
    return newest_per_key(df, [parent], [F.col(newest).desc(), F.col(key)], limit)


def changed_versions(versions: DataFrame, parent: str, slice_by, at: list[str], same: list[str]) -> DataFrame:
    """Snapshots that differ from the one before."""
    from readlake.operators.ranking import with_previous

    paired = with_previous(versions, [parent], slice_by, at, same)
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_prev_{c}"))
    return paired.filter(F.col("_first") | ~equal).drop("_first", *(f"_prev_{c}" for c in same))


def recent_turns(messages: DataFrame, limit: int = HISTORY) -> DataFrame:
    """The last turns of each conversation."""
    return newest_per_key(messages, ["conv_id"], [F.col("turn").desc(), F.col("role")], limit)


def reading_order(highlights: DataFrame, documents: DataFrame) -> DataFrame:
    """Where each highlight's opening words stand in its document: the first 60 folded characters, else the
    first 24, else the page's share of the text, else the end; `place` orders them, then age. The text is
    folded once per document, and only documents with highlights are read."""
    texts = documents.join(highlights.select("document_id").distinct(), "document_id", "left_semi")
    texts = texts.select("document_id", "page_count", F.lower(X.collapse(F.col("text"))).alias("_text"))
    words = F.lower(X.collapse(F.col("selected_text")))
    joined = highlights.withColumn("_words", words).join(texts, "document_id")
    found = lambda size: F.when(F.length("_words") > 0, F.expr(f"nullif(instr(_text, substr(_words, 1, {size})), 0) - 1"))
    share = F.floor((F.col("page_number") - 1) / F.nullif("page_count", F.lit(0)) * F.length("_text")).cast("int")
    place = F.coalesce(found(60), found(24), F.when(F.col("page_number") > 0, share), F.length("_text"))
    return joined.withColumn("place", place).drop("_words", "_text", "page_count")


def source_groups(sources: DataFrame) -> DataFrame:
    """Sources of a notebook grouped by document, the groups by their first number, in order:
    one row per group, never its sources gathered."""
    firsts = sources.groupBy("notebook_id", "document_id").agg(
        F.min("number").alias("first_number"), F.count(F.lit(1)).alias("sources")
    )
    return firsts


def _sliced(sources: DataFrame, at: list[str], most: int, fields: list[str], whole: bool = False) -> DataFrame:
    """(at, slice, sources): each group's sources in the order of their numbers, `most` in a row, counted slice by slice of the numbers, so
    that no group is gathered in one task; or, where groups are `whole`, counted where they lie."""
    if whole:
        numbered_ = sources.withColumn("_n", F.row_number().over(W.partitionBy(*at).orderBy("number")))
    else:
        numbered_ = numbered(sources, at, F.floor(F.col("number") / most), [F.col("number")], "_n")
    cut = numbered_.withColumn("slice", F.floor((F.col("_n") - 1) / most).cast("int"))
    return cut.groupBy(*at, "slice").agg(F.array_sort(F.collect_list(F.struct("number", *fields))).alias("sources"))


def group_sources(sources: DataFrame, most: int = 1000, fields: tuple = ("highlight_id",), whole: bool = False) -> DataFrame:
    """(notebook_id, document_id, first_number, slice, sources): the sources themselves of each group, in order, in slices of `most`. Groups go by
    first_number, slices by their own number."""
    at = ["notebook_id", "document_id"]
    if whole:
        first = sources.withColumn("first_number", F.min("number").over(W.partitionBy(*at).orderBy("number")))
        out = _sliced(first, [*at, "first_number"], most, list(fields), whole)
        return out.select(*at, "slice", "sources", "first_number")
    first = sources.groupBy(*at).agg(F.min("number").alias("first_number"))
    return _sliced(sources, at, most, list(fields)).join(first, at)


def paragraph_sentences(sources: DataFrame, most: int = 1000, whole: bool = False) -> DataFrame:
    """(notebook_id, document_id, paragraph, slice, sources): sources that share a paragraph, as an ordered array of number, highlight_id and the
    sentence its words stand in. `sources` carries paragraph, paragraph_text and selected_text."""
    at = ["notebook_id", "document_id", "paragraph"]
    told = sources.filter(F.col("paragraph").isNotNull())
    if whole:
        shared = told.withColumn("_c", F.count(F.lit(1)).over(W.partitionBy(*at))).filter("_c > 1").drop("_c")
    else:
        shared = told.join(told.groupBy(*at).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(*at), at)
    said = shared.withColumn("sentence", sentence_around(F.col("paragraph_text"), F.col("selected_text")))
    return _sliced(said, at, most, ["highlight_id", "sentence"], whole)


def partners(sources: DataFrame, most: int = 1000, whole: bool = False) -> DataFrame:
    """(notebook_id, document_id, paragraph, number, highlight_id, partners): for each source that shares a paragraph the others of its slice, with
    their sentences: all of them in a paragraph of up to `most` sources, else its neighbours, the rest being in `paragraph_sentences`."""
    rows = paragraph_sentences(sources, most, whole)
    each = rows.withColumn("one", F.explode("sources"))
    others = F.filter("sources", lambda s: s["number"] != F.col("one.number"))
    return each.select("notebook_id", "document_id", "paragraph", F.col("one.number").alias("number"), F.col("one.highlight_id").alias("highlight_id"), others.alias("partners"))


def scope_problems(rows: DataFrame, collection: str | None = None) -> DataFrame:
    """Per notebook: whether its highlights come from one document, or all from the named shelf's documents."""
    docs = rows.groupBy("notebook_id").agg(
        F.min("document_id").alias("_a"),
        F.max("document_id").alias("_z"),
        F.every(F.col(collection) if collection else F.lit(True)).alias("_in"),
    )
    ok = F.col("_in") if collection else F.col("_a") == F.col("_z")
    return docs.select("notebook_id", ok.alias("in_scope"))


def paragraph_partners(sources: DataFrame, whole: bool = False) -> DataFrame:
    """For sources sharing a paragraph: how many others there are and the first and last numbers there, from
    one grouped row per paragraph (never every pair), or from the group itself where groups are `whole`."""
    at = ["notebook_id", "document_id", "paragraph"]
    told = sources.filter(F.col("paragraph").isNotNull())
    sums = {"_n": F.count(F.lit(1)), "first_number": F.min("number"), "last_number": F.max("number")}
    if whole:
        met = told.withColumns({name: value.over(W.partitionBy(*at)) for name, value in sums.items()}).filter(F.col("_n") > 1)
    else:
        shared = told.groupBy(*at).agg(*(value.alias(name) for name, value in sums.items()))
        met = sources.join(shared.filter(F.col("_n") > 1), at)
    return met.withColumn("others", F.col("_n") - 1).drop("_n")


def merge_plan(highlights: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Highlights on one passage: the oldest is kept, its pair merged when they are just two, one from each
    view, of one colour and without a common notebook; otherwise held back with the reason. One row per
    passage: only counts and extremes leave the tasks, and only pairs that nothing else holds back meet their links
    (highlight_id, notebook_id; by default the one notebook a highlight row names)."""
    passage = ["user_id", "document_id", "version", "start_at", "end_at"]
    key = F.struct("created_at", "highlight_id")
    per = highlights.groupBy(*passage).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("page_number").isNull()).alias("_clean"),
        (F.min("color") == F.max("color")).alias("_one_color"),
        F.min(key)["highlight_id"].alias("kept"),
        F.max(key)["highlight_id"].alias("merged"),
    )
    reason = (
        F.when(F.col("n") > 2, "more_than_two")
        .when(F.col("_clean") != 1, "same_view")
        .when(~F.col("_one_color"), "colors_differ")
    )
    plan = per.filter("n > 1").select(*passage, "n", "kept", "merged", reason.alias("held"))
    cited = (highlights if links is None else links).select("highlight_id", "notebook_id").filter("notebook_id IS NOT NULL")
    common = common_notebooks(plan.filter("held IS NULL").select("kept", "merged"), cited).select("kept", "merged").distinct()
    plan = plan.join(common.withColumn("_shared", F.lit(True)), ["kept", "merged"], "left")
    held = F.when(F.col("_shared"), "shared_notebook").otherwise(F.col("held"))
    return plan.select(*passage, "n", "kept", F.when(held.isNull(), F.col("merged")).alias("merged"), held.alias("held"))


def merged_highlights(highlights: DataFrame, links: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(highlights, links) after a plan: the merged highlight's note goes to the kept one, its notebook links too (each once), and
    its row goes."""
    pairs = plan.filter("merged IS NOT NULL").select("kept", "merged")
    gone = highlights.join(pairs, highlights["highlight_id"] == pairs["merged"]).select(F.col("kept").alias("highlight_id"), F.col("note").alias("_note"))
    rest = highlights.join(pairs.select(F.col("merged").alias("highlight_id")), "highlight_id", "left_anti")
    rest = rest.join(gone.withColumn("_pair", F.lit(True)), "highlight_id", "left")
    rest = rest.withColumn("note", F.when(F.col("_pair"), join_notes(F.col("note"), F.col("_note"))).otherwise(F.col("note")))
    moved = links.join(pairs.withColumnRenamed("merged", "highlight_id"), "highlight_id", "left")
    moved = moved.withColumn("highlight_id", F.coalesce("kept", "highlight_id")).select(*links.columns)
    return rest.select(*highlights.columns), moved.dropDuplicates(["highlight_id", "notebook_id"])
