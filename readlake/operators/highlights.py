"""Highlights as intervals: overlaps, equal passages, duplicates, reports on their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.operators.ranking import numbered, running

PASSAGE = ["user_id", "document_id", "version"]
SLICE = 4096  # characters of a document that share a task


def overlaps(df: DataFrame, start: str = "start_at", end: str = "end_at", key: str = "highlight_id") -> DataFrame:
    """How many other highlights of the same person, document and version overlap each one, and how many
    share its exact passage.

    No pairs are built. The intervals' ends are swept in order: those that started before this one ends,
    less those that ended by the time it starts, less itself, are the ones that meet it. The sweep counts
    slice by slice, so a document with a huge number of highlights is still many tasks.
    """
    placed = df.filter(F.col(start).isNotNull() & (F.col(end) > F.col(start))).select(*PASSAGE, key, start, end)
    edge = lambda at, opens: placed.select(
        *PASSAGE, key, start, end, F.col(at).alias("_at"), F.lit(opens).cast("bigint").alias("_opens")
    )
    edges = edge(end, 0).unionByName(edge(start, 1))
    swept = running(
        edges,
        PASSAGE,
        F.floor(F.col("_at") / SLICE),
        [F.col("_at"), F.col("_opens"), F.col(key)],
        {"_started": F.col("_opens"), "_ended": 1 - F.col("_opens")},
    )
    met = swept.groupBy(*PASSAGE, key, start, end).agg(
        (
            F.sum(F.when(F.col("_opens") == 0, F.col("_started"))) - F.sum(F.when(F.col("_opens") == 1, F.col("_ended")))
            - F.count_if(F.col("_opens") == 1)
        ).alias("_met")
    )
    same = placed.groupBy(*PASSAGE, start, end).agg(F.count(F.lit(1)).alias("_same"))
    out = met.join(same, [*PASSAGE, start, end])
    return out.select(
        *PASSAGE, key, start, end, (F.col("_met") - F.col("_same") + 1).alias("overlapping"), (F.col("_same") - 1).alias("same_passage")
    )


def neighbours(current: DataFrame, incoming: DataFrame, start: str = "start_at", end: str = "end_at") -> DataFrame:
    """For new highlights, the rows already there on the same passage or overlapping it. Both sides are cut
    into stretches of text, so the range test runs inside an equi-join; a pair meeting in several stretches
    is kept in the first one they share."""
    stretch = lambda df: df.withColumn(
        "_stretch", F.explode(F.sequence(F.floor(F.col(start) / SLICE), F.floor((F.col(end) - 1) / SLICE)))
    )
    a = stretch(incoming.select(*PASSAGE, F.col("highlight_id").alias("new_id"), start, end))
    b = stretch(
        current.select(*PASSAGE, "highlight_id", F.col(start).alias("_s"), F.col(end).alias("_e"))
        .withColumnsRenamed({}).withColumn(start, F.col("_s")).withColumn(end, F.col("_e"))
    ).drop(start, end)
    met = a.join(b, [*PASSAGE, "_stretch"]).filter((F.col("_s") < F.col(end)) & (F.col(start) < F.col("_e")))
    met = met.filter(F.col("_stretch") == F.floor(F.greatest(F.col("_s"), F.col(start)) / SLICE))
    same = (F.col("_s") == F.col(start)) & (F.col("_e") == F.col(end))
    return met.select(*PASSAGE, "new_id", "highlight_id", F.when(same, "same").otherwise("overlapping").alias("relation"))


def same_passage(df: DataFrame) -> DataFrame:
    """Each highlight with the one its passage belongs to: the earliest on it. One grouped row per passage is
    joined back; the rows of a passage are never paired with each other."""
    at = [*PASSAGE, "start_at", "end_at"]
    owner = df.groupBy(*at).agg(F.min(F.struct("created_at", "highlight_id"))["highlight_id"].alias("kept"))
    return df.join(owner, at)


def earliest_wins(df: DataFrame) -> DataFrame:
    """The earliest of the highlights on one passage stays; the later ones become ambiguous."""
    owned = same_passage(df)
    state = F.when(F.col("kept") == F.col("highlight_id"), F.col("anchor_status")).otherwise("ambiguous")
    return owned.withColumn("anchor_status", state)


def status_counts(df: DataFrame, key: str, states=("mapped", "ambiguous", "unresolved")) -> DataFrame:
    return df.groupBy(key).agg(*(F.count_if(F.col("anchor_status") == s).alias(s) for s in states))


def sync_report(highlights: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: documents, highlights by sync state, merges planned and held back."""
    states = highlights.agg(
        F.count_distinct("document_id").alias("documents"),
        F.count(F.lit(1)).alias("highlights"),
        *(F.count_if(F.col("sync_status") == s).alias(s) for s in ("synced", "unsynced", "ambiguous")),
    )
    count = lambda c: plan.agg(F.count(c)).scalar()
    return states.select("*", count("merged").alias("merges"), count("held").alias("held"))


def common_notebooks(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Notebooks citing both highlights of a pair: the intersection of each side's notebooks."""
    side = lambda c: pairs.join(links.select(F.col("highlight_id").alias(c), "notebook_id"), c).select(
        "kept", "merged", "notebook_id"
    )
    return side("kept").intersect(side("merged"))


def block_of(clean_anchor: Column, block_id: Column) -> Column:
    """The paragraph a highlight belongs to: where it shows now, else where it was made."""
    return F.coalesce(F.get(clean_anchor, F.lit(0))["block"], block_id)


def numbered_in_document(df: DataFrame) -> DataFrame:
    """Highlights numbered in document order: page first (unknown pages last), then age."""
    order = [F.col("page_number").asc_nulls_last(), F.col("created_at"), F.col("highlight_id")]
    slices = F.struct(F.coalesce("page_number", F.lit(1 << 30)).alias("p"), F.to_date("created_at").alias("d"))
    return numbered(df, ["document_id"], slices, order, "number")
