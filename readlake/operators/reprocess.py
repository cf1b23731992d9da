"""What becomes of a document's annotations and reading place when its text is made anew.

Two versions of a text are laid beside each other by their blocks: blocks of one name are the same block, and the heaviest part of
them that keeps its order pins the rest down. Between pins lie stretches of the old text that became stretches of the new one, so
any offset can be taken across: inside a kept block to the same letter, inside a changed stretch in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from readlake.operators import alignment, anchors

DONE, FAILED = "done", "failed"


def stretches(old: DataFrame, new: DataFrame, doc: str) -> DataFrame:
    """(doc, old_from, old_to, new_from, new_to, same): the old text, place by place, and what became of it. Both sides: (doc,
    block_id, start, words), start among the document's words. Blocks of one name that rise in both texts are kept; what stands
    between two kept blocks became what stands between them now."""
    size = lambda df, name: df.select(doc, "block_id", F.col("start").cast("int").alias(name), F.length("words").alias("size")).filter("size > 0")
    pins = size(old, "at").join(size(new, "to"), [doc, "block_id", "size"])
    # Neighbours on both sides are one pin, so a chain is as long as there are changes.
    along = W.partitionBy(doc).orderBy("at")
    goes_on = (F.lag(F.col("at") + F.col("size")).over(along) == F.col("at")) & (F.lag(F.col("to") + F.col("size")).over(along) == F.col("to"))
    pins = pins.withColumn("_run", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    pins = pins.groupBy(doc, "_run").agg(F.min("at").alias("at"), F.min("to").alias("to"), F.sum("size").cast("int").alias("size"))
    chain = pins.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("at", "to", "size").cast(alignment.RUN))).alias("_found"))
    chain = chain.withColumn("_chain", alignment.heaviest_chain(F.col("_found"))).drop("_found")
    ends = lambda df, name: df.groupBy(doc).agg(F.max(F.col("start") + F.length("words")).cast("int").alias(name))
    both = ends(old, "_old").join(ends(new, "_new"), doc, "left").join(chain, doc, "left")
    pinned_ = F.coalesce("_chain", F.array().cast(f"array<{alignment.RUN}>"))
    last = F.struct(F.col("_old").alias("at"), F.coalesce("_new", F.lit(0)).alias("to"), F.lit(0).alias("size")).cast(alignment.RUN)
    rows = both.select(doc, F.explode(F.concat(pinned_, F.array(last))).alias("r"))
    w = W.partitionBy(doc).orderBy("r.at", "r.size")
    before = lambda c: F.coalesce(F.lag(F.col(f"r.{c}") + F.col("r.size")).over(w), F.lit(0))
    rows = rows.select(doc, "r", before("at").alias("_a"), before("to").alias("_b"))
    kept = rows.filter("r.size > 0").select(
        doc, F.col("r.at").alias("old_from"), (F.col("r.at") + F.col("r.size")).alias("old_to"), F.col("r.to").alias("new_from"), (F.col("r.to") + F.col("r.size")).alias("new_to"), F.lit(True).alias("same")
    )
    changed = rows.filter("_a < r.at").select(doc, F.col("_a").alias("old_from"), F.col("r.at").alias("old_to"), F.col("_b").alias("new_from"), F.greatest("_b", "r.to").alias("new_to"), F.lit(False).alias("same"))
    return kept.unionByName(changed)


def moved(positions: DataFrame, between: DataFrame, doc: str, stretch: int = 4096) -> DataFrame:
    """`positions` (doc, offset, …) with the stretch they lie in: new_offset (null past the end of the old text) and same. Both
    sides are cut into cells of text, so that the range test is an equi-join."""
    cells = between.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("old_from") / stretch), F.floor((F.col("old_to") - 1) / stretch))))
    asked = positions.withColumn("_cell", F.floor(F.col("offset") / stretch))
    met = (asked[doc] == cells[doc]) & (asked["_cell"] == cells["_cell"]) & (asked["offset"] >= cells["old_from"]) & (asked["offset"] < cells["old_to"])
    rows = asked.join(cells, met, "left").drop(cells[doc], cells["_cell"], asked["_cell"])
    inside = F.col("offset") - F.col("old_from")
    share = F.floor(inside * (F.col("new_to") - F.col("new_from")) / (F.col("old_to") - F.col("old_from")))
    there = F.when(F.col("same"), F.col("new_from") + inside).otherwise(F.col("new_from") + share).cast("bigint")
    return rows.withColumn("new_offset", there).drop("old_from", "old_to", "new_from", "new_to")


def outcome(results: DataFrame, highlights: DataFrame, places: DataFrame, old: DataFrame, new: DataFrame, doc: str) -> DataFrame:
    """One row a reprocessed document.

    results: (doc, from_version, to_version, error), error null where a whole new text came out. highlights: as `anchors.placed` takes
    them, with user_id and created_at. places: (doc, block_id, offset), where the reader was, offset among the block's words. old, new: blocks
    (doc, block_id, ord, words, text, start) of both versions.

    state: done, or failed, and then nothing else changes. mapped, ambiguous, unresolved: the highlights placed again in the new
    text. place: kept (its block is still there), moved (another block stands there now, at place_offset among the new words), lost (the
    new text has nothing there), or null where nobody read."""
    good = results.filter("error is null").select(doc)
    again = anchors.recheck(highlights, anchors.index(new, doc), good, doc)
    counts = again.groupBy(doc).agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("mapped", "ambiguous", "unresolved")])
    held = places.join(good, doc, "left_semi").join(old.select(doc, "block_id", F.col("start").alias("_start")), [doc, "block_id"], "left")
    between = stretches(old.join(good, doc, "left_semi"), new.join(good, doc, "left_semi"), doc)
    asked = held.select(doc, "block_id", (F.col("_start") + F.col("offset")).alias("offset"))
    across = moved(asked, between, doc)
    still = new.select(doc, "block_id", F.col("start").alias("_now")).join(held.select(doc, "block_id", F.col("offset").alias("_in")), [doc, "block_id"])
    found = across.join(still, [doc, "block_id"], "left")
    ends = new.groupBy(doc).agg(F.max(F.col("start") + F.length("words")).alias("_end"))
    found = found.join(ends, doc, "left")
    is_moved = F.col("new_offset").isNotNull() & (F.col("new_offset") < F.col("_end"))
    place = F.when(F.col("_now").isNotNull(), "kept").when(F.coalesce(is_moved, F.lit(False)), "moved").otherwise("lost")
    at = F.when(F.col("_now").isNotNull(), F.col("_now") + F.col("_in")).when(is_moved, F.col("new_offset"))
    told = found.select(doc, place.alias("place"), at.cast("bigint").alias("place_offset"))
    out = results.join(counts, doc, "left").join(told, doc, "left")
    ok = F.col("error").isNull()
    zero = lambda c: F.when(ok, F.coalesce(F.col(c), F.lit(0))).alias(c)
    return out.select(
        doc, F.when(ok, DONE).otherwise(FAILED).alias("state"), "from_version", F.when(ok, F.col("to_version")).otherwise(F.col("from_version")).alias("to_version"), "error",
        *map(zero, ("mapped", "ambiguous", "unresolved")), "place", "place_offset",
    )
