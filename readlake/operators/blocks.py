"""Blocks of a clean text: their names, order, offsets and the ranges that cross them.

Everything here is ordered within one document, whose text is one row of the documents table; a document is
therefore the natural unit of a window, and no window spans documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from readlake.functions import text as X

STRETCH = 4096


def heading_in_force(df: DataFrame, doc: str, order: str, own: str) -> DataFrame:
    """The last heading at or above each row."""
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("heading", F.last(own, ignorenulls=True).over(w))


# Line patterns of the reading Markdown.
STOP = r"^(#{1,6}\s|```|>|\||---\s*$)"
LIST = r"^\s*(?:[-*+]|\d+\.)\s+"
IMAGE = r"(?i)^!\[[^\]]*\]\((?:https?://\S+|%s:[0-9a-f]{16}\.webp)\)$"
MATH = r"^\s*\$\$(.*\S.*)\$\$\s*$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def markdown_blocks(df: DataFrame, doc: str, text: str, scheme: str = X.PICTURES) -> DataFrame:
    """(doc, ord, kind, raw): the blocks of each text in reading order, raw as their names are made from it.

    Lines become rows and the blocks are found as runs: a fence is told by the parity of fence marks, a
    paragraph goes on through any line that does not open something else (a picture or an indented table row
    right under a paragraph belongs to it).
    """
    lines = df.select(doc, F.posexplode(F.split(text, "\n")).alias("line", "s"))
    w = W.partitionBy(doc).orderBy("line")
    sofar = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    mark = F.startswith("s", F.lit("```")).cast("int")
    lines = lines.withColumn("_fences", F.sum(mark).over(sofar)).withColumn("_mark", mark == 1)
    fenced = F.col("_mark") | (F.col("_fences") % 2 == 1)
    hit = lambda p: F.rlike("s", F.lit(p))
    blank = ~hit(r"\S") | hit(r"^---\s*$")
    table = hit(r"^\s*\|")
    image = F.rlike(_strip(F.col("s")), F.lit(IMAGE % scheme))
    raw_kind = (
        F.when(fenced, "fence").when(blank, "gap").when(hit(MATH) | hit(r"^#{1,6}\s+"), "single").when(image, "image")
        .when(table, "table").when(hit("^>"), "quote").when(hit(LIST), "list").otherwise("para")
    )
    lines = lines.withColumn("_k", raw_kind)
    soft = F.col("_k").isin("para", "image") | ((F.col("_k") == "table") & ~hit(STOP))
    lines = lines.withColumn("_soft", soft).withColumn("_run", F.sum((~soft).cast("int")).over(sofar))
    in_run = W.partitionBy(doc, "_run").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    open_para = F.max((F.col("_soft") & (F.col("_k") == "para")).cast("int")).over(in_run) == 1
    kind = F.when(F.col("_soft") & open_para, "para").otherwise(F.col("_k"))
    lines = lines.withColumn("kind", kind)
    before = F.lag("kind").over(w)
    fence_opens = F.col("_mark") & (F.col("_fences") % 2 == 1)
    opens = F.when(F.col("kind") == "fence", fence_opens).otherwise(
        before.isNull() | (before != F.col("kind")) | F.col("kind").isin("single", "image")
    )
    lines = lines.withColumn("_block", F.sum(opens.cast("int")).over(sofar)).filter("kind <> 'gap'")
    kept = lines.filter(~((F.col("kind") == "fence") & F.col("_mark") & (F.col("_fences") % 2 == 0)))
    grouped = kept.groupBy(doc, "_block", "kind").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("line", "s"))), lambda x: x["s"]).alias("_l")
    )
    joined = F.array_join("_l", "\n")
    raw = (
        F.when(F.col("kind") == "fence", F.concat(F.lit("```"), F.array_join(F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0))), "\n")))
        .when(F.col("kind") == "para", F.array_join(F.transform("_l", lambda x: _strip(x)), " "))
        .when(F.col("kind") == "quote", F.concat(F.lit("> "), F.array_join(F.transform("_l", lambda x: F.regexp_replace(x, r"^>\s?", "")), "\n")))
        .otherwise(joined)
    )
    order = F.row_number().over(W.partitionBy(doc).orderBy("_block"))
    return grouped.select(doc, order.alias("ord"), "kind", raw.alias("raw"))


def ids(blocks: DataFrame, doc: str, key: Column | None = None) -> DataFrame:
    """Adds block_id: b<key>, then b<key>-1 … for the same block again."""
    keyed = blocks.withColumn("key", key if key is not None else X.fnv1a(F.col("raw")))
    n = F.row_number().over(W.partitionBy(doc, "key").orderBy("ord")) - 1
    named = keyed.withColumn("nth", n)
    suffix = F.when(F.col("nth") > 0, F.concat(F.lit("-"), F.col("nth").cast("string"))).otherwise("")
    return named.withColumn("block_id", F.concat(F.lit("b"), F.col("key"), suffix))


def places(blocks: DataFrame, source_map: DataFrame, doc: str) -> DataFrame:
    """The nth block of a key with the nth source-map entry of that key."""
    entries = source_map.withColumn("nth", F.row_number().over(W.partitionBy(doc, "key").orderBy("ord")) - 1).drop("ord")
    return blocks.join(entries, [doc, "key", "nth"], "left")


def offsets(blocks: DataFrame, doc: str, words: str = "words") -> DataFrame:
    """Adds start: where each block begins among the squashed characters of its document."""
    before = W.partitionBy(doc).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn("start", F.coalesce(F.sum(F.length(words)).over(before), F.lit(0)))


def spans(ranges: DataFrame, blocks: DataFrame, doc: str, key: str) -> DataFrame:
    """The stretch of each range inside each block it crosses. Both sides are cut into stretches of text, so
    the range test is an equi-join; a pair is kept in the first stretch both share."""
    b = blocks.select(doc, "block_id", F.col("start").alias("_s"), (F.col("start") + F.length("words")).alias("_e")).filter("_e > _s")
    cut = lambda df, a, z: df.withColumn("_k", F.explode(F.sequence(F.floor(F.col(a) / STRETCH), F.floor((F.col(z) - 1) / STRETCH))))
    r = cut(ranges.filter("range_end > range_start").select(doc, key, "range_start", "range_end"), "range_start", "range_end")
    met = r.join(cut(b, "_s", "_e"), [doc, "_k"]).filter((F.col("_s") < F.col("range_end")) & (F.col("range_start") < F.col("_e")))
    met = met.filter(F.col("_k") == F.floor(F.greatest("_s", "range_start") / STRETCH))
    return met.select(
        doc, key, "block_id",
        F.greatest(F.col("range_start") - F.col("_s"), F.lit(0)).alias("span_start"),
        (F.least("range_end", "_e") - F.col("_s")).alias("span_end"),
    )


def vocabulary(df: DataFrame, doc: str, text: str) -> DataFrame:
    """The distinct lower-case words of each document."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(\p{L}+)"), F.lit(1)))
    return df.select(doc, F.explode(words).alias("word"))


#: From the first letter of a word on and without going back, so that a word is read once.
BROKEN = "(?<!\\p{L})(\\p{L}++)-⁣(\\p{L}++)"


def rejoin(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Words broken at a line end, whole when the document prints them whole elsewhere.

    The broken words of a text are looked up among its own words, all at once; the replacements are folded over the text.
    """
    shown_soft = F.rlike(F.col(text), F.lit("­(?![⁣\\s]|$)"))
    soft = F.when(shown_soft, F.replace(F.col(text), F.lit("­"), F.lit("-"))).otherwise(
        F.replace(F.replace(F.col(text), F.lit("­⁣"), F.lit("")), F.lit("­"), F.lit(""))
    )
    out = df.withColumn("_t", soft)
    half = lambda m, n: F.substring_index(m, "-⁣", n)
    found = F.transform(F.regexp_extract_all("_t", F.lit(BROKEN), F.lit(0)), lambda m: F.struct(half(m, 1).alias("a"), half(m, -1).alias("b")))
    out = out.withColumn("_pairs", F.when(F.contains("_t", F.lit("-⁣")), F.array_distinct(found)))
    seen = F.regexp_extract_all(F.lower(F.regexp_replace("_t", BROKEN, " ")), F.lit(r"(\p{L}+)"), F.lit(1))
    whole = F.array_intersect(F.transform("_pairs", lambda p: F.lower(F.concat(p["a"], p["b"]))), seen)

    def fix(whole: Column) -> Column:
        joined = lambda p: F.when(F.array_contains(whole, F.lower(F.concat(p["a"], p["b"]))), F.concat(p["a"], p["b"])).otherwise(F.concat_ws("-", p["a"], p["b"]))
        return F.aggregate("_pairs", F.col("_t"), lambda acc, p: F.replace(acc, F.concat(p["a"], F.lit("-⁣"), p["b"]), joined(p)))

    fixed = F.when(F.size("_pairs") > 0, X.let(whole, fix)).otherwise(F.col("_t"))
    return out.withColumn(text, F.replace(fixed, F.lit("⁣"), F.lit(""))).drop("_t", "_pairs")
