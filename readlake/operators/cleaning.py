"""Page items into a document's clean text, with where every block of it stood and a store of all that was set aside.

Items go through the rules of `layout` and `roles` in their order: edges of pages and running lines, reading order, roles, paragraphs
carried over a page break, words broken at a line's end, scanned pages. Every text carries its boxes through splits and joins, so
what comes out is three tables: content, source map, side store. Each item ends in the flow or in the side store.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from readlake.functions import text as X
from readlake.operators import blocks as B
from readlake.operators import geom
from readlake.operators import layout as L
from readlake.operators import roles as R
from readlake.session import pinned

#: Stands between the texts of a document while its broken words are made whole.
APART = "\x1e"
BOX = "struct<page:int,x:double,y:double,w:double,h:double>"


class Cleaned(NamedTuple):
    """content: (doc_id, content, word_count). source_map: (doc_id, ord, key, boxes), one row a block of the content. aside: (doc_id, ord,
    type, text, page, box, confidence, reason). parts: the texts themselves, (doc_id, page, n, text, boxes)."""

    content: DataFrame
    source_map: DataFrame
    aside: DataFrame
    parts: DataFrame


def own_box() -> Column:
    page = [F.col(c) for c in ("x0", "y0", "x1", "y1", "page_width", "page_height")]
    return F.struct(F.col("page").cast("int").alias("page"), *geom.source_box(*page)).cast(BOX)


def with_edges(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """Items with role, confidence and reason where their place on the page tells them: turned text, licence lines, contact notes
    and sentences, running lines, page numbers. A contact sentence becomes an item of its own on its paragraph's box; a
    paragraph with nothing left goes."""
    rows = L.edge_roles(items.withColumn("text", F.coalesce("text", F.lit(""))).join(sizes, "doc_id", "left")).drop("body_size")
    told = ("text", "kind", "role", "confidence", "reason")
    cut = lambda c: F.struct(F.trim(c).alias("text"), F.lit("text").alias("kind"), F.lit("AUTHORS").alias("role"), F.lit(0.9).alias("confidence"), F.lit("contact sentence").alias("reason"))
    stays = (F.col("text") != "") | ~F.col("kind").isin("text", "note", "turned")
    own = F.filter(F.array(F.when(stays, F.struct(*told))), lambda x: x.isNotNull())
    each = F.explode(F.concat(own, F.transform("contacts", cut))).alias("_each")
    rows = rows.select(*[c for c in rows.columns if c not in (*told, "contacts")], each).select("*", "_each.*").drop("_each")
    # What has a role already takes no part in the count of running lines.
    known = {c: F.col(c) for c in ("role", "confidence", "reason", "kind")}
    rows = rows.withColumns({f"_{c}": v for c, v in known.items()}).withColumn("kind", F.when(F.col("role").isNull(), F.col("kind")).otherwise("set"))
    told = L.running_text(rows.drop("role", "confidence", "reason"), sizes).drop("body_size")
    told = told.withColumns({c: F.when(F.col("_role").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("role", "confidence", "reason")})
    return told.withColumn("kind", F.col("_kind")).drop(*[f"_{c}" for c in known])


def rejoined(texts: DataFrame, payload: list[str]) -> DataFrame:
    """(doc_id, text, payload…): words cut at a line's end made whole where the document prints them whole anywhere, the side store
    included. A document is one row meanwhile, as its content is."""
    row = F.struct("part", "page", "n", *payload, F.translate("text", APART, " ").alias("text"))
    whole = texts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.struct("part", "page", "n").alias("at"), row.alias("row")))).alias("_rows"))
    whole = whole.withColumn("_text", F.array_join(F.transform("_rows", lambda r: r["row"]["text"]), APART))
    whole = B.rejoin(whole, "doc_id", "_text").withColumn("_texts", F.split("_text", APART, -1))
    rows = whole.select("doc_id", F.explode(F.arrays_zip("_rows", "_texts")).alias("r"))
    return rows.select("doc_id", F.col("r._texts").alias("text"), *[F.col(f"r._rows.row.{c}").alias(c) for c in ("part", "page", "n", *payload)])


def read_scans(flow: DataFrame, read: DataFrame) -> DataFrame:
    """Marks of scanned pages replaced by the text read from them, placed on the whole page; a mark whose page could not be read
    goes."""
    texts = read.filter(F.rlike("text", F.lit(r"\S"))).select("doc_id", "page", F.trim("text").alias("_read"))
    scan = F.col("kind") == "ocr"
    rows = flow.join(texts, L.PAGE, "left").filter(~scan | F.col("_read").isNotNull())
    page = F.array(F.struct(F.col("page").cast("int").alias("page"), *[F.lit(v).alias(c) for c, v in (("x", 0.0), ("y", 0.0), ("w", 1.0), ("h", 1.0))]).cast(BOX))
    return rows.withColumns({"text": F.when(scan, F.col("_read")).otherwise(F.col("text")), "boxes": F.when(scan, page).otherwise(F.col("boxes"))}).drop("_read")


def source_map(flow: DataFrame) -> DataFrame:
    """(doc_id, ord, key, boxes): the blocks a reader sees in each text, named by their source, with the text's boxes."""
    at = F.struct("doc_id", "page", "n").alias("_at")
    found = B.markdown_blocks(flow.select(at, "text"), "_at", "text").withColumn("key", X.fnv1a(F.col("raw")))
    found = found.select("_at.*", F.col("ord").alias("_k"), "key").join(flow.select("doc_id", "page", "n", "boxes"), ["doc_id", "page", "n"])
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "n", "_k"))
    return found.select("doc_id", place.alias("ord"), "key", "boxes")


def clean(items: DataFrame, read: DataFrame | None = None) -> Cleaned:
    """The whole chain over page items. `read`: (doc_id, page, text) of scanned pages; without it their marks stay in the content."""
    # Read for the type sizes and again for the edges: worked out once.
    items = pinned(items, "items")
    sizes = pinned(L.body_size(items), "sizes")
    edged = pinned(with_edges(items, sizes).withColumn("boxes", F.array(own_box())), "edged")
    upper, early = L.split_aside(edged)
    ordered = L.reading_order(upper)
    typed = pinned(R.classify(ordered, sizes), "typed")
    flow, late = L.split_aside(typed)
    # On each page: what was set aside on sight in its upper half, what the roles took out, what stood in the lower half.
    half = F.when(F.col("y0") < F.col("page_height") / 2, 0).otherwise(2)
    said = ["role", "confidence", "reason", "boxes", "kind"]
    by_place = F.row_number().over(W.partitionBy(*L.PAGE).orderBy("_half", "y0", "x0", "ord", "text"))
    early = early.withColumn("_half", half).withColumn("n", by_place).select("doc_id", "page", "_half", "n", "text", *said)
    aside = early.unionByName(late.withColumn("_half", F.lit(1)).select("doc_id", "page", "_half", "n", "text", *said))
    aside = aside.withColumn("n", F.row_number().over(W.partitionBy(*L.PAGE).orderBy("_half", "n"))).drop("_half").withColumn("part", F.lit(1))
    whole = L.carry_over(flow).select("doc_id", "page", "n", "text", *said).withColumn("part", F.lit(0))
    texts = pinned(rejoined(whole.unionByName(aside), said), "texts")
    parts = texts.filter("part = 0").select("doc_id", "page", "n", "text", "kind", "boxes")
    if read is not None:
        parts = pinned(read_scans(parts, read), "parts")
    content = L.clean_documents(L.page_texts(parts))
    if read is not None:
        content = content.withColumn("content", F.trim(F.regexp_replace("content", r"\n{3,}", "\n\n")))
    content = content.withColumn("word_count", F.regexp_count("content", F.lit(r"(?U)\w+")))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "n"))
    side = texts.filter("part = 1").select(
        "doc_id", place.alias("ord"), F.col("role").alias("type"), "text", "page", F.get("boxes", F.lit(0)).alias("box"), "confidence", "reason"
    )
    return Cleaned(content, source_map(parts), side, parts.drop("kind"))
