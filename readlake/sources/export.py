"""Sinks: Markdown, BibTeX and CSV as rows of text in their final order, and snapshots of tables.

An export is never gathered into one string: every highlight, note or entry is a row with its sort keys, and
the writer range-partitions on them, so a library of any size is written in parallel and in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.functions import text as X
from readlake.operators.ranking import numbered

QUOTE_CITATION = 200


def quote(text: Column) -> Column:
    """Every line behind a quotation mark."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"(?m)[ \t]*$", ""), r"(?m)^(?=(.?))", "> ")


def hard_breaks(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "\r?\n", "  \n")


def one_line(text: Column) -> Column:
    return X.collapse(text)


def highlight_body(text: Column, page: Column, color: Column, category: Column, note: Column) -> Column:
    meta = F.concat_ws(" · ", F.concat(F.lit("Page "), page.cast("string")), color, category)
    noted = F.concat(F.lit("\n\n**Note:** "), hard_breaks(note))
    return F.concat(
        quote(text), F.lit("\n\n*"), meta, F.lit("*"), F.when(F.length(F.trim(note)) > 0, noted).otherwise("")
    )


def highlights_md(highlights: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, section, page_number, created_at, id, text): each document's heading, then its
    highlights by page and age, with a rule between two of them."""
    order = F.struct(F.coalesce("page_number", F.lit(0)).alias("p"), "created_at", "highlight_id")
    marks = highlights.withColumn("_key", order)
    firsts = marks.groupBy("document_id").agg(F.min("_key").alias("_first"))
    named = documents.join(firsts, "document_id").select("document_id", "_first", "title", "file_type", "url")
    address = F.when(F.col("url").isNotNull(), F.concat(F.lit(" · <"), F.col("url"), F.lit(">"))).otherwise("")
    head = named.select(
        "document_id",
        F.lit(0).alias("section"),
        F.lit(None).cast("struct<p:int,created_at:timestamp_ntz,highlight_id:string>").alias("_key"),
        F.concat(F.lit("## "), one_line(F.col("title")), F.lit("\n\n"), F.upper("file_type"), address).alias("text"),
    )
    body = highlight_body(*(F.col(c) for c in ("selected_text", "page_number", "color", "category", "note")))
    items = marks.join(firsts, "document_id").select(
        "document_id",
        F.lit(1).alias("section"),
        "_key",
        F.concat(F.when(F.col("_key") == F.col("_first"), "").otherwise("---\n\n"), body).alias("text"),
    )
    rows = head.unionByName(items)
    return rows.select(
        "document_id",
        "section",
        F.col("_key.p").alias("page_number"),
        F.col("_key.created_at").alias("created_at"),
        F.col("_key.highlight_id").alias("id"),
        "text",
    )


def notebook_md(documents: DataFrame, highlights: DataFrame, notes: DataFrame) -> DataFrame:
    """One document's notebook and every other's: heading, highlights, own notes, what was kept from the AI."""
    head = documents.select(
        "document_id", F.lit(0).alias("section"), F.lit("").alias("id"), F.concat(F.lit("# "), one_line(F.col("title"))).alias("text")
    )
    marks = highlights.select(
        "document_id",
        F.lit(1).alias("section"),
        F.col("highlight_id").alias("id"),
        highlight_body(*(F.col(c) for c in ("selected_text", "page_number", "color", "category", "note"))).alias("text"),
    )
    kept = F.when(F.col("origin") == "ai_saved", "*Written by AI*\n\n").otherwise("")
    free = notes.select(
        "document_id",
        F.when(F.col("origin") == "user", 2).otherwise(3).alias("section"),
        F.col("note_id").cast("string").alias("id"),
        F.concat(kept, hard_breaks(F.col("body"))).alias("text"),
    )
    content = marks.unionByName(free)
    heads = head.join(content.select("document_id").distinct(), "document_id", "left_semi")
    return heads.unionByName(content)


def citation_line(position: Column, text: Column) -> Column:
    """A kept answer's citation, cut."""
    line = one_line(text)
    cut = F.when(F.length(line) > QUOTE_CITATION, F.concat(F.substring(line, 1, QUOTE_CITATION), F.lit("…"))).otherwise(line)
    return F.concat(F.lit("  \n["), position.cast("string"), F.lit("] “"), cut, F.lit("”"))


# BibTeX entry and container field per kind of work, and LaTeX's special characters.
ENTRY = {
    "article": ("article", "journal"),
    "book": ("book", "series"),
    "chapter": ("incollection", "booktitle"),
    "conference": ("inproceedings", "booktitle"),
    "thesis": ("phdthesis", "school"),
    "report": ("techreport", "institution"),
    "misc": ("misc", "howpublished"),
}


def tex(text: Column) -> Column:
    """Text as LaTeX reads it. The backslash goes through a placeholder, so its braces stay."""
    out = F.regexp_replace(text, r"\\", "\x01")
    out = F.regexp_replace(out, r"([{}%&$#_])", r"\\$1")
    out = F.regexp_replace(F.regexp_replace(out, "~", r"\\textasciitilde{}"), r"\^", r"\\textasciicircum{}")
    return F.regexp_replace(out, "\x01", r"\\textbackslash{}")


def cite_key(family: Column, year: Column, title: Column) -> Column:
    """First author, year, first telling word of the title."""
    author = F.substring(F.regexp_replace(X.ascii_words(F.coalesce(family, F.lit(""))), " ", ""), 1, 20)
    words = F.split(X.ascii_words(title), " ")
    telling = F.coalesce(F.get(F.filter(words, lambda w: F.length(w) > 3), F.lit(0)), F.get(words, F.lit(0)), F.lit(""))
    key = F.concat(author, F.coalesce(year.cast("string"), F.lit("")), F.substring(telling, 1, 20))
    return F.when(key == "", "doc").otherwise(key)


def unique_keys(df: DataFrame, position: str, base: str = "base") -> DataFrame:
    """base, base-2, base-3 … in the caller's order."""
    counted = numbered(df, [base], F.floor(F.col(position) / 10000), [F.col(position)], "_n")
    key = F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat_ws("-", base, F.col("_n").cast("string")))
    return counted.withColumn("key", key).drop("_n")


def bibtex(df: DataFrame, position: str) -> DataFrame:
    """(position, key, entry) for documents with title, url, kind, family, given, year, container,
    publisher, volume, issue, pages and created_at."""
    keyed = unique_keys(df.withColumn("base", cite_key(F.col("family"), F.col("year"), F.col("title"))), position)
    kind = F.coalesce("kind", F.lit("misc"))
    stands_in = kind.isin("thesis", "report") & F.col("container").isNull()
    container = F.when(stands_in, F.col("publisher")).otherwise(F.col("container"))
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in ENTRY.items() for x in (k, v[i])]), kind)
    author = F.when(
        F.length("given") > 0, F.concat(tex(F.col("family")), F.lit(", "), tex(F.col("given")))
    ).otherwise(F.concat(F.lit("{"), tex(F.col("family")), F.lit("}")))
    field = lambda name, value: F.concat(F.lit("  "), name, F.lit(" = {"), value, F.lit("}"))
    day = F.concat(F.lit("Accessed: "), F.date_format("created_at", "yyyy-MM-dd"))
    fields = F.concat_ws(
        ",\n",
        F.when(F.col("family").isNotNull(), field(F.lit("author"), author)),
        field(F.lit("title"), F.concat(F.lit("{"), tex(F.col("title")), F.lit("}"))),
        F.when(container.isNotNull(), field(pick(1), tex(container))),
        F.when(F.col("publisher").isNotNull() & ~stands_in, field(F.lit("publisher"), tex(F.col("publisher")))),
        field(F.lit("year"), F.col("year").cast("string")),
        field(F.lit("volume"), tex(F.col("volume"))),
        field(F.lit("number"), tex(F.col("issue"))),
        field(F.lit("pages"), tex(F.regexp_replace("pages", r"\s*[-–—]+\s*", "--"))),
        field(F.lit("url"), F.regexp_replace("url", "[{}]", "")),
        F.when(F.col("url").isNotNull() & F.col("year").isNull(), field(F.lit("note"), day)),
    )
    entry = F.concat(F.lit("@"), pick(0), F.lit("{"), F.col("key"), F.lit(",\n"), fields, F.lit("\n}"))
    return keyed.select(position, "key", entry.alias("entry"))


def csv_number(value: Column) -> Column:
    """A number in plain digits, never with an exponent: what a cast writes from 1e-3 to 1e7, and the same digits otherwise."""
    text = value.cast("string")
    mantissa, power = F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), F.regexp_extract(text, r"E(-?[0-9]+)$", 1).cast("int")
    digits = F.regexp_replace(mantissa, "[-.]", "")
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), F.rtrim(digits, F.lit("0")))
    whole = F.rpad(digits, F.greatest(power + 1, F.length(digits)), "0")
    big = F.concat(sign, F.substr(whole, F.lit(1), power + 1), F.lit("."), F.coalesce(F.nullif(F.rtrim(F.substr(whole, power + 2), F.lit("0")), F.lit("")), F.lit("0")))
    return F.when(~F.contains(text, F.lit("E")), text).when(power < 0, small).otherwise(big)


def csv_cell(value: Column) -> Column:
    text = value.cast("string")
    quoted = F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))
    return F.when(F.rlike(text, F.lit('[",\n]')), quoted).otherwise(text)


def chart_csv(charts: DataFrame, key: str) -> DataFrame:
    """(key, panel, ord, line): the header, then one line per point; every point is a row of its own."""
    panels = charts.select(key, F.posexplode("panels").alias("panel", "p"))
    title = lambda axis, plain: F.when(F.length(F.col(f"p.{axis}.title")) > 0, F.col(f"p.{axis}.title")).otherwise(plain)
    head = panels.select(
        key,
        "panel",
        F.lit(0).cast("bigint").alias("ord"),
        F.concat_ws(",", F.lit("series"), csv_cell(title("x", "x")), csv_cell(title("y", "y"))).alias("line"),
    )
    series = panels.select(key, "panel", F.posexplode("p.series").alias("s", "series"))
    points = series.select(key, "panel", "s", "series.name", F.posexplode("series.points").alias("i", "pt"))
    name = F.when(F.length("name") > 0, F.col("name")).otherwise((F.col("s") + 1).cast("string"))
    body = points.select(
        key,
        "panel",
        (F.col("s") * 1_000_000_000 + F.col("i") + 1).cast("bigint").alias("ord"),
        F.concat_ws(",", csv_cell(name), csv_number(F.get("pt", F.lit(0))), csv_number(F.get("pt", F.lit(1)))).alias("line"),
    )
    return head.unionByName(body)


def write_lines(rows: DataFrame, order: list[str], text: str, path: str) -> None:
    """The rows' text in order, as text files whose names sort the same way."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(text).write.mode("overwrite").text(path)


def write_by_document(rows: DataFrame, order: list[str], text: str, path: str) -> None:
    """One folder per document; a document's rows are spread by range, so none is one task's burden."""
    ranged = rows.repartitionByRange("document_id", *order).sortWithinPartitions("document_id", *order)
    ranged.select("document_id", text).write.mode("overwrite").partitionBy("document_id").text(path)


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """The table's next state, complete at `path` or not there: written beside it, then renamed."""
    spark = df.sparkSession
    jvm = spark._jvm
    staging = path.rstrip("/") + ".next"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging)
    target, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staging)
    fs = fresh.getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".old")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
