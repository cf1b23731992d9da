"""Sources: files landed for reading, EPUB chapters, catalogues, annotations brought in from elsewhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.functions import scalars as S
from readlake.functions import text as X

MAX_BYTES = 50 * 1024 * 1024
MAX_ENTRIES, MAX_UNPACKED, MIN_CHAPTER = 5000, 300 * 1024 * 1024, 50
# Words in an EPUB element's class, id or type that mark it as no text to read.
JUNK = ("pagebreak", "footnote-backlink", "toc", "copyright-page", "titlepage", "cover")


def landing(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a folder of uploads. Size and name are tested on the listing; only files that pass
    have their first bytes looked at."""
    files = spark.read.format("binaryFile").load(path)
    name = S.safe_name(F.col("path"))
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    head = F.substring("content", 1, 100)
    pdf = F.hex(F.substring("content", 1, 4)) == "25504446"
    epub = (F.hex(F.substring("content", 1, 4)) == "504B0304") & F.contains(F.decode(head, "ISO-8859-1"), F.lit("mimetypeapplication/epub+zip"))
    why = (
        F.when(~suffix.isin(".pdf", ".epub"), "type").when(F.col("length") > MAX_BYTES, "size")
        .when((suffix == ".pdf") & ~pdf, "content").when((suffix == ".epub") & ~epub, "content")
    )
    judged = files.withColumn("name", name).withColumn("problem", why)
    return judged.filter("problem IS NULL").drop("problem"), judged.filter("problem IS NOT NULL").select("path", "name", "length", "problem")


def _chapters(content: bytes) -> tuple[str | None, list[tuple[int, str, str]]]:
    """(problem, chapters): (number, title, html) of the spine, or why the book cannot be read (broken, encrypted, too many
    entries, too large unpacked)."""
    import io
    import posixpath
    import xml.etree.ElementTree as ET
    import zipfile

    def named(root, tag):
        return [e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == tag]

    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        entries = book.infolist()
        names = {e.filename for e in entries}
        problems = {
            "encrypted": "META-INF/encryption.xml" in names,
            "entries": len(entries) > MAX_ENTRIES,
            "size": sum(e.file_size for e in entries) > MAX_UNPACKED,
        }
        for problem, there in problems.items():
            if there:
                return problem, []
        opf = named(ET.fromstring(book.read("META-INF/container.xml")), "rootfile")[0].get("full-path")
        package = ET.fromstring(book.read(opf))
    except (zipfile.BadZipFile, KeyError, IndexError, ET.ParseError, OSError):
        return "broken", []
    base = posixpath.dirname(opf)
    title = next((t.text.strip() for t in named(package, "title") if t.text and t.text.strip()), "")
    items = {i.get("id"): i for i in named(package, "item")}
    out = []
    for ref in named(package, "itemref"):
        item = items.get(ref.get("idref"))
        if item is None or "html" not in item.get("media-type", "") or "nav" in item.get("properties", "").split():
            continue
        href = posixpath.normpath(posixpath.join(base, item.get("href", "")))
        if href in names:
            out.append((len(out) + 1, title, book.read(href).decode("utf-8", "replace")))
    return None if out else "empty", out


def epub_read(files: DataFrame) -> DataFrame:
    """(path, chapter, title, text, problem): every chapter, its junk elements dropped, with `short` where it has too few letters to
    be worth reading; a book that cannot be read is one row with the reason and no chapter."""
    from readlake.operators.web import STRIP_TAGS
    from readlake.sources.html import page_rows, to_markdown

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["node", "path", "tag", "hint", "hidden", "text", "attrs"]
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                problem, chapters = _chapters(content)
                if problem:
                    out.append((path, None, None, None, problem))
                for number, title, html in chapters:
                    rows = [dict(zip(names, r, strict=True)) for r in page_rows(html)]
                    bad = {r["node"] for r in rows if r["tag"] in STRIP_TAGS or any(j in r["hint"].lower() for j in JUNK)}
                    kept = [r for r in rows if bad.isdisjoint(r["path"])]
                    body = next((r["node"] for r in kept if r["tag"] == "body"), 0)
                    text = to_markdown([r for r in kept if body in r["path"]], body, "") if kept else ""
                    out.append((path, number, title, text, None if len(text) >= MIN_CHAPTER else "short"))
            frame = pd.DataFrame(out, columns=["path", "chapter", "title", "text", "problem"])
            yield frame.astype({"chapter": "Int32"})

    return files.select("path", "content").mapInPandas(read, "path STRING, chapter INT, title STRING, text STRING, problem STRING")


def epub_chapters(files: DataFrame) -> DataFrame:
    """(path, chapter, title, text): one row per chapter worth reading; `epub_rejects` has the rest."""
    return epub_read(files).filter("problem IS NULL").drop("problem")


def epub_rejects(files: DataFrame) -> DataFrame:
    """(path, chapter, problem): books that cannot be read (no chapter) and chapters too short to be read."""
    return epub_read(files).filter("problem IS NOT NULL").select("path", "chapter", "problem")


def epub_documents(chapters: DataFrame) -> DataFrame:
    """(path, title, content, word_count): a book's chapters joined in order."""
    rows = chapters.groupBy("path").agg(F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("chapter", "text"))).alias("_c"))
    body = F.array_join(F.transform("_c", lambda c: c["text"]), "\n\n")
    return rows.select("path", "title", body.alias("content"), X.word_count(body).alias("word_count"))


CATALOG = (
    "updated_at STRING, articles ARRAY<STRUCT<url: STRING, title: STRING, source: STRING, license: STRING, "
    "language: STRING, kind: STRING, topics: ARRAY<STRING>, summary: STRING>>"
)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per article of a catalogue file."""
    read = spark.read.schema(CATALOG).option("multiLine", True).json(path)
    return read.select("updated_at", F.explode("articles").alias("a")).select("updated_at", "a.*")


def catalog_report(spark: SparkSession, path: str) -> DataFrame:
    """(by, key, n) of a catalogue's counts."""
    read = spark.read.schema("by_topic MAP<STRING, BIGINT>, by_kind MAP<STRING, BIGINT>").option("multiLine", True).json(path)
    side = lambda c: read.select(F.lit(c[3:]).alias("by"), F.explode(c).alias("key", "n"))
    return side("by_topic").unionByName(side("by_kind"))


IMPORT = (
    "STRUCT<highlights: ARRAY<STRUCT<id: STRING, document_id: STRING, text: STRING, color: STRING, note: STRING, page: INT>>, "
    "notes: MAP<STRING, STRING>, progress: MAP<STRING, DOUBLE>>"
)


def import_annotations(payloads: DataFrame, documents: DataFrame, highlights: DataFrame, notes: DataFrame) -> dict[str, DataFrame]:
    """What a person's annotations kept elsewhere add: highlights and notes not yet there, progress further on, and
    the documents they do not own. `payloads` holds (user_id, payload JSON); any number of people at once."""
    p = payloads.select("user_id", F.from_json("payload", IMPORT).alias("p"))
    owned = documents.select("user_id", F.col("document_id").cast("string").alias("document_id"))
    marks = p.select("user_id", F.explode("p.highlights").alias("h")).select("user_id", "h.*")
    texts = p.select("user_id", F.explode("p.notes").alias("document_id", "body")).filter("trim(body) <> ''")
    read = p.select("user_id", F.explode("p.progress").alias("document_id", "fraction"))
    at = ["user_id", "document_id"]
    every = marks.select(*at).union(texts.select(*at)).union(read.select(*at)).distinct()
    further = read.join(documents.select("user_id", F.col("document_id").cast("string").alias("document_id"), "read_fraction"), at)
    return {
        "highlights": marks.dropDuplicates(["id"]).join(owned, at, "left_semi").join(highlights.select("id"), "id", "left_anti"),
        "notes": texts.join(owned, at, "left_semi").join(notes.select(*at, "body"), [*at, "body"], "left_anti"),
        "progress": further.filter(F.col("fraction") > F.coalesce("read_fraction", F.lit(0.0))).select(*at, F.least("fraction", F.lit(1.0)).alias("fraction")),
        "unknown": every.join(owned, at, "left_anti"),
    }
