"""Passages: the clean text cut on paragraph boundaries under its headings, stubs folded into what follows.

The packing is greedy, so it is a fold over one text's own paragraphs. It runs inside a projection (no
shuffle, no Python): the fold keeps only where passages start, and the passages are then sliced out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.functions import scalars as S
from readlake.functions import text as X

PAGE_BREAK = "\n\n---\n\n"
MIN_CHUNK_CHARS = 120
CHARS_PER_TOKEN = 3
HEADING = r"^#{1,6}\s+(.+?)\s*#*\s*$"
IMAGE_LINE = r"(?m)^[ \t]*!\[[^\]\n]*\]\([^)\s]+\)[ \t]*(?:\n|$)"

_int = lambda v: F.lit(v).cast("int")


def strip_images(text: Column) -> Column:
    """Image lines out, blank runs closed."""
    return F.regexp_replace(F.regexp_replace(text, IMAGE_LINE, ""), r"\n{3,}", "\n\n")


def with_figures(text: Column, notes: Column, scheme: str = X.PICTURES) -> Column:
    """Image lines replaced by the note known for them (a map of image name to text), the rest dropped. Stored pictures are
    named `scheme:name`."""
    entries = F.map_entries(F.coalesce(notes, F.create_map().cast("map<string,string>")))
    # A known picture's line becomes its text; a name is the digest of the picture, so it has no special marks.
    told = F.aggregate(
        entries,
        text,
        lambda acc, e: F.regexp_replace(
            acc,
            F.concat(F.lit(rf"(?m)^[ \t]*!\[[^\]\n]*\]\({scheme}:"), F.regexp_replace(e["key"], r"([.])", r"\\$1"), F.lit(r"\)[ \t]*$")),
            F.concat(F.lit("[Figure: "), F.regexp_replace(e["value"], r"([\\$])", r"\\$1"), F.lit("]")),
        ),
    )
    return strip_images(told)


def clean_heading(para: Column) -> Column:
    words = F.substring(F.trim(F.regexp_replace(F.regexp_extract(para, HEADING, 1), r"[*_`]", "")), 1, 255)
    return F.nullif(words, F.lit(""))


def paragraphs(text: Column) -> Column:
    """Non-empty paragraphs, page marks left out."""
    parts = F.transform(F.split(text, r"\n{2,}"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: (p != "") & (p != "---"))


def pages(text: Column) -> Column:
    """Non-blank pages, images dropped."""
    kept = F.filter(F.split(text, PAGE_BREAK), lambda p: F.rlike(p, F.lit(r"\S")))
    return F.transform(kept, strip_images)


def _pieces(page_list: Column, limit: int) -> Column:
    """Each page's paragraphs, those over the limit in pieces, with what forces a new passage."""

    def of_page(page: Column, number: Column) -> Column:
        def of_para(para: Column) -> Column:
            size = F.length(para)
            count = F.greatest(F.ceil(size / limit).cast("int"), _int(1))
            head = clean_heading(para)
            return F.transform(
                F.sequence(_int(0), count - 1),
                lambda k: F.struct(
                    number.cast("int").alias("page"),
                    F.substr(para, k * limit + 1, F.lit(limit)).alias("text"),
                    head.alias("section"),
                    (head.isNotNull() | (size > limit)).alias("forced"),
                ),
            )

        return F.flatten(F.transform(paragraphs(page), of_para))

    return F.flatten(F.transform(page_list, of_page))


def _starts(pieces: Column, limit: int) -> Column:
    """Indexes (from 0) of the pieces that open a passage."""

    def step(acc: Column, p: Column) -> Column:
        full = acc["size"] + F.length(p["text"]) > limit
        opens = p["forced"] | full | (acc["page"] != p["page"])
        return F.struct(
            (acc["i"] + 1).alias("i"),
            p["page"].alias("page"),
            F.when(opens, F.length(p["text"]) + 2).otherwise(acc["size"] + F.length(p["text"]) + 2).alias("size"),
            F.when(opens, F.concat(acc["at"], F.array(acc["i"]))).otherwise(acc["at"]).alias("at"),
        )

    zero = F.struct(
        _int(0).alias("i"), _int(-1).alias("page"), _int(0).alias("size"), F.array().cast("array<int>").alias("at")
    )
    return F.aggregate(pieces, zero, step, lambda acc: acc["at"])


def _passages(pieces: Column, starts: Column, numbered: Column) -> Column:
    """The passages between the starts, each under the heading in force where it opens."""
    def one(at: Column, n: Column) -> Column:
        end = F.coalesce(F.get(starts, n + 1), F.size(pieces))
        run = F.slice(pieces, at + 1, end - at)
        first = F.get(pieces, at)
        titled = F.filter(F.slice(pieces, _int(1), at + 1), lambda p: p["section"].isNotNull())
        return F.struct(
            F.when(numbered, first["page"] + 1).alias("page_number"),
            F.get(titled, F.size(titled) - 1)["section"].alias("heading"),
            F.array_join(F.transform(run, lambda p: p["text"]), "\n\n").alias("text"),
        )

    return F.transform(starts, one)


def _ends(passages: Column) -> Column:
    """Indexes of the passages that close one: not a stub, or nothing follows on the same page."""

    def step(acc: Column, c: Column) -> Column:
        size = acc["size"] + F.length(c["text"])
        following = F.get(passages, acc["i"] + 1)
        same = following.isNotNull() & following["page_number"].eqNullSafe(c["page_number"])
        carry = (size < MIN_CHUNK_CHARS) & same
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(carry, size).otherwise(_int(0)).alias("size"),
            F.when(carry, acc["at"]).otherwise(F.concat(acc["at"], F.array(acc["i"]))).alias("at"),
        )

    zero = F.struct(_int(0).alias("i"), _int(0).alias("size"), F.array().cast("array<int>").alias("at"))
    return F.aggregate(passages, zero, step, lambda acc: acc["at"])


def split(df: DataFrame, key: str, text: str, max_tokens: int = 400, page_count: str | None = None) -> DataFrame:
    """(key, position, page_number, heading, text, token_count): one row per passage."""
    limit = max_tokens * CHARS_PER_TOKEN
    count = F.col(page_count) if page_count else F.lit(None).cast("int")
    # Each stage is its own column, so a text is cut once and not once per mention of the result.
    out = df.select(key, pages(F.col(text)).alias("_pages"), count.alias("_count"))
    out = out.select(key, (F.size("_pages") == F.col("_count")).alias("_numbered"), _pieces(F.col("_pages"), limit).alias("_pieces"))
    out = out.select("*", _starts(F.col("_pieces"), limit).alias("_starts"))
    numbered = F.coalesce("_numbered", F.lit(False))
    out = out.select(key, _passages(F.col("_pieces"), F.col("_starts"), numbered).alias("_cut"))
    out = out.select(key, "_cut", _ends(F.col("_cut")).alias("_ends"))
    cut, ends = F.col("_cut"), F.col("_ends")

    def merged(end: Column, n: Column) -> Column:
        start = F.when(n == 0, _int(0)).otherwise(F.get(ends, n - 1) + 1)
        last = F.get(cut, end)
        body = F.array_join(F.transform(F.slice(cut, start + 1, end - start + 1), lambda c: c["text"]), "\n\n")
        return F.struct(
            (n + 1).cast("int").alias("position"), last["page_number"].alias("page_number"), last["heading"].alias("heading"), body.alias("text")
        )

    rows = out.select(key, F.explode(F.transform(ends, merged)).alias("c")).select(key, "c.*")
    return rows.withColumn("token_count", X.token_estimate(F.col("text")))


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("labelled", S.label_passage(F.col("heading"), F.col("text")))


def groups(df: DataFrame, key: str, max_tokens: int) -> DataFrame:
    """Passages of a document grouped in order under a token budget: adds `group`. One document's token
    counts are folded; its texts stay where they are until the group numbers are joined."""
    sizes = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "token_count"))).alias("_s"))

    def step(acc: Column, c: Column) -> Column:
        opens = (acc["size"] > 0) & (acc["size"] + c["token_count"] > max_tokens)
        return F.struct(
            F.when(opens, c["token_count"]).otherwise(acc["size"] + c["token_count"]).alias("size"),
            F.when(opens, F.concat(acc["at"], F.array(c["position"]))).otherwise(acc["at"]).alias("at"),
        )

    zero = F.struct(_int(0).alias("size"), F.array().cast("array<int>").alias("at"))
    cuts = sizes.select(key, F.aggregate("_s", zero, step, lambda a: a["at"]).alias("_cuts"))
    joined = df.join(cuts, key)
    return joined.withColumn("group", F.size(F.filter("_cuts", lambda c: c <= F.col("position"))) + 1).drop("_cuts")


def parts(df: DataFrame, key: str, text: str, max_tokens: int) -> DataFrame:
    """(key, part, text): parts for condensing. A heading opens a part once one is half full; a paragraph too
    long for any part fills this one and goes on in the next."""
    limit = max_tokens * CHARS_PER_TOKEN
    out = df.select(key, paragraphs(F.col(text)).alias("_p"))

    def step(acc: Column, para: Column) -> Column:
        n = F.length(para)
        heading = F.startswith(para, F.lit("#")) & (acc["size"] >= limit // 2)
        fresh = (acc["size"] > 0) & (heading | ((acc["size"] + n > limit) & (n <= limit)))
        size = F.when(fresh, _int(0)).otherwise(acc["size"])
        room = F.greatest(limit - size, _int(1))
        spills = size + n > limit
        last = room + F.greatest(F.ceil((n - room) / limit).cast("int") - 1, _int(0)) * limit
        offsets = F.when(spills, F.sequence(room, last, _int(limit))).otherwise(F.array().cast("array<int>"))
        cuts = F.transform(offsets, lambda o: F.struct(acc["i"].alias("p"), o.alias("o")))
        opened = F.when(
            fresh, F.concat(acc["cuts"], F.array(F.struct(acc["i"].alias("p"), _int(0).alias("o"))))
        ).otherwise(acc["cuts"])
        rest = F.when(spills, n - last).otherwise(n)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(spills, F.when(rest > 0, rest + 2).otherwise(_int(0))).otherwise(size + n + 2).alias("size"),
            F.concat(opened, cuts).alias("cuts"),
        )

    zero = F.struct(
        _int(0).alias("i"), _int(0).alias("size"), F.array().cast("array<struct<p:int,o:int>>").alias("cuts")
    )
    out = out.select(key, "_p", F.aggregate("_p", zero, step, lambda a: a["cuts"]).alias("_c"))
    begin = F.struct(_int(0).alias("p"), _int(0).alias("o"))
    end = F.struct(F.size("_p").alias("p"), _int(0).alias("o"))
    out = out.select(key, "_p", F.concat(F.array(begin), F.col("_c"), F.array(end)).alias("_c"))

    def one(n: Column) -> Column:
        a, z = F.get("_c", n), F.get("_c", n + 1)
        run = F.sequence(a["p"], F.greatest(a["p"], F.when(z["o"] > 0, z["p"]).otherwise(z["p"] - 1)))

        def cut(i: Column) -> Column:
            para = F.get("_p", i)
            start = F.when(i == a["p"], a["o"]).otherwise(_int(0))
            stop = F.when((i == z["p"]) & (z["o"] > 0), z["o"]).otherwise(F.length(para))
            return F.substr(para, start + 1, stop - start)

        pieces = F.filter(F.transform(run, cut), lambda s: s != "")
        return F.array_join(pieces, "\n\n")

    whole = F.transform(F.sequence(_int(0), F.size("_c") - 2), one)
    rows = out.filter(F.size("_p") > 0).select(key, F.posexplode(F.filter(whole, lambda s: s != "")).alias("part", "text"))
    return rows.withColumn("part", F.col("part") + 1)


def stale_documents(documents: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Documents whose digest or embedding model is not the indexed one: only these are cut again."""
    return documents.join(indexed.select(key, "digest", "model"), [key, "digest", "model"], "left_anti")
