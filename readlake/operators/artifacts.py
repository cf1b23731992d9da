"""Generated results: read from JSON, checked against the passages they cite, kept as notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.functions import text as X
from readlake.functions import urls as U

MAX_CITATION, MAX_SOURCES, MAX_POINT = 600, 4, 1200
MIN_TAKEAWAYS, MAX_TAKEAWAYS = 3, 5
MAX_POINTS, MIN_DEEP, MAX_QUESTIONS = 8, 3, 5
MAX_ANALYSIS, MIN_ANALYSIS = 6, 2
SECTIONS = ("context", "core", "findings", "limitations")
FIELDS = ("question", "method", "data", "findings", "limitations", "applicability")
TYPES, RESEARCH = ("research", "report", "essay", "book", "guide", "other"), ("research", "report")
MAX_CANDIDATES, MAX_PICKS = 12, 5
KINDS = ("article", "report", "paper", "book", "other")

POINT = "STRUCT<text: STRING, sources: ARRAY<STRING>>"
QUICK = f"tldr STRING, tldr_sources ARRAY<STRING>, takeaways ARRAY<{POINT}>"
DEEP = f"document_type STRING, questions ARRAY<STRING>, {', '.join(f'{s} ARRAY<{POINT}>' for s in SECTIONS)}"
ANALYSIS = f"document_type STRING, {', '.join(f'{s} ARRAY<{POINT}>' for s in FIELDS)}"
SUMMARY = "key_points ARRAY<STRING>, concepts ARRAY<STRUCT<term: STRING, explanation: STRING>>, conclusion STRING, keywords ARRAY<STRING>"

_none = lambda kind: F.array().cast(f"array<{kind}>")


def sources(value: Column, total: Column) -> Column:
    """Passage numbers that exist, each once, at most four."""
    whole = F.filter(F.coalesce(value, _none("string")), lambda s: F.rlike(s, F.lit("^[0-9]{1,9}$")))
    known = F.filter(F.transform(whole, lambda s: s.cast("int")), lambda n: (n >= 1) & (n <= total))
    return F.slice(F.array_distinct(known), 1, MAX_SOURCES)


def points(value: Column, total: Column, limit: int) -> Column:
    """Points with words, cleaned, each with its sources."""
    made = F.transform(
        F.coalesce(value, _none(POINT)),
        lambda p: F.struct(X.clean_line(p["text"], MAX_POINT).alias("text"), sources(p["sources"], total).alias("sources")),
    )
    return F.slice(F.filter(made, lambda p: p["text"] != ""), 1, limit)


def _cite(lists: Column) -> Column:
    """The passages used, in order of first use."""
    return F.array_distinct(F.flatten(lists))


def _renumber(sources_: Column, order: Column) -> Column:
    return F.transform(sources_, lambda n: F.array_position(order, n).cast("int"))


def _renumbered(points_: Column, order: Column) -> Column:
    return F.transform(points_, lambda p: F.struct(p["text"].alias("text"), _renumber(p["sources"], order).alias("sources")))


def parse_quick(df: DataFrame, body: str = "body", total: str = "total") -> DataFrame:
    """Adds tldr, tldr_sources, takeaways, cited and problem (null when the result stands)."""
    out = df.withColumn("_d", F.from_json(F.col(body), QUICK))
    out = out.withColumn("tldr", X.clean_line(F.col("_d.tldr"), MAX_POINT)).withColumn("_ts", sources(F.col("_d.tldr_sources"), F.col(total)))
    out = out.withColumn("_pts", points(F.col("_d.takeaways"), F.col(total), MAX_TAKEAWAYS))
    out = out.withColumn("cited", _cite(F.concat(F.array("_ts"), F.transform("_pts", lambda p: p["sources"]))))
    few = (F.col("tldr") == "") | (F.size("_pts") < MIN_TAKEAWAYS)
    problem = F.when(F.try_parse_json(F.col(body)).isNull(), "not JSON").when(few, "schema mismatch").when(F.size("cited") == 0, "no citations")
    out = out.withColumn("problem", problem).withColumn("tldr_sources", _renumber(F.col("_ts"), F.col("cited")))
    return out.withColumn("takeaways", _renumbered(F.col("_pts"), F.col("cited"))).drop("_d", "_ts", "_pts")


def _sections(df: DataFrame, schema: str, names: tuple, limit: int, least: int, counted: tuple, body: str, total: str) -> DataFrame:
    out = df.withColumn("_d", F.from_json(F.col(body), schema))
    for name in names:
        out = out.withColumn(f"_{name}", points(F.col(f"_d.{name}"), F.col(total), limit))
    lists = F.flatten(F.array(*(F.transform(f"_{n}", lambda p: p["sources"]) for n in names)))
    out = out.withColumn("cited", _cite(lists))
    enough = sum((F.size(f"_{n}") for n in counted), F.lit(0)) >= least
    kind = F.when(F.col("_d.document_type").isin(*TYPES), F.col("_d.document_type")).otherwise("other")
    out = out.withColumn("document_type", kind)
    problem = F.when(F.try_parse_json(F.col(body)).isNull(), "not JSON").when(~enough, "schema mismatch").when(F.size("cited") == 0, "no citations")
    out = out.withColumn("problem", problem)
    for name in names:
        out = out.withColumn(name, _renumbered(F.col(f"_{name}"), F.col("cited")))
    return out.drop(*(f"_{n}" for n in names))


def parse_deep(df: DataFrame, body: str = "body", total: str = "total") -> DataFrame:
    out = _sections(df, DEEP, SECTIONS, MAX_POINTS, MIN_DEEP, SECTIONS[:3], body, total)
    asked = F.transform(F.coalesce("_d.questions", _none("string")), lambda q: X.clean_line(q, 400))
    return out.withColumn("questions", F.slice(F.filter(asked, lambda q: q != ""), 1, MAX_QUESTIONS)).drop("_d")


def parse_analysis(df: DataFrame, body: str = "body", total: str = "total") -> DataFrame:
    """As the others; a document that is no study or report has no analysis."""
    out = _sections(df, ANALYSIS, FIELDS, MAX_ANALYSIS, MIN_ANALYSIS, FIELDS[:4], body, total).drop("_d")
    other = ~F.col("document_type").isin(*RESEARCH) & (F.coalesce("problem", F.lit("")) != "not JSON")
    return out.withColumn("problem", F.when(other, "not research").otherwise(F.col("problem")))


def parse_summary(df: DataFrame, body: str = "body", most: tuple = (10, 15, 10)) -> DataFrame:
    """Key points, concepts with both halves, conclusion, keywords once whatever their case."""
    d = F.from_json(F.col(body), SUMMARY)
    said = lambda v: F.filter(F.transform(F.coalesce(v, _none("string")), lambda s: F.trim(s)), lambda s: s != "")
    words = said(F.col("_d.keywords"))
    once = F.aggregate(
        words, _none("string"),
        lambda acc, k: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(k)), acc).otherwise(F.concat(acc, F.array(k))),
    )
    pairs = F.transform(
        F.coalesce("_d.concepts", _none("struct<term:string,explanation:string>")),
        lambda c: F.struct(F.trim(c["term"]).alias("term"), F.trim(c["explanation"]).alias("explanation")),
    )
    return df.withColumn("_d", d).select(
        *df.columns,
        F.slice(said(F.col("_d.key_points")), 1, most[0]).alias("key_points"),
        F.slice(F.filter(pairs, lambda c: (c["term"] != "") & (c["explanation"] != "")), 1, most[1]).alias("concepts"),
        F.trim(F.coalesce("_d.conclusion", F.lit(""))).alias("conclusion"),
        F.slice(once, 1, most[2]).alias("keywords"),
    )


def quick_text(df: DataFrame) -> Column:
    return F.array_join(F.concat(F.array("tldr"), F.transform("takeaways", lambda p: p["text"])), "\n")


def sections_text(names: tuple, questions: Column | None = None) -> Column:
    texts = F.flatten(F.array(*(F.transform(n, lambda p: p["text"]) for n in names)))
    return F.array_join(F.concat(texts, questions) if questions is not None else texts, "\n")


def marked(text: Column, numbers: Column) -> Column:
    """The sentence with its citations after it."""
    refs = F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")
    return F.when(F.size(numbers) > 0, F.concat(text, F.lit(" "), refs)).otherwise(text)


def quick_note(part: Column) -> Column:
    """The text of one piece of a quick result: tldr, takeaway:<i> or all; null for no such piece."""
    head = marked(F.col("tldr"), F.col("tldr_sources"))
    i = F.split_part(part, F.lit(":"), F.lit(2)).try_cast("int")
    one = F.get("takeaways", i)
    lines = F.transform("takeaways", lambda p: F.concat(F.lit("- "), marked(p["text"], p["sources"])))
    return (
        F.when(part == "tldr", head)
        .when(F.startswith(part, F.lit("takeaway:")) & one.isNotNull(), marked(one["text"], one["sources"]))
        .when(part == "all", F.concat(head, F.lit("\n\n"), F.array_join(lines, "\n")))
    )


# The headings a kept result is written under.
HEADINGS = {
    "context": "Context", "core": "Core arguments", "method": "Methodology", "findings": "Key findings and evidence",
    "limitations": "Limitations and uncertainties", "questions": "Further questions (suggested by AI)",
    "question": "Research question", "data": "Sample and data", "applicability": "Applicability",
}


def section_note(part: Column, names: tuple, questions: str | None = None) -> Column:
    """The text of <section>:<i>, question:<i> or all of a deep result or an analysis."""
    out = F.lit(None).cast("string")
    i = F.split_part(part, F.lit(":"), F.lit(2)).try_cast("int")
    blocks = []
    for n in names:
        one = F.get(n, i)
        out = F.when(F.startswith(part, F.lit(n + ":")) & one.isNotNull(), marked(one["text"], one["sources"])).otherwise(out)
        title = F.lit(HEADINGS[n])
        if n == "core":
            title = F.when(F.col("document_type") == "research", HEADINGS["method"]).otherwise(HEADINGS["core"])
        lines = F.array_join(F.transform(n, lambda p: F.concat(F.lit("- "), marked(p["text"], p["sources"]))), "\n")
        blocks.append(F.when(F.size(n) > 0, F.concat(title, F.lit("\n"), lines)))
    if questions:
        out = F.when(F.startswith(part, F.lit("question:")) & F.get(questions, i).isNotNull(), F.get(questions, i)).otherwise(out)
        asked = F.array_join(F.transform(questions, lambda q: F.concat(F.lit("- "), q)), "\n")
        blocks.append(F.when(F.size(questions) > 0, F.concat(F.lit(HEADINGS["questions"] + "\n"), asked)))
    return F.when(part == "all", F.concat_ws("\n\n", *blocks)).otherwise(out)


def citations(results: DataFrame, passages: DataFrame, key: str = "result_id") -> DataFrame:
    """(key, position, page_number, heading, text): the passages each result cites, numbered by first use."""
    used = results.select(key, "document_id", F.posexplode("cited").alias("i", "_n"))
    cols = passages.select("document_id", F.col("position").alias("_n"), "page_number", "heading", F.substring("text", 1, MAX_CITATION).alias("text"))
    return used.join(cols, ["document_id", "_n"]).select(key, (F.col("i") + 1).alias("position"), "page_number", "heading", "text")


def save_key(source: Column, key: Column, part: Column) -> Column:
    return F.concat_ws(":", source, key, part)


def unsaved(saves: DataFrame, notes: DataFrame) -> DataFrame:
    """Pieces not kept as a note before: once per person and key."""
    return saves.dropDuplicates(["user_id", "source_key"]).join(notes.select("user_id", "source_key"), ["user_id", "source_key"], "left_anti")


ANNOTATION = "STRUCT<type: STRING, url: STRING, title: STRING, start_index: INT, end_index: INT>"
ANSWER = f"output ARRAY<STRUCT<type: STRING, content: ARRAY<STRUCT<text: STRING, annotations: ARRAY<{ANNOTATION}>>>>>"


def search_candidates(answers: DataFrame, key: str = "query_id", body: str = "body") -> DataFrame:
    """(key, number, url, title): the pages a search answer cites, each once, in order, at most twelve."""
    from readlake.operators.ranking import newest_per_key

    d = answers.select(key, F.posexplode(F.from_json(body, ANSWER)["output"]).alias("i", "m")).filter("m.type = 'message'")
    parts = d.select(key, "i", F.posexplode("m.content").alias("j", "p"))
    marks = parts.select(key, "i", "j", F.explode("p.annotations").alias("a")).filter("a.type = 'url_citation'")
    rows = marks.withColumn("url", U.clean_url(F.col("a.url"))).filter("url IS NOT NULL").withColumn("_same", U.same_page_key(F.col("url")))
    order = F.struct("i", "j", F.coalesce("a.start_index", F.lit(0)), "url")
    once = rows.groupBy(key, "_same").agg(F.min(order).alias("_o"), F.min_by(F.struct("url", F.col("a.title").alias("title")), order).alias("r"))
    kept = newest_per_key(once, [key], ["_o"], MAX_CANDIDATES)
    from pyspark.sql.window import Window as W

    numbered = kept.withColumn("number", F.row_number().over(W.partitionBy(key).orderBy("_o")))
    return numbered.select(key, "number", "r.url", U.tidy_title(F.col("r.title"), F.col("r.url")).alias("title"))


CHOICE = "documents ARRAY<STRUCT<number: STRING, source: STRING, authors: STRING, year: STRING, kind: STRING, summary: STRING, reason: STRING>>"


def choices(df: DataFrame, candidates: DataFrame, key: str = "query_id", body: str = "body") -> DataFrame:
    """(key, rank, url, title, source, authors, year, kind, summary, reason): chosen candidates that exist, each
    once, at most five."""
    from pyspark.sql.window import Window as W

    rows = df.select(key, F.posexplode(F.from_json(body, CHOICE)["documents"]).alias("pos", "d"))
    rows = rows.withColumn("number", F.when(F.rlike("d.number", F.lit("^[0-9]{1,6}$")), F.col("d.number").cast("int")))
    known = rows.join(candidates.select(key, "number", "url", "title"), [key, "number"])
    once = known.groupBy(key, "number", "url", "title").agg(F.min(F.struct("pos", "d")).alias("f"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("f.pos"))).filter(F.col("rank") <= MAX_PICKS)
    cut = lambda c, n: F.substring(F.trim(F.coalesce(F.col(f"f.d.{c}"), F.lit(""))), 1, n).alias(c)
    year = F.col("f.d.year").try_cast("int")
    return ranked.select(
        key, "rank", "url", "title", cut("source", 200), cut("authors", 300), F.when(year.between(1000, 2100), year).alias("year"),
        F.when(F.col("f.d.kind").isin(*KINDS), F.col("f.d.kind")).otherwise("other").alias("kind"), cut("summary", 600), cut("reason", 400),
    )


def numbers_in(text: Column) -> Column:
    """The numbers of a table as a reading has them."""
    return F.regexp_extract_all(text, F.lit(r"([0-9]+(?:[.,][0-9]+)*)"), F.lit(1))


def markdown_table(text: Column) -> Column:
    """A Markdown table with every row as wide as the widest; null when it is no table."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda r: F.trim(r)), lambda r: r != "")
    is_table = (F.size(rows) >= 3) & F.forall(rows, lambda r: F.startswith(r, F.lit("|"))) & F.rlike(F.get(rows, F.lit(1)), F.lit(r"^\|[\s:|-]+\|?$"))
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(c)))
    wide = F.array_max(F.transform(cells, lambda c: F.size(c)))
    pad = lambda c, fill: F.concat(c, F.array_repeat(F.lit(fill), wide - F.size(c)))
    line = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
    out = F.transform(cells, lambda c, i: F.when(i == 1, F.concat(F.lit("|"), F.repeat(F.lit("---|"), wide))).otherwise(line(pad(c, ""))))
    return F.when(is_table & (wide >= 2), F.array_join(out, "\n"))


def agreed(readings: DataFrame, item: str, text: str, norm: Column) -> DataFrame:
    """Items whose independent readings say the same once normalised. Distinct forms are counted, so an item read
    very often is no burden."""
    rows = readings.withColumn("_n", norm)
    per = rows.groupBy(item).agg(F.count(F.lit(1)).alias("_all"), F.min("_n").alias("_a"), F.max("_n").alias("_z"), F.min(text).alias(text))
    return per.filter((F.col("_all") > 1) & (F.col("_a") == F.col("_z"))).select(item, text)
