"""Small derived columns of the library, the quotas and the telemetry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS_PER_MINUTE = 230
AI_DAILY_LIMIT, CHAT_DAILY_LIMIT = 20, 50

# US dollars per million tokens (input, cached input, output) and per web search.
PRICES = [
    ("gpt-4.1", 2.00, 0.50, 8.00),
    ("gpt-4.1-mini", 0.40, 0.10, 1.60),
    ("gpt-4o", 2.50, 1.25, 10.00),
    ("gpt-4o-mini", 0.15, 0.075, 0.60),
    ("text-embedding-3-small", 0.02, 0.02, 0.0),
]
WEB_SEARCH_USD = 0.01


def file_type(source_type: Column, filename: Column) -> Column:
    name = F.lower(F.coalesce(filename, F.lit("")))
    return (
        F.when(F.endswith(name, F.lit(".epub")), "epub")
        .when((source_type == "manual") & ~F.endswith(name, F.lit(".pdf")), "web")
        .otherwise("pdf")
    )


def reading_minutes(words: Column) -> Column:
    return F.ceil(F.nullif(words, F.lit(0)) / WORDS_PER_MINUTE).cast("int")


def progress(is_read: Column, last_page: Column, page_count: Column, fraction: Column) -> Column:
    """0–100: a read document is 100, an unread one stops at 99; the page counts from the second on."""
    by_page = last_page / F.nullif(page_count, F.lit(0)) * 100
    share = F.when((last_page > 1) & (page_count > 0), by_page).otherwise(F.coalesce(fraction, F.lit(0.0)) * 100)
    return F.when(is_read, 100).otherwise(F.least(F.lit(99), F.floor(share + 0.5).cast("int")))


def read_state(percent: Column) -> Column:
    return F.when(percent >= 100, "read").when(percent > 0, "reading").otherwise("unread")


def reading_state(is_read: Column, fraction: Column) -> Column:
    return (
        F.when(is_read, "read").when(F.coalesce(fraction, F.lit(0.0)) > 0, "reading").otherwise("unread")
    )


def content_version(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.substring(F.sha2(text, 256), 1, 16))


def index_digest(text: Column, notes: Column, charts: Column) -> Column:
    """Digest of a text with its figure notes and charts (maps of strings), whatever the maps' order."""
    flat = lambda m: F.to_json(
        F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>")))))
    )
    return F.sha2(F.concat_ws("\n", text, flat(notes), flat(charts)), 256)


def remaining(limit: int, used: Column, used_on: Column, today: Column) -> Column:
    spent = F.when(used_on == today, used).otherwise(0)
    return F.greatest(F.lit(0), F.lit(limit) - spent)


def used_today(used: Column, used_on: Column, today: Column) -> Column:
    return F.when(used_on == today, used).otherwise(0)


def day_vn(ts: Column) -> Column:
    """The calendar day at UTC+7, which never changes clocks."""
    return F.to_date(ts + F.expr("INTERVAL 7 HOURS"))


def area(path: Column) -> Column:
    """The part of the app a request is for: the segment after /api/, at most 24 characters."""
    segment = F.substring(F.regexp_extract(path, r"^/api/([^/]+)", 1), 1, 24)
    return F.nullif(segment, F.lit(""))


def endpoint_template(path: Column) -> Column:
    """Path parameters (UUIDs and numbers) put back as a placeholder."""
    return F.regexp_replace(
        path,
        "(?<=/)([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9]+)(?=/|$)",
        "{id}",
    )


def base_model(model: Column) -> Column:
    """A dated snapshot is priced as its model."""
    return F.regexp_replace(model, "-[0-9]{4}-[0-9]{2}-[0-9]{2}$", "")


def price_map(which: int) -> Column:
    """The price list as one constant map column (a handful of models, fixed)."""
    pairs = []
    for row in PRICES:
        pairs += [F.lit(row[0]), F.lit(row[which])]
    return F.create_map(*pairs)


def call_cost(model: Column, prompt: Column, cached: Column, completion: Column, searches: Column) -> Column:
    """Dollars of one call; null for an unpriced model, zero when nothing was used."""
    name = F.when(F.map_contains_key(price_map(1), model), model).otherwise(base_model(model))
    price = lambda i: F.try_element_at(price_map(i), name)
    hit = F.least(cached, prompt)
    dollars = ((prompt - hit) * price(1) + hit * price(2) + completion * price(3)) / 1_000_000
    nothing = (prompt <= 0) & (completion <= 0) & (searches <= 0)
    return F.when(nothing, 0.0).otherwise(dollars + searches * WEB_SEARCH_USD)


def usage_tokens(answer: Column) -> Column:
    """(prompt, cached, completion) out of the three answer shapes; anything not a positive integer is 0."""

    def count(*paths: str) -> Column:
        raw = F.coalesce(*(F.get_json_object(answer, p) for p in paths))
        value = F.when(F.rlike(raw, F.lit("^[0-9]{1,18}$")), raw.cast("bigint"))
        return F.coalesce(value, F.lit(0))

    return F.struct(
        count("$.usage.prompt_tokens", "$.usage.input_tokens").alias("prompt"),
        count(
            "$.usage.prompt_tokens_details.cached_tokens", "$.usage.input_tokens_details.cached_tokens"
        ).alias("cached"),
        count("$.usage.completion_tokens", "$.usage.output_tokens").alias("completion"),
    )


def safe_name(name: Column, fallback: str = "document") -> Column:
    """A file name without path, control and reserved characters, at most 200 long, its extension kept."""
    base = F.substring_index(F.regexp_replace(F.coalesce(name, F.lit("")), r"\\", "/"), "/", -1)
    base = F.regexp_replace(base, r"\p{C}", "")
    base = F.regexp_replace(F.regexp_replace(base, r'[<>:"/\\|?*]', "_"), r"^[ .]+|[ .]+$", "")
    base = F.when(base == "", fallback).otherwise(base)
    ext = F.substring_index(base, ".", -1)
    stem = F.substr(base, F.lit(1), F.length(base) - F.length(ext) - 1)
    short = F.concat(F.substr(stem, F.lit(1), 199 - F.length(ext)), F.lit("."), ext)
    dotted = F.contains(base, F.lit(".")) & (F.length(ext) <= 10)
    return F.when(F.length(base) <= 200, base).when(dotted, short).otherwise(F.substring(base, 1, 200))


def significant(value: Column, digits: int = 4) -> Column:
    """Rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, 0.0).otherwise(F.rint(value * scale) / scale)


def authors_short(families: Column) -> Column:
    names = F.filter(F.transform(F.coalesce(families, F.array().cast("array<string>")), lambda n: F.trim(n)), lambda n: n != "")
    return F.when(F.size(names) <= 2, F.array_join(names, " & ")).otherwise(
        F.concat(F.element_at(names, 1), F.lit(" et al."))
    )


def authors_to_text(authors: Column) -> Column:
    """[{family, given}] as "Family, Given; Family"."""
    return F.array_join(
        F.transform(authors, lambda a: F.concat_ws(", ", a["family"], F.nullif(a["given"], F.lit("")))), "; "
    )


def authors_from_text(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, "[;\n]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.trim(F.substring_index(p, ",", 1)).alias("family"),
            F.when(F.contains(p, F.lit(",")), F.trim(F.substr(p, F.locate(",", p) + 1))).otherwise("").alias("given"),
        ),
    )


def no_derivatives(license: Column) -> Column:
    return F.contains(F.upper(F.coalesce(license, F.lit(""))), F.lit("ND"))


def readable(status: Column, kind: Column) -> Column:
    return (status == "done") | ((kind == "pdf") & ~status.isin("pending", "processing"))


def doi(raw: Column) -> Column:
    """The bare lower-case DOI in what was pasted; null when it is none."""
    bare = F.regexp_replace(F.trim(raw), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    value = F.try_url_decode(F.regexp_replace(bare, r"\+", "%2B"))
    good = F.rlike(value, F.lit(r"(?i)^10\.[0-9]{4,9}/\S+$")) & (F.length(value) <= 300)
    return F.when(good, F.lower(F.regexp_replace(value, "[.,;]+$", "")))


def label_passage(heading: Column, text: Column) -> Column:
    return F.when(F.length(heading) > 0, F.concat_ws("\n", heading, text)).otherwise(text)


# The order in which extraction issues are shown, and those that mean text is missing.
ISSUE_ORDER = ["scanned_pages", "tables_as_images", "equations_as_images", "ocr_pages"]
ISSUE_MISSING = ISSUE_ORDER[:3]
# What each issue is called in the sentence about coverage.
COVERAGE = {
    "scanned_pages": "{n} scanned page(s){pages} could not be read and are not in the passages",
    "tables_as_images": "{n} table(s) are only pictures and their contents are not in the passages",
    "equations_as_images": "{n} equation(s) are only pictures and are not in the passages",
    "ocr_pages": "{n} page(s){pages} were read by text recognition and may contain misread words",
}


def shown_issues(issues: Column) -> Column:
    """Issues with a count, in display order."""
    rank = lambda i: F.array_position(F.array(*map(F.lit, ISSUE_ORDER)), i["code"])
    live = F.filter(issues, lambda i: i["count"] > 0)
    keyed = F.array_sort(F.transform(live, lambda i: F.struct(rank(i).alias("r"), i.alias("i"))))
    return F.transform(keyed, lambda k: k["i"])


def is_partial(issues: Column) -> Column:
    return F.exists(shown_issues(issues), lambda i: i["code"].isin(*ISSUE_MISSING))


def coverage_note(issues: Column) -> Column:
    """One sentence on what the text leaves out; null when nothing known is missing."""

    def say(issue: Column) -> Column:
        shown = F.array_join(F.transform(F.slice(issue["pages"], 1, 12), lambda p: p.cast("string")), ", ")
        word = F.when(F.size(issue["pages"]) == 1, "page").otherwise("pages")
        where = F.when(F.size(issue["pages"]) > 0, F.concat(F.lit(" ("), word, F.lit(" "), shown, F.lit(")")))
        out = F.lit(None).cast("string")
        for code, template in COVERAGE.items():
            line = F.replace(F.lit(template), F.lit("{n}"), issue["count"].cast("string"))
            line = F.replace(line, F.lit("{pages}"), F.coalesce(where, F.lit("")))
            out = F.when(issue["code"] == code, line).otherwise(out)
        return out

    said = F.filter(
        F.transform(F.filter(issues, lambda i: i["count"] > 0), say), lambda s: s.isNotNull()
    )
    note = F.concat(F.lit("Note on this text: "), F.array_join(said, "; "), F.lit("."))
    return F.when(F.size(said) > 0, note)


def page_runs(pages: Column, limit: int = 6) -> Column:
    """"2–4, 7, 9" for pages 2, 3, 4, 7, 9; after `limit` runs an ellipsis. One document's own page list."""
    ordered = F.array_sort(F.array_distinct(pages))
    starts = F.filter(ordered, lambda p: ~F.array_contains(ordered, p - 1))
    ends = F.filter(ordered, lambda p: ~F.array_contains(ordered, p + 1))
    runs = F.zip_with(
        starts,
        ends,
        lambda a, z: F.when(a == z, a.cast("string")).otherwise(F.concat_ws("–", a.cast("string"), z.cast("string"))),
    )
    more = F.when(F.size(runs) > limit, ", …").otherwise("")
    return F.concat(F.array_join(F.slice(runs, 1, limit), ", "), more)


def sql_functions(spark) -> None:
    """The scalar rules above under names SQL can call."""
    for ddl in (
        "file_type(source STRING, name STRING) RETURNS STRING RETURN CASE "
        "WHEN lower(coalesce(name, '')) LIKE '%.epub' THEN 'epub' "
        "WHEN source = 'manual' AND NOT lower(coalesce(name, '')) LIKE '%.pdf' THEN 'web' ELSE 'pdf' END",
        "reading_minutes(words INT) RETURNS INT RETURN CAST(ceil(nullif(words, 0) / 230) AS INT)",
        "progress(is_read BOOLEAN, page INT, pages INT, fraction DOUBLE) RETURNS INT RETURN CASE WHEN is_read "
        "THEN 100 WHEN page > 1 AND pages > 0 THEN least(99, CAST(floor(page / pages * 100 + 0.5) AS INT)) "
        "ELSE least(99, CAST(floor(coalesce(fraction, 0D) * 100 + 0.5) AS INT)) END",
        "token_estimate(body STRING) RETURNS INT RETURN length(body) DIV 3 + 1",
        "vn_day(ts TIMESTAMP) RETURNS DATE RETURN to_date(ts + INTERVAL 7 HOURS)",
        "call_cost(prompt BIGINT, cached BIGINT, completion BIGINT, searches BIGINT, p_in DOUBLE, "
        "p_cached DOUBLE, p_out DOUBLE) RETURNS DOUBLE RETURN CASE WHEN prompt <= 0 AND completion <= 0 AND "
        "searches <= 0 THEN 0D ELSE ((prompt - least(cached, prompt)) * p_in + least(cached, prompt) * p_cached "
        "+ completion * p_out) / 1000000 + searches * 0.01D END",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {ddl}")
