"""What the given tables stand for in the URL filter query, in Spark and in DuckDB.

Captures are the pages, fetched at an instant told by the page's id. The lists are dated from the pages' own hosts and paths: some
domains are blocked, some of them freed and blocked again; some sections are allowed for a while; some pages are blocked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm.url_lists import host, path

#: (list, kind, one value in so many, added, days after the value's first day, one value in so many has it)
HISTORY = [
    ("block", "domain", 3, True, 0, 1),
    ("block", "domain", 3, False, 60, 2),
    ("block", "domain", 3, True, 110, 4),
    ("allow", "prefix", 5, True, 10, 1),
    ("allow", "prefix", 5, False, 200, 3),
    ("block", "page", 40, True, 0, 1),
]


def number(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 7), 16, 10).cast("long")


def instant(days: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + days * 86400 + seconds)


def captures(pages: DataFrame) -> DataFrame:
    x = number(F.col("page_id"))
    return pages.select("page_id", "url", instant(x % 360, F.floor(x / 360) % 86400).alias("fetched_at"))


def entries(pages: DataFrame) -> DataFrame:
    labels = F.split(host(F.col("url")), r"\.")
    parts = F.filter(F.split(path(F.col("url")), "/"), lambda x: x != "")
    of = [
        ("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")),
        ("prefix", F.when(F.size(parts) > 0, F.concat(host(F.col("url")), F.lit("/"), F.element_at(parts, 1)))),
        ("page", F.concat(host(F.col("url")), path(F.col("url")))),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in of]))
    known = pages.select(each.alias("k")).select("k.*").dropna().distinct().withColumn("x", number(F.col("value")))
    names = ["list", "kind", "one_in", "added", "days", "some"]
    history = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in HISTORY])
    mine = F.filter(history, lambda h: (h["kind"] == F.col("kind")) & (F.col("x") % h["one_in"] == 0) & (F.floor(F.col("x") / 7) % h["some"] == 0))
    dated = known.withColumn("h", F.explode(mine))
    return dated.select("h.list", "kind", "value", "h.added", instant(F.col("x") % 150 + F.col("h.days"), F.col("x") % 86400).alias("at"))


def _number(value: str) -> str:
    return f"('0x' || substr(md5({value}), 1, 7))::BIGINT"


def _instant(days: str, seconds: str) -> str:
    return f"make_timestamp((1704067200 + ({days}) * 86400 + ({seconds})) * 1000000)"


def oracle() -> str:
    said = "\nUNION ALL ".join(
        f"SELECT '{name}' AS list, '{kind}' AS kind, value, {str(added).lower()} AS added, {_instant(f'x % 150 + {days}', 'x % 86400')} AS at_ FROM known WHERE kind = '{kind}' AND x % {one_in} = 0 AND x // 7 % {some} = 0"
        for name, kind, one_in, added, days, some in HISTORY
    )
    return f"""
WITH c AS (SELECT page_id, url, {_instant("x % 360", "x // 360 % 86400")} AS fetched_at FROM (SELECT page_id, url, {_number("page_id::VARCHAR")} AS x FROM pages)),
u AS (SELECT DISTINCT url, h, p, string_split(h, '.') AS ls, list_filter(string_split(p, '/'), lambda s: s <> '') AS ps FROM (
    SELECT url, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS h,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) AS p FROM pages) WHERE h <> ''),
values_ AS (SELECT DISTINCT 'domain' AS kind, array_to_string(ls[greatest(len(ls) - 2, 1):], '.') AS value FROM u
    UNION SELECT 'prefix', h || '/' || ps[1] FROM u WHERE len(ps) > 0 UNION SELECT 'page', h || p FROM u),
known AS (SELECT kind, value, {_number("value")} AS x FROM values_),
said AS ({said}),
changed AS (SELECT list, kind, value, at_, bool_and(added) AS added FROM said GROUP BY ALL),
held AS (SELECT * FROM (SELECT list, kind, value, added, at_ AS f, lead(at_) OVER (PARTITION BY list, kind, value ORDER BY at_) AS t FROM changed) WHERE added),
k AS (SELECT url, 'domain' AS kind, unnest(CASE WHEN len(ls) >= 2 THEN list_transform(range(1, len(ls)), lambda i: array_to_string(ls[i:], '.')) ELSE [h] END) AS value FROM u
    UNION ALL SELECT url, 'prefix', unnest(list_transform(range(1, len(ps) + 1), lambda i: h || '/' || array_to_string(ps[:i], '/'))) FROM u
    UNION ALL SELECT url, 'page', h || p FROM u),
hit AS (SELECT c.page_id, c.url, c.fetched_at, list, held.kind, held.value, f,
    row_number() OVER (PARTITION BY c.page_id, c.url, c.fetched_at ORDER BY CASE held.kind WHEN 'page' THEN 1 WHEN 'prefix' THEN 2 ELSE 3 END, length(held.value) DESC, list <> 'allow', list, held.value) AS r,
    count(*) OVER (PARTITION BY c.page_id, c.url, c.fetched_at) AS n
    FROM c JOIN k ON c.url = k.url JOIN held ON held.kind = k.kind AND held.value = k.value AND c.fetched_at >= f AND (t IS NULL OR c.fetched_at < t))
SELECT c.page_id, c.url, c.fetched_at, coalesce(n, 0)::BIGINT AS n_active, CASE WHEN list IS NULL THEN 'none' WHEN list = 'allow' THEN 'allow' ELSE 'block' END AS verdict,
    list AS matched_list, kind AS matched_kind, value AS matched_value, f AS active_since
FROM c LEFT JOIN hit ON hit.page_id = c.page_id AND hit.url = c.url AND r = 1"""
