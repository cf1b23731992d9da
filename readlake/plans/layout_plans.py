"""Page layout, roles and charts; the given texts' lines stand for the items of five-line pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.operators import charts as C
from readlake.operators import layout as L
from readlake.operators import roles as R
from readlake.plans.registry import query
from readlake.sources import export as E

ITEMS = """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
b AS (SELECT doc_id, i // 5 + 1 AS page, i % 5 + 1 AS ord, CASE i % 5 WHEN 0 THEN 50.0 WHEN 1 THEN 310.0 WHEN 2 THEN 50.0 WHEN 3 THEN 310.0 ELSE 50.0 END AS x0,
  100.0 + (i % 5) * 120 AS y0, CASE i % 5 WHEN 0 THEN 550.0 WHEN 1 THEN 550.0 WHEN 2 THEN 290.0 WHEN 3 THEN 550.0 ELSE 290.0 END AS x1,
  180.0 + (i % 5) * 120 AS y1, text, 8.0 + length(text) % 5 AS size FROM l WHERE text <> ''),
h AS (SELECT DISTINCT doc_id, i // 5 + 1 AS page, 0 AS ord, 50.0 AS x0, 20.0 AS y0, 550.0 AS x1, 40.0 AS y1,
  'Journal of ' || source || ' vol ' || (i // 5 + 1) AS text, 8.0 AS size FROM l WHERE text <> ''),
items AS (SELECT * FROM b UNION ALL SELECT * FROM h)
"""


def items(t):
    rows = t.documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "text")).filter("text <> ''")
    k, page = F.col("i") % 5, (F.floor(F.col("i") / 5) + 1).cast("int").alias("page")
    left, span = k.isin(2, 4), k == 0
    num = lambda v, n: v.cast("double").alias(n)
    body = rows.select(
        "doc_id", page, (k + 1).cast("int").alias("ord"), num(F.when(left | span, 50.0).otherwise(310.0), "x0"), num(100 + k * 120, "y0"),
        num(F.when(left, 290.0).otherwise(550.0), "x1"), num(180 + k * 120, "y1"), "text", num(8 + F.length("text") % 5, "size"),
    )
    head = rows.select("doc_id", page, "source").distinct().select(
        "doc_id", "page", F.lit(0).alias("ord"), F.lit(50.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(550.0).alias("x1"), F.lit(40.0).alias("y1"),
        F.concat(F.lit("Journal of "), "source", F.lit(" vol "), F.col("page").cast("string")).alias("text"), F.lit(8.0).alias("size"),
    )
    return body.unionByName(head).withColumns(
        {"kind": F.lit("text"), "page_width": F.lit(600.0), "page_height": F.lit(800.0), "bold": F.lit(False)}
    )


@query("layout_body_size", ITEMS + """
SELECT doc_id, quantile_cont(size, 0.5) AS body_size FROM (SELECT doc_id, size, unnest(range(length(text))) FROM items) GROUP BY 1""")
def _(t):
    return L.body_size(items(t))


@query("layout_reading_order", ITEMS + """
, m AS (SELECT *, (min(x0) OVER w + max(x1) OVER w) / 2 AS mid, (max(x1) OVER w - min(x0) OVER w) * 0.1 AS slack FROM items WINDOW w AS (PARTITION BY doc_id, page))
, s AS (SELECT *, CASE WHEN x0 < mid - slack AND x1 > mid + slack THEN 1 ELSE 0 END AS sp FROM m)
, bb AS (SELECT *, sum(sp) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ord ROWS UNBOUNDED PRECEDING) AS band FROM s)
SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, CASE WHEN sp = 1 THEN 0 WHEN (x0 + x1) / 2 < mid THEN 1 ELSE 2 END, y0, x0, ord) AS n FROM bb""")
def _(t):
    return L.reading_order(items(t)).select("doc_id", "page", "ord", F.col("n").cast("bigint").alias("n"))


KEY = "lower(trim(regexp_replace(regexp_replace(replace(text, '**', ''), '\\d+', '#', 'g'), '\\s+', ' ', 'g'), ' '))"
RUNNING = ITEMS + f"""
, k AS (SELECT *, {KEY} AS key, y1 < 80 OR y0 > 720 AS m FROM items)
, p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM items GROUP BY 1)
, s AS (SELECT doc_id, key, count(DISTINCT page) AS seen FROM k WHERE m GROUP BY 1, 2)
, r AS (SELECT k.*, pages, seen, CASE WHEN m AND pages > 1 AND seen >= least(3, pages) THEN CASE WHEN y1 < 80 THEN 'RUNNING_HEADER' ELSE 'RUNNING_FOOTER' END END AS role
  FROM k JOIN p ON p.doc_id = k.doc_id LEFT JOIN s ON s.doc_id = k.doc_id AND s.key = k.key)
"""


@query("layout_running_text", RUNNING + "SELECT doc_id, page, ord, role FROM r")
def _(t):
    rows = items(t)
    return L.running_text(rows, L.body_size(rows)).select("doc_id", "page", "ord", "role")


@query("layout_running_support", RUNNING + "SELECT doc_id, key, seen FROM s")
def _(t):
    rows = items(t).filter("y1 < 80 OR y0 > 720").withColumn("key", L.running_key(F.col("text")))
    return rows.groupBy("doc_id", "key").agg(F.count_distinct("page").alias("seen"))


@query("layout_flow_and_aside", RUNNING + """
SELECT doc_id, count(*) FILTER (WHERE role IS NULL) AS flow, count(*) FILTER (WHERE role IS NOT NULL) AS aside FROM r GROUP BY 1""")
def _(t):
    rows = items(t)
    flow, aside = L.split_aside(L.running_text(rows, L.body_size(rows)))
    both = flow.select("doc_id", F.lit(1).alias("f")).unionByName(aside.select("doc_id", F.lit(0).alias("f")))
    return both.groupBy("doc_id").agg(F.count_if(F.col("f") == 1).alias("flow"), F.count_if(F.col("f") == 0).alias("aside"))


@query("layout_paragraphs", ITEMS + """
, p AS (SELECT *, CASE WHEN abs(size - lag(size) OVER w) <= 0.6 AND y0 - lag(y1) OVER w < greatest(size, lag(size) OVER w) * 0.9
  AND NOT regexp_matches(trim(text), '(?i)^\\**\\s*(Fig\\.|Figure|Table|Tab\\.|Hình|Bảng)\\s*\\d') THEN 0 ELSE 1 END AS new FROM (SELECT * REPLACE (y0 - 35 AS y0) FROM items)
  WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord))
SELECT doc_id, page, ord, CAST(sum(new) OVER (PARTITION BY doc_id, page ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph FROM p""")
def _(t):
    return L.paragraphs(items(t).withColumn("y0", F.col("y0") - 35)).select("doc_id", "page", "ord", "paragraph")


@query("layout_headings", ITEMS + """
SELECT doc_id, page, ord, CASE WHEN size >= 18 THEN '# ' WHEN size >= 14.5 THEN '## ' WHEN size >= 12 THEN '### ' END || trim(regexp_replace(replace(text, '**', ''), '\\s+', ' ', 'g'), ' ') AS heading
FROM items WHERE size >= 12""")
def _(t):
    rows = items(t)
    head = L.heading(F.col("text"), F.col("size"), F.lit(10.0), F.lit(3), F.lit(False))
    return rows.select("doc_id", "page", "ord", head.alias("heading")).filter("heading IS NOT NULL")


def flow(t):
    rows = items(t)
    kept, _ = L.split_aside(L.running_text(rows, L.body_size(rows)))
    return L.reading_order(kept)


@query("layout_carried_over")
def _(t):
    cut = F.regexp_replace("text", r"[.]\s*$", "")
    rows = flow(t).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lower(cut)).otherwise(F.col("text")))
    return L.carry_over(rows).select("doc_id", "page", "n", "carried", F.md5("text").alias("text"))


@query("layout_clean_documents")
def _(t):
    from readlake.operators.blocks import rejoin

    pages = L.page_texts(L.carry_over(flow(t)))
    return rejoin(L.clean_documents(pages), "doc_id", "content").select("doc_id", F.md5("content").alias("content"))


@query("layout_image_strips", """
WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page, l_partkey * 10000 + l_suppkey AS ord, l_returnflag, l_quantity FROM lineitem),
m AS (SELECT *, lag(l_returnflag) OVER w = 'A' AND l_returnflag = 'A' AS near FROM i WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord)),
g AS (SELECT *, sum(CASE WHEN coalesce(near, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY ord ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT doc_id, page, min(ord) AS ord, count(*) AS strips FROM g GROUP BY doc_id, page, g""")
def _(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), (F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("ord"),
        F.when(F.col("l_returnflag") == "A", "image").otherwise("text").alias("kind"), F.lit(1.0).alias("x0"), F.lit(2.0).alias("x1"), F.lit(5.0).alias("y0"), F.lit(4.5).alias("y1"),
    )
    return L.image_strips(rows).select("doc_id", "page", "ord", "strips")


@query("layout_repeated_pictures", """
WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey * 1000 + l_suppkey AS ord, l_suppkey % 2 AS data, l_partkey % 128 AS w FROM lineitem),
g AS (SELECT doc_id, data FROM i GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3)
SELECT doc_id, page, ord FROM i WHERE (doc_id, data) NOT IN (SELECT (doc_id, data) FROM g) AND w >= 64
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) <= 200""")
def _(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ord"),
        (F.col("l_suppkey") % 2).cast("string").alias("data"), (F.col("l_partkey") % 128).alias("width"), F.lit(99).alias("height"),
    )
    return L.repeated_pictures(rows, 200).select("doc_id", "page", "ord")


@query("layout_table_pictures")
def _(t):
    rows = flow(t).withColumn("kind", F.when(F.col("n") % 2 == 0, "image").otherwise("text"))
    rows = rows.withColumn("text", F.when(F.col("n") == 1, F.concat(F.lit("Table 1. "), "text")).otherwise(F.col("text")))
    return L.table_pictures(rows, reach=60.0).select("doc_id", "page", "n")


@query("layout_equations")
def _(t):
    rows = items(t).withColumn("size", F.lit(10.0)).withColumn("bold", F.lit(False)).withColumn("baseline", F.lit(None).cast("double"))
    tag = F.struct(F.lit("n").alias("w"), F.concat(F.lit("("), F.col("page").cast("string"), F.lit(")")).alias("text"), F.lit(560.0).alias("x0"), F.lit(575.0).alias("x1"))
    math = F.struct(F.lit("m").alias("w"), F.concat(F.substring("text", 1, 3), F.lit(" = x")).alias("text"), F.lit(300.0).alias("x0"), F.lit(400.0).alias("x1"))
    both = rows.filter("ord > 0").withColumn("v", F.explode(F.array(tag, math))).select(
        "doc_id", "page", (F.col("ord") * 2 + F.when(F.col("v.w") == "n", 1).otherwise(0)).alias("ord"), F.col("v.text").alias("text"), F.col("v.x0").alias("x0"),
        F.col("v.x1").alias("x1"), "y0", "y1", "size", "bold", "baseline", "page_width",
    )
    return L.equations(both).select("doc_id", "page", "tag", F.round("y0", 3).alias("y0"), F.round("y1", 3).alias("y1"))


@query("layout_figure_clusters")
def _(t):
    boxes = t.lineitem.select(
        (F.col("l_orderkey") % 200).cast("string").alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 600).cast("double").alias("x0"),
        (F.col("l_suppkey") % 800 * 8).cast("double").alias("y0"), (F.col("l_partkey") % 600 + F.col("l_quantity") / 5).alias("x1"),
        (F.col("l_suppkey") % 800 * 8 + F.col("l_quantity") / 5).alias("y1"), F.lit(3).cast("bigint").alias("paths"), (F.col("l_returnflag") == "A").alias("curvy"),
    )
    found = L.clusters(boxes)
    return found.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("clusters"), F.sum("paths").alias("paths"))


@query("layout_issues", """
WITH p AS (SELECT o_custkey AS doc_id, o_orderkey AS page, CASE o_orderstatus WHEN 'F' THEN 'scanned_pages' WHEN 'O' THEN 'ocr_pages' END AS code FROM orders)
SELECT doc_id, code, count(DISTINCT page) AS count, array_to_string(list_sort(list(DISTINCT page))[1:50], ',') AS pages FROM p WHERE code IS NOT NULL GROUP BY 1, 2""")
def _(t):
    code = F.when(F.col("o_orderstatus") == "F", "scanned_pages").when(F.col("o_orderstatus") == "O", "ocr_pages")
    rows = t.orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), code.alias("code"))
    out = L.issues(rows, 50)
    return out.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


@query("layout_scanned_pages_read", """
SELECT o_custkey AS doc_id, o_orderkey AS page, CASE WHEN o_orderstatus = 'F' AND o_orderkey IN (SELECT doc_id FROM documents) THEN (SELECT lang FROM documents d WHERE d.doc_id = o_orderkey)
  ELSE o_orderpriority END AS text FROM orders""")
def _(t):
    pages = t.orders.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), F.when(F.col("o_orderstatus") == "F", "ocr").otherwise("text").alias("kind"), F.col("o_orderpriority").alias("text")
    )
    read = pages.select("doc_id", "page").join(t.documents.select(F.col("doc_id").alias("page"), F.col("lang").alias("text")), "page")
    return L.with_scanned_pages(pages, read).select("doc_id", "page", "text")


FIG = ITEMS + """
, s AS (SELECT doc_id, page * 10 + ord AS ord, CASE WHEN ord = 2 THEN '![x](picture:a.webp)' WHEN ord = 1 THEN '## ' || substr(trim(text), 1, 12) ELSE trim(text) END AS text FROM items WHERE trim(text) <> '')
, w AS (SELECT *, nullif(regexp_extract(text, '^#{1,6}\\s+(.+?)\\s*#*\\s*$', 1), '') AS h, CASE WHEN NOT starts_with(text, '## ') AND NOT starts_with(text, '![') THEN text END AS p FROM s)
, c AS (SELECT *, last_value(h IGNORE NULLS) OVER a AS heading, last_value(p IGNORE NULLS) OVER a AS b, first_value(p IGNORE NULLS) OVER z AS f FROM w
  WINDOW a AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), z AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT doc_id, ord, heading, CASE WHEN length(b) > 375 THEN substr(b, length(b) - 374) ELSE b END AS before, substr(f, 1, 375) AS after FROM c WHERE starts_with(text, '![')"""


@query("layout_figure_context", FIG)
def _(t):
    text = F.trim("text")
    made = F.when(F.col("ord") == 2, "![x](picture:a.webp)").when(F.col("ord") == 1, F.concat(F.lit("## "), F.substring(text, 1, 12))).otherwise(text)
    rows = items(t).filter("trim(text) <> ''").select("doc_id", (F.col("page") * 10 + F.col("ord")).alias("ord"), made.alias("text"))
    return L.figure_context(rows)


@query("layout_line_sizes", """
WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, round(l_quantity, 1) AS size, length(l_returnflag || l_linestatus) * l_linenumber AS w, l_tax AS b FROM lineitem),
g AS (SELECT doc_id, page, size, sum(w) AS w, median(b) AS b FROM s GROUP BY 1, 2, 3)
SELECT doc_id, page, size, b AS baseline FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY w DESC, size) = 1""")
def _(t):
    spans = t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit(1).alias("line"), F.col("l_quantity").alias("size"),
        F.repeat(F.concat("l_returnflag", "l_linestatus"), F.col("l_linenumber")).alias("text"), F.col("l_tax").alias("baseline"),
    )
    return L.line_sizes(spans).select("doc_id", "page", "size", "baseline")


# ---- roles


def typed(t):
    """Items whose words carry what the rules look for, told by their place in the document."""
    rows = flow(t).withColumn("role", F.lit(None).cast("string")).withColumn("confidence", F.lit(0.0)).withColumn("reason", F.lit(""))
    k = (F.col("page") * 5 + F.col("n")) % 11
    text = (
        F.when((F.col("page") == 1) & (F.col("n") == 1), F.concat(F.lit("# "), F.substring("text", 1, 60)))
        .when((F.col("page") == 1) & (F.col("n") == 2), F.lit("Abstract"))
        .when(k == 3, F.lit("## References")).when(k == 5, F.concat(F.lit("[4] "), "text")).when(k == 7, F.lit("We thank everyone who helped."))
        .when(k == 9, F.lit("## Funding")).when(k == 10, F.lit("## 3 Results")).otherwise(F.col("text"))
    )
    size = F.when((F.col("page") == 1) & (F.col("n") == 1), 24.0).otherwise(10.0)
    return rows.withColumn("text", text).withColumn("size", size)


@query("roles_of_blocks")
def _(t):
    rows = typed(t)
    return R.classify(rows, L.body_size).select("doc_id", "page", "n", "role", "confidence")


@query("roles_side_store")
def _(t):
    rows = typed(t)
    _, aside = L.split_aside(R.classify(rows, L.body_size))
    return R.aside_groups(aside).select("doc_id", "group", "rank", "role", F.md5("text").alias("text"))


@query("roles_groups", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'metadata' WHEN '2-HIGH' THEN 'supplementary' WHEN '3-MEDIUM' THEN 'furniture' END AS "group",
  CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 7 WHEN '3-MEDIUM' THEN 18 ELSE 0 END AS rank FROM orders""")
def _(t):
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "PUBLISHER_INFO").when(p == "2-HIGH", "REFERENCES").when(p == "3-MEDIUM", "PAGE_NUMBER").otherwise("TEXT")
    return t.orders.select("o_orderkey", R.group_of(kind).alias("group"), R.group_order(kind).alias("rank"))


@query("roles_question_intents", """
SELECT conv_id, turn, regexp_matches(q, '(?i)\\b(authors?|doi)\\b') AS about_front, regexp_matches(q, '(?i)\\b(fund\\w*|thank\\w*)\\b') AS about_statements,
  regexp_matches(q, '(?i)\\b(references?|cited)\\b') AS about_references FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Who are the AUTHORS' WHEN 1 THEN 'who funded it'
  WHEN 2 THEN 'which sources are cited' ELSE 'so what' END AS q FROM conversations)""")
def _(t):
    n = F.col("turn") % 4
    q = F.when(n == 0, "Who are the AUTHORS").when(n == 1, "who funded it").when(n == 2, "which sources are cited").otherwise("so what")
    front, statements, references = R.asks_about(q)
    return t.conversations.select("conv_id", "turn", front.alias("about_front"), statements.alias("about_statements"), references.alias("about_references"))


@query("roles_aside_for_questions")
def _(t):
    rows = typed(t)
    _, aside = L.split_aside(R.classify(rows, L.body_size))
    asked = t.documents.select("doc_id", F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 2 == 0, "who wrote it").otherwise("list its references").alias("question"))
    return R.aside_passages(aside, asked).select("doc_id", "question_id", "label", "page", F.length("text").alias("length"))


# ---- charts


AXES = """
WITH k AS (SELECT o_custkey AS axis, CAST(o_orderkey % 1000 AS DOUBLE) AS pos, CASE o_custkey % 3 WHEN 0 THEN (o_orderkey % 1000) * 3.0 + 7 WHEN 1 THEN pow(10.0, (o_orderkey % 1000) / 200.0)
  ELSE o_totalprice END AS value FROM orders)
, l AS (SELECT *, CASE WHEN value > 0 THEN log10(value) END AS lg FROM k)
, f AS (SELECT axis, regr_slope(value, pos) AS a1, regr_intercept(value, pos) AS b1, regr_slope(lg, pos) AS a2, regr_intercept(lg, pos) AS b2,
  max(value) - min(value) AS r1, max(lg) - min(lg) AS r2 FROM l GROUP BY 1)
, m AS (SELECT l.axis, a1, b1, a2, b2, r1, r2, max(abs(a1 * pos + b1 - value)) AS m1, max(abs(a2 * pos + b2 - lg)) AS m2 FROM l JOIN f ON f.axis = l.axis GROUP BY 1, 2, 3, 4, 5, 6, 7)
"""


@query("chart_axis_fits", AXES + """
SELECT axis, CASE WHEN r1 > 0 AND m1 <= 0.006 * r1 THEN 'linear' ELSE 'log' END AS scale, round(CASE WHEN r1 > 0 AND m1 <= 0.006 * r1 THEN a1 ELSE a2 END, 5) AS a
FROM m WHERE (r1 > 0 AND m1 <= 0.006 * r1) OR (r2 > 0 AND m2 <= 0.006 * r2)""")
def _(t):
    pos = (F.col("o_orderkey") % 1000).cast("double")
    kind = F.col("o_custkey") % 3
    value = F.when(kind == 0, pos * 3 + 7).when(kind == 1, F.pow(F.lit(10.0), pos / 200)).otherwise(F.col("o_totalprice"))
    ticks = t.orders.select(F.col("o_custkey").alias("axis"), pos.alias("pos"), value.alias("value"))
    return C.fit_axis(ticks, "axis").select("axis", "scale", F.round("a", 5).alias("a"))


@query("chart_tick_runs")
def _(t):
    labels = t.lineitem.select(
        F.col("l_suppkey").cast("string").alias("figure"), F.round(F.col("l_discount") * 1000).alias("at"), F.col("l_partkey").cast("double").alias("pos"), (F.col("l_partkey") * 2.0).alias("value")
    )
    runs = C.tick_runs(labels.dropDuplicates(["figure", "at", "pos"]))
    return runs.groupBy("figure", "run").agg(F.count(F.lit(1)).alias("ticks"), F.min("pos").alias("start"), F.max("pos").alias("end"))


def charts(t):
    """Every vector as a chart of one panel and one series."""
    points = F.transform("embedding", lambda v, i: F.array(i.cast("double"), F.round(v.cast("double"), 3)))
    axis = lambda title: F.struct(F.lit(title).alias("title"), F.lit("linear").alias("scale"))
    series = F.array(F.struct(F.lit("").alias("name"), F.lit("#112233").alias("color"), points.alias("points")))
    panel = F.struct(F.col("label").cast("string").alias("title"), axis("dim, x").alias("x"), axis("").alias("y"), series.alias("series"))
    return t.embeddings.select("vec_id", F.array(panel).alias("panels"))


@query("chart_csv", """
SELECT vec_id, 0 AS ord, 'series,"dim, x",y' AS line FROM embeddings
UNION ALL SELECT vec_id, i + 1, '1,' || printf('%.1f', CAST(i AS DOUBLE)) || ',' || CAST(round(CAST(embedding[i + 1] AS DOUBLE), 3) + 0.0 AS VARCHAR) FROM embeddings, range(64) r(i)""")
def _(t):
    return E.chart_csv(charts(t), "vec_id").select("vec_id", "ord", "line")


@query("chart_points_sampled", """
SELECT vec_id, array_to_string(list_transform(range(30), lambda i: CAST(CAST(round_even(i * 63 / 29.0, 0) AS INT) AS VARCHAR)), ',') AS kept FROM embeddings""")
def _(t):
    at = F.transform("embedding", lambda v, i: i)
    return t.embeddings.select("vec_id", F.array_join(F.transform(C.sampled(at, 30), lambda i: i.cast("string")), ",").alias("kept"))


@query("chart_text")
def _(t):
    return C.chart_text(charts(t), "vec_id")


@query("chart_series_names", """
WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey AS f, l_linenumber AS n, first_value(l_partkey % 50) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS c FROM lineitem),
h AS (SELECT f, n, substr(md5(c::VARCHAR), 1, 6) AS c FROM s), g AS (SELECT o_orderkey AS f, substr(md5((o_custkey % 50)::VARCHAR), 1, 6) AS c, o_orderstatus AS name FROM orders),
p AS (SELECT h.f, h.n, g.c, g.name, greatest(abs(('0x' || substr(h.c, 1, 2))::INT - ('0x' || substr(g.c, 1, 2))::INT), abs(('0x' || substr(h.c, 3, 2))::INT - ('0x' || substr(g.c, 3, 2))::INT), abs(('0x' || substr(h.c, 5, 2))::INT - ('0x' || substr(g.c, 5, 2))::INT)) AS d FROM h JOIN g USING (f)),
o AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY d, n, c) AS rn FROM p WHERE d <= 24),
r AS (SELECT f, 0::BIGINT AS rn, []::BIGINT[] AS ns, []::VARCHAR[] AS cs, NULL::VARCHAR AS name FROM (SELECT DISTINCT f FROM o) UNION ALL
  SELECT o.f, o.rn, CASE WHEN ok THEN list_append(r.ns, o.n) ELSE r.ns END, CASE WHEN ok THEN list_append(r.cs, o.c) ELSE r.cs END, CASE WHEN ok THEN o.name END
  FROM r JOIN (SELECT * FROM o) o ON o.f = r.f AND o.rn = r.rn + 1, LATERAL (SELECT NOT list_contains(r.ns, o.n) AND NOT list_contains(r.cs, o.c) AS ok))
SELECT name, count(*) AS n FROM (SELECT name FROM r WHERE name IS NOT NULL UNION ALL SELECT '' FROM s LEFT JOIN (SELECT f, unnest(ns) AS n FROM r QUALIFY row_number() OVER (PARTITION BY f ORDER BY rn DESC) = 1) k ON k.f = s.f AND k.n = s.n WHERE k.n IS NULL) GROUP BY 1""")
def _(t):
    hue = lambda c: F.concat(F.lit("#"), F.substring(F.md5(c.cast("string")), 1, 6))
    first = F.min(F.struct("_k", "color"))["color"].alias("color")
    series = t.lineitem.select(F.col("l_orderkey").cast("string").alias("figure"), F.col("l_linenumber").alias("series"), F.struct("l_partkey", "l_suppkey").alias("_k"), hue(F.col("l_partkey") % 50).alias("color"))
    series = series.groupBy("figure", "series").agg(first)
    legend = t.orders.select(F.col("o_orderkey").cast("string").alias("figure"), hue(F.col("o_custkey") % 50).alias("color"), F.col("o_orderstatus").alias("name"))
    return C.series_names(series, legend).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _four_digits(v: str) -> str:
    scale = f"pow(10.0, 3 - floor(log10(abs({v}))))"
    return f"CASE WHEN {v} = 0 THEN 0.0 ELSE round_even({v} * {scale}, 0) / {scale} END"


@query("chart_values_digitised", f"""
WITH m AS (SELECT CAST(l_orderkey % 50 AS VARCHAR) AS figure, CAST(l_suppkey % 15 AS INT) AS series, CAST(l_quantity AS DOUBLE) AS px, CAST(l_extendedprice AS DOUBLE) / 100 AS py FROM lineitem),
n AS (SELECT *, CASE WHEN abs(px - lag(px) OVER w) <= 1.2 AND abs(py - lag(py) OVER w) <= 1.2 THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY figure, series ORDER BY px, py)),
g AS (SELECT *, sum(new) OVER (PARTITION BY figure, series ORDER BY px, py ROWS UNBOUNDED PRECEDING) AS k FROM n),
p AS (SELECT figure, series, avg(px) * 2 + 1 AS x, avg(py) * 2 + 1 AS y FROM g GROUP BY figure, series, k)
SELECT figure, series, count(*) AS points, max({_four_digits("x")}) AS x, max({_four_digits("y")}) AS y FROM p GROUP BY figure, series""")
def _(t):
    marks = t.lineitem.select(
        (F.col("l_orderkey") % 50).cast("string").alias("figure"), (F.col("l_suppkey") % 15).cast("int").alias("series"), F.col("l_quantity").alias("px"), (F.col("l_extendedprice") / 100).alias("py")
    )
    axis = marks.select("figure").distinct().select("figure", F.lit("linear").alias("scale"), F.lit(2.0).alias("a"), F.lit(1.0).alias("b"))
    out = C.digitise(marks, axis, axis)
    return out.groupBy("figure", "series").agg(F.count(F.lit(1)).alias("points"), F.max("x").alias("x"), F.max("y").alias("y"))


# ---- places and pictures of a page


EDGES = ITEMS + """
, e AS (SELECT doc_id, page, ord, md5(text) AS m, (length(text) * 7) % 760 AS y0, (length(text) * 13) % 560 AS x0, length(text) % 320 AS h, 6.0 + length(text) % 6 AS size, (doc_id + page * 3 + ord) % 6 AS c FROM items),
f AS (SELECT *, y0 + h AS y1, x0 + length(m) AS x1, CASE WHEN m < '4' THEN 'turned' ELSE 'text' END AS kind, CASE c WHEN 0 THEN '© 2020 ' || m WHEN 1 THEN '* Corresponding author: ' || m || '@b.org' WHEN 2 THEN '* Equal contribution ' || m
  WHEN 3 THEN 'See ' || m || '. Correspondence to: Ann <a@b.org>. End' ELSE m END AS text FROM e),
g AS (SELECT *, c = 3 AS cut, CASE WHEN c = 3 THEN 'See ' || m || '. End' ELSE text END AS said FROM f),
r AS (SELECT *, CASE WHEN kind = 'turned' AND h >= 200 AND (x1 < 72 OR x0 > 528) THEN 'WATERMARK' WHEN c = 0 AND (y0 > 640 OR y1 < 80) THEN 'PUBLISHER_INFO' WHEN c = 1 AND size < 9.5 AND y0 > 480 THEN 'AUTHORS' END AS role FROM g)
SELECT doc_id, page, ord, role, CASE WHEN role IS NULL AND c IN (1, 2) AND size < 9.5 AND y0 > 480 THEN 'note' ELSE kind END AS kind, md5(said) AS text, CASE WHEN cut THEN 1 ELSE 0 END AS contacts FROM r"""


@query("layout_edge_roles", EDGES)
def _(t):
    n, m, c = F.length("text"), F.md5("text"), (F.col("doc_id") + F.col("page") * 3 + F.col("ord")) % 6
    text = (
        F.when(c == 0, F.concat(F.lit("© 2020 "), m)).when(c == 1, F.concat(F.lit("* Corresponding author: "), m, F.lit("@b.org"))).when(c == 2, F.concat(F.lit("* Equal contribution "), m))
        .when(c == 3, F.concat(F.lit("See "), m, F.lit(". Correspondence to: Ann <a@b.org>. End"))).otherwise(m)
    )
    num = lambda v: v.cast("double")
    rows = items(t).withColumns({"_y": num((n * 7) % 760), "_x": num((n * 13) % 560), "_h": num(n % 320), "size": 6.0 + n % 6, "kind": F.when(m < "4", "turned").otherwise("text"), "_t": text, "body_size": F.lit(10.0)})
    rows = rows.withColumns({"x0": F.col("_x"), "y0": F.col("_y"), "x1": F.col("_x") + 32, "y1": F.col("_y") + F.col("_h"), "text": F.col("_t")})
    return L.edge_roles(rows).select("doc_id", "page", "ord", "role", "kind", F.md5("text").alias("text"), F.size("contacts").alias("contacts"))


@query("layout_ruled_tables", ITEMS + """
, k AS (SELECT doc_id, page, md5(string_agg(text, '' ORDER BY ord)) AS m FROM items GROUP BY 1, 2),
w AS (SELECT doc_id, page, caption, list_transform(range(6), lambda i: substr(m, i * 4 + caption, 4)) AS w FROM k, (VALUES (1), (2)) c(caption))
SELECT doc_id, page, caption, '| H1 | H2 |' || chr(10) || '|---|---|' || chr(10) || CASE WHEN page % 3 = 0 THEN '| ' || w[1] || ' ' || w[4] || ' | ' || w[2] || ' ' || w[3] || ' ' || w[5] || ' ' || w[6] || ' |'
  ELSE '| ' || w[1] || ' | ' || w[2] || ' ' || w[3] || ' |' || chr(10) || '| ' || w[4] || ' | ' || w[5] || ' ' || w[6] || ' |' END AS markdown FROM w""")
def _(t):
    """Two tables under each other on every page, with cells of two lines; on every third page nothing parts their rows."""
    pages = items(t).groupBy("doc_id", "page").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "")).alias("m"))
    both = pages.withColumn("caption", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("top", F.col("caption") * 100.0)
    page = [F.col("doc_id").cast("string").alias("doc_id"), "page"]
    captions = both.select(*page, F.col("caption").alias("ord"), F.lit(60.0).alias("x0"), (F.col("top") - 10).alias("y0"), F.lit(240.0).alias("x1"), (F.col("top") - 2).alias("y1"))
    rules = both.withColumn("d", F.explode(F.array(*map(F.lit, (0.0, 20.0, 80.0))))).select(*page, (F.col("top") + F.col("d")).alias("y"), F.lit(50.0).alias("x0"), F.lit(250.0).alias("x1"))
    gap = F.when(F.col("page") % 3 == 0, 16.0).otherwise(28.0)
    word = lambda i: F.substr("m", i * 4 + F.col("caption"), F.lit(4))
    cell = lambda v, x, y: F.struct(v.alias("text"), F.lit(x).alias("x0"), (F.col("top") + y).alias("y0"))
    cells = [cell(F.lit("H1"), 60.0, F.lit(5.0)), cell(F.lit("H2"), 160.0, F.lit(5.0)), cell(word(0), 60.0, F.lit(24.0)), cell(word(1), 160.0, F.lit(24.0)), cell(word(2), 160.0, F.lit(32.0)),
             cell(word(3), 60.0, 24.0 + gap), cell(word(4), 160.0, 24.0 + gap), cell(word(5), 160.0, 32.0 + gap)]
    spans = both.withColumn("s", F.explode(F.array(*cells))).select(*page, "s.*", (F.col("s.x0") + 40).alias("x1"), (F.col("s.y0") + 8).alias("y1"), F.lit(8.0).alias("size"))
    out = L.tables(spans, L.ruled_tables(captions, rules))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "page", "caption", "markdown")


@query("layout_figure_regions")
def _(t):
    """Every document's lines as labels and text around a drawing on each page."""
    rows = items(t).withColumn("k", F.length("text"))
    page = [F.col("doc_id").cast("string").alias("doc_id"), "page"]
    drawn = rows.filter("ord = 1").select(*page, F.lit(0).alias("cluster"), F.lit(200.0).alias("x0"), F.lit(300.0).alias("y0"), (300.0 + F.col("k") % 150).alias("x1"), (350.0 + F.col("k") % 90).alias("y1"), (F.col("k") % 40).cast("bigint").alias("paths"), (F.col("k") % 2 == 0).alias("curvy"))
    text = F.when(F.col("ord") == 0, F.concat(F.lit("Figure 1. "), "text")).otherwise(F.col("text"))
    x, y = (150 + F.col("k") * 7 % 220).cast("double"), (250 + F.col("k") * 11 % 200).cast("double")
    labels = rows.select(*page, text.alias("text"), x.alias("x0"), y.alias("y0"), (x + F.least("k", F.lit(120))).alias("x1"), (y + 9).alias("y1"), (6.0 + F.col("k") % 5).alias("size"), (F.col("k") > 45).alias("in_paragraph"), F.lit(10.0).alias("body_size"))
    return L.figures(drawn, labels)


@query("chart_panels_digitised", """
WITH RECURSIVE f AS (SELECT s_suppkey AS figure FROM supplier),
x AS (SELECT figure, k AS axis, 100.0 + 300 * (k % 2) AS "first", 300.0 + 300 * (k % 2) AS "last", 200.0 + 200 * (k // 2) + (k % 2) * (figure % 7) AS "row", row_number() OVER (PARTITION BY figure ORDER BY k) AS n FROM f, range(4) r(k) WHERE NOT (k = 3 AND figure % 5 = 0)),
y AS (SELECT figure, j AS axis, 90.0 + 300 * (j % 2) - (figure * (j + 1)) % 30 AS "right", 50.0 + 200 * (j // 2 % 2) AS "first", 190.0 + 200 * (j // 2 % 2) - (figure + j) % 20 AS "last" FROM f, range(6) r(j)),
c AS (SELECT x.figure, x.n, x.axis AS x, y.axis AS y, (x."row" - y."last") + (x."first" - y."right") AS far FROM x JOIN y USING (figure) WHERE y."right" <= x."first" + 4 AND x."first" - y."right" <= 45 AND x."row" - y."last" BETWEEN -4 AND 45),
g AS (SELECT figure, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS x, NULL::BIGINT AS y FROM f UNION ALL
  SELECT g.figure, g.n + 1, CASE WHEN b.y IS NULL THEN g.used ELSE list_append(g.used, b.y) END, b.x, b.y FROM g LEFT JOIN LATERAL (SELECT arg_min(c.y, (c.far, c.y)) AS y, any_value(c.x) AS x FROM c WHERE c.figure = g.figure AND c.n = g.n + 1 AND NOT list_contains(g.used, c.y)) b ON TRUE WHERE g.n < 4),
p AS (SELECT g.figure, row_number() OVER (PARTITION BY g.figure ORDER BY g.n) - 1 AS panel, g.x, g.y, y."right" + 1 AS x0, y."first" - (y."last" - y."first") / 4 * 0.6 AS y0, x."last" + (x."last" - x."first") / 4 * 0.6 AS x1, x."row" - 1 AS y1
  FROM g JOIN x ON x.figure = g.figure AND x.axis = g.x JOIN y ON y.figure = g.figure AND y.axis = g.y),
m AS (SELECT l_suppkey AS figure, l_linenumber AS series, 80.0 + (l_partkey * 37) % 560 AS px, 40.0 + (l_orderkey * 17) % 380 AS py FROM lineitem),
i AS (SELECT p.figure, panel, series, px, py, p.x, p.y FROM m JOIN p ON p.figure = m.figure AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1),
d AS (SELECT *, CASE WHEN abs(px - lag(px) OVER w) <= 1.2 AND abs(py - lag(py) OVER w) <= 1.2 THEN 0 ELSE 1 END AS new FROM i WINDOW w AS (PARTITION BY figure, panel, series ORDER BY px, py)),
e AS (SELECT *, sum(new) OVER (PARTITION BY figure, panel, series ORDER BY px, py ROWS UNBOUNDED PRECEDING) AS k FROM d),
v AS (SELECT figure, panel, series, k, avg(px) AS px, avg(py) AS py, any_value(x) AS x, any_value(y) AS y FROM e GROUP BY 1, 2, 3, 4)
SELECT figure, panel, series, count(*) AS points, round(sum(px * (x + 1)), 1) AS x, round(max(py) + 0.25, 0) AS y FROM v GROUP BY 1, 2, 3""")
def _(t):
    """Four panels of two rows and six y axes to choose from in each figure; every second y axis is logarithmic."""
    f, k, j = F.col("s_suppkey"), F.col("k"), F.col("j")
    xs = t.supplier.select(f, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).filter(~((k == 3) & (f % 5 == 0)))
    xs = xs.select(f.cast("string").alias("figure"), k.alias("axis"), (100.0 + 300 * (k % 2)).alias("first"), (300.0 + 300 * (k % 2)).alias("last"), (200.0 + 200 * F.floor(k / 2) + (k % 2) * (f % 7)).cast("double").alias("row"), F.lit(5).alias("ticks"))
    ys = t.supplier.select(f, F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"))
    high = 200 * (F.floor(j / 2) % 2)
    ys = ys.select(f.cast("string").alias("figure"), j.alias("axis"), (90.0 + 300 * (j % 2) - (f * (j + 1)) % 30).cast("double").alias("right"), (50.0 + high).cast("double").alias("first"), (190.0 + high - (f + j) % 20).cast("double").alias("last"), F.lit(5).alias("ticks"))
    marks = t.lineitem.select(F.col("l_suppkey").cast("string").alias("figure"), F.col("l_linenumber").alias("series"), (80.0 + (F.col("l_partkey") * 37) % 560).cast("double").alias("px"), (40.0 + (F.col("l_orderkey") * 17) % 380).cast("double").alias("py"))
    log = F.col("axis") % 2 == 0
    x_fits = xs.select("figure", "axis", F.lit("linear").alias("scale"), (F.col("axis") + 1).cast("double").alias("a"), F.lit(0.0).alias("b"))
    y_fits = ys.select("figure", "axis", F.when(log, "log").otherwise("linear").alias("scale"), F.when(log, 0.01).otherwise(0.02).alias("a"), F.lit(0.0).alias("b"))
    found = C.panels(xs, ys)
    out = C.digitise_panels(marks, found, x_fits, y_fits, digits=None).join(found.select("figure", "panel", F.col("y").alias("axis")), ["figure", "panel"])
    read = F.when(F.col("axis") % 2 == 0, F.log10("y") * 100).otherwise(F.col("y") * 50)  # back to the place on the page
    grouped = out.groupBy(F.col("figure").cast("bigint").alias("figure"), F.col("panel").cast("bigint").alias("panel"), "series")
    return grouped.agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("x"), 1).alias("x"), F.round(F.round(F.max(read), 6) + 0.25, 0).alias("y"))  # places have few decimals, logarithms there and back many


@query("page_items_read", ITEMS + """
SELECT doc_id, page, count(*) AS items, CAST(sum(length(text)) AS BIGINT) AS letters, round(sum(size), 1) AS size, md5(string_agg(text, '|' ORDER BY ord)) AS words FROM items GROUP BY 1, 2""")
def _(t):
    """The items written as a page parser leaves them, JSON lines, and read through the source, five columns of thirteen."""
    from readlake.session import shared_path
    from readlake.sources import page_items

    path = shared_path(t.spark, "page_items")
    items(t).withColumn("doc_id", F.col("doc_id").cast("string")).write.json(path)
    page_items.register(t.spark)
    read = t.spark.read.format("page_items").schema("doc_id STRING, page INT, ord INT, text STRING, size DOUBLE").option("rangeBytes", 1 << 18).load(path)
    rows = read.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), "page").agg(
        F.count(F.lit(1)).alias("items"), F.sum(F.length("text")).cast("bigint").alias("letters"), F.round(F.sum("size"), 1).alias("size"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("_t")
    )
    return rows.withColumn("words", F.md5(F.array_join(F.transform("_t", lambda x: x["text"]), "|"))).drop("_t")
