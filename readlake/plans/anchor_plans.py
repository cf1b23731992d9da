"""Blocks, anchors and page geometry over the given texts and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.functions import text as X
from readlake.operators import anchors as A
from readlake.operators import blocks as B
from readlake.operators import geom as G
from readlake.plans.registry import query

DROP = "[\\s\\-‐‑­⁣​‌‍﻿]+"
SQUASH = "regexp_replace(translate(strip_accents(lower({0})), 'đς', 'dσ'), '" + DROP + "', '', 'g')"

BLOCKS = """
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
a AS (SELECT *, starts_with(s, '```') AS mark, sum(CASE WHEN starts_with(s, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS f FROM s),
k AS (SELECT *, CASE WHEN mark OR f % 2 = 1 THEN 'fence' WHEN NOT regexp_matches(s, '\\S') OR regexp_matches(s, '^---\\s*$') THEN 'gap'
  WHEN regexp_matches(s, '^\\s*\\$\\$(.*\\S.*)\\$\\$\\s*$') OR regexp_matches(s, '^#{1,6}\\s+') THEN 'single'
  WHEN regexp_matches(trim(s), '(?i)^!\\[[^\\]]*\\]\\((https?://\\S+|picture:[0-9a-f]{16}\\.webp)\\)$') THEN 'image'
  WHEN regexp_matches(s, '^\\s*\\|') THEN 'table' WHEN starts_with(s, '>') THEN 'quote'
  WHEN regexp_matches(s, '^\\s*([-*+]|\\d+\\.)\\s+') THEN 'list' ELSE 'para' END AS k FROM a),
t AS (SELECT *, k IN ('para', 'image') OR (k = 'table' AND NOT starts_with(s, '|')) AS soft FROM k),
r AS (SELECT *, sum(CASE WHEN soft THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM t),
p AS (SELECT *, CASE WHEN soft AND max(CASE WHEN soft AND k = 'para' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY line) = 1
  THEN 'para' ELSE k END AS kind FROM r),
o AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM p),
b AS (SELECT *, sum(CASE WHEN CASE WHEN kind = 'fence' THEN mark AND f % 2 = 1 ELSE before IS NULL OR before <> kind OR kind IN ('single', 'image') END
  THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM o),
g AS (SELECT doc_id, block, kind, list(s ORDER BY line) AS l FROM b WHERE kind <> 'gap' AND NOT (kind = 'fence' AND mark AND f % 2 = 0) GROUP BY 1, 2, 3),
w AS (SELECT doc_id, kind, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS ord, CASE kind WHEN 'fence' THEN '```' || array_to_string(l[2:], chr(10))
  WHEN 'para' THEN array_to_string(list_transform(l, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), ' ')
  WHEN 'quote' THEN '> ' || array_to_string(list_transform(l, lambda x: regexp_replace(x, '^>\\s?', '')), chr(10))
  ELSE array_to_string(l, chr(10)) END AS raw FROM g)
"""


def blocks(t):
    return B.markdown_blocks(t.documents, "doc_id", "text")


@query("blocks_of_markdown", BLOCKS + "SELECT doc_id, ord, kind, md5(raw) AS raw FROM w")
def _(t):
    return blocks(t).select("doc_id", F.col("ord").cast("bigint").alias("ord"), "kind", F.md5("raw").alias("raw"))


FNV = """, f AS (SELECT doc_id, ord, printf('%08x', list_reduce(list_prepend(CAST(2166136261 AS UBIGINT),
  list_transform(string_split(raw, ''), lambda c: CAST(unicode(c) AS UBIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)) AS key FROM w WHERE raw <> '')
"""


@query("block_ids", BLOCKS + FNV + """
SELECT doc_id, ord, 'b' || key || CASE WHEN row_number() OVER w > 1 THEN '-' || (row_number() OVER w - 1) ELSE '' END AS block_id FROM f
WINDOW w AS (PARTITION BY doc_id, key ORDER BY ord)""")
def _(t):
    return B.ids(blocks(t), "doc_id").select("doc_id", F.col("ord").cast("bigint").alias("ord"), "block_id")


LINES = f"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents),
b AS (SELECT doc_id, ord, 'l' || ord AS block_id, s AS text, {SQUASH.format("s")} AS words FROM s),
o AS (SELECT *, CAST(coalesce(sum(length(words)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM b)
"""


def lines(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    rows = rows.withColumn("ord", F.col("ord") + 1).withColumn("block_id", F.concat(F.lit("l"), F.col("ord").cast("string")))
    return rows.withColumn("words", X.squash(F.col("text")))


@query("block_offsets", LINES + "SELECT doc_id, ord, start, CAST(length(words) AS INT) AS length FROM o")
def _(t):
    out = B.offsets(lines(t), "doc_id")
    return out.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "start", F.length("words").alias("length"))


@query("block_spans", LINES + """
, r AS (SELECT doc_id, n AS id, n_chars // 7 * n AS a, n_chars // 7 * n + n_chars // 3 AS z FROM documents, (VALUES (0), (1), (2)) v(n))
SELECT r.doc_id, id, block_id, greatest(a - start, 0) AS span_start, least(z, start + length(words)) - start AS span_end
FROM r JOIN o ON o.doc_id = r.doc_id AND start < z AND a < start + length(words) AND length(words) > 0 WHERE z > a""")
def _(t):
    n = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("id")
    ranges = t.documents.select("doc_id", "n_chars", n).select(
        "doc_id", "id", (F.floor(F.col("n_chars") / 7) * F.col("id")).alias("range_start"),
        (F.floor(F.col("n_chars") / 7) * F.col("id") + F.floor(F.col("n_chars") / 3)).alias("range_end"),
    )
    out = B.spans(ranges, B.offsets(lines(t), "doc_id"), "doc_id", "id")
    return out


@query("block_places", """
WITH b AS (SELECT l_orderkey AS doc_id, l_partkey % 3 AS key, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS n,
  l_partkey, l_suppkey FROM lineitem),
m AS (SELECT l_orderkey AS doc_id, l_suppkey % 3 AS key, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS n, l_tax FROM lineitem)
SELECT b.doc_id, l_partkey, l_suppkey, m.l_tax AS box FROM b LEFT JOIN m ON m.doc_id = b.doc_id AND m.key = b.key AND m.n = b.n""")
def _(t):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), order.alias("ord"), "l_partkey", "l_suppkey", "l_tax")
    named = B.ids(rows, "doc_id", F.col("l_partkey") % 3).drop("l_tax")
    source = rows.select("doc_id", "ord", (F.col("l_suppkey") % 3).alias("key"), F.col("l_tax").alias("box"))
    return B.places(named, source, "doc_id").select("doc_id", "l_partkey", "l_suppkey", "box")


@query("document_vocabulary", """
SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents""")
def _(t):
    return B.vocabulary(t.documents, "doc_id", "text")


@query("words_rejoined", """
WITH w AS (SELECT doc_id, text, list_filter(regexp_extract_all(text, '\\p{L}+'), lambda x: length(x) > 3) AS l FROM documents)
SELECT doc_id, md5(CASE WHEN regexp_matches(text, '­[^⁣\\s]') THEN replace(text, '­', '-') ELSE replace(replace(text, '­⁣', ''), '­', '') END
  || CASE WHEN len(l) > 0 THEN ' ' || l[1] || ' zqx-' || l[1] ELSE '' END) AS body FROM w""")
def _(t):
    long = F.filter(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1)), lambda x: F.length(x) > 3)
    rows = t.documents.withColumn("w", F.get(long, F.lit(0)))
    half = F.concat(F.substring("w", 1, 2), F.lit("-⁣"), F.substr("w", F.lit(3)))
    more = F.concat(F.lit(" "), half, F.lit(" zqx-⁣"), "w")
    made = rows.withColumn("body", F.concat("text", F.coalesce(more, F.lit(""))))
    return B.rejoin(made, "doc_id", "body").select("doc_id", F.md5("body").alias("body"))


@query("squashed_texts", f"SELECT doc_id, md5({SQUASH.format('text')}) AS words, CAST(length({SQUASH.format('text')}) AS INT) AS n FROM documents")
def _(t):
    words = X.squash(F.col("text"))
    return t.documents.select("doc_id", F.md5(words).alias("words"), F.length(words).alias("n"))


@query("passage_occurrences", f"""
WITH w AS (SELECT doc_id, {SQUASH.format("text")} AS t FROM documents),
q AS (SELECT doc_id, t, substr(t, length(t) // 2 + 1, 3) AS q FROM w)
SELECT doc_id, CASE WHEN q = '' THEN 0 ELSE CAST((length(t) - length(replace(t, q, ''))) // length(q) AS INT) END AS apart,
  CASE WHEN q = '' THEN 0 ELSE CAST(len(list_filter(range(1, length(t) - length(q) + 2), lambda i: substr(t, i, length(q)) = q)) AS INT) END AS stepping FROM q""")
def _(t):
    rows = t.documents.select("doc_id", X.squash(F.col("text")).alias("t"))
    q = F.substr("t", F.floor(F.length("t") / 2).cast("int") + 1, F.lit(3))
    rows = rows.withColumn("q", q)
    return rows.select(
        "doc_id",
        F.size(A.places(F.col("t"), F.col("q"))).alias("apart"),
        F.size(A.places(F.col("t"), F.col("q"), overlapping=True)).alias("stepping"),
    )


PLACED = LINES + f"""
, d AS (SELECT doc_id, string_agg(words, chr(10) ORDER BY ord) AS w FROM b GROUP BY 1)
, h AS (SELECT doc_id, {SQUASH.format("substr(text, length(text) // 2, 40)")} AS q FROM documents)
, c AS (SELECT h.doc_id, q, w, CASE WHEN q = '' THEN 0 ELSE (length(w) - length(replace(w, q, ''))) // length(q) END AS n FROM h JOIN d ON d.doc_id = h.doc_id)
, p AS (SELECT doc_id, CASE WHEN n = 0 THEN 'unresolved' WHEN n = 1 THEN 'mapped' ELSE 'ambiguous' END AS state,
  CASE WHEN n = 1 THEN strpos(w, q) - 1 - (length(substr(w, 1, strpos(w, q))) - length(replace(substr(w, 1, strpos(w, q)), chr(10), ''))) END AS range_start,
  length(q) AS size FROM c)
"""


def marks(t):
    none = F.lit(None).cast("string")
    return t.documents.select(
        "doc_id",
        F.col("doc_id").alias("highlight_id"),
        F.lit(1).alias("user_id"),
        F.substr("text", F.floor(F.length("text") / 2).cast("int"), F.lit(40)).alias("selected_text"),
        none.alias("block_id"), none.alias("prefix"), none.alias("suffix"),
        F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("int").alias("start_offset"),
        F.col("doc_id").alias("created_at"),
    )


@query("anchors_placed", PLACED + "SELECT doc_id, state, CAST(range_start AS INT) AS range_start, CAST(range_start + size AS INT) AS range_end FROM p")
def _(t):
    return A.placed(marks(t), A.index(lines(t), "doc_id"), "doc_id").select("doc_id", "state", "range_start", "range_end")


@query("anchors_placed_in_blocks", LINES + """
, f AS (SELECT doc_id, ord, words, start, row_number() OVER (PARTITION BY doc_id ORDER BY length(words) DESC, ord) AS n FROM o)
SELECT doc_id, CASE WHEN length(words) > 0 THEN 'mapped' ELSE 'unresolved' END AS state,
  CASE WHEN length(words) > 0 THEN CAST(start AS INT) END AS range_start FROM f WHERE n = 1""")
def _(t):
    rows = lines(t)
    longest = rows.groupBy("doc_id").agg(F.max_by(F.struct("block_id", "text"), F.struct(F.length("words"), -F.col("ord"))).alias("r"))
    h = marks(t).drop("block_id", "selected_text").join(longest.select("doc_id", "r.block_id", F.col("r.text").alias("selected_text")), "doc_id")
    return A.placed(h, A.index(rows, "doc_id"), "doc_id").select("doc_id", "state", "range_start")


@query("anchors_rechecked", PLACED + """
SELECT state, count(*) AS n FROM p WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1""")
def _(t):
    out = A.recheck(marks(t), A.index(lines(t), "doc_id"), t.labels.select("doc_id").distinct(), "doc_id")
    return out.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("anchor_spots_read", LINES + """
SELECT doc_id, coalesce(string_agg(words, '' ORDER BY ord) FILTER (WHERE words <> '' AND NOT (doc_id % 3 = 0 AND ord = 1))
  = string_agg(words, '' ORDER BY ord), false) AS reads FROM b GROUP BY doc_id""")
def _(t):
    rows = lines(t)
    kept = rows.filter((F.length("words") > 0) & ~((F.col("doc_id") % 3 == 0) & (F.col("ord") == 1))).select(
        "doc_id", F.col("doc_id").alias("id"), "block_id", F.lit(0).alias("span_start"), F.length("words").alias("span_end")
    )
    passages = t.documents.select("doc_id", F.col("doc_id").alias("id"), F.col("text").alias("selected_text"))
    return A.spots_read(kept, rows, "doc_id", "id", passages).select("doc_id", "reads")


@query("find_in_texts", """
WITH f AS (SELECT doc_id, string_split(translate(strip_accents(lower(text)), 'đ', 'd'), 'ther') AS p FROM documents),
e AS (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM f WHERE len(p) > 1)
SELECT doc_id, CAST(length(array_to_string(p[1:i], '')) + (i - 1) * 4 AS INT) AS start FROM e""")
def _(t):
    return A.find_matches(t.documents, "doc_id", "text", "Thér").select("doc_id", "start")


@query("find_in_texts_loose")
def _(t):
    found = A.find_matches(t.documents, "doc_id", "text", "of the", loose=True)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("matches"), F.max("end").alias("last"))


@query("sentences_around")
def _(t):
    word = F.regexp_extract(F.substr("text", F.floor(F.length("text") / 2).cast("int"), F.lit(60)), r"\s(\S+ \S+)\s", 1)
    return t.documents.select("doc_id", A.sentence_around(F.col("text"), word).alias("sentence"))


# ---- geometry: line items as boxes on pages


RECTS = """
WITH r AS (SELECT l_suppkey % 20 AS doc, l_linenumber AS page, l_suppkey AS owner, l_returnflag, l_discount * 8 AS x, l_tax * 10 AS y,
  l_quantity / 250 AS w, 0.02 + l_tax AS h FROM lineitem)
"""


# The same boxes with an order as the document, for what compares boxes with each other.
RECTS_BY_ORDER = RECTS.replace("l_suppkey % 20 AS doc", "l_orderkey AS doc").replace("l_linenumber AS page", "l_linenumber % 2 AS page")


def rects_by_order(t):
    page = (F.col("l_linenumber") % 2).alias("page")
    return rects(t, F.col("l_orderkey"), page)


def rects(t, doc=None, page=None):
    return t.lineitem.select(
        (doc if doc is not None else F.col("l_suppkey") % 20).alias("doc"), page if page is not None else F.col("l_linenumber").alias("page"), F.col("l_suppkey").alias("owner"), "l_returnflag",
        (F.col("l_discount") * 8).alias("x"), (F.col("l_tax") * 10).alias("y"), (F.col("l_quantity") / 250).alias("w"), (0.02 + F.col("l_tax")).alias("h"),
    )


@query("selections_of_same_area", RECTS_BY_ORDER + """
, a AS (SELECT * FROM r WHERE l_returnflag = 'A'), b AS (SELECT * FROM r WHERE l_returnflag <> 'A')
, s AS (SELECT a.doc, a.page, a.owner AS id_a, b.owner AS id_b, sum(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))
  * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))) AS shared FROM a JOIN b ON a.doc = b.doc AND a.page = b.page GROUP BY 1, 2, 3, 4)
, x AS (SELECT doc, page, owner, sum(w * h) AS area FROM a GROUP BY 1, 2, 3), y AS (SELECT doc, page, owner, sum(w * h) AS area FROM b GROUP BY 1, 2, 3)
SELECT s.doc, s.page, id_a, id_b, round(shared / least(x.area, y.area), 4) AS ratio FROM s JOIN x ON x.doc = s.doc AND x.page = s.page AND x.owner = id_a
JOIN y ON y.doc = s.doc AND y.page = s.page AND y.owner = id_b WHERE shared / least(x.area, y.area) >= 0.5""")
def _(t):
    r = rects_by_order(t)
    a = r.filter("l_returnflag = 'A'").withColumnRenamed("owner", "id_a")
    b = r.filter("l_returnflag <> 'A'").withColumnRenamed("owner", "id_b")
    return G.same_area(a, b, ["doc", "page"]).withColumn("ratio", F.round("ratio", 4))


@query("points_in_boxes", RECTS_BY_ORDER + """
, c AS (SELECT o_custkey AS ord, o_orderkey AS doc, o_custkey % 2 AS page, (o_totalprice % 1000) / 1000 AS cx, (o_totalprice % 777) / 777 AS cy FROM orders)
, b AS (SELECT * FROM r)
SELECT DISTINCT c.doc, c.page, owner, ord FROM c JOIN b ON b.doc = c.doc AND b.page = c.page AND cx BETWEEN x - 0.004 AND x + w + 0.004
  AND cy BETWEEN y - 0.004 AND y + h + 0.004""")
def _(t):
    cx, cy = (F.col("o_totalprice") % 1000) / 1000, (F.col("o_totalprice") % 777) / 777
    chars = t.orders.select(
        F.col("o_custkey").alias("ord"), F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 2).cast("int").alias("page"),
        cx.alias("x0"), cx.alias("x1"), cy.alias("y0"), cy.alias("y1"),
    )
    return G.chars_in_boxes(chars, rects_by_order(t), ["doc", "page"], "owner")


@query("boxes_per_line", RECTS + """
, b AS (SELECT doc, page, owner, greatest(0, min(x)) AS x0, greatest(0, min(y)) AS y0, least(1, max(x + w)) AS x1, least(1, max(y + h)) AS y1 FROM r GROUP BY 1, 2, 3)
SELECT doc, page, owner, round(x0, 5) AS x, round(y0, 5) AS y, round(x1 - x0, 5) AS w, round(y1 - y0, 5) AS h FROM b WHERE round(x1 - x0, 5) > 0 AND round(y1 - y0, 5) > 0""")
def _(t):
    chars = rects(t).select(
        "doc", "page", "owner", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1")
    )
    return G.line_boxes(chars, ["doc", "page"], "owner")


@query("boxes_as_page_fractions", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(greatest(l_quantity - 5, 0) / 612, 4) AS x, round(l_discount * 100 / 792, 4) AS y,
  round(greatest(least(l_quantity * 20, 612) - greatest(l_quantity - 5, 0), 0) / 612, 4) AS w, round(greatest(least(700 + l_tax * 2000, 792) - l_discount * 100, 0) / 792, 4) AS h FROM lineitem""")
def _(t):
    box = G.source_box(
        F.col("l_quantity") - 5, F.col("l_discount") * 100, F.col("l_quantity") * 20, 700 + F.col("l_tax") * 2000, F.lit(612.0), F.lit(792.0)
    )
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *box)


@query("rules_joined", """
WITH r AS (SELECT o_custkey, o_totalprice AS lo, o_totalprice + 9000 AS hi FROM orders),
m AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 500 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM m)
SELECT o_custkey, min(lo) AS lo, max(hi) AS hi, count(*) AS pieces FROM i GROUP BY o_custkey, i""")
def _(t):
    r = t.orders.select("o_custkey", F.col("o_totalprice").alias("lo"), (F.col("o_totalprice") + 9000).alias("hi"))
    return G.joined_stretches(r, ["o_custkey"], "lo", "hi", 500)


@query("selection_boxes_merged")
def _(t):
    # An order's items are one selection: a handful of boxes.
    r = rects_by_order(t).groupBy("doc", "page").agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("r"))
    return r.select("doc", "page", F.size("r").alias("boxes"), F.size(G.merge_rects(F.col("r"))).alias("lines"))


@query("page_runs", """
WITH d AS (SELECT DISTINCT l_orderkey, l_partkey % 12 AS p FROM lineitem),
i AS (SELECT *, p - row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS g FROM d),
r AS (SELECT l_orderkey, min(p) AS a, max(p) AS z, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(p)) AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM i GROUP BY l_orderkey, g)
SELECT l_orderkey, string_agg(CASE WHEN a = z THEN CAST(a AS VARCHAR) ELSE a || '–' || z END, ', ' ORDER BY a) FILTER (WHERE n <= 6)
  || CASE WHEN max(c) > 6 THEN ', …' ELSE '' END AS runs FROM r GROUP BY l_orderkey""")
def _(t):
    from readlake.functions import scalars as S

    # Page numbers are few, so they are made unique before a group's list is built.
    pages = t.lineitem.select("l_orderkey", (F.col("l_partkey") % 12).alias("p")).distinct()
    return pages.groupBy("l_orderkey").agg(S.page_runs(F.collect_list("p")).alias("runs"))
