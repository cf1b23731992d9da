"""The cleaning chain over page items; lines of the given texts make pages with running lines, scans, parts, broken words."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.operators import cleaning as C
from readlake.operators import evals as V
from readlake.operators import roles as R
from readlake.plans.registry import query
from readlake.session import pinned

#: Joins the halves of a word cut at a line's end.
CUT = "-⁣"


def _lines(t):
    """The lines as (doc_id, source, page, k: its place there, w: its words, c: what it is to be, scan)."""
    rows = t.documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "line")).filter("line <> ''")
    rows = rows.select("doc_id", "source", (F.floor(F.col("i") / 5) + 1).cast("int").alias("page"), (F.col("i") % 5).alias("k"), F.translate(F.md5("line"), "0123456789", "ghijklmnop").alias("w"), ((F.col("i") * 7 + F.col("doc_id")) % 13).alias("c"))
    scan = (F.col("doc_id") % 5 == 0) & (F.col("page") % 4 == 2)
    return rows.withColumn("scan", scan).filter("not scan or k = 0")


def items(t):
    """Five lines a page, each line's words told by its digest; a header, a page number, a licence line; every fourth page of every
    fifth document is a scan."""
    rows = _lines(t)
    c, w = F.col("c"), F.col("w")
    text = (
        F.when(F.col("scan"), F.concat(F.lit("<!-- scan "), F.col("page").cast("string"), F.lit(" -->")))
        .when(c == 1, F.concat(F.lit("Open "), w)).when(c == 2, F.concat(w, F.lit(" goes on."))).when(c == 3, F.concat(F.lit("Broken "), F.substring(w, 1, 6), F.lit("-")))
        .when(c == 5, F.lit(f"See exam{CUT}ple and miss{CUT}ing here.")).when(c == 6, F.lit("An example stands here.")).when(c == 7, F.lit("## Funding")).when(c == 8, F.lit("## Results"))
        .when(c == 10, F.concat(F.lit("("), w, F.lit(" in brackets).")))
        .when(c == 11, F.concat(F.lit("Word "), w, F.lit(". Correspondence to: Ann <ann@"), F.col("source"), F.lit(".org>.")))
        .otherwise(F.concat(F.lit("Word "), w, F.lit(".")))
    )
    k = F.col("k")
    num = lambda v, n: v.cast("double").alias(n)
    body = rows.select(
        "doc_id", "page", (k + 1).cast("int").alias("ord"), num(F.when(k.isin(1, 3), 310.0).otherwise(50.0), "x0"), num(100 + k * 120, "y0"),
        num(F.when(k.isin(2, 4), 290.0).otherwise(550.0), "x1"), num(180 + k * 120, "y1"), text.alias("text"), F.when(F.col("scan"), "ocr").otherwise("text").alias("kind"),
    )
    marks = F.array(
        F.struct(F.lit(0).alias("ord"), *[F.lit(v).alias(n) for n, v in (("x0", 50.0), ("y0", 20.0), ("x1", 550.0), ("y1", 40.0))], F.concat(F.lit("Journal of "), "source", F.lit(" vol "), F.col("page").cast("string")).alias("text")),
        F.struct(F.lit(6).alias("ord"), *[F.lit(v).alias(n) for n, v in (("x0", 290.0), ("y0", 760.0), ("x1", 310.0), ("y1", 780.0))], F.col("page").cast("string").alias("text")),
        F.struct(F.lit(7).alias("ord"), *[F.lit(v).alias(n) for n, v in (("x0", 50.0), ("y0", 700.0), ("x1", 550.0), ("y1", 715.0))], F.concat(F.lit("© "), "source", F.lit(" all rights reserved")).alias("text")),
    )
    edge = rows.filter("not scan").select("doc_id", "page", "source").distinct().select("doc_id", "page", F.explode(marks).alias("m")).select("doc_id", "page", "m.*", F.lit("text").alias("kind"))
    both = body.unionByName(edge.filter("ord < 7 or page = 1"))
    return both.withColumns({"size": F.lit(10.0), "page_width": F.lit(600.0), "page_height": F.lit(800.0), "bold": F.lit(False)})


def scans_read(t):
    """Every second scanned page, read as a line and a heading."""
    pages = items(t).filter("kind = 'ocr' and page % 8 = 2")
    return pages.select("doc_id", "page", F.concat(F.lit("Read "), F.col("page").cast("string"), F.lit("\n\n## Results")).alias("text"))


BOX = "page || ':' || round(x0 / 600.0 * 10000)::INT || ':' || round(y0 / 800.0 * 10000)::INT || ':' || round((x1 - x0) / 600.0 * 10000)::INT || ':' || round((y1 - y0) / 800.0 * 10000)::INT"
CHAIN = """
WITH RECURSIVE l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
r AS (SELECT doc_id, source, i // 5 + 1 AS page, i % 5 AS k, translate(md5(line), '0123456789', 'ghijklmnop') AS w, (i * 7 + doc_id) % 13 AS c, doc_id % 5 = 0 AND (i // 5 + 1) % 4 = 2 AS scan FROM l WHERE line <> ''),
b AS (SELECT doc_id, source, page, k + 1 AS ord, CASE WHEN k IN (1, 3) THEN 310 ELSE 50 END AS x0, 100 + k * 120 AS y0, CASE WHEN k IN (2, 4) THEN 290 ELSE 550 END AS x1, 180 + k * 120 AS y1, c, scan,
  CASE WHEN scan THEN '<!-- scan ' || page || ' -->' WHEN c = 1 THEN 'Open ' || w WHEN c = 2 THEN w || ' goes on.' WHEN c = 3 THEN 'Broken ' || substr(w, 1, 6) || '-' WHEN c = 5 THEN 'See exam@ple and miss@ing here.'
  WHEN c = 6 THEN 'An example stands here.' WHEN c = 7 THEN '## Funding' WHEN c = 8 THEN '## Results' WHEN c = 10 THEN '(' || w || ' in brackets).' ELSE 'Word ' || w || '.' END AS text FROM r WHERE NOT scan OR k = 0),
pg AS (SELECT doc_id, source, page, bool_or(scan) AS scan FROM b GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE NOT scan) AS headed FROM pg GROUP BY 1),
-- Set aside on sight: running headers, page numbers, the licence line, contact sentences.
head AS (SELECT doc_id, page, 0 AS ord, 50 AS x0, 20 AS y0, 550 AS x1, 40 AS y1, 'Journal of ' || source || ' vol ' || page AS text, pages > 1 AND headed >= least(3, pages) AS aside FROM pg JOIN n USING (doc_id) WHERE NOT scan),
early AS (SELECT doc_id, page, ord, x0, y0, x1, y1, text, 'RUNNING_HEADER' AS type FROM head WHERE aside
  UNION ALL SELECT doc_id, page, 6, 290, 760, 310, 780, page::VARCHAR, 'PAGE_NUMBER' FROM pg WHERE NOT scan
  UNION ALL SELECT doc_id, page, 7, 50, 700, 550, 715, '© ' || source || ' all rights reserved', 'PUBLISHER_INFO' FROM pg WHERE NOT scan AND page = 1
  UNION ALL SELECT doc_id, page, ord, x0, y0, x1, y1, 'Correspondence to: Ann <ann@' || source || '.org>.', 'AUTHORS' FROM b WHERE c = 11 AND NOT scan),
up AS (SELECT doc_id, page, ord, x0, y0, x1, y1, text FROM b UNION ALL SELECT doc_id, page, ord, x0, y0, x1, y1, text FROM head WHERE NOT aside),
mid AS (SELECT *, (min(x0) OVER p + max(x1) OVER p) / 2 AS m, (max(x1) OVER p - min(x0) OVER p) * 0.1 AS s FROM up WINDOW p AS (PARTITION BY doc_id, page)),
sp AS (SELECT *, CASE WHEN x0 < m - s AND x1 > m + s THEN 1 ELSE 0 END AS wide FROM mid),
band AS (SELECT *, sum(wide) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ord ROWS UNBOUNDED PRECEDING) AS band FROM sp),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, CASE WHEN wide = 1 THEN 0 WHEN (x0 + x1) / 2 < m THEN 1 ELSE 2 END, y0, x0, ord) AS n FROM band),
typed AS (SELECT *, last_value(CASE text WHEN '## Funding' THEN 'FUNDING' WHEN '## Results' THEN '' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, n ROWS UNBOUNDED PRECEDING) AS part FROM o),
f AS (SELECT doc_id, page, n, text, {box} AS box, row_number() OVER (PARTITION BY doc_id, page ORDER BY n) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC) AS z FROM typed WHERE coalesce(part, '') <> 'FUNDING'),
p AS (SELECT *, coalesce(regexp_matches(tail, '^[A-Z(a-z]') AND regexp_matches(tail, '[^.!?:;)>]$') AND regexp_matches(nh, '^[a-z(]'), FALSE) AS cond FROM (
  SELECT *, lead(hd) OVER d AS nh, lead(hbox) OVER d AS nbox, row_number() OVER d AS rn FROM (
    SELECT doc_id, page, count(*) AS size, max(CASE WHEN a = 1 THEN text END) AS hd, max(CASE WHEN a = 1 THEN box END) AS hbox, max(CASE WHEN z = 1 THEN text END) AS tail FROM f GROUP BY 1, 2) WINDOW d AS (PARTITION BY doc_id ORDER BY page))),
j AS (SELECT doc_id, rn, cond AS f FROM p WHERE rn = 1 UNION ALL SELECT p.doc_id, p.rn, p.cond AND NOT (p.size = 1 AND j.f) FROM j JOIN p ON p.doc_id = j.doc_id AND p.rn = j.rn + 1),
jp AS (SELECT p.*, j.f, coalesce(lag(j.f) OVER (PARTITION BY doc_id ORDER BY rn), FALSE) AS taken FROM p JOIN j USING (doc_id, rn)),
whole AS (SELECT f.doc_id, f.page, f.n, CASE WHEN jp.f AND z = 1 THEN text || CASE WHEN text LIKE '%-' THEN '' ELSE ' ' END || nh ELSE text END AS text,
  CASE WHEN jp.f AND z = 1 THEN box || ',' || nbox ELSE box END AS boxes FROM f JOIN jp USING (doc_id, page) WHERE NOT (taken AND a = 1)),
-- 'example' is printed whole where a document has the sentence; 'missing' never is.
seen AS (SELECT doc_id, bool_or(c = 6 AND NOT scan) AS whole FROM b GROUP BY 1),
fixed AS (SELECT doc_id, page, n, replace(replace(text, 'exam@ple', CASE WHEN whole THEN 'example' ELSE 'exam-ple' END), 'miss@ing', 'miss-ing') AS text, boxes FROM whole JOIN (SELECT doc_id, whole FROM seen) s(doc_id, whole) USING (doc_id)),
parts AS (SELECT doc_id, page, n, CASE WHEN text LIKE '<%' THEN 'Read ' || page || chr(10) || chr(10) || '## Results' ELSE text END AS text, CASE WHEN text LIKE '<%' THEN page || ':0:0:10000:10000' ELSE boxes END AS boxes
  FROM fixed WHERE text NOT LIKE '<%' OR page % 8 = 2)
""".replace("{box}", BOX)


def shown(box):
    """A box in ten-thousandths of its page."""
    whole = [F.round(box[c] * 10000).cast("int").cast("string") for c in "xywh"]
    return F.concat_ws(":", box["page"].cast("string"), *whole)


def cleaned(t):
    return C.clean(items(t), scans_read(t))


@query("clean_contents", CHAIN + """
SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page)) AS content FROM (SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text FROM parts GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    return cleaned(t).content.select("doc_id", F.md5("content").alias("content"))


@query("clean_source_map", CHAIN + """
, keyed AS (SELECT doc_id, page, n, boxes, unnest(string_split(text, chr(10) || chr(10))) AS raw, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS k FROM parts)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, n, k) AS ord, printf('%08x', list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(raw, ''), lambda x: ord(x)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)) AS key, boxes FROM keyed""")
def _(t):
    return cleaned(t).source_map.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "key", F.array_join(F.transform("boxes", shown), ",").alias("boxes"))


SIDE = """
, late AS (SELECT doc_id, page, 1 AS half, n, 0 AS y0, 0 AS x0, 0 AS ord, text, 'FUNDING' AS type, {box} AS box FROM (SELECT doc_id, page, n, x0, y0, x1, y1, text FROM typed WHERE part = 'FUNDING'))
, every AS (SELECT doc_id, page, CASE WHEN y0 < 400 THEN 0 ELSE 2 END AS half, 0 AS n, y0, x0, ord, text, type, {box} AS box FROM early UNION ALL SELECT * FROM late)
""".replace("{box}", BOX)


@query("clean_side_store", CHAIN + SIDE + """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, half, n, y0, x0, ord, text) AS ord, type, replace(replace(text, 'exam@ple', CASE WHEN whole THEN 'example' ELSE 'exam-ple' END), 'miss@ing', 'miss-ing') AS text, page, box,
  CASE WHEN type IN ('RUNNING_HEADER', 'PAGE_NUMBER') THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence FROM every JOIN seen USING (doc_id)""")
def _(t):
    return cleaned(t).aside.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "type", "text", "page", shown(F.col("box")).alias("box"), "confidence")


# ---- how well it was cleaned: the lines themselves are the labels


@query("eval_cleaning_shares", CHAIN + SIDE + """
, flow AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, n) - 1 AS block, lower(trim(regexp_replace(regexp_replace(text, '(^|\\n)#{1,6}\\s+', '\\1', 'g'), '\\s+', ' ', 'g'))) AS t, text, boxes FROM parts)
, side AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, half, n, y0, x0, ord, text) AS ord, type, lower(regexp_replace(text, '^#{1,6}\\s+', '')) AS t FROM every)
, lab AS (SELECT doc_id, page, k + 1 AS ord, CASE c WHEN 4 THEN 'MAIN' WHEN 0 THEN 'SUPPLEMENTARY' ELSE 'FIGURE_TEXT' END AS grp, 'word ' || w || '.' AS t, c = 4 AS placed FROM r WHERE c IN (0, 4, 12) AND NOT scan
  UNION ALL SELECT doc_id, page, 0, 'FURNITURE', lower('Journal of ' || source || ' vol ' || page), FALSE FROM pg WHERE NOT scan UNION ALL SELECT doc_id, page, 7, 'METADATA', lower('© ' || source || ' all rights reserved'), FALSE FROM pg WHERE NOT scan AND page = 1)
, inflow AS (SELECT lab.doc_id, lab.page, lab.ord, sum((length(f.t) - length(replace(f.t, lab.t, ''))) // length(lab.t)) AS n, min(CASE WHEN contains(f.t, lab.t) THEN block END) AS block FROM lab JOIN flow f USING (doc_id) GROUP BY 1, 2, 3)
, inside AS (SELECT lab.doc_id, lab.page, lab.ord, arg_min(s.type, s.ord) AS type FROM lab JOIN side s ON s.doc_id = lab.doc_id AND contains(s.t, lab.t) GROUP BY 1, 2, 3)
, lj AS (SELECT lab.*, coalesce(n, 0) AS n, block, CASE WHEN type IN ('RUNNING_HEADER', 'PAGE_NUMBER') THEN 'FURNITURE' WHEN type IN ('PUBLISHER_INFO', 'AUTHORS') THEN 'METADATA' WHEN type = 'FUNDING' THEN 'SUPPLEMENTARY' END AS filed
  FROM lab LEFT JOIN inflow USING (doc_id, page, ord) LEFT JOIN inside USING (doc_id, page, ord))
, pr AS (SELECT a.doc_id, 'word ' || a.w || '.' AS a, 'word ' || b.w || '.' AS b, a.page % 2 = 0 AS next FROM r a JOIN r b ON b.doc_id = a.doc_id AND b.page = a.page AND b.k = a.k + 1 WHERE NOT a.scan)
, at_a AS (SELECT pr.doc_id, pr.a, min((block, position(pr.a IN f.t))) AS p FROM (SELECT DISTINCT doc_id, a FROM pr) pr JOIN flow f ON f.doc_id = pr.doc_id AND contains(f.t, pr.a) GROUP BY 1, 2)
, at_b AS (SELECT pr.doc_id, pr.b, min((block, position(pr.b IN f.t))) AS p FROM (SELECT DISTINCT doc_id, b FROM pr) pr JOIN flow f ON f.doc_id = pr.doc_id AND contains(f.t, pr.b) GROUP BY 1, 2)
, pres AS (SELECT CASE WHEN x.p IS NULL OR y.p IS NULL THEN NULL WHEN next THEN y.p[1] = x.p[1] + 1 OR (y.p[1] = x.p[1] AND y.p[2] > x.p[2]) ELSE x.p < y.p END AS ok FROM pr LEFT JOIN at_a x ON x.doc_id = pr.doc_id AND x.a = pr.a LEFT JOIN at_b y ON y.doc_id = pr.doc_id AND y.b = pr.b)
, wd AS (SELECT d.doc_id, h.a, h.b, NOT coalesce(bool_or(contains(f.text, h.a || '-' || h.b)), FALSE) AS ok FROM pg d CROSS JOIN (VALUES ('exam', 'ple'), ('miss', 'ing')) h(a, b) LEFT JOIN flow f ON f.doc_id = d.doc_id GROUP BY 1, 2, 3)
-- Printed where they stood, or a page further in odd documents; of every fifth document nothing is known.
, pl AS (SELECT l.doc_id % 5 <> 0 AS known, EXISTS (SELECT 1 FROM (SELECT unnest(string_split(f.boxes, ',')) AS x) WHERE split_part(x, ':', 1)::INT = l.page + l.doc_id % 2 AND split_part(x, ':', 2)::INT < round(b.x1 / 600.0 * 10000) AND split_part(x, ':', 2)::INT + split_part(x, ':', 4)::INT > round(b.x0 / 600.0 * 10000)
  AND split_part(x, ':', 3)::INT < round(b.y1 / 800.0 * 10000) AND split_part(x, ':', 3)::INT + split_part(x, ':', 5)::INT > round(b.y0 / 800.0 * 10000)) AS ok FROM lj l JOIN flow f ON f.doc_id = l.doc_id AND f.block = l.block JOIN b ON b.doc_id = l.doc_id AND b.page = l.page AND b.ord = l.ord WHERE placed)
, m AS (SELECT 'main_kept' AS measure, n > 0 AS hit FROM lj WHERE grp = 'MAIN' UNION ALL SELECT 'furniture_suppressed', n = 0 FROM lj WHERE grp = 'FURNITURE' UNION ALL SELECT 'figure_text_suppressed', n = 0 FROM lj WHERE grp = 'FIGURE_TEXT'
  UNION ALL SELECT 'metadata_separated', n = 0 FROM lj WHERE grp = 'METADATA' UNION ALL SELECT 'supplementary_separated', n = 0 FROM lj WHERE grp = 'SUPPLEMENTARY'
  UNION ALL SELECT 'kept_somewhere', n > 0 OR filed IS NOT NULL FROM lj WHERE grp IN ('METADATA', 'SUPPLEMENTARY', 'FURNITURE') UNION ALL SELECT 'reading_order', ok FROM pres WHERE ok IS NOT NULL
  UNION ALL SELECT 'typed_right', filed = grp FROM lj WHERE filed IS NOT NULL AND (grp <> 'MAIN' OR n = 0) UNION ALL SELECT 'checks', doc_id % 3 = 0 FROM (SELECT DISTINCT doc_id FROM pg) UNION ALL SELECT 'words_rejoined', ok FROM wd UNION ALL SELECT 'provenance', ok FROM pl WHERE known)
SELECT measure, count(*) FILTER (WHERE hit) AS hit, count(*) AS of, round(count(*) FILTER (WHERE hit) / count(*), 3) AS rate FROM m GROUP BY 1""")
def _(t):
    lines, word = _lines(t), F.concat(F.lit("Word "), "w", F.lit("."))
    out = cleaned(t)
    flow = pinned(out.parts.select("doc_id", F.struct("page", "n").alias("ord"), "text", "boxes"), "flow")
    side = pinned(out.aside, "side")
    named = lambda kind, group, text, ord_: [F.concat_ws("-", F.col("page").cast("string"), ord_.cast("string")).alias("label_id"), kind.alias("type"), group.alias("group"), text.alias("text"), F.lit(False).alias("whole"), F.lit(0).alias("max_in_flow")]
    c, clear = F.col("c"), lines.filter("not scan")
    body = clear.filter("c in (0, 4, 12)").select("doc_id", *named(F.when(c == 4, "BODY").when(c == 0, "FUNDING").otherwise("AXIS"), F.when(c == 4, "MAIN").when(c == 0, "SUPPLEMENTARY").otherwise("FIGURE_TEXT"), word, F.col("k") + 1))
    heads = clear.select("doc_id", "page", "source").distinct()
    over = heads.select("doc_id", *named(F.lit("RUNNING_HEADER"), F.lit("FURNITURE"), F.concat(F.lit("Journal of "), "source", F.lit(" vol "), F.col("page").cast("string")), F.lit(0)))
    legal = heads.filter("page = 1").select("doc_id", *named(F.lit("PUBLISHER_INFO"), F.lit("METADATA"), F.concat(F.lit("© "), "source", F.lit(" all rights reserved")), F.lit(7)))
    labels = pinned(body.unionByName(over).unionByName(legal), "labels")
    after = lines.select("doc_id", "page", (F.col("k") - 1).alias("k"), word.alias("b"))
    pairs = clear.select("doc_id", "page", "k", word.alias("a"), (F.col("page") % 2 == 0).alias("next")).join(after, ["doc_id", "page", "k"]).select("doc_id", "a", "b", "next")
    halves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("exam", "ple"), ("miss", "ing"))])).alias("h")
    every = lines.select("doc_id").distinct()
    boxed = items(t).filter("kind = 'text' and ord between 1 and 5 and doc_id % 5 <> 0").withColumn("page", F.col("page") + (F.col("doc_id") % 2).cast("int")).select(
        "doc_id", F.concat_ws("-", (F.col("page") - F.col("doc_id") % 2).cast("int").cast("string"), F.col("ord").cast("string")).alias("label_id"), C.own_box().alias("b")
    ).select("doc_id", "label_id", "b.*")
    return V.cleaning_shares(
        V.judged_labels(labels, flow, side, "doc_id"), V.judged_pairs(pairs, flow, "doc_id"), every.select((F.col("doc_id") % 3 == 0).alias("ok")),
        V.judged_words(every.select("doc_id", halves).select("doc_id", "h.*"), flow, "doc_id"), V.judged_places(labels, flow, boxed, "doc_id"), F.upper(R.group_of(F.col("in_side"))),
    )
