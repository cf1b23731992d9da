"""Generated results, mind maps and measures. Answers in the models' JSON shapes are built from the orders, parts,
events and documents, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.functions import text as X
from readlake.operators import artifacts as A
from readlake.operators import evals as V
from readlake.operators import tree as T
from readlake.plans.registry import query


def point(text, *sources):
    return F.struct(text.alias("text"), F.array(*sources).alias("sources"))


def quick(t):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    take = F.transform(
        F.sequence(F.lit(1), (k % 7).cast("int")),
        lambda i: F.struct(F.concat(F.lit("<b>Point</b>  "), s(i)).alias("text"), F.array(s(k % 12), F.lit("x"), s(i), s(i)).alias("sources")),
    )
    body = F.to_json(F.struct(F.col("o_orderpriority").alias("tldr"), F.array(s(k % 5)).alias("tldr_sources"), F.when(k % 7 > 0, take).alias("takeaways")))
    body = F.when(k % 13 == 0, "{broken").otherwise(body)
    return t.orders.select(k.alias("result_id"), k.alias("document_id"), body.alias("body"), F.lit(8).alias("total"), "o_orderpriority")


@query("result_quick_checked", """
SELECT o_orderkey AS result_id, CASE WHEN o_orderkey % 13 = 0 THEN 'not JSON' WHEN o_orderkey % 7 < 3 THEN 'schema mismatch' END AS problem,
  CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE least(o_orderkey % 7, 5) END AS takeaways FROM orders""")
def _(t):
    out = A.parse_quick(quick(t))
    return out.select("result_id", "problem", F.size("takeaways").cast("bigint").alias("takeaways"))


@query("result_quick_note", """
WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderkey % 5 AS a, o_orderkey % 12 AS b FROM orders WHERE o_orderkey % 13 <> 0),
q AS (SELECT *, CASE WHEN a > 0 THEN ' [1]' ELSE '' END AS t FROM o)
SELECT k AS result_id, p || t AS tldr FROM q""")
def _(t):
    out = A.parse_quick(quick(t)).filter("problem IS NULL OR problem <> 'not JSON'")
    return out.select("result_id", A.quick_note(F.lit("tldr")).alias("tldr"))


@query("result_quick_text")
def _(t):
    out = A.parse_quick(quick(t)).filter("problem IS NULL")
    return out.select("result_id", A.quick_note(F.lit("all")).alias("note"), A.quick_text(out).alias("search_text"))


def sections(t, names):
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    pts = lambda n: F.transform(F.sequence(F.lit(1), (k % (n + 2) + 1).cast("int")), lambda i: F.struct(F.concat("p_name", F.lit(" "), s(i)).alias("text"), F.array(s(i), s(k % 9)).alias("sources")))
    body = F.struct(
        F.when(k % 3 == 0, "research").when(k % 3 == 1, "essay").otherwise("nonsense").alias("document_type"),
        F.array(F.col("p_type"), F.lit(" ")).alias("questions"),
        *(pts(n).alias(name) for n, name in enumerate(names)),
    )
    return t.part.select(k.alias("result_id"), F.to_json(body).alias("body"), F.lit(6).alias("total"))


@query("result_deep_checked", """
SELECT p_partkey AS result_id, CASE p_partkey % 3 WHEN 0 THEN 'research' WHEN 1 THEN 'essay' ELSE 'other' END AS document_type,
  CAST(NULL AS VARCHAR) AS problem, p_type AS question, p_name || ' 1 [1]' || CASE WHEN p_partkey % 9 BETWEEN 2 AND 6 THEN '[2]' ELSE '' END AS first FROM part
WHERE p_partkey % 2 + 1 + p_partkey % 3 + 1 + p_partkey % 4 + 1 >= 3""")
def _(t):
    out = A.parse_deep(sections(t, A.SECTIONS))
    return out.select("result_id", "document_type", "problem", F.get("questions", F.lit(0)).alias("question"), A.section_note(F.lit("context:0"), A.SECTIONS).alias("first"))


@query("result_analysis_checked", """
SELECT p_partkey AS result_id, CASE WHEN p_partkey % 3 <> 0 THEN 'not research' END AS problem FROM part""")
def _(t):
    return A.parse_analysis(sections(t, A.FIELDS)).select("result_id", "problem")


@query("result_section_text")
def _(t):
    out = A.parse_deep(sections(t, A.SECTIONS))
    return out.select("result_id", A.section_note(F.lit("all"), A.SECTIONS, "questions").alias("note"), A.sections_text(A.SECTIONS, F.col("questions")).alias("search_text"))


@query("result_citations", """
SELECT p_partkey AS result_id, n AS position, n AS page_number FROM part, (VALUES (1), (2), (3)) v(n) WHERE n <= 3 - p_partkey % 3""")
def _(t):
    cited = F.sequence(F.lit(1), (3 - F.col("p_partkey") % 3).cast("int"))
    results = t.part.select(F.col("p_partkey").alias("result_id"), F.col("p_partkey").alias("document_id"), cited.alias("cited"))
    passages = t.part.select(F.col("p_partkey").alias("document_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("position"))
    passages = passages.select("document_id", "position", F.col("position").alias("page_number"), F.lit("h").alias("heading"), F.lit("t").alias("text"))
    return A.citations(results, passages).select("result_id", "position", "page_number")


@query("result_summary_checked", """
SELECT p_partkey AS result_id, 1 AS key_points, p_name || ',' || p_type AS keywords, 1 AS concepts, p_brand AS conclusion FROM part""")
def _(t):
    body = F.to_json(
        F.struct(
            F.array(F.col("p_name"), F.lit("  ")).alias("key_points"),
            F.array(F.struct(F.col("p_name").alias("term"), F.lit("x").alias("explanation")), F.struct(F.lit("t").alias("term"), F.lit(" ").alias("explanation"))).alias("concepts"),
            F.concat(F.lit(" "), "p_brand").alias("conclusion"),
            F.array(F.col("p_name"), F.upper("p_name"), F.col("p_type"), F.lower("p_type")).alias("keywords"),
        )
    )
    out = A.parse_summary(t.part.select(F.col("p_partkey").alias("result_id"), body.alias("body")))
    return out.select("result_id", F.size("key_points").alias("key_points"), F.array_join("keywords", ",").alias("keywords"), F.size("concepts").alias("concepts"), "conclusion")


@query("result_notes_unsaved", """
SELECT user_id, 'chat:' || min(event_id) || ':' || event_type AS source_key FROM (SELECT user_id, event_type, event_id // 2 * 0 + user_id AS event_id FROM events)
WHERE event_type <> 'view' GROUP BY user_id, event_type""")
def _(t):
    key = A.save_key(F.lit("chat"), F.col("user_id").cast("string"), F.col("event_type"))
    saves = t.events.select("user_id", key.alias("source_key"), "event_type")
    return A.unsaved(saves.select("user_id", "source_key"), saves.filter("event_type = 'view'")).select("user_id", "source_key")


@query("search_candidates", """
WITH u AS (SELECT conv_id AS query_id, turn, 'https://www.site' || (turn % 3) || '.example/a' AS url FROM conversations)
SELECT query_id, replace(url, 'www.', 'www.') AS url, row_number() OVER (PARTITION BY query_id ORDER BY min(turn)) AS number FROM u GROUP BY query_id, url""")
def _(t):
    url = F.concat(F.lit("https://www.site"), (F.col("turn") % 3).cast("string"), F.lit(".example/a"), F.when(F.col("turn") % 2 == 0, "?utm_source=x").otherwise("#f"))
    mark = F.struct(F.lit("url_citation").alias("type"), url.alias("url"), F.lit("T").alias("title"), F.col("turn").cast("int").alias("start_index"), (F.col("turn") + 1).cast("int").alias("end_index"))
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", mark.alias("m")))).alias("a"))
    content = F.array(F.struct(F.lit("some text").alias("text"), F.transform("a", lambda x: x["m"]).alias("annotations")))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("message").alias("type"), content.alias("content"))).alias("output")))
    found = A.search_candidates(rows.select(F.col("conv_id").alias("query_id"), body.alias("body")))
    return found.select("query_id", "url", F.col("number").cast("bigint").alias("number"))


@query("search_choices", """
SELECT o_custkey AS query_id, CAST(1 AS BIGINT) AS rank, 'u1' AS url, CAST(NULL AS INTEGER) AS year, 'other' AS kind FROM (SELECT DISTINCT o_custkey FROM orders)
UNION ALL SELECT o_custkey, 2, 'u2', 2001, 'book' FROM (SELECT DISTINCT o_custkey FROM orders)""")
def _(t):
    d = lambda n, y, k: F.struct(F.lit(n).alias("number"), F.lit(y).alias("year"), F.lit(k).alias("kind"), F.lit(" s ").alias("source"))
    body = F.to_json(F.struct(F.array(d("1", "99", "poem"), d("7", "2000", "book"), d("1", "2000", "book"), d("2", "2001", "book"), d("x", "1", "y")).alias("documents")))
    who = t.orders.select(F.col("o_custkey").alias("query_id")).distinct()
    known = who.select("query_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("number"))
    known = known.select("query_id", "number", F.concat(F.lit("u"), F.col("number").cast("string")).alias("url"), F.lit("t").alias("title"))
    out = A.choices(who.withColumn("body", body), known)
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), "url", "year", "kind")


@query("readings_agreed", """
SELECT o_custkey, min(o_orderstatus) AS said FROM orders GROUP BY 1 HAVING count(*) > 1 AND min(lower(o_orderstatus)) = max(lower(o_orderstatus))""")
def _(t):
    return A.agreed(t.orders.withColumnRenamed("o_orderstatus", "said"), "o_custkey", "said", F.lower("said")).select("o_custkey", "said")


@query("tables_padded", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || o_orderstatus || ' |  |' END AS md,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '' END || array_to_string(regexp_extract_all(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), '[0-9]+'), ',') AS numbers FROM orders""")
def _(t):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit("no table")).otherwise(F.concat(F.lit("|a|b|\n|--|:-:|\n\n|"), "o_orderstatus", F.lit("|")))
    n = A.numbers_in(F.concat(F.lit("x "), F.floor("o_totalprice").cast("string"), F.lit(" y")))
    return t.orders.select("o_orderkey", A.markdown_table(raw).alias("md"), F.array_join(n, ",").alias("numbers"))


# ---- mind maps: the lines of each order as nodes


NODES = """
WITH RECURSIVE n AS (SELECT l_orderkey AS artifact_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS ord, l_partkey FROM lineitem),
m AS (SELECT artifact_id, ord, 'n' || ord AS id, CASE WHEN ord = 1 THEN '' WHEN l_partkey % 11 = 0 THEN 'gone' ELSE 'n' || (1 + l_partkey % (ord - 1)) END AS parent FROM n),
b AS (SELECT artifact_id, id, 0 AS depth, [ord] AS route FROM m WHERE parent = '' UNION ALL
  SELECT m.artifact_id, m.id, depth + 1, list_append(route, m.ord) FROM m JOIN b ON b.artifact_id = m.artifact_id AND b.id = m.parent WHERE depth < 3)
"""


def nodes(t):
    from pyspark.sql.window import Window as W

    rows = t.lineitem.select(
        F.col("l_orderkey").alias("artifact_id"), "l_partkey",
        F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("ord"),
    )
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    # try_mod: the branch is not taken for the first line, but is evaluated as a column
    up = name(1 + F.try_mod(F.col("l_partkey"), F.col("ord") - 1))
    parent = F.when(F.col("ord") == 1, "").when(F.col("l_partkey") % 11 == 0, "gone").otherwise(up)
    return rows.select("artifact_id", "ord", name(F.col("ord")).alias("id"), parent.alias("parent"), name(F.col("ord")).alias("label"))


@query("mindmap_tree", NODES + "SELECT artifact_id, id, depth, row_number() OVER (PARTITION BY artifact_id ORDER BY depth, route) AS position FROM b")
def _(t):
    return T.bfs(nodes(t)).select("artifact_id", "id", "depth", F.col("position").cast("bigint").alias("position"))


@query("mindmap_valid", NODES + """
SELECT artifact_id, count(*) AS nodes, count(*) FILTER (WHERE depth = 1) AS themes FROM b GROUP BY 1 HAVING count(*) >= 6 AND count(*) FILTER (WHERE depth = 1) >= 2""")
def _(t):
    return T.valid(T.bfs(nodes(t)))


@query("mindmap_paths", NODES + """
SELECT artifact_id, id, array_to_string(list_transform(route, lambda r: 'n' || r), ' › ') AS line FROM b""")
def _(t):
    rows = nodes(t)
    return T.paths(T.bfs(rows), rows)


@query("mindmap_children", NODES + """
SELECT p.artifact_id, p.id, string_agg(b.id, ',' ORDER BY b.route) AS children FROM b JOIN m ON m.artifact_id = b.artifact_id AND m.id = b.id
JOIN b p ON p.artifact_id = b.artifact_id AND p.id = m.parent GROUP BY 1, 2""")
def _(t):
    return T.children_lists(T.bfs(nodes(t))).withColumn("children", F.array_join("children", ","))


# ---- measures


@query("eval_shares", """
WITH d AS (SELECT d.*, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT 'good' AS measure, count(*) FILTER (WHERE quality = 1) AS hit, count(*) AS of, round(count(*) FILTER (WHERE quality = 1) / count(*), 3) AS rate FROM d
UNION ALL SELECT 'clean_english', count(*) FILTER (WHERE lang = 'en' AND toxic = 0), count(*) FILTER (WHERE lang = 'en'),
  round(count(*) FILTER (WHERE lang = 'en' AND toxic = 0) / count(*) FILTER (WHERE lang = 'en'), 3) FROM d""")
def _(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    return V.shares(rows, good=(F.lit(True), F.col("quality") == 1), clean_english=(F.col("lang") == "en", F.col("toxic") == 0))


@query("eval_timing", """
SELECT event_type AS "group", quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1
UNION ALL SELECT 'all', quantile_disc(value, 0.5), quantile_disc(value, 0.95), count(*) FROM events""")
def _(t):
    return V.timing(t.events, "event_type", "value")


@query("eval_support", """
WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^[0-9_]+$')
  AND x NOT IN (%s))) AS c FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.c) = 0 THEN 1 ELSE len(list_intersect(a.c, b.c)) / len(a.c) END, 4) AS support
FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""" % ", ".join(f"'{w}'" for w in V.STOP))
def _(t):
    before = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("cited"))
    rows = t.conversations.join(before, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", F.round(V.support(F.col("text"), F.col("cited")), 4).alias("support"))


@query("eval_numbers", """
SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) || ',2,3' AS numbers FROM orders""")
def _(t):
    said = F.concat(F.lit("about "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" and 2 or Three"))
    return t.orders.select("o_orderkey", F.array_join(V.numbers(said), ",").alias("numbers"))


@query("eval_answers", """
SELECT conv_id, turn, turn % 3 = 0 AS should_abstain, CASE WHEN turn % 3 = 0 THEN TRUE ELSE turn % 3 = 1 END AS "right" FROM conversations""")
def _(t):
    n = F.col("turn") % 3
    rows = t.conversations.select(
        "conv_id", "turn", (n == 0).alias("should_abstain"), F.array(F.lit("Pörto"), F.lit("zz")).alias("facts"),
        F.when(n == 0, F.lit(X.NO_ANSWER["en"])).when(n == 1, F.concat("text", F.lit(" PORTO [1]"))).otherwise(F.lit("Lisbon 7 [1]")).alias("answer"),
        F.when(n == 1, F.concat("text", F.lit(" porto"))).otherwise("nothing").alias("cited_text"),
    )
    return V.judge_answers(rows).select("conv_id", "turn", "should_abstain", "right")


@query("eval_points", """
SELECT conv_id, count(*) AS points, count(*) FILTER (WHERE turn % 2 = 0) AS sourced, count(*) FILTER (WHERE turn % 2 = 0) AS supported, CAST(count(*) FILTER (WHERE turn % 2 = 1) AS BIGINT) AS unknown_numbers
FROM conversations GROUP BY 1""")
def _(t):
    said = F.regexp_replace(F.regexp_replace("text", "[0-9]", ""), r"(?i)\b(one|two|three|four|five|six|seven|eight|nine|ten)\b", "")
    rows = t.conversations.select(
        "conv_id", F.concat(said, F.when(F.col("turn") % 2 == 1, " 987654").otherwise("")).alias("text"), F.when(F.col("turn") % 2 == 0, said).alias("cited_text"), said.alias("document_text")
    )
    return V.score_points(rows, "conv_id")


@query("eval_labels_found", """
WITH d AS (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, '’‘“”–—', '''''""--'), '(?m)^#{1,6}\\s+', '', 'g'), '\\*\\*|__|\\\\|⁣|­', '', 'g'),
  '(?m)^\\d{1,2}(?:\\.\\d{1,2})*\\.?\\s+', '', 'g'), '\\s+', ' ', 'g'), ' ')) AS f FROM documents)
SELECT doc_id, CAST((length(f) - length(replace(f, 'the', ''))) // 3 AS INT) AS times FROM d""")
def _(t):
    labels = t.documents.select("doc_id", F.lit(1).alias("label_id"), F.lit("**The**").alias("text"))
    return V.labels_found(labels, t.documents, "doc_id").select("doc_id", "times")


@query("eval_order", """
WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders)
SELECT a.o_custkey AS doc, a.o_orderkey AS a, b.o_orderkey AS b, a.place < b.place AND (b.o_orderkey % 2 = 0 OR b.place = a.place + 1) AS "right" FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND b.o_orderkey = a.o_orderkey + 1""")
def _(t):
    from pyspark.sql.window import Window as W

    places = t.orders.select(
        F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("label_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("place")
    )
    pairs = t.orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"))
    return V.order_right(places, pairs.withColumn("next", F.col("b") % 2 == 1), "doc")


@query("issues_shown", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'ocr_pages' ELSE 'scanned_pages,ocr_pages' END AS codes, o_orderkey % 4 <> 0 AS partial,
  'Note on this text: ' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE (o_orderkey % 4) || ' scanned page(s) could not be read and are not in the passages; ' END
  || '2 page(s) (pages 3, 4) were read by text recognition and may contain misread words.' AS note FROM orders""")
def _(t):
    from readlake.functions import scalars as S

    issue = lambda c, n, *p: F.struct(F.lit(c).alias("code"), n.cast("int").alias("count"), F.array(*p).cast("array<int>").alias("pages"))
    raw = F.array(issue("scanned_pages", F.col("o_orderkey") % 4), issue("tables_as_images", F.lit(0)), issue("ocr_pages", F.lit(2), F.lit(3), F.lit(4)))
    both = F.reverse(raw)
    return t.orders.select(
        "o_orderkey", F.array_join(F.transform(S.shown_issues(both), lambda i: i["code"]), ",").alias("codes"), S.is_partial(both).alias("partial"), S.coverage_note(raw).alias("note")
    )
