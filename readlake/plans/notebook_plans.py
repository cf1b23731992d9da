"""Notebooks, highlights as intervals, and the exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.functions import scalars as S
from readlake.operators import highlights as H
from readlake.operators import notebooks as N
from readlake.plans.bindings import bound, with_bindings
from readlake.plans.registry import query
from readlake.sources import export as E

GROUPS = with_bindings("library", "highlights", "notes") + """
, h AS (SELECT document_id, count(*) AS n, count(*) FILTER (WHERE note <> '') AS noted, max(updated_at) AS last FROM highlights GROUP BY 1)
, f AS (SELECT document_id, count(*) FILTER (WHERE origin = 'user') AS own, count(*) FILTER (WHERE origin = 'ai_saved') AS ai,
  max(updated_at) AS last FROM notes GROUP BY 1)
"""


@query("notebook_groups", GROUPS + """
SELECT l.document_id, coalesce(h.n, 0) AS highlight_count, coalesce(h.noted, 0) + coalesce(f.own, 0) AS note_count,
  coalesce(f.ai, 0) AS insight_count, strftime(greatest(h.last, f.last), '%Y-%m-%d %H:%M:%S') AS last_activity_at
FROM library l LEFT JOIN h ON h.document_id = l.document_id LEFT JOIN f ON f.document_id = l.document_id
WHERE h.n IS NOT NULL OR f.own IS NOT NULL""")
def _(t):
    out = N.groups(bound(t, "library").select("document_id"), bound(t, "highlights"), bound(t, "notes"))
    return out.withColumn("last_activity_at", F.date_format("last_activity_at", "yyyy-MM-dd HH:mm:ss"))


@query("notebook_list", with_bindings("notebooks", "notebook_links", "notebook_documents") + """
, s AS (SELECT notebook_id, count(*) AS n FROM notebook_links GROUP BY 1)
, d AS (SELECT notebook_id, count(*) AS n FROM (SELECT notebook_id, document_id FROM notebook_documents
  UNION SELECT notebook_id, document_id FROM notebook_links) GROUP BY 1)
SELECT b.notebook_id, coalesce(s.n, 0) AS source_count, coalesce(d.n, 0) AS document_count FROM notebooks b
LEFT JOIN s ON s.notebook_id = b.notebook_id LEFT JOIN d ON d.notebook_id = b.notebook_id""")
def _(t):
    out = N.notebook_list(bound(t, "notebooks"), bound(t, "notebook_links"), bound(t, "notebook_documents"))
    return out.select("notebook_id", "source_count", "document_count")


NUMBERED = """
, s AS (SELECT k.notebook_id, k.highlight_id, k.document_id, title, selected_text, row_number() OVER (PARTITION BY k.notebook_id
  ORDER BY lower(title), CAST(k.document_id AS VARCHAR), start_at IS NULL, coalesce(start_at, 0), coalesce(page_number, 0),
  h.created_at, k.highlight_id) AS number
FROM notebook_links k JOIN highlights h ON h.highlight_id = k.highlight_id JOIN library l ON l.document_id = k.document_id)
"""


def _sources(t, made, more=()):
    links, marks = bound(t, "notebook_links"), bound(t, "highlights").withColumn("paragraph", F.length("selected_text"))
    return N.by_notebook(N.sources_of(links, marks, bound(t, "library"), more), links, made)


@query("notebook_sources_numbered", with_bindings("notebook_links", "highlights", "library") + NUMBERED + """
SELECT notebook_id, highlight_id, title, number FROM s""")
def _(t):
    return _sources(t, lambda s, _: s.select("notebook_id", "highlight_id", "title", "number"))


@query("notebook_source_groups", with_bindings("notebook_links", "highlights", "library") + NUMBERED + """
SELECT notebook_id, document_id, min(number) AS first_number, count(*) AS sources FROM s GROUP BY 1, 2""")
def _(t):
    return _sources(t, lambda s, _: N.source_groups(s))


@query("notebook_group_sources", with_bindings("notebook_links", "highlights", "library") + NUMBERED + """
, g AS (SELECT *, (row_number() OVER (PARTITION BY notebook_id, document_id ORDER BY number) - 1) // 3 AS slice, min(number) OVER (PARTITION BY notebook_id, document_id) AS first_number FROM s)
SELECT notebook_id, document_id, first_number, CAST(slice AS INT) AS slice, string_agg(number || ':' || highlight_id, ',' ORDER BY number) AS sources FROM g GROUP BY 1, 2, 3, 4""")
def _(t):
    out = _sources(t, lambda s, whole: N.group_sources(s, most=3, whole=whole))
    shown = F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["number"].cast("string"), x["highlight_id"])), ",")
    return out.select("notebook_id", "document_id", "first_number", "slice", shown.alias("sources"))


@query("notebook_new_numbers", with_bindings("notebook_links", "notebook_documents") + """
, old AS (SELECT notebook_id, document_id, min(position) AS position FROM notebook_links GROUP BY 1, 2)
, c AS (SELECT p_partkey AS notebook_id, p_size AS position FROM part)
, m AS (SELECT notebook_id, max(position) AS top FROM (SELECT notebook_id, position FROM old UNION ALL SELECT * FROM c) GROUP BY 1)
, w AS (SELECT d.notebook_id, d.document_id, position, coalesce(top, 0) AS top FROM notebook_documents d
  LEFT JOIN old o ON o.notebook_id = d.notebook_id AND o.document_id = d.document_id LEFT JOIN m ON m.notebook_id = d.notebook_id)
SELECT notebook_id, document_id, CAST(coalesce(position, top + row_number() OVER (PARTITION BY notebook_id, position IS NULL
  ORDER BY document_id)) AS INT) AS position FROM w""")
def _(t):
    old = bound(t, "notebook_links").groupBy("notebook_id", "document_id").agg(F.min("position").alias("position"))
    cited = t.part.select(F.col("p_partkey").alias("notebook_id"), F.col("p_size").alias("position"))
    wanted = bound(t, "notebook_documents").withColumn("asked", F.col("document_id"))
    as_h = lambda df: df.withColumnRenamed("document_id", "highlight_id")
    out = N.new_numbers(as_h(old), cited, as_h(wanted))
    return out.select("notebook_id", F.col("highlight_id").alias("document_id"), "position")


@query("notebook_versions_kept", with_bindings("usage") + """
SELECT user_id, id FROM usage QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) <= 50""")
def _(t):
    return N.keep_newest(bound(t, "usage"), "user_id", "created_at", "id", N.MAX_VERSIONS).select("user_id", "id")


@query("notebook_versions_changed", """
SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER w AS a, row_number() OVER w AS n FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR a IS DISTINCT FROM event_type""")
def _(t):
    return N.changed_versions(t.events, "user_id", F.to_date("ts"), ["ts", "event_id"], ["event_type"]).select("user_id", "event_id")


@query("conversation_recent_turns", """
SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) <= 8""")
def _(t):
    return N.recent_turns(t.conversations).select("conv_id", "turn", "role")


@query("conversations_kept", """
WITH c AS (SELECT conv_id, conv_id % 3 AS doc, max(turn) AS last FROM conversations GROUP BY 1)
SELECT conv_id, doc FROM c QUALIFY row_number() OVER (PARTITION BY doc ORDER BY last DESC, conv_id) <= 50""")
def _(t):
    rows = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last")).withColumn("doc", F.col("conv_id") % 3)
    return N.keep_newest(rows, "doc", "last", "conv_id", N.MAX_CONVERSATIONS).select("conv_id", "doc")


PLACES = """
WITH d AS (SELECT doc_id, CAST(length(text) % 9 AS INT) AS pages, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS t,
  text FROM documents),
h AS (SELECT doc_id, doc_id % 4 AS kind, CASE doc_id % 4 WHEN 0 THEN substr(text, length(text) // 2, 90)
    WHEN 1 THEN substr(text, length(text) // 3, 30) || ' zzqq not there at all in this text, surely not' ELSE 'zzqq' END AS s,
  CASE WHEN doc_id % 4 = 2 THEN 2 END AS page FROM documents),
w AS (SELECT *, lower(trim(regexp_replace(s, '\\s+', ' ', 'g'), ' ')) AS q FROM h)
SELECT w.doc_id, CAST(coalesce(CASE WHEN length(q) > 0 THEN nullif(strpos(t, substr(q, 1, 60)), 0) - 1 END,
  CASE WHEN length(q) > 0 THEN nullif(strpos(t, substr(q, 1, 24)), 0) - 1 END,
  CASE WHEN page > 0 THEN CAST(floor((page - 1) / nullif(pages, 0) * length(t)) AS BIGINT) END, length(t)) AS INT) AS place
FROM w JOIN d ON d.doc_id = w.doc_id"""


@query("highlights_reading_order", PLACES)
def _(t):
    n = F.col("doc_id") % 4
    half = F.substr("text", F.floor(F.length("text") / 2).cast("int"), F.lit(90))
    third = F.concat(
        F.substr("text", F.floor(F.length("text") / 3).cast("int"), F.lit(30)), F.lit(" zzqq not there at all in this text, surely not")
    )
    docs = t.documents.select(F.col("doc_id").alias("document_id"), "text", (F.length("text") % 9).cast("int").alias("page_count"))
    marks = t.documents.select(
        F.col("doc_id").alias("document_id"),
        F.when(n == 0, half).when(n == 1, third).otherwise("zzqq").alias("selected_text"),
        F.when(n == 2, 2).alias("page_number"),
    )
    return N.reading_order(marks, docs).select(F.col("document_id").alias("doc_id"), "place")


@query("highlights_newest_first", with_bindings("highlights") + """
SELECT highlight_id FROM highlights ORDER BY created_at DESC, highlight_id LIMIT 50 OFFSET 50""")
def _(t):
    return bound(t, "highlights").orderBy(F.col("created_at").desc(), "highlight_id").offset(50).limit(50).select("highlight_id")


@query("highlights_numbered_in_document", with_bindings("highlights") + """
SELECT highlight_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number NULLS LAST, created_at, highlight_id) AS number FROM highlights""")
def _(t):
    return H.numbered_in_document(bound(t, "highlights")).select("highlight_id", "number")


WIDE = """
, w AS (SELECT highlight_id, user_id % 5 AS user_id, document_id % 50 AS document_id, version, start_at * 4 AS start_at,
  end_at + start_at * 3 AS end_at FROM highlights)
"""


def _wide(t):
    return bound(t, "highlights").select(
        "highlight_id",
        (F.col("user_id") % 5).alias("user_id"),
        (F.col("document_id") % 50).alias("document_id"),
        "version",
        (F.col("start_at") * 4).alias("start_at"),
        (F.col("end_at") + F.col("start_at") * 3).alias("end_at"),
    )


@query("highlights_overlaps", with_bindings("highlights") + WIDE + """
SELECT a.highlight_id, count(b.highlight_id) FILTER (WHERE NOT (a.start_at = b.start_at AND a.end_at = b.end_at)) AS overlapping,
  count(b.highlight_id) FILTER (WHERE a.start_at = b.start_at AND a.end_at = b.end_at) - 1 AS same_passage
FROM w a JOIN w b ON a.user_id = b.user_id AND a.document_id = b.document_id AND a.version = b.version
  AND a.start_at < b.end_at AND b.start_at < a.end_at
GROUP BY a.highlight_id, a.user_id, a.document_id, a.version, a.start_at, a.end_at""")
def _(t):
    return H.overlaps(_wide(t)).select("highlight_id", "overlapping", "same_passage")


@query("highlights_neighbours", with_bindings("highlights") + """
SELECT a.highlight_id AS new_id, b.highlight_id, CASE WHEN a.start_at = b.start_at AND a.end_at = b.end_at THEN 'same' ELSE 'overlapping' END
  AS relation FROM highlights a JOIN highlights b ON a.user_id = b.user_id AND a.document_id = b.document_id AND a.version = b.version
  AND a.start_at < b.end_at AND b.start_at < a.end_at WHERE a.color = 'pink' AND b.color <> 'pink'""")
def _(t):
    rows = bound(t, "highlights")
    return H.neighbours(rows.filter("color <> 'pink'"), rows.filter("color = 'pink'")).select("new_id", "highlight_id", "relation")


COARSE = """
, c AS (SELECT highlight_id, user_id, document_id % 100 AS document_id, version, start_at // 500 AS start_at, 9 AS end_at, color,
  page_number, notebook_id % 10 AS notebook_id, anchor_status, created_at, sync_status FROM highlights)
"""


def _coarse(t):
    return (
        bound(t, "highlights")
        .withColumn("document_id", F.col("document_id") % 100)
        .withColumn("start_at", F.floor(F.col("start_at") / 500))
        .withColumn("end_at", F.lit(9))
        .withColumn("notebook_id", F.col("notebook_id") % 10)
    )


@query("highlights_earliest_wins", with_bindings("highlights") + COARSE + """
SELECT highlight_id, CASE WHEN row_number() OVER (PARTITION BY user_id, document_id, version, start_at, end_at
  ORDER BY created_at, highlight_id) > 1 THEN 'ambiguous' ELSE anchor_status END AS anchor_status FROM c""")
def _(t):
    return H.earliest_wins(_coarse(t)).select("highlight_id", "anchor_status")


@query("highlights_same_passage", with_bindings("highlights") + COARSE + """
SELECT highlight_id, first_value(highlight_id) OVER (PARTITION BY user_id, document_id, version, start_at, end_at
  ORDER BY created_at, highlight_id) AS kept FROM c""")
def _(t):
    return H.same_passage(_coarse(t)).select("highlight_id", "kept")


@query("highlights_status_counts", with_bindings("highlights") + """
SELECT document_id, count(*) FILTER (WHERE anchor_status = 'mapped') AS mapped,
  count(*) FILTER (WHERE anchor_status = 'ambiguous') AS ambiguous,
  count(*) FILTER (WHERE anchor_status = 'unresolved') AS unresolved FROM highlights GROUP BY 1""")
def _(t):
    return H.status_counts(bound(t, "highlights"), "document_id")


PLAN = COARSE + """
, g AS (SELECT user_id, document_id, version, start_at, count(*) AS n, count(*) FILTER (WHERE page_number IS NULL) AS clean,
  min(color) = max(color) AS one_color, min(notebook_id) = max(notebook_id) AS shared,
  arg_min(highlight_id, (created_at, highlight_id)) AS kept, arg_max(highlight_id, (created_at, highlight_id)) AS other
  FROM c GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)
, plan AS (SELECT *, CASE WHEN n > 2 THEN 'more_than_two' WHEN clean <> 1 THEN 'same_view' WHEN NOT one_color THEN 'colors_differ'
  WHEN shared THEN 'shared_notebook' END AS held FROM g)
"""


@query("highlights_merge_plan", with_bindings("highlights") + PLAN + """
SELECT user_id, document_id, version, start_at, n, kept, CASE WHEN held IS NULL THEN other END AS merged, held FROM plan""")
def _(t):
    return N.merge_plan(_coarse(t)).drop("end_at")


@query("highlights_after_merge", with_bindings("highlights") + PLAN + """
, pairs AS (SELECT kept, other FROM plan WHERE held IS NULL), w AS (SELECT highlight_id, note FROM highlights)
SELECT c.highlight_id, CASE WHEN m.other IS NULL THEN c.note
  WHEN trim(coalesce(o.note, '')) = '' OR contains(trim(coalesce(c.note, '')), trim(coalesce(o.note, ''))) THEN trim(coalesce(c.note, ''))
  WHEN trim(coalesce(c.note, '')) = '' THEN trim(coalesce(o.note, '')) ELSE trim(coalesce(c.note, '')) || chr(10) || chr(10) || trim(coalesce(o.note, '')) END AS note
FROM w c LEFT JOIN pairs m ON m.kept = c.highlight_id LEFT JOIN w o ON o.highlight_id = m.other
WHERE c.highlight_id NOT IN (SELECT other FROM pairs)""")
def _(t):
    rows = _coarse(t)
    links = rows.select("highlight_id", "notebook_id")
    return N.merged_highlights(rows, links, N.merge_plan(rows, links))[0].select("highlight_id", "note")


@query("highlights_sync_report", with_bindings("highlights") + PLAN + """
SELECT (SELECT count(DISTINCT document_id) FROM c) AS documents, (SELECT count(*) FROM c) AS highlights,
  (SELECT count(*) FROM c WHERE sync_status = 'synced') AS synced, (SELECT count(*) FROM c WHERE sync_status = 'unsynced') AS unsynced,
  (SELECT count(*) FROM c WHERE sync_status = 'ambiguous') AS ambiguous,
  (SELECT count(*) FROM plan WHERE held IS NULL) AS merges, (SELECT count(*) FROM plan WHERE held IS NOT NULL) AS held""")
def _(t):
    rows = _coarse(t)
    return H.sync_report(rows, N.merge_plan(rows))


@query("highlights_common_notebooks", with_bindings("highlights", "notebook_documents") + PLAN + """
, k AS (SELECT highlight_id, CAST(length(highlight_id) + start_at AS BIGINT) % 4 AS notebook_id FROM c)
SELECT kept, other AS merged, a.notebook_id FROM plan JOIN k a ON a.highlight_id = kept JOIN k b ON b.highlight_id = other
WHERE a.notebook_id = b.notebook_id""")
def _(t):
    rows = _coarse(t)
    at = ["user_id", "document_id", "version", "start_at"]
    key = F.struct("created_at", "highlight_id")
    pairs = rows.groupBy(*at).agg(
        F.count(F.lit(1)).alias("n"), F.min(key)["highlight_id"].alias("kept"), F.max(key)["highlight_id"].alias("merged")
    )
    links = rows.select("highlight_id", ((F.length("highlight_id") + F.col("start_at")) % 4).alias("notebook_id"))
    return H.common_notebooks(pairs.filter("n > 1").select("kept", "merged"), links)


@query("highlights_block", with_bindings("highlights") + """
SELECT highlight_id, CASE WHEN page_number = 1 THEN 'a' || start_at ELSE color END AS block FROM highlights""")
def _(t):
    span = F.struct(F.concat(F.lit("a"), F.col("start_at").cast("string")).alias("block"), F.lit(0).alias("start"))
    anchor = F.when(F.col("page_number") == 1, F.array(span))
    return bound(t, "highlights").select("highlight_id", H.block_of(anchor, F.col("color")).alias("block"))


@query("notebook_scope", with_bindings("notebook_links", "library") + """
SELECT notebook_id, min(k.document_id) = max(k.document_id) AS one_document, bool_and(collection_id <> 7) AS in_shelf
FROM notebook_links k JOIN library l ON l.document_id = k.document_id GROUP BY 1""")
def _(t):
    rows = bound(t, "notebook_links").join(
        bound(t, "library").select("document_id", (F.col("collection_id") != 7).alias("inside")), "document_id"
    )
    one = N.scope_problems(rows).withColumnRenamed("in_scope", "one_document")
    return one.join(N.scope_problems(rows, "inside").withColumnRenamed("in_scope", "in_shelf"), "notebook_id")


@query("notebook_paragraph_partners", with_bindings("notebook_links", "highlights", "library") + NUMBERED + """
, p AS (SELECT *, length(selected_text) AS paragraph, count(*) OVER w AS n, min(number) OVER w AS first_number,
  max(number) OVER w AS last_number FROM s WINDOW w AS (PARTITION BY notebook_id, document_id, length(selected_text)))
SELECT notebook_id, highlight_id, first_number, last_number, n - 1 AS others FROM p WHERE n > 1""")
def _(t):
    out = _sources(t, lambda s, whole: N.paragraph_partners(s, whole), ("paragraph",))
    return out.select("notebook_id", "highlight_id", "first_number", "last_number", "others")


@query("notebook_partners", with_bindings("notebook_links", "highlights", "library") + NUMBERED + """
, p AS (SELECT *, length(selected_text) AS paragraph, count(*) OVER w AS n, (row_number() OVER (w ORDER BY number) - 1) // 4 AS slice FROM s WINDOW w AS (PARTITION BY notebook_id, document_id, length(selected_text)))
SELECT a.notebook_id, a.highlight_id, a.number, coalesce(string_agg(b.number || ':Here k' || b.number || ' stands.', ',' ORDER BY b.number), '') AS partners FROM p a LEFT JOIN p b
  ON b.notebook_id = a.notebook_id AND b.document_id = a.document_id AND b.paragraph = a.paragraph AND b.slice = a.slice AND b.number <> a.number WHERE a.n > 1 GROUP BY 1, 2, 3""")
def _(t):
    word = F.concat(F.lit("k"), F.col("number").cast("string"))
    text = F.concat(F.lit("One thing is said. Here "), word, F.lit(" stands. More follows."))
    told = lambda s: s.withColumn("selected_text", word).withColumn("paragraph_text", text)
    out = _sources(t, lambda s, whole: N.partners(told(s), most=4, whole=whole), ("paragraph",))
    shown = F.array_join(F.transform("partners", lambda x: F.concat_ws(":", x["number"].cast("string"), x["sentence"])), ",")
    return out.select("notebook_id", "highlight_id", "number", shown.alias("partners"))


# ---- exports


@query("export_highlights_markdown", with_bindings("library", "highlights") + """
, k AS (SELECT CASE WHEN lower(coalesce(original_filename, '')) LIKE '%.epub' THEN 'EPUB' WHEN source_type = 'manual' THEN 'WEB'
  ELSE 'PDF' END AS kind, * FROM library)
, m AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(page_number, 0), created_at, highlight_id) AS n FROM highlights)
SELECT document_id, 0 AS section, CAST(NULL AS VARCHAR) AS id, '## ' || title || chr(10) || chr(10) || kind
  || CASE WHEN url IS NOT NULL THEN ' · <' || url || '>' ELSE '' END AS text FROM k WHERE document_id IN (SELECT document_id FROM m)
UNION ALL SELECT document_id, 1, highlight_id, CASE WHEN n > 1 THEN '---' || chr(10) || chr(10) ELSE '' END || '> ' || selected_text
  || chr(10) || chr(10) || '*' || concat_ws(' · ', 'Page ' || page_number, color, category) || '*'
  || CASE WHEN note <> '' THEN chr(10) || chr(10) || '**Note:** ' || note ELSE '' END FROM m
  WHERE document_id IN (SELECT document_id FROM library)""")
def _(t):
    docs = bound(t, "library").withColumn("file_type", S.file_type(F.col("source_type"), F.col("original_filename")))
    return E.highlights_md(bound(t, "highlights"), docs).select("document_id", "section", "id", "text")


@query("export_notebook_markdown", with_bindings("library", "highlights", "notes") + """
SELECT document_id, 0 AS section, '' AS id, '# ' || title AS text FROM library WHERE document_id IN
  (SELECT document_id FROM highlights UNION SELECT document_id FROM notes)
UNION ALL SELECT document_id, 1, highlight_id, '> ' || selected_text || chr(10) || chr(10) || '*'
  || concat_ws(' · ', 'Page ' || page_number, color, category) || '*'
  || CASE WHEN note <> '' THEN chr(10) || chr(10) || '**Note:** ' || note ELSE '' END FROM highlights
UNION ALL SELECT document_id, CASE WHEN origin = 'user' THEN 2 ELSE 3 END, CAST(note_id AS VARCHAR),
  CASE WHEN origin = 'user' THEN '' ELSE '*Written by AI*' || chr(10) || chr(10) END || body FROM notes""")
def _(t):
    return E.notebook_md(bound(t, "library"), bound(t, "highlights"), bound(t, "notes"))


@query("export_citation_lines", """
SELECT conv_id, turn, '  ' || chr(10) || '[' || turn || '] “' || CASE WHEN length(l) > 200 THEN substr(l, 1, 200) || '…' ELSE l END || '”' AS line
FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS l FROM conversations)""")
def _(t):
    return t.conversations.select("conv_id", "turn", E.citation_line(F.col("turn"), F.col("text")).alias("line"))


@query("export_bibtex_keys", """
WITH b AS (SELECT p_partkey, lower(replace(p_brand, '#', '')) || CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(1990 + p_size AS VARCHAR) END
  || CASE WHEN length(split_part(p_name, ' ', 1)) > 3 OR length(split_part(p_name, ' ', 2)) <= 3 THEN split_part(p_name, ' ', 1)
     ELSE split_part(p_name, ' ', 2) END AS base FROM part)
SELECT p_partkey, CASE WHEN row_number() OVER w = 1 THEN base ELSE base || '-' || row_number() OVER w END AS key FROM b
WINDOW w AS (PARTITION BY base ORDER BY p_partkey)""")
def _(t):
    year = F.when(F.col("p_size") % 3 != 0, 1990 + F.col("p_size"))
    rows = t.part.withColumn("base", E.cite_key(F.col("p_brand"), year, F.col("p_name")))
    return E.unique_keys(rows, "p_partkey").select("p_partkey", "key")


@query("export_bibtex", """
WITH b AS (SELECT p_partkey, lower(replace(p_brand, '#', '')) || p_size || CASE WHEN length(split_part(p_name, ' ', 1)) > 3
    OR length(split_part(p_name, ' ', 2)) <= 3 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END AS base, * FROM part)
, k AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN base ELSE base || '-' || row_number() OVER w END AS key FROM b
  WINDOW w AS (PARTITION BY base ORDER BY p_partkey))
SELECT p_partkey, '@' || CASE WHEN p_type = 'PROMO' THEN 'phdthesis' ELSE 'article' END || '{' || key || ',' || chr(10)
  || '  author = {' || replace(p_brand, '#', '\\#') || ', A.},' || chr(10) || '  title = {{' || p_name || '}},' || chr(10)
  || CASE WHEN p_type = 'PROMO' THEN '  school = {P \\& Q},' ELSE '  publisher = {P \\& Q},' END || chr(10)
  || '  year = {' || p_size || '},' || chr(10) || '  pages = {1--' || p_size || '},' || chr(10)
  || '  url = {https://a.example/x}' || chr(10) || '}' AS entry FROM k""")
def _(t):
    none = F.lit(None).cast("string")
    rows = t.part.select(
        "p_partkey",
        F.col("p_name").alias("title"),
        F.lit("https://a.example/{x}").alias("url"),
        F.when(F.col("p_type") == "PROMO", "thesis").otherwise("article").alias("kind"),
        F.col("p_brand").alias("family"),
        F.lit("A.").alias("given"),
        F.col("p_size").alias("year"),
        none.alias("container"),
        F.lit("P & Q").alias("publisher"),
        none.alias("volume"),
        none.alias("issue"),
        F.concat(F.lit("1 – "), F.col("p_size").cast("string")).alias("pages"),
        F.lit("2024-01-01").cast("date").alias("created_at"),
    )
    return E.bibtex(rows, "p_partkey").select("p_partkey", "entry")


@query("authors_shown", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN p_brand WHEN 2 THEN p_brand || ' & ' || p_name ELSE p_brand || ' et al.' END AS short,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand || ', A; ' || p_name END AS listed FROM part""")
def _(t):
    n = F.col("p_size") % 4
    full = F.array(F.col("p_brand"), F.lit("  "), F.col("p_name"), F.lit("Last"))
    names = F.when(n == 0, F.slice(full, 2, 1)).when(n == 1, F.slice(full, 1, 2)).when(n == 2, F.slice(full, 1, 3)).otherwise(full)
    people = S.authors_from_text(F.when(n == 0, "").otherwise(F.concat("p_brand", F.lit(" ,  A ;"), "p_name", F.lit("; "))))
    return t.part.select("p_partkey", S.authors_short(names).alias("short"), S.authors_to_text(people).alias("listed"))
