"""The library, its shelves, the administrator's views and the batch merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.functions import scalars as S
from readlake.functions import urls as U
from readlake.operators import admin as A
from readlake.operators import library as L
from readlake.operators import merge as M
from readlake.plans.bindings import bound, with_bindings
from readlake.plans.registry import query

TODAY = "2001-08-01"
DERIVED = """
, p AS (SELECT *, CASE WHEN lower(coalesce(original_filename, '')) LIKE '%.epub' THEN 'epub'
    WHEN source_type = 'manual' AND lower(coalesce(original_filename, '')) NOT LIKE '%.pdf' THEN 'web' ELSE 'pdf' END AS file_type,
  CASE WHEN is_read THEN 100 WHEN last_read_page > 1 AND page_count > 0
    THEN least(99, CAST(floor(last_read_page / page_count * 100 + 0.5) AS INT))
    ELSE least(99, CAST(floor(coalesce(read_fraction, 0) * 100 + 0.5) AS INT)) END AS progress FROM library)
, x AS (SELECT *, CASE WHEN progress >= 100 THEN 'read' WHEN progress > 0 THEN 'reading' ELSE 'unread' END AS state,
  CASE WHEN source_type = 'manual' THEN coalesce(regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^www\\.', ''), 'Link')
    ELSE coalesce(original_filename, 'Uploaded file') END AS origin,
  CAST(ceil(nullif(word_count, 0) / 230.0) AS INT) AS reading_minutes,
  upper(coalesce(license, '')) LIKE '%ND%' AS no_derivatives,
  extraction_status = 'done' OR (file_type = 'pdf' AND extraction_status NOT IN ('pending', 'processing')) AS readable FROM p)
"""


def lib(t):
    return L.derived(bound(t, "library"))


def d(name):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


@query("library_list", with_bindings("library") + """
SELECT document_id, user_id, title, source_type, file_size, strftime(created_at, '%Y-%m-%d') AS created_at FROM library""")
def _(t):
    out = L.list_documents(bound(t, "library"), sort="newest")
    return out.select("document_id", "user_id", "title", "source_type", "file_size", d("created_at"))


@query("library_list_uploads_by_title", with_bindings("library") + """
SELECT document_id, title FROM library WHERE source_type = 'upload'""")
def _(t):
    return L.list_documents(bound(t, "library"), "upload", "title").select("document_id", "title")


@query("library_heavy_column", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(t):
    return L.heavy(t.documents, "doc_id", "text").select("doc_id", F.md5("text").alias("digest"))


@query("library_owned", "SELECT doc_id, n_chars FROM documents WHERE source = 'src1'")
def _(t):
    return L.owned(t.documents, "src1", "source").select("doc_id", "n_chars")


@query("library_derived_columns", with_bindings("library") + DERIVED + """
SELECT document_id, file_type, progress, state, origin, reading_minutes, no_derivatives, readable FROM x""")
def _(t):
    return lib(t).select(
        "document_id", "file_type", "progress", "state", "origin", "reading_minutes", "no_derivatives", "readable"
    )


@query("library_filter", with_bindings("library") + DERIVED + """
SELECT document_id FROM x WHERE source_type = 'manual' AND state = 'reading' AND file_type = 'web'
  AND lower(title || ' ' || origin) LIKE '%conversation%'""")
def _(t):
    found = L.filter_documents(lib(t), source="manual", state="reading", file_type="web", query=" Conversation ")
    return found.select("document_id")


@query("library_topic_filter", with_bindings("library") + """
SELECT document_id FROM library WHERE document_id % 3 = 1 OR document_id % 5 = 1""")
def _(t):
    tags = F.array((F.col("document_id") % 3).cast("string"), (F.col("document_id") % 5).cast("string"))
    rows = bound(t, "library").withColumn("topics", tags)
    return L.filter_documents(rows, topic="1").select("document_id")


@query("highlights_equal_filters", with_bindings("highlights") + """
SELECT highlight_id FROM highlights WHERE color = 'green' AND category = 'question'""")
def _(t):
    return L.equal_filters(bound(t, "highlights"), color="green", category="question", document_id=None).select("highlight_id")


@query("highlights_on_shelf", with_bindings("highlights", "library") + """
SELECT highlight_id FROM highlights WHERE document_id IN (SELECT document_id FROM library WHERE collection_id = 3)""")
def _(t):
    return L.on_shelf(bound(t, "highlights"), bound(t, "library"), 3).select("highlight_id")


@query("library_topics_and_license", with_bindings("library") + """
, a AS (SELECT url, license AS al, user_id % 7 AS topics FROM library WHERE url LIKE '%site%')
SELECT l.document_id, a.topics, coalesce(al, CASE WHEN l.url LIKE 'https://theconversation.com/%' THEN 'CC BY-ND 4.0' END) AS license
FROM library l LEFT JOIN a ON a.url = l.url""")
def _(t):
    rows = bound(t, "library")
    catalogue = rows.filter(F.contains("url", F.lit("site"))).select("url", (F.col("user_id") % 7).alias("topics"), "license")
    return L.with_topics(rows.drop("license"), catalogue).select("document_id", "topics", "license")


@query("shelf_document_counts", with_bindings("collections", "library") + """
SELECT c.collection_id, c.name, count(l.document_id) AS documents FROM collections c
LEFT JOIN library l ON l.collection_id = c.collection_id GROUP BY 1, 2""")
def _(t):
    return L.count_children(bound(t, "collections"), bound(t, "library"), "collection_id", "documents")


@query("conversation_message_counts", """
SELECT c.c_custkey AS conv_id, count(m.turn) AS messages FROM customer c LEFT JOIN conversations m ON m.conv_id = c.c_custkey GROUP BY 1""")
def _(t):
    return L.count_children(t.customer.select(F.col("c_custkey").alias("conv_id")), t.conversations, "conv_id", "messages")


@query("library_continue_reading", with_bindings("library") + DERIVED + """
SELECT document_id FROM x WHERE readable AND progress > 0 AND progress < 100 ORDER BY updated_at DESC, document_id LIMIT 3""")
def _(t):
    return L.continue_reading(lib(t)).select("document_id")


@query("library_continue_reading_each", with_bindings("library") + DERIVED + """
, s AS (SELECT user_id, document_id FROM x WHERE readable AND progress > 0 AND progress < 100
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, document_id) <= 3)
SELECT * FROM s UNION ALL SELECT * FROM (SELECT user_id, document_id FROM x WHERE readable AND NOT is_read
  AND user_id NOT IN (SELECT user_id FROM s)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, document_id) = 1)""")
def _(t):
    return L.continue_reading_each(lib(t)).select("user_id", "document_id")


@query("library_read_counts", with_bindings("library") + DERIVED + """
SELECT state, count(*) AS n FROM x GROUP BY state UNION ALL SELECT 'all', count(*) FROM x""")
def _(t):
    return L.read_counts(lib(t))


@query("library_document_usage", with_bindings("library", "highlights", "notes", "notebook_links", "notebook_documents") + """
, h AS (SELECT document_id, count(*) AS n, count(*) FILTER (WHERE note <> '') AS noted FROM highlights GROUP BY 1)
, f AS (SELECT document_id, count(*) AS n FROM notes GROUP BY 1)
, b AS (SELECT document_id, count(*) AS n FROM (SELECT document_id, notebook_id FROM notebook_links UNION
  SELECT document_id, notebook_id FROM notebook_documents) GROUP BY 1)
SELECT l.document_id, coalesce(h.n, 0) AS highlights, coalesce(h.noted, 0) + coalesce(f.n, 0) AS notes,
  l.document_id IN (SELECT doc_id FROM documents) AS has_result, coalesce(b.n, 0) AS notebooks
FROM library l LEFT JOIN h ON h.document_id = l.document_id LEFT JOIN f ON f.document_id = l.document_id
LEFT JOIN b ON b.document_id = l.document_id""")
def _(t):
    return L.usage(
        bound(t, "library"),
        bound(t, "highlights"),
        bound(t, "notes"),
        t.documents.select(F.col("doc_id").alias("document_id")),
        bound(t, "notebook_links"),
        bound(t, "notebook_documents"),
    )


@query("results_stale_reason", with_bindings("highlights", "library") + """
SELECT highlight_id, CASE WHEN version <> 'v1' THEN 'content' WHEN page_number IS DISTINCT FROM 2 THEN 'prompt'
  WHEN category IS DISTINCT FROM 'concept' THEN 'model' END AS reason FROM highlights""")
def _(t):
    reason = L.stale_reason(F.col("version"), F.lit("v1"), F.col("page_number"), 2, F.col("category"), "concept")
    return bound(t, "highlights").select("highlight_id", reason.alias("reason"))


@query("jobs_claimable", """
SELECT event_id FROM events WHERE event_type = 'signup' OR event_type <> 'error' OR ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 15 MINUTE""")
def _(t):
    state = F.when(F.col("event_type") == "error", "running").when(F.col("event_type") != "signup", "done")
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return t.events.filter(L.claimable(state, F.col("ts"), now)).select("event_id")


@query("notebooks_expired_drafts", with_bindings("notebooks") + """
SELECT notebook_id FROM notebooks WHERE status = 'draft' AND ai_model IS NOT NULL AND opened_on < DATE '2001-08-01' - 30
  AND updated_on < DATE '2001-08-01' - 30 AND notebook_id NOT IN (SELECT CAST(s_suppkey * 3 AS BIGINT) FROM supplier)""")
def _(t):
    posts = t.supplier.select((F.col("s_suppkey") * 3).alias("notebook_id"))
    return L.expired_drafts(bound(t, "notebooks"), posts, F.lit(TODAY).cast("date")).select("notebook_id")


@query("activity_expired", with_bindings("traffic") + """
SELECT DISTINCT strftime(day, '%Y-%m-%d') AS day, user_id FROM traffic WHERE day < DATE '2024-04-20' - 90""")
def _(t):
    old = L.expired_activity(bound(t, "traffic").select("day", "user_id").distinct(), F.lit("2024-04-20").cast("date"))
    return old.select(d("day"), "user_id")


@query("library_in_callers_order", with_bindings("collections") + """
, w AS (SELECT 24 - CAST(n_nationkey AS INT) AS collection_id, CAST(n_nationkey AS BIGINT) AS pos FROM nation WHERE n_regionkey < 3)
SELECT c.collection_id, c.name, w.pos FROM collections c LEFT JOIN w ON w.collection_id = c.collection_id""")
def _(t):
    wanted = t.nation.filter("n_regionkey < 3").select(
        (24 - F.col("n_nationkey")).alias("collection_id"), F.col("n_nationkey").cast("bigint").alias("pos")
    )
    return L.in_order(wanted, bound(t, "collections"), "collection_id", "pos").select("collection_id", "name", "pos")


KEY = """lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '')
  || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') || '?'
  || regexp_extract(url, '[?]([^#]*)', 1))"""


@query("urls_deduplicated", f"SELECT page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY page_id) = 1")
def _(t):
    return L.unique_addresses(t.pages.select("page_id", "url"), "url", [F.col("page_id")])


@query("urls_first_twelve", f"""
SELECT page_id FROM (SELECT page_id FROM pages QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY page_id) = 1) ORDER BY page_id LIMIT 12""")
def _(t):
    return L.unique_addresses(t.pages.select("page_id", "url"), "url", [F.col("page_id")], keep=12).select("page_id")


@query("urls_clean", """
WITH u AS (SELECT page_id, url, url || CASE WHEN contains(url, '#') THEN '' WHEN contains(url, '?') THEN '&utm_source=a&z=1'
  ELSE '?utm_medium=b' END AS raw FROM pages),
s AS (SELECT *, regexp_replace(raw, '#.*$', '') AS bare FROM u),
q AS (SELECT *, split_part(bare, '?', 1) AS base, array_to_string(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'),
  lambda p: p <> '' AND NOT starts_with(p, 'utm_')), '&') AS kept FROM s)
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS domain,
  CASE WHEN kept = '' THEN base ELSE base || '?' || kept END AS clean, TRUE AS valid, TRUE AS document_host FROM q""")
def _(t):
    extra = (
        F.when(F.contains("url", F.lit("#")), "").when(F.contains("url", F.lit("?")), "&utm_source=a&z=1").otherwise("?utm_medium=b")
    )
    return t.pages.withColumn("raw", F.concat("url", extra)).select(
        "page_id",
        U.domain(F.col("url")).alias("domain"),
        U.clean_url(F.col("raw")).alias("clean"),
        U.valid_url(F.col("url")).alias("valid"),
        U.is_document_host(F.col("url")).alias("document_host"),
    )


@query("urls_rejected", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN FALSE WHEN 1 THEN FALSE WHEN 2 THEN TRUE WHEN 3 THEN FALSE ELSE TRUE END AS valid,
  page_id % 5 <> 2 AS document_host FROM pages""")
def _(t):
    n = F.col("page_id") % 5
    raw = (
        F.when(n == 0, F.lit("ftp://a.example/x"))
        .when(n == 1, F.lit("https://user:pw@a.example/x"))
        .when(n == 2, F.lit("https://m.youtube.com/watch?v=1"))
        .when(n == 3, F.concat(F.lit("https://a.example/"), F.repeat(F.lit("x"), 3000)))
        .otherwise(F.col("url"))
    )
    return t.pages.select(
        "page_id", U.valid_url(raw).alias("valid"), U.is_document_host(raw).alias("document_host")
    )


@query("urls_public_addresses", """
SELECT user_id, count(*) FILTER (WHERE user_id % 4 NOT IN (0, 1, 2)) AS public, count(*) AS n FROM events GROUP BY user_id""")
def _(t):
    n = F.col("user_id") % 4
    last = (F.col("user_id") % 250).cast("string")
    ip = (
        F.when(n == 0, F.concat(F.lit("10.0.0."), last)).when(n == 1, F.lit("::1"))
        .when(n == 2, F.concat(F.lit("::ffff:192.168.1."), last)).otherwise(F.concat(F.lit("8.8.4."), last))
    )
    return t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("public", F.when(U.is_public_ip(ip), F.col("n")).otherwise(0))


@query("positions_wrong", with_bindings("library", "highlights") + DERIVED + """
SELECT highlight_id, CASE WHEN file_type <> 'pdf' THEN 'not_a_pdf' ELSE 'no_such_page' END AS problem FROM highlights h
JOIN x ON x.document_id = h.document_id WHERE page_number IS NOT NULL AND (file_type <> 'pdf' OR page_number < 1 OR page_number > page_count)""")
def _(t):
    return L.position_errors(bound(t, "highlights"), lib(t)).select("highlight_id", "problem")


@query("documents_status_counts", with_bindings("library") + """
SELECT user_id, count(*) FILTER (WHERE extraction_status = 'done') AS done,
  count(*) FILTER (WHERE extraction_status = 'processing') AS processing,
  count(*) FILTER (WHERE extraction_status = 'failed') AS failed FROM library GROUP BY user_id""")
def _(t):
    return A.status_counts(bound(t, "library"), "user_id", ["done", "processing", "failed"])


# ---- administrator


@query("admin_users_matching", with_bindings("users") + """
SELECT user_id FROM users WHERE (contains(lower(email), 'ilding') OR contains(lower(name), 'ilding')) AND disabled_on IS NULL""")
def _(t):
    return A.users(bound(t, "users"), " ILDing", "active").select("user_id")


@query("admin_users_wildcards_mean_nothing", with_bindings("users") + "SELECT user_id FROM users WHERE contains(lower(name), '%')")
def _(t):
    return A.users(bound(t, "users"), "%").select("user_id")


for _status, _where in (("active", "disabled_on IS NULL"), ("disabled", "disabled_on IS NOT NULL"), ("admin", "role = 'admin'")):

    @query(f"admin_users_{_status}", with_bindings("users") + f"SELECT user_id, name FROM users WHERE {_where}")
    def _(t, status=_status):
        return A.users(bound(t, "users"), status=status).select("user_id", "name")


@query("admin_user_storage_page", with_bindings("users", "library") + """
SELECT user_id, documents, storage_bytes FROM (
  SELECT u.user_id, u.seen_on, count(l.document_id) AS documents, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS storage_bytes
  FROM users u LEFT JOIN library l ON l.user_id = u.user_id GROUP BY 1, 2) ORDER BY seen_on DESC NULLS LAST, user_id LIMIT 25 OFFSET 25""")
def _(t):
    people = A.with_counts(bound(t, "users"), bound(t, "library"))
    page = A.page(people, [F.col("seen_on").desc_nulls_last(), F.col("user_id")], 2, A.PAGE_USERS)
    return page.select("user_id", "documents", "storage_bytes")


@query("admin_user_detail", with_bindings("users", "library", "highlights", "notes") + """
SELECT u.user_id, (SELECT count(*) FROM library l WHERE l.user_id = u.user_id) AS documents,
  (SELECT count(*) FROM highlights h WHERE h.user_id = u.user_id) AS highlights,
  (SELECT count(*) FROM notes n WHERE n.user_id = u.user_id) AS notes FROM users u""")
def _(t):
    return A.detail(
        bound(t, "users").select("user_id"),
        documents=bound(t, "library"),
        highlights=bound(t, "highlights"),
        notes=bound(t, "notes"),
    )


@query("admin_recent_audit", with_bindings("usage") + """
SELECT user_id, id FROM usage QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) <= 10""")
def _(t):
    return A.recent_audit(bound(t, "usage")).select("user_id", "id")


@query("admin_audit_rows", with_bindings("users", "traffic") + """
SELECT e.event_id, a.email AS admin_email, b.email AS target_email FROM events e LEFT JOIN users a ON a.user_id = e.user_id
LEFT JOIN users b ON b.user_id = e.event_id""")
def _(t):
    actions = t.events.select("event_id", F.col("user_id").alias("admin_id"), F.col("event_id").alias("target_id"))
    return M.audit_rows(actions, bound(t, "users")).select("event_id", "admin_email", "target_email")


# ---- merges


@query("merge_counters", with_bindings("traffic") + """
SELECT strftime(day, '%Y-%m-%d') AS day, area, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(errors) AS BIGINT) AS errors
FROM (SELECT * FROM traffic UNION ALL SELECT * FROM traffic WHERE area <> 'view') GROUP BY day, area""")
def _(t):
    rows = bound(t, "traffic")
    current = rows.groupBy("day", "area").agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"))
    out = M.add_counters(current, rows.filter("area <> 'view'"), ["day", "area"], ["requests", "errors"])
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("merge_insert_ignore", with_bindings("traffic") + "SELECT DISTINCT strftime(day, '%Y-%m-%d') AS day, user_id FROM traffic")
def _(t):
    pairs = bound(t, "traffic").select("day", "user_id")
    return M.insert_ignore(pairs.distinct(), pairs, ["day", "user_id"]).select(d("day"), "user_id")


@query("merge_insert_unless_exists", """
SELECT o_orderkey, o_orderkey IN (SELECT doc_id FROM documents) AS existing, CASE WHEN o_orderkey IN (SELECT doc_id FROM documents)
  THEN (SELECT lang FROM documents d WHERE d.doc_id = o_orderkey) ELSE o_orderstatus END AS value FROM orders""")
def _(t):
    current = t.documents.select(F.col("doc_id").alias("o_orderkey"), F.col("lang").alias("value"))
    return M.insert_unless_exists(current, t.orders.select("o_orderkey", F.col("o_orderstatus").alias("value")), ["o_orderkey"])


@query("merge_replace_by_parent", """
SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 0, CAST(n_chars AS DOUBLE) FROM documents""")
def _(t):
    current = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))
    fresh = t.documents.select(
        F.col("doc_id").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.col("n_chars").cast("double").alias("q")
    )
    return M.replace_by_parent(current, fresh, "l_orderkey")


@query("merge_update_where", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def _(t):
    return M.update_where(t.orders, F.col("o_orderstatus") == "P", o_orderstatus=F.lit("X")).select("o_orderkey", "o_orderstatus")


@query("merge_purge_accounts", with_bindings("users", "library", "usage") + """
, gone AS (SELECT user_id FROM users WHERE disabled_on IS NOT NULL)
SELECT 'document' AS kind, document_id AS id, user_id FROM library WHERE user_id NOT IN (SELECT user_id FROM gone)
UNION ALL SELECT 'usage', id, CASE WHEN user_id IN (SELECT user_id FROM gone) THEN NULL ELSE user_id END FROM usage""")
def _(t):
    gone = A.users(bound(t, "users"), status="disabled")
    docs = M.delete_owner(bound(t, "library"), gone, "user_id")
    calls = M.null_owner(bound(t, "usage"), gone, "user_id")
    return docs.select(F.lit("document").alias("kind"), F.col("document_id").alias("id"), "user_id").unionByName(
        calls.select(F.lit("usage").alias("kind"), "id", "user_id")
    )


@query("merge_notes_joined", with_bindings("highlights") + """
SELECT highlight_id, CASE WHEN note = '' THEN selected_text WHEN contains(note, selected_text) THEN note
  ELSE note || chr(10) || chr(10) || selected_text END AS note FROM highlights""")
def _(t):
    return bound(t, "highlights").select("highlight_id", M.join_notes(F.col("note"), F.col("selected_text")).alias("note"))


@query("merge_overlay", """
WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS color FROM orders),
l AS (SELECT event_id * 2 AS id, event_type AS color, event_type = 'signup' AS made FROM events)
SELECT coalesce(s.id, l.id) AS id, coalesce(l.color, s.color) AS color FROM s FULL JOIN l ON l.id = s.id WHERE s.id IS NOT NULL OR made""")
def _(t):
    server = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("color"))
    local = t.events.select(
        (F.col("event_id") * 2).alias("id"), F.col("event_type").alias("color"), (F.col("event_type") == "signup").alias("create")
    )
    return M.overlay(server, local, "id", ["color"])


@query("merge_last_write", """
SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id""")
def _(t):
    return M.last_write(t.events, "user_id", F.col("event_id"), ["event_type", "value"])


@query("merge_link_edits", with_bindings("notebook_links", "notebook_documents") + """
SELECT coalesce(a.notebook_id, b.notebook_id) AS notebook_id, coalesce(a.document_id, b.document_id) AS document_id,
  CASE WHEN a.notebook_id IS NULL THEN 'added' WHEN b.notebook_id IS NULL THEN 'removed' ELSE 'kept' END AS action
FROM (SELECT DISTINCT notebook_id, document_id FROM notebook_links) a
FULL JOIN notebook_documents b ON a.notebook_id = b.notebook_id AND a.document_id = b.document_id""")
def _(t):
    return M.edit_links(bound(t, "notebook_links"), bound(t, "notebook_documents"), ["notebook_id", "document_id"])


@query("reports_unseen", with_bindings("highlights") + """
SELECT DISTINCT document_id, category, page_number FROM highlights h WHERE NOT EXISTS (SELECT 1 FROM highlights k
  WHERE k.color = 'pink' AND k.document_id IS NOT DISTINCT FROM h.document_id AND k.category IS NOT DISTINCT FROM h.category
  AND k.page_number IS NOT DISTINCT FROM h.page_number)""")
def _(t):
    rows = bound(t, "highlights").select("document_id", "category", "page_number", "color")
    return M.unseen_reports(rows.filter("color = 'pink'"), rows.drop("color"), ["document_id", "category", "page_number"])


@query("license_backfill", with_bindings("library") + """
SELECT document_id, coalesce(license, CASE WHEN url LIKE 'https://theconversation.com/%' THEN 'CC BY-ND 4.0' END) AS license FROM library""")
def _(t):
    return bound(t, "library").select("document_id", U.known_license(F.col("license"), F.col("url")).alias("license"))


@query("notes_backfill", """
WITH d AS (SELECT doc_id AS document_id, n_chars AS user_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE substr(text, 1, 40) END AS note, DATE '2024-01-01' + CAST(n_chars % 100 AS INT) AS updated_at FROM documents),
n AS (SELECT CASE conv_id % 2 WHEN 0 THEN 'first-' || conv_id ELSE 'own-' || conv_id || '-' || turn END AS note_id, turn AS user_id, conv_id AS document_id, text AS body, role AS origin, DATE '2024-02-01' AS created_at FROM conversations WHERE turn = 1)
SELECT note_id, user_id, document_id, md5(body) AS body, origin, strftime(created_at, '%Y-%m-%d') AS created_at FROM n
UNION ALL SELECT 'first-' || document_id, user_id, document_id, md5(note), 'user', strftime(updated_at, '%Y-%m-%d') FROM d WHERE note <> '' AND 'first-' || document_id NOT IN (SELECT note_id FROM n)""")
def _(t):
    note = F.when(F.col("doc_id") % 3 == 1, F.lit("")).when(F.col("doc_id") % 3 == 2, F.substring("text", 1, 40))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 100).cast("int"))
    docs = t.documents.select(F.col("doc_id").alias("document_id"), F.col("n_chars").alias("user_id"), note.alias("note"), day.alias("updated_at"))
    name = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("first-"), F.col("conv_id").cast("string"))).otherwise(F.concat_ws("-", F.lit("own"), F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    made = F.lit("2024-02-01").cast("date")
    held = t.conversations.filter("turn = 1").select(
        name.alias("note_id"), F.col("turn").alias("user_id"), F.col("conv_id").alias("document_id"), F.col("text").alias("body"), F.col("role").alias("origin"), made.alias("created_at"), made.alias("updated_at")
    )
    out = M.notes_of_documents(docs, held)
    return out.select("note_id", "user_id", "document_id", F.md5("body").alias("body"), "origin", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))


@query("expect_rules", with_bindings("library") + """
SELECT 'known_source' AS rule, count(*) FILTER (WHERE source_type NOT IN ('manual', 'upload')) AS violations FROM library
UNION ALL SELECT 'short_title', count(*) FILTER (WHERE length(title) > 24) FROM library
UNION ALL SELECT 'page_in_document', count(*) FILTER (WHERE last_read_page > page_count) FROM library""")
def _(t):
    return M.expect(
        bound(t, "library"),
        {
            "known_source": F.col("source_type").isin("manual", "upload"),
            "short_title": F.length("title") <= 24,
            "page_in_document": F.col("last_read_page") <= F.col("page_count"),
        },
    )


@query("expect_unique_passages", with_bindings("highlights") + """
SELECT user_id, document_id, version, count(*) AS n FROM highlights WHERE page_number IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def _(t):
    return M.expect_unique(bound(t, "highlights"), ["user_id", "document_id", "version"], F.col("page_number").isNotNull())


@query("expect_highlights_per_document", with_bindings("highlights") + """
SELECT document_id, count(*) AS n FROM highlights GROUP BY 1 HAVING count(*) > 8""")
def _(t):
    return M.expect_at_most(bound(t, "highlights"), ["document_id"], 8)


@query("file_names_safe", with_bindings("library") + """
SELECT document_id, replace(replace(title, ' ', '?'), '?', '_') || '.pdf' AS name FROM library""")
def _(t):
    raw = F.concat(F.lit("C:\\tmp\\..\\ "), F.regexp_replace("title", " ", "?"), F.lit(".pdf. "))
    return bound(t, "library").select("document_id", S.safe_name(raw).alias("name"))


@query("dois_parsed", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '10.1000/ab(' || o_orderkey || ')' WHEN 1 THEN '10.1000/x+' || o_orderkey
  WHEN 2 THEN NULL ELSE '10.1234/y' || o_orderkey END AS doi FROM orders""")
def _(t):
    n, key = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    raw = (
        F.when(n == 0, F.concat(F.lit(" https://dx.doi.org/10.1000/AB%28"), key, F.lit(").")))
        .when(n == 1, F.concat(F.lit("DOI: 10.1000/x+"), key))
        .when(n == 2, F.concat(F.lit("10.12/no"), key))
        .otherwise(F.concat(F.lit("10.1234/Y"), key, F.lit(",;")))
    )
    return t.orders.select("o_orderkey", S.doi(raw).alias("doi"))


@query("values_significant", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_extendedprice = 0 THEN 0 ELSE
  round_even(l_extendedprice / 7 * pow(10.0, 3 - floor(log10(l_extendedprice / 7))), 0) / pow(10.0, 3 - floor(log10(l_extendedprice / 7))) END AS v
FROM lineitem""")
def _(t):
    v = S.significant(F.col("l_extendedprice") / 7)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v.alias("v"))


@query("sql_functions", with_bindings("library") + DERIVED + """
SELECT document_id, file_type, progress, reading_minutes, CAST(length(title) // 3 + 1 AS INT) AS tokens,
  strftime(created_at + INTERVAL 7 HOUR, '%Y-%m-%d') AS day FROM x""")
def _(t):
    S.sql_functions(t.spark)
    return bound(t, "library").selectExpr(
        "document_id",
        "file_type(source_type, original_filename) AS file_type",
        "progress(is_read, last_read_page, page_count, CAST(read_fraction AS DOUBLE)) AS progress",
        "reading_minutes(word_count) AS reading_minutes",
        "token_estimate(title) AS tokens",
        "date_format(vn_day(created_at), 'yyyy-MM-dd') AS day",
    )
