"""The given tables read as the product's tables.

Each binding is one SELECT both Spark and the reference engine accept: customers are users, orders are
documents of a library, line items are highlights (a part is the notebook citing them), events are requests,
AI calls or notes, suppliers and nations are dimensions. Every binding covers its whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from readlake.schemas import TABLES, Tables

AS_OF = "2024-01-30"  # the fixed "today" of the telemetry tables
NOW = "2001-08-01"  # the fixed "now" of the library tables

USERS = """
SELECT c_custkey AS user_id, lower(c_name) || '@' || lower(c_mktsegment) || '.example' AS email, c_name AS name,
  CASE WHEN c_nationkey = 0 THEN 'admin' ELSE 'user' END AS role,
  CASE WHEN c_acctbal < 0 THEN DATE '2024-01-15' END AS disabled_on,
  CASE WHEN c_nationkey < 20 THEN DATE '2024-01-01' + c_nationkey END AS seen_on,
  CAST(c_nationkey % 30 AS INT) AS ai_used, DATE '2024-01-05' + c_nationkey AS ai_used_on,
  CAST(c_nationkey AS INT) AS collection_id
FROM customer
"""

DOCUMENTS = """
SELECT o_orderkey AS document_id, o_custkey AS user_id,
  'Report ' || o_orderpriority || ' no ' || CAST(o_orderkey AS VARCHAR(20)) AS title,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'manual' ELSE 'upload' END AS source_type,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderpriority = '5-LOW'
    THEN 'book' || CAST(o_orderkey AS VARCHAR(20)) || '.EPUB' WHEN o_orderpriority = '2-HIGH' THEN 'web.html'
    ELSE 'scan.pdf' END AS original_filename,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'https://www.site' || CAST(o_custkey % 50 AS VARCHAR(20))
    || '.example/a/' || CAST(o_orderkey AS VARCHAR(20)) WHEN o_orderpriority = '2-HIGH'
    THEN 'https://theconversation.com/p' || CAST(o_orderkey AS VARCHAR(20)) END AS url,
  CAST(floor(o_totalprice) AS BIGINT) AS file_size, CAST(o_orderkey % 40 AS INT) AS page_count,
  CAST(o_orderkey % 45 AS INT) AS last_read_page, CAST(floor(o_totalprice / 50) AS INT) AS word_count,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'processing' ELSE 'failed' END AS extraction_status,
  o_totalprice > 450000 AS is_read,
  CASE WHEN o_totalprice > 50000 THEN (o_orderkey % 101) / 100.0E0 END AS read_fraction,
  CAST(o_custkey % 20 AS INT) AS collection_id,
  CASE WHEN o_orderkey % 11 = 0 THEN 'CC BY-ND 4.0' WHEN o_orderkey % 11 = 1 THEN 'cc by' END AS license,
  o_orderdate AS created_at, o_orderdate + INTERVAL 1 DAY AS updated_at
FROM orders
"""

HIGHLIGHTS = """
SELECT CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) || '-'
    || CAST(l_partkey AS VARCHAR(20)) || '-' || CAST(l_suppkey AS VARCHAR(20)) AS highlight_id,
  l_orderkey AS document_id, l_suppkey AS user_id, l_partkey AS notebook_id,
  CASE l_returnflag WHEN 'A' THEN 'yellow' WHEN 'N' THEN 'green' ELSE 'pink' END AS color,
  CASE WHEN l_linestatus = 'F' THEN 'concept' WHEN l_discount > 0.05 THEN 'question' END AS category,
  CASE WHEN l_tax > 0.04 THEN 'remember ' || l_returnflag ELSE '' END AS note,
  'passage ' || CAST(l_partkey AS VARCHAR(20)) || ' of ' || l_linestatus AS selected_text,
  CASE WHEN l_tax > 0.01 THEN l_linenumber END AS page_number,
  CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS start_at,
  CAST(floor(l_extendedprice) AS BIGINT) % 5000 + CAST(l_quantity AS BIGINT) * 20 AS end_at,
  CASE WHEN l_quantity > 25 THEN 'v1' ELSE 'v2' END AS version,
  CASE WHEN l_discount < 0.08 THEN 'mapped' WHEN l_discount < 0.1 THEN 'ambiguous' ELSE 'unresolved' END
    AS anchor_status,
  CASE WHEN l_discount < 0.05 THEN 'synced' WHEN l_discount < 0.09 THEN 'unsynced' ELSE 'ambiguous' END
    AS sync_status,
  l_shipdate AS created_at, l_shipdate + INTERVAL 2 DAY AS updated_at
FROM lineitem
"""

NOTES = """
SELECT event_id AS note_id, event_id - event_id % 3 AS document_id, user_id,
  event_type || ' note ' || CAST(event_id AS VARCHAR(20)) AS body,
  CASE WHEN event_type IN ('click', 'view') THEN 'user' ELSE 'ai_saved' END AS origin,
  ts AS created_at, ts AS updated_at
FROM events
"""

NOTEBOOKS = """
SELECT p_partkey AS notebook_id, p_partkey % 100 AS user_id, p_name AS title, p_type AS content,
  CASE WHEN p_size > 25 THEN 'draft' ELSE 'saved' END AS status,
  CASE WHEN p_size % 2 = 0 THEN 'gpt-4.1-mini' END AS ai_model,
  DATE '2001-08-01' - p_size AS opened_on, DATE '2001-08-01' - CAST(p_partkey % 60 AS INT) AS updated_on
FROM part
"""

NOTEBOOK_LINKS = """
SELECT l_partkey AS notebook_id, l_orderkey AS document_id, CAST(l_orderkey AS VARCHAR(20)) || '-'
    || CAST(l_linenumber AS VARCHAR(20)) || '-' || CAST(l_partkey AS VARCHAR(20)) || '-'
    || CAST(l_suppkey AS VARCHAR(20)) AS highlight_id, l_linenumber AS position
FROM lineitem
"""

NOTEBOOK_DOCUMENTS = "SELECT o_custkey AS notebook_id, o_orderkey AS document_id FROM orders"

COLLECTIONS = "SELECT n_nationkey AS collection_id, n_name AS name FROM nation"

# AI calls: the purpose is the event's type, the model its number, a null cost an unpriced call.
USAGE = """
SELECT event_id AS id, ts AS created_at, CAST(ts + INTERVAL 7 HOUR AS DATE) AS day,
  CAST(user_id AS VARCHAR(20)) || '-' || CAST(hour(ts) AS VARCHAR(20)) AS request_id, user_id,
  event_type AS purpose, 'm' || CAST(k % 3 AS VARCHAR(20)) AS model, k * 10 AS prompt_tokens,
  k AS cached_tokens, k * 3 AS completion_tokens, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS web_searches,
  CASE WHEN k > 0 THEN value END AS cost_usd, event_type <> 'error' AS ok
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
"""

TRAFFIC = """
SELECT CAST(ts + INTERVAL 7 HOUR AS DATE) AS day, event_type AS area, 1 AS requests,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS errors,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS ai_calls, user_id
FROM events
"""

# One request per event: the areas, methods and statuses of the access log.
REQUESTS = """
SELECT event_id, ts, user_id, CASE WHEN event_type = 'click' THEN 'OPTIONS' WHEN event_type = 'purchase'
    THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN event_type = 'purchase' THEN '/api/translate' WHEN event_type = 'signup' THEN '/healthz'
    ELSE '/api/documents/' || CAST(event_id AS VARCHAR(20)) || '/notes' END AS path,
  CASE WHEN event_type = 'error' THEN 500 WHEN value > 9 THEN 404 ELSE 200 END AS status
FROM events
"""

BINDINGS = {
    "users": USERS,
    "library": DOCUMENTS,
    "highlights": HIGHLIGHTS,
    "notes": NOTES,
    "notebooks": NOTEBOOKS,
    "notebook_links": NOTEBOOK_LINKS,
    "notebook_documents": NOTEBOOK_DOCUMENTS,
    "collections": COLLECTIONS,
    "usage": USAGE,
    "traffic": TRAFFIC,
    "requests": REQUESTS,
}


def bound(t: Tables, name: str) -> DataFrame:
    """The product table `name` derived from the given tables."""
    text = BINDINGS[name]
    used = [n for n in TABLES if re.search(rf"FROM {n}\b", text)]
    for n in used:
        text = re.sub(rf"FROM {n}\b", "FROM {" + n + "}", text)
    return t.spark.sql(text, **{n: getattr(t, n) for n in used})


def with_bindings(*names: str) -> str:
    """The same tables as common table expressions for the reference SQL."""
    return "WITH " + ", ".join(f"{n} AS ({BINDINGS[n].strip()})" for n in names) + "\n"
