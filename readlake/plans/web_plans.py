"""Articles out of the given pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.functions import text as X
from readlake.functions import urls as U
from readlake.operators import web as W
from readlake.plans.registry import query
from readlake.session import pinned
from readlake.sources.html import html_nodes

TITLE = """regexp_replace(trim(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')), '^\\s+|\\s+$', '', 'g')"""


@query("page_metadata", f"SELECT page_id, {TITLE} AS title, FALSE AS paywalled FROM pages")
def _(t):
    out = W.metadata(pinned(html_nodes(t.pages), "nodes"), t.pages)
    return out.select("page_id", "title", "paywalled")


@query("page_nodes", """
SELECT page_id, len(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<script>.*?</script>', '<script></script>', 'g'),
  '(?i)<[a-z][a-z0-9]*[ >/]')) AS elements FROM pages""")
def _(t):
    nodes = html_nodes(t.pages).filter("tag <> ''")
    return nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("elements"))


@query("page_element_measures")
def _(t):
    clean = pinned(W.stripped(pinned(html_nodes(t.pages), "nodes")), "clean")
    return W.measures(clean, ["page_id"]).select("page_id", "node", "tag", "text_len", "link_len", "prose")


@query("page_containers")
def _(t):
    clean = pinned(W.stripped(pinned(html_nodes(t.pages).drop("attrs"), "nodes")), "clean")
    nodes = pinned(W.pruned(clean, [0, 1, 2, 3], pinned(W.measures(clean, ["page_id"]), "measures")), "pruned")
    return W.containers(nodes, pinned(W.measures(nodes, W.AT), "measures"))


@query("page_articles")
def _(t):
    return W.articles(t.pages).select("page_id", "title", "words", "variant", F.round("share", 4).alias("share"), F.md5("content").alias("content"))


@query("page_import_forecast")
def _(t):
    held = t.pages.select("url", F.col("page_id").alias("document_id")).filter("document_id % 2 = 0")
    return W.importable(W.articles(t.pages), held).select("page_id", "status", "kind", "words", "saved_as")


@query("page_titles_tidy", """
WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS host FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'A story - part two' WHEN 1 THEN 'A story' ELSE 'A story | Nobody Knows' END AS title FROM p""")
def _(t):
    n = F.col("page_id") % 3
    site = F.initcap(F.element_at(F.split(U.domain(F.col("url")), r"\."), -2))
    raw = (
        F.when(n == 0, F.concat(F.lit("A  story - part two | "), site)).when(n == 1, F.concat(F.lit(" A story – "), F.upper(site)))
        .otherwise("A story | Nobody Knows")
    )
    return t.pages.select("page_id", U.tidy_title(raw, F.col("url")).alias("title"))


@query("page_domains", """
SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS domain, count(*) AS pages FROM pages GROUP BY 1""")
def _(t):
    return t.pages.groupBy(U.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@query("page_words", """
SELECT page_id, len(regexp_extract_all(html, '[\\p{L}\\p{N}_]+')) AS words FROM pages""")
def _(t):
    return t.pages.select("page_id", X.word_count(F.col("html")).cast("bigint").alias("words"))
