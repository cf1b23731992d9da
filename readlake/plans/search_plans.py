"""Search over the given texts, conversations and the library's highlights and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.functions import scalars as S
from readlake.functions import text as X
from readlake.operators import search as R
from readlake.plans.bindings import bound, with_bindings
from readlake.plans.registry import query
from readlake.session import shared_path

Q = "that ther"
FOLD = "translate(strip_accents(lower({0})), 'đ', 'd')"
TOK = "regexp_extract_all(" + FOLD + ", '[\\p{{L}}\\p{{N}}_]+')"


def matches(col: str, terms=("that", "ther")) -> str:
    toks = TOK.format(col)
    tests = [f"list_contains({toks}, '{t}')" for t in terms[:-1]]
    tests.append(f"len(list_filter({toks}, lambda x: starts_with(x, '{terms[-1]}'))) > 0")
    return "(" + " AND ".join(tests) + ")"


def score(col: str, terms=("that", "ther")) -> str:
    toks = TOK.format(col)
    parts = [f"ln(1 + len(list_filter({toks}, lambda x: x = '{t}')))" for t in terms[:-1]]
    parts.append(f"ln(1 + len(list_filter({toks}, lambda x: starts_with(x, '{terms[-1]}'))))")
    return "(" + " + ".join(parts) + ")"


DOCS = """
, d AS (SELECT doc_id, source, split_part(text, chr(10), 1) AS title, text FROM documents)
"""


def texts(t):
    return t.documents.select("doc_id", "source", F.substring_index("text", "\n", 1).alias("title"), "text")


def marked_snippet(body: str, fold: str, first: str) -> str:
    cut = f"substr({body}, greatest({first} - 61, 0) + 1, 200)"
    return f"""CASE WHEN {first} - 61 > 0 THEN '…' ELSE '' END || trim(regexp_replace({cut},
      '([tT][hH][aA][tT]|[tT][hH][eE][rR])', chr(2) || '\\1' || chr(3), 'g'), ' ')
      || CASE WHEN greatest({first} - 61, 0) + 200 < length({body}) THEN '…' ELSE '' END"""


_FOUND = f"""WITH d AS (SELECT doc_id, source, split_part(text, chr(10), 1) AS title, text FROM documents),
h AS (SELECT doc_id, text, {FOLD.format("text")} AS f,
  round({score("title")} * 2 + {score("text")}, 6) AS score FROM d WHERE {matches("title")} OR {matches("text")})"""

_FIRST = "least(CASE WHEN strpos(f, 'that') > 0 THEN strpos(f, 'that') ELSE 1000000000 END, CASE WHEN strpos(f, 'ther') > 0 THEN strpos(f, 'ther') ELSE 1000000000 END)"


@query("search_documents", _FOUND + f"""
SELECT doc_id, score, {marked_snippet("text", "f", _FIRST)} AS snippet, (SELECT count(*) FROM h) AS total
FROM (SELECT * FROM h ORDER BY score DESC, doc_id DESC LIMIT 10)""")
def _(t):
    found = R.search(texts(t), Q, "text", "doc_id", "doc_id", title="title")
    return found.select("doc_id", "score", "snippet", "total")


@query("search_documents_all_matches", _FOUND + " SELECT doc_id, score FROM h")
def _(t):
    return R.hits(texts(t), Q, "text", "title").select("doc_id", "score")


@query("search_page_two", _FOUND + """
SELECT doc_id, score FROM (SELECT * FROM h ORDER BY score DESC, doc_id DESC LIMIT 10 OFFSET 10)""")
def _(t):
    return R.page_of(R.hits(texts(t), Q, "text", "title"), 2, "doc_id", "doc_id").select("doc_id", "score")


@query("search_result_pages", _FOUND + " SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 10.0)) AS BIGINT) AS pages FROM h")
def _(t):
    return R.result_pages(R.hits(texts(t), Q, "text", "title"))


@query("search_conversations_contains_all", f"""
SELECT conv_id, turn FROM conversations WHERE contains({FOLD.format("text")}, 'the') AND contains({FOLD.format("text")}, 'ou')""")
def _(t):
    return t.conversations.filter(R.contains_all(F.col("text"), "The  Où")).select("conv_id", "turn")


@query("search_by_index", f"""
WITH h AS (SELECT doc_id, round({score("text")}, 6) AS score FROM documents WHERE {matches("text")}) SELECT * FROM h""")
def _(t):
    return R.from_index(R.token_index(t.documents, "doc_id", "text"), Q, "doc_id")


@query("search_by_written_index", f"""
WITH h AS (SELECT doc_id, round({score("text")}, 6) AS score FROM documents WHERE {matches("text")}) SELECT * FROM h""")
def _(t):
    path = shared_path(t.spark, "token_index")
    R.write_index(R.token_index(t.documents, "doc_id", "text"), path)
    return R.from_index(t.spark.read.parquet(path), Q, "doc_id")


@query("search_highlights_and_notes", with_bindings("highlights", "library") + """
, a AS (SELECT h.highlight_id AS id, title, h.created_at, round(ln(1 + 1), 6) AS score FROM highlights h
  JOIN library d ON d.document_id = h.document_id WHERE note <> '' AND note = 'remember A')
, n AS (SELECT CAST(event_id AS VARCHAR) AS id, event_id, event_type FROM events WHERE event_type = 'signup')
SELECT * FROM (SELECT id, 1 AS part, (SELECT count(*) FROM a) AS total, (SELECT count(*) FROM a) AS all_total FROM a
  ORDER BY score DESC, created_at DESC, id LIMIT 10)""")
def _(t):
    documents = bound(t, "library").select("document_id", "title")
    noted = bound(t, "highlights").filter(F.col("note") != "")
    found = R.search(noted, "remember a", "note", "highlight_id", "created_at")
    own = bound(t, "notes").withColumnRenamed("note_id", "highlight_id")
    second = R.search(own, "remember a", "body", "highlight_id", "created_at")
    named = found.join(documents, "document_id").select(F.col("highlight_id").alias("id"), "total")
    other = second.select(F.col("highlight_id").cast("string").alias("id"), "total")
    return R.two_lists(named, other).select("id", "part", "total", F.col("all_total"))


@query("search_notebooks", with_bindings("notebooks") + f"""
SELECT notebook_id, round({score("title", ("small", "bo"))} * 2 + {score("content", ("small", "bo"))}, 6) AS score
FROM notebooks WHERE {matches("title", ("small", "bo"))} OR {matches("content", ("small", "bo"))}""")
def _(t):
    return R.hits(bound(t, "notebooks"), "small bo", "content", "title").select("notebook_id", "score")


@query("search_match_counts", with_bindings("library", "highlights", "notes") + """
SELECT document_id, CAST(sum(n) AS BIGINT) AS matches FROM (
  SELECT document_id, 0 AS n FROM library WHERE title LIKE '%1-URGENT%'
  UNION ALL SELECT document_id, 1 FROM highlights WHERE selected_text LIKE '% urgent%' OR note LIKE '%urgent%'
  UNION ALL SELECT document_id, 1 FROM notes WHERE body LIKE '%urgent%') GROUP BY document_id""")
def _(t):
    return R.match_counts(bound(t, "library"), bound(t, "highlights"), bound(t, "notes"), "1 urgent")


@query("search_palette", with_bindings("library", "highlights") + """
SELECT kind, id, label FROM (SELECT 'document' AS kind, CAST(document_id AS VARCHAR) AS id, title AS label FROM library
  WHERE lower(title || ' ' || coalesce(original_filename, '')) LIKE '%scan.pdf%'
  ORDER BY created_at DESC, document_id LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'highlight' AS kind, highlight_id AS id, selected_text AS label FROM highlights
  WHERE lower(selected_text || ' ' || note) LIKE '%scan.pdf%' ORDER BY created_at DESC, highlight_id LIMIT 6)""")
def _(t):
    docs = bound(t, "library").withColumn("origin", F.coalesce("original_filename", F.lit("")))
    return R.palette(docs, bound(t, "highlights"), "Scan.PDF")


@query("fold_texts", f"SELECT doc_id, md5({FOLD.format('text')}) AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"))


@query("text_measures", """
SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS INT) AS words,
  CAST(length(text) // 3 + 1 AS INT) AS token_estimate,
  CASE WHEN length(regexp_replace(text, '\\P{L}+', '', 'g')) = 0 THEN 'vi'
    WHEN length(regexp_replace(text, '[^%s]+', '', 'g'))
      / length(regexp_replace(text, '\\P{L}+', '', 'g')) > 0.03 THEN 'vi' ELSE 'en' END AS language
FROM documents""" % X.VI_LETTERS)
def _(t):
    body = F.col("text")
    return t.documents.select(
        "doc_id",
        X.word_count(body).alias("words"),
        X.token_estimate(body).alias("token_estimate"),
        X.detect_language(body).alias("language"),
    )


@query("text_translation_direction", """
WITH l AS (SELECT doc_id, length(regexp_replace(text, '\\P{L}+', '', 'g')) AS n,
  length(regexp_replace(text, '[^%s]+', '', 'g')) AS v FROM documents)
SELECT CASE WHEN n = 0 OR v / n > 0.03 THEN 'vi-en' ELSE 'en-vi' END AS direction, count(*) AS documents FROM l GROUP BY 1"""
    % X.VI_LETTERS)
def _(t):
    return t.documents.groupBy(X.translation_direction(F.col("text")).alias("direction")).agg(
        F.count(F.lit(1)).alias("documents")
    )


@query("text_collapsed", """
SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS line,
  md5(lower(trim(regexp_replace(regexp_replace(text, '[*_`#>\\[\\]()|~]+', ' ', 'g'), '\\s+', ' ', 'g'), ' '))) AS screen
FROM documents""")
def _(t):
    return t.documents.select(
        "doc_id", F.md5(X.collapse(F.col("text"))).alias("line"), F.md5(X.screen_words(F.col("text"))).alias("screen")
    )


@query("text_plain_words", """
SELECT doc_id, md5(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'),
  '(?m)^\\s{0,3}(#{1,6}\\s+|>\\s?|[-*+]\\s+|\\d+\\.\\s+)', '', 'g'), '\\*\\*|__|`|<br\\s*/?>', '', 'g'),
  '(?m)^\\|?[\\s:|-]+\\|?$', '', 'g'), '|', ' ')) AS words FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(X.plain(F.col("text"))).alias("words"))


@query("text_titles", """
SELECT doc_id, CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) > 80
    THEN substr(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1, 79) || '…'
    ELSE trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') END AS title,
  CASE WHEN length(trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'), ' ')) > 120
    THEN rtrim(substr(trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'), ' '), 1, 119), ' ') || '…'
    ELSE trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'), ' ') END AS line,
  rtrim(substr(regexp_replace(regexp_replace(translate(strip_accents(lower(text)), 'đ', 'd'), '[^a-z0-9]+', '-', 'g'),
    '^-+|-+$', '', 'g'), 1, 60), '-') AS slug FROM documents""")
def _(t):
    body = F.col("text")
    return t.documents.select(
        "doc_id",
        X.short_title(body).alias("title"),
        X.clean_line(body, 120).alias("line"),
        X.slug(body).alias("slug"),
    )


@query("text_content_version", "SELECT doc_id, substr(sha256(text), 1, 16) AS version FROM documents")
def _(t):
    return t.documents.select("doc_id", S.content_version(F.col("text")).alias("version"))


@query("answer_citations", """
WITH a AS (SELECT conv_id, turn, text || ' [1] and [12][1], not [1234] nor [x] [' || turn || ']' AS answer FROM conversations)
SELECT conv_id, turn, array_to_string(CASE WHEN turn IN (1, 12) THEN [1, 12] ELSE [1, 12, turn] END, ',') AS cited,
  md5(regexp_replace(answer, '[ \\t]*\\[[0-9]{1,3}\\]', '', 'g')) AS bare FROM a""")
def _(t):
    answer = F.concat("text", F.lit(" [1] and [12][1], not [1234] nor [x] ["), F.col("turn").cast("string"), F.lit("]"))
    return t.conversations.select(
        "conv_id",
        "turn",
        F.array_join(F.transform(X.cited(answer), lambda n: n.cast("string")), ",").alias("cited"),
        F.md5(F.regexp_replace(answer, r"[ \t]*\[[0-9]{1,3}\]", "")).alias("bare"),
    )


@query("answer_refusals", """
SELECT conv_id, turn, turn % 2 = 0 OR starts_with(lower(regexp_replace(text, '^[\\s>*_"“]+', '')), 'this document does not contain enough information to answer that')
  AS refused FROM conversations""")
def _(t):
    said = F.when(
        F.col("turn") % 2 == 0, F.concat(F.lit("> *“This document DOES NOT contain enough information to answer that: "), "text")
    ).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", X.abstained(said).alias("refused"))


@query("answer_unfenced", """
SELECT conv_id, turn, md5(trim(text, ' ')) AS body, CASE WHEN turn = 0 THEN 'Part ' || conv_id ELSE NULL END AS title FROM conversations""")
def _(t):
    fenced = F.concat(F.lit("```markdown\n"), F.trim("text"), F.lit("\n```\n"))
    heading = F.concat(F.lit("intro\n# **Part** `"), F.col("conv_id").cast("string"), F.lit("` ##\nmore"))
    return t.conversations.select(
        "conv_id",
        "turn",
        F.md5(X.unfence(fenced)).alias("body"),
        F.when(F.col("turn") == 0, X.heading_title(heading)).alias("title"),
    )


@query("search_headlines", f"""
WITH w AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS word, l FROM (
  SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), ' ') AS l FROM documents WHERE {matches("text")})),
f AS (SELECT *, CASE WHEN list_contains({TOK.format("word")}, 'that') THEN 1 ELSE 0 END AS a,
  CASE WHEN len(list_filter({TOK.format("word")}, lambda x: starts_with(x, 'ther'))) > 0 THEN 1 ELSE 0 END AS b FROM w),
r AS (SELECT doc_id, pos, l, a + b AS here, max(a) OVER s + max(b) OVER s AS n FROM f
  WINDOW s AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING))
SELECT doc_id, regexp_replace(array_to_string(l[pos:pos + 31], ' '), '([tT][hH][aA][tT]|[tT][hH][eE][rR])',
  chr(2) || '\\1' || chr(3), 'g') AS headline
FROM r WHERE here > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) = 1""")
def _(t):
    return R.headline(t.documents.filter(R.match(F.col("text"), Q)), "doc_id", "text", Q)
