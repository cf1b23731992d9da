"""Passages, retrieval and citations over the given texts, vectors and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.functions import scalars as S
from readlake.functions import text as X
from readlake.operators import chunks as C
from readlake.operators import passage_index as I
from readlake.operators import retrieval as R
from readlake.plans.registry import query
from readlake.session import shared_path

TOKENS = 200
FLAT = "regexp_replace({0}, '\\s+', '', 'g')"


def doc_chunks(t, tokens=TOKENS):
    """The documents' lines are their paragraphs: each line break becomes a paragraph break."""
    return C.split(t.documents.withColumn("body", F.regexp_replace("text", "\n", "\n\n")), "doc_id", "body", tokens)


@query("passages_cover_text", f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))),
  lambda x: x <> '' AND x <> '---') AS l FROM documents)
SELECT doc_id, md5({FLAT.format("array_to_string(l, '')")}) AS words FROM p WHERE len(l) > 0""")
def _(t):
    rows = doc_chunks(t).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("c"))
    text = F.array_join(F.transform("c", lambda c: c["text"]), "")
    return rows.select("doc_id", F.md5(F.regexp_replace(text, r"\s+", "")).alias("words"))


@query("passages_within_budget", """
SELECT CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS bad_estimate, CAST(0 AS BIGINT) AS bad_number""")
def _(t):
    rows = doc_chunks(t)
    last = rows.groupBy("doc_id").agg(F.max("position").alias("top"), F.count(F.lit(1)).alias("n"))
    checks = rows.agg(
        F.count_if(F.length("text") > TOKENS * 3 + C.MIN_CHUNK_CHARS + 2).alias("too_long"),
        F.count_if(F.col("token_count") != F.floor(F.length("text") / 3) + 1).alias("bad_estimate"),
    )
    return checks.withColumn("bad_number", last.agg(F.count_if(F.col("top") != F.col("n"))).scalar())


@query("passages")
def _(t):
    return C.labelled(doc_chunks(t)).select("doc_id", "position", "heading", "token_count", F.md5("labelled").alias("digest"))


@query("passages_with_pages_and_headings")
def _(t):
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 7 == 0, F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n\n"), x))
        .when(i % 5 == 0, F.concat(F.lit("\n---\n\n"), x))
        .otherwise(x),
    )
    made = t.documents.withColumn("body", F.array_join(lines, "\n\n"))
    made = made.withColumn("pages", F.size(F.filter(F.split("body", C.PAGE_BREAK), lambda p: F.rlike(p, F.lit(r"\S")))))
    cut = C.split(made, "doc_id", "body", TOKENS, "pages")
    return cut.select("doc_id", "position", "page_number", "heading", "token_count")


@query("passage_groups")
def _(t):
    return C.groups(doc_chunks(t), "doc_id", 1500).select("doc_id", "position", "token_count", "group")


@query("passage_parts_cover_text", f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))),
  lambda x: x <> '' AND x <> '---') AS l FROM documents)
SELECT doc_id, md5({FLAT.format("array_to_string(l, '')")}) AS words FROM p WHERE len(l) > 0""")
def _(t):
    made = t.documents.withColumn("body", F.regexp_replace("text", "\n", "\n\n"))
    rows = C.parts(made, "doc_id", "body", TOKENS).groupBy("doc_id")
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("c"))
    text = F.array_join(F.transform("c", lambda c: c["text"]), "")
    return rows.select("doc_id", F.md5(F.regexp_replace(text, r"\s+", "")).alias("words"))


LINES = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS position FROM documents)
"""


def lines(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "text"))
    return rows.withColumn("position", F.col("position") + 1)


HEADS = LINES + """
, h AS (SELECT *, CASE WHEN position % 4 = 1 THEN split_part(text, ' ', 1) END AS own FROM l)
"""


@query("heading_in_force", HEADS + """
SELECT doc_id, position, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM h""")
def _(t):
    from readlake.operators.blocks import heading_in_force

    rows = lines(t).withColumn("own", F.when(F.col("position") % 4 == 1, F.substring_index("text", " ", 1)))
    return heading_in_force(rows, "doc_id", "position", "own").select("doc_id", "position", "heading")


SCREEN = "lower(trim(regexp_replace(regexp_replace({0}, '[*_`#>\\[\\]()|~]+', ' ', 'g'), '\\s+', ' ', 'g'), ' '))"
QUOTES = LINES + f"""
, q AS (SELECT doc_id, {SCREEN.format("substr(text, length(text) // 2, 120)")} AS w FROM documents)
, n AS (SELECT doc_id, CASE WHEN length(w) > 80 THEN regexp_replace(substr(w, 1, 80), ' [^ ]*$', '') ELSE w END AS needle FROM q WHERE w <> '')
, hit AS (SELECT l.doc_id, position FROM l JOIN n ON n.doc_id = l.doc_id WHERE contains({SCREEN.format("l.text")}, needle)
  QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY position) <= 2)
, near AS (SELECT DISTINCT l.doc_id, l.position FROM hit JOIN l ON l.doc_id = hit.doc_id AND abs(l.position - hit.position) <= 1)
"""


def quotes(t):
    quote = F.substr("text", F.floor(F.length("text") / 2).cast("int"), F.lit(120))
    return t.documents.select("doc_id", F.col("doc_id").alias("quote_id"), quote.alias("quote"))


@query("passages_around_quote", QUOTES + "SELECT doc_id, position FROM near")
def _(t):
    return R.around_quote(lines(t), quotes(t), "doc_id").select("doc_id", "position")


@query("passages_quote_first", QUOTES + """
, r AS (SELECT doc_id, position, 100 - position AS score FROM l)
, m AS (SELECT doc_id, position, min(tier) AS tier, max(score) AS score FROM (SELECT doc_id, position, 0 AS tier, 0 AS score FROM near
  UNION ALL SELECT doc_id, position, 1, score FROM r) GROUP BY 1, 2)
SELECT doc_id, position FROM m QUALIFY tier = 0 OR row_number() OVER (PARTITION BY doc_id ORDER BY tier, score DESC, position) <= 8""")
def _(t):
    near = R.around_quote(lines(t), quotes(t), "doc_id").select(F.col("doc_id").alias("question_id"), "position")
    rest = lines(t).select(F.col("doc_id").alias("question_id"), "position", (100 - F.col("position")).cast("double").alias("score"))
    return R.merge_passages(near, rest).select(F.col("question_id").alias("doc_id"), "position")


COS = """
, s AS (SELECT q.vec_id AS question_id, p.vec_id AS position, round(list_cosine_similarity(p.e, q.e), 6) AS score
  FROM v p JOIN v q ON p.label = q.label)
, k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, position) <= 8)
"""
VEC = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _closest(t):
    rows = t.embeddings.select(F.col("label").alias("document"), F.col("vec_id").alias("position"), "embedding")
    return R.closest_of_many(rows, rows.withColumnRenamed("position", "question_id"), "document", tile=4096, block=4096)  # every vector asks


@query("closest_passages", VEC + COS + "SELECT question_id, position, score FROM k")
def _(t):
    return _closest(t).select("question_id", "position", "score")


@query("prompt_context", VEC + COS + """
, n AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY position) AS n FROM k)
SELECT question_id, '<passages>' || chr(10) || string_agg('[' || n || '] (page ' || position || ', h)' || chr(10) || 'text ' || position || chr(10), chr(10)
  ORDER BY n) || chr(10) || '</passages>' AS context FROM n GROUP BY question_id""")
def _(t):
    shown = _closest(t).select(
        "question_id", "position", F.col("position").alias("page_number"), F.lit("h").alias("heading"),
        F.concat(F.lit("text "), F.col("position").cast("string")).alias("text"),
    )
    return R.prompt_passages(shown)


#: One vector in a hundred asks.
COS_HUNDREDTH = """
, s AS (SELECT q.vec_id AS question_id, p.vec_id AS position, round(list_cosine_similarity(p.e, q.e), 6) AS score
  FROM v p JOIN v q ON p.label = q.label WHERE q.vec_id % 100 = 0)
, k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, position) <= 8)
"""
CONTEXT = """
, n AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY position) AS n FROM k)
SELECT question_id, '<passages>' || chr(10) || string_agg('[' || n || '] (page ' || position || ', h)' || chr(10) || 'text ' || position || chr(10), chr(10)
  ORDER BY n) || chr(10) || '</passages>' AS context FROM n GROUP BY question_id"""


def _closest_of_hundredth(t):
    rows = t.embeddings.select(F.col("label").alias("document"), F.col("vec_id").alias("position"), "embedding")
    return R.closest_of_many(rows, rows.filter("position % 100 = 0").withColumnRenamed("position", "question_id"), "document")


@query("closest_passages_hundredth", VEC + COS_HUNDREDTH + "SELECT question_id, position, score FROM k")
def _(t):
    return _closest_of_hundredth(t).select("question_id", "position", "score")


@query("prompt_context_hundredth", VEC + COS_HUNDREDTH + CONTEXT)
def _(t):
    shown = _closest_of_hundredth(t).select(
        "question_id", "position", F.col("position").alias("page_number"), F.lit("h").alias("heading"),
        F.concat(F.lit("text "), F.col("position").cast("string")).alias("text"),
    )
    return R.prompt_passages(shown)


@query("citations_kept", """
WITH a AS (SELECT conv_id, max(turn) % 5 AS c FROM conversations GROUP BY 1)
SELECT m.conv_id, m.turn AS n, substr(m.text, 1, 600) AS text FROM conversations m JOIN a ON a.conv_id = m.conv_id
WHERE m.turn = c OR m.turn = 1""")
def _(t):
    answers = t.conversations.groupBy("conv_id").agg((F.max("turn") % 5).alias("c"))
    answers = answers.select("conv_id", F.concat(F.lit("so [1], and ["), F.col("c").cast("string"), F.lit("].")).alias("answer"))
    return R.kept_citations(t.conversations.withColumnRenamed("turn", "n"), answers, "conv_id")


@query("citations_renumbered", """
WITH u AS (SELECT l_orderkey AS result_id, l_partkey % 9 AS n, l_linenumber * 1000000 + l_suppkey AS ord FROM lineitem)
SELECT result_id, n, row_number() OVER (PARTITION BY result_id ORDER BY min(ord), n) AS number FROM u GROUP BY result_id, n""")
def _(t):
    uses = t.lineitem.select(
        F.col("l_orderkey").alias("result_id"), (F.col("l_partkey") % 9).alias("n"),
        (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("ord"),
    )
    return R.renumber(uses)


@query("vectors_encoded", """
SELECT vec_id, round(list_cosine_similarity(list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 6)), list_reverse(CAST(embedding AS DOUBLE[]))), 6) AS cosine,
  len(embedding) AS size FROM embeddings""")
def _(t):
    back = R.decode(R.encode(F.col("embedding")))
    return t.embeddings.select(
        "vec_id", F.round(R.cosine(back, F.reverse("embedding")), 6).alias("cosine"), F.size(back).cast("bigint").alias("size")
    )


@query("index_stale_documents", """
SELECT doc_id FROM documents WHERE NOT (n_chars % 3 = 0 AND lang <> 'en')""")
def _(t):
    docs = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"), F.lit("e1").alias("model"))
    held = t.documents.filter("n_chars % 3 = 0").select(
        "doc_id", F.sha2("text", 256).alias("digest"), F.when(F.col("lang") == "en", "e0").otherwise("e1").alias("model")
    )
    return C.stale_documents(docs, held, "doc_id").select("doc_id")


@query("index_refreshed", """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN upper(lang) || chr(10) || text ELSE text END AS text FROM documents WHERE doc_id % 100 <> 8)
SELECT * FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS position FROM d) WHERE p <> ''
""".replace("SELECT * FROM (", "SELECT doc_id, position, md5(p) AS passage FROM ("))
def _(t):
    """An index of all texts but a hundredth; then a hundredth changes, one leaves and one comes."""
    path, text = shared_path(t.spark, "index"), F.sha2("text", 256)
    cut = lambda docs: docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "passage")).filter("passage <> ''").withColumn("position", F.col("position") + 1)
    I.refresh(t.documents.filter("doc_id % 100 <> 9"), path, "doc_id", text, "e1", cut)
    new = F.when(F.col("doc_id") % 100 == 7, F.concat(F.upper("lang"), F.lit("\n"), "text")).otherwise(F.col("text"))
    I.refresh(t.documents.filter("doc_id % 100 <> 8").withColumn("text", new), path, "doc_id", text, "e1", cut)
    return I.passages(t.spark, path).select("doc_id", F.col("position").cast("bigint").alias("position"), F.md5("passage").alias("passage"))


@query("index_refreshed_passages", """
SELECT CAST(0 AS BIGINT) AS only_refreshed, CAST(0 AS BIGINT) AS only_rebuilt, count(*) FILTER (WHERE doc_id % 100 = 7) AS cut FROM documents""")
def _(t):
    """The same with passages of token size: what a refresh leaves is what an index built anew holds."""
    path, again = shared_path(t.spark, "index"), shared_path(t.spark, "index")
    text, cut = F.sha2("text", 256), lambda docs: C.split(docs.withColumn("body", F.regexp_replace("text", "\n", "\n\n")), "doc_id", "body", TOKENS)
    changed = t.documents.withColumn("text", F.when(F.col("doc_id") % 100 == 7, F.concat(F.lit("New words first.\n"), "text")).otherwise(F.col("text")))
    I.refresh(t.documents, path, "doc_id", text, "e1", cut)
    done = I.refresh(changed, path, "doc_id", text, "e1", cut)
    I.refresh(changed, again, "doc_id", text, "e1", cut)
    # Copies of a passage in one index less those in the other; texts meet by digest.
    held = lambda p, n: I.passages(t.spark, p).select("doc_id", "position", F.unhex(F.sha2("text", 256)).alias("text"), "token_count", F.lit(n).alias("n"))
    more = held(path, 1).unionByName(held(again, -1)).groupBy("doc_id", "position", "text", "token_count").agg(F.sum("n").alias("n"))
    over = lambda n: F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).cast("bigint")
    return more.agg(over(F.col("n")).alias("only_refreshed"), over(-F.col("n")).alias("only_rebuilt")).withColumn("cut", F.lit(done.cut).cast("bigint"))


@query("index_digest", """
SELECT doc_id, sha256(text || chr(10) || '{"a":"' || lang || '","b":"2"}' || chr(10) || '{}') AS digest FROM documents""")
def _(t):
    notes = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.col("lang"))
    return t.documents.select("doc_id", S.index_digest(F.col("text"), notes, F.lit(None).cast("map<string,string>")).alias("digest"))


@query("passage_labels", "SELECT doc_id, md5(CASE WHEN length(lang) > 0 AND doc_id % 2 = 0 THEN lang || chr(10) || text ELSE text END) AS l FROM documents")
def _(t):
    head = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return t.documents.select("doc_id", F.md5(S.label_passage(head, F.col("text"))).alias("l"))


@query("figures_in_text", """
SELECT doc_id, md5('before' || chr(10) || '[Figure: cost $' || doc_id || ' \\ ' || lang || ']' || chr(10) || lang || chr(10) || chr(10) || 'after') AS body FROM documents""")
def _(t):
    raw = F.concat(
        F.lit("before\n![x](picture:0123456789abcdef.webp)\n"), "lang", F.lit("\n\n![y](picture:ffff.webp)\n\n\nafter")
    )
    notes = F.create_map(
        F.lit("0123456789abcdef.webp"), F.concat(F.lit("cost $"), F.col("doc_id").cast("string"), F.lit(" \\ "), F.col("lang"))
    )
    return t.documents.select("doc_id", F.md5(C.with_figures(raw, notes)).alias("body"))


@query("embedding_of_words")
def _(t):
    return t.conversations.select("conv_id", "turn", F.md5(R.encode(R.hashed_words(F.col("text")))).alias("vector"))
