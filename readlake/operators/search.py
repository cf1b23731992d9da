"""Accent-blind search over documents, highlights, notes, results and notebooks.

Every kind is one plan: filter, score, top page. The page is a `TakeOrderedAndProject`, so each task ships at
most one page of rows; snippets are cut only for those. For a lake that is searched often, `token_index`
writes an inverted index whose buckets follow the token's first letters, so a query reads only its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.functions import text as X
from readlake.session import pinned

PAGE_SIZE = 10
MAX_PAGE = 100
KINDS = ("document", "highlight", "note", "summary", "notebook")


def match(column: Column, q: str) -> Column:
    terms = X.query_terms(q)
    return X.let(X.fold(column), lambda f: X.match_folded(f, terms))


def contains_all(column: Column, q: str) -> Column:
    """Looser: every folded word of the query is somewhere in the text; an empty query fits all."""
    words = X.fold_text(q).split()

    def test(folded: Column) -> Column:
        out = F.lit(True)
        for word in words:
            out = out & F.contains(folded, F.lit(word))
        return out

    return X.let(X.fold(column), test)


def hits(df: DataFrame, q: str, body: str, title: str | None = None) -> DataFrame:
    """The matching rows with their score; a title's words count double. Each text is folded once: the score comes out of the
    same expression as the test, as a generator that gives a row for a match and none otherwise, which is never repeated."""
    terms = X.query_terms(q)

    def told(folded: Column, head: Column | None) -> Column:
        test, score = X.match_folded(folded, terms), X.rank_folded(folded, terms)
        if head is not None:
            test, score = X.match_folded(head, terms) | test, X.rank_folded(head, terms) * 2 + score
        return F.when(test, F.array(F.round(score, 6)))

    folded = X.fold(F.col(body))
    if title:
        found = X.let(X.fold(F.col(title)), lambda head: X.let(folded, lambda f: told(f, head)))
    else:
        found = X.let(folded, lambda f: told(f, None))
    return df.select("*", F.explode(found).alias("score"))


def page_of(found: DataFrame, page: int, newest: str, key: str, size: int = PAGE_SIZE) -> DataFrame:
    """One page, best first, then newest, then by key."""
    if not 1 <= page <= MAX_PAGE:
        raise ValueError("page out of range")
    order = [F.col("score").desc(), F.col(newest).desc(), F.col(key)]
    return found.orderBy(*order).offset((page - 1) * size).limit(size)


def search(df: DataFrame, q: str, body: str, key: str, newest: str, page: int = 1, title: str | None = None) -> DataFrame:
    """One kind's page with snippets and the number of all matches on every row. The texts are tested and scored in one pass that
    writes keys and scores; the count and the page come from those, and only the page's texts are cut."""
    narrow = dict.fromkeys([key, newest, "score"])
    found = pinned(hits(df, q, body, title).select(*narrow), "hits")
    total = found.agg(F.count(F.lit(1))).scalar()
    shown = page_of(found, page, newest, key).select(key, "score")
    snippet = X.snippet(F.col(body), X.fold(F.col(body)), X.query_terms(q))
    return df.join(shown, key).withColumn("snippet", snippet).withColumn("total", total)


def notebook_snippet(snippet: Column) -> Column:
    """Notebook snippets show plain words: Markdown marks and reference numbers go."""
    return F.regexp_replace(snippet, r"[#*_`|>]+|\[[0-9]{1,3}\]", "")


def two_lists(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two kinds shown as one group: each pages on its own, the totals add up."""
    both = first.withColumn("part", F.lit(1)).unionByName(second.withColumn("part", F.lit(2)), allowMissingColumns=True)
    totals = both.groupBy("part").agg(F.max("total").alias("t")).agg(F.sum("t"))
    return both.withColumn("all_total", totals.scalar())


def headline(found: DataFrame, key: str, body: str, q: str, max_words: int = 32) -> DataFrame:
    """(key, headline): the run of at most `max_words` words that opens with a hit and holds the most different
    terms, the first such run. Words become rows; the runs are one sliding frame per text."""
    from pyspark.sql.window import Window as W

    terms = X.query_terms(q)
    last = len(terms) - 1
    words = found.select(key, F.posexplode(F.split(X.fold(X.collapse(F.col(body))), " ")).alias("at", "folded"))
    some = F.lit(False)
    for t in terms:
        some = some | F.contains("folded", F.lit(t))
    flags = [F.rlike("folded", F.lit(X.term_pattern(t, n == last))).cast("int").alias(f"h{n}") for n, t in enumerate(terms)]
    flagged = words.filter(some).select(key, "at", *flags)
    here = sum((F.col(f"h{n}") for n in range(1, last + 1)), F.col("h0"))
    flagged = flagged.filter(here > 0)  # only hits open or add to a run, so the frame ranges over positions
    ahead = W.partitionBy(key).orderBy("at").rangeBetween(0, max_words - 1)
    in_run = sum((F.max(f"h{n}").over(ahead) for n in range(1, last + 1)), F.max("h0").over(ahead))
    runs = flagged.withColumn("n", in_run)
    best = runs.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "at"))["at"].alias("at"))
    best = found.select(key, body).join(best, key)
    run = F.slice(F.split(X.collapse(F.col(body)), " "), F.col("at") + 1, F.lit(max_words))
    pattern = "(" + "|".join(X.accent_blind(t) for t in terms) + ")"
    marked = F.regexp_replace(F.array_join(run, " "), pattern, f"{X.MARK_START}$1{X.MARK_END}")
    return best.select(key, marked.alias("headline"))


def token_index(df: DataFrame, key: str, body: str) -> DataFrame:
    """(bucket, token, key, tf): the inverted index of a text column. A word's occurrences within one text are
    counted before the rows leave the task, so a frequent word shuffles once per document, not per use."""
    bag = df.select(key, F.explode(X.tokens(F.col(body))).alias("token"))
    return bag.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf")).withColumn("bucket", F.substring("token", 1, 2))


def write_index(index: DataFrame, path: str) -> None:
    """One folder per bucket, so a query prunes to the first letters of its terms. Rows are spread inside a
    bucket by token and key: a very common word does not become one file."""
    spread = index.repartition("bucket", F.pmod(F.xxhash64("token", index.columns[0]), F.lit(64)))
    spread.write.mode("overwrite").partitionBy("bucket").parquet(path)


def from_index(index: DataFrame, q: str, key: str) -> DataFrame:
    """Keys matching every term with their score, read from the index."""
    terms = X.query_terms(q)
    test = F.lit(False)
    for n, t in enumerate(terms):
        last = n == len(terms) - 1
        hit = F.startswith("token", F.lit(t)) if last else F.col("token") == t
        if len(t) >= 2 or not last:
            hit = (F.col("bucket") == t[:2]) & hit
        test = test | hit
    marks = []
    for n, t in enumerate(terms):
        hit = F.startswith("token", F.lit(t)) if n == len(terms) - 1 else F.col("token") == t
        marks.append(F.sum(F.when(hit, F.col("tf"))).alias(f"tf{n}"))
    per_key = index.filter(test).groupBy(key).agg(*marks)
    score = F.lit(0.0)
    for n in range(len(terms)):
        per_key = per_key.filter(F.col(f"tf{n}").isNotNull())
        score = score + F.log1p(F.col(f"tf{n}"))
    return per_key.select(key, F.round(score, 6).alias("score"))


def palette(documents: DataFrame, highlights: DataFrame, q: str) -> DataFrame:
    """The quick-jump list: the newest documents by title and origin, then highlights by text and note."""
    needle = X.fold_text(q.strip())
    docs = documents.withColumn("label", F.col("title"))
    if needle:
        docs = docs.filter(F.contains(X.fold(F.concat_ws(" ", "title", "origin")), F.lit(needle)))
    docs = docs.orderBy(F.col("created_at").desc(), "document_id").limit(8 if needle else 5)
    first = docs.select(F.lit("document").alias("kind"), F.col("document_id").cast("string").alias("id"), "label")
    if not needle:
        return first
    marked = highlights.filter(F.contains(X.fold(F.concat_ws(" ", "selected_text", "note")), F.lit(needle)))
    marked = marked.orderBy(F.col("created_at").desc(), "highlight_id").limit(6)
    return first.unionByName(
        marked.select(F.lit("highlight").alias("kind"), F.col("highlight_id").alias("id"), F.col("selected_text").alias("label"))
    )


def match_counts(documents: DataFrame, highlights: DataFrame, notes: DataFrame, q: str) -> DataFrame:
    """Documents a search finds with the matches inside: a title match alone counts 0."""
    terms = X.query_terms(q)
    fits = lambda c: X.let(X.fold(F.col(c)), lambda f: X.match_folded(f, terms))
    titles = documents.filter(fits("title")).select("document_id", F.lit(0).cast("bigint").alias("n"))
    marked = highlights.filter(fits("selected_text") | fits("note")).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    noted = notes.filter(fits("body")).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return titles.unionByName(marked).unionByName(noted).groupBy("document_id").agg(F.sum("n").alias("matches"))


def result_pages(found: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """Number of results and of pages."""
    return found.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint").alias("pages")
    )
