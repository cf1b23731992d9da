"""Finding the passages a question or a selection is about, and the citations an answer rests on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from readlake.functions import text as X
from readlake.operators.ranking import newest_per_key

CLOSEST, RADIUS, HITS, NEEDLE = 8, 1, 2, 80
CITATION_CHARS = 600


def encode(vector: Column) -> Column:
    """A vector as JSON with six decimals."""
    return F.to_json(F.transform(vector, lambda v: F.round(v.cast("double"), 6)))


def decode(text: Column) -> Column:
    """The vector; an empty one when the text is none."""
    return F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for an empty vector, a zero one, or two of different size."""
    length = (norm_a if norm_a is not None else norm(a)) * (norm_b if norm_b is not None else norm(b))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0)
    return F.when(fits, dot(a, b) / length).otherwise(0.0)


def hashed_words(text: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedding: words hashed into buckets, scaled to length one."""
    words = X.tokens(text)
    bucket = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(bucket, lambda b: b == i)).cast("double"))
    return X.let(each, lambda v: X.let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def closest(passages: DataFrame, questions: DataFrame, document: str, k: int = CLOSEST) -> DataFrame:
    """The k passages of each question's document nearest to it, ties by position.

    Lengths are computed once per vector, not per pair. The rank is limited in each task before the shuffle,
    so a document holding a third of the passages still sends only k rows per task and question.
    """
    p = passages.select(document, "position", F.col("embedding").alias("_v"), norm(F.col("embedding")).alias("_nv"))
    q = questions.select(document, "question_id", F.col("embedding").alias("_q"), norm(F.col("embedding")).alias("_nq"))
    score = F.round(cosine(F.col("_v"), F.col("_q"), F.col("_nv"), F.col("_nq")), 6)
    scored = p.join(q, document).select(document, "question_id", "position", score.alias("score"))
    best = newest_per_key(scored, ["question_id"], [F.col("score").desc(), F.col("position")], k)
    return best


def closest_of_many(passages: DataFrame, questions: DataFrame, document: str, k: int = CLOSEST, tile: int = 2048, block: int = 256) -> DataFrame:
    """As `closest`, for questions that grow with the passages: blocks of a document's questions meet tiles of its passages, and a
    meeting gives k rows a question, so no row stands for a pair. Blocks and tiles are copied for their meetings where they lie and
    meet by document, block and tile: a document that holds most of the passages is many tasks' work."""

    def packed(rows: DataFrame, name: str, many: int) -> tuple[DataFrame, DataFrame]:
        held = rows.filter(F.col(document).isNotNull()).select(document, name, "embedding")
        parts = held.groupBy(document).agg(F.ceil(F.count(F.lit(1)) / many).cast("int").alias(f"_{name}_parts"))
        dealt = held.join(parts, document).withColumn(f"_{name}", F.pmod(F.xxhash64(name), F.col(f"_{name}_parts")).cast("int"))
        return dealt.groupBy(document, f"_{name}").agg(F.collect_list(F.struct(F.col(name).alias("id"), F.col("embedding").alias("v"))).alias(name)), parts

    def vectors(rows: pa.ListScalar) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """The ids; and for each size of vector the places that have it and their vectors, scaled to length one (of length zero: zeros)."""
        ids, held = rows.values.field("id").to_numpy(zero_copy_only=False), rows.values.field("v")
        sizes = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        by_size = {}
        for size in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == size)
            v = held.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), size)
            length = np.sqrt(np.einsum("ij,ij->i", v, v))
            by_size[int(size)] = at, np.divide(v, length[:, None], out=np.zeros_like(v), where=length[:, None] > 0)
        return ids, by_size

    def best(score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Question, place and score of the k best of each row. Scores count to six decimals, so those just under the k-th are asked too."""
        if score.shape[1] > k:
            least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            row, at = np.nonzero(score >= least[:, None] - 2e-6)
        else:
            row, at = (x.ravel() for x in np.indices(score.shape))
        shown = np.round(score[row, at], 6)
        order = np.lexsort((ids[at], -shown, row))
        row, at, shown = row[order], at[order], shown[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[kept], at[kept], shown[kept]

    def run(batches):
        for batch in batches:
            for of, asked, held in zip(batch[document], batch["question_id"], batch["position"], strict=True):
                (q_ids, q), (p_ids, p) = vectors(asked), vectors(held)
                step = max(1, (1 << 21) // len(p_ids))  # 16 MB of scores at once
                for start in range(0, len(q_ids), step):
                    some = q_ids[start : start + step]
                    score = np.zeros((len(some), len(p_ids)))
                    for size in q.keys() & p.keys():  # vectors of two sizes have score 0
                        (q_at, q_v), (p_at, p_v) = q[size], p[size]
                        mine = (q_at >= start) & (q_at < start + step)
                        if len(q_at) == len(q_ids) and len(p_at) == len(p_ids):
                            np.matmul(q_v[mine], p_v.T, out=score)
                        else:
                            score[np.ix_(q_at[mine] - start, p_at)] = q_v[mine] @ p_v.T
                    row, at, shown = best(score, p_ids)
                    cols = [pa.array([of.as_py()] * len(row), type=kind), pa.array(some[row]), pa.array(p_ids[at]), pa.array(shown)]
                    yield pa.RecordBatch.from_arrays(cols, names=[document, "question_id", "position", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    shape = passages.schema[document].dataType
    kind = to_arrow_type(shape)
    asked, blocks = packed(questions.withColumn("question_id", F.col("question_id").cast("long")), "question_id", block)
    held, tiles = packed(passages.withColumn("position", F.col("position").cast("long")), "position", tile)
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(f"_{name}_parts") - 1)).alias(f"_{name}")
    asked = asked.join(tiles, document).select(document, "_question_id", "question_id", each("position"))
    held = held.join(blocks, document).select(document, "_position", "position", each("question_id"))
    pairs = held.join(asked.hint("shuffle_merge"), [document, "_question_id", "_position"]).select(document, "question_id", "position")
    scored = pairs.mapInArrow(run, f"`{document}` {shape.simpleString()}, question_id long, position long, score double")
    return newest_per_key(scored, ["question_id"], [F.col("score").desc(), F.col("position")], k)


def needle(quote: Column) -> Column:
    """The start of a selection as it reads on screen, cut at a word's end."""
    words = X.screen_words(quote)
    cut = F.substring(words, 1, NEEDLE)
    head = F.regexp_replace(cut, " [^ ]*$", "")
    return F.nullif(F.when(F.length(words) > NEEDLE, head).otherwise(words), F.lit(""))


def around_quote(passages: DataFrame, quotes: DataFrame, document: str, radius: int = RADIUS) -> DataFrame:
    """Passages holding the start of each quote, the first two of them, with their neighbours.

    The join is on the document; a hit is at most two rows per quote before its neighbours are looked up.
    """
    wanted = quotes.select(document, "quote_id", needle(F.col("quote")).alias("_needle")).filter("_needle IS NOT NULL")
    read = passages.select(document, "position", X.screen_words(F.col("text")).alias("_read"))
    hits = read.join(wanted, document).filter(F.contains("_read", F.col("_needle"))).select(document, "quote_id", "position")
    first = newest_per_key(hits, ["quote_id"], [F.col("position")], HITS)
    near = first.select(
        document, "quote_id", F.explode(F.sequence(F.col("position") - radius, F.col("position") + radius)).alias("position")
    ).distinct()
    return near.join(passages.select(document, "position"), [document, "position"])


def merge_passages(first: DataFrame, rest: DataFrame, limit: int = CLOSEST) -> DataFrame:
    """All of `first`, then the best of `rest` up to the limit, each position once."""
    a = first.select("question_id", "position", F.lit(0).alias("_tier"), F.lit(0.0).alias("score"))
    b = rest.select("question_id", "position", F.lit(1).alias("_tier"), "score")
    once = a.unionByName(b).groupBy("question_id", "position").agg(F.min("_tier").alias("_tier"), F.max("score").alias("score"))
    order = W.partitionBy("question_id").orderBy("_tier", F.col("score").desc(), "position")
    ranked = once.withColumn("_rank", F.row_number().over(order))
    kept = ranked.filter((F.col("_rank") <= limit) | (F.col("_tier") == 0))
    return kept.select("question_id", "position")


def prompt_passages(shown: DataFrame, question: str = "question_id") -> DataFrame:
    """The numbered passages of each prompt, one text per question. `shown` holds at most k rows a question."""
    order = W.partitionBy(question).orderBy("position")
    rows = shown.withColumn("n", F.row_number().over(order))
    page = F.concat(F.lit("page "), F.col("page_number").cast("string"))
    where = F.concat_ws(", ", page, F.nullif(F.col("heading"), F.lit("")))
    head = F.concat(
        F.lit("["), F.col("n").cast("string"), F.lit("]"),
        F.when(where != "", F.concat(F.lit(" ("), where, F.lit(")"))).otherwise(""),
    )
    lines = rows.withColumn("_line", F.concat(head, F.lit("\n"), F.col("text"), F.lit("\n")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "_line"))), lambda s: s["_line"]), "\n")
    return lines.groupBy(question).agg(F.concat(F.lit("<passages>\n"), body, F.lit("\n</passages>")).alias("context"))


def kept_citations(shown: DataFrame, answers: DataFrame, question: str = "question_id") -> DataFrame:
    """The numbered passages an answer uses, cut to what is stored."""
    used = answers.select(question, X.cited(F.col("answer")).alias("_used"))
    return (
        shown.join(used, question)
        .filter(F.array_contains("_used", F.col("n")))
        .select(question, "n", F.substring("text", 1, CITATION_CHARS).alias("text"))
    )


def renumber(uses: DataFrame, result: str = "result_id") -> DataFrame:
    """(result, n, number): cited passages numbered by first use. `uses` has ord, the use's place."""
    first = uses.groupBy(result, "n").agg(F.min("ord").alias("_first"))
    return first.select(
        result, "n", F.row_number().over(W.partitionBy(result).orderBy("_first", "n")).alias("number")
    )
