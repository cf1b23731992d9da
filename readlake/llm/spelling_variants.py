"""Spelling variants: words one edit apart, found by PartEnum signatures over multisets of letters.

A word's letters make a binary vector with a dimension for every (letter, k): one if the word has that letter k times or more.
One replaced code point changes two dimensions at most, of two letters; one inserted or deleted changes one. The letters are dealt
into parts; a word signs every choice of all parts but two (for words of its own length) and of all parts but one (for words one
longer or shorter) with the letters it has there. Words that are near agree on one choice at least, so an equi-join of signatures
finds all near pairs; each pair met is verified by its edit distance inside the join.

Counts are summed in the tasks before they are shuffled. A signature's bucket holds words of one length, or of two neighbouring
ones, that share the letters of all parts but one or two.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm.words import column, tables
from readlake.session import pinned

#: After A-Z are lowered.
RUN = re.compile("[a-zÀ-ÿ]+")
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
#: Words a task counts before it passes the counts on.
HELD = 400_000


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 31, least_length: int = 7) -> DataFrame:
    """(word, n): how often each word stands in the whole texts, A-Z lowered; null texts have none.

    Runs are garbled as a test of the search for variants: with h the crc32 of `<doc_id>:<run>`, a run whose h is divisible by `every` loses
    its code point h % length (0: none is garbled). A null doc_id counts as the empty text there. Results shorter than
    `least_length` code points are not counted."""

    def run(batches):
        held: Counter = Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), type=pa.string()), pa.array(list(held.values()), type=pa.int64())], names=["word", "n"])

        for table in tables(batches):
            for i, t in zip(column(table, "id").to_pylist(), column(table, "text"), strict=True):
                start = zlib.crc32(f"{i or ''}:".encode())
                for word, n in Counter(RUN.findall((t.as_py() or "").encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if every and h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield passed()
                    held.clear()
        if held:
            yield passed()

    each = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def projected(words: DataFrame, parts: dict[str, int]) -> DataFrame:
    """`words` with, for each name of `parts` and each of its parts k, a column <name><k>: the word's letters that fall into the part, in order.
    Letters outside `LETTERS` fall into none."""
    known = F.regexp_replace("word", f"[^{LETTERS}]+", "")
    rows = words.select("word", F.length("word").alias("size"), F.array_join(F.array_sort(F.split(known, "")), "").alias("_letters"))
    # A step of its own, so that a projection is worked out once for all signatures that take it.
    every = [F.translate("_letters", "".join(x for i, x in enumerate(LETTERS) if i % n != k), "").alias(f"{name}{k}") for name, n in parts.items() for k in range(n)]
    return rows.select("word", "size", *every)


def signatures(name: str, size: Column, parts: int, left_out: int) -> list[Column]:
    """One signature for every choice of all parts but `left_out`, of words of `size` code points."""
    return [F.xxhash64(F.lit(left_out), F.lit(k), size, *[F.col(f"{name}{p}") for p in kept]) for k, kept in enumerate(combinations(range(parts), parts - left_out))]


def near_pairs(words: DataFrame, parts_replaced: int = 6, parts_moved: int = 5) -> DataFrame:
    """(a, b): every pair of `words` (column `word`, distinct) that differ by exactly one inserted, deleted or replaced code point,
    once. Letters outside `LETTERS` count for no part, which costs selectivity but no pair."""
    spark = words.sparkSession
    wide = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = projected(words.repartition(wide, "word"), {"_r": parts_replaced, "_m": parts_moved})  # much work on short rows
    own = signatures("_r", F.col("size"), parts_replaced, 2)
    longer = signatures("_m", F.col("size"), parts_moved, 1)
    shorter = signatures("_m", F.col("size") + 1, parts_moved, 1)
    signed = rows.select("word", F.explode(F.array(*own, *longer, *shorter)).alias("signature"))
    a, b = signed.alias("a"), signed.alias("b")
    la, lb = F.length("a.word"), F.length("b.word")
    order = ((la == lb) & (F.col("a.word") < F.col("b.word"))) | (la == lb + 1)
    near = F.levenshtein("a.word", "b.word", 1) == 1
    met = a.join(b, (F.col("a.signature") == F.col("b.signature")) & order & near)
    return met.select(F.col("a.word").alias("a"), F.col("b.word").alias("b")).distinct()


def roots(forms: DataFrame, most_rounds: int = 8) -> DataFrame:
    """(word, root): where following `form` from each word ends. Every step multiplies the count, so chains are short; each round
    doubles the steps taken."""
    now = pinned(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    for _ in range(most_rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        step = now.select("word", "root").join(ahead, "root", "left")
        now = pinned(step.select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
    raise RuntimeError("chains of forms did not end")


def variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 31, least_length: int = 7, least: int = 2, times: int = 10
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of `least_length` code points and `least` occurrences or more.

    n_near counts the near words; form is the one of them that stands most often (ties: the smallest in code-point order), if it
    stands `times` as often as the word at least, else null, as is form_n; root is where the forms end, the word itself if it has
    none. No texts: no rows."""
    if times < 2:
        raise ValueError("a form stands twice as often at least, or forms could go round")
    words = pinned(occurrences(docs, doc_id, text, every, least_length).filter(F.col("n") >= least), "words")
    pairs = pinned(near_pairs(words.select("word")), "near_words")
    near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = near.join(words.withColumnRenamed("word", "b").withColumnRenamed("n", "their_n"), "b")
    best = counted.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("their_n")).alias("minus"), "b")).alias("best"))
    told = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    is_form = -F.col("best.minus") >= times * F.col("n")
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.b")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"))
    told = pinned(told, "forms")
    ends = roots(told.filter("form is not null").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
