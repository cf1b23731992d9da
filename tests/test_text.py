"""Scalar text rules on hand-made strings, in several languages."""

import random

import pytest
from pyspark.sql import functions as F

from readlake.functions import python_udfs as P
from readlake.functions import scalars as S
from readlake.functions import text as X
from readlake.functions import urls as U

WORDS = ["Phương pháp", "ĐƯỜNG đi", "Straße", "ΛΌΓΟΣ λόγος", "e\u0301te\u0301", "naïve co\u00adop", "emoji 😀 ok", "a-b\u2010c"]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_native_folds_equal_exact_ones(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    for row in df.select("w", X.fold(F.col("w")).alias("f"), P.fold_exact("w").alias("e"), X.squash(F.col("w")).alias("s"), P.squash_exact("w").alias("x")).collect():
        assert row.f == row.e
        assert row.s == row.x


def fnv(text):
    h = 0x811C9DC5
    data = text.encode("utf-16-le")
    for low, high in zip(data[::2], data[1::2], strict=True):
        h = (h ^ (low + 256 * high)) * 0x01000193 % 2**32
    return f"{h:08x}"


def test_block_name_hash(spark):
    for text in ["", "a", "héllo 😀", "Đường"]:
        assert one(spark, X.fnv1a(F.lit(text))) == fnv(text)


def test_block_name_hash_of_many(spark):
    """Texts of all lengths in one batch, some null; no interpreted fold over their letters."""
    rng = random.Random(4)
    texts = [None if n % 7 == 3 else "".join(rng.choice("aé😀đ\n ") for _ in range(rng.choice((0, 1, 5, 60, 900)))) for n in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(1).select("n", "t", X.fnv1a(F.col("t")).alias("h"))
    assert all(r.h == (None if r.t is None else fnv(r.t)) for r in df.collect())
    assert "lambda" not in df._jdf.queryExecution().executedPlan().toString()


def test_snippet_marks_accented_terms(spark):
    text = "x" * 100 + " Phương pháp học " + "y" * 300
    got = one(spark, X.snippet(F.lit(text), X.fold(F.lit(text)), X.query_terms("phuong phap")))
    assert got.startswith("…") and got.endswith("…")
    assert "\x02Phương\x03 \x02pháp\x03 học" in got


@pytest.mark.parametrize("bad", ["", " a ", "!!", "   "])
def test_short_or_wordless_queries_are_refused(bad):
    with pytest.raises(ValueError):
        X.normalize_query(bad)


def runs(pages, most=6):
    out = []
    for p in sorted(set(pages)):
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    said = ", ".join(str(a) if a == z else f"{a}–{z}" for a, z in out[:most])
    return said + (", …" if len(out) > most else "")


def test_page_runs_match_a_plain_version(spark):
    rng = random.Random(3)
    rows = [([rng.randint(1, 30) for _ in range(rng.randint(1, 20))],) for _ in range(60)]
    df = spark.createDataFrame(rows, "p array<int>")
    for row in df.select("p", S.page_runs(F.col("p")).alias("r")).collect():
        assert row.r == runs(row.p)


def test_costs(spark):
    cost = lambda m, p, c, o, w: one(spark, S.call_cost(F.lit(m), F.lit(p), F.lit(c), F.lit(o), F.lit(w)))
    assert cost("gpt-4.1", 1_000_000, 0, 0, 0) == pytest.approx(2.0)
    assert cost("gpt-4.1-2025-04-14", 1000, 5000, 0, 0) == pytest.approx(1000 * 0.5 / 1e6)  # cached counts at most the prompt
    assert cost("nobody", 10, 0, 0, 0) is None
    assert cost("nobody", 0, 0, 0, 0) == 0
    assert cost("gpt-4o", 0, 0, 0, 2) == pytest.approx(0.02)


def test_safe_names(spark):
    name = lambda s: one(spark, S.safe_name(F.lit(s)))
    assert name("C:\\a\\b: c?.pdf") == "b_ c_.pdf"
    assert name(" .. ") == "document"
    assert len(name("x" * 300 + ".pdf")) == 200 and name("x" * 300 + ".pdf").endswith(".pdf")


def test_public_addresses(spark):
    df = spark.createDataFrame([("8.8.8.8", True), ("127.0.0.1", False), ("::ffff:10.0.0.1", False), ("169.254.1.1", False), ("2606:4700::1111", True), ("x", None)], "a string, want boolean")
    for row in df.select("want", U.is_public_ip("a").alias("got")).collect():
        assert row.got == row.want


def test_sentences(spark):
    from readlake.operators.anchors import sentence_around

    around = lambda p, w: one(spark, sentence_around(F.lit(p), F.lit(w)))
    text = "First one. Then chapter two begins here! Last."
    assert around(text, "chapter two") == "Then chapter two begins here!"
    assert around(text, "nowhere") == ""
    assert around("chapter two.", "chapter two") == ""
    assert around(text, "a b c d e f g h") == ""


def test_plain_words_pairs(spark):
    """What a reader sees of each source line."""
    pairs = [
        ("# Title *here*", "Title here"), ("> said **so**", "said so"), ("- an `entry`", "an entry"), ("12. third", "third"), ("see [the page](http://x.y/z) now", "see the page now"),
        ("![alt text](a.webp)", ""), ("a ![x](u) b [c](d)", "a  b c"), ("not [a link] (at all)", "not [a link] (at all)"), ("![open", "![open"), ("2 * 3 * 4", "2 * 3 * 4"), ("a*b*c", "a*b*c"),
        ("*one* and *two words*", "one and two words"), ("\\*kept\\* \\_too\\_", "kept _too_"), ("| a | b |", "  a   b  "), ("|---|:-:|", ""), ("cut<br/>here", "cuthere"), ("soft­hyphen⁣", "softhyphen"),
        ("__strong__ word", "strong word"), ("", ""), ("#tag", "#tag"), ("    # code", "    # code"),
    ]
    frame = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(pairs)], "i int, raw string")
    got = {r.i: r.words for r in frame.select("i", X.plain(F.col("raw")).alias("words")).collect()}
    assert {i: got[i] for i in got} == {i: want for i, (_, want) in enumerate(pairs)}


def test_paragraphs_that_open_with_their_part(spark):
    from readlake.operators import roles

    said = {"Funding: by a grant.": "FUNDING", "**Conflicts of interest.** None.": "CONFLICT_OF_INTEREST", "Data availability — on request": "DATA_AVAILABILITY", "Acknowledgments: we thank": "ACKNOWLEDGEMENTS", "Funding was hard to find.": None, "We saw: things": None}
    frame = spark.createDataFrame([(k,) for k in said], "t string")
    assert {r.t: r.p for r in frame.select("t", roles.opening_part(F.col("t")).alias("p")).collect()} == said


def test_markdown_helpers():
    from readlake.sources import html as H

    assert H._pictures_apart("a ![x](u) b ![y] c ![](z)d") == ["a ", "![x](u)", " b ![", "y] c ", "![](z)", "d"]
    assert [H._is_entry(x) for x in ("  - x", "  12. x", "  -x", "- x", "  x. y")] == [True, True, False, False, False]
    assert H._without_leaders("Title . . . . . . . 12") == "Title  … 12" and H._without_leaders("a.b ... c") == "a.b ... c"
