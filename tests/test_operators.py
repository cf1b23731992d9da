"""Operators on small hand-made inputs: against plain versions, or known answers."""

import io
import random
import re
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from readlake.operators import anchors as A
from readlake.operators import artifacts as R
from readlake.operators import blocks as B
from readlake.operators import chunks as C
from readlake.operators import geom as G
from readlake.operators import highlights as H
from readlake.operators import layout as L
from readlake.operators import merge as M
from readlake.operators import roles
from readlake.operators import search
from readlake.operators import tree as T
from readlake.operators import web
from readlake.operators.ranking import numbered, with_previous
from readlake.streaming import decisions, jobs


def plain_passages(text, budget, count=None):
    """The same rule, written as a walk over paragraphs."""
    limit, found, head = budget * 3, [], None
    pages = [p for p in text.split("\n\n---\n\n") if p.strip()]
    for number, page in enumerate(pages, 1):
        held, size, under = [], 0, head
        at = number if count == len(pages) else None
        for para in (p.strip() for p in re.split(r"\n{2,}", page)):
            if not para or para == "---":
                continue
            m = re.match(r"^#{1,6}\s+(.+?)\s*#*\s*$", para)
            if m or size + len(para) > limit:
                if held:
                    found.append([at, under, "\n\n".join(held)])
                held, size, head = [], 0, (m.group(1) if m else head)
                under = head
            while len(para) > limit:
                found.append([at, under, para[:limit]])
                para = para[limit:]
            if para:
                held.append(para)
                size += len(para) + 2
        if held:
            found.append([at, under, "\n\n".join(held)])
    out, carry = [], []
    for i, (at, under, body) in enumerate(found):
        carry.append(body)
        if sum(map(len, carry)) < 120 and i + 1 < len(found) and found[i + 1][0] == at:
            continue
        out.append((at, under, "\n\n".join(carry)))
        carry = []
    return out


def some_text(rng):
    parts = []
    for _ in range(rng.randint(1, 25)):
        kind = rng.random()
        if kind < 0.15:
            parts.append("#" * rng.randint(1, 3) + f" Part {rng.randint(1, 9)}")
        elif kind < 0.25:
            parts.append("---")
        else:
            parts.append("w" * rng.choice([3, 40, 90, 200, 299, 300, 301, 750]))
    return "\n\n".join(parts)


def test_passages_match_a_plain_version(spark):
    rng = random.Random(7)
    rows = [(i, some_text(rng)) for i in range(80)]
    rows = [(i, t, rng.choice([None, len([p for p in t.split("\n\n---\n\n") if p.strip()])])) for i, t in rows]
    got = {}
    for r in C.split(spark.createDataFrame(rows, "id int, t string, n int"), "id", "t", 100, "n").orderBy("id", "position").collect():
        got.setdefault(r.id, []).append((r.page_number, r.heading, r.text))
    for i, text, n in rows:
        assert got.get(i, []) == plain_passages(text, 100, n), i


def plain_parts(text, budget):
    limit, parts, held, size = budget * 3, [], [], 0
    for para in (p.strip() for p in re.split(r"\n{2,}", text)):
        if not para or para == "---":
            continue
        if held and ((para[0] == "#" and size >= limit // 2) or (size + len(para) > limit and len(para) <= limit)):
            parts.append("\n\n".join(held))
            held, size = [], 0
        while size + len(para) > limit:
            room = max(limit - size, 1)
            parts.append("\n\n".join([*held, para[:room]]))
            held, size, para = [], 0, para[room:]
        if para:
            held.append(para)
            size += len(para) + 2
    return parts + (["\n\n".join(held)] if held else [])


def test_parts_match_a_plain_version(spark):
    rng = random.Random(11)
    rows = [(i, some_text(rng)) for i in range(80)]
    got = {}
    for r in C.parts(spark.createDataFrame(rows, "id int, t string"), "id", "t", 100).orderBy("id", "part").collect():
        got.setdefault(r.id, []).append(r.text)
    for i, text in rows:
        assert got.get(i, []) == plain_parts(text, 100), i


def test_markdown_blocks(spark):
    text = "\n".join(
        ["# Title", "one", "two", "![p](https://a.example/p.png)", "", "![q](https://a.example/q.png)", "- a", "- b", "para", " | not a table", "| a | b |", "|---|---|",
         "> said", "> more", "```", "code", "", "- x", "```", "$$x=1$$", "last", "---", "end"]
    )
    rows = B.markdown_blocks(spark.createDataFrame([(1, text)], "d int, t string"), "d", "t").orderBy("ord").collect()
    assert [r.raw for r in rows] == [
        "# Title", "one two ![p](https://a.example/p.png)", "![q](https://a.example/q.png)", "- a\n- b", "para | not a table", "| a | b |\n|---|---|", "> said\nmore",
        "```code\n\n- x", "$$x=1$$", "last", "end",
    ]


def test_hot_keys_are_numbered_right(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else "cold", rng.randint(0, 500), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, at int, id int")
    got = {r.id: r.n for r in numbered(df, ["k"], F.floor(F.col("at") / 50), ["at", "id"]).collect()}
    for key in ("hot", "cold"):
        mine = sorted((at, i) for k, at, i in rows if k == key)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))
    prev = {r.id: r._prev_id for r in with_previous(df, ["k"], F.floor(F.col("at") / 50), ["at", "id"], ["id"]).collect()}
    mine = [i for _, i in sorted((at, i) for k, at, i in rows if k == "hot")]
    assert [prev[i] for i in mine] == [None, *mine[:-1]]


def test_previous_row_of_null_keys_and_falling_order(spark):
    rows = [(None, None, 1), (None, None, 2), (None, 60, 3), ("a", 10, 4), ("a", 70, 5), ("a", 20, 6)]
    df = spark.createDataFrame(rows, "k string, at int, id int")
    up = {r.id: r._prev_id for r in with_previous(df, ["k"], F.floor(F.col("at") / 50), ["at", "id"], ["id"]).collect()}
    assert up == {1: None, 2: 1, 3: 2, 4: None, 6: 4, 5: 6}
    order = [F.col("at").desc(), F.col("id").desc()]
    down = {r.id: r._prev_id for r in with_previous(df, ["k"], F.floor(F.col("at") / 50), order, ["id"], falling=True).collect()}
    assert down == {3: None, 2: 3, 1: 2, 5: None, 6: 5, 4: 6}


def test_inserts_keep_one_row_per_key(spark):
    now = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "y"), (2, "x"), (3, "z")], "k int, v string")
    got = sorted((r.k, r.v, r.existing) for r in M.insert_unless_exists(now, new, ["k"]).collect())
    assert got == [(1, "old", True), (2, "x", False), (3, "z", False)]
    assert (1, "old") in [tuple(r) for r in M.insert_ignore(now, new, ["k"]).collect()] and M.insert_ignore(now, new, ["k"]).count() == 3


def test_merges_by_all_links(spark):
    from readlake.operators import notebooks as N

    shape = "user_id int, document_id int, version string, start_at int, end_at int, highlight_id string, page_number int, color string, created_at int, notebook_id int, note string"
    rows = []
    for n, (a, b) in enumerate([("p", "q"), ("r", "s"), ("t", "u")]):
        rows += [(1, n, "v", 0, 5, a, None, "y", 1, None, "first"), (1, n, "v", 0, 5, b, 3, "y", 2, None, "second")]
    marks = spark.createDataFrame(rows, shape)
    links = spark.createDataFrame([("p", 1), ("p", 2), ("q", 2), ("r", 1), ("s", 2), ("s", 3), ("t", None), ("u", None)], "highlight_id string, notebook_id int")
    plan = N.merge_plan(marks, links)
    assert {r.kept: (r.merged, r.held) for r in plan.collect()} == {"p": (None, "shared_notebook"), "r": ("s", None), "t": ("u", None)}
    left, linked = N.merged_highlights(marks, links, plan)
    assert {r.highlight_id: r.note for r in left.collect()} == {"p": "first", "q": "second", "r": "first\n\nsecond", "t": "first\n\nsecond"}
    assert sorted((r.highlight_id, r.notebook_id or 0) for r in linked.collect()) == [("p", 1), ("p", 2), ("q", 2), ("r", 1), ("r", 2), ("r", 3), ("t", 0)]


def test_parents_rebuilt_to_nothing(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    fresh = spark.createDataFrame([(1, "n")], "k int, v string")
    got = M.replace_by_parent(now, fresh, "k", spark.createDataFrame([(1,), (2,)], "k int"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "n"), (3, "c")]


def test_word_vectors_have_length_one(spark):
    df = spark.createDataFrame([("one two two three four five",), ("",), (None,)], "t string")
    from readlake.operators import retrieval

    got = [r.v for r in df.select(retrieval.hashed_words(F.col("t")).alias("v")).collect()]
    assert len(got[0]) == 64 and abs(sum(x * x for x in got[0]) - 1) < 1e-12
    assert got[1] == [0.0] * 64


def test_all_points_of_a_series(spark):
    from readlake.operators import charts

    marks = spark.createDataFrame([("f", s, float(5 * i), float(i)) for s in range(14) for i in range(301)], "figure string, series int, px double, py double")
    axis = spark.createDataFrame([("f", "linear", 1.0, 0.0)], "figure string, scale string, a double, b double")
    assert charts.digitise(marks, axis, axis).count() == 14 * 301
    assert charts.digitise(marks, axis, axis, most_series=12).count() == 12 * 301


def test_language_of_a_whole_text(spark):
    df = spark.createDataFrame([("plain english words " * 2000 + "đượcđượcđược " * 4000,)], "t string")
    from readlake.functions import text as X

    assert df.select(X.detect_language(F.col("t"))).first()[0] == "vi"
    assert len(X.query_terms("a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12")) == 12


def test_readings_are_aligned(spark):
    """Runs hold in both texts, rise in both, never lap over, and cover what noise left; gaps are looked into again."""
    from difflib import SequenceMatcher

    from readlake.operators import alignment

    rng = random.Random(8)
    rows = []
    for n in (30, 120, 400, 900):
        for kind in range(4):
            a = "".join(rng.choice("abcdefgh ") for _ in range(n))
            b = list(a + a[: n // 3] if kind == 1 else a)
            for at in rng.sample(range(len(b)), n // 30):
                b[at] = {0: "#", 1: "#", 2: "", 3: b[at] + "xy"}[kind]
            rows.append((len(rows), a, "".join(b)))
    rows += [(97, "", "x"), (98, None, None), (99, "same", "same"), (100, "abc", "abc"), (101, "ab" * 40, "ab" * 41), (102, "xxxxabcdyyyy", "yyyyabcdxxxx")]
    frame = spark.createDataFrame(rows, "id int, a string, b string").repartition(3)
    found = {}
    for r in alignment.runs(frame, ["id"], "a", "b", A.MIN_RUN).collect():
        found.setdefault(r.id, []).append((r.at, r.to, r.size))
    for i, a, b in rows:
        runs = sorted(found.get(i, []))
        assert all(a[x : x + k] == b[y : y + k] and k >= A.MIN_RUN for x, y, k in runs)
        assert all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in zip(runs, runs[1:]))
        if i < 97:
            plain = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= A.MIN_RUN)
            assert sum(k for _, _, k in runs) >= 0.97 * plain
    assert found[99] == [(0, 0, 4)] and not {97, 98, 100} & found.keys() and [n for _, _, n in found[102]] == [4]


def test_selections_on_a_page(spark):
    """The place most covered wins; two covered alike are ambiguous; where no character lies under it, the only place in a block
    near by will do. More highlights than share a row are placed alike."""
    words = "abcdexabcdeyabcde"
    index = spark.createDataFrame([("d", words, ["p", "q"], [0, 11])], "doc string, words string, ids array<string>, starts array<int>")
    names = {"one": [0, 1, 2, 3, 4], "two": [0, 1, 2, 3, 6, 7, 8, 9], "few": [0, 1], "more": [0, 1, 2, 6, 7, 8, 9, 10]}
    marks = [("d", n, "abcde") for n in [*names, "near", "far", "none"]] + [("d", f"x{i}", "yab") for i in range(2500)] + [("d", "gone", "zzz"), ("other", "one", "abcde")]
    touched = spark.createDataFrame([("d", n, p) for n, ps in names.items() for p in ps] + [("d", f"x{i}", 11) for i in range(2500)] + [("d", f"x{i}", 12) for i in range(2500)], "doc string, highlight_id string, position int")
    near = spark.createDataFrame([("d", "near", "q"), ("d", "far", "p")], "doc string, highlight_id string, block_id string")
    got = A.on_page(spark.createDataFrame(marks, "doc string, highlight_id string, selected_text string"), index, touched, "doc", near).collect()
    told = {r.highlight_id: (r.state, r.range_start, r.range_end) for r in got if not r.highlight_id.startswith("x")}
    assert told == {
        "one": ("mapped", 0, 5), "two": ("ambiguous", None, None), "few": ("unresolved", None, None), "more": ("mapped", 6, 11), "near": ("mapped", 12, 17),
        "far": ("ambiguous", None, None), "none": ("unresolved", None, None), "gone": ("unresolved", None, None),
    }
    assert sum(r.highlight_id.startswith("x") and (r.state, r.range_start) == ("mapped", 11) for r in got) == 2500


def test_numbers_without_exponents(spark):
    from readlake.sources.export import csv_number

    values = [0.0004, -1.25e-7, 1.5e10, -2e8, 12.5, 0.0, 123456789.125, 1e21]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(csv_number(F.col("v"))).collect()]
    assert not any("E" in x for x in got) and [float(x) for x in got] == values


def test_overlaps_count_touching_apart_and_equal(spark):
    rows = [("a", 0, 10), ("b", 10, 20), ("c", 5, 12), ("d", 0, 10), ("e", 2, 4), ("f", 9000, 9500), ("g", 4000, 9100)]
    df = spark.createDataFrame([(1, 1, "v", i, s, e) for i, s, e in rows], "user_id int, document_id int, version string, highlight_id string, start_at int, end_at int")
    got = {r.highlight_id: (r.overlapping, r.same_passage) for r in H.overlaps(df).collect()}
    for i, s, e in rows:
        others = [(a, z) for j, a, z in rows if j != i]
        assert got[i] == (sum(a < e and s < z and (a, z) != (s, e) for a, z in others), others.count((s, e)))


def anchored(spark, lines, **h):
    blocks = spark.createDataFrame([(1, i, f"b{i}", t, p) for i, (t, p) in enumerate(lines)], "doc int, ord int, block_id string, text string, page int")
    from readlake.functions import text as X

    row = {"prefix": None, "suffix": None, "page_number": None, "block_id": None, "start_offset": None, **h}
    marks = spark.createDataFrame(
        [(1, "h", row["selected_text"], row["prefix"], row["suffix"], row["page_number"], row["block_id"], row["start_offset"])],
        "doc int, highlight_id string, selected_text string, prefix string, suffix string, page_number int, block_id string, start_offset int",
    )
    r = A.placed(marks, A.index(blocks.withColumn("words", X.squash(F.col("text"))), "doc"), "doc").first()
    return r.state, r.range_start


def test_anchor_rules(spark):
    lines = [("the cat sat on the mat", 1), ("a dog and a cat met", 2), ("nothing here", 2)]
    assert anchored(spark, lines, selected_text="a dog and a cat met there") == ("unresolved", None)
    assert anchored(spark, lines, selected_text="dog", page_number=2) == ("mapped", 18)
    assert anchored(spark, lines, selected_text="dog", page_number=1) == ("ambiguous", None)
    assert anchored(spark, lines, selected_text="cat") == ("ambiguous", None)
    assert anchored(spark, lines, selected_text="cat", page_number=1) == ("mapped", 3)
    assert anchored(spark, lines, selected_text="Cat", prefix="dog and a ")[0] == "mapped"
    assert anchored(spark, lines, selected_text="the", block_id="b0", start_offset=15) == ("mapped", 11)
    assert anchored(spark, lines, selected_text="cat", block_id="b1") == ("mapped", 17 + 8)


def page(spark, words):
    return spark.createDataFrame([("d", p, n, t) for p, texts in enumerate(words, 1) for n, t in enumerate(texts, 1)], "doc_id string, page int, n int, text string")


@pytest.mark.parametrize(
    ("pages", "want"),
    [
        ([["It goes"], ["on here. Done."], ["Next."]], [["It goes on here. Done."], ["Next."]]),
        ([["A. it goes"], ["on and"], ["on."]], [["A. it goes on and"], ["on."]]),
        ([["x goes"], ["a"], ["b"], ["c."]], [["x goes a"], ["b c."]]),
        ([["x goes"], ["a"], ["b"], ["c"], ["d."]], [["x goes a"], ["b c"], ["d."]]),
        ([["Done."], ["next"]], [["Done."], ["next"]]),
        ([["well-"], ["known is."]], [["well-\u2063known is."]]),
        ([["| a |"], ["on."]], [["| a |"], ["on."]]),
    ],
)
def test_paragraphs_carried_over(spark, pages, want):
    got = {}
    for r in L.carry_over(page(spark, pages)).orderBy("page", "n").collect():
        got.setdefault(r.page, []).append(r.text)
    assert list(got.values()) == want


def test_broken_words(spark):
    df = spark.createDataFrame([(1, "defi-\u2063nition of water-\u2063saturated; the definition")], "d int, t string")
    assert B.rejoin(df, "d", "t").first().t == "definition of water-saturated; the definition"


def test_broken_words_of_long_runs_of_letters(spark):
    """A run of letters is read once, not from each of its letters on."""
    began = time.monotonic()
    df = spark.createDataFrame([(1, "a" * 150_000 + " foo-\u2063bar-\u2063baz re-\u2063do Redo " + "b" * 150_000), (2, "no halves"), (3, None)], "d int, t string")
    rows = {r.d: r.t for r in B.rejoin(df, "d", "t").collect()}
    assert rows[1][150_000:-150_000] == " foo-bar-baz redo Redo " and rows[2] == "no halves" and rows[3] is None
    assert time.monotonic() - began < 20


def test_roles_of_a_paper(spark):
    texts = [
        ("Journal homepage: www.elsevier.com", 8.0), ("# A Study of Things", 20.0), ("Ann Lee, Bob Ray", 11.0), ("1 University of Somewhere", 9.0), ("Abstract", 11.0),
        ("We study things at length.", 10.0), ("## 1 Introduction", 13.0), ("Body text goes here.", 10.0), ("## 2 Results", 13.0), ("More body.", 10.0),
        ("We thank our funders for the grant.", 10.0), ("## References", 13.0), ("[1] Someone, 2001.", 10.0), ("## Appendix A", 13.0), ("Tables.", 10.0), ("-----", 10.0),
    ]
    rows = [("d", 1, n, 50.0, 40.0 + n * 40, 550.0, 60.0 + n * 40, t, "text", s, 800.0, None, 0.0, "") for n, (t, s) in enumerate(texts, 1)]
    items = spark.createDataFrame(
        rows,
        "doc_id string, page int, n int, x0 double, y0 double, x1 double, y1 double, text string, kind string, size double, page_height double, role string, confidence double, reason string",
    )
    sizes = spark.createDataFrame([("d", 10.0)], "doc_id string, body_size double")
    got = {r.n: r.role for r in roles.classify(items, sizes).collect()}
    assert [got[n] for n in range(1, 17)] == [
        "PUBLISHER_INFO", None, "AUTHORS", "AFFILIATIONS", None, None, None, None, None, None, "FUNDING", "REFERENCES", "REFERENCES", "APPENDIX", "APPENDIX", "DECORATION",
    ]


def test_tables_from_rules(spark):
    cells = [("A", 10, 40, 10), ("B", 100, 130, 10), ("1", 10, 20, 30), ("2|3", 100, 120, 30)]
    spans = spark.createDataFrame([("d", 1, t, float(x0), float(y), float(x1), y + 8.0) for t, x0, x1, y in cells], "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    rules = spark.createDataFrame([("d", 1, y, 0.0, 200.0) for y in (5.0, 25.0, 45.0)], "doc_id string, page int, y double, x0 double, x1 double")
    caption = spark.createDataFrame([("d", 1, 9, 50.0, -12.0, 150.0, -2.0)], "doc_id string, page int, ord int, x0 double, y0 double, x1 double, y1 double")
    found = L.tables(spans, L.ruled_tables(caption, rules)).first()
    assert found.markdown == "| A | B |\n|---|---|\n| 1 | 2\\|3 |"


def test_figures_and_clusters(spark):
    boxes = [(0, 0, 10, 10, 15, True), (15, 0, 60, 50, 10, False), (300, 300, 310, 305, 2, False)]
    drawings = spark.createDataFrame([("d", 1, *map(float, b[:4]), b[4], b[5]) for b in boxes], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, paths long, curvy boolean")
    found = L.clusters(drawings)
    assert sorted((r.paths, r.curvy) for r in found.collect()) == [(2, False), (25, True)]
    labels = spark.createDataFrame([("d", 1, "0.5", 62.0, 10.0, 70.0, 14.0, 6.0, False, 10.0)], "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double, size double, in_paragraph boolean, body_size double")
    figure = L.figures(found, labels).collect()
    assert [(f.x0, f.x1) for f in figure] == [(0.0, 70.0)]


def test_selection_rectangles(spark):
    df = spark.createDataFrame([([(0.1, 0.1, 0.2, 0.02), (0.31, 0.1, 0.2, 0.02), (0.1, 0.2, 0.1, 0.02), (0.9, 0.1, 0.05, 0.02), (0.0, 0.5, 0.0, 0.1)],)], "r array<struct<x:double,y:double,w:double,h:double>>")
    lines = df.select(G.merge_rects(F.col("r")).alias("l")).first().l
    assert [(round(r.x, 3), round(r.w, 3)) for r in lines] == [(0.1, 0.41), (0.9, 0.05), (0.1, 0.1)]


def test_place_on_the_page(spark):
    words = "abcdefgh"
    chars = spark.createDataFrame([(1, 1, i, c, 0.1 + i * 0.01, 0.1, 0.11 + i * 0.01, 0.12, i // 4) for i, c in enumerate(words)], "doc int, page int, ord int, c string, x0 double, y0 double, x1 double, y1 double, line int")
    boxes = spark.createDataFrame([(1, 1, "b", 0.05, 0.05, 0.3, 0.1)], "doc int, page int, block_id string, x double, y double, w double, h double")
    blocks = spark.createDataFrame([(1, "b", words + "zz", 0)], "doc int, block_id string, words string, ord int")
    lined = A.aligned(blocks, chars, boxes, "doc")
    assert lined.count() == 8
    spans = spark.createDataFrame([(1, "h", "b", 2, 6, 0), (1, "far", "b", 6, 10, 0)], "doc int, id string, block_id string, span_start int, span_end int, ord int")
    found = A.pdf_place(spans, lined, chars, "doc", "id").collect()
    assert {r.id for r in found} == {"h"} and len(found) == 2
    index = spark.createDataFrame([(1, "abcab")], "doc int, words string")
    marks = spark.createDataFrame([(1, "h", "ab")], "doc int, highlight_id string, selected_text string")
    touched = spark.createDataFrame([(1, "h", 3), (1, "h", 4)], "doc int, highlight_id string, position int")
    placed = A.on_page(marks, index, touched, "doc").first()
    assert (placed.state, placed.range_start, placed.range_end) == ("mapped", 3, 5)


def test_find_keeps_original_offsets(spark):
    df = spark.createDataFrame([(1, "Phương  PHÁP và phuong phap")], "d int, t string")
    assert [(r.start, r.end) for r in A.find_matches(df, "d", "t", "phuong").collect()] == [(0, 6), (16, 22)]
    assert A.find_matches(df, "d", "t", "phuong phap", loose=True).count() == 2


def test_mind_map_limits(spark):
    nodes = [("root", ""), ("a", "root"), ("b", "root"), ("c", "a"), ("d", "c"), ("e", "d"), ("x", "y"), ("y", "x"), ("lost", "gone")]
    df = spark.createDataFrame([("m", i, n, p, n) for i, (n, p) in enumerate(nodes)], "artifact_id string, ord int, id string, parent string, label string")
    got = {r.id: r.depth for r in T.bfs(df).collect()}
    assert got == {"root": 0, "a": 1, "b": 1, "c": 2, "d": 3}
    two = df.unionByName(spark.createDataFrame([("m", 99, "r2", "", "r2")], df.schema))
    assert T.bfs(two).count() == 0
    line = {r.id: r.line for r in T.paths(T.bfs(df), df).collect()}
    assert line["d"] == "root › a › c › d"


def test_index_answers_like_a_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, "Alpha beta"), (2, "alphabet alpha"), (3, "béta alpha betamax")], "id int, t string")
    search.write_index(search.token_index(df, "id", "t"), str(tmp_path / "i"))
    found = search.from_index(spark.read.parquet(str(tmp_path / "i")), "alpha beta", "id")
    scan = search.hits(df, "alpha beta", "t").select("id", "score")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, scan.collect()))


ARTICLE = "<p>{}</p>".format("Real words of the story, told at some length so that it counts as prose. " * 4)


def article(spark, html, url="https://www.news.example/a"):
    return web.articles(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")).first()


def test_articles(spark):
    nav = "<nav><a href='/x'>x</a></nav><div class='sidebar'><p>{}</p></div>".format("Other things entirely, also long enough to be prose. " * 2)
    html = f"<html><head><title>The Story</title><meta property='og:title' content='The Story!'></head><body>{nav}<article><h1>The story</h1>{ARTICLE * 8}<p>A <b>bold</b> <a href='https://b.example/q'>link</a>.</p><img src='/i.png' alt='pic'></article></body></html>"
    got = article(spark, html)
    assert got.title == "The Story!" and got.variant == 0 and not got.paywalled
    assert got.content.startswith("Real words") and "Other things" not in got.content
    assert "A **bold** [link](https://b.example/q)." in got.content
    assert "![pic](https://www.news.example/i.png)" in got.content


def test_hidden_article_is_found_by_loosening(spark):
    got = article(spark, f"<body><p>Short teaser of nothing at all here.</p><div hidden id='S:1'>{ARTICLE * 8}</div></body>")
    assert got.variant > 0 and got.words > 150


def test_paywall_and_published_text(spark):
    ld = '{"@type":"NewsArticle","isAccessibleForFree":false,"articleBody":"%s"}' % ("One two three. " * 100)
    got = article(spark, f"<head><script type='application/ld+json'>{ld}</script></head><body><p>Only a teaser here.</p></body>")
    assert got.paywalled and got.words == 300
    row = spark.createDataFrame([(got.words, got.paywalled, None)], "words int, paywalled boolean, pdf_url string")
    assert web.importable(row).first().status == "blocked"


def test_tables_and_lists_in_markdown():
    from readlake.sources.html import page_rows, to_markdown

    names = ["node", "path", "tag", "hint", "hidden", "text", "attrs"]
    html = "<div><ul><li>a<ul><li>b</li></ul></li></ul><table><tr><th>x</th><th>y</th></tr><tr><td>1</td></tr></table><pre>z\n</pre><blockquote><p>q</p></blockquote></div>"
    rows = [dict(zip(names, r, strict=True)) for r in page_rows(html)]
    assert to_markdown(rows, 0, "") == "- a\n  - b\n\n| x | y |\n|---|---|\n| 1 |  |\n\n```\nz\n```\n\n> q"


def test_limiter():
    times, passed = [], []
    for now in (0.0, 1.0, 2.0, 9.0, 10.0, 11.5):
        ok, times = decisions.allowed(times, now, 2, 10.0)
        passed.append(ok)
    assert passed == [True, True, False, False, True, True]  # refused hits do not count; a hit leaves after exactly ten seconds


def epub(chapters):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(chapters)))
        refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
        z.writestr("o/c.opf", f'<package xmlns:dc="d"><metadata><dc:title>Book</dc:title></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for i, body in enumerate(chapters):
            z.writestr(f"o/c{i}.xhtml", f"<html><body>{body}</body></html>")
    return data.getvalue()


def test_landing_and_epub(spark, tmp_path):
    from readlake.sources import ingest

    (tmp_path / "a.epub").write_bytes(epub(["<h1>One</h1><p>" + "word " * 30 + "</p><div class='toc'>junk</div>", "<p>short</p>", "<p>" + "more " * 30 + "</p>"]))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "c.pdf").write_bytes(b"nope")
    (tmp_path / "d.txt").write_bytes(b"x")
    good, bad = ingest.landing(spark, str(tmp_path))
    assert sorted(r.name for r in good.collect()) == ["a.epub", "b.pdf"]
    assert sorted((r.name, r.problem) for r in bad.collect()) == [("c.pdf", "content"), ("d.txt", "type")]
    book = ingest.epub_documents(ingest.epub_chapters(good.filter("name = 'a.epub'"))).first()
    locked = io.BytesIO(epub(["<p>" + "word " * 30 + "</p>"]))
    with zipfile.ZipFile(locked, "a") as z:
        z.writestr("META-INF/encryption.xml", "<x/>")
    books = spark.createDataFrame([("l", locked.getvalue()), ("z", b"PK no zip"), ("a", (tmp_path / "a.epub").read_bytes())], "path string, content binary")
    assert sorted((r.path, r.chapter, r.problem) for r in ingest.epub_rejects(books).collect()) == [("a", 2, "short"), ("l", None, "encrypted"), ("z", None, "broken")]
    assert book.title == "Book" and book.content.startswith("# One\n\nword") and "junk" not in book.content and "short" not in book.content


def test_catalog_and_log(spark, tmp_path):
    from readlake.sources import ingest

    (tmp_path / "c.json").write_text('{"updated_at": "x",\n "articles": [{"url": "u", "title": "t", "topics": ["a"]}]}')
    assert ingest.catalog(spark, str(tmp_path / "c.json")).first().topics == ["a"]
    (tmp_path / "r.json").write_text('{"by_topic": {"a": 2}, "by_kind": {"k": 1}}')
    assert ingest.catalog_report(spark, str(tmp_path / "r.json")).count() == 2
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.json").write_text('{"ts": "2024-01-01T20:00:00Z", "method": "POST", "path": "/api/translate", "status": 200}\nbad\n')
    path = str(tmp_path / "out")
    jobs.count_traffic(jobs.request_log(spark, str(log)), path, str(tmp_path / "cp")).awaitTermination()
    row = jobs.read_counters(spark, path).first()
    assert (str(row.day), row.area, row.requests, row.ai_calls) == ("2024-01-02", "translate", 1, 1)


def test_snapshot_replaces_whole_table(spark, tmp_path):
    from readlake.sources.export import write_lines, write_snapshot

    path = str(tmp_path / "t")
    write_snapshot(spark.range(5), path)
    write_snapshot(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3
    write_lines(spark.range(100).selectExpr("id", "cast(id as string) line"), ["id"], "line", str(tmp_path / "l"))
    lines = [line for f in sorted((tmp_path / "l").glob("part-*")) for line in f.read_text().split()]
    assert lines == [str(i) for i in range(100)]


def test_results_refused(spark):
    df = spark.createDataFrame([("not json", 3), ('{"tldr": "x", "takeaways": []}', 3), ('{"tldr": "x", "tldr_sources": [], "takeaways": [{"text":"a","sources":[9]},{"text":"b","sources":[]},{"text":"c","sources":[true]}]}', 3)], "body string, total int")
    assert [r.problem for r in R.parse_quick(df).collect()] == ["not JSON", "schema mismatch", "no citations"]


def test_every_vector_asks_for_its_closest(spark, tmp_path):
    """Vectors of any id are questions, so also of a label without a round id; the text of the prompt has the same ones."""
    from readlake.operators import retrieval
    from readlake.plans import QUERIES

    r = random.Random(7)
    some = [(i, [float(r.randrange(-2, 3)) + 0.5 for _ in range(3)], i % 4) for i in range(1, 60)]
    df = spark.createDataFrame(some, "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = df.selectExpr("label document", "vec_id position", "embedding")
    plain = retrieval.closest(rows, rows.withColumnRenamed("position", "question_id"), "document")
    want = sorted((x.question_id, x.position, x.score) for x in plain.collect())
    assert len({q for q, _, _ in want}) == 59 and len(want) == 59 * 8
    assert sorted(tuple(x) for x in QUERIES["closest_passages"](spark, str(tmp_path)).collect()) == want
    assert {x.question_id for x in QUERIES["prompt_context"](spark, str(tmp_path)).collect()} == set(range(1, 60))


def test_closest_of_many_against_brute_force(spark):
    from readlake.operators import retrieval

    r = random.Random(5)
    rows = [(i, i % 3, [float(r.randrange(-3, 4)) for _ in range(4)]) for i in range(300)]
    rows += [(300, 1, []), (301, 1, [1.0, 2.0]), (302, 1, [0.0] * 4), (303, 1, None), (304, None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "position long, document int, embedding array<double>")
    asked = df.withColumnRenamed("position", "question_id")  # every row asks
    got = retrieval.closest_of_many(df, asked, "document", 8, tile=40, block=16).select("question_id", "position", "score").collect()

    def cosine(a, b):
        a, b = a or [], b or []
        both = sum(x * x for x in a) * sum(x * x for x in b)
        return round(sum(x * y for x, y in zip(a, b)) / both**0.5, 6) if len(a) == len(b) and both > 0 else 0.0

    want = []
    for q, d, v in rows:
        if d is not None:
            near = sorted((-cosine(w, v), p) for p, e, w in rows if e == d)
            want += [(q, p, -s) for s, p in near[:8]]
    assert sorted((x[0], x[1]) for x in got) == sorted((q, p) for q, p, _ in want)
    assert {(x[0], x[1]): x[2] for x in got} == pytest.approx({(q, p): s for q, p, s in want}, abs=2e-6)


def test_decisions_in_pieces(spark):
    """A hot key cut into chunks, quiet gaps, ties and one-hit keys: the same decisions as a plain pass."""
    rng = random.Random(12)
    rows, at = [], 0.0
    for i in range(900):
        at += rng.choice([0.0, 0.5, 1.0, 3.0, 30.0])
        rows.append(("hot", at, i))
    rows += [(f"k{i % 40}", float(rng.randrange(400)), 1000 + i) for i in range(300)] + [("one", 5.0, 5000)]
    hits = spark.createDataFrame(rows, "key string, at double, hit_id long").repartition(5)
    for decide, reach in ((lambda t, a: decisions.allowed(t, a, 3, 10.0), 10.0), (lambda t, a: decisions.spaced_out(t, a, 7.0), 7.0)):
        want, held = set(), {}
        for key, a, i in sorted(rows, key=lambda r: (r[1], r[2])):
            passed, held[key] = decide(held.get(key, []), a)
            want.add((key, i, passed))
        for most in (7, 100_000):
            assert {tuple(r) for r in decisions.decided(hits, decide, reach, most).collect()} == want
    cut = decisions.pieces(hits, 10.0, 7)
    assert cut.groupBy("key", "piece", "chunk").count().agg(F.max("count")).first()[0] <= 7
    assert decisions.rate_limited_batch(hits.limit(0), 3, 10.0).collect() == []


def test_state_of_a_stream_ends(spark, tmp_path):
    """Decisions across micro-batches are those of the whole log, and a key that stays away is forgotten by its timer."""
    arrived = str(tmp_path / "arrived")
    files = [[("a", 1000.0, 1), ("b", 1001.0, 2), ("a", 1002.0, 3)], [("a", 1004.0, 4), ("a", 1005.0, 5)], [("c", 90_000.0, 6)], [("c", 90_010.0, 7), ("a", 90_011.0, 8)]]
    for rows in files:
        spark.createDataFrame(rows, "key string, at double, hit_id long").coalesce(1).write.mode("append").parquet(arrived)
    log = spark.readStream.schema("key string, at double, hit_id long").option("maxFilesPerTrigger", 1).parquet(arrived)
    out, held = str(tmp_path / "out"), []
    query = decisions.rate_limited(log, 2, 100.0, "10 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    got = {r.hit_id: r.passed for r in spark.read.schema(decisions.DECIDED).parquet(out).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: True, 8: True}
    assert max(held) > held[-1] and max(held) >= 2  # the keys of the first files are gone


def test_late_rows_are_counted_once(spark, tmp_path):
    """Late rows by the newest event of earlier batches; a batch that is run again changes nothing."""
    rows = [[(1, "2024-01-10"), (2, "2024-01-20")], [(3, "2024-01-19"), (4, "2024-01-01")], [(5, "2024-02-20"), (6, "2024-01-18")], [(7, "2024-01-18")]]
    arrived, path = str(tmp_path / "arrived"), str(tmp_path / "late")
    for r in rows:
        spark.createDataFrame(r, "id int, day string").withColumn("ts", F.col("day").cast("timestamp")).drop("day").coalesce(1).write.mode("append").parquet(arrived)
    log = lambda: spark.readStream.schema("id int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(arrived)
    for checkpoint in ("one", "two"):  # the second run writes every batch again
        jobs.counted_late(log(), path, str(tmp_path / checkpoint), "5 days").awaitTermination()
        got = sorted((r.batch, r.kept, r.late) for r in jobs.late_counts(spark, path).collect())
        assert got == [(0, 2, 0), (1, 1, 1), (2, 2, 0), (3, 0, 1)]
        assert sorted(r.id for r in spark.read.parquet(f"{path}/late/batch=*").collect()) == [4, 7]


def test_index_refresh(spark, tmp_path):
    """Changed, new and gone documents are cut anew; files of untouched buckets keep their names; a run that was broken off is done again."""
    from pathlib import Path

    from readlake.operators import passage_index as I

    path = str(tmp_path / "index")
    asked = []

    def cut(docs):
        asked.append(sorted(r.id for r in docs.select("id").collect()))
        return docs.select("id", F.posexplode(F.split("text", " ")).alias("position", "word")).filter("word <> ''")

    def state(table):
        return sorted(map(tuple, table.drop("bucket").collect()))

    def files():
        return {str(f.relative_to(path)) for f in Path(path).rglob("part-*.parquet")}

    texts = {i: f"a{i} b{i} c" for i in range(60)} | {60: ""}

    def run(model="m"):
        docs = spark.createDataFrame([*texts.items(), (None, "no key")], "id int, text string")
        return I.refresh(docs, path, "id", F.sha2("text", 256), model, cut, buckets=16)

    want = lambda: sorted((i, p, w) for i, t in texts.items() for p, w in enumerate(t.split()))
    done = run()
    assert (done.cut, done.gone) == (61, 0) and state(I.passages(spark, path)) == want()
    before = files()
    assert run() == I.Refreshed(0, 0, []) and files() == before
    texts[5] = "other words"
    texts[70] = "new"
    del texts[6]
    done = run()
    assert (done.cut, done.gone, asked[-1]) == (2, 1, [5, 70]) and state(I.passages(spark, path)) == want()
    kept = lambda fs: {f for f in fs if not any(f"bucket={b}/" in f for b in done.buckets)}
    assert 0 < len(done.buckets) <= 3 and kept(files()) == kept(before) and len(kept(before)) > 0
    alone = next(b for b in range(16) if b in {r.bucket for r in I.digests(spark, path).collect()})
    for r in I.digests(spark, path).filter(F.col("bucket") == alone).collect():
        del texts[r.id]
    done = run()
    assert done.buckets == [alone] and state(I.passages(spark, path)) == want() and not any(f"bucket={alone}/" in f for f in files())
    assert run("m2").cut == len(texts) and state(I.passages(spark, path)) == want()


def test_figure_regions_like_a_plain_pass(spark):
    """Labels taken in one after the other until none is in reach, then running text cut off: the same regions as the fold."""
    rng = random.Random(21)
    pages, found, labels = {}, [], []
    for page in range(40):
        x, y = rng.randrange(100, 250), rng.randrange(100, 250)
        core = (x, y, x + rng.randrange(20, 200), y + rng.randrange(20, 200))
        paths, curvy = rng.randrange(5, 40), rng.random() < 0.7
        found.append(("d", page, 0, *map(float, core), paths, curvy))
        mine = []
        for n in range(rng.randrange(0, 14)):
            a, b = rng.randrange(40, 480), rng.randrange(40, 480)
            words = rng.choice(["0.5", "time in s", "a line of running text that goes on for long enough", "Figure 2. What is seen", "x" * 30])
            box = (a, b, a + rng.randrange(10, 130), b + 9)
            mine.append((box, words, rng.choice([6.0, 9.0, 10.0, 12.0]), len(words) > 45))
            labels.append(("d", page, words, *map(float, box), mine[-1][2], mine[-1][3], 10.0))
        pages[page] = (core, paths, curvy, sorted(mine))

    def meets(a, b, by=0):
        return a[0] - by < b[2] and b[0] < a[2] + by and a[1] - by < b[3] and b[1] < a[3] + by

    def within(a, b):
        return b[0] <= (a[0] + a[2]) / 2 <= b[2] and b[1] <= (a[1] + a[3]) / 2 <= b[3]

    def plain(core, paths, curvy, mine):
        captions = [b for b, t, _, _ in mine if t.startswith("Figure")]
        plot = curvy and paths >= 20
        if max(core[2] - core[0], core[3] - core[1]) < 40 or not (plot or any(meets(core, c, 80) for c in captions)):
            return None
        region, pending = core, [m for m in mine if not m[1].startswith("Figure")]
        grew = True
        while grew:
            grew = False
            for m in list(pending):
                b, t, size, para = m
                if within(b, core) or ((size < 9.5 or (len(t) <= 25 and not para)) and meets(region, b, 14)):
                    region = (min(region[0], b[0]), min(region[1], b[1]), max(region[2], b[2]), max(region[3], b[3]))
                    pending.remove(m)
                    grew = True
        for b in [m[0] for m in pending] + captions:
            if meets(region, b) and not within(b, core):
                w, h = region[2] - region[0], region[3] - region[1]
                cuts = [(region[2] - b[0], w, (region[0], region[1], b[0] - 1, region[3])), (b[2] - region[0], w, (b[2] + 1, region[1], region[2], region[3])),
                        (region[3] - b[1], h, (region[0], region[1], region[2], b[1] - 1)), (b[3] - region[1], h, (region[0], b[3] + 1, region[2], region[3]))]
                loss, side, cut = min(cuts, key=lambda c: c[0])
                region = cut if 0 < loss < side * 0.3 else region
        if min(region[2] - region[0], region[3] - region[1]) < 40 or sum(len(t) for b, t, s, p in mine if p and s >= 9.5 and within(b, core)) > 60:
            return None
        near = any(c[0] < region[2] and c[2] > region[0] and (region[3] - 5 <= c[1] <= region[3] + 40 or region[1] - 40 <= c[3] <= region[1] + 5) for c in captions)
        return tuple(map(float, region)) if near or plot else None

    shape = "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double, size double, in_paragraph boolean, body_size double"
    drawn = spark.createDataFrame(found, "doc_id string, page int, cluster int, x0 double, y0 double, x1 double, y1 double, paths int, curvy boolean")
    got = {r.page: (r.x0, r.y0, r.x1, r.y1) for r in L.figures(drawn, spark.createDataFrame(labels, shape)).collect()}
    want = {p: plain(*v) for p, v in pages.items()}
    assert got == {p: r for p, r in want.items() if r is not None} and 8 < len(got) < 40


def test_tables_on_one_page(spark):
    """A table ends where another's caption stands; rows are told by spacing; items of a list in a cell begin lines; like first cells make no header."""
    captions = spark.createDataFrame([("d", 1, n, 20.0, y, 180.0, y + 8.0) for n, y in ((1, 80.0), (2, 190.0), (3, 500.0))], "doc_id string, page int, ord int, x0 double, y0 double, x1 double, y1 double")
    rules = [("d", 1, y, 0.0, 200.0) for y in (100.0, 120.0, 180.0, 205.0, 225.0, 260.0, 400.0, 440.0, 490.0)] + [("d", 1, 150.0, 90.0, 130.0)]
    found = L.ruled_tables(captions, spark.createDataFrame(rules, "doc_id string, page int, y double, x0 double, x1 double"))
    assert {r.caption: r.ys for r in found.collect()} == {1: [100.0, 120.0, 180.0], 2: [205.0, 225.0, 260.0, 400.0, 440.0, 490.0]}
    cells = [("Case 1", 10, 105), ("v", 110, 105), ("Case 2", 10, 125), ("1. one", 110, 125), ("more", 110, 133), ("2. two", 110, 141), ("Case 3", 10, 160), ("w", 110, 160), ("x", 110, 168)]
    spans = spark.createDataFrame([("d", 1, t, float(x), float(y), x + 50.0, y + 8.0, 8.0) for t, x, y in cells], "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double, size double")
    got = L.tables(spans, found.filter("caption = 1")).first().markdown
    assert got.split("\n") == ["|  |  |", "|---|---|", "| Case 1 | v |", "| Case 2 | 1. one more<br>2. two |", "| Case 3 | w x |"]


def test_cleaning_chain(spark):
    """Provenance through splits, joins and scans on hand-made pages, messy rows included; flow and side store together hold every item."""
    from readlake.operators import cleaning as CL

    def item(page, n, text, kind="text", y=None, size=10.0):
        y = 100.0 * n if y is None else y
        return ("d", page, n, 50.0, y, 550.0, y + 20.0, 600.0, 800.0, text, kind, size, False)

    rows = [
        item(1, 1, "A thing is told and goes"), item(2, 1, "on over here until it"), item(3, 1, "ends at last. Word-⁣break and wordbreak."), item(3, 2, "## Funding"), item(3, 3, "We were paid."), item(3, 4, "## Results"),
        item(4, 1, "<!-- scan 4 -->", "ocr"), item(5, 1, "<!-- scan 5 -->", "ocr"), item(6, 1, "7", y=770.0), item(6, 2, "More."), item(6, 3, None), item(6, 4, "© 2020 All rights reserved", y=700.0),
    ]
    frame = spark.createDataFrame(rows, "doc_id string, page int, ord int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, text string, kind string, size double, bold boolean")
    read = spark.createDataFrame([("d", 4, " Read words.\n\nTwo blocks. "), ("d", 5, "  ")], "doc_id string, page int, text string")
    out = CL.clean(frame, read)
    content = out.content.first().content
    assert content == "A thing is told and goes on over here until it\n\n---\n\nends at last. Wordbreak and wordbreak.\n\n## Results\n\n---\n\nRead words.\n\nTwo blocks.\n\n---\n\nMore."
    boxes = {r.ord: [(b.page, b.y) for b in r.boxes] for r in out.source_map.collect()}
    assert boxes[1] == [(1, 0.125), (2, 0.125)]  # the paragraph of two pages has both boxes
    kept = CL.clean(frame).content.first().content
    assert "<!-- scan 4 -->" in kept and "<!-- scan 5 -->" in kept
    side = {(r.type, r.text) for r in out.aside.collect()}
    assert {("PAGE_NUMBER", "7"), ("PUBLISHER_INFO", "© 2020 All rights reserved"), ("FUNDING", "## Funding"), ("FUNDING", "We were paid.")} <= side
    assert CL.clean(frame.limit(0), read.limit(0)).content.collect() == []


def test_page_items_source(spark, tmp_path):
    """Ranges of any size give every line once; lines that are no items are left out or fail; only the columns asked for are read."""
    import json

    from readlake.sources import page_items

    rows = [{"doc_id": f"d{i}", "page": i % 7, "text": "wörds " * (i % 50), "x0": i / 2} for i in range(300)]
    body = "\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
    (tmp_path / "a.json").write_text(body + "\n[1]\nnot json\n", encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"doc_id": "last"}), encoding="utf-8")
    (tmp_path / "_SUCCESS").write_text("")
    page_items.register(spark)
    for size in (1, 7, 4096, 1 << 20):
        if size == 1:  # every byte its own range
            parts = page_items.ranges(str(tmp_path / "b.json"), 1)
            assert [x for p in parts for x in page_items.lines(p)] == [b'{"doc_id": "last"}']
            continue
        if size == 7:
            got = [x for p in page_items.ranges(str(tmp_path / "a.json"), 7) for x in page_items.lines(p)]
            assert got == (tmp_path / "a.json").read_bytes().splitlines()
            continue
        read = spark.read.format("page_items").option("rangeBytes", size).schema("doc_id STRING, x0 DOUBLE, text STRING").load(str(tmp_path))
        want = sorted([(r["doc_id"], r["x0"], r["text"]) for r in rows] + [("last", None, None)], key=str)
        assert read.columns == ["doc_id", "x0", "text"] and sorted(map(tuple, read.collect()), key=str) == want
    whole = spark.read.format("page_items").load(str(tmp_path))
    assert len(whole.columns) == 13 and whole.count() == 301
    with pytest.raises(Exception, match="no item|JSON|Expecting"):
        spark.read.format("page_items").option("mode", "FAILFAST").load(str(tmp_path)).count()


def test_notebooks_whole_or_in_slices(spark):
    """Small notebooks are numbered, grouped and paired after one shuffle of their sources; large ones slice by slice, with the same rows."""
    from readlake.operators import notebooks as N

    rnd = random.Random(5)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.randrange(4), f"h{i}", rnd.choice([None, 1, 5000, 9000]), rnd.choice([None, 1, 2]), rnd.randrange(3), rnd.choice([None, 1, 2])) for i in range(300)]
    rows = spark.createDataFrame(rows, "notebook_id long, document_id long, highlight_id string, start_at long, page_number int, created_at int, paragraph int")
    rows = rows.withColumns({"title": F.concat(F.lit("T"), (F.col("document_id") % 2).cast("string")), "selected_text": F.lit("here"), "paragraph_text": F.lit("One. It stands here now. End.")}).cache()
    full = rows.filter("notebook_id is not null")
    made = {
        "numbers": (rows, lambda s, _: s.select("notebook_id", "highlight_id", "number"), 1),
        "groups": (full, lambda s, whole: N.group_sources(s, 3, whole=whole), 1),
        "partners": (full, lambda s, whole: N.partners(s, 3, whole=whole), 1),
        "paragraphs": (full, lambda s, whole: N.paragraph_partners(s, whole).select("notebook_id", "highlight_id", "first_number", "last_number", "others"), 1),
    }
    for name, (given, f, shuffles) in made.items():
        whole = N.by_notebook(given, given, f)
        told = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
        assert told(whole) == told(N.by_notebook(given, given, f, most=70)) == told(f(N.number_sources(given), False)), name
        assert whole._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == shuffles, name


def test_figure_regions_worked_out_once(spark):
    """A chain of labels, given from far to near, is taken in whole; the plan holds each fold once, not once for each use of its region."""
    found = spark.createDataFrame([("d", 1, 0, 100.0, 100.0, 200.0, 200.0, 30, True)], L.CLUSTERS)
    chain = [("d", 1, "x", 205.0 + 20 * i, 150.0, 215.0 + 20 * i, 159.0, 6.0, False, 10.0) for i in reversed(range(12))]
    far = [("d", 1, "y", 600.0, 600.0, 610.0, 610.0, 6.0, False, 10.0)]
    labels = spark.createDataFrame(chain + far, "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double, size double, in_paragraph boolean, body_size double")
    out = L.figures(found, labels)
    assert [tuple(r)[3:7] for r in out.collect()] == [(100.0, 100.0, 435.0, 200.0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 4


def test_panels_digitised_to_all_digits(spark):
    """Three marks in a row stand for their mean: 501 and a third, which on a doubled axis has more than four digits."""
    from readlake.operators import charts

    marks = spark.createDataFrame([("f", 1, p, 10.0) for p in (500.0, 501.0, 503.0 - 1)] + [("f", 1, 400.0, 10.0), ("f", 1, 401.0, 10.0), ("f", 1, 401.0, 11.0)], "figure string, series int, px double, py double")
    found = spark.createDataFrame([("f", 0, 0, 0, 0.0, 0.0, 999.0, 999.0)], "figure string, panel int, x int, y int, x0 double, y0 double, x1 double, y1 double")
    fits = spark.createDataFrame([("f", 0, "linear", 4.0, 0.0)], "figure string, axis int, scale string, a double, b double")
    read = lambda **more: [r.x for r in charts.digitise_panels(marks, found, fits, fits, **more).orderBy("i").collect()]
    assert read() == [1603.0, 2004.0]
    assert read(digits=None) == pytest.approx([1602.6666667, 2004.0], abs=1e-6)


def test_title_keeps_unclosed_references(spark):
    """A reference in a title counts once it is closed; elsewhere, and in closed form, it is read as before."""
    from readlake.sources.html import html_nodes

    html = "<html><head><TITLE lang='en'>Rock &amp; roll &amp;&amp</TITLE></head><body><p>x &amp y</p></body></html>"
    pages = spark.createDataFrame([(1, "http://a.example/", html), (2, "http://a.example/", "<title>A&lt;B &#39;c&#39; &amp;lt; AT&T</title>")], "page_id long, url string, html string")
    titles = {r.page_id: r.title for r in web.metadata(html_nodes(pages), pages).collect()}
    assert titles == {1: "Rock & roll &&amp", 2: "A<B 'c' &lt; AT&T"}
    assert html_nodes(pages).filter("text like 'x%'").first().text == "x & y"


def test_alignment_of_repeated_letters(spark):
    """Runs whose every gram stands several times: one letter over and over, and a text that says itself twice."""
    from readlake.operators import alignment

    twice = "0123456789abcdeffedcba9876543210" * 2
    cases = [(1, "aaaaaXzy9w8v7u6t5s4r3", "aaaaa#zy9w8v7u6t5s4r3"), (2, twice, twice[:20] + "#" + twice[21:]), (3, "ababababX", "abababab#"), (4, "bb62bb9ea304d21041041a", "bb62bb9ea304d2#041041a"), (5, "bb62bb9ea304d2X1041041a", "bb62bb9ea304d2#1041041a")]
    frame = spark.createDataFrame(cases, "id int, a string, b string")
    got = {}
    for r in alignment.runs(frame, ["id"], "a", "b", A.MIN_RUN).collect():
        got.setdefault(r.id, set()).update((r.at + i, r.to + i) for i in range(r.size))
    for n, a, b in cases:
        assert got[n] == {(i, i) for i in range(len(a)) if a[i] == b[i]}, n


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_readings_are_aligned_in_their_own_rows(spark, monkeypatch):
    """No gram of a passage is sent anywhere: a round reads rows, works on them and writes them."""
    from readlake.operators import alignment

    written, keep = [], alignment.pinned
    monkeypatch.setattr(alignment, "pinned", lambda df, name="stage", **options: (written.append(_plan(df)), keep(df, name, **options))[1])
    frame = spark.createDataFrame([(1, "one two three four five", "one two thr#e four five"), (2, None, "x")], "id int, a string, b string")
    got = sorted((r.at, r.to, r.size) for r in alignment.runs(frame, ["id"], "a", "b", A.MIN_RUN).collect())
    assert got == [(0, 0, 11), (12, 12, 11)]
    assert len(written) == len(alignment.GRAMS) and not any("Exchange" in p for p in written)
    assert alignment.shared_runs("abcdXabcd", "abcd", 4, 1) == [] and alignment.shared_runs("abcdXabcd", "abcd", 4, 2) == [(0, 0, 4), (5, 0, 4)]


def test_characters_of_several_letters_on_the_page(spark):
    """A sign of two letters stays one character of the page, also where its block goes on over the next page."""
    signs = [(1, 0, "a"), (1, 1, "fi"), (2, 0, "b")]
    chars = spark.createDataFrame([(1, p, i, c, 0.1 + i * 0.01, 0.1, 0.11 + i * 0.01, 0.12) for p, i, c in signs], "doc int, page int, ord int, c string, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([(1, p, "b", 0.05, 0.05, 0.3, 0.1) for p in (1, 2, 2)], "doc int, page int, block_id string, x double, y double, w double, h double")
    found = A.aligned(spark.createDataFrame([(1, "b", "afib")], "doc int, block_id string, words string"), chars, boxes, "doc").collect()
    assert sorted((r.i, r.page, r.ord) for r in found) == [(0, 1, 0), (1, 1, 1), (2, 2, 0)]


def test_boxes_meet_characters_once(spark):
    """A box is one row however much of the page it covers, and what is grouped by page next is not sent again."""
    rng = random.Random(5)
    spots = [(d, rng.randint(1, 2), n, rng.uniform(-0.1, 1.1), rng.uniform(-0.1, 1.1)) for n, d in enumerate([1, 2] * 60)]
    areas = [(d, rng.randint(1, 2), f"b{n % 5}", rng.uniform(-0.1, 1), rng.uniform(-0.1, 1), rng.uniform(0, 1), rng.uniform(0, 1)) for n, d in enumerate([1, 2] * 15)]
    chars = spark.createDataFrame([(*r[:3], r[3], r[4], r[3], r[4]) for r in spots], "doc int, page int, ord int, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame(areas, "doc int, page int, key string, x double, y double, w double, h double")
    met = G.chars_in_boxes(chars, boxes, ["doc", "page"], "key")
    plain = {(d, p, k, n) for d, p, n, cx, cy in spots for e, q, k, x, y, w, h in areas if (d, p) == (e, q) and x - 0.004 <= cx <= x + w + 0.004 and y - 0.004 <= cy <= y + h + 0.004}
    got = [(r.doc, r.page, r.key, r.ord) for r in met.collect()]
    assert set(got) == plain and len(got) == len(plain)
    plan = _plan(met.groupBy("doc", "page").count())
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_page_nodes_are_sent_without_their_words(spark):
    """Permalinks and commas are told before rows are sent, and a node meets the flags of all rules at once."""
    from readlake.sources.html import html_nodes

    html = "<body><div class='sidebar'><p>a, b, c and so on for a paragraph.</p></div><p hidden>x</p><h2>T<a href='#t'> <i>¶</i> </a></h2><h3>U<a href='#u'>#<b>#</b></a></h3><p>one, two, and three in a long row of words that goes on</p></body>"
    nodes = html_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    stripped = web.stripped(nodes)
    assert "collect_list" not in _plan(stripped)
    clean = stripped.localCheckpoint()
    assert [r.tag for r in clean.filter("tag = 'a'").collect()] == ["a"] and clean.filter("text = '¶'").count() == 0
    kept = web.pruned(clean, [0, 1, 2, 3], web.measures(clean, ["page_id"]))
    assert _plan(kept).count("Generate explode([0,1,2,3])") == 1 and _plan(kept).rindex("Generate explode([0,1,2,3])") < _plan(kept).index("Join")
    texts = {v: {r.text for r in kept.filter(f"variant = {v} and tag = ''").collect()} for v in range(4)}
    assert [("x" in texts[v], "a, b, c and so on for a paragraph." in texts[v]) for v in range(4)] == [(False, False), (True, False), (False, True), (True, True)]
    sizes = web.measures(kept.localCheckpoint(), web.AT)
    assert {r.variant: clean.filter(f"node = {r.root}").first().tag for r in web.containers(kept, sizes).collect()} == dict.fromkeys(range(4), "body")


def test_new_index_is_written_once(spark, tmp_path, monkeypatch):
    """Rows of an index that is not there yet go to their buckets at once; a refresh still sets them down first."""
    from readlake.operators import passage_index as I

    names, keep = [], I.pinned
    monkeypatch.setattr(I, "pinned", lambda df, name="stage", **options: (names.append(name), keep(df, name, **options))[1])
    docs = spark.createDataFrame([(n, f"text {n}") for n in range(20)], "doc_id long, text string")
    cut = lambda df: df.select("doc_id", F.col("text").alias("passage"))
    path = str(tmp_path / "index")
    I.refresh(docs, path, "doc_id", F.md5("text"), "m", cut, 4)
    assert "buckets" not in names and I.passages(spark, path).count() == 20
    left = docs.filter("doc_id > 2").withColumn("text", F.when(F.col("doc_id") == 7, "new").otherwise(F.col("text")))
    done = I.refresh(left, path, "doc_id", F.md5("text"), "m", cut, 4)
    assert (done.cut, done.gone) == (1, 3) and names.count("buckets") == 2
    assert {(r.doc_id, r.passage) for r in I.passages(spark, path).collect()} == {(r.doc_id, r.text) for r in left.collect()}


def test_image_strips_need_one_sort(spark):
    r = random.Random(5)
    box = lambda: (r.choice(["image", "image", "image", "text", None]), *(r.choice([*range(0, 4), None]) if r.random() < 0.1 else float(r.choice(v)) for v in ([1, 2], [9, 10], [4, 5], [3, 4])))
    rows = [(str(i // 400), i // 40 % 10, None if i % 40 == 0 else i * 3, *box()) for i in range(1200)]
    rows = [(d, p, o, k, *(None if v is None else float(v) for v in b)) for d, p, o, k, *b in rows]
    out = L.image_strips(spark.createDataFrame(rows, "doc_id string, page int, ord long, kind string, x0 double, x1 double, y0 double, y1 double").repartition(3))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [") == 1
    want, last = [], None
    near = lambda a, b: None not in (a[4], b[4], a[5], b[5], a[7], b[6]) and abs(a[4] - b[4]) <= 2 and abs(a[5] - b[5]) <= 2 and 0 <= b[6] - a[7] <= 2
    for b in rows:
        if last and last[:2] == b[:2] and last[3] == b[3] == "image" and near(last, b):
            want[-1].append(b)
        else:
            want.append([b])
        last = b
    least = lambda s, i, f: f((b[i] for b in s if b[i] is not None), default=None)
    want = [(*s[0][:2], least(s, 2, min), s[0][3], len(s), least(s, 4, min), least(s, 6, min), least(s, 5, max), least(s, 7, max)) for s in want]
    assert max(s[4] for s in want) > 5 and out.columns == ["doc_id", "page", "ord", "kind", "strips", "x0", "y0", "x1", "y1"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_tables_are_told_within_a_row(spark):
    """Pages and tables are each one row once their lines have met: no windows, and a join each for rules and for text."""
    page = "doc_id string, page int"
    captions = spark.createDataFrame([("d", 1, 5, 60.0, 90.0, 240.0, 98.0)], f"{page}, ord int, x0 double, y0 double, x1 double, y1 double")
    rules = spark.createDataFrame([("d", 1, y, 50.0, 250.0) for y in (100.0, 120.0, 180.0)], f"{page}, y double, x0 double, x1 double")
    spans = [("d", 1, t, x, y, x + 40, y + 8, 8.0) for t, x, y in (("H1", 60.0, 105.0), ("H2", 160.0, 105.0), ("a", 60.0, 124.0), ("b", 160.0, 124.0), ("c", 160.0, 132.0), ("d", 60.0, 152.0), ("e|f", 160.0, 152.0))]
    out = L.tables(spark.createDataFrame(spans, f"{page}, text string, x0 double, y0 double, x1 double, y1 double, size double"), L.ruled_tables(captions, rules))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 2
    assert out.first().markdown == "| H1 | H2 |\n|---|---|\n| a | b c |\n| d | e\\|f |"


def test_packed_lines_are_read_as_characters_are(spark, monkeypatch):
    """Lines of a page and stretches of a block say what single characters do, and no character is a row of its own on the way."""
    from pyspark.sql import functions as fn

    r = random.Random(11)
    blocks, chars, boxes, spans, rects, marks, start = [], [], [], [], [], [], 0
    for n in range(30):
        words = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
        page, line = 1 + n // 6, n % 6
        blocks.append((1, f"b{n}", words, n, start, words, page))
        for j, c in enumerate(words):
            sign = "#" if r.random() < 0.04 else c
            chars.append((1, page, line * 24 + j, sign, line, j / 24, line / 6, (j + 1) / 24, line / 6 + 0.1))
        boxes += [(1, page, f"b{n}", 0.0, line / 6, 1.0, 0.1), (1, page, f"b{n}", 0.2, line / 6, 0.3, 0.1)]
        spans.append((1, f"h{n // 2}", f"b{n}", 3 if n % 2 == 0 else 0, 24 if n % 2 == 0 else 20, n))
        if n % 3 == 0:
            rects += [(1, f"h{n}", page, 2 / 24, line / 6, 12 / 24, 0.1), (1, f"h{n}", page, 8 / 24, line / 6, 9 / 24, 0.1)]
            marks.append((1, f"h{n}", words[2:17]))
        start += 24
    blocks = spark.createDataFrame(blocks, "doc int, block_id string, words string, ord int, start int, text string, page int")
    chars = spark.createDataFrame(chars, "doc int, page int, ord int, c string, line int, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame(boxes, "doc int, page int, block_id string, x double, y double, w double, h double")
    spans = spark.createDataFrame(spans, "doc int, id string, block_id string, span_start int, span_end int, ord int")
    rects = spark.createDataFrame(rects, "doc int, highlight_id string, page int, x double, y double, w double, h double")
    marks = spark.createDataFrame(marks, "doc int, highlight_id string, selected_text string")
    lines = G.lines_of(chars, ["doc", "page"])
    written, keep = [], A.pinned
    monkeypatch.setattr(A, "pinned", lambda df, *a, **k: (written.append(df), keep(df, *a, **k))[1])
    packed, single = A.aligned_stretches(blocks, lines, boxes, "doc"), A.aligned(blocks, chars, boxes, "doc")
    assert lines.count() == 30 and written[0].count() == 30  # rows of lines and of blocks
    each = packed.select("block_id", "i", "page", "ord", fn.explode(fn.sequence(fn.lit(0), fn.col("size") - 1)).alias("k")).collect()
    where = {(x.block_id, x.i): (x.page, x.ord) for x in single.collect()}
    assert {(x.block_id, x.i + x.k): (x.page, x.ord + x.k) for x in each} == where and len(each) == len(where)
    said = {(c.page, c.ord): c.c for c in chars.collect()}
    text = {b.block_id: b.words for b in blocks.collect()}
    assert all(said[at] == text[b][i] for (b, i), at in where.items()) and len(where) > 550

    def placed(alignment, signs):
        found = A.pdf_place(spans, alignment, signs, "doc", "id").collect()
        touched = A.under_selection(rects, alignment, signs, blocks, "doc")
        return sorted(map(tuple, found)), sorted(map(str, A.on_page(marks, A.index(blocks, "doc"), touched, "doc").collect()))

    assert placed(packed, lines) == placed(single, chars)
    # A range is shown where 98 % of it and both ends are found: the box of what is found on each of its lines.
    want = []
    for h in range(15):
        wanted = [(f"b{2 * h}", i) for i in range(3, 24)] + [(f"b{2 * h + 1}", i) for i in range(20)]
        there = [where[w] for w in wanted if w in where]
        if len(there) >= A.COVERED * len(wanted) and wanted[0] in where and wanted[-1] in where:
            for page, line in sorted({(p, o // 24) for p, o in there}):
                js = [o % 24 for p, o in there if (p, o // 24) == (page, line)]
                want.append((f"h{h}", page, line, round(min(js) / 24, 5), round((max(js) + 1) / 24 - min(js) / 24, 5)))
    got = [(x.id, x.page, x.line, x.x, x.w) for x in A.pdf_place(spans, packed, lines, "doc", "id").collect()]
    assert [g[:3] for g in sorted(got)] == [w[:3] for w in sorted(want)] and all(abs(g[3] - w[3]) < 2e-5 and abs(g[4] - w[4]) < 2e-5 for g, w in zip(sorted(got), sorted(want), strict=True)) and want
    share = {m.highlight_id: sum((m.block, i) in where for i in range(2, 17)) / 15 for m in marks.withColumn("block", fn.concat(fn.lit("b"), fn.substring("highlight_id", 2, 9))).collect()}
    state = {x.highlight_id: x.state for x in A.on_page(marks, A.index(blocks, "doc"), A.under_selection(rects, packed, lines, blocks, "doc"), "doc").collect()}
    assert state == {h: "mapped" if s >= A.OVERLAP else "unresolved" for h, s in share.items()}


def test_chains_of_runs_are_those_of_the_array_functions(spark):
    """The heaviest chain made where the runs are found is the one that the array functions make."""
    from readlake.operators import alignment

    r = random.Random(3)
    rows = []
    for n in range(150):
        a = "".join(r.choice("abc") for _ in range(r.randrange(8, 60)))
        b = "".join(r.choice("abcx") if r.random() < 0.1 else c for c in a) if n % 3 else a[len(a) // 2 :] + a[: len(a) // 2]
        rows.append((n, a, b, alignment.shared_runs(a, b, 4, 9)))
    frame = spark.createDataFrame(rows, f"id int, a string, b string, found array<{alignment.RUN}>").filter("size(found) > 1")
    got = {x.id: [tuple(y) for y in x.c] for x in frame.select("id", alignment.heaviest_chain(F.col("found")).alias("c")).collect()}
    assert len(got) > 100 and all(alignment._chain(rows[n][3]) == c for n, c in got.items())
    assert all(a[x : x + k] == b[y : y + k] for _, a, b, f in rows for x, y, k in alignment.grown(alignment._chain(f), a, b))
    assert alignment.grown([(2, 2, 2), (6, 6, 2)], "abcdefghij", "abcdefghij") == [(0, 0, 10)]


def test_role_items_are_made_once(spark):
    """Body sizes are told from the items as they are written, not from a second making of them."""
    many = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            many.add(batch.num_rows)
            yield batch

    rows = [(d, p, n, 50.0, 60.0 * n, 300.0, 60.0 * n + 20, 800.0, t, "text", 9.0 + d, None, 0.0, "") for d in (1, 2) for p in (1, 2) for n, t in enumerate(("## References", "[1] One", "plain words here", "We thank all."), 1)]
    shape = "doc_id long, page int, n int, x0 double, y0 double, x1 double, y1 double, page_height double, text string, kind string, size double, role string, confidence double, reason string"
    items = spark.createDataFrame(rows, shape)
    plain = sorted(map(str, roles.classify(items, L.body_size(items)).collect()))
    assert sorted(map(str, roles.classify(items.mapInArrow(counted, items.schema), L.body_size).collect())) == plain
    assert many.value == len(rows)
