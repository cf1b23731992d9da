"""Spelling variants against a plain comparison of all words, and signatures that miss no near pair."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from readlake.llm import queries, spelling_variants
from tests.llm.conftest import ROWS

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def low(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def edits(word, letters):
    """All words one edit away."""
    for i in range(len(word) + 1):
        for x in letters:
            yield word[:i] + x + word[i:]
            if i < len(word):
                yield word[:i] + x + word[i + 1 :]
        if i < len(word):
            yield word[:i] + word[i + 1 :]


def counted(rows, every=31, least_length=7, least=2):
    held = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                held[run] += 1
    return {w: n for w, n in held.items() if n >= least}


def plain(words, times=10):
    letters = sorted({x for w in words for x in w})
    near = {w: {x for x in edits(w, letters) if x != w and x in words} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def grown():
    """Texts with words whose counts fall by ten from form to form, ties, and accents."""
    r = random.Random(7)
    base = ["reading", "thänkful", "ÀÉÎõüÿß", "aaaaaaaa", "abcdefgh"]
    words = []
    for b in base:
        words += [b] * 2300
        one = b[:2] + "q" + b[2:]
        words += [one] * 210 + [one[:-1] + "z"] * 20 + [one[:-1] + "y"] * 20 + [one[:-1] + "zz"] * 2
    words += [w for b in base for w in (b.upper(), b + "×", b[::-1]) for _ in range(3)]
    r.shuffle(words)
    return [(i, r.choice([" ", "-", "1"]).join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]


@pytest.mark.parametrize("every", [31, 3, 0])
def test_variants(spark, messy, every):
    got = spelling_variants.variants(messy, every=every, least_length=4)
    assert rows_of(got) == plain(counted([(i, t) for i, t, _, _ in ROWS], every, 4))


def test_chains(spark):
    rows = grown()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = rows_of(spelling_variants.variants(docs))
    assert got == plain(counted(rows))
    depth = {w: f for w, f, *_ in got if f}
    assert any(depth.get(depth[w]) in depth for w in depth)  # chains of three forms


def test_nothing(spark, nothing):
    assert spelling_variants.variants(nothing).collect() == []


def test_no_near_pair_is_missed(spark):
    """Every one-edit change of random words meets its word, letters that stand several times and foreign ones included."""
    r = random.Random(11)
    letters = "abcdeèéz" + "ж"
    words = {"".join(r.choices(letters[: r.randrange(2, 10)], k=r.randrange(1, 11))) for _ in range(150)}
    words |= {r.choice(list(edits(w, letters))) for w in sorted(words) for _ in range(3)} - {""}
    want = sorted((a, b) if len(a) > len(b) or (len(a) == len(b) and a < b) else (b, a) for a in words for b in set(edits(a, letters)) & words if a < b)
    frame = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    for parts in ((5, 4), (6, 5), (7, 3)):
        assert sorted(map(tuple, spelling_variants.near_pairs(frame, *parts).collect())) == want


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op12_spelling_variants"](spark, folder)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert rows_of(got) == plain(counted([tuple(r) for r in docs]))
    assert got.filter(F.col("form").isNotNull()).count() > 0
