"""Each operator on messy rows, held against a plain version of its rule."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from readlake.llm import decontaminate, fm_index, html_extract, language_id, license_scan, lm_score, mixing, simhash, substring_dedup, topk_search, url_lists, url_queries
from tests.llm.conftest import ROWS, SHARED, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def crc(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def near(a, b):
    return abs(a - b) <= 1e-9 + 1e-9 * abs(b)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(messy, order):
    got = sorted((tuple(r) for r in lm_score.scores(messy, order=order, block_bytes=20_000, part_entries=500).collect()), key=lambda r: (r[0] or -1, r[6]))
    texts = [(i, [*WORD.findall(low(t)), None]) for i, t, _, _ in ROWS]
    role = [2 if crc(i, 5) == 1 else 1 if zlib.crc32(("" if i is None else str(i)).encode()) // 5 % 10 == 0 else 0 for i, _ in texts]

    def counted(keep):
        held, many = Counter(), 0
        for (_, w), r in zip(texts, role, strict=True):
            if r in keep:
                many += 1
                padded = ["^"] * (order - 1) + w
                for j in range(order - 1, len(padded)):
                    held.update(tuple(padded[j - n + 1 : j + 1]) for n in range(1, order + 1))
        return held, many

    def parts(w, held, many):
        padded = ["^"] * (order - 1) + w
        for j in range(order - 1, len(padded)):
            grams = [held[tuple(padded[j - n + 1 : j + 1])] for n in range(1, order + 1)]
            contexts = [0, *(held[tuple(padded[j - n + 1 : j])] if j > order - 1 else many for n in range(2, order + 1))]
            yield grams, contexts

    def bucket(h):
        return min(int(math.log2(h)) + 1, lm_score.BUCKETS - 1) if h else 0

    def size(held):
        return sum(v for k, v in held.items() if len(k) == 1), sum(len(k) == 1 for k in held if held[k])

    held, many = counted({0})
    tokens, distinct = size(held)

    def shares(g, h):
        """Any word, 1-gram, ...; an order without its context repeats the one below."""
        out = [1 / (distinct + 1), g[0] / tokens]
        for n in range(1, order):
            out.append(g[n] / h[n] if h[n] else out[-1])
        return out

    events = [(bucket(h[-1]), shares(g, h)) for (_, w), r in zip(texts, role, strict=True) if r == 1 for g, h in parts(w, held, many)]
    mix = [[1 / (order + 1)] * (order + 1) for _ in range(lm_score.BUCKETS)]
    last = None
    for _ in range(30):
        sums, times, fit = defaultdict(lambda: [0.0] * (order + 1)), Counter(), 0.0
        for b, p in events:
            q = [x * y for x, y in zip(mix[b], p, strict=True)]
            fit += math.log(sum(q))
            times[b] += 1
            sums[b] = [x + y / sum(q) for x, y in zip(sums[b], q, strict=True)]
        for b in times:
            mix[b] = [x / times[b] for x in sums[b]]
        if last is not None and fit - last <= 1e-5 * max(len(events), 1):
            break
        last = fit
    mix = [mix[min(times, key=lambda k: (abs(k - b), k))] for b in range(lm_score.BUCKETS)]
    held, many = counted({0, 1})
    tokens, distinct = size(held)
    want = []
    for (i, w), r in zip(texts, role, strict=True):
        score = base = known = 0
        for g, h in parts(w, held, many):
            m = mix[bucket(h[-1])]
            score += math.log10(sum(x * y for x, y in zip(m, shares(g, h), strict=True)))
            base += math.log10((g[0] + 0.5) / (tokens + 0.5 * (distinct + 1)))
            known += g[0] > 0
        want.append((i, r == 2, len(w), known, tokens, base, score))
    want.sort(key=lambda r: (r[0] or -1, r[6]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(near(a[5], b[5]) and near(a[6], b[6]) for a, b in zip(got, want, strict=True))


def test_probabilities_sum_to_one(spark):
    """Over the words, the unknown word and the end, at the beginning and after every word, known or not.

    With s the probability of a text, the chances that a text ends after x follow from u(x) = 1 / p(end | x) = 1 + sum over y of
    s(x y) / s(x) * u(y), if those after x sum to one; then the first words and the empty text sum to one exactly if those at the
    beginning do."""
    rows = [(i, t) for i, t in enumerate(["a b a", "b b a c", "c a", "a", "b c b", ""] * 4)]
    words = ["a", "b", "c", "zz"]
    probes = ["", *words, *[f"{x} {y}" for x in words for y in words]]
    docs = spark.createDataFrame(rows + [(1000 + k, t) for k, t in enumerate(probes)], "doc_id long, text string")
    for tune in (None, F.lit(False), F.lit(True)):
        got = lm_score.scores(docs, held_out=F.col("doc_id") >= 1000, tune=tune).filter("held_out").collect()
        s = {probes[r["doc_id"] - 1000]: 10 ** r["score"] for r in got}
        step = np.array([[s[f"{x} {y}"] / s[x] for y in words] for x in words])
        ends = np.linalg.solve(np.eye(4) - step, np.ones(4))
        assert (ends > 1).all() and abs(sum(s[x] * u for x, u in zip(words, ends, strict=True)) + s[""] - 1) < 1e-9


def test_nothing_to_learn_from(spark):
    """Without training text every token has probability one."""
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm_score.scores(docs, held_out=F.lit(True)).collect()
    assert [(r["score"], r["train_tokens"], r["n_known"]) for r in got] == [(0.0, 0, 0)] * 2


def test_near_duplicates(messy):
    for size, bits, radius, repeats in ((4, 64, 4, True), (5, 128, 27, False), (4, 64, 20, True)):
        got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.groups(messy, size=size, bits=bits, radius=radius, tile=3, repeats=repeats).collect()]
        prints = []
        for i, t, _, _ in ROWS:
            w = WORD.findall(low(t))
            shingles = [" ".join(w[j : j + size]).encode() for j in range(max(1, len(w) - size + 1))] if w else []
            digest = xxhash.xxh64_intdigest if bits == 64 else xxhash.xxh3_128_intdigest
            hashes = [digest(s, 42) for s in (shingles if repeats else set(shingles))]
            prints.append((i, sum(1 << b for b in range(bits) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)))
        root = list(range(len(prints)))

        def find(i, root=root):
            return i if root[i] == i else find(root[i])

        for a in range(len(prints)):
            for b in range(a):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                    root[find(a)] = find(b)
        least = {}
        for k, (i, _) in enumerate(prints):
            if i is not None:
                least[find(k)] = min(i, least.get(find(k), i))
        want = [(i, f"{p:0{bits // 4}x}", least.get(find(k))) for k, (i, p) in enumerate(prints)]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_a_dense_group_emits_a_forest():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    one = np.array([base ^ (np.uint64(1) << np.uint64(rng.integers(64))) for _ in range(1500)], dtype=np.uint64)
    one = np.unique(one)[:, None]
    far = rng.integers(0, 1 << 63, (500, 1), dtype=np.uint64)
    a, b = simhash.compared(np.concatenate((one, far)), None, 4)
    assert len(a) == len(one) - 1
    a, b = simhash.compared(one, far, 4)
    assert len(a) == 0


def test_one_of_each(messy):
    got = simhash.one_of_each(messy)
    assert got.columns == messy.columns
    rows = got.collect()
    assert len({(r["doc_id"], r["text"]) for r in rows}) == len(rows)
    ids = [r["doc_id"] for r in rows]
    assert 1 in ids and 2 not in ids and 3 not in ids and 17 in ids and 18 not in ids and 14 in ids


@pytest.mark.parametrize("how", [{}, {"hot": 1}, {"shard_words": 50}, {"gram": 1, "window": 5}, {"gram": 5, "window": 5}, {"hot": 1, "window": 12, "gram": 3}])
def test_substrings(messy, how):
    window = how.get("window", 35)
    got = [tuple(r) for r in substring_dedup.digest(substring_dedup.kept_words(messy, **how)).collect()]
    texts = [(i, WORD.findall(t or "")) for i, t, _, _ in ROWS]
    seen = Counter(tuple(w[j : j + window]) for _, w in texts for j in range(len(w) - window + 1))
    want = []
    for i, w in texts:
        gone = set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_without_repeats(messy):
    got = substring_dedup.without_repeats(messy)
    assert got.columns == messy.columns
    held = {r["doc_id"]: r for r in got.collect()}
    assert SHARED not in held[4]["text"] and held[4]["n_chars"] == len(held[4]["text"]) and held[9]["text"] == ROWS[8][1]
    assert 1 not in held and held[6]["text"] is None and held[14]["text"] == ROWS[18][1]


def test_index_counts():
    r = random.Random(5)
    text = [r.randint(1, 4) for _ in range(400)]
    index = fm_index.FMIndex(np.array([*text, 0]), np.ones(401, dtype=np.int64), 12)
    reach = fm_index.matching_statistics(index, np.array([*text, 0]), np.arange(1, 401), 12)
    for end in range(1, 401):
        best = 0
        for n in range(1, min(12, end) + 1):
            part = text[end - n : end]
            if sum(text[j : j + n] == part for j in range(401 - n)) >= 2:
                best = n
        assert reach[end - 1] == best


def test_top_k(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=6) * (1 + i % 3)]) for i in range(900)]
    rows += [(2000 + i, [1.0, 1.0, 0.5, 0.0, -1.0, 2.0]) for i in range(300)]  # one vector many times
    rows += [(5000, None), (5100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5200, [1.0, math.nan, 0.0, 0.0, 0.0, 0.0]), (5300, [1.0, math.inf, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6)]
    rows += [(5400, [0.0] * 6), (5500, [1.0, 2.0]), (5501, [2.0, 2.0]), (5600, []), (100, rows[100][1])]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, score int").repartition(4)
    got = sorted(tuple(x) for x in topk_search.top_k(frame, tile=128, block=3).collect())
    use = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in use if i % 100 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in use if i != q and len(x) == len(v))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want)


def test_pages(spark):
    long = "Some words of an article that go on for a good while, so that they look like text and not like a menu."
    cases = {
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=1>Home</a></nav><div class='ad'>Buy {long}</div><article><h1>Head &amp; more</h1>"
        f"<p>{long}<p>Short.<br>{long}</article><aside>{long}</aside><footer>&copy; {long}</footer>": f"Head & more\n{long}\nShort.\n{long}",
        f"<body><div id=menu><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div><div><h2>Title</h2><p>{long}</p><p>{long}</p></div><div class=comments><p>{long}</p></div><form><p>{long}</form>": f"Title\n{long}\n{long}",
        "": "",
        None: "",
        "<script>var x='</p>';</script>": "",
        "just &lt;text&gt;  \n here": "just <text> here",
        "<p>unclosed <b>bold <i>both": "unclosed bold both",
        "<article><header><h1>In</h1></header><p>" + long + "</p><script>1<2</script></article>": "In\n" + long,
        "<nav>only a menu</nav>": "",
        "<div>" * 3000 + long: long,
    }
    frame = spark.createDataFrame([(i, "u", h, "t") for i, h in enumerate(cases)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(frame).collect()}
    for i, want in enumerate(cases.values()):
        assert got[i] == (want, len(want)), i


def test_language(spark, messy):
    told = language_id.identify(messy).collect()
    assert len(told) == len(ROWS)
    for r in told:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (crc(r["doc_id"], 4) == 2)
    by = {r["doc_id"]: r["lang_pred"] for r in told}
    assert by[6] == by[7] == by[8] == by[19] == "und" and by[4] == "en"
    kept = language_id.accepted(messy)
    assert kept.columns == messy.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 6 not in ids and 19 not in ids and {1, 4, 9, 10, 11, 14} <= set(ids) and ids.count(11) == 3
    filled = {r["doc_id"]: r["lang"] for r in kept.collect()}
    assert filled[5] == "en"


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language_id.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_letters_bind():
    code = np.array([1 + 2 * 64 + 3 * 64 * 64, 3 + 2 * 64 + 64 * 64])
    a, b = language_id.vectors(code).astype(int)
    assert set(np.unique(a)) <= {-1, 1} and abs(a @ b) < 6 * np.sqrt(language_id.DIMENSIONS)


def distance(p, t):
    last = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        row = [i]
        for j, x in enumerate(t, 1):
            row.append(min(last[j - 1] + (c != x), last[j] + 1, row[-1] + 1))
        last = row
    return min(last)


def test_edits(spark, messy):
    r = random.Random(6)
    for _ in range(400):
        p, t = ("".join(r.choice("abc ") for _ in range(r.randint(a, 40))) for a in (1, 0))
        k = r.randint(0, len(p) - 1)
        assert decontaminate.Myers(p).ends(t, k)[0] == min(distance(p, t), k + 1)
    item = prose(20, 25)
    edited = list(item)
    for at in r.sample(range(len(item)), int(len(item) * 0.08)):
        edited[at] = "#"
    much = "".join("#" if j % 5 == 0 else c for j, c in enumerate(item))
    rows = [(1, f"{prose(21, 30)} {item.upper()} {prose(22, 9)}"), (2, f"x {''.join(edited)} y"), (3, much), (4, prose(23, 200)), (5, None), (6, ""), (1, f"{prose(21, 30)} {item.upper()} {prose(22, 9)}")]
    docs = spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (8, item), (9, None), (10, ""), (11, " \n"), (12, prose(30, 12))], "item_id long, text string")
    got = [(x["doc_id"], x["item_id"], x["distance"]) for x in decontaminate.matches(docs, items).collect()]
    exact = Counter((x[0], x[1]) for x in got)
    assert exact == {(1, 7): 2, (1, 8): 2, (2, 7): 1, (2, 8): 1}
    assert all(d == 0 for i, _, d in got if i == 1)
    for doc, text in rows:
        for i, t in ((7, item), (12, prose(30, 12))):
            near_ = bool(text) and distance(decontaminate.normal(t), decontaminate.normal(text)) <= decontaminate.budget(len(t), 0.08)
            assert near_ == ((doc, i) in exact)
    clean = decontaminate.clean(docs, items)
    assert sorted(x["doc_id"] for x in clean.collect()) == [3, 4, 5, 6] and clean.columns == docs.columns
    assert decontaminate.clean(messy, items).count() == len(ROWS)
    small = [x for held in decontaminate.blocks(items, "item_id", "text", 100) for x in held]
    assert sorted(i for i, _ in small) == [7, 8, 12]


def duck_rows(frame, sql, name):
    import duckdb

    con = duckdb.connect()
    held = frame.toArrow()
    con.register(name, held)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=str)


def spark_rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(r) for r in frame.select(*names).collect()), key=str)


def test_licenses(messy):
    got = license_scan.scan(messy)
    assert spark_rows(got) == duck_rows(messy, license_scan.oracle(), "documents")
    rows = [r for r in got.collect() if r["doc_id"] == 11]
    one = next(r for r in rows if r["n_base"])
    # released under the mit license cc by nc 4 0 apache license version 2 0 under the mit license
    assert (one["n_words"], one["n_base"], one["first_word"], one["last_word"], one["base_labels"]) == (19, 4, 1, 15, "apache-2,cc-by-nc,mit")
    assert any(r["labels"] == "gpl-3" and r["score"] == 0.9 for r in rows)


NOTICES = {
    "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "SPDX-License-Identifier: MPL-2.0": "mpl-2", "SPDX-License-Identifier: LGPL-3.0-only": "lgpl-3", "SPDX-License-Identifier: LGPL-2.1": "lgpl-2",
    "SPDX-License-Identifier: EPL-2.0": "epl-2", "SPDX-License-Identifier: Zlib": "zlib", "SPDX-License-Identifier: BSL-1.0": "bsl-1", "SPDX-License-Identifier: OFL-1.1": "ofl-1", "SPDX-License-Identifier: MIT": "mit",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2", "SPDX-License-Identifier: Apache-2.0": "apache-2", "Licensed under GPLv3": "gpl-3", "licensed under the GPLv2": "gpl-2", "Licensed under the BSD license": "bsd",
    "This project is MIT licensed.": "mit", "covered by the Apache License 2.0": "apache-2", "Released under the GNU LGPLv3.": "lgpl-3", "licensed under the GNU Affero General Public License v3.0": "agpl-3",
    "licensed under the 3-Clause BSD License": "bsd-3-clause", "Nothing is said here about any licence": "",
}


def test_common_notices(spark):
    """Notices as they stand in files, each with its label, in Spark and in SQL."""
    docs = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan(docs).collect()} == dict(enumerate(NOTICES.values()))
    assert spark_rows(license_scan.scan(docs)) == duck_rows(docs, license_scan.oracle(), "documents")


def test_rules_are_plain():
    every = license_scan.rules()
    assert len(every) > 200
    for r in every:
        re.compile(r.pattern)
        assert "   " not in r.pattern


def test_mixture(spark, messy):
    got = mixing.standard(messy, keep=["doc_id"])
    names, want = duck_rows(messy, mixing.oracle(), "documents")
    mine, rows = spark_rows(got)
    assert mine == names and len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert near(x, y) if isinstance(x, float) else x == y
    whole = mixing.standard(messy)
    assert [c for c in whole.columns if not c.startswith("mix_")] == [c for c in messy.columns if c != "mix_picked"]


def test_mixture_in_any_order(spark, messy):
    """Targets and rows in any order give the same rows to the last bit, and a whole given share leaves others nothing."""
    held = [("en", 0.5), ("de", 0.2), ("fr", 0.2), ("es", 0.1)]
    docs = messy.drop("mix_picked").withColumns({"mix_fraction": F.lit(1), "wanted": F.lit("w"), "a.b": F.lit(2), "chance": F.lit(3), "fraction": F.lit(4)})
    seen = set()
    for i, order in enumerate([(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)]):
        targets = {"lang": spark.createDataFrame([held[k] for k in order], "value string, share double").repartition(1 + i)}
        got = mixing.mixed(docs.repartition(1 + 2 * i), {"lang": F.col("lang"), "kind": mixing.topic(F.col("text"))}, targets, mixing.n_words(F.col("text")), rounds=4)
        assert got.columns == [*docs.columns, "mix_lang", "mix_kind", "mix_tokens", "mix_probability", "mix_weight", "mix_picked"]
        rows = got.collect()
        assert all(r["mix_probability"] == r["mix_weight"] == 0 for r in rows if r["mix_lang"] == mixing.MISSING)
        seen.add(str(sorted(map(tuple, rows), key=str)))
    assert len(seen) == 1


def test_shares_meet_targets(spark):
    rows = [(i, f"s{i % 3}", "xy"[i % 7 == 0], 1 + i % 5) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, kind string, n int")
    targets = {"source": spark.createDataFrame([("s0", 0.6), ("s1", 0.3), ("gone", 0.1)], "value string, share double")}
    targets["kind"] = spark.createDataFrame([("y", 0.4)], "value string, share double")
    got = mixing.mixed(docs, {"source": F.col("source"), "kind": F.col("kind")}, targets, F.col("n").cast("long"), rate=0.5).toPandas()
    weighed = got.mix_tokens * got.mix_probability * got.mix_weight
    by = (weighed.groupby(got.mix_source).sum() / weighed.sum()).to_dict()
    assert near(by["s0"], 0.6) and near(by["s1"], 0.3) and near(by["s2"], 0.1)
    assert near((weighed.groupby(got.mix_kind).sum() / weighed.sum())["y"], 0.4)
    assert near((got.mix_tokens * got.mix_probability).sum(), 0.5 * got.mix_tokens.sum())


def test_listed_urls(spark):
    rows = [
        (1, "http://User@A.Example.com:80/x/y?q#f"), (2, "https://a.example.com/x/y"), (3, "HTTPS://b.example.com./"), (4, None), (5, ""), (6, "no url"), (7, "http://host"),
        (8, "http://a.example.com/x/y/z"), (1, "http://User@A.Example.com:80/x/y?q#f"), (9, "http://c.d.e.example.org//x//y/"),
    ]
    rows += [(100 + i, f"http://w{i % 7}.many{i % 11}.example.net/p{i % 3}/q{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = url_lists.evaluate(url_queries.captures(pages), url_queries.entries(pages))
    names, want = duck_rows(pages, f"SELECT DISTINCT * FROM ({url_queries.oracle()})", "pages")
    mine, held = spark_rows(got.distinct())
    assert mine == names and [str(x) for x in held] == [str(x) for x in want]
    assert got.count() == len(rows)


def test_intervals(spark):
    said = [("l", "domain", "x", True, "2024-01-10"), ("l", "domain", "x", True, "2024-02-01"), ("l", "domain", "x", False, "2024-05-01"), ("l", "domain", "x", False, "2024-01-10"),
            ("l", "domain", "x", True, "2024-05-02"), ("l", "domain", None, True, "2024-01-01"), ("l", "domain", "x", True, None)]
    entries = spark.createDataFrame(said, "list string, kind string, value string, added boolean, at string").withColumn("at", F.to_timestamp("at"))
    got = sorted((str(r["valid_from"])[:10], str(r["valid_to"])[:10]) for r in url_lists.intervals(entries).collect())
    assert got == [("2024-02-01", "2024-05-01"), ("2024-05-02", "None")]
    days = ["2024-01-10", "2024-01-31", "2024-02-01", "2024-04-30", "2024-05-01", "2024-05-02", "2025-01-01"]
    captures = spark.createDataFrame([(d, "http://x", 3) for d in days], "at string, url string, n_active int").withColumn("at", F.to_timestamp("at"))
    told = {str(r["at"])[:10]: r["verdict"] for r in url_lists.evaluate(captures, entries, at="at", allow="none").collect()}
    assert [told[d] for d in days] == ["none", "none", "block", "block", "none", "block", "block"]


def test_empty_tables(spark, nothing):
    assert lm_score.scores(nothing).count() == 0
    assert simhash.groups(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0
    assert substring_dedup.kept_words(nothing).count() == 0 and substring_dedup.without_repeats(nothing).count() == 0
    assert language_id.identify(nothing).count() == 0 and language_id.accepted(nothing).count() == 0
    assert license_scan.scan(nothing).count() == 0 and mixing.standard(nothing).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(nothing, items).count() == 0 and decontaminate.clean(nothing, items).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(pages).count() == 0
    assert url_lists.evaluate(url_queries.captures(pages), url_queries.entries(pages)).count() == 0
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0




@pytest.mark.parametrize("block", [1 << 16, 40])
def test_one_of_each_by_shingles(spark, block):
    r = random.Random(3)
    # Unrelated texts of two to four shingles, whose fingerprints come near each other.
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(6 + i % 3))) for i in range(1500)]
    base = {i: prose(1000 + i, 10 + 2 * (i % 30)).split() for i in range(60)}
    for i, words in base.items():  # copies with changes up to and past the limit
        rows.append((2000 + 10 * i, " ".join(words)))
        for j in range(1, 5):
            cut = r.randrange(0, j + 1)
            rows.append((2000 + 10 * i + j, " ".join(words[cut:] + [f"x{i}{j}"] * (j - 1))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for held in holders.values():
        for i in held:
            for j in held:
                if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    a, b = top(i), top(j)
                    root[max(a, b)] = min(a, b)
    want = sorted(rows[i][0] for i in range(len(rows)) if top(i) == i)
    assert sorted(x["doc_id"] for x in simhash.one_of_each(docs, block=block).collect()) == want


def test_sets_of_other_sizes_are_not_compared(spark, monkeypatch):
    """A set meets those of at least four fifths of its size and at most five fourths, wherever they lie; copies of fingerprints in other sizes do no harm."""
    r = random.Random(4)
    words = [f"w{r.randrange(10**9)}" for _ in range(700)]
    sizes = (100, 112, 124, 160, 320, 640)  # the first words of one text: 100, 112 and 124 are alike by steps
    docs = spark.createDataFrame([(i, " ".join(words[:n])) for i, n in enumerate(sizes)], "doc_id long, text string")
    met, keep = [], simhash.links

    def watched(*args, **how):
        found = keep(*args, **how)
        met.extend(found.collect())
        return found

    monkeypatch.setattr(simhash, "links", watched)
    # All 128 bits may differ, so sizes alone part the sets.
    kept = simhash.one_of_each(docs, radius=128).collect()
    assert sorted(x["doc_id"] for x in kept) == [0, 3, 4, 5]
    marks = {x["fingerprint"]: x["n"] for x in simhash.shingle_sets(docs, "doc_id", "text", 5, 128).collect()}
    pairs = {tuple(sorted((marks[x["a"]], marks[x["b"]]))) for x in met}
    assert pairs and all(5 * a >= 3.8 * b for a, b in pairs)
    assert {n for p in pairs for n in p} == {96, 108, 120}


def test_main_text_keeps_links_parts_and_formulas_of_articles():
    long, short = prose(21, 300), prose(22, 45)
    page = f"<body><nav><a>Home</a></nav><article><p>{long}</p><p><a>Full report</a></p><ul><li><a>Data</a></li></ul><p>so <math><mi>a</mi><mo>=</mo><mi>b</mi></math></p></article></body>"
    assert html_extract.main_text(page) == f"{long}\nFull report\nData\nso a=b"
    parts = f"<body><section><p>{long}</p></section><section><p>{short}</p></section><div><p><a>More</a></p></div></body>"
    assert html_extract.main_text(parts) == f"{long}\n{short}"


def test_parts_of_an_article_stay():
    """What lies inside a content region stays; a class takes no word, paragraph or list out of an article but a list of another kind."""
    long, short = "A sentence of an article that goes on for a while. " * 12, "Sub part short."
    long = long.strip()
    assert html_extract.main_text(f"<body><div><p>{long}</p><div><p>{short}</p></div></div></body>") == f"{long}\n{short}"
    assert html_extract.main_text(f"<body><div><p>{long}</p><div><div><p>{short}</p></div><div class='ad'>Buy</div></div></div></body>") == f"{long}\n{short}"
    inside = '<p class="reply">Said so.</p><ul class="tags-list"><li>one</li></ul><p>A <span class="search">term</span> here.</p>'
    outside = '<div class="comments"><p>First!</p></div><ol class="comment-list"><li>Second!</li></ol><ul class="share"><li>Post</li></ul><p hidden>x</p><section class="related">More</section>'
    assert html_extract.main_text(f"<article><p>{long}</p>{inside}{outside}</article>") == f"{long}\nSaid so.\none\nA term here."
    few = "<p><a href='r.pdf'>Full report</a></p>"
    menu = "<ul><li><a>Home</a></li><li><a>News</a></li><li><a>About</a></li></ul>"
    assert html_extract.main_text(f"<body><div><p>{long}</p>{few}<p>{long}</p>{menu}</div></body>") == f"{long}\nFull report\n{long}"


def test_short_texts_of_no_language(spark):
    """The limit falls with the number of n-grams for every length: letters of no language go, short texts of one stay."""
    r = random.Random(4)
    words = {"en": "the of and that with from this have which there".split(), "de": "der die und nicht mit sich eine auch nach werden".split()}
    rows = [(4 * i + 1, " ".join(r.choices(words[g], k=60)), g) for i, g in enumerate(["en", "de"] * 20)]
    good = [(10_000 + i, " ".join(r.choices(words[g], k=k)), g) for i, (g, k) in enumerate([("en", 1), ("de", 2), ("en", 5), ("de", 20), ("en", 200)])]
    junk = [(20_000 + i, "".join(r.choices("qxzjvwkpy", k=k)), None) for i, k in enumerate([30, 60, 120, 190, 400])]
    docs = spark.createDataFrame(rows + good + junk, "doc_id long, text string, lang string")
    kept = {x["doc_id"] for x in language_id.accepted(docs).collect()}
    assert {x[0] for x in rows + good} <= kept and len(kept & {x[0] for x in junk}) <= 1


def test_items_in_a_row():
    item = prose(31, 20)
    n = len(item)
    text = "x " + " ".join([item] * 3) + " y"
    got = decontaminate.Matcher([(1, item)], 0.08).matches(text)
    assert got == [(1, 2 + i * (n + 1), 2 + i * (n + 1) + n, 0) for i in range(3)]
