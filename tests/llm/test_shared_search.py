"""Search of many items at once against plain scores, and the plan's graph against the items it stands for."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from readlake.llm import queries, shared_search
from tests.compare import compare, duck
from tests.llm.conftest import BASE, ROWS, SHARED

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SHAPE = "item_id long, text string, doc_id long, score int"
ITEMS = [
    (1, SHARED), (2, SHARED + " " + BASE), (3, BASE.upper()), (4, None), (5, ""), (6, "nothing-known-anywhere qqq"), (7, "the the the of a a b Öl ß \U0001f600 MIT 2"), (8, "license"),
    (9, "License, license!"), (1, "another text of the same id"), (1, SHARED), (None, "word"), (10, " ".join(["a b c"] * 300)),
]


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * n) // max(total, 1)
            v = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) * x for t, x in Counter(terms(text)).items() if t in c)
            if v > 0:
                scores.append((-v, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_terms", [100_000, 40])
def test_ranked(spark, messy, nothing, block_terms):
    items = spark.createDataFrame([(i, t, 5, 1) for i, t in ITEMS], SHAPE)
    got = shared_search.ranked(messy, items, block_terms=block_terms)
    assert sorted((tuple(r) for r in got.drop("item_key").collect()), key=str) == plain([(i, t) for i, t, _, _ in ROWS], ITEMS)
    if block_terms > 100:
        assert shared_search.ranked(messy, items.limit(0)).collect() == [] == shared_search.ranked(nothing, items).collect()


def test_graph_adds_up():
    """The sum of an item's nodes is the sum of its terms, whatever is shared."""
    r = random.Random(5)
    for _ in range(60):
        words = [r.sample(range(30), r.randrange(1, 12)) for _ in range(4)]
        items = []
        for _ in range(r.randrange(1, 25)):
            c = Counter(x for w in r.sample(words, r.randrange(1, 4)) for x in w) + Counter(r.choices(range(40), k=r.randrange(6)))
            t = np.array(sorted(c), dtype=np.uint64)
            items.append((t, np.array([c[int(x)] for x in t]), (t * 7 + 3).astype(np.int64)))
        plan = shared_search.shared_plan(items)
        # A node as the count of each term's weight below it.
        below = [Counter() for _ in range(plan["n_atoms"])]
        for i, t in enumerate(plan["terms"].tolist()):
            for k in range(plan["atom_edge"][i], plan["atom_edge"][i + 1]):
                below[plan["atoms"][k]][t] += int(plan["weights"][k])
        used = Counter()
        for a, b in plan["rounds"]:
            below += [below[x] + below[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            used.update([*a.tolist(), *b.tolist()])
        for i, (t, copies, w) in enumerate(items):
            mine = sum((below[n] for n in plan["nodes"][plan["item_edge"][i] : plan["item_edge"][i + 1]]), Counter())
            assert mine == Counter({int(x): int(c * y) for x, c, y in zip(t, copies, w, strict=True)})
        # No pair of neighbours is left that two items share.
        item = np.repeat(np.arange(len(items)), np.diff(plan["item_edge"]))
        pairs = Counter(zip(plan["nodes"][:-1][item[1:] == item[:-1]].tolist(), plan["nodes"][1:][item[1:] == item[:-1]].tolist(), strict=True))
        assert all(n == 1 for n in pairs.values())


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    compare(spark, duck(folder), folder, "op11_shared_search", queries.QUERIES["op11_shared_search"], queries.ORACLE["op11_shared_search"])
