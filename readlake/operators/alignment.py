"""Two readings of one passage laid side by side: the runs of characters they share, in order in both.

A passage's two readings stand in one row and stay there. Candidates are k-grams that stand once in each reading; neighbours on one
diagonal join to runs; the heaviest rising chain of a passage's runs is a fold over them, sorted; runs then grow to both sides while
the characters agree. What is left between the runs of a chain goes through the same steps with shorter grams, at last with
grams that stand several times as well.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.session import pinned

RUN = "struct<at:int,to:int,size:int>"
LINK = "struct<score:int,at:int,to:int,size:int,before:int>"
#: Gram lengths of the rounds, and in how many pairs of places a gram may stand.
GRAMS = ((12, 1), (4, 1), (4, 1), (4, 1024))


def shared_runs(a: str, b: str, k: int, most: int) -> list[tuple[int, int, int]]:
    """(at, to, size), sorted: runs of grams of length k that stand once in each text, or in up to `most` pairs of places, place by place."""
    grams: dict[str, tuple[list[int], list[int]]] = {}
    for i in range(len(a) - k + 1):
        grams.setdefault(a[i : i + k], ([], []))[0].append(i)
    for j in range(len(b) - k + 1):
        if found := grams.get(b[j : j + k]):
            found[1].append(j)
    steps = sorted((i - j, i) for left, right in grams.values() if len(left) * len(right) <= most for i in left for j in right)
    out: list[list[int]] = []
    before = (0, -1)
    for d, i in steps:
        if before == (d, i - 1) and out:
            out[-1][2] += 1
        else:
            out.append([i, i - d, k])
        before = (d, i)
    return sorted(map(tuple, out))


def _chain(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """`heaviest_chain` of a list of runs."""
    links: list[tuple[int, int]] = []  # the weight up to a run, and the run before it
    for n, (at, to, size) in enumerate(found):
        best = (-1, -1)
        for i in range(n):
            p, q, many = found[i]
            lap = max(0, p + many - at, q + many - to)
            if p < at and q < to and lap < size:
                best = max(best, (links[i][0] + size - lap, i))
        links.append(best if best[0] > size else (size, -1))
    here, rising = max((weight, i) for i, (weight, _) in enumerate(links))[1] if links else -1, []
    while here >= 0:
        rising.append(found[here])
        here = links[here][1]
    out: list[tuple[int, int, int]] = []
    for at, to, size in reversed(rising):
        lap = max(0, out[-1][0] + out[-1][2] - at, out[-1][1] + out[-1][2] - to) if out else 0
        out.append((at + lap, to + lap, size - lap))
    return out


def grown(runs: list[tuple[int, int, int]], a: str, b: str) -> list[tuple[int, int, int]]:
    """Runs made longer while the characters agree: to the next run, then back to the one before; then those without a gap in either text as one."""
    longer, out = [], []
    for n, (at, to, size) in enumerate(runs):
        stop_a, stop_b = (runs[n + 1][0], runs[n + 1][1]) if n + 1 < len(runs) else (len(a), len(b))
        while at + size < stop_a and to + size < stop_b and a[at + size] == b[to + size]:
            size += 1
        longer.append((at, to, size))
    for n, (at, to, size) in enumerate(longer):
        floor_a, floor_b = (longer[n - 1][0] + longer[n - 1][2], longer[n - 1][1] + longer[n - 1][2]) if n else (0, 0)
        while at > floor_a and to > floor_b and a[at - 1] == b[to - 1]:
            at, to, size = at - 1, to - 1, size + 1
        if out and out[-1][0] + out[-1][2] == at and out[-1][1] + out[-1][2] == to:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + size)
        else:
            out.append((at, to, size))
    return out


def chained(a: str, b: str, k: int, most: int = 1) -> Column:
    """The heaviest chain of the runs of two texts, grown, as an array of RUN."""

    def one(x: str, y: str) -> list[dict]:
        found = shared_runs(x, y, k, most)
        return [dict(zip(("at", "to", "size"), r, strict=True)) for r in grown(_chain(found) if len(found) > 1 else found, x, y)]

    def read(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(left, right, strict=True)], dtype=object)

    return F.pandas_udf(read, f"array<{RUN}>")(a, b)


def heaviest_chain(found: Column) -> Column:
    """Of runs sorted by their place in the first text, those of the heaviest chain that rises in both; a run that laps over the one
    before gives way."""

    def lap(q: Column, x: Column) -> Column:
        return F.greatest(F.lit(0), q["at"] + q["size"] - x["at"], q["to"] + q["size"] - x["to"])

    def linked(chain: Column, x: Column) -> Column:
        fits = lambda q: (q["at"] < x["at"]) & (q["to"] < x["to"]) & (lap(q, x) < x["size"])
        weighed = F.transform(chain, lambda q, i: F.struct(F.when(fits(q), q["score"] + x["size"] - lap(q, x)).otherwise(-1).alias("score"), i.alias("i")))
        best = F.array_max(weighed)
        joins = F.coalesce(best["score"] > x["size"], F.lit(False))
        score, before = F.when(joins, best["score"]).otherwise(x["size"]), F.when(joins, best["i"]).otherwise(-1)
        return F.concat(chain, F.array(F.struct(score.alias("score"), x["at"].alias("at"), x["to"].alias("to"), x["size"].alias("size"), before.alias("before")).cast(LINK)))

    links = F.aggregate(found, F.array().cast(f"array<{LINK}>"), linked)
    end = lambda ls: F.array_max(F.transform(ls, lambda q, i: F.struct(q["score"].alias("score"), i.alias("i"))))["i"]

    def walked(state: Column, q: Column) -> Column:
        return F.struct(F.when(state["next"] >= 0, F.get(state["links"], state["next"])["before"]).otherwise(-1).alias("next"), state["links"].alias("links"), F.when(
            state["next"] >= 0, F.concat(F.array(F.struct(*[F.get(state["links"], state["next"])[c].alias(c) for c in ("at", "to", "size")]).cast(RUN)), state["all"])
        ).otherwise(state["all"]).alias("all"))

    start = lambda ls: F.struct(F.coalesce(end(ls), F.lit(-1)).alias("next"), ls.alias("links"), F.array().cast(f"array<{RUN}>").alias("all"))
    chain = F.transform(F.array(links), lambda ls: F.aggregate(ls, start(ls), walked, lambda s: s["all"]))[0]

    def apart(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        cut = F.when(F.size(done) > 0, lap(last, x)).otherwise(0)
        return F.concat(done, F.array(F.struct((x["at"] + cut).alias("at"), (x["to"] + cut).alias("to"), (x["size"] - cut).alias("size")).cast(RUN)))

    return F.aggregate(chain, F.array().cast(f"array<{RUN}>"), apart)


def runs(passages: DataFrame, keys: list[str], a: str, b: str, least: int) -> DataFrame:
    """(keys, at, to, size): runs of `least` characters or more that texts `a` and `b` of a passage share, rising in both and never
    lapping over. Null texts are empty."""
    parts, out = passages.select(*keys, F.lit(0).alias("_at"), F.lit(0).alias("_to"), F.coalesce(a, F.lit("")).alias("_a"), F.coalesce(b, F.lit("")).alias("_b")), []
    named = [*keys, "_at", "_to"]
    for turn, (k, most) in enumerate(GRAMS):
        met = parts.filter((F.length("_a") >= least) & (F.length("_b") >= least)).withColumn("_chain", chained("_a", "_b", k, most))
        met = pinned(met, "chains")
        one = met.select(*named, F.explode("_chain").alias("_r"))
        out.append(one.select(*keys, (F.col("_at") + F.col("_r.at")).alias("at"), (F.col("_to") + F.col("_r.to")).alias("to"), F.col("_r.size").alias("size")))
        if turn + 1 == len(GRAMS):
            break
        # The gaps of the chain, both ends included; passages without a chain stay whole.
        ends = F.concat(F.array(F.lit(None).cast(RUN)), "_chain")
        starts = F.concat("_chain", F.array(F.struct(F.length("_a").alias("at"), F.length("_b").alias("to"), F.lit(0).alias("size")).cast(RUN)))
        gaps = met.select(*named, "_a", "_b", F.explode(F.arrays_zip(ends.alias("p"), starts.alias("q"))).alias("_z"))
        begin = {c: F.coalesce(F.col(f"_z.p.{c}") + F.col("_z.p.size"), F.lit(0)) for c in ("at", "to")}
        cut = lambda text, c: F.substr(text, begin[c] + 1, F.greatest(F.col(f"_z.q.{c}") - begin[c], F.lit(0)))
        parts = gaps.select(*keys, (F.col("_at") + begin["at"]).alias("_at"), (F.col("_to") + begin["to"]).alias("_to"), cut("_a", "at").alias("_a"), cut("_b", "to").alias("_b"))
    return reduce(DataFrame.unionByName, out).filter(F.col("size") >= least)
