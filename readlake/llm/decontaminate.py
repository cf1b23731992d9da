"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from its copy in a text by k = floor(m * rate) edits. Cut into k + 1 pieces, at least one
piece must stand unchanged, so pieces are looked up exactly (one automaton for all items of a block), and each hit is
verified around its place with Myers' bit-parallel edit distance.

Texts and items are compared with A-Z lowered and white space runs as one space. Items are taken in blocks of bounded size, so
a large test set costs more passes over the texts, not more memory.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.common import identity
from readlake.llm.words import column, tables

#: Characters of items matched in one pass; an automaton takes about a hundred bytes a character.
BLOCK_CHARS = 1_000_000


def normal(text: str | None) -> str:
    """A-Z lowered; runs of space, tab, line feed, vertical tab, form feed, carriage return as one space, none at the ends."""
    return b" ".join((text or "").encode().lower().split()).decode()  # bytes know ASCII letters and white space only


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """(where it begins, piece): k + 1 pieces of nearly equal length."""
    many = budget(len(item), rate) + 1
    edge = [len(item) * i // many for i in range(many + 1)]
    return [(a, item[a:b]) for a, b in zip(edge, edge[1:], strict=False)]


class Myers:
    """Edit distance of a pattern to the best part of a text, one text character a step."""

    def __init__(self, pattern: str):
        self.length, self.bits = len(pattern), {}
        for i, c in enumerate(pattern):
            self.bits[c] = self.bits.get(c, 0) | 1 << i
        self.mask, self.top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)

    def ends(self, text: str, most: int) -> tuple[int, int]:
        """(least distance up to `most`, where the first part with it ends), or (most + 1, -1)."""
        mask, top, bits = self.mask, self.top, self.bits
        up, down, score = mask, 0, self.length
        best, at = most + 1, -1
        for j, c in enumerate(text):
            eq = bits.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | ~(xh | up) & mask, up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1 & mask, mh << 1 & mask  # the text may begin anywhere: no cost from the left
            up, down = mh | ~(xv | ph) & mask, ph & xv
            if score < best:
                best, at = score, j + 1
        return best, at


class Matcher:
    """Items of one block and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.found = [], ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            for begin, piece in pieces(text, rate):
                held.setdefault(piece, []).append((len(self.items), begin))
            self.items.append((item_id, text, budget(len(text), rate), Myers(text), Myers(text[::-1])))
        for piece, spots in held.items():
            self.found.add_word(piece, (len(piece), spots))
        if held:
            self.found.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, begin, end, distance) of the verified places, the best of overlapping ones of an item."""
        if not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, (length, spots) in self.found.iter(text):
            for which, begin in spots:
                _, item, most, _, _ = self.items[which]
                start = last + 1 - length - begin
                a, b = max(0, start - most), min(len(text), start + len(item) + most)
                held = windows.setdefault(which, [])
                if held and a <= held[-1][1] and held[-1][0] <= b and b - held[-1][0] <= 4 * len(item) + 64:
                    held[-1][0], held[-1][1] = min(a, held[-1][0]), max(b, held[-1][1])  # the same copy hit by several pieces
                else:
                    held.append([a, b])
        out = []
        for which, spans in windows.items():
            item_id, item, most, forward, backward = self.items[which]
            mine: list[tuple[int, int, int, int]] = []
            places: list[tuple[int, int, int, int]] = []
            for a, b in spans:
                rest, inside = [(a, b)], []
                while rest:  # the best place, then what is left on both sides of it
                    a, b = rest.pop()
                    if b - a < len(item) - most:
                        continue
                    distance, end = forward.ends(text[a:b], most)
                    if distance > most:
                        continue
                    end += a
                    _, back = backward.ends(text[a:end][::-1], distance)
                    begin = end - back
                    inside.append((item_id, begin, end, distance))
                    rest += [(a, begin), (end, b)]
                places += sorted(inside, key=lambda x: x[1])
            for place in places:
                if not mine or place[1] >= mine[-1][2]:
                    mine.append(place)
                elif place[3] < mine[-1][3]:
                    mine[-1] = place
            out += mine
        return out


def blocks(items: DataFrame, item_id: str, text: str, block_chars: int = BLOCK_CHARS):
    """Items without null or empty texts, in lists of at most about `block_chars` characters (one item at least). A block is the
    only part of the test set that the driver holds."""
    base = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).filter("text is not null")
    total = base.agg(F.sum(F.length("text"))).first()[0] or 0
    many = int(total // block_chars) + 1
    for k in range(many):
        part = base.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k).distinct().collect()
        held = [(r["item_id"], normal(r["text"])) for r in part]
        held = [(i, t) for i, t in held if t]
        if held:
            yield held


HIT = "doc_id long, text_key long, item_id long, begin int, end int, distance int"


def matches(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = 0.08
) -> DataFrame:
    """(doc_id, text_key, item_id, begin, end, distance): where an item stands in a text with at most floor(length * rate) edits;
    begin and end count characters of the normalised text. A null text has no match; a repeated row repeats its matches; equal
    items match under each of their ids."""
    out = None
    base = identity(docs, doc_id, text)
    for held in blocks(items, item_id, item_text):

        def run(batches, held=held):
            matcher = Matcher(held, rate)
            for table in tables(batches):
                texts, found, rows = column(table, "text"), [], []
                for i in range(table.num_rows):
                    got = matcher.matches(normal(texts[i].as_py()))
                    found += got
                    rows += [i] * len(got)
                if found:
                    take = pa.array(rows)
                    cols = np.array(found, dtype=object).T
                    yield pa.RecordBatch.from_arrays(
                        [column(table, "doc_id").take(take), column(table, "text_key").take(take), pa.array(cols[0].tolist(), type=pa.int64()), *(pa.array(c.tolist(), type=pa.int32()) for c in cols[1:])],
                        names=["doc_id", "text_key", "item_id", "begin", "end", "distance"],
                    )

        part = base.mapInArrow(run, HIT)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], HIT)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = 0.08) -> DataFrame:
    """The rows of `docs` in whose text no item stands; a null text stays. No shuffle: a row is held against all items where it is."""
    for held in blocks(items, item_id, item_text):

        def run(batches, held=held):
            matcher = Matcher(held, rate)
            for table in tables(batches):
                texts = column(table, text)
                fine = [not matcher.matches(normal(texts[i].as_py())) for i in range(table.num_rows)]
                yield from table.filter(pa.array(fine)).to_batches()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
