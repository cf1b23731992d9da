"""Near duplicates by SimHash, found by exact tiled comparison.

Every text gets a fingerprint of 64 bits (XXH64 of each word shingle) or 128 bits (XXH3): a bit is 1 if it is set in over half
of the shingles' hashes. Different fingerprints are grouped by their number of ones and dealt into tiles of about `tile`;
two tiles meet only if their numbers of ones differ by no more than the radius, since a bit flipped changes that number by at
most one. A meeting is a blockwise numpy exclusive-or with bit counts. Links inside a block that is already connected are
skipped, so a meeting emits a forest and never all pairs of a dense group; the forests are then merged by Spark joins.

Comparisons grow with the square of the number of *different* fingerprints; the shuffle of tiles with the number of meetings. For near
duplicates by similarity, tiles are of one size of set instead, and only sizes that may be alike meet.
"""

from __future__ import annotations

import math
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readlake.llm.common import identity, restored
from readlake.llm.words import Words, chunks, column, mixed, tables
from readlake.session import pinned

SEED = 42
_NO_ID = -(1 << 63)
_BLOCK = 512
#: Similarity of near duplicates, as a fraction.
NEAR = (4, 5)
#: Shingles from which a fingerprint tells unrelated texts apart. A set of fewer can be alike only to sets under SHORT.
SURE = 20
SHORT = SURE * NEAR[1] // NEAR[0]
#: Kinds of set sizes in which a set is at most NEAR[1] / NEAR[0] times as large as another.
_STEPS = 8


def _shingle_hashes(words: Words, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles as bytes (n, bits / 8), highest byte first, and the number of shingles of each text."""
    many = words.counts()
    each = np.where(many >= size, many - size + 1, np.minimum(many, 1))
    # Words joined by one space each: the place of a word there is the sum of the lengths before it.
    length = words.ends - words.starts
    place = np.concatenate(([0], np.cumsum(length + 1)))
    inside = np.zeros(len(words.data) + 1, dtype=np.int8)
    inside[words.starts] = 1
    np.add.at(inside, words.ends, -1)
    flat = words.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    joined = np.full(int(place[-1]), 0x20, dtype=np.uint8)
    if len(flat):
        joined[np.arange(len(flat)) + np.repeat(np.arange(len(length)), length)] = flat
    data = joined.tobytes()
    first = np.repeat(words.first[:-1], each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    last = np.minimum(first + size, np.repeat(words.first[1:], each))
    begin, end = place[first].tolist(), (place[last] - 1).tolist()
    if bits == 64:
        digest = xxhash.xxh64_digest
        found = b"".join([digest(data[a:b], SEED) for a, b in zip(begin, end, strict=True)])
    else:
        digest = xxhash.xxh3_128_digest
        found = b"".join([digest(data[a:b], SEED) for a, b in zip(begin, end, strict=True)])
    return np.frombuffer(found, dtype=np.uint8).reshape(-1, bits // 8), each


def _distinct(hashes: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles once; within a text 64 bits of a hash tell a shingle."""
    text = np.repeat(np.arange(len(each)), each)
    key = np.ascontiguousarray(hashes[:, :8]).view(np.uint64).ravel() + mixed(text.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(key, return_index=True)
    first.sort()
    return hashes[first], np.bincount(text[first], minlength=len(each))


def _majority(hashes: np.ndarray, each: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros((len(each), bits // 8), dtype=np.uint8)
    full = np.flatnonzero(each)
    begin = np.cumsum(each) - each
    step = 1 << 19
    for at in range(0, len(full), 256):
        rows = full[at : at + 256]
        a, b = int(begin[rows[0]]), int(begin[rows[-1]] + each[rows[-1]])
        ones = np.zeros((len(rows), bits), dtype=np.int64)
        edge = np.append(begin[rows], b)
        for x in range(a, b, step):  # a very long text is counted in parts
            y = min(b, x + step)
            i, j = int(np.searchsorted(edge, x, "right")) - 1, int(np.searchsorted(edge, y, "left"))
            cuts = np.maximum(edge[i:j], x) - x
            ones[i:j] += np.add.reduceat(np.unpackbits(hashes[x:y], axis=1), cuts, axis=0, dtype=np.int64)
        out[rows] = np.packbits(2 * ones > each[rows][:, None], axis=1)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, bits: int = 64, repeats: bool = True) -> DataFrame:
    """(doc_id, text_key, fingerprint): lower-case hex digits of the SimHash of every whole text, A-Z lowered.

    A text of fewer words than a shingle is one shingle; a text without words (null too) has fingerprint zero. A shingle that a
    text repeats counts each time, or once without `repeats`."""

    def run(batches):
        for table in tables(batches):
            for rows, words in chunks(column(table, "text"), lower=True):
                hashes, each = _shingle_hashes(words, size, bits)
                if not repeats:
                    hashes, each = _distinct(hashes, each)
                digits = _majority(hashes, each, bits).tobytes().hex()
                w = bits // 4
                yield pa.RecordBatch.from_arrays(
                    [
                        column(table, "doc_id")[rows],
                        column(table, "text_key")[rows],
                        pa.array([digits[i * w : i * w + w] for i in range(words.texts)], type=pa.string()),
                    ],
                    names=["doc_id", "text_key", "fingerprint"],
                )

    if bits not in (64, 128):
        raise ValueError("a fingerprint has 64 or 128 bits")
    return identity(docs, doc_id, text).mapInArrow(run, "doc_id long, text_key long, fingerprint string")


def ones(fingerprint: Column) -> Column:
    """Bits set in hex digits."""
    digits = F.split(F.translate(fingerprint, "0123456789abcdef", "0112122312232334"), "")
    return F.aggregate(digits, F.lit(0), lambda s, d: s + F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)))


class _Groups:
    """Which fingerprints of two tiles are connected so far."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Connect pairs; give back those that were needed."""
        x, y = self.of[a], self.of[b]
        key = np.minimum(x, y) * len(self.of) + np.maximum(x, y)
        _, first = np.unique(key, return_index=True)
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while (j := parent.get(i, i)) != i:
                parent[i] = parent.get(j, j)
                i = j
            return i

        used = []
        for k in first.tolist():
            p, q = root(int(x[k])), root(int(y[k]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                used.append(k)
        if parent:
            change = np.arange(len(self.of))
            for i in parent:
                change[i] = root(i)
            self.of = change[self.of]
        return a[used], b[used]


def compared(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the links of two tiles (rows of 64-bit words), or of one tile with itself: indexes into left, then right."""
    same = right is None
    both = left if same else np.concatenate((left, right))
    shift = 0 if same else len(left)
    other = left if same else right
    # Ones of each half, so that blocks of rows in this order can be skipped like tiles.
    half = [np.bitwise_count(both & np.uint64(m)).sum(axis=1, dtype=np.int16) for m in (0xFFFFFFFF, 0xFFFFFFFF00000000)]
    order_l = np.lexsort((half[1][: len(left)], half[0][: len(left)]))
    order_r = np.lexsort((half[1][shift:], half[0][shift:]))
    groups, out = _Groups(len(both)), []

    def ends(order: np.ndarray, base: int) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
        rows = [order[i : i + _BLOCK] + base for i in range(0, len(order), _BLOCK)]
        return [(r, [(int(h[r].min()), int(h[r].max())) for h in half]) for r in rows]

    lefts, rights = ends(order_l, 0), ends(order_r, shift)
    for i, (rl, el) in enumerate(lefts):
        a = both[rl]
        for rr, er in rights[i:] if same else rights:
            gap = sum(max(0, p[0] - q[1], q[0] - p[1]) for p, q in zip(el, er, strict=True))
            if gap > radius:
                continue
            b = both[rr]
            far = np.bitwise_count(a[:, :1] ^ b[:, 0])
            for w in range(1, a.shape[1]):
                far = far + np.bitwise_count(a[:, w : w + 1] ^ b[:, w])
            near = far <= radius
            if not near.any():
                continue
            near &= groups.of[rl][:, None] != groups.of[rr][None, :]
            # A few rows at a time: once some are connected, the rest of a dense group is no longer looked at.
            for x in range(0, len(rl), 16):
                part = near[x : x + 16]
                if part.any():
                    part = part & (groups.of[rl[x : x + 16]][:, None] != groups.of[rr][None, :])
                    p, q = np.nonzero(part)
                    if len(p):
                        out.append(groups.join(rl[x : x + 16][p], rr[q]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def links(different: DataFrame, radius: int, bits: int, tile: int = 8192, reach: int | None = None) -> DataFrame:
    """(a, b): pairs of fingerprints within the radius that connect all that are linked. `different`: one row a fingerprint. With `reach`, one row a
    fingerprint and `kind` (a number), and only those are compared whose kinds differ by no more than that."""
    kind = F.col("kind").cast("int") if reach is not None else ones(F.col("fingerprint"))
    nodes = pinned(different.select("fingerprint", kind.alias("kind")), "fingerprints")
    spark = nodes.sparkSession
    #: At most bits + 1 rows, or as many as there are kinds.
    parts = {r["kind"]: ceil(r["count"] / tile) for r in nodes.groupBy("kind").count().collect()}
    kinds = spark.createDataFrame(list(parts.items()) or [(0, 1)], "kind int, parts int")
    dealt = nodes.join(kinds, "kind").withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
    packed = dealt.groupBy("kind", "part").agg(F.unhex(F.concat_ws("", F.collect_list("fingerprint"))).alias("held"))
    packed = pinned(packed, "tiles")
    tile_ids = kinds.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meets = tile_ids.withColumn("other", F.explode(F.sequence(F.col("kind"), F.col("kind") + (radius if reach is None else reach))))
    others = kinds.select(F.col("kind").alias("other"), F.col("parts").alias("other_parts"))
    meets = meets.join(others, "other").withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    meets = meets.filter("other > kind or other_part >= part").select("kind", "part", "other", "other_part")
    # Rebalanced: a meeting is long work on a short row.
    wide = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    meets = meets.repartition(wide, "kind", "part", "other", "other_part")
    left = packed.select("kind", "part", F.col("held").alias("left"))
    right = packed.select(F.col("kind").alias("other"), F.col("part").alias("other_part"), F.col("held").alias("right"))
    pairs = meets.join(left, ["kind", "part"]).join(right, ["other", "other_part"])
    width = bits // 64

    def run(batches):
        for table in tables(batches):
            ids = [column(table, x).to_numpy(zero_copy_only=False) for x in ("kind", "other", "part", "other_part")]
            for k in range(table.num_rows):
                mine, theirs = (np.frombuffer(column(table, x)[k].as_py(), dtype=">u8").astype(np.uint64).reshape(-1, width) for x in ("left", "right"))
                same = ids[0][k] == ids[1][k] and ids[2][k] == ids[3][k]
                a, b = compared(mine, None if same else theirs, radius)
                both = mine if same else np.concatenate((mine, theirs))
                hexed = [[x.tobytes().hex() for x in both[i].astype(">u8")] for i in (a, b)]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.string()) for x in hexed], names=["a", "b"])

    return pairs.select("kind", "part", "other", "other_part", "left", "right").mapInArrow(run, "a string, b string")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node each node of (a, b) is connected to, by alternating stars. Every round halves the
    distances or better; each is written, so a lost executor costs one round at most."""
    spark = edges.sparkSession
    now = pinned(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            break
        before = state
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        star = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = pinned(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, bits: int = 64, radius: int = 4, tile: int = 8192, repeats: bool = True
) -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id, root): one row per row of `docs`; `root` names the component, `component_id` is the smallest doc_id that
    links of at most `radius` differing bits reach, the row's own included. Rows without a doc_id are grouped like others; a
    component of only such rows has a null id. Texts without words share fingerprint zero and are linked like any other."""
    marked = pinned(fingerprints(docs, doc_id, text, size, bits, repeats), "marked")
    different = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = components(links(different, radius, bits, tile))
    reached = different.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    reached = reached.withColumn("root", F.coalesce("root", "fingerprint"))
    least = reached.groupBy("root").agg(F.min("least").alias("component_id"))
    named = reached.join(least, "root").select("fingerprint", "component_id", "root")
    return marked.join(named, "fingerprint").select("doc_id", "text_key", "fingerprint", "component_id", "root")


def shingle_sets(docs: DataFrame, doc_id: str, text: str, size: int, bits: int) -> DataFrame:
    """(doc_id, text_key, set_key, fingerprint, n, short): each text's set of shingles named by 128 bits, its SimHash and its
    size; the shingles' hashes themselves only of sets under `SHORT`."""

    def run(batches):
        for table in tables(batches):
            for rows, words in chunks(column(table, "text"), lower=True):
                hashes, each = _distinct(*_shingle_hashes(words, size, bits))
                digits, w = _majority(hashes, each, bits).tobytes().hex(), bits // 4
                sets = _sorted_sets(hashes, each)
                yield pa.RecordBatch.from_arrays(
                    [
                        column(table, "doc_id")[rows],
                        column(table, "text_key")[rows],
                        pa.array([xxhash.xxh3_128_hexdigest(x.tobytes(), SEED) for x in sets], type=pa.string()),
                        pa.array([digits[i * w : i * w + w] for i in range(words.texts)], type=pa.string()),
                        pa.array(each, type=pa.int64()),
                        pa.array([x.view(np.int64) if len(x) < SHORT else None for x in sets], type=pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_key", "set_key", "fingerprint", "n", "short"],
                )

    return identity(docs, doc_id, text).mapInArrow(run, "doc_id long, text_key long, set_key string, fingerprint string, n long, short array<long>")


def _sorted_sets(hashes: np.ndarray, each: np.ndarray) -> list[np.ndarray]:
    key = np.ascontiguousarray(hashes[:, :8]).view(np.uint64).ravel()
    return [np.sort(x) for x in np.split(key, np.cumsum(each)[:-1])]


def alike(left: list[np.ndarray], right: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the pairs of sets of similarity `NEAR` or more, of two blocks or inside one: indexes into left, then right."""
    both = left if right is None else left + right
    shift = 0 if right is None else len(left)
    many = np.array([len(x) for x in both], dtype=np.int64)
    other = both[shift:]
    flat = np.concatenate(other) if other else np.zeros(0, dtype=np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(shift, len(both)), many[shift:])[order]
    groups, out = _Groups(len(both)), []
    for i, one in enumerate(left):
        if (groups.of[shift:] == groups.of[i]).all():
            continue
        a, b = np.searchsorted(flat, one, "left"), np.searchsorted(flat, one, "right")
        each = b - a
        spots = np.repeat(a, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        shared = np.bincount(owner[spots], minlength=len(both))
        near = np.flatnonzero((shared > 0) & (NEAR[1] * shared >= NEAR[0] * (many + many[i] - shared)) & (groups.of != groups.of[i]))
        if len(near):
            out.append(groups.join(np.full(len(near), i), near))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _short_links(sets: DataFrame) -> DataFrame:
    """(a, b): pairs that connect all short sets that may be alike. Alike sets share one of each's first shingles in any one
    order; the rarest come first, so that common phrases connect little."""
    each = sets.filter("n > 0 and short is not null").select("set_key", "n", F.explode("short").alias("shingle"))
    many = pinned(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "shingles")
    known = each.join(many, "shingle", "left").select("set_key", "n", F.struct(F.coalesce("copies", F.lit(1)).alias("copies"), "shingle").alias("s"))
    # n - ceil(n * NEAR) + 1 of them; those that stand once connect nothing.
    taken = f"cast(n - (n * {NEAR[0]} + {NEAR[1] - 1}) div {NEAR[1]} + 1 as int)"
    heads = known.groupBy("set_key", "n").agg(F.array_sort(F.collect_list("s")).alias("all"))
    heads = heads.select("set_key", F.explode(F.expr(f"slice(all, 1, {taken})")).alias("s")).filter("s.copies > 1").select("set_key", F.col("s.shingle").alias("shingle"))
    heads = pinned(heads, "heads")
    least = pinned(heads.groupBy("shingle").agg(F.min("set_key").alias("b")), "least")
    return heads.join(least, "shingle").filter("set_key <> b").select(F.col("set_key").alias("a"), "b")


def _candidates(sets: DataFrame, radius: int, bits: int, tile: int) -> DataFrame:
    """(a, b): pairs of set_keys that connect all sets that may be alike, and more."""
    long = sets.filter(F.col("n") >= SURE)
    firsts = pinned(long.groupBy("fingerprint").agg(F.min("set_key").alias("first")), "firsts")
    same = long.join(firsts, "fingerprint").filter("set_key <> first").select(F.col("set_key").alias("a"), F.col("first").alias("b"))
    # Alike sets are of nearly one size: the smaller has at least `NEAR` of the larger.
    ratio = math.log(NEAR[1] / NEAR[0]) / _STEPS
    kinds = long.select("fingerprint", F.floor(F.log("n") / ratio).cast("int").alias("kind")).distinct()
    near = pinned(links(kinds, radius, bits, tile, reach=_STEPS + 1), "links")  # one more, as logarithms are rounded
    near = near.join(firsts.select(F.col("fingerprint").alias("a"), F.col("first").alias("x")), "a")
    near = near.join(firsts.select(F.col("fingerprint").alias("b"), F.col("first").alias("y")), "b")
    return same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b"))).unionByName(_short_links(sets))


def _verified(docs: DataFrame, sets: DataFrame, roots: DataFrame, doc_id: str, text: str, size: int, bits: int, block: int) -> DataFrame:
    """(a, b): a forest over the pairs of alike sets of each candidate group. A group is dealt into blocks of about `block`
    shingles, and every block meets every other of its group, so no pair is left out and a task holds two blocks."""
    members = pinned(roots.join(sets, roots["node"] == sets["set_key"]).select("root", "set_key", "n", "one", "two"), "members")
    large = members.groupBy("root").agg(F.ceil(F.sum("n") / block).cast("int").alias("parts")).filter("parts > 1")
    dealt = members.join(pinned(large, "large"), "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int")).drop("n")
    base = identity(docs, doc_id, text).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("one"), F.col("text_key").alias("two"), "text")
    texts = base.join(dealt, ["one", "two"]).dropDuplicates(["one", "two"]).select("root", "parts", "part", "set_key", "text")

    def held(batches):
        for table in tables(batches):
            for rows, words in chunks(column(table, "text"), lower=True):
                sets = _sorted_sets(*_distinct(*_shingle_hashes(words, size, bits)))
                cols = [column(table, x)[rows] for x in ("root", "parts", "part", "set_key")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x.tobytes() for x in sets], type=pa.binary())], names=["root", "parts", "part", "set_key", "held"])

    known = texts.mapInArrow(held, "root string, parts int, part int, set_key string, held binary")
    packed = known.groupBy("root", "part", "parts").agg(F.collect_list(F.struct("set_key", "held")).alias("sets"))
    packed = pinned(packed, "blocks")
    wide = max(docs.sparkSession.sparkContext.defaultParallelism * 4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = packed.select("root", "part", F.explode(F.sequence("part", F.col("parts") - 1)).alias("other"))
    ids = ids.repartition(wide, "root", "part", "other")
    left = packed.select("root", "part", F.col("sets").alias("left"))
    right = packed.select("root", F.col("part").alias("other"), F.col("sets").alias("right"))
    # A block meets itself without a second copy of it.
    inside = left.select("left", F.lit(None).cast(left.schema["left"].dataType).alias("right"))
    across = ids.filter("part <> other").join(left, ["root", "part"]).join(right, ["root", "other"]).select("left", "right")

    def run(batches):
        for table in tables(batches):
            for k in range(table.num_rows):
                mine, theirs = (column(table, x)[k].as_py() for x in ("left", "right"))
                a, b = alike(*([np.frombuffer(x["held"], dtype=np.uint64) for x in y] if y is not None else None for y in (mine, theirs)))
                keys = [x["set_key"] for x in mine + (theirs or [])]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in x], type=pa.string()) for x in (a.tolist(), b.tolist())], names=["a", "b"])

    return inside.unionByName(across).mapInArrow(run, "a string, b string")


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, bits: int = 128, radius: int = 32, tile: int = 8192, block: int = 1 << 16
) -> DataFrame:
    """The rows of `docs`, one of each group of near duplicates: the one of the smallest id (null last), of repeated rows one.

    Two texts are near if their sets of shingles have a similarity (Jaccard) of 0.8 or more, counted on the sets; a group is what
    such links connect. Fingerprints only say which sets are compared. Two texts of equal length that share a part s of their
    shingles differ in about acos(s) / pi of the bits: similarity 0.8 (s = 0.89) is 19 of 128 bits with a deviation of 4, so a
    radius of 32 misses one such pair in about two thousand. Texts of few shingles have no such fingerprints (unrelated ones
    come near as well) and are found by the shingles they share."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    marked = shingle_sets(docs, doc_id, text, size, bits)
    sets = marked.groupBy("set_key").agg(F.min(first).alias("k"), *[F.first(c).alias(c) for c in ("fingerprint", "n", "short")])
    sets = sets.withColumn("one", F.coalesce("k.doc_id", F.lit(_NO_ID))).withColumn("two", F.col("k.text_key"))
    sets = pinned(sets, "sets")
    maybe = components(_candidates(sets, radius, bits, tile))
    roots = components(_verified(docs, sets, maybe, doc_id, text, size, bits, block))
    named = sets.select("set_key", "k").join(roots.withColumnRenamed("node", "set_key"), "set_key", "left")
    keys = named.groupBy(F.coalesce("root", "set_key")).agg(F.min("k").alias("k"))
    keys = keys.select(F.coalesce("k.doc_id", F.lit(_NO_ID)).alias("one"), F.col("k.text_key").alias("two"))
    base = identity(docs, doc_id, text, carry=True).withColumn("one", F.coalesce("doc_id", F.lit(_NO_ID))).withColumn("two", F.col("text_key"))
    # Dealt by the same keys, so repeated rows are dropped without another shuffle.
    kept = base.select("one", "two", "text", "row").join(keys, ["one", "two"], "left_semi").dropDuplicates(["one", "two"])
    return restored(kept, docs, text)
