"""Exact top-k inner-product search over norm-sorted vectors.

Components become whole numbers, so scores are exact. All vectors are rotated by the eigenvectors of their Gram matrix (the right
singular vectors of the data), which puts most of each product into the first coordinates. Vectors are cut into tiles by falling
length. A block of queries goes through a tile a chunk at a time, from the longest vectors on:

- a chunk is done with, and all after it, once |q| times its longest vector is below every query's k-th score (Cauchy-Schwarz);
- otherwise partial sums over the first coordinates plus the product of the rests' lengths bound each score, and only vectors whose
  bound reaches the k-th score are scored in whole numbers.

The longest tile is searched first; its k-th scores start the pruning everywhere else. Queries are a stated set (a fraction of all
rows), so blocks of queries meet tiles, and block and tile sizes bound memory. Nothing but a matrix of dimensions squared reaches
the driver.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlake.llm.words import column, tables
from readlake.session import pinned

CHUNK = 512
#: Bounds are in floating point; they are widened by this part of the largest possible product.
SLACK = 1e-9
#: Below any score; its negative is a number too.
NONE = -(1 << 62)


def whole(embedding: Column, scale: int) -> Column:
    """Components as floor(scale * x)."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(embedding: Column) -> Column:
    """No null vector, no vector without components, no null or non-finite component."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.coalesce(fine, F.lit(False))


def rotation(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each number of dimensions the eigenvectors of the Gram matrix, strongest first. Tasks sum their own rows; the sums are
    added by matrix row."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for table in tables(batches):
            held, size = column(table, "v"), column(table, "size").to_numpy()
            for d in np.unique(size).tolist():
                part = held.filter(pa.array(size == d)).flatten().to_numpy().reshape(-1, d).astype(np.float64)
                sums[d] = sums.get(d, 0) + part.T @ part
        for d, got in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, type=pa.int32()), pa.array(np.arange(d, dtype=np.int32)), pa.array(got.tolist(), type=pa.list_(pa.float64()))], names=["size", "i", "row"]
            )

    rows = vectors.select("size", "v").mapInArrow(run, "size int, i int, row array<double>")
    cells = rows.select("size", "i", F.posexplode("row").alias("j", "x")).groupBy("size", "i", "j").agg(F.sum("x").alias("x")).collect()
    out = {}
    for d in {r["size"] for r in cells}:
        gram = np.zeros((d, d))
        mine = [r for r in cells if r["size"] == d]
        gram[[r["i"] for r in mine], [r["j"] for r in mine]] = [r["x"] for r in mine]
        out[d] = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()
    return out


def _packed(size: int):
    """Rows of a task as they come, `size` at a time and one number of dimensions each: ids and components as bytes."""

    def run(batches):
        held: dict[tuple, list] = {}

        def out(key):
            ids, parts = zip(*held.pop(key), strict=True)
            v = np.concatenate(parts)
            i = np.concatenate(ids)
            long = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
            order = np.lexsort((i, -long))
            names = ["size", "n", "longest", "ids", "held"]
            return pa.RecordBatch.from_arrays(
                [pa.array([key], type=pa.int32()), pa.array([len(i)], type=pa.int32()), pa.array([float(long.max())]), pa.array([i[order].tobytes()]), pa.array([v[order].tobytes()])], names=names
            )

        for table in tables(batches):
            ids, sizes, vectors = column(table, "vec_id").to_numpy(), column(table, "size").to_numpy(), column(table, "v")
            for d in np.unique(sizes).tolist():
                mine = pa.array(sizes == d)
                i, v = ids[sizes == d], vectors.filter(mine).flatten().to_numpy().reshape(-1, d)
                for at in range(0, len(i), size):
                    held.setdefault(d, []).append((i[at : at + size], v[at : at + size]))
                    if sum(len(x) for x, _ in held[d]) >= size:
                        yield out(d)
        for d in list(held):
            yield out(d)

    return run


def search(query: np.ndarray, query_id: np.ndarray, item: np.ndarray, item_id: np.ndarray, turn: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(query, item, score) indexes of the k best items of each query, items by falling length; `floor`: scores below are of no
    use. Ties go to the smaller id; a query's own id takes no part."""
    q, x = query.astype(np.float64) @ turn, item.astype(np.float64) @ turn
    q_len, x_len = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    d = q.shape[1]
    head = max(1, d // 4)
    q_rest = np.sqrt(np.maximum(q_len**2 - (q[:, :head] ** 2).sum(axis=1), 0))
    x_rest = np.sqrt(np.maximum(x_len**2 - (x[:, :head] ** 2).sum(axis=1), 0))
    n = len(q)
    best_score = np.full((n, k), NONE)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    limit = np.full(n, -np.inf) if floor is None else floor.astype(np.float64)
    # After a small first chunk the limits are known.
    edge = [0, *range(min(64, len(x)), len(x), CHUNK), len(x)]
    for a, b in zip(edge, edge[1:], strict=False):
        slack = SLACK * q_len * x_len[a] + 1e-3
        live = np.flatnonzero(q_len * x_len[a] + slack >= limit)
        if not len(live):
            break  # all that follow are shorter
        bound = q[live, :head] @ x[a:b, :head].T + np.outer(q_rest[live], x_rest[a:b]) + slack[live, None]
        may = (bound >= limit[live, None]) & (query_id[live, None] != item_id[None, a:b])
        i, j = np.nonzero(may)
        if not len(i):
            continue
        # The rest of the sum in floating point, for those left; whole numbers decide.
        i, j = live[i], j + a
        full = (q[i] * x[j]).sum(axis=1) + slack[i] if len(i) < 20_000 else np.concatenate([(q[i[s : s + 20_000]] * x[j[s : s + 20_000]]).sum(axis=1) + slack[i[s : s + 20_000]] for s in range(0, len(i), 20_000)])
        keep = full >= limit[i]
        i, j = i[keep], j[keep]
        exact = np.concatenate([(query[i[s : s + 20_000]] * item[j[s : s + 20_000]]).sum(axis=1) for s in range(0, max(len(i), 1), 20_000)])
        rows = np.unique(i)
        row_of = np.concatenate((np.repeat(rows, k), i))
        score, ids = np.concatenate((best_score[rows].ravel(), exact)), np.concatenate((best_id[rows].ravel(), item_id[j]))
        order = np.lexsort((ids, -score, row_of))
        row_of, score, ids = row_of[order], score[order], ids[order]
        first = np.searchsorted(row_of, rows)
        take = first[:, None] + np.arange(k)
        best_score[rows], best_id[rows] = score[take], ids[take]
        worst = best_score[rows, -1]
        limit[rows] = np.maximum(limit[rows], np.where(worst > NONE, worst.astype(np.float64), -np.inf))
    at, place = np.nonzero(best_score > NONE)
    return query_id[at], best_id[at, place], best_score[at, place]


FOUND = "query_id long, vec_id long, score long"


def _met(turns: dict[int, np.ndarray], k: int):
    def run(batches):
        for table in tables(batches):
            for row in table.to_pylist():
                d = row["size"]
                query, item = (np.frombuffer(row[x], dtype=np.int64).reshape(-1, d) for x in ("q_held", "held"))
                floor = None if row["floor"] is None else np.frombuffer(row["floor"], dtype=np.int64)
                q, x, s = search(query, np.frombuffer(row["q_ids"], dtype=np.int64), item, np.frombuffer(row["ids"], dtype=np.int64), turns[d], k, floor)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(x), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run


def _floors(turns: dict[int, np.ndarray], k: int):
    """Each block of queries against the tile it was given: the k-th scores, which no later find may be below."""

    def run(batches):
        for table in tables(batches):
            out = []
            for row in table.to_pylist():
                d = row["size"]
                query, item = (np.frombuffer(row[x], dtype=np.int64).reshape(-1, d) for x in ("q_held", "held"))
                ids = np.frombuffer(row["q_ids"], dtype=np.int64)
                at = {v: i for i, v in enumerate(ids.tolist())}
                q, _, s = search(query, ids, item, np.frombuffer(row["ids"], dtype=np.int64), turns[d], k)
                which = np.array([at[v] for v in q.tolist()], dtype=np.int64)
                many, low = np.bincount(which, minlength=len(ids)), np.full(len(ids), np.iinfo(np.int64).max)
                np.minimum.at(low, which, s)
                out.append(np.where(many >= k, low, NONE).tobytes())
            yield pa.RecordBatch.from_arrays([column(table, "block"), pa.array(out, type=pa.binary())], names=["block", "floor"])

    return run


def top_k(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    queries: Column | None = None,
    k: int = 10,
    scale: int = 1024,
    tile: int = 2048,
    block: int = 1024,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product with each query, fewer if there are fewer.

    Queries: rows with `queries` true (default: the id is divisible by 100). Rows with a null id, a null or empty vector, or a null
    or non-finite component take no part; vectors of another number of dimensions are no candidates. A query's own id is left out;
    equal rows of a query give one answer, equal ids of candidates are candidates each. Scores are exact while they fit a long."""
    queries = F.col(vec_id) % 100 == 0 if queries is None else queries
    base = vectors.withColumn("_query", queries).filter(F.col(vec_id).isNotNull() & usable(F.col(embedding)))
    base = base.select(F.col(vec_id).cast("long").alias("vec_id"), whole(F.col(embedding), scale).alias("v"), F.col("_query").alias("is_query"))
    base = base.withColumn("size", F.size("v")).withColumn("squares", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    base = pinned(base, "vectors")
    turns = rotation(base)
    spark = base.sparkSession
    counts = base.agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q")).first()
    tiles = max(1, ceil(counts["n"] / tile))
    blocks = max(1, ceil((counts["q"] or 0) / block))
    shape = "size int, n int, longest double, ids binary, held binary"
    sorted_ = base.repartitionByRange(tiles, F.desc("squares"), "vec_id").select("vec_id", "size", "v")
    item = pinned(sorted_.mapInArrow(_packed(2 * tile), shape).withColumn("tile", F.monotonically_increasing_id()), "vector_tiles")
    asked = base.filter("is_query").select("vec_id", "size", "v").dropDuplicates(["vec_id", "v"])
    asked = asked.repartition(blocks, "vec_id").select("vec_id", "size", "v")
    asked = asked.mapInArrow(_packed(2 * block), shape).withColumn("block", F.monotonically_increasing_id())
    asked = asked.select("block", "size", F.col("ids").alias("q_ids"), F.col("held").alias("q_held"), F.col("longest").alias("q_longest"))
    asked = pinned(asked, "query_blocks")
    first = item.groupBy("size").agg(F.max_by("tile", "longest").alias("tile"))
    start = asked.join(first, "size").join(item.select("tile", "ids", "held"), "tile")
    floors = pinned(start.select("block", "size", "q_ids", "q_held", "ids", "held").mapInArrow(_floors(turns, k), "block long, floor binary"), "floors")
    # Which blocks meet which tiles: by numbers alone; the bytes are joined to them after.
    meets = asked.select("block", "size").join(item.select("tile", "size"), "size")
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    meets = meets.repartition(wide, "tile", "block")
    pairs = meets.join(item.select("tile", "ids", "held"), "tile").join(asked.drop("size", "q_longest"), "block").join(floors, "block", "left")
    found = pairs.select("size", "q_ids", "q_held", "ids", "held", "floor").mapInArrow(_met(turns, k), FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 10, scale: int = 1024) -> str:
    """`top_k(embeddings)` in DuckDB, every query with every vector."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s) WHERE rank <= {k}"""
