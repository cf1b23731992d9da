"""Ranked lexical search for many items at once; what items share is worked out once.

The items are the queries. Their terms are counted in a first pass over all documents, which also writes, batch by batch, the
documents' terms that some item may hold (told by a bitmap of fixed size). Items are then dealt into blocks, neighbours sharing a term,
and a plan is mined for each block. Terms that stand in the same items of the block are one atom; in every item the atoms come in
one order, the most shared first, and a pair of neighbours that stands in two items or more becomes a node of its own, again and
again, until no pair is shared. That is a directed graph without cycles: atoms, nodes over two nodes, items over what is left.

For every batch of documents the atoms' partial sums are laid out once, nodes add up two rows, items add up their rows. A task
keeps the best k of each item, so a shuffle carries k rows per item and task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readlake.llm.common import identity
from readlake.llm.words import GAPS, chunks, column, tables
from readlake.operators import ranking
from readlake.session import pinned

#: Bits of a term's hash that say whether some item may hold it.
_BITS = 20
#: Numbers held at a time: rows of the graph times documents.
_CELLS = 1 << 22
#: Stands for a null doc_id, after all others.
_LAST = np.iinfo(np.int64).max
POSTINGS = "n_docs long, n_terms long, docs binary, sizes binary, many binary, terms binary, times binary"


def _counted(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (of, key) in order, and how often each occurs."""
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], of[first], np.diff(first, append=len(keys))


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, item_key, term, copies): the terms of each different (item_id, text), as hashes, and how often each occurs."""

    def run(batches):
        for table in tables(batches):
            for rows, words in chunks(column(table, "text"), lower=True, space=GAPS):
                term, of, copies = _counted(words.hashes(), words.text_of_word())
                named = [column(table, x)[rows].take(pa.array(of)) for x in ("doc_id", "text_key")]
                cols = [*named, pa.array(term.view(np.int64)), pa.array(copies)]
                yield pa.RecordBatch.from_arrays(cols, names=["item_id", "item_key", "term", "copies"])

    each = identity(items, item_id, text).mapInArrow(run, "item_id long, item_key long, term long, copies long")
    return each.dropDuplicates(["item_id", "item_key", "term"])


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Which values of the first bits occur: at most 2 ** _BITS numbers reach the driver."""
    held = np.zeros(1 << _BITS, dtype=bool)
    held[terms.select(F.shiftrightunsigned("term", 64 - _BITS).alias("at")).distinct().toArrow().column("at").to_numpy()] = True
    return held


def postings(docs: DataFrame, wanted: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every few megabytes of texts: documents with a term and all their terms; and, packed, the documents that hold
    terms `wanted`, their sizes in terms, how many of those terms each has, the terms and how often they occur."""

    def run(batches):
        for table in tables(batches):
            for rows, words in chunks(column(table, "text"), lower=True, space=GAPS):
                size = words.counts()
                hashes, of = words.hashes(), words.text_of_word()
                may = wanted[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)]
                term, of, times = _counted(hashes[may], of[may])
                found, many = np.unique(of, return_counts=True)
                ids = column(table, "doc_id")[rows].fill_null(int(_LAST)).to_numpy(zero_copy_only=False)
                packed = [ids[found].astype(np.int64), size[found].astype(np.int64), many.astype(np.int32), term, times.astype(np.int32)]
                cols = [pa.array([int((size > 0).sum())]), pa.array([int(size.sum())]), *(pa.array([x.tobytes()], type=pa.binary()) for x in packed)]
                yield pa.RecordBatch.from_arrays(cols, names=["n_docs", "n_terms", "docs", "sizes", "many", "terms", "times"])

    return identity(docs, doc_id, text).select("doc_id", "text").mapInArrow(run, POSTINGS)


def document_counts(held: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(term, df) of the postings, counted inside the tasks first."""

    def run(batches):
        terms, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

        def passed():
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], names=["term", "df"])

        for table in tables(batches):
            for packed in column(table, "terms"):
                new = np.frombuffer(packed.as_py(), dtype=np.uint64)
                both = np.concatenate((terms, new))
                terms, which = np.unique(both, return_inverse=True)
                counts = np.bincount(which, np.concatenate((counts, np.ones(len(new), dtype=np.int64))), len(terms)).astype(np.int64)
                if len(terms) > most:
                    yield passed()
                    terms, counts = terms[:0], counts[:0]
        if len(terms):
            yield passed()

    return held.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def shared_plan(items: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[str, np.ndarray | list]:
    """The graph of a block of items, each given as (terms, copies, weights).

    terms: sorted. For a term: `atom_edge` into (atoms, weights), as its copies may stand in several atoms. rounds: for each round of
    merging the two children of each new node; a node's number is the atoms' count plus its place. An item: `item_edge` into nodes."""
    terms = np.unique(np.concatenate([t for t, _, _ in items])) if items else np.zeros(0, dtype=np.uint64)
    # The k-th copy of a term is a symbol of its own, so items with more copies share the first ones.
    of_item = np.repeat(np.arange(len(items)), [int(c.sum()) for _, c, _ in items])
    flat = [(np.repeat(np.searchsorted(terms, t), c), np.concatenate([np.arange(k) for k in c.tolist()] or [np.zeros(0, np.int64)]), np.repeat(w, c)) for t, c, w in items]
    term, copy, weight = (np.concatenate([x[k] for x in flat]) if flat else np.zeros(0, np.int64) for k in range(3))
    order = np.lexsort((of_item, copy, term))
    term, copy, weight, of_item = term[order], copy[order], weight[order], of_item[order]
    begin = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (copy[1:] != copy[:-1])))) if len(term) else np.zeros(0, np.int64)
    ends = np.append(begin[1:], len(term))
    # Symbols of the same items are one atom.
    atoms: dict[bytes, int] = {}
    atom = np.array([atoms.setdefault(of_item[a:b].tobytes(), len(atoms)) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)], dtype=np.int64)
    pair, where = np.unique(term[begin] * max(1, len(atoms)) + atom, return_inverse=True)
    weights = np.zeros(len(pair), dtype=np.int64)
    np.add.at(weights, where, weight[begin])
    # Each item's atoms, the most shared first.
    members = [np.frombuffer(k, dtype=of_item.dtype) for k in atoms]
    shared = np.array([len(m) for m in members], dtype=np.int64)
    rank = np.lexsort((np.arange(len(members)), -shared))
    item = np.concatenate([members[a] for a in rank]) if len(rank) else np.zeros(0, np.int64)
    node = np.repeat(rank, shared[rank])
    order = np.argsort(item, kind="stable")
    item, node = item[order], node[order]
    rounds: list[tuple[np.ndarray, np.ndarray]] = []
    nodes = len(members)
    while True:
        inside = np.flatnonzero(item[1:] == item[:-1])
        pairs, which, many = np.unique(node[inside] * max(1, nodes) + node[inside + 1], return_inverse=True, return_counts=True)
        left, right = np.divmod(pairs, max(1, nodes))
        chosen, used = {}, set()
        for k in np.argsort(-many, kind="stable").tolist():
            if many[k] < 2:
                break
            a, b = int(left[k]), int(right[k])
            if a not in used and b not in used:
                used.update((a, b))
                chosen[k] = nodes + len(chosen)
        if not chosen:
            break
        picked = list(chosen)
        rounds.append((left[picked], right[picked]))
        new = np.full(len(pairs), -1, dtype=np.int64)
        new[picked] = list(chosen.values())
        new = new[which]
        at = inside[new >= 0]
        node = node.copy()
        node[at] = new[new >= 0]
        keep = np.ones(len(node), dtype=bool)
        keep[at + 1] = False
        item, node, nodes = item[keep], node[keep], nodes + len(chosen)
    return {
        "terms": terms,
        "atom_edge": np.searchsorted(pair // max(1, len(atoms)), np.arange(len(terms) + 1)),
        "atoms": pair % max(1, len(atoms)),
        "weights": weights,
        "n_atoms": len(members),
        "rounds": rounds,
        "nodes": node,
        "item_edge": np.searchsorted(item, np.arange(len(items) + 1)),
    }


def _mined(table: pa.Table) -> pa.Table:
    """The plan of a block of items."""
    rows = table.to_pylist()
    held = [(np.array(r["terms"], dtype=np.int64).view(np.uint64), np.array(r["copies"], dtype=np.int64), np.array(r["weights"], dtype=np.int64)) for r in rows]
    plan = {"ids": [r["item_id"] for r in rows], "keys": [r["item_key"] for r in rows], **shared_plan(held)}
    return pa.table({"plan": pa.array([pickle.dumps(plan)], type=pa.binary())})


def plans(lists: DataFrame, block_terms: int) -> DataFrame:
    """(plan): items (item_id, item_key, lead, size, terms, copies, weights) in the order of `lead`, in blocks of about `block_terms` terms, a block's
    plan each. Where a block begins is told by a running sum over sizes, slice by slice of `lead`."""
    sizes = ranking.running(lists.select("item_id", "item_key", "lead", "size"), [], F.shiftright("lead", 54), ["lead", "item_key", "item_id"], {"upto": F.col("size")}, inclusive=False)
    block = sizes.select(F.col("item_id").alias("_id"), F.col("item_key").alias("_key"), F.floor(F.col("upto") / block_terms).alias("block"))
    dealt = lists.join(block, F.col("item_id").eqNullSafe(F.col("_id")) & (F.col("item_key") == F.col("_key")))
    return dealt.select("block", "item_id", "item_key", "terms", "copies", "weights").groupBy("block").applyInArrow(_mined, "plan binary")


def accumulated(plan: dict, size: np.ndarray, many: np.ndarray, terms: np.ndarray, times: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(items, documents): the scores of a few documents."""
    docs = len(size)
    place = np.searchsorted(plan["terms"], terms)
    known = np.flatnonzero(plan["terms"][np.minimum(place, len(plan["terms"]) - 1)] == terms)
    doc, place, times = np.repeat(np.arange(docs), many)[known], place[known], times[known].astype(np.int64)
    m = 25 + (75 * size[doc] * n_docs) // n_terms
    part = (1_000_000_000 * times) // (1000 * times + 8 * m)
    # A posting goes to every atom that its term's copies stand in.
    begin = plan["atom_edge"][place]
    each = plan["atom_edge"][place + 1] - begin
    spot = np.repeat(begin - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    atom, value = plan["atoms"][spot], plan["weights"][spot] * np.repeat(part, each)
    # Rows only for what occurs in these documents; row 0 is nothing.
    nodes = plan["n_atoms"] + sum(len(a) for a, _ in plan["rounds"])
    live = np.zeros(nodes, dtype=bool)
    live[atom] = True
    at = plan["n_atoms"]
    for a, b in plan["rounds"]:
        live[at : at + len(a)] = live[a] | live[b]
        at += len(a)
    row = np.where(live, np.cumsum(live), 0)
    sums = np.zeros((int(live.sum()) + 1, docs), dtype=np.int64)
    np.add.at(sums.ravel(), row[atom] * docs + np.repeat(doc, each), value)
    at = plan["n_atoms"]
    for a, b in plan["rounds"]:
        mine = live[at : at + len(a)]
        sums[row[at : at + len(a)][mine]] = sums[row[a[mine]]] + sums[row[b[mine]]]
        at += len(a)
    out = np.zeros((len(plan["ids"]), docs), dtype=np.int64)
    left = row[plan["nodes"]]
    item = np.repeat(np.arange(len(out)), np.diff(plan["item_edge"]))[left > 0]
    left = left[left > 0]
    if len(left):
        first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        # A few rows at a time, as an item may be over many nodes.
        step = max(1, _CELLS // docs)
        at = 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(first, first[at] + step, "right")) - 1)
            end = first[to] if to < len(first) else len(left)
            out[item[first[at:to]]] = np.add.reduceat(sums[left[first[at] : end]], first[at:to] - first[at], axis=0)
            at = to
    return out


def _batches_of(table: pa.Table, rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The postings of a table in runs of documents."""
    for k in range(table.num_rows):
        ids, size, many, terms, times = (np.frombuffer(column(table, n)[k].as_py(), dtype=t) for n, t in (("docs", np.int64), ("sizes", np.int64), ("many", np.int32), ("terms", np.uint64), ("times", np.int32)))
        edge = np.concatenate(([0], np.cumsum(many)))
        for a in range(0, len(ids), rows):
            b = min(len(ids), a + rows)
            yield ids[a:b], size[a:b], many[a:b], terms[edge[a] : edge[b]], times[edge[a] : edge[b]]


def _best(packed: bytes, k: int, n_docs: int, n_terms: int):
    def run(batches):
        plan = pickle.loads(packed)
        n = len(plan["ids"])
        nodes = plan["n_atoms"] + sum(len(a) for a, _ in plan["rounds"])
        best, names = np.zeros((n, k), dtype=np.int64), np.full((n, k), _LAST)
        rows = max(16, _CELLS // max(1, nodes))
        for table in tables(batches):
            for ids, *held in _batches_of(table, rows):
                scores = accumulated(plan, *held, n_docs, n_terms)
                least = np.maximum(best[:, -1], 1)
                if len(ids) > k:
                    least = np.maximum(least, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
                i, j = np.nonzero(scores >= least[:, None])
                if not len(i):
                    continue
                some = np.unique(i)
                of = np.concatenate((np.repeat(some, k), i))
                score, name = np.concatenate((best[some].ravel(), scores[i, j])), np.concatenate((names[some].ravel(), ids[j]))
                order = np.lexsort((name, -score, of))
                of, score, name = of[order], score[order], name[order]
                take = np.searchsorted(of, some)[:, None] + np.arange(k)
                best[some], names[some] = score[take], name[take]
        i, j = np.nonzero(best > 0)
        ids = names[i, j]
        cols = [
            pa.array([plan["ids"][x] for x in i.tolist()], type=pa.int64()),
            pa.array([plan["keys"][x] for x in i.tolist()], type=pa.int64()),
            pa.array(ids, mask=ids == _LAST),
            pa.array(best[i, j]),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["item_id", "item_key", "doc_id", "score"])

    return run


def ranked(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = 10,
    block_terms: int = 100_000,
) -> DataFrame:
    """(item_id, item_key, rank, doc_id, score): for each different (item_id, text) of `items` the k rows of `docs` of the highest
    score above 0, fewer if there are fewer, equal scores by rising doc_id.

    Terms are runs of digits, letters and characters outside ASCII, A-Z lowered. With N the rows that have a term, L all terms, n a row's
    terms, df the rows with a term and tf its occurrences: the sum over the item's terms, repeats included, of
    floor(1000 ln((2N+2)/(2df+1))) * ((10^9 tf) div (1000 tf + 8 (25 + (75 n N) div L))). Null texts have no terms; an item without a
    known term has no rows. Repeated rows of `docs` are ranked each; a null doc_id comes last among equals. Items of one id
    and different texts have an answer each, told apart by item_key. Both ids must cast to long."""
    asked = pinned(item_terms(items, item_id, item_text), "item_terms")
    held = pinned(postings(docs, _bitmap(asked), doc_id, text), "postings", compression="zstd")
    total = held.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = int(total["n"] or 0), max(1, int(total["l"] or 0))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    known = asked.join(document_counts(held), "term").withColumn("weight", weight).filter("weight > 0")
    one = F.struct("term", "copies", "weight")
    lists = known.groupBy("item_id", "item_key").agg(F.sort_array(F.collect_list(one)).alias("all"), F.min("term").alias("lead"), F.sum("copies").alias("size"))
    lists = pinned(lists.select("item_id", "item_key", "lead", "size", *[F.col(f"all.{x}").alias(y) for x, y in (("term", "terms"), ("copies", "copies"), ("weight", "weights"))]), "items")
    mined = pinned(plans(lists, block_terms), "plans")
    place = F.row_number().over(Window.partitionBy("item_id", "item_key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))

    def answered(plan: bytes) -> DataFrame:
        found = held.select("docs", "sizes", "many", "terms", "times").mapInArrow(_best(plan, k, n_docs, n_terms), "item_id long, item_key long, doc_id long, score long")
        return found.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "item_key", "rank", "doc_id", "score")

    # One plan at a time: the driver never holds more than a block of the items.
    out = [pinned(answered(bytes(r["plan"])), "ranked") for r in mined.toLocalIterator()]
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id long, item_key long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)


def oracle(docs: str = "documents", items: str = "benchmark", k: int = 10) -> str:
    """`ranked` in DuckDB, without item_key, for items whose ids are unique."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({low}, '{term}') AS w FROM {docs} WHERE text IS NOT NULL),
s AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
tot AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM s),
i AS (SELECT item_id, t, count(*)::BIGINT AS copies FROM (SELECT DISTINCT item_id, text FROM {items}), unnest(regexp_extract_all({low}, '{term}')) u(t) GROUP BY ALL),
p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY 1), tot),
x AS (SELECT p.r, p.t, f.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))) AS v FROM p JOIN f USING (t) JOIN s USING (r), tot),
g AS (SELECT item_id, r, sum(copies * v)::BIGINT AS score FROM x JOIN i USING (t) GROUP BY ALL HAVING sum(copies * v) > 0)
SELECT * FROM (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM g JOIN s USING (r)) WHERE rank <= {k}"""
