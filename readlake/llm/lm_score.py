"""N-gram language-model scores by deleted interpolation.

p(w | h) = sum over n of weight[bucket][n] * c(h_n w) / c(h_n), and weight[bucket][0] / (V + 1) for any word at all. The bucket
is the power of two of the longest context's count. Weights come from expectation-maximisation over the training texts that
are set aside (`tune`), with counts of the other training texts; scores then use the counts of all training texts.

The counts are as large as the corpus, so they are never gathered or broadcast. Texts become blocks of a few megabytes with
their words as numbers. A block asks for each of its n-grams once; requests are dealt by key, counted, and answered to the
block. Keys are sorted in a block and parts are ranges of keys, so an answer is a plain array in the order of the question.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm.common import crc
from readlake.llm.words import chunks, column, give_back, mixed, tables
from readlake.session import pinned

LEARN, TUNE, OTHER = 0, 1, 2
_END, _BEGIN = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_STEP = np.uint64(0x9E3779B97F4A7C15)
BUCKETS = 24
BLOCK = "block long, role int, doc_id array<long>, n_tokens binary, keys binary, codes binary, entries array<long>"


def _packed(x: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes: the high ones are mostly zero and compress away."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(held: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(held, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def blocks(docs: DataFrame, order: int, size: int) -> DataFrame:
    """docs: (doc_id, role, text). The texts of one role in blocks; each word and the end of each text is a token."""

    def run(batches):
        for table in tables(batches):
            roles = column(table, "role").to_numpy(zero_copy_only=False)
            for role in np.unique(roles):
                part = table.filter(pa.array(roles == role)).combine_chunks()
                for rows, words in chunks(column(part, "text"), lower=True, limit=size):
                    many = words.counts()
                    at = words.first[1:] + np.arange(words.texts)  # where each text's end stands
                    tokens = np.empty(len(words) + words.texts, dtype=np.uint64)
                    inside = np.ones(len(tokens), dtype=bool)
                    inside[at] = False
                    tokens[inside], tokens[at] = words.hashes(), _END
                    keys, code, times = np.unique(tokens, return_inverse=True, return_counts=True)
                    often = np.argsort(-times, kind="stable")
                    rank = np.empty(len(keys), dtype=np.int64)
                    rank[often] = np.arange(len(keys))
                    block = _Block(keys[often], rank[code], many + 1)
                    entries = [len(keys), *(len(block.grams(n)[0]) for n in range(2, order + 1))]
                    yield pa.RecordBatch.from_pylist(
                        [
                            {
                                "block": uuid.uuid4().int >> 65,
                                "role": int(role),
                                "doc_id": column(part, "doc_id")[rows].to_pylist(),
                                "n_tokens": _packed(many + 1),
                                "keys": block.keys.tobytes(),
                                "codes": _packed(block.codes),
                                "entries": entries,
                            }
                        ],
                        schema=pa.schema(
                            [("block", pa.int64()), ("role", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.binary()), ("keys", pa.binary()), ("codes", pa.binary()), ("entries", pa.list_(pa.int64()))]
                        ),
                    )
                    del words, tokens, inside, keys, code, times, often, rank, block
                    give_back()

    return docs.mapInArrow(run, BLOCK)


@dataclass
class _Block:
    keys: np.ndarray
    codes: np.ndarray
    many: np.ndarray

    @classmethod
    def of(cls, keys: bytes, codes: bytes, many: bytes) -> _Block:
        return cls(np.frombuffer(keys, dtype=np.uint64), _unpacked(codes), _unpacked(many))

    def first(self) -> np.ndarray:
        """Whether a token begins its text."""
        out = np.zeros(len(self.codes), dtype=bool)
        out[np.cumsum(self.many) - self.many] = True
        return out

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams ending at the tokens, sorted, and which of them each token ends."""
        if n == 1:
            order = np.argsort(self.keys)
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            return self.keys[order], place[self.codes]
        tokens, first = self.keys[self.codes], self.first()
        held, gone = tokens.copy(), np.zeros(len(tokens), dtype=bool)
        for j in range(1, n):
            gone[j - 1 :] |= first[: len(first) - j + 1]  # the text began fewer than j tokens before
            before = np.concatenate((np.repeat(_BEGIN, min(j, len(tokens))), tokens[: len(tokens) - j]))
            held = held * _STEP + np.where(gone, _BEGIN, before)
        return np.unique(mixed(held + np.uint64(n)), return_inverse=True)


def requests(held: DataFrame, order: int, parts: list[int]) -> DataFrame:
    """(n, part, block, role, keys, times): what each block asks, in ranges of keys."""

    def run(batches):
        for table in tables(batches):
            for row in table.select(["block", "role", "keys", "codes", "n_tokens"]).to_pylist():
                block = _Block.of(row["keys"], row["codes"], row["n_tokens"])
                for n in range(1, order + 1):
                    keys, which = block.grams(n)
                    times = np.bincount(which, minlength=len(keys))
                    part = ((keys >> np.uint64(32)) * np.uint64(parts[n - 1]) >> np.uint64(32)).astype(np.int64)
                    edge = np.flatnonzero(np.diff(part)) + 1
                    edge = [0, *edge.tolist(), len(keys)]
                    k = len(edge) - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(k, n, dtype=np.int32)),
                            pa.array(part[edge[:-1]].astype(np.int32)),
                            pa.array(np.full(k, row["block"], dtype=np.int64)),
                            pa.array(np.full(k, row["role"], dtype=np.int32)),
                            pa.array([keys[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], type=pa.binary()),
                            pa.array([_packed(times[a:b]) for a, b in zip(edge, edge[1:], strict=False)], type=pa.binary()),
                        ],
                        names=["n", "part", "block", "role", "keys", "times"],
                    )
                    del keys, which, times, part
                del block
                give_back()

    return held.mapInArrow(run, "n int, part int, block long, role int, keys binary, times binary")


def _answer(table):
    """Counts of one range of keys: learned and all training texts', given back to each block that asked; the row without a
    block has the totals (n, distinct and occurrences, learned and all)."""
    asked, times = column(table, "keys").to_pylist(), column(table, "times").to_pylist()
    roles = column(table, "role").to_numpy(zero_copy_only=False)
    each = np.array([len(x) // 8 for x in asked])
    keys = np.frombuffer(b"".join(asked), dtype=np.uint64)
    some, which = np.unique(keys, return_inverse=True)
    much = np.concatenate([_unpacked(x) for x in times])
    role = np.repeat(roles, each)
    learned = np.bincount(which, much * (role == LEARN), len(some)).astype(np.int64)
    trained = np.bincount(which, much * (role != OTHER), len(some)).astype(np.int64)
    edge = np.concatenate(([0], np.cumsum(each)))
    n, part = column(table, "n")[0].as_py(), column(table, "part")[0].as_py()
    back = [which[a:b] for a, b in zip(edge, edge[1:], strict=False)]
    k = len(back) + 1
    totals = [int((learned > 0).sum()), int(learned.sum()), int((trained > 0).sum()), int(trained.sum())]
    del asked, keys, some, which, much, role
    give_back()
    return pa.table(
        {
            "block": pa.concat_arrays([column(table, "block"), pa.nulls(1, pa.int64())]),
            "n": pa.array([n] * k, type=pa.int32()),
            "part": pa.array([part] * k, type=pa.int32()),
            "learned": pa.array([_packed(learned[i]) if r == TUNE else None for i, r in zip(back, roles, strict=True)] + [None], type=pa.binary()),
            "trained": pa.array([_packed(trained[i]) for i in back] + [None], type=pa.binary()),
            "totals": pa.array([None] * len(back) + [totals], type=pa.list_(pa.int64())),
        }
    )


ANSWER = "block long, n int, part int, learned binary, trained binary, totals array<long>"


def _counts(block: _Block, answers: pa.Table, name: str, order: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each n: which n-gram each token ends, its count, and its context's count."""
    ns, parts = (column(answers, x).to_numpy(zero_copy_only=False) for x in ("n", "part"))
    held = column(answers, name)
    first = block.first()
    starts = np.flatnonzero(first)
    which, count, context = [], [], []
    for n in range(1, order + 1):
        rows = np.flatnonzero(ns == n)
        rows = rows[np.argsort(parts[rows])]
        of = np.concatenate([_unpacked(held[int(i)].as_py()) for i in rows])
        keys, at = block.grams(n)
        which.append(at)
        count.append(of[at])
        if n == 1:
            texts = int(of[np.searchsorted(keys, _END)])  # each text has one end, and one beginning
            context.append(np.zeros(len(at), dtype=np.int64))
            continue
        before = np.concatenate(([0], count[n - 2][:-1]))
        before[starts] = texts
        context.append(before)
    return which, count, context


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def _tuning(order: int):
    names = [f"c{n}" for n in range(1, order + 1)] + [f"h{n}" for n in range(2, order + 1)]

    def run(left, right):
        out = []
        for row in left.select(["keys", "codes", "n_tokens"]).to_pylist():
            block = _Block.of(row["keys"], row["codes"], row["n_tokens"])
            which, count, context = _counts(block, right.combine_chunks(), "learned", order)
            _, seen, times = np.unique(which[-1], return_index=True, return_counts=True)
            held = [c[seen] for c in count] + [h[seen] for h in context[1:]]
            out.append(pa.table({x: pa.array(v) for x, v in zip(names, held, strict=True)} | {"times": pa.array(times)}))
        return pa.concat_tables(out) if out else pa.table({x: pa.array([], type=pa.int64()) for x in [*names, "times"]})

    return run, ", ".join(f"{x} long" for x in [*names, "times"])


def learned_weights(events: DataFrame, order: int, distinct: int, tokens: int, rounds: int, close: float) -> list[list[float]]:
    """Expectation-maximisation: for each bucket the weights of (any word, 1-gram, ..., n-gram). One pass of Spark a round; only
    `BUCKETS * (order + 1)` sums reach the driver."""
    longest = F.col(f"h{order}") if order > 1 else F.lit(0)
    bucket = F.when(longest > 0, F.least(F.floor(F.log2(longest)) + 1, F.lit(BUCKETS - 1))).otherwise(0).cast("int")
    any_word = F.lit(1.0 / (distinct + 1))
    parts: list[Column] = [any_word, F.col("c1") / F.lit(float(tokens)) if tokens else any_word]
    for n in range(2, order + 1):  # after a context that was never seen the order below speaks
        parts.append(F.when(F.col(f"h{n}") > 0, F.col(f"c{n}") / F.col(f"h{n}")).otherwise(parts[-1]))
    weights = [[1.0 / (order + 1)] * (order + 1) for _ in range(BUCKETS)]
    last, seen = None, []
    for _ in range(rounds):
        table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in weights])
        mine = F.element_at(table, F.col("bucket") + 1)
        frame = events.select(bucket.alias("bucket"), "times", *[p.alias(f"p{i}") for i, p in enumerate(parts)])
        frame = frame.select("bucket", "times", *[(F.col(f"p{i}") * mine[i]).alias(f"p{i}") for i in range(order + 1)])
        whole = sum((F.col(f"p{i}") for i in range(1, order + 1)), F.col("p0"))
        sums = [F.sum(F.col("times") * F.col(f"p{i}") / whole).alias(f"s{i}") for i in range(order + 1)]
        got = frame.groupBy("bucket").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.log(whole)).alias("fit"), *sums).collect()
        for r in got:
            weights[r["bucket"]] = [r[f"s{i}"] / r["n"] for i in range(order + 1)]
        seen = [r["bucket"] for r in got]
        fit, n = sum(r["fit"] for r in got), sum(r["n"] for r in got)
        if last is not None and fit - last <= close * max(n, 1):
            break
        last = fit
    # A bucket without an event has the weights of the nearest one with any, the lower of two; equal weights stay where none has.
    return [weights[min(seen, key=lambda k: (abs(k - b), k))] if seen else weights[b] for b in range(BUCKETS)]


def scores(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    held_out: Column | None = None,
    tune: Column | None = None,
    order: int = 2,
    rounds: int = 30,
    close: float = 1e-5,
    block_bytes: int = 5 << 20,
    part_entries: int = 700_000,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`.

    `held_out` rows teach nothing (default: crc32 of the id modulo 5 is 1); `tune` says which of the others teach the mixture
    weights (default: a tenth, by another part of the crc32). A null text is the empty text, one end token; a null id counts as
    the empty text in crc32. An order whose context was never seen leaves its weight to the order below, so the probabilities after any
    context sum to one; a bucket of contexts that no tuning text has takes the weights of the nearest that some has, and equal weights
    stand if there is no tuning text. Without training text every token has probability 1 / (V + 1) = 1."""
    key = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    held_out = crc(F.col(doc_id), 5) == 1 if held_out is None else held_out
    tune = F.pmod(F.floor(key / 5), F.lit(10)) == 0 if tune is None else tune
    role = F.when(held_out, OTHER).when(tune, TUNE).otherwise(LEARN).cast("int")
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), role.alias("role"), F.col(text).alias("text"))
    # Wide rows: a block is made from what one batch holds, and the codec keeps no buffer outside the heap.
    batch, spark = "spark.sql.execution.arrow.maxBytesPerBatch", docs.sparkSession
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(3 * block_bytes))
    try:
        held = pinned(blocks(read, order, block_bytes), "lm_blocks", compression="zstd")
    finally:
        spark.conf.set(batch, before)
    entries = held.agg(*[F.sum(F.col("entries")[n]).alias(f"e{n}") for n in range(order)]).first()
    parts = [int((e or 0) // part_entries) + 1 for e in entries]
    asked = requests(held.select("block", "role", "keys", "codes", "n_tokens"), order, parts)
    answers = pinned(asked.groupBy("n", "part").applyInArrow(_answer, ANSWER), "lm_counts", compression="zstd")
    total = answers.filter("block is null and n = 1").agg(*[F.sum(F.col("totals")[i]).alias(f"t{i}") for i in range(4)]).first()
    distinct_learned, learned, distinct, tokens = (int(x or 0) for x in total)
    tuning, shape = _tuning(order)
    tuned = held.filter(F.col("role") == TUNE).select("block", "keys", "codes", "n_tokens").groupBy("block")
    given = answers.filter("learned is not null").select("block", "n", "part", "learned").groupBy("block")
    events = tuned.cogroup(given).applyInArrow(tuning, shape)
    names = [x.split()[0] for x in shape.split(", ")][:-1]
    events = pinned(events.groupBy(*names).agg(F.sum("times").alias("times")), "lm_events")
    weights = learned_weights(events, order, distinct_learned, learned, rounds, close)

    def score(left, right):
        give_back()
        mix, out = np.array(weights), []
        for row in left.to_pylist():
            block = _Block.of(row["keys"], row["codes"], row["n_tokens"])
            _, count, context = _counts(block, right.combine_chunks(), "trained", order)
            mine = mix[_bucket(context[-1])]
            part = count[0] / tokens if tokens else np.full(len(mine), 1 / (distinct + 1))
            p = mine[:, 0] / (distinct + 1) + mine[:, 1] * part
            for n in range(2, order + 1):
                part = np.where(context[n - 1] > 0, count[n - 1] / np.maximum(context[n - 1], 1), part)
                p += mine[:, n] * part
            begin = np.cumsum(block.many) - block.many
            base = np.log10((count[0] + 0.5) / (tokens + 0.5 * (distinct + 1)))
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(row["doc_id"], type=pa.int64()),
                        "held_out": pa.array([row["role"] == OTHER] * len(begin)),
                        "n_tokens": pa.array(block.many),
                        "n_known": pa.array(np.add.reduceat((count[0] > 0).astype(np.int64), begin)),
                        "train_tokens": pa.array([tokens] * len(begin), type=pa.int64()),
                        "base_score": pa.array(np.add.reduceat(base, begin)),
                        "score": pa.array(np.add.reduceat(np.log10(p), begin)),
                    }
                )
            )
        return pa.concat_tables(out)

    given = answers.filter("block is not null").select("block", "n", "part", "trained").groupBy("block")
    return (
        held.select("block", "role", "doc_id", "keys", "codes", "n_tokens")
        .groupBy("block")
        .cogroup(given)
        .applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
