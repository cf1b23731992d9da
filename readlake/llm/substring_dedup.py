"""Substring dedup by compressed FM-indexes, one per shard.

A window is `window` consecutive words. Windows that may be equal must meet in one shard, and each must meet its shard only
once, so windows are dealt by their anchor: the leftmost smallest hash of any `gram` words inside. Consecutive windows with
one anchor form a stretch. The steps:

1. Every text is cut into stretches (anchor, hash of the stretch's words, where it stands).
2. Stretches are counted by anchor and by content, partially before the shuffle. An anchor met once holds no repeat; equal
   stretches collapse to one with a multiplicity, so a group of copies of any size is one row.
3. The stretches that are left share an anchor with a different stretch. Shards of about `shard_words` words are indexed;
   each stretch met once is streamed through its shard's index by backward search, whose matching statistics tell which of
   its windows stand twice.
4. An anchor with more than `hot` different stretches (a passage that stands in a great many texts, each time with other
   words beside it) would make one task; its windows are dealt singly by their content and counted there instead.
5. Windows found are joined back to the texts, and every covered word goes.

Words are compared by 64-bit hashes, stretches by 64-bit hashes within one anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.common import identity, restored
from readlake.llm.fm_index import FMIndex, matching_statistics
from readlake.llm.words import Words, chunks, column, mixed, spans_hash, tables
from readlake.session import pinned

_GRAM_BASE = np.uint64(0x9E3779B97F4A7C15)
STRETCHES = "anchor long, content long, doc_id long, text_key long, at int, n int"


def anchors(words: Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Stretches of the texts: (text, first window, number of windows, anchor, hash of the words)."""
    n = len(hashes)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = np.zeros(n, dtype=np.uint64)
    for j in range(gram):
        grams[: n - j] = grams[: n - j] * _GRAM_BASE + hashes[j:]
    grams = mixed(grams)
    held = np.arange(n)
    width, span = 1, window - gram + 1

    def smaller(a: np.ndarray, step: int) -> np.ndarray:
        b = np.concatenate((a[step:], np.repeat(a[-1:], min(step, n))))[:n]
        return np.where(grams[b] < grams[a], b, a)  # the left one at a tie

    while width * 2 <= span:
        held, width = smaller(held, width), width * 2
    if width < span:
        held = smaller(held, span - width)
    text = words.text_of_word()
    valid = np.arange(n) + window <= words.first[text + 1]
    new = valid & np.concatenate(([True], ~valid[:-1] | (held[1:] != held[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    closes = np.flatnonzero(valid & np.concatenate((~valid[1:] | new[1:], [True]))) + 1
    many = closes - first
    return text[first], first, many, grams[held[first]], spans_hash(hashes, first, first + many + window - 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def stretches(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches):
        for table in tables(batches):
            ids, keys = column(table, "doc_id"), column(table, "text_key")
            for rows, words in chunks(column(table, "text")):
                text, first, many, anchor, content = anchors(words, words.hashes(), window, gram)
                if len(text):
                    row = pa.array(text + rows.start)
                    at = (first - words.first[text]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(anchor), _signed(content), ids.take(row), keys.take(row), pa.array(at), pa.array(many.astype(np.int32))],
                        names=["anchor", "content", "doc_id", "text_key", "at", "n"],
                    )

    return docs.mapInArrow(run, STRETCHES)


def _with_words(docs: DataFrame, picked: DataFrame, window: int) -> DataFrame:
    """The words of picked stretches, read again from the text of one document that has each."""
    per_text = picked.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "content", "copies", "hot", "at", "n")).alias("parts"))
    joined = docs.alias("d").join(
        per_text.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_key") == F.col("p.text_key"))
    )

    def run(batches):
        for table in tables(batches):
            held = column(table, "parts")
            parts, bounds = held.flatten(), np.concatenate(([0], np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))))
            at, n = (parts.field(x).to_numpy(zero_copy_only=False) for x in ("at", "n"))
            for rows, words in chunks(column(table, "text")):
                hashes = words.hashes()
                a, b = int(bounds[rows.start]), int(bounds[rows.stop])
                base = np.repeat(words.first[:-1], np.diff(bounds[rows.start : rows.stop + 1]))
                spans = [hashes[i : i + k].tobytes() for i, k in zip(base + at[a:b], n[a:b] + (window - 1), strict=True)]
                some = parts.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(some.field(x) for x in ("anchor", "content", "copies", "hot", "n")), pa.array(spans, type=pa.binary())],
                    names=["anchor", "content", "copies", "hot", "n", "words"],
                )

    read = joined.select(F.col("d.text").alias("text"), F.col("p.parts").alias("parts"))
    return read.mapInArrow(run, "anchor long, content long, copies long, hot boolean, n int, words binary")


def _shard(window: int):
    """Index a shard's stretches and stream those met once through it."""

    def run(table):
        frame = table.select(["anchor", "content", "copies", "n"]).to_pandas()
        spans = column(table, "words").to_pylist()
        keep = ~frame.duplicated(["anchor", "content"]).to_numpy()  # equal rows of documents give a stretch again
        frame, spans = frame[keep], [x for x, k in zip(spans, keep, strict=True) if k]
        length = np.array([len(x) // 8 for x in spans])
        begin = np.concatenate(([0], np.cumsum(length + 1)))
        symbols = np.zeros(int(begin[-1]), dtype=np.int64)
        _, code = np.unique(np.frombuffer(b"".join(spans), dtype=np.uint64), return_inverse=True)
        inside = np.ones(len(symbols), dtype=bool)
        inside[begin[1:] - 1] = False
        symbols[inside] = code + 1
        index = FMIndex(symbols, np.repeat(frame["copies"].to_numpy(), length + 1), window)
        once = np.flatnonzero(frame["copies"].to_numpy() == 1)
        n = frame["n"].to_numpy()[once]
        which = np.repeat(np.arange(len(once)), n)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        reach = matching_statistics(index, symbols, begin[once][which] + offset + window, window)
        mask = np.zeros(len(once), dtype=np.int64)
        hit = reach >= window
        np.bitwise_or.at(mask, which[hit], np.int64(1) << offset[hit])
        got = frame.iloc[once[mask != 0]]
        return pa.table({"anchor": pa.array(got["anchor"].to_numpy()), "content": pa.array(got["content"].to_numpy()), "mask": pa.array(mask[mask != 0])})

    return run


def _single_windows(hot: DataFrame, window: int) -> DataFrame:
    """Each window of the stretches of a hot anchor, by two hashes of its words."""

    def run(batches):
        for table in tables(batches):
            spans, many = column(table, "words").to_pylist(), column(table, "n").to_numpy(zero_copy_only=False)
            values = np.frombuffer(b"".join(spans), dtype=np.uint64)
            begin = np.concatenate(([0], np.cumsum([len(x) // 8 for x in spans])))[:-1]
            which = np.repeat(np.arange(len(many)), many)
            offset = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            start = begin[which] + offset
            row = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [
                    *(column(table, x).take(row) for x in ("anchor", "content", "copies")),
                    pa.array(offset.astype(np.int32)),
                    _signed(spans_hash(values, start, start + window)),
                    _signed(spans_hash(mixed(values), start, start + window)),
                ],
                names=["anchor", "content", "copies", "offset", "one", "two"],
            )

    return hot.mapInArrow(run, "anchor long, content long, copies long, offset int, one long, two long")


def repeated_windows(docs: DataFrame, window: int = 35, gram: int = 8, hot: int = 2000, shard_words: int = 400_000) -> DataFrame:
    """docs: (doc_id, text_key, text). (doc_id, text_key, spots): per text with any, the stretches (at, mask) whose windows
    at + bit stand elsewhere too. `window - gram` is at most 61, as a mask is one long."""
    if not 1 <= gram <= window or window - gram > 61:
        raise ValueError("a gram fits into the window, and at most 62 windows share an anchor")
    cut = pinned(stretches(docs, window, gram), "stretches")
    kinds = cut.groupBy("anchor", "content").agg(
        F.count("*").alias("copies"), F.min_by(F.struct("doc_id", "text_key", "at", "n"), F.struct("doc_id", "text_key", "at")).alias("seen")
    )
    kinds = pinned(kinds, "kinds")
    shared = kinds.groupBy("anchor").agg(F.count("*").alias("different")).filter("different > 1")
    picked = kinds.join(shared, "anchor").select("anchor", "content", "copies", (F.col("different") > hot).alias("hot"), "seen.*")
    texts = pinned(_with_words(docs, picked, window), "stretch_words")
    words = texts.filter("not hot").agg(F.sum(F.length("words") / 8)).first()[0] or 0
    shards = int(words // shard_words) + 1
    dealt = texts.filter("not hot").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    streamed = dealt.groupBy("shard").applyInArrow(_shard(window), "anchor long, content long, mask long")
    single = _single_windows(texts.filter("hot").dropDuplicates(["anchor", "content"]), window)
    often = single.groupBy("one", "two").agg(F.sum("copies").alias("times")).filter("times > 1").select("one", "two")
    single = single.filter("copies = 1").join(often, ["one", "two"], "left_semi")
    single = single.groupBy("anchor", "content").agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("mask"))
    copied = kinds.filter("copies > 1").select("anchor", "content", F.expr("shiftleft(1L, seen.n) - 1").alias("mask"))
    verdicts = streamed.unionByName(single).unionByName(copied)
    found = cut.join(verdicts, ["anchor", "content"]).select("doc_id", "text_key", "at", "mask")
    return found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "mask")).alias("spots"))


def _covered(many: int, at: np.ndarray, mask: np.ndarray, window: int) -> np.ndarray:
    """Which of a text's words lie in one of its windows."""
    step = np.zeros(many + 1, dtype=np.int64)
    bits = np.flatnonzero(np.unpackbits(mask.astype("<i8").view(np.uint8), bitorder="little"))
    starts = np.unique(at[bits >> 6] + (bits & 63))
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return np.cumsum(step[:-1]) > 0


def kept_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, carry: bool = False, **how: int) -> DataFrame:
    """(doc_id, text_key, n_words, removed, kept; with `carry` also `row` and `text`): every text without the words of windows that also start anywhere else.

    One row per row of `docs`. A null text has no words, a text shorter than a window loses none, a repeated row loses every
    window (it stands elsewhere); kept words are joined by one space. `removed` lists the spans (from, to) in words."""
    base = identity(docs, doc_id, text, carry)
    spots = repeated_windows(base.drop("row"), window, **how)
    more = ["row", "text"] if carry else []
    joined = base.alias("d").join(
        spots.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_key") == F.col("s.text_key")), "left"
    )

    def run(batches):
        for table in tables(batches):
            held = column(table, "spots")
            sizes = np.nan_to_num(held.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            parts, bounds = held.flatten(), np.concatenate(([0], np.cumsum(sizes)))
            at, mask = (parts.field(x).to_numpy(zero_copy_only=False) for x in ("at", "mask"))
            for rows, words in chunks(column(table, "text")):
                data, kept, removed = words.data.tobytes(), [], []
                for i in range(words.texts):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    j, k = int(bounds[rows.start + i]), int(bounds[rows.start + i + 1])
                    if j == k:
                        kept.append(b" ".join(data[int(words.offsets[i]) : int(words.offsets[i + 1])].split()) if b > a else b"")
                        removed.append([])
                        continue
                    gone = _covered(b - a, at[j:k], mask[j:k], window)
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
                    removed.append([{"from": int(x), "to": int(y)} for x, y in edge.reshape(-1, 2)])
                    stay = np.flatnonzero(~gone) + a
                    kept.append(b" ".join([data[x:y] for x, y in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)]))
                some = slice(rows.start, rows.stop)
                yield pa.RecordBatch.from_arrays(
                    [
                        column(table, "doc_id")[some],
                        column(table, "text_key")[some],
                        pa.array(words.counts().astype(np.int64)),
                        pa.array(removed, type=pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
                        pa.array(kept, type=pa.binary()).cast(pa.string()),
                        *(column(table, x)[some] for x in more),
                    ],
                    names=["doc_id", "text_key", "n_words", "removed", "kept", *more],
                )

    read = joined.select("d.doc_id", "d.text_key", "d.text", "s.spots", *["d.row"][: len(more)])
    shape = "doc_id long, text_key long, n_words long, removed array<struct<from:int,to:int>>, kept string"
    if carry:
        shape += f", row {base.schema['row'].dataType.simpleString()}, text string"
    return read.mapInArrow(run, shape)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, **how: int) -> DataFrame:
    """The rows of `docs` with repeated windows cut out of their texts. A text that loses nothing stays as it is, white space and
    all; one that loses every word is left out; a column n_chars is counted again where a text changed."""
    told = kept_words(docs, doc_id, text, window, carry=True, **how)
    cut = F.size("removed") > 0
    told = told.filter(~cut | (F.col("kept") != ""))
    values = {text: F.when(cut, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        held = F.col("row.n_chars")
        values["n_chars"] = F.when(cut, F.length("kept")).otherwise(held).cast(docs.schema["n_chars"].dataType)
    return restored(told, docs, text, values)


def digest(kept: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of `kept_words`."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    return kept.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def oracle(window: int = 35) -> str:
    """`digest(kept_words(documents))` in DuckDB, every window as a string."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT r, unnest(range(1, len(w) - {window - 2})) AS i, w FROM d WHERE len(w) >= {window}),
k AS (SELECT r, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS h FROM v),
often AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + j AS p FROM k JOIN often USING (h), range({window}) t(j)),
per AS (SELECT r, list(p) AS ps, count(*) AS n FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(per.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN per USING (r) LEFT JOIN kept USING (r)"""
