"""Token ids of whole texts in compressed files, in rising order of doc_id, and back.

Rows are dealt by ranges of (doc_id, text) and sorted inside a range; a task turns its texts into ids and closes a segment after
about `segment` ids, at the end of a text. A segment is one row of the file format of `context_coder` with the ids of its
documents and how many token ids each has, so files can be read from any of them on. What stands before a segment is a sum over
counts only.

Texts are cut where the vocabulary's own rules never join: at the white space of ASCII, and between a letter of ASCII and a sign
that is no apostrophe. Each different piece goes to the tokenizers library once while a worker remembers it (pieces are told
apart by 64-bit hashes, those of ASCII alone by their small letters, which is how the rules see them). A word that may hold a
special token, which is looked up before the rules, stays whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readlake.llm import context_coder
from readlake.llm.common import identity
from readlake.llm.words import Words, chunks, column, give_back, tables
from readlake.session import pinned

VOCABULARY = "word_bpe_49k.json"
END = 2
#: Pieces a worker remembers.
REMEMBERED = 800_000
#: Stands alone between words that are encoded together.
_BREAK = "\x00"
_LETTER, _SIGN = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
SEGMENTS = "part int, seq int, doc_ids array<long>, many array<long>, n_ids long, segment binary"


def _file(vocabulary: str) -> str:
    if os.path.isabs(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def _with(places: np.ndarray, more: np.ndarray, size: int) -> np.ndarray:
    """Both in rising order, each once: a cut where the next text begins stands there already."""
    held = np.zeros(size, dtype=bool)
    held[places] = held[more] = True
    return np.flatnonzero(held)


def pieces(words: Words) -> Words:
    """Words cut further between a letter of ASCII and a sign, pieces of ASCII alone in small letters."""
    data = words.data
    special = np.searchsorted(words.starts, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), "right") - 1  # "<|"
    cuts = np.flatnonzero(_LETTER[data[:-1]] & _SIGN[data[1:]]) + 1
    if len(special):
        cuts = cuts[~np.isin(np.searchsorted(words.starts, cuts, "right") - 1, special)]
    starts, ends = (_with(x, cuts, len(data) + 1) for x in (words.starts, words.ends))
    as_is = np.zeros(len(starts), dtype=bool)  # with a byte outside ASCII
    as_is[np.searchsorted(starts, np.flatnonzero(data >= 128), "right") - 1] = True
    if len(special):
        as_is |= np.isin(np.searchsorted(words.starts, starts, "right") - 1, special)
    large = np.flatnonzero((data - np.uint8(65)) < 26)
    large = large[~as_is[np.searchsorted(starts, large, "right") - 1]]
    if len(large):
        data = data.copy()
        data[large] += 32
    return Words(data, words.offsets, starts, ends, np.searchsorted(starts, words.offsets))


class Encoder:
    """Ids of texts, piece by piece. For vocabularies that make letters small, split at white space and drop it, and split
    between letters and signs."""

    def __init__(self, vocabulary: str = VOCABULARY):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(_file(vocabulary))
        mark = self.library.encode(_BREAK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.start, self.many = np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=np.int64)
        self.pool, self.used = np.zeros(1 << 12, dtype=np.int32), 0

    def _encoded(self, words: list[str], plain: bool) -> list[list[int]]:
        """plain: no word holds the break."""
        out: list[list[int]] = [[]] * len(words)
        together = list(range(len(words))) if plain and self.mark is not None else [i for i, w in enumerate(words) if self.mark is not None and _BREAK not in w]
        groups = [together[i : i + 256] for i in range(0, len(together), 256)]
        held = self.library.encode_batch_fast([f" {_BREAK} ".join(words[i] for i in g) for g in groups], add_special_tokens=False)
        alone = sorted(set(range(len(words))) - set(together))
        for g, e in zip(groups, held, strict=True):
            ids = e.ids
            edge = [-1, *(k for k, x in enumerate(ids) if x == self.mark), len(ids)]
            if len(edge) != len(g) + 1:  # a rule of this vocabulary joined words: each by itself
                alone += g
                continue
            for i, a, b in zip(g, edge, edge[1:], strict=False):
                out[i] = ids[a + 1 : b]
        for i, e in zip(alone, self.library.encode_batch_fast([words[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _learn(self, words: Words, keys: list[int], at: np.ndarray) -> None:
        data = words.data.tobytes()
        spans = zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)
        found = self._encoded([data[a:b].decode() for a, b in spans], b"\x00" not in data)
        many = np.array([len(x) for x in found], dtype=np.int64)
        n, extra = len(self.slots), int(many.sum())
        while n + len(keys) > len(self.many):
            self.start, self.many = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.many))
        while self.used + extra > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + extra] = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=extra)
        self.start[n : n + len(keys)] = self.used + np.cumsum(many) - many
        self.many[n : n + len(keys)] = many
        self.slots.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.used += extra

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts end to end, and how many each text has."""
        words = pieces(words)
        if len(self.slots) > REMEMBERED:
            self._forget()
        which, keys = pd.factorize(words.hashes())
        first = np.empty(len(keys), dtype=np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]  # the first of equal ones is written last
        slot = np.fromiter(map(self.slots.get, keys.tolist(), repeat(-1)), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(slot < 0)
        if len(new):
            n = len(self.slots)
            self._learn(words, keys[new].tolist(), first[new])
            slot[new] = np.arange(n, n + len(new))
        slot = slot[which]
        many = self.many[slot]
        spot = np.arange(int(many.sum())) + np.repeat(self.start[slot] - (np.cumsum(many) - many), many)
        upto = np.concatenate(([0], np.cumsum(many)))
        return self.pool[spot], upto[words.first[1:]] - upto[words.first[:-1]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One for each vocabulary and worker; what it remembers serves the worker's later tasks."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def segments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END, segment: int = 1 << 22, block: int = 1024) -> DataFrame:
    """The rows of the token files, one a segment: where it stands (part, seq), its documents, how many ids each has (with the
    end id), and the bytes.

    A null or empty text has the end id only. Rows without a doc_id come first; rows of one doc_id follow each other in the
    order of their texts' hashes; repeated rows are each written. No rows: no segments. One text is the smallest unit of a
    segment, however long it is; doc_id must cast to long."""

    def run(batches):
        tool, part, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
        ids, many, names, held = [], [], [], 0

        def closed():
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], type=pa.int32()),
                    pa.array([seq], type=pa.int32()),
                    pa.array([[x for n in names for x in n]], type=pa.list_(pa.int64())),
                    pa.array([np.concatenate(many)], type=pa.list_(pa.int64())),
                    pa.array([held], type=pa.int64()),
                    pa.array([context_coder.encode(np.concatenate(ids), block)], type=pa.binary()),
                ],
                names=["part", "seq", "doc_ids", "many", "n_ids", "segment"],
            )
            give_back()
            return out

        for table in tables(batches):
            for rows, words in chunks(column(table, "text")):
                found, each = tool.ids(words)
                ids.append(np.insert(found, np.cumsum(each), end))
                many.append(each + 1)
                names.append(column(table, "doc_id")[rows].to_pylist())
                held += len(ids[-1])
                if held >= segment:
                    yield closed()
                    seq, ids, many, names, held = seq + 1, [], [], [], 0
        if held:
            yield closed()

    rows = identity(docs, doc_id, text).repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    return rows.select("doc_id", "text").mapInArrow(run, SEGMENTS)


def write(docs: DataFrame, path: str, **options) -> None:
    """The token files of `docs` below `path`, which every executor can reach. `options` are those of `segments`."""
    segments(docs, **options).write.parquet(path)


def _based(held: DataFrame) -> DataFrame:
    """Segments with `base`, the ids of all segments before. Sums inside a part, then over the parts: counts only."""
    counts = held.select("part", "seq", "n_ids")
    before = (Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("whole"))
    parts = parts.select("part", F.coalesce(F.sum("whole").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*before)), F.lit(0))
    bases = counts.withColumn("inside", inside).join(parts, "part").select("part", "seq", (F.col("ahead") + F.col("inside")).alias("base"))
    return held.join(bases, ["part", "seq"])


def _documents(batches) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, ids, edges, starts) of each segment."""
    for table in tables(batches):
        for k in range(table.num_rows):
            row = {n: column(table, n)[k] for n in ("doc_ids", "many", "base", "segment")}
            edge = np.concatenate(([0], np.cumsum(row["many"].values.to_numpy(zero_copy_only=False))))
            ids = context_coder.decode(row["segment"].as_py())
            if len(ids) != edge[-1]:
                raise ValueError("a segment and its list of documents differ")
            yield row["doc_ids"].as_py(), ids, edge, edge[:-1] + row["base"].as_py()
            give_back()


def read(held: DataFrame) -> DataFrame:
    """(doc_id, start, ids): the documents of token files, one row each."""

    def run(batches):
        for names, ids, edge, start in _documents(batches):
            lists = pa.ListArray.from_arrays(pa.array(edge, type=pa.int32()), pa.array(ids, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.int64()), pa.array(start), lists], names=["doc_id", "start", "ids"])

    return _based(held).select("doc_ids", "many", "base", "segment").mapInArrow(run, "doc_id long, start long, ids array<int>")


def digests(held: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): as `read`, with the crc32 of each document's ids as little-endian u32."""

    def run(batches):
        for names, ids, edge, start in _documents(batches):
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False)]
            cols = [pa.array(names, type=pa.int64()), pa.array(start), pa.array(np.diff(edge)), pa.array(crc, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _based(held).select("doc_ids", "many", "base", "segment").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """`digests` of the token files of `docs`, written to the shared folder and read back."""
    return digests(pinned(segments(docs, **options), "token_files", compression="none"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """`read` of what `write` left below `path`."""
    return read(spark.read.schema(SEGMENTS).parquet(path))
