"""Words of many texts at once, as byte positions and 64-bit hashes in numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. These bytes never
occur inside a longer UTF-8 character, so cutting bytes is cutting characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed together; the tables of powers are this long.
CHUNK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a term: all of ASCII but digits and letters.
GAPS = np.arange(256) < 0x80
GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240131)
#: One random odd-or-even 64-bit value for each byte: the letters of the polynomial.
_BYTE = _RANDOM.integers(1, 1 << 64, 256, dtype=np.uint64)
#: Odd, so that it has an inverse modulo 2**64.
_BASE = int(_RANDOM.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
_WORD_BASE = int(_RANDOM.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    have, step = 1, base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(step)
        have += take
        step = step * step & (2**64 - 1)
    return out


@lru_cache(maxsize=4)
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2**64."""
    return _powers(base, size), _powers(pow(base, -1, 2**64), size)


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > CHUNK:
        return _powers(base, n), _powers(pow(base, -1, 2**64), n)
    up, down = powers(base, CHUNK)
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Every input bit spread over all 64 output bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _WORD_BASE) -> np.ndarray:
    """A 64-bit hash of each values[start:end], from prefix sums of one polynomial."""
    n = len(values)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _tables(base, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Some texts end to end: `data[starts[w]:ends[w]]` is word w, text i has the words first[i] to first[i + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; runs of words are taken so that few bytes are held at a time."""
        out = np.empty(len(self), dtype=np.uint64)
        at = 0
        while at < len(self):
            base = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, base + CHUNK, "right")))
            part = _BYTE[self.data[base : int(self.ends[to - 1])]]
            out[at:to] = spans_hash(part, self.starts[at:to] - base, self.ends[at:to] - base, _BASE)
            at = to
        return out


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column end to end, and where each text begins; null is the empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return held[int(at[0]) : int(at[-1])] if len(at) else held[:0], at - at[0]


def cut(data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE) -> Words:
    """`space`: for each byte, whether it stands between words."""
    if lower:
        data = LOWER[data]
    space = space[data]
    begin = np.zeros(len(data) + 1, dtype=bool)
    begin[offsets] = True  # a text's first byte begins a word, whatever the byte before it
    word = ~space
    starts = np.flatnonzero(word & (np.concatenate(([True], space[:-1])) | begin[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(word & (np.concatenate((space[1:], [True])) | begin[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def chunks(texts: pa.Array, lower: bool = False, limit: int = 2 * CHUNK, space: np.ndarray = _SPACE) -> Iterator[tuple[slice, Words]]:
    """The texts of a column in runs of about `limit` bytes, each with the rows it stands for."""
    data, offsets = raw(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        part = offsets[at : to + 1]
        yield slice(at, to), cut(data[int(part[0]) : int(part[-1])], part - part[0], lower, space)
        at = to


def tables(batches) -> Iterator[pa.Table]:
    """Record batches of a task as tables of one chunk, without empty ones."""
    for batch in batches:
        if batch.num_rows:
            yield pa.Table.from_batches([batch]).combine_chunks()


def give_back() -> None:
    """Freed memory returned to the machine. Workers are used again by later stages; without this, what the allocators of Arrow
    and C keep for reuse adds up beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def column(table: pa.Table, name: str) -> pa.Array:
    held = table.column(name)
    return held.chunk(0) if held.num_chunks == 1 else pa.concat_arrays(held.chunks)
