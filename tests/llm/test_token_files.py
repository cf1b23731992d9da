"""Token files: exact round trips, the checksums, and every document's numbers against the library's own ids."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readlake.llm import context_coder, queries, token_files
from readlake.llm.words import chunks
from readlake.session import shared_path

PIECES = [
    "hello", "it's", "'s", "don't", "Ärger", "é", "́x", " ", "　a", "<|endoftext|>", "<|startoftext|>x", "\x00", "a\x00b", "123", "½", "日本語", "ÀÉ", "ΣΑΣ", "İI", "!!", "...", " ",
    "ﬁ", "\U0001f600", "\x1c", "\x85", "<|endof", "text|>", "w</w>", "J̌.", "a.b", "B&&'s", "it's.", "a<|b", "x.<|endoftext|>", "ab<|ENDOFTEXT|>", "≮", "a≮",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files._file(token_files.VOCABULARY))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.integers(0, 40) | st.integers(0, 65534), max_size=400), st.integers(1, 90))
@settings(max_examples=60, deadline=None)
def test_round_trip(ids, block):
    segment = context_coder.encode(np.array(ids, dtype=np.int64), block)
    assert context_coder.decode(segment).tolist() == ids


def test_long_round_trips():
    r = np.random.default_rng(3)
    for ids in (np.zeros(9000, int), r.integers(0, 65535, 9000), r.zipf(1.3, 9000) % 60000, np.tile(r.integers(0, 50000, 70), 200)):
        segment = context_coder.encode(ids, 700)
        assert (context_coder.decode(segment) == ids).all()
    assert len(segment) < len(ids)  # copies cost little


def test_blocks_stand_alone():
    ids = np.random.default_rng(4).zipf(1.2, 5000) % 40000
    segment = context_coder.encode(ids, 512)
    assert (context_coder.decode(segment, [3]) == ids[3 * 512 : 4 * 512]).all()
    assert (context_coder.decode(segment, [9, 0]) == np.concatenate((ids[:512], ids[9 * 512 :]))).all()
    bad = bytearray(segment)
    bad[-3] ^= 0x40  # the last block
    assert (context_coder.decode(bytes(bad), [0, 1, 2]) == ids[: 3 * 512]).all()
    with pytest.raises(ValueError, match="block 9"):
        context_coder.decode(bytes(bad))
    bad = bytearray(segment)
    bad[30] ^= 1
    with pytest.raises(ValueError, match="header"):
        context_coder.decode(bytes(bad))
    with pytest.raises(ValueError, match="not a segment"):
        context_coder.decode(b"PAR1" + segment)


def test_step_of_the_coder():
    """What a step touches lies close together, in small numbers, and the bytes of a segment stay what they were."""
    writer, model = context_coder._Writer(40, 10), context_coder._Model(40)
    assert writer.out.shape == (22, 40) and model.one.dtype == np.uint16
    ids = np.random.default_rng(9).zipf(1.3, 30000) % 50000
    segment = context_coder.encode(ids, 300)
    assert zlib.crc32(segment) == 2631277360 and (context_coder.decode(segment) == ids).all()


@pytest.mark.parametrize("ids", [[-1], [65535]])
def test_ids_out_of_range(ids):
    with pytest.raises(ValueError):
        context_coder.encode(np.array(ids))


def test_pieces_are_whole_texts(library):
    r = random.Random(1)
    texts = ["".join(r.choice(PIECES) + r.choice(["", " ", "\n", "\t ", "  ", "\r\n", "\x0b"]) for _ in range(r.randrange(30))) for _ in range(1500)]
    tool = token_files.Encoder()
    for rows, words in chunks(pa.array(texts, pa.string()), limit=5000):
        ids, each = tool.ids(words)
        edge = np.concatenate(([0], np.cumsum(each)))
        for i, text in enumerate(texts[rows]):
            assert ids[edge[i] : edge[i + 1]].tolist() == ids_of(library, text)


def plain(library, rows):
    """(doc_id, start, n_tokens, ids_crc32) for rows in file order; what stands first among one id's texts is left to the files."""
    at = 0
    for i, text in rows:
        ids = [*ids_of(library, text), 2]
        yield i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)


def test_digests(spark, messy, nothing, library):
    got = token_files.round_trip(messy, segment=3000, block=256).orderBy("start").collect()
    ids = [(r["doc_id"] is not None, r["doc_id"]) for r in got]
    assert ids == sorted(ids, key=lambda x: (x[0], x[1] or 0)) and len(got) == messy.count()
    want = sorted(plain(library, [(r["doc_id"], r["text"]) for r in messy.collect()]), key=str)
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(((r[0], r[2], r[3]) for r in want), key=str)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert token_files.round_trip(nothing).collect() == []


def test_files(spark, messy, library):
    path = shared_path(spark, "token_files_test")
    token_files.write(messy, path, segment=2000)
    got = {(r["doc_id"], r["start"]): r["ids"] for r in token_files.from_files(spark, path).collect()}
    texts = {}
    for r in messy.collect():
        texts.setdefault(r["doc_id"], []).append([*ids_of(library, r["text"]), 2])
    assert all(ids in texts[i] for (i, _), ids in got.items()) and len(got) == messy.count()


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.QUERIES["op13_token_files"](spark, folder).orderBy("start").collect()
    assert [tuple(r) for r in got] == list(plain(library, docs))
