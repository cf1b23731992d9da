"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram of letters is bound into one vector: the letters' vectors, each rotated
by its place, multiplied component by component. A text is the bundle (sum) of its n-grams' vectors, a language the bundle of its
training texts, and a text is given to the language whose bundle has the largest cosine, after the mean direction of all
languages is taken out of both (what they share tells nothing).

Bundling is linear, so training is a count of n-grams per language, summed by Spark; the profiles are then languages times
dimensions, whatever the corpus. Letters are mapped to a fixed alphabet, so the possible n-grams are bounded too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm.common import crc, identity, restored
from readlake.llm.words import raw, tables

#: 0 is every run of other characters, 1 to 26 are a to z, the rest are shared out among all other letters.
ALPHABET = 64
ORDER = 3
DIMENSIONS = 1024
SEED = 7


def _letters() -> np.ndarray:
    """The alphabet's number of each code point; 0: no letter."""
    out = np.zeros(0x110000, dtype=np.uint8)
    every = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
    low = np.array([ord(chr(c).lower()[0]) for c in every])
    plain = (low >= 97) & (low <= 122)
    out[every] = np.where(plain, low - 96, 27 + low * 2654435761 % (1 << 32) // 65536 % (ALPHABET - 27))
    return out


_TABLE: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letters())
    return _TABLE[0]


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram code, text it belongs to) of all n-grams of a column's texts, and whether each text has a letter. Other characters
    in a row count as one; every text begins and ends with one."""
    data, offsets = raw(pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), " ", ""))
    lead = (data & 0xC0) != 0x80  # first byte of each character
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    symbol = letters()[points]
    before = np.concatenate(([0], np.cumsum(lead)))[offsets]  # characters before each text
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    has = np.bincount(text, symbol > 0, len(offsets) - 1) > 0
    first = np.concatenate(([True], text[1:] != text[:-1])) if len(text) else np.zeros(0, dtype=bool)
    keep = (symbol > 0) | first | np.concatenate(([True], symbol[:-1] > 0))[: len(symbol)]
    symbol, text, first = symbol[keep].astype(np.int32), text[keep], first[keep]
    code, valid = symbol.copy(), np.ones(len(symbol), dtype=bool)
    for j in range(1, ORDER):
        code[j:] += symbol[: len(symbol) - j] * ALPHABET**j
        valid[:j] = False
        valid[j:] &= text[j:] == text[: len(text) - j]
    return code[valid], text[valid], has


def vectors(code: np.ndarray) -> np.ndarray:
    """The bound vectors of some n-grams, one row each."""
    base = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), (ALPHABET, DIMENSIONS))
    out = np.ones((len(code), DIMENSIONS), dtype=np.int8)
    for j in range(ORDER):
        out *= np.roll(base, j, axis=1)[code // ALPHABET**j % ALPHABET]
    return out


def _runs(table: pa.Table, size: int = 4 << 20):
    """Rows of a table in runs of about so many bytes of text."""
    _, offsets = raw(table.column("text"))
    at = 0
    while at < table.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, at + 512)
        yield table.slice(at, to - at)
        at = to


def gram_counts(docs: DataFrame) -> DataFrame:
    """docs: (lang, text). (lang, code, times): n-grams of each language, summed in each task before the shuffle."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for table in tables(batches):
            for part in _runs(table):
                code, text, _ = codes(part.column("text"))
                lang = part.column("lang").combine_chunks().dictionary_encode()
                which = lang.indices.to_numpy(zero_copy_only=False)[text]
                for k, name in enumerate(lang.dictionary.to_pylist()):
                    got = np.bincount(code[which == k], minlength=ALPHABET**ORDER)
                    sums[name] = sums[name] + got if name in sums else got
        for name, got in sums.items():
            seen = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), type=pa.string()), pa.array(seen.astype(np.int32)), pa.array(got[seen])], names=["lang", "code", "times"])

    return docs.mapInArrow(run, "lang string, code int, times long").groupBy("lang", "code").agg(F.sum("times").alias("times"))


def profiles(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their bundles of length one. What reaches the driver is one vector a language: each task bundles the
    n-grams it was dealt."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for table in tables(batches):
            code, times = (table.column(x).to_numpy() for x in ("code", "times"))
            lang = np.array(table.column("lang").to_pylist(), dtype=object)
            for at in range(0, len(code), 4096):
                held = vectors(code[at : at + 4096])
                for name in set(lang[at : at + 4096]):
                    mine = lang[at : at + 4096] == name
                    got = times[at : at + 4096][mine].astype(np.float64) @ held[mine]
                    sums[name] = sums[name] + got if name in sums else got
        for name, got in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([got.tolist()], type=pa.list_(pa.float64()))], names=["lang", "bundle"])

    parts = gram_counts(docs).mapInArrow(run, "lang string, bundle array<double>")
    flat = parts.select("lang", F.posexplode("bundle").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = flat.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("bundle")).orderBy("lang").collect()
    held = np.array([r["bundle"] for r in rows]).reshape(len(rows), DIMENSIONS)
    return [r["lang"] for r in rows], held / np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-300)


def predictions(docs: DataFrame, languages: list[str], bundles: np.ndarray, with_text: bool = False) -> DataFrame:
    """docs: (doc_id, ..., text). The other columns with lang_pred, score, cosine and n_grams (and the text). The score is the share of the best cosine's
    lead: softmax over cosines with a fixed temperature. A text without a letter, or a model without languages, gives `und`, 0."""
    mean = bundles.mean(axis=0) if len(languages) > 1 else np.zeros(DIMENSIONS)
    mean = mean / max(np.linalg.norm(mean), 1e-300)
    centred = bundles - np.outer(bundles @ mean, mean)
    centred = (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-300)).astype(np.float32)
    others = [c for c in docs.columns if with_text or c != "text"]

    def run(batches):
        for table in tables(batches):
            for part in _runs(table):
                code, text, has = codes(part.column("text"))
                seen = np.zeros(ALPHABET**ORDER, dtype=bool)
                seen[code] = True
                grams = np.flatnonzero(seen)
                place = np.cumsum(seen) - 1
                n = part.num_rows
                counts = np.bincount(text * len(grams) + place[code], minlength=n * len(grams)).reshape(n, len(grams)).astype(np.float32)
                held = counts @ vectors(grams).astype(np.float32)
                length = np.linalg.norm(held, axis=1)
                raw_cosine = (held @ bundles.T.astype(np.float32)) / np.maximum(length, 1e-30)[:, None]
                off = held - np.outer(held @ mean.astype(np.float32), mean.astype(np.float32))
                cosine = (off @ centred.T) / np.maximum(np.linalg.norm(off, axis=1), 1e-30)[:, None]
                if len(languages):
                    best = cosine.argmax(axis=1)
                    share = np.exp(10 * (cosine - cosine.max(axis=1, keepdims=True)))
                    score = share[np.arange(n), best] / share.sum(axis=1)
                    plain = raw_cosine[np.arange(n), best]
                    names = [languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                else:  # nothing was learned
                    score, plain, names, has = np.zeros(n), np.zeros(n), ["und"] * n, np.zeros(n, dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).combine_chunks() for c in others),
                        pa.array(names, type=pa.string()),
                        pa.array(np.where(has, np.clip(score, 0, 1), 0.0).astype(np.float64)),
                        pa.array(np.where(has, plain, 0.0).astype(np.float64)),
                        pa.array(np.bincount(text, minlength=n)),
                    ],
                    names=[*others, "lang_pred", "score", "cosine", "n_grams"],
                )

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in others)
    return docs.mapInArrow(run, f"{shape}, lang_pred string, score double, cosine double, n_grams long")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", held_out: Column | None = None) -> DataFrame:
    """(doc_id, text_key, held_out, lang_pred, score, cosine, n_grams) of every row. Rows that are not held out (default: crc32 of the id
    modulo 4 is 2) and have a language and a text teach; repeated rows teach and are told alike. `und`: null, no letter."""
    held_out = crc(F.col(doc_id), 4) == 2 if held_out is None else held_out
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text), F.length(text)).alias("text_key"), held_out.alias("held_out"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    languages, bundles = profiles(base.filter("not held_out and lang is not null and text is not null").select("lang", "text"))
    return predictions(base.drop("lang"), languages, bundles)


def accepted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.1, few: int = 50) -> DataFrame:
    """The rows of `docs` whose language is known, null languages filled in with the prediction. Rejected: texts without a letter
    (null too), and texts whose best profile is nearly at right angles: with n n-grams a cosine under least * sqrt(n / (n + few)), as
    the cosine of a text and its own language grows with the text. (Two random vectors have a cosine of about 1 / sqrt(DIMENSIONS)
    = 0.03; ten n-grams of a language of about 0.2.) Without any learned language all texts with a letter stay."""
    base = identity(docs, doc_id, text, carry=True)
    learn = base.filter((crc(F.col("doc_id"), 4) != 2) & F.col(f"row.`{lang}`").isNotNull() & F.col("text").isNotNull())
    languages, bundles = profiles(learn.select(F.col(f"row.`{lang}`").alias("lang"), "text"))
    if not languages:
        return docs.filter(F.col(text).rlike(r"\p{L}"))
    told = predictions(base.select("row", "text"), languages, bundles, with_text=True)
    limit = least * F.sqrt(F.col("n_grams") / (F.col("n_grams") + few))
    kept = told.filter((F.col("lang_pred") != "und") & (F.col("cosine") >= limit))
    return restored(kept, docs, text, {lang: F.coalesce(F.col(f"row.`{lang}`"), F.col("lang_pred"))})
