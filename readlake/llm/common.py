"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def identity(docs: DataFrame, doc_id: str, text: str, carry: bool = False) -> DataFrame:
    """(doc_id, text_key, text): the columns an operator works on. Rows with one id and one text share a key and a result.
    carry: all columns of the row too, but for the text, as the struct `row`."""
    cols = [F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text), F.length(text)).alias("text_key"), F.col(text).alias("text")]
    if carry:
        rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
        cols.append(F.struct(*rest).alias("row"))
    return docs.select(*cols)


def restored(frame: DataFrame, docs: DataFrame, text: str, values: dict[str, Column] | None = None) -> DataFrame:
    """The columns of `docs`, in order, from `row` and `text`; `values` replaces some."""
    values = values or {}
    return frame.select(*[values.get(c, F.col("text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
