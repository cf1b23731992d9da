"""A standing index of passages that follows its documents.

The index is two tables below one folder: `passages`, partitioned by a bucket of the document's key, and `digests`, which text and
model each document was indexed with, partitioned alike. A refresh compares digests, cuts only documents that are new or changed, and
overwrites only the buckets that hold a document that is new, changed or gone; files of other buckets are not touched. Passages are
written before digests, so a refresh that was broken off is done again by the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.session import pinned, removed, written

BUCKETS = 256
Cut = Callable[[DataFrame], DataFrame]


class Refreshed(NamedTuple):
    """How many documents were cut, how many left the index, and which buckets were written."""

    cut: int
    gone: int
    buckets: list[int]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def passages(spark: SparkSession, path: str) -> DataFrame | None:
    """The passages of an index, or None where there is none."""
    return spark.read.option("basePath", f"{path}/passages").parquet(f"{path}/passages") if written(spark, f"{path}/passages") else None


def digests(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.option("basePath", f"{path}/digests").parquet(f"{path}/digests") if written(spark, f"{path}/digests") else None


def _put(rows: DataFrame, path: str, buckets: list[int], new: bool) -> None:
    """Exactly the given buckets replaced by `rows`, one file a bucket; a bucket without rows goes. The rows of a new table come from
    elsewhere and are written at once; others may come from the buckets that they replace."""
    spark = rows.sparkSession
    rows = rows if new else pinned(rows, "buckets")
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    if new:
        return
    left = {r["bucket"] for r in rows.select("bucket").distinct().toLocalIterator()}
    for b in set(buckets) - left:
        removed(spark, f"{path}/bucket={b}")


def refresh(documents: DataFrame, path: str, key: str, digest: Column, model: str, cut: Cut, buckets: int = BUCKETS) -> Refreshed:
    """Bring the index below `path` up to `documents`. `digest`: what a document's passages are made from; `cut`: documents to passages,
    which keep the column `key`. Documents have unique keys; a null key is left out.

    A document with no passages is known by its digest alone. At most `buckets` numbers reach the driver."""
    spark = documents.sparkSession
    now = documents.filter(F.col(key).isNotNull()).select(key, digest.alias("digest"), F.lit(model).alias("model"), bucket_of(F.col(key), buckets).alias("bucket"))
    now = pinned(now, "digests")
    held = digests(spark, path)
    if held is None:
        changed, gone = now, now.limit(0)
    else:
        changed = now.join(held.select(key, "digest", "model"), [key, "digest", "model"], "left_anti")
        gone = held.join(now.select(key), key, "left_anti").select(*now.columns)
    changed, gone = pinned(changed, "changed"), pinned(gone, "gone")
    touched = sorted(r["bucket"] for r in changed.select("bucket").union(gone.select("bucket")).distinct().collect())
    if not touched:
        return Refreshed(0, 0, [])
    fresh = cut(documents.join(changed.select(key), key, "left_semi")).withColumn("bucket", bucket_of(F.col(key), buckets))
    replaced = changed.select(key).union(gone.select(key))
    for name, table, new in (("passages", passages(spark, path), fresh), ("digests", held, changed)):
        if table is not None:  # only the touched buckets are read
            kept = table.filter(F.col("bucket").isin(touched)).join(replaced, key, "left_anti")
            new = new.unionByName(kept.select(*new.columns))
        _put(new, f"{path}/{name}", touched, table is None)
    return Refreshed(changed.count(), gone.count(), touched)
