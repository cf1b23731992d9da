"""Row numbers and running sums that survive one key holding much of the table.

A window over a hot key is one task. Here each key is cut into slices that follow the order (a day, a
thousand of positions); a slice is summed before the shuffle, the slices' totals are accumulated (a small
table: one row per key and slice), and only rows of one slice ever share a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from readlake.session import pinned

#: Rows of one key that one task may sort.
WHOLE = 100_000


def running(
    df: DataFrame, keys: list[str], slice_by: Column, order: list, sums: dict[str, Column], inclusive: bool = True
) -> DataFrame:
    """Adds `{name}: sum of value over the rows before (and with) this one` for each of `sums`."""
    cut = df.withColumn("_slice", slice_by)
    for name, value in sums.items():
        cut = cut.withColumn(f"_v_{name}", value)
    totals = cut.groupBy(*keys, "_slice").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys),
        F.col("_slice").alias("_k_slice"),
        *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums),
    )
    match = F.col("_slice").eqNullSafe(F.col("_k_slice"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    joined = cut.join(offsets, match)
    out = joined
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) + F.col(f"_o_{n}"))
    extra = [c for c in out.columns if c.startswith(("_k_", "_v_", "_o_")) or c == "_slice"]
    return out.drop(*extra)


def numbered(df: DataFrame, keys: list[str], slice_by: Column, order: list, name: str = "n") -> DataFrame:
    """row_number() per key, counted slice by slice."""
    return running(df, keys, slice_by, order, {name: F.lit(1).cast("bigint")})


def large_keys(df: DataFrame, keys: list[str], whole: int = WHOLE) -> DataFrame | None:
    """The keys with more than `whole` rows, None where there are none. There are at most rows / `whole` of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    found = pinned(counts.filter(F.col("_rows") > whole).select(*keys), "large")
    return None if found.isEmpty() else found


def newest_per_key(df: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    """The first `limit` rows of each key. The limit is applied before the shuffle as well as after it
    (Spark's window group limit), so a hot key ships only `limit` rows per task."""
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= limit).drop("_rn")


def with_previous(
    df: DataFrame, keys: list[str], slice_by: Column, order: list, columns: list[str], falling: bool = False
) -> DataFrame:
    """Adds `_first` (no row before this one) and `_prev_<column>`: lag() per key, without a key's rows in one
    task. Each slice's last row is handed to the first row of the next slice. Slices follow the order: rising, or
    falling where the order's first column falls. Null is a key and a slice like any other."""
    row = F.struct(*columns)
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    cut = df.withColumn("_slice", slice_by)
    cut = cut.withColumns({"_here": F.lag(row).over(inside), "_end": F.lead(F.lit(True)).over(inside).isNull()})
    lasts = cut.filter("_end").select(
        *(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_slice").alias("_k_slice"), row.alias("_last")
    )
    along = W.partitionBy(*(f"_k_{k}" for k in keys)).orderBy(F.col("_k_slice").desc() if falling else F.col("_k_slice"))
    lasts = lasts.withColumn("_before", F.lag("_last").over(along)).drop("_last")
    match = F.col("_slice").eqNullSafe(F.col("_k_slice"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = cut.join(lasts, match)
    prev = F.coalesce("_here", "_before")
    out = out.withColumn("_first", prev.isNull())
    for c in columns:
        out = out.withColumn(f"_prev_{c}", prev[c])
    return out.drop("_slice", "_before", "_here", "_end", "_k_slice", *(f"_k_{k}" for k in keys))
