"""The administrator's views of accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.operators.library import count_children

PAGE_USERS, PAGE_AUDIT = 25, 50
STATUSES = {
    "active": lambda: F.col("disabled_on").isNull(),
    "disabled": lambda: F.col("disabled_on").isNotNull(),
    "admin": lambda: F.col("role") == "admin",
}


def users(df: DataFrame, q: str = "", status: str | None = None) -> DataFrame:
    """Accounts whose e-mail or name contains `q` (wildcards mean nothing), of one status."""
    if q.strip():
        needle = F.lit(q.strip().lower())
        df = df.filter(F.contains(F.lower("email"), needle) | F.contains(F.lower("name"), needle))
    return df.filter(STATUSES[status]()) if status else df


def with_counts(people: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents and storage per account: one grouped row per account joins."""
    stored = documents.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce("file_size", F.lit(0))).alias("storage_bytes")
    )
    return people.join(stored, "user_id", "left").fillna(0, ["documents", "storage_bytes"])


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def status_counts(documents: DataFrame, key: str, states: list[str]) -> DataFrame:
    """Documents per extraction status, one column each (a fixed list, so no extra pass finds the values)."""
    return documents.groupBy(key).agg(
        *(F.count_if(F.col("extraction_status") == s).alias(s) for s in states)
    )


def detail(people: DataFrame, **children: DataFrame) -> DataFrame:
    """Counts of everything an account owns: each child table is grouped on its own, then joined."""
    for name, rows in children.items():
        people = count_children(people, rows, "user_id", name)
    return people


def recent_audit(log: DataFrame, n: int = 10) -> DataFrame:
    """The last `n` actions on each account."""
    from readlake.operators.ranking import newest_per_key

    return newest_per_key(log, ["user_id"], [F.col("created_at").desc(), F.col("id")], n)
