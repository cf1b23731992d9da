"""Row changes as batch merges: current rows and changes in, the next snapshot out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_counters(current: DataFrame, changes: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Additive upsert: both sides are summed together, map-side first."""
    both = current.select(*keys, *sums).unionByName(changes.select(*keys, *sums))
    return both.groupBy(*keys).agg(*(F.sum(c).cast("bigint").alias(c) for c in sums))


def insert_ignore(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is new are added once; rows that are there stay, whatever comes in."""
    new = changes.select(*current.columns).join(current.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    return current.unionByName(new.select(*current.columns))


def insert_unless_exists(current: DataFrame, incoming: DataFrame, keys: list[str], arrival: list[str] | None = None) -> DataFrame:
    """Every incoming key's row after the insert: the one already there, else the incoming one, with which. Of several incoming
    rows of one key the first to arrive is inserted (smallest `arrival` columns; by default the smallest row)."""
    rest = [c for c in incoming.columns if c not in keys]
    if rest:
        first = F.min_by(F.struct(*rest), F.struct(*(arrival or rest))).alias("_r")
        incoming = incoming.groupBy(*keys).agg(first).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))
    else:
        incoming = incoming.distinct()
    there = current.join(incoming.select(*keys).distinct(), keys, "left_semi").withColumn("existing", F.lit(True))
    new = incoming.join(current.select(*keys), keys, "left_anti").withColumn("existing", F.lit(False))
    return there.unionByName(new.select(*there.columns))


def replace_by_parent(current: DataFrame, fresh: DataFrame, parent: str, rebuilt: DataFrame | None = None) -> DataFrame:
    """All rows of the rebuilt parents replaced by the fresh ones. `rebuilt` lists the parents, with those left without a row;
    by default they are the ones in `fresh`."""
    gone = fresh.select(parent)
    gone = gone if rebuilt is None else gone.unionByName(rebuilt.select(parent))
    kept = current.join(gone.distinct(), parent, "left_anti")
    return kept.unionByName(fresh.select(*kept.columns))


def update_where(df: DataFrame, test: Column, **values: Column) -> DataFrame:
    """Columns set where the test holds."""
    for name, value in values.items():
        df = df.withColumn(name, F.when(test, value).otherwise(F.col(name)))
    return df


def delete_owner(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A purged account's rows leave."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def null_owner(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A purged account's rows stay, without their owner."""
    marks = gone.select(F.col(key).alias("_gone")).distinct()
    joined = df.join(marks, F.col(key) == F.col("_gone"), "left")
    return joined.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def join_notes(kept: Column, other: Column) -> Column:
    """The other note appended, unless it says nothing new."""
    a, b = F.trim(F.coalesce(kept, F.lit(""))), F.trim(F.coalesce(other, F.lit("")))
    return F.when((b == "") | F.contains(a, b), a).when(a == "", b).otherwise(F.concat_ws("\n\n", a, b))


def overlay(server: DataFrame, local: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Unsent local edits over the server's rows: edits win, creates are added, edits of rows the server no
    longer has are dropped. `local` carries a boolean `create`."""
    s = server.select(key, *columns).withColumn("_server", F.lit(True))
    mine = local.select(key, "create", *(F.col(c).alias(f"_m_{c}") for c in columns)).withColumn("_mine", F.lit(True))
    both = s.join(mine, key, "full")
    live = both.filter(F.col("_server").isNotNull() | F.col("create"))
    pick = [F.when(F.col("_mine").isNotNull(), F.col(f"_m_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return live.select(key, *pick)


def last_write(edits: DataFrame, key: str, at: Column, columns: list[str]) -> DataFrame:
    """Only each row's newest edit."""
    row = F.max_by(F.struct(*columns), at).alias("r")
    return edits.groupBy(key).agg(row).select(key, "r.*")


def edit_links(current: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """What happens to each link: kept, added or removed."""
    c = current.select(*keys).distinct().withColumn("_c", F.lit(True))
    w = wanted.select(*keys).distinct().withColumn("_w", F.lit(True))
    action = F.when(F.col("_c").isNull(), "added").when(F.col("_w").isNull(), "removed").otherwise("kept")
    return c.join(w, keys, "full").select(*keys, action.alias("action"))


def audit_rows(actions: DataFrame, people: DataFrame) -> DataFrame:
    """Audit rows with both accounts' e-mails copied in, so they outlive the accounts."""
    mail = people.select("user_id", "email")
    admins = mail.select(F.col("user_id").alias("admin_id"), F.col("email").alias("admin_email"))
    targets = mail.select(F.col("user_id").alias("target_id"), F.col("email").alias("target_email"))
    return actions.join(admins, "admin_id", "left").join(targets, "target_id", "left")


def unseen_reports(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Reports not filed before; null means the same as null."""
    known, new = current.select(*keys).distinct().alias("k"), incoming.dropDuplicates(keys).alias("n")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}"))
    return new.join(known, same, "left_anti")


# ---- expectations


def expect(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of row rules, in one pass over the table."""
    counted = df.agg(*(F.count_if(~F.coalesce(test, F.lit(True))).alias(name) for name, test in rules.items()))
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return counted.selectExpr(f"stack({len(rules)}, {pairs}) AS (rule, violations)")


def expect_unique(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys held by more than one row (of those the partial rule covers)."""
    rows = df.filter(where) if where is not None else df
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def expect_at_most(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Parents with more children than allowed."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)


def notes_of_documents(documents: DataFrame, notes: DataFrame) -> DataFrame:
    """The notes with the single note that a document used to carry (document_id, user_id, note, updated_at) as its first, of its person's own words. A
    document's note is named by the document, so a second run adds nothing; empty ones are no notes."""
    carried = documents.filter(F.col("note").isNotNull() & (F.col("note") != "")).select(
        F.concat(F.lit("first-"), F.col("document_id").cast("string")).alias("note_id"), "user_id", "document_id", F.col("note").alias("body"), F.lit("user").alias("origin"),
        F.col("updated_at").alias("created_at"), "updated_at",
    )
    new = carried.join(notes.select("note_id"), "note_id", "left_anti")
    return notes.select(*carried.columns).unionByName(new)
