"""URL filters with dated lists.

Entries say that a list gains or loses a domain, a path prefix or a page at some instant. They become validity intervals, and
every capture is held against the entries that were active when it was fetched: an as-of join.

Time is cut into slices (a month by default). What an entry is at the start of a slice is carried over from one row per entry and
slice, so a long history is never one task; and captures and changes of one entry meet in one slice only, in time order, with one
pass and no product of the two. Captures are first reduced to distinct pages and instants and then to distinct keys, so a host
that holds a third of all captures is shuffled once per instant, not once per capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlake.session import pinned

#: A more specific kind decides over a less specific one.
KINDS = {"domain": 1, "prefix": 2, "page": 3}
ENTRY = ["list", "kind", "value"]


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    return F.when(name != "", name)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def keys(url: Column) -> Column:
    """The keys a URL can be listed under: (kind, value) of the host and its parents of two labels or more, of each path prefix that
    ends before a slash, and of the page without query and fragment. Empty without a host."""
    labels = F.split(host(url), r"\.")
    many = F.size(labels)
    domains = F.when(many >= 2, F.transform(F.sequence(F.lit(1), many - 1), lambda i: F.array_join(F.slice(labels, i, many), "."))).otherwise(F.array(host(url)))
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    prefixes = F.when(F.size(parts) > 0, prefixes).otherwise(F.array().cast("array<string>"))

    def of(kind: str, values: Column) -> Column:
        return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    page = F.array(F.concat(host(url), path(url)))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return F.when(host(url).isNull(), none).otherwise(F.concat(of("domain", domains), of("prefix", prefixes), of("page", page)))


def changes(entries: DataFrame) -> DataFrame:
    """entries: (list, kind, value, added boolean, at). One row per entry and instant; a removal wins over an addition at the same
    instant. Rows with a null in any of them say nothing."""
    return entries.dropna(subset=[*ENTRY, "added", "at"]).groupBy(*ENTRY, "at").agg(F.min("added").alias("added"))


def _slices(changed: DataFrame, slice_by: str) -> DataFrame:
    """Per entry and slice: whether it was active before the slice, and the first change after it."""
    each = changed.groupBy(*ENTRY, F.date_trunc(slice_by, "at").alias("slice")).agg(F.max_by("added", "at").alias("left"), F.min("at").alias("first"))
    by = Window.partitionBy(*ENTRY).orderBy("slice")  # a row a slice, so months at most
    return each.select(*ENTRY, "slice", "left", F.lag("left").over(by).alias("before"), F.lead("first").over(by).alias("next"), F.lead("slice").over(by).alias("until"))


def intervals(entries: DataFrame, slice_by: str = "month") -> DataFrame:
    """(list, kind, value, valid_from, valid_to): when each entry was active; valid_to is null while it still is."""
    changed = changes(entries).withColumn("slice", F.date_trunc(slice_by, "at"))
    slices = _slices(changed, slice_by).select(*ENTRY, "slice", "next")
    by = Window.partitionBy(*ENTRY, "slice").orderBy("at")
    timed = changed.withColumn("then", F.lead("at").over(by)).join(slices, [*ENTRY, "slice"])
    return timed.filter("added").select(*ENTRY, F.col("at").alias("valid_from"), F.coalesce("then", "next").alias("valid_to"))


def active(asked: DataFrame, held: DataFrame, slice_by: str = "month") -> DataFrame:
    """The rows of asked (kind, value, at; distinct) with each list whose interval of that key covers the instant.
    held: intervals. As of an instant, the last interval that began no later is the one that can cover it."""
    known = held.select(*ENTRY).distinct()
    asked = asked.join(known, ["kind", "value"]).withColumn("slice", F.date_trunc(slice_by, "at"))
    begun = held.withColumn("slice", F.date_trunc(slice_by, "valid_from"))
    # The interval that a slice starts with: the last one begun in the slices before.
    last = begun.groupBy(*ENTRY, "slice").agg(F.max_by("valid_to", "valid_from").alias("to"), F.max("valid_from").alias("from"))
    seen = asked.select(*ENTRY, "slice").distinct()
    steps = last.select(*ENTRY, "slice", F.struct("from", "to").alias("open")).unionByName(seen.select(*ENTRY, "slice", F.lit(None).cast("struct<from:timestamp,to:timestamp>").alias("open")))
    steps = steps.groupBy(*ENTRY, "slice").agg(F.max("open").alias("open"))
    by = Window.partitionBy(*ENTRY).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select(*ENTRY, "slice", F.last("open", ignorenulls=True).over(by).alias("carried"))
    rows = asked.select(*ENTRY, "slice", "at", F.lit(1).alias("asked"), F.lit(None).cast("struct<from:timestamp,to:timestamp>").alias("open"))
    rows = rows.unionByName(begun.select(*ENTRY, "slice", F.col("valid_from").alias("at"), F.lit(0).alias("asked"), F.struct(F.col("valid_from").alias("from"), F.col("valid_to").alias("to")).alias("open")))
    by = Window.partitionBy(*ENTRY, "slice").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("open", F.last("open", ignorenulls=True).over(by)).filter("asked = 1")
    rows = rows.join(carried, [*ENTRY, "slice"]).withColumn("open", F.coalesce("open", "carried"))
    return rows.filter("open is not null and (open.to is null or at < open.to)").select(*ENTRY, "at", F.col("open.from").alias("since"))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at", allow: str = "allow", slice_by: str = "month") -> DataFrame:
    """The rows of `captures` with n_active, verdict, matched_list, matched_kind, matched_value, active_since.

    The most specific active entry decides (page, longer prefix, shorter prefix, longer domain, ...); at a tie the allowing list,
    then the list's name. The verdict is `allow`, `block` or, without an active entry, `none`. A null or unreadable URL or a null
    instant has none. An entry is active from its addition up to, not including, its removal. Columns of those names in
    `captures` are replaced."""
    added = ["n_active", "verdict", "matched_list", "matched_kind", "matched_value", "active_since"]
    captures = captures.drop(*added)
    distinct = captures.select(F.col(url).alias("_url"), F.col(at).alias("_at")).dropna().distinct()
    each = distinct.withColumn("key", F.explode(keys(F.col("_url")))).select("_url", F.col("_at").alias("at"), "key.*")
    held = pinned(intervals(entries, slice_by), "intervals")
    found = active(each.select("kind", "value", "at").distinct(), held, slice_by)
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    order = F.struct(-kind[F.col("kind")], -F.length("value"), F.when(F.col("list") == allow, 0).otherwise(1), "list", "value")
    best = each.join(found, ["kind", "value", "at"]).groupBy("_url", "at").agg(F.count("*").alias("n_active"), F.min_by(F.struct("list", "kind", "value", "since"), order).alias("m"))
    told = captures.alias("c").join(best.alias("b"), (F.col(f"c.{url}") == F.col("b._url")) & (F.col(f"c.{at}") == F.col("b.at")), "left")
    listed = F.col("b.m.list")
    verdict = F.when(listed.isNull(), "none").when(listed == allow, "allow").otherwise("block")
    return told.select(
        "c.*",
        F.coalesce("b.n_active", F.lit(0)).cast("long").alias("n_active"),
        verdict.alias("verdict"),
        listed.alias("matched_list"),
        F.col("b.m.kind").alias("matched_kind"),
        F.col("b.m.value").alias("matched_value"),
        F.col("b.m.since").alias("active_since"),
    )
