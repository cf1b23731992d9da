"""Streams replayed from the events table, each beside the batch SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.plans.bindings import REQUESTS, USAGE, bound, with_bindings
from readlake.plans.registry import query
from readlake.schemas import TABLES
from readlake.session import shared_path
from readlake.sources import ingest as I
from readlake.streaming import decisions as D
from readlake.streaming import jobs as J


def stream(t, binding: str | None = None):
    rows = J.table_stream(t.spark, f"{t.folder}/events.parquet*", TABLES["events"])
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    if binding is None:
        return rows
    return t.spark.sql(binding.replace("FROM events", "FROM {events}"), events=rows)


COUNTS = with_bindings("requests") + """
, l AS (SELECT strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d') AS day, substr(split_part(path, '/', 3), 1, 24) AS area, method, path, status
  FROM requests WHERE path LIKE '/api/%' AND method <> 'OPTIONS')
SELECT day, area, count(*) AS requests, CAST(sum(CASE WHEN status >= 500 THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  CAST(sum(CASE WHEN status < 400 AND method = 'POST' AND path = '/api/translate' THEN 1 ELSE 0 END) AS BIGINT) AS ai_calls FROM l GROUP BY 1, 2"""


@query("stream_traffic_counts", COUNTS)
def _(t):
    path = shared_path(t.spark, "traffic")
    J.count_traffic(stream(t, REQUESTS), path, shared_path(t.spark, "traffic-checkpoint")).awaitTermination()
    return J.read_counters(t.spark, path).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("stream_traffic_retained", COUNTS.replace("GROUP BY 1, 2", "WHERE day >= '2024-01-15' GROUP BY 1, 2"))
def _(t):
    path, kept = shared_path(t.spark, "traffic"), shared_path(t.spark, "traffic-daily")
    J.count_traffic(stream(t, REQUESTS), path, shared_path(t.spark, "traffic-checkpoint")).awaitTermination()
    J.compact(t.spark, path, kept, F.lit("2024-01-15").cast("date"))
    return t.spark.read.parquet(kept).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("stream_daily_active", """
SELECT DISTINCT strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d') AS day, CAST(user_id AS VARCHAR) AS user_id FROM events""")
def _(t):
    path = shared_path(t.spark, "active")
    J.active_people(stream(t), path, shared_path(t.spark, "active-checkpoint")).awaitTermination()
    rows = t.spark.read.schema("day DATE, user_id STRING").parquet(path)
    return rows.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


WHEN = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def stamped(df, *names):
    for n in names:
        df = df.withColumn(n, F.date_format(n, "yyyy-MM-dd HH:mm:ss"))
    return df


@query("stream_windows_daily", f"""
SELECT {WHEN.format("date_trunc('day', ts)")} AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def _(t):
    # Complete mode would hold every day; update batches keep each day's last count, the largest.
    out = J.table_of_updates(J.windows(stream(t), "1 day"), ["start", "event_type"], "n")
    return stamped(out, "start").select("start", "event_type", "n")


@query("stream_windows_sliding", f"""
SELECT {WHEN.format("date_trunc('day', ts) - INTERVAL 1 DAY * d")} AS start, event_type, count(*) AS n FROM events, range(7) r(d) GROUP BY 1, 2""")
def _(t):
    out = J.table_of_updates(J.windows(stream(t), "7 days", "1 day"), ["start", "event_type"], "n")
    return stamped(out, "start").select("start", "event_type", "n")


SESSIONS = """
WITH o AS (SELECT *, lag({ts}) OVER (PARTITION BY {key} ORDER BY {ts}) AS before FROM ({src}) x),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR {ts} >= before + INTERVAL {gap} MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY {ts}, {id} ROWS UNBOUNDED PRECEDING) AS s FROM o)
"""


@query("stream_reading_visits", SESSIONS.format(ts="ts", key="user_id", gap=30, id="event_id", src="SELECT * FROM events") + f"""
SELECT user_id, {WHEN.format("min(ts)")} AS start, count(*) AS events FROM s GROUP BY user_id, s.s
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 DAY""")
def _(t):
    out = J.table_of(J.visits(stream(t)), "visits")  # a visit is written once the watermark has passed its end
    return stamped(out, "start").select("user_id", "start", "events")


@query("stream_request_sessions", SESSIONS.format(ts="created_at", key="request_id", gap=5, id="id", src=USAGE.strip()) + f"""
SELECT request_id, {WHEN.format("min(created_at)")} AS start, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens FROM s GROUP BY request_id, s.s
HAVING max(created_at) + INTERVAL 5 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def _(t):
    out = J.table_of(J.request_sessions(stream(t, USAGE)), "requests")
    return stamped(out, "start").select("request_id", "start", "calls", "prompt_tokens")


@query("stream_calls_priced", with_bindings("usage") + """
SELECT id, round(CASE WHEN model = 'm2' THEN NULL ELSE ((prompt_tokens - cached_tokens) * p + cached_tokens * p / 4 + completion_tokens * 4 * p) END, 4) AS micro_usd
FROM (SELECT *, CASE WHEN created_at < TIMESTAMP '2024-01-15 00:00:00' THEN 1.0 ELSE 2.0 END * CASE model WHEN 'm0' THEN 1 ELSE 3 END AS p FROM usage)""")
def _(t):
    change = F.lit("2024-01-15 00:00:00").cast("timestamp")
    scale = F.when(F.col("m") == "m0", 1.0).otherwise(3.0) * F.when(F.col("old"), 1.0).otherwise(2.0)
    known = bound(t, "usage").select(F.col("model").alias("m")).distinct().filter("m <> 'm2'")
    known = known.withColumn("old", F.explode(F.array(F.lit(True), F.lit(False))))
    prices = known.select(
        F.col("m").alias("model"), F.when(F.col("old"), F.lit("2020-01-01").cast("timestamp")).otherwise(change).alias("valid_from"),
        F.when(F.col("old"), change).alias("valid_to"), scale.alias("input"), (scale / 4).alias("cached"), (scale * 4).alias("output"),
    )
    calls = stream(t, USAGE).drop("cost_usd")
    out = J.table_of(J.priced(calls, prices).select("id", "cost_usd"), "priced")
    return out.select("id", F.round(F.col("cost_usd") * 1e6, 4).alias("micro_usd"))


def hits(df):
    return df.select(F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.col("event_id").alias("hit_id")).select(
        "key", (F.col("us") / 1e6).alias("at"), "hit_id"
    )


@query("limiter_decisions", """
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) / 1e6 AS at_, event_id AS hit_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT key, rn, hit_id, TRUE AS passed, [at_] AS times FROM e WHERE rn = 1 UNION ALL
  SELECT key, rn, hit_id, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, at_) ELSE live END FROM (
    SELECT e.key, e.rn, e.hit_id, e.at_, list_filter(r.times, lambda x: e.at_ - x < 86400) AS live FROM r JOIN e ON e.key = r.key AND e.rn = r.rn + 1))
SELECT key, hit_id, passed FROM r""")
def _(t):
    return D.rate_limited_batch(hits(t.events), 3, 24 * 3600)


@query("stream_limiter_equals_batch", "SELECT CAST(0 AS BIGINT) AS different, count(*) AS hits FROM events")
def _(t):
    streamed = J.table_of(D.rate_limited(hits(stream(t)), 3, 24 * 3600.0), "limited")
    both = D.rate_limited_batch(hits(t.events), 3, 24 * 3600).join(streamed.withColumnRenamed("passed", "_p"), ["key", "hit_id"])
    return both.agg(F.count_if(F.col("passed") != F.col("_p")).alias("different"), F.count(F.lit(1)).alias("hits"))


GREEDY = """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events),
p AS (SELECT user_id, min(us) AS us FROM e GROUP BY 1 UNION ALL
  SELECT e.user_id, min(e.us) FROM p JOIN e ON e.user_id = p.user_id AND e.us >= p.us + {gap} * CAST(1000000 AS BIGINT) GROUP BY e.user_id)
SELECT CAST(e.user_id AS VARCHAR) AS key, e.event_id AS hit_id, p.us IS NOT NULL AS passed FROM e LEFT JOIN p ON p.user_id = e.user_id AND p.us = e.us
"""


@query("last_seen_refreshes", GREEDY.format(gap=3600))
def _(t):
    return D.spaced_batch(hits(t.events), D.SEEN_GAP)


@query("stream_last_seen", GREEDY.format(gap=3600))
def _(t):
    return J.table_of(D.spaced(hits(stream(t)), float(D.SEEN_GAP)), "seen")


@query("stream_late_rows", """
WITH e AS (SELECT event_id % 5 AS batch, ts FROM events), m AS (SELECT batch, max(ts) AS newest FROM e GROUP BY 1),
w AS (SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(newest) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) AS newest FROM m)
SELECT batch, count(*) FILTER (WHERE NOT coalesce(ts < before - INTERVAL 10 DAY, FALSE)) AS kept, count(*) FILTER (WHERE ts < before - INTERVAL 10 DAY) AS late,
  strftime(w.newest, '%Y-%m-%d %H:%M:%S') AS newest FROM e JOIN w USING (batch) GROUP BY batch, w.newest""")
def _(t):
    arrived, path = shared_path(t.spark, "arrivals"), shared_path(t.spark, "late")
    for k in range(5):  # one file after the other, each of all times
        t.events.filter(F.col("event_id") % 5 == k).coalesce(1).write.mode("append").parquet(arrived)
    rows = J.table_stream(t.spark, arrived, TABLES["events"], files_per_trigger=1).withColumn("ts", F.col("ts").cast("timestamp"))
    J.counted_late(rows, path, shared_path(t.spark, "late-checkpoint"), "10 days").awaitTermination()
    return stamped(J.late_counts(t.spark, path), "newest")


@query("one_job_per_key", GREEDY.format(gap=900))
def _(t):
    return D.spaced_batch(hits(t.events), D.JOB_TTL)


# ---- annotations brought in: every order's line items as one person's payload


def payloads(t):
    mark = F.struct(
        F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("id"),
        F.col("l_orderkey").cast("string").alias("document_id"), F.lit("words").alias("text"), F.lit("pink").alias("color"), F.lit("").alias("note"), F.col("l_linenumber").alias("page"),
    )
    per = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(mark).alias("h"))
    doc = F.col("l_orderkey").cast("string")
    rows = per.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    body = F.struct(
        F.col("h").alias("highlights"), F.create_map(doc, F.concat(F.lit("note "), doc), F.lit("x1"), F.lit("lost")).alias("notes"),
        F.create_map(doc, F.lit(0.5)).alias("progress"),
    )
    return rows.select(F.col("o_custkey").alias("user_id"), F.to_json(body).alias("payload"))


def _imported(t):
    held = bound(t, "highlights").filter("color = 'pink'").select(F.col("highlight_id").alias("id"))
    notes = t.orders.filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").cast("string").alias("document_id"), F.concat(F.lit("note "), F.col("o_orderkey").cast("string")).alias("body")
    )
    return I.import_annotations(payloads(t), bound(t, "library"), held, notes)


@query("import_highlights", with_bindings("highlights") + "SELECT DISTINCT highlight_id AS id FROM highlights WHERE color <> 'pink' AND document_id IN (SELECT o_orderkey FROM orders)")
def _(t):
    return _imported(t)["highlights"].select("id")


@query("import_notes", "SELECT o_custkey AS user_id, CAST(o_orderkey AS VARCHAR) AS document_id FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return _imported(t)["notes"].select("user_id", "document_id")


@query("import_progress", with_bindings("library") + """
SELECT user_id, CAST(document_id AS VARCHAR) AS document_id, 0.5 AS fraction FROM library WHERE coalesce(read_fraction, 0) < 0.5 AND document_id IN (SELECT l_orderkey FROM lineitem)""")
def _(t):
    return _imported(t)["progress"]


@query("import_unknown_documents", "SELECT DISTINCT o_custkey AS user_id, 'x1' AS document_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return _imported(t)["unknown"]
