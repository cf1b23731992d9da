"""Traffic, active people and AI spend per day, and the quotas counted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.functions import scalars as S

RANGES = (7, 30, 90)
TOP_USERS = 10
UNCOUNTED = ("healthz",)
# The requests that ask the AI for something.
AI_ENDPOINTS = (
    ("POST", "/api/summaries"),
    ("POST", "/api/notebooks/generate"),
    ("POST", "/api/chat/conversations/{conversation_id}/messages"),
    ("POST", "/api/translate"),
)
MEASURES = (
    "calls",
    "failed_calls",
    "prompt_tokens",
    "cached_tokens",
    "completion_tokens",
    "web_searches",
    "cost_usd",
    "unpriced_calls",
)


def day_range(df: DataFrame, days: int, today: str) -> DataFrame:
    """The last `days` days up to `today`; only the page's own ranges are known."""
    if days not in RANGES:
        raise ValueError(f"days must be one of {RANGES}")
    first = F.date_sub(F.lit(today).cast("date"), days - 1)
    return df.filter(F.col("day") >= first)


def calendar(spark, days: int, today: str) -> DataFrame:
    """One row per day of the range."""
    last = F.lit(today).cast("date")
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))


def spend() -> list[Column]:
    """The eight measures of AI calls; a null cost is unknown, not free."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return [
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("ok")).alias("failed_calls"),
        total("prompt_tokens").alias("prompt_tokens"),
        total("cached_tokens").alias("cached_tokens"),
        total("completion_tokens").alias("completion_tokens"),
        total("web_searches").alias("web_searches"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_calls"),
    ]


def spend_per_day(events: DataFrame, days: int, today: str) -> DataFrame:
    """Every day of the range, days without calls as zeros. The calls are summed before the join."""
    per_day = day_range(events, days, today).groupBy("day").agg(*spend())
    joined = calendar(events.sparkSession, days, today).join(per_day, "day", "left")
    return joined.select("day", *(F.coalesce(F.col(m), F.lit(0)).alias(m) for m in MEASURES))


def spend_totals(events: DataFrame, days: int, today: str, exact: bool = True) -> DataFrame:
    """Totals with the number of requests and today's cost, in one pass over the calls."""
    ranged = day_range(events, days, today)
    requests = F.count_distinct("request_id") if exact else F.approx_count_distinct("request_id")
    today_cost = F.sum(F.when(F.col("day") == F.lit(today).cast("date"), F.col("cost_usd")))
    return ranged.agg(
        *spend(), F.round(F.coalesce(today_cost, F.lit(0.0)), 4).alias("today_cost_usd"), requests.alias("requests")
    )


def spend_by(events: DataFrame, key: str, days: int, today: str) -> DataFrame:
    """Spend per feature or model, the dearest first, unpriced last."""
    cost = F.sum("cost_usd").alias("_cost")
    grouped = day_range(events, days, today).groupBy(F.col(key).alias("key")).agg(*spend(), cost)
    return grouped.orderBy(F.round("_cost", 4).desc_nulls_last(), "key").drop("_cost")


def spend_cube(events: DataFrame, days: int, today: str) -> DataFrame:
    """Per day, per feature, per model and in all, out of one scan and one shuffle."""
    ranged = day_range(events, days, today)
    return (
        ranged.groupingSets([["day"], ["purpose"], ["model"], []], "day", "purpose", "model")
        .agg(F.grouping_id().alias("_g"), *spend())
        .withColumn("level", F.expr("CASE _g WHEN 3 THEN 'day' WHEN 5 THEN 'purpose' WHEN 6 THEN 'model' ELSE 'all' END"))
        .drop("_g")
    )


def top_users(events: DataFrame, users: DataFrame, days: int, today: str, n: int = TOP_USERS) -> DataFrame:
    """The accounts that cost the most: calls are summed per account before e-mails are looked up."""
    per_user = day_range(events, days, today).groupBy("user_id").agg(*spend(), F.sum("cost_usd").alias("_cost"))
    named = per_user.join(users.select("user_id", "email"), "user_id")
    return named.orderBy(F.round("_cost", 4).desc_nulls_last(), "email").limit(n).drop("_cost")


def spend_by_request(events: DataFrame, days: int, today: str) -> DataFrame:
    """One row per request and account, with its last call's time."""
    return (
        day_range(events, days, today)
        .groupBy("request_id", "user_id")
        .agg(F.max("created_at").alias("at"), *spend())
    )


def request_page(events: DataFrame, users: DataFrame, days: int, today: str, page: int, size: int) -> DataFrame:
    """One page of requests, newest first, each call of theirs as a row with its number in the request.

    Only the page's keys are joined back to the calls, so the calls that are ordered within a request are
    those of one page.
    """
    from pyspark.sql.window import Window as W

    grouped = spend_by_request(events, days, today)
    shown = grouped.orderBy(F.col("at").desc(), "request_id", "user_id").offset((page - 1) * size).limit(size)
    shown = shown.select("request_id", "user_id", "at", F.col("calls").alias("request_calls"))
    calls = day_range(events, days, today).join(shown, ["request_id", "user_id"])
    order = W.partitionBy("request_id", "user_id").orderBy("created_at", "id")
    named = calls.join(users.select("user_id", "email"), "user_id", "left")
    return named.withColumn("call_no", F.row_number().over(order))


def traffic_per_day(traffic: DataFrame, days: int, today: str) -> DataFrame:
    return (
        day_range(traffic, days, today)
        .groupBy("day")
        .agg(*(F.sum(c).cast("bigint").alias(c) for c in ("requests", "errors", "ai_calls")))
    )


def traffic_per_area(traffic: DataFrame, days: int, today: str) -> DataFrame:
    """Areas by requests, with each one's share. The shares' total is a one-row aggregate of the areas."""
    areas = (
        day_range(traffic, days, today)
        .groupBy("area")
        .agg(*(F.sum(c).cast("bigint").alias(c) for c in ("requests", "errors", "ai_calls")))
    )
    share = F.round(F.col("requests") / areas.agg(F.sum("requests")).scalar(), 6).alias("share")
    return areas.select("area", "requests", "errors", "ai_calls", share).orderBy(F.desc("requests"), "area")


def active_users(activity: DataFrame, days: int, today: str) -> DataFrame:
    """Distinct people per day: pairs are made unique before they are counted, which spreads a busy day."""
    pairs = day_range(activity, days, today).select("day", "user_id").distinct()
    return pairs.groupBy("day").agg(F.count("user_id").alias("active_users"))


def signups(users: DataFrame, created: str, days: int, today: str) -> DataFrame:
    dated = users.withColumn("day", S.day_vn(F.col(created)))
    return day_range(dated, days, today).groupBy("day").agg(F.count(F.lit(1)).alias("signups"))


def traffic_series(traffic: DataFrame, users: DataFrame, created: str, days: int, today: str) -> DataFrame:
    """The dashboard's days: requests, errors, AI calls, active people, sign-ups, zeros where nothing was."""
    out = calendar(traffic.sparkSession, days, today)
    for part in (
        traffic_per_day(traffic, days, today),
        active_users(traffic, days, today),
        signups(users, created, days, today),
    ):
        out = out.join(part, "day", "left")
    return out.fillna(0)


def traffic_totals(series: DataFrame, users: DataFrame, documents: DataFrame, today: str) -> DataFrame:
    last = F.sum(F.when(F.col("day") == F.lit(today).cast("date"), F.col("active_users")))
    sums = series.agg(
        *(F.sum(c).alias(c) for c in ("requests", "errors", "ai_calls", "signups")),
        F.coalesce(last, F.lit(0)).alias("active_today"),
    )
    rows = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return sums.select("*", rows(users).alias("users"), rows(documents).alias("documents"))


def request_counts(log: DataFrame) -> DataFrame:
    """The access log as (day, area) counters: pre-flight and health requests are not use."""
    endpoint = S.endpoint_template(F.col("path"))
    ai = F.lit(False)
    for method, path in AI_ENDPOINTS:
        ai = ai | ((F.col("method") == method) & (endpoint == path.replace("{conversation_id}", "{id}")))
    named = log.withColumn("area", S.area(F.col("path"))).filter(
        F.col("area").isNotNull() & ~F.col("area").isin(*UNCOUNTED) & (F.col("method") != "OPTIONS")
    )
    return named.select(
        S.day_vn(F.col("ts")).alias("day"),
        "area",
        F.lit(1).cast("bigint").alias("requests"),
        (F.col("status") >= 500).cast("bigint").alias("errors"),
        ((F.col("status") < 400) & ai).cast("bigint").alias("ai_calls"),
        "user_id",
        "ts",
    )


def usage_sums(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens over the attempts of one job."""
    return attempts.groupBy(*keys).agg(
        *(F.sum(c).cast("bigint").alias(c) for c in ("prompt_tokens", "cached_tokens", "completion_tokens"))
    )


def quota_used(calls: DataFrame) -> DataFrame:
    """AI requests each person made per day: what consuming one by one would have counted."""
    return calls.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("used"))


def quota_left(used: DataFrame, limit: int, today: str) -> DataFrame:
    """What is left of today's quota: an older day's count starts over."""
    from pyspark.sql.functions import max_by

    last = used.groupBy("user_id").agg(F.max("day").alias("day"), max_by("used", "day").alias("used"))
    left = S.remaining(limit, F.col("used"), F.col("day"), F.lit(today).cast("date"))
    return last.select("user_id", left.cast("bigint").alias("remaining"))
