"""Traffic, spend and quotas over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.functions import scalars as S
from readlake.operators import telemetry as T
from readlake.plans.bindings import AS_OF, bound, with_bindings
from readlake.plans.registry import query

DAYS = 30
SPEND = """count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS failed_calls,
  CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens,
  CAST(coalesce(sum(cached_tokens), 0) AS BIGINT) AS cached_tokens,
  CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens,
  CAST(coalesce(sum(web_searches), 0) AS BIGINT) AS web_searches,
  round(coalesce(sum(cost_usd), 0), 4) AS cost_usd,
  count(*) FILTER (WHERE cost_usd IS NULL) AS unpriced_calls"""
RANGE = "day >= DATE '2024-01-30' - 29"
CAL = "(SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day)"


def text_day(df, *names):
    for n in names or ("day",):
        df = df.withColumn(n, F.date_format(n, "yyyy-MM-dd"))
    return df


@query(
    "spend_range_filter",
    with_bindings("usage") + f"SELECT id, strftime(day, '%Y-%m-%d') AS day FROM usage WHERE {RANGE}",
)
def _(t):
    return text_day(T.day_range(bound(t, "usage"), DAYS, AS_OF).select("id", "day"))


@query("spend_per_day", with_bindings("usage") + f"""
SELECT strftime(c.day, '%Y-%m-%d') AS day, {", ".join(f"coalesce({m}, 0) AS {m}" for m in T.MEASURES)}
FROM {CAL} c LEFT JOIN (SELECT day, {SPEND} FROM usage WHERE {RANGE} GROUP BY day) p ON c.day = p.day""")
def _(t):
    return text_day(T.spend_per_day(bound(t, "usage"), DAYS, AS_OF))


@query("spend_totals", with_bindings("usage") + f"""
SELECT {SPEND}, round(coalesce(sum(cost_usd) FILTER (WHERE day = DATE '2024-01-30'), 0), 4) AS today_cost_usd,
  count(DISTINCT request_id) AS requests FROM usage WHERE {RANGE}""")
def _(t):
    return T.spend_totals(bound(t, "usage"), DAYS, AS_OF)


for _key in ("purpose", "model"):

    @query(f"spend_by_{_key}", with_bindings("usage") + f"""
SELECT {_key} AS key, {SPEND} FROM usage WHERE {RANGE} GROUP BY {_key}""")
    def _(t, key=_key):
        return T.spend_by(bound(t, "usage"), key, DAYS, AS_OF)


@query("spend_grouping_sets", with_bindings("usage") + f"""
SELECT strftime(day, '%Y-%m-%d') AS day, purpose, model, {SPEND},
  CASE grouping(day, purpose, model) WHEN 3 THEN 'day' WHEN 5 THEN 'purpose' WHEN 6 THEN 'model' ELSE 'all' END AS level
FROM usage WHERE {RANGE} GROUP BY GROUPING SETS ((day), (purpose), (model), ())""")
def _(t):
    return text_day(T.spend_cube(bound(t, "usage"), DAYS, AS_OF))


@query("spend_top_users", with_bindings("usage", "users") + f"""
SELECT user_id, email, {", ".join(T.MEASURES)} FROM (
  SELECT u.user_id, u.email, {SPEND}, sum(cost_usd) AS c FROM usage e JOIN users u ON u.user_id = e.user_id
  WHERE {RANGE} GROUP BY u.user_id, u.email ORDER BY round(sum(cost_usd), 4) DESC NULLS LAST, email LIMIT 10)""")
def _(t):
    return T.top_users(bound(t, "usage"), bound(t, "users"), DAYS, AS_OF)


@query("spend_by_request", with_bindings("usage") + f"""
SELECT request_id, user_id, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS at, {SPEND}
FROM usage WHERE {RANGE} GROUP BY request_id, user_id""")
def _(t):
    out = T.spend_by_request(bound(t, "usage"), DAYS, AS_OF)
    return out.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("spend_request_page", with_bindings("usage", "users") + f"""
, g AS (SELECT request_id, user_id, max(created_at) AS last_at, count(*) AS request_calls FROM usage WHERE {RANGE}
  GROUP BY 1, 2 ORDER BY last_at DESC, request_id, user_id LIMIT 20 OFFSET 20)
SELECT e.request_id, e.user_id, request_calls, id, u.email, purpose, model,
  row_number() OVER (PARTITION BY e.request_id, e.user_id ORDER BY created_at, id) AS call_no
FROM usage e JOIN g ON g.request_id = e.request_id AND g.user_id = e.user_id
LEFT JOIN users u ON u.user_id = e.user_id WHERE {RANGE}""")
def _(t):
    out = T.request_page(bound(t, "usage"), bound(t, "users"), DAYS, AS_OF, page=2, size=20)
    return out.select(
        "request_id", "user_id", "request_calls", "id", "email", "purpose", "model", F.col("call_no").cast("bigint").alias("call_no")
    )


@query("traffic_per_day", with_bindings("traffic") + f"""
SELECT strftime(day, '%Y-%m-%d') AS day, CAST(sum(requests) AS BIGINT) AS requests,
  CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(ai_calls) AS BIGINT) AS ai_calls
FROM traffic WHERE {RANGE} GROUP BY day""")
def _(t):
    return text_day(T.traffic_per_day(bound(t, "traffic"), DAYS, AS_OF))


@query("traffic_per_area", with_bindings("traffic") + f"""
SELECT area, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(errors) AS BIGINT) AS errors,
  CAST(sum(ai_calls) AS BIGINT) AS ai_calls,
  round(sum(requests) / sum(sum(requests)) OVER (), 6) AS share
FROM traffic WHERE {RANGE} GROUP BY area""")
def _(t):
    return T.traffic_per_area(bound(t, "traffic"), DAYS, AS_OF)


@query("daily_active_users", with_bindings("traffic") + f"""
SELECT strftime(day, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS active_users FROM traffic WHERE {RANGE} GROUP BY day""")
def _(t):
    return text_day(T.active_users(bound(t, "traffic"), DAYS, AS_OF))


@query("signups_per_day", """
SELECT strftime(CAST(ts + INTERVAL 7 HOUR AS DATE), '%Y-%m-%d') AS day, count(*) AS signups FROM events
WHERE event_type = 'signup' AND CAST(ts + INTERVAL 7 HOUR AS DATE) >= DATE '2024-01-01' GROUP BY 1""")
def _(t):
    made = t.events.filter(F.col("event_type") == "signup")
    return text_day(T.signups(made, "ts", DAYS, AS_OF))


_SERIES = f"""
, s AS (SELECT c.day, coalesce(requests, 0) AS requests, coalesce(errors, 0) AS errors,
  coalesce(ai_calls, 0) AS ai_calls, coalesce(active_users, 0) AS active_users, coalesce(signups, 0) AS signups
FROM {CAL} c LEFT JOIN (SELECT day, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(errors) AS BIGINT) AS errors,
  CAST(sum(ai_calls) AS BIGINT) AS ai_calls, count(DISTINCT user_id) AS active_users,
  count(*) FILTER (WHERE area = 'signup') AS signups FROM traffic WHERE {RANGE} GROUP BY day) p ON c.day = p.day)
"""


def _series(t):
    made = t.events.filter(F.col("event_type") == "signup")
    return T.traffic_series(bound(t, "traffic"), made, "ts", DAYS, AS_OF)


@query("traffic_series", with_bindings("traffic") + _SERIES + "SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM s")
def _(t):
    return text_day(_series(t))


@query("traffic_totals", with_bindings("traffic") + _SERIES + """
SELECT CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(errors) AS BIGINT) AS errors,
  CAST(sum(ai_calls) AS BIGINT) AS ai_calls, CAST(sum(signups) AS BIGINT) AS signups,
  CAST(sum(active_users) FILTER (WHERE day = DATE '2024-01-30') AS BIGINT) AS active_today,
  (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM orders) AS documents FROM s""")
def _(t):
    return T.traffic_totals(_series(t), t.customer, t.orders, AS_OF)


_LOG = """
, l AS (SELECT CAST(ts + INTERVAL 7 HOUR AS DATE) AS day, substr(nullif(split_part(path, '/', 3), ''), 1, 24) AS area,
  method, path, status, user_id, ts FROM requests WHERE path LIKE '/api/%' AND method <> 'OPTIONS')
, c AS (SELECT *, CASE WHEN status >= 500 THEN 1 ELSE 0 END AS e,
  CASE WHEN status < 400 AND method = 'POST' AND path = '/api/translate' THEN 1 ELSE 0 END AS a FROM l)
"""


@query("request_log_counts", with_bindings("requests") + _LOG + """
SELECT strftime(day, '%Y-%m-%d') AS day, area, count(*) AS requests, CAST(sum(e) AS BIGINT) AS errors,
  CAST(sum(a) AS BIGINT) AS ai_calls FROM c GROUP BY day, area""")
def _(t):
    log = T.request_counts(bound(t, "requests"))
    return text_day(log.groupBy("day", "area").agg(*(F.sum(c).alias(c) for c in ("requests", "errors", "ai_calls"))))


@query("request_area_and_endpoint", with_bindings("requests") + """
SELECT event_id, CASE WHEN path LIKE '/api/%' THEN substr(split_part(path, '/', 3), 1, 24) END AS area,
  regexp_replace(path, '/[0-9]+/', '/{id}/') AS endpoint FROM requests""")
def _(t):
    return bound(t, "requests").select(
        "event_id", S.area(F.col("path")).alias("area"), S.endpoint_template(F.col("path")).alias("endpoint")
    )


@query("usage_sums_per_request", with_bindings("usage") + """
SELECT request_id, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens
FROM usage GROUP BY request_id""")
def _(t):
    return T.usage_sums(bound(t, "usage"), ["request_id"])


@query("quota_used", with_bindings("usage") + """
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, count(*) AS used FROM usage WHERE ok GROUP BY user_id, day""")
def _(t):
    return text_day(T.quota_used(bound(t, "usage").filter("ok")))


@query("quota_left", with_bindings("usage") + """
SELECT user_id, CAST(greatest(0, 20 - CASE WHEN max(day) = DATE '2024-01-30' THEN max_by(used, day) ELSE 0 END) AS BIGINT)
  AS remaining FROM (SELECT user_id, day, count(*) AS used FROM usage GROUP BY user_id, day) GROUP BY user_id""")
def _(t):
    return T.quota_left(T.quota_used(bound(t, "usage")), S.AI_DAILY_LIMIT, AS_OF)


@query("admin_usage_today", with_bindings("users") + """
SELECT user_id, CASE WHEN ai_used_on = DATE '2024-01-15' THEN ai_used ELSE 0 END AS used_today,
  greatest(0, 20 - CASE WHEN ai_used_on = DATE '2024-01-15' THEN ai_used ELSE 0 END) AS remaining FROM users""")
def _(t):
    today = F.lit("2024-01-15").cast("date")
    return bound(t, "users").select(
        "user_id",
        S.used_today(F.col("ai_used"), F.col("ai_used_on"), today).alias("used_today"),
        S.remaining(S.AI_DAILY_LIMIT, F.col("ai_used"), F.col("ai_used_on"), today).alias("remaining"),
    )


@query("call_costs", """
WITH p(model, i, c, o) AS (VALUES ('gpt-4.1', 2.0, 0.5, 8.0), ('gpt-4.1-mini', 0.4, 0.1, 1.6), ('gpt-4o', 2.5, 1.25, 10.0)),
u AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN 'gpt-4.1-2025-04-14' WHEN event_type = 'view' THEN 'gpt-4o'
  WHEN event_type = 'error' THEN 'unknown' ELSE 'gpt-4.1-mini' END AS model,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 10 AS pr, CAST(floor(value * 20) AS BIGINT) AS ca,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS co, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS w FROM events)
SELECT event_id, round(1e6 * CASE WHEN pr <= 0 AND co <= 0 AND w <= 0 THEN 0.0 ELSE ((pr - least(ca, pr)) * i
  + least(ca, pr) * c + co * o) / 1000000.0 + w * 0.01 END, 2) AS micro_usd
FROM u LEFT JOIN p ON p.model = regexp_replace(u.model, '-[0-9]{4}-[0-9]{2}-[0-9]{2}$', '')""")
def _(t):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    kind = F.col("event_type")
    model = (
        F.when(kind == "signup", "gpt-4.1-2025-04-14").when(kind == "view", "gpt-4o").when(kind == "error", "unknown")
        .otherwise("gpt-4.1-mini")
    )
    cost = S.call_cost(model, k * 10, F.floor(F.col("value") * 20), k, (kind == "click").cast("int"))
    return t.events.select("event_id", F.round(cost * 1e6, 2).alias("micro_usd"))


@query("vietnam_day", "SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d') AS day FROM events")
def _(t):
    return text_day(t.events.select("event_id", S.day_vn(F.col("ts")).alias("day")))


@query("usage_token_shapes", """
WITH u AS (SELECT event_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE k END AS prompt,
  CASE WHEN event_type IN ('view', 'click') THEN k // 2 ELSE 0 END AS cached,
  CASE WHEN event_type IN ('view', 'click') THEN k * 2 ELSE 0 END AS completion FROM u""")
def _(t):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    half = F.floor(k / 2)
    chat = F.format_string(
        '{"usage":{"prompt_tokens":%d,"completion_tokens":%d,"prompt_tokens_details":{"cached_tokens":%d}}}', k, k * 2, half
    )
    responses = F.format_string(
        '{"usage":{"input_tokens":%d,"output_tokens":%d,"input_tokens_details":{"cached_tokens":%d}}}', k, k * 2, half
    )
    embeddings = F.format_string('{"usage":{"prompt_tokens":%d}}', k)
    kind = F.col("event_type")
    answer = (
        F.when(kind == "view", chat).when(kind == "click", responses)
        .when(kind == "error", F.lit('{"usage":{"prompt_tokens":-4,"completion_tokens":"x"}}')).otherwise(embeddings)
    )
    return t.events.select("event_id", S.usage_tokens(answer).alias("u")).select("event_id", "u.*")
