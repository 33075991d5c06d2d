"""Queries over events: engagement, edition windows, rate limits, streaks, queues and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..operators import tables
from .registry import query

DAY = 86400
BEGAN = 1704067200
AS_OF = BEGAN + 31 * DAY
AT = "CAST(epoch(ts) AS BIGINT)"
E = f"e AS (SELECT event_id, user_id, event_type, value, props, {AT} AS at_s FROM events)".replace(AT, "CAST(floor(epoch(ts)) AS BIGINT)")


def timed(t) -> DataFrame:
    return t("events").withColumn("at_s", times.epoch("ts"))


@query("SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'view' THEN 1 ELSE 0 END)::BIGINT AS engagement FROM events GROUP BY user_id")
def engagement_by_user(t):
    points = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "view", 1).otherwise(0)
    return t("events").groupBy("user_id").agg(F.sum(points).alias("engagement"))


SLOT = """(at_s + 28800) // 86400 * 86400 - 28800 + CASE WHEN (at_s + 28800) % 86400 >= 64800 THEN 64800 WHEN (at_s + 28800) % 86400 >= 39600 THEN 39600
  WHEN (at_s + 28800) % 86400 >= 18000 THEN 18000 ELSE -21600 END"""


@query(f"WITH {E} SELECT {SLOT} AS slot, count(*) AS n, count(DISTINCT user_id) AS users FROM e GROUP BY 1")
def slot_window_counts(t):
    return timed(t).groupBy(times.slot_start(F.col("at_s")).alias("slot")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(f"WITH {E} SELECT strftime(DATE '1970-01-01' + CAST((at_s + 28800) // 86400 AS INT), '%Y-%m-%d') AS day, count(*) AS n FROM e GROUP BY 1")
def beijing_day_key(t):
    return timed(t).groupBy(F.date_format(times.beijing_date(F.col("at_s")), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT strftime(date_trunc('week', DATE '1970-01-01' + CAST((at_s + 28800) // 86400 AS INT)), '%Y-%m-%d') AS week, event_type, count(*) AS n FROM e GROUP BY 1, 2")
def week_start_rollup(t):
    return timed(t).groupBy(F.date_format(times.week_start(F.col("at_s")), "yyyy-MM-dd").alias("week"), "event_type").agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT event_id FROM e WHERE (at_s + 28800) % 86400 // 3600 BETWEEN 1 AND 4")
def quiet_hours_filter(t):
    return timed(t).where(times.is_quiet(F.col("at_s"))).select("event_id")


@query(f"""WITH {E}, l AS (SELECT event_id, user_id, coalesce(at_s - lag(at_s) OVER (PARTITION BY user_id ORDER BY at_s, event_id) < 30, false) AS limited FROM e)
SELECT user_id, count(*) AS n, CAST(count_if(limited) AS BIGINT) AS limited FROM l GROUP BY user_id""")
def rate_limit_lag30s(t):
    return tables.rate_limited(timed(t), "user_id", "at_s", "event_id").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("limited").alias("limited"))


@query(f"""WITH {E}, n AS (SELECT *, CASE WHEN at_s - lag(at_s) OVER (PARTITION BY user_id ORDER BY at_s, event_id) <= 3600 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY at_s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM n)
SELECT user_id, session, count(*) AS n_events, min(at_s) AS began, max(at_s) AS ended FROM s GROUP BY user_id, session""")
def session_gap60s(t):
    return tables.sessions(timed(t), "user_id", "at_s", "event_id", gap=3600)


@query(f"""WITH {E}, i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY at_s, event_id) AS island FROM e),
s AS (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY at_s, event_id) AS streak FROM i)
SELECT user_id, CAST(max(streak) AS BIGINT) AS longest FROM s GROUP BY user_id""")
def error_streak_islands(t):
    return tables.error_streaks(timed(t), "user_id", ["at_s", "event_id"], F.col("event_type") == "error").groupBy("user_id").agg(F.max("streak").alias("longest"))


@query(f"WITH {E} SELECT event_type, max(at_s) AS cursor FROM e WHERE at_s <= {AS_OF} GROUP BY event_type")
def cursor_max_ts(t):
    return timed(t).where(F.col("at_s") <= AS_OF).groupBy("event_type").agg(F.max("at_s").alias("cursor"))


@query(f"WITH {E} SELECT event_id, at_s FROM e WHERE at_s >= {AS_OF - 16 * DAY} ORDER BY at_s, event_id LIMIT 20")
def delta_since(t):
    return tables.delta(timed(t), "at_s", F.lit(AS_OF - 16 * DAY), tie="event_id").select("event_id", "at_s")


@query(f"WITH {E} SELECT event_type, count(*) AS n FROM e WHERE at_s + CASE WHEN event_type = 'purchase' THEN {30 * DAY} ELSE {7 * DAY} END > {AS_OF} GROUP BY event_type")
def ttl_expired_counts(t):
    return tables.without_expired(timed(t), "at_s", 7 * DAY, F.col("event_type") == "purchase", AS_OF).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT at_s // 3600 AS hour, count(*) AS asked, least(count(*), 10) AS granted FROM e GROUP BY 1")
def hourly_budget(t):
    return tables.capped_counter(timed(t).withColumn("hour", F.floor(F.col("at_s") / 3600)), ["hour"], 10)


@query(f"""WITH {E}, l AS (SELECT user_id, event_type, max(at_s) AS at_s FROM e GROUP BY user_id, event_type)
SELECT user_id, event_type, at_s, CAST(row_number() OVER (PARTITION BY user_id ORDER BY at_s DESC, event_type) AS INT) AS rank FROM l WHERE at_s > {AS_OF - 20 * DAY} QUALIFY rank <= 3""")
def history_recent_cap(t):
    return tables.recent_per_user(timed(t), "user_id", "event_type", "at_s", cap=3, ttl=20 * DAY, as_of=AS_OF)


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_props_extract(t):
    k = F.from_json("props", "k long")["k"]
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


STATE = "CASE event_type WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'pending' END"


@query(f"""WITH {E}, s AS (SELECT user_id, at_s, event_id, {STATE} AS state FROM e),
l AS (SELECT user_id, arg_max(state, (at_s, event_id)) AS state, max(at_s) AS since, count_if(state = 'failed') AS failures FROM s GROUP BY user_id)
SELECT user_id, CASE WHEN failures >= 30 THEN 'discarded' WHEN state = 'processing' AND since < {AS_OF} - 300 THEN 'pending' WHEN state = 'failed' THEN 'pending' ELSE state END AS state, since, CAST(failures AS BIGINT) AS failures FROM l""")
def queue_states(t):
    state = F.when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("pending")
    return tables.queue_state(timed(t).withColumn("state", state), "user_id", "at_s", "event_id", AS_OF, retries=30)


@query(f"""WITH {E}, d AS (SELECT at_s // 86400 AS day, count(*) AS total, count_if(event_type = 'error') AS failed FROM e GROUP BY 1)
SELECT day, total, CAST(failed AS BIGINT) AS failed, CASE WHEN failed = total AND total > 0 THEN 'all-failed' WHEN failed > 0 THEN 'partial' ELSE 'none' END AS level, failed > total * CAST(0.2 AS DOUBLE) AS alert FROM d""")
def health_summary(t):
    d = timed(t).groupBy(F.floor(F.col("at_s") / DAY).alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return d.withColumn("level", tables.health_level(F.col("failed"), F.col("total"))).withColumn("alert", F.col("failed") > F.col("total") * 0.2)


@query(f"""WITH {E}, s AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS active, at_s, event_id FROM e WHERE event_type IN ('purchase', 'error'))
SELECT user_id, arg_max(active, (at_s, event_id)) AS active FROM s GROUP BY user_id""")
def soft_delete_latest_wins(t):
    e = timed(t).where(F.col("event_type").isin("purchase", "error"))
    return e.groupBy("user_id").agg(F.max_by(F.col("event_type") == "purchase", F.struct("at_s", "event_id")).alias("active"))


@query(f"""WITH {E}, n AS (SELECT *, CASE WHEN at_s - lag(at_s) OVER (PARTITION BY event_type ORDER BY at_s, event_id) <= 60 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY event_type ORDER BY at_s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM n)
SELECT event_type, session, count(*) AS n_events, min(at_s) AS began, max(at_s) AS ended FROM s GROUP BY event_type, session""")
def sessions_of_a_minute(t):
    return tables.sessions(timed(t), "event_type", "at_s", "event_id", gap=60)


@query(f"""WITH {E}, s AS (SELECT user_id, at_s // 86400 AS day, at_s, event_id, {STATE} AS state FROM e),
l AS (SELECT user_id || '-' || day AS item, arg_max(state, (at_s, event_id)) AS state, max(at_s) AS since, count_if(state = 'failed') AS failures FROM s GROUP BY 1)
SELECT item, CASE WHEN failures >= 3 THEN 'discarded' WHEN state = 'processing' AND since < {AS_OF} - 300 THEN 'pending' WHEN state = 'failed' THEN 'pending' ELSE state END AS state, since, CAST(failures AS BIGINT) AS failures FROM l""")
def queue_states_three_retries(t):
    state = F.when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("pending")
    item = F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("at_s") / DAY).cast("string"))
    return tables.queue_state(timed(t).withColumn("item", item).withColumn("state", state), "item", "at_s", "event_id", AS_OF)
