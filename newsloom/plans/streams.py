"""Queries as Structured Streaming jobs over the events that have arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..shared import place, remove, written
from ..streaming import merges, queue
from ..streaming.drain import arrivals, drained
from . import events, registry


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def stream_dedup_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, whatever is sent again within a day."""
    timed = _stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    return drained(timed.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"))


def stream_slot_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each edition: rows are tagged in the stream, their counts are taken over what it wrote."""
    tagged = _stream(spark, sf_dir).select(times.slot_start(times.epoch("ts")).alias("slot"), "event_type")
    return drained(tagged).groupBy("slot").agg(F.count("*").alias("n"))


def stream_queue_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions on work items, a hundred events an item."""
    value = F.coalesce("value", F.lit(0.0))
    action = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type").isin("view", "click"), "claim").when(F.col("event_type") == "error", "failed")
    action = action.when(F.col("event_type") == "purchase", F.when(value < 5, "done").otherwise("postponed"))
    stream = _stream(spark, sf_dir)
    return drained(queue.queue_steps(stream, F.floor(F.col("event_id") / 100), F.col("event_id"), "ts", action)).withColumn("event", F.coalesce("event", F.lit(-1)))


#: Arrivals of the cursor's stream: a batch for ten days each, with rows that come a batch late or early.
CURSOR_BATCHES, TEN_DAYS = 3, 10 * events.DAY


def stream_cursor_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept and dropped, and the cursor reached, of each event type in each batch."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", times.epoch("ts").alias("at_s"))
    shift = F.when(F.col("event_id") % 10 == 3, 1).when(F.col("event_id") % 10 == 7, -1).otherwise(0)
    due = F.greatest(F.lit(0), F.least(F.lit(CURSOR_BATCHES - 1), F.floor((F.col("at_s") - events.BEGAN) / TEN_DAYS).cast("int") + shift))
    e = e.withColumn("now", events.BEGAN + (due + 1).cast("long") * TEN_DAYS)
    where = place(spark, "cursor")
    tables = merges.BatchTables(spark, where, kept="event_id long, event_type string, at_s long", cursors="event_type string, cursor long", counts="event_type string, kept long, late long, future long, undated long")
    parts = [e.where(F.col("now") == events.BEGAN + (k + 1) * TEN_DAYS) for k in range(CURSOR_BATCHES)]
    arrivals(parts, e.schema, lambda stream, log: merges.cursor_intake(stream, tables, "event_type", "at_s", F.col("now"), log, look_back=TEN_DAYS))
    reached = tables.read("counts").join(tables.read("cursors"), ["batch", "event_type"], "left")
    out = written(reached.withColumn("cursor", F.coalesce("cursor", F.lit(-1))), "cursor-counts")
    remove(spark, where)
    return out


def stream_daily_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of each day's brief, as the events of each quarter of a day arrive."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at_s", times.epoch("ts"))
    is_item = F.col("event_type").isin("purchase", "view") & (F.col("value") >= 30)
    rows = e.select(
        F.date_format(F.timestamp_seconds("at_s"), "yyyy-MM-dd").alias("day"), F.when(is_item, F.col("event_id")).alias("id"), F.when(is_item, F.col("value")).alias("score"),
        ((F.col("event_type") == "signup") & (F.col("value") > 40) & (F.col("at_s") % events.DAY >= events.DAY // 2)).alias("closes"), (F.col("at_s") % events.DAY / (events.DAY // 4)).cast("int").alias("quarter"),
    )
    where = place(spark, "brief")
    tables = merges.BatchTables(spark, where, items="day string, id long, score double", briefs=merges.BRIEF)
    rows = written(rows, "brief-rows")
    arrivals([rows.where(F.col("quarter") == k) for k in range(4)], rows.schema, lambda stream, log: merges.brief_intake(stream, tables, log, cap=5))
    out = written(tables.read("briefs").select("day", "version", "mode", "locked", "n_items", F.array_join(F.transform("items", lambda x: x["id"].cast("string")), ",").alias("ids")), "brief-versions")
    remove(spark, where)
    return out


registry.QUERIES |= {f.__name__: f for f in (stream_dedup_available_now, stream_slot_agg, stream_queue_steps, stream_cursor_intake, stream_daily_brief)}
registry.ORACLE_SQL["stream_dedup_available_now"] = "SELECT event_id, any_value(event_type) AS event_type FROM events GROUP BY event_id"
registry.ORACLE_SQL["stream_slot_agg"] = f"WITH {events.E} SELECT {events.SLOT} AS slot, count(*) AS n FROM e GROUP BY 1"

registry.ORACLE_SQL["stream_queue_steps"] = """WITH RECURSIVE e AS (SELECT event_id // 100 AS item, event_id AS event, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY event_id // 100 ORDER BY epoch_us(ts) // 1000, event_id) AS n,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'claim' WHEN 'error' THEN 'failed' ELSE CASE WHEN coalesce(value, 0) < 5 THEN 'done' ELSE 'postponed' END END AS action FROM events),
f AS (SELECT item, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event, CAST(NULL AS BIGINT) AS at_ms, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS BOOLEAN) AS accepted, CAST(NULL AS VARCHAR) AS said, CAST(NULL AS VARCHAR) AS status,
    CAST(0 AS INT) AS retries, CAST(0 AS INT) AS skips, CAST(0 AS INT) AS retries_said, CAST(0 AS INT) AS skips_said, CAST(NULL AS BIGINT) AS failed_at, CAST(NULL AS BIGINT) AS claimed_at, CAST(NULL AS BIGINT) AS lapsed FROM (SELECT DISTINCT item FROM e)
  UNION ALL
  SELECT item, n, event, at_ms, action, accepted, said, CASE WHEN said <> 'done' THEN said END, CASE WHEN said <> 'done' THEN retries ELSE 0 END, CASE WHEN said <> 'done' THEN skips ELSE 0 END, retries, skips,
    CASE WHEN said <> 'done' THEN failed_at END, CASE WHEN said <> 'done' THEN claimed_at END, lapsed
  FROM (SELECT item, n, event, at_ms, action, accepted, lapsed, retries, skips,
      CASE WHEN NOT accepted THEN was WHEN action = 'queued' THEN 'pending' WHEN action = 'claim' THEN 'processing' WHEN action = 'done' THEN 'done' WHEN retries >= 3 OR skips >= 20 THEN 'discarded' ELSE 'pending' END AS said,
      CASE WHEN accepted AND action = 'failed' THEN at_ms ELSE failed_at END AS failed_at, CASE WHEN accepted AND action = 'claim' THEN at_ms WHEN accepted AND action <> 'queued' THEN NULL ELSE claimed_at END AS claimed_at
    FROM (SELECT item, n, event, at_ms, action, was, lapsed, accepted, failed_at, claimed_at, CAST(retries + CAST(accepted AND action = 'failed' AS INT) AS INT) AS retries, CAST(skips + CAST(accepted AND action = 'postponed' AS INT) AS INT) AS skips
      FROM (SELECT *, CASE WHEN action = 'queued' THEN was IS NULL WHEN was IS NULL OR was = 'discarded' THEN false WHEN action = 'claim' THEN was = 'pending' AND (failed_at IS NULL OR at_ms - failed_at >= 600000) ELSE claimed_at IS NOT NULL END AS accepted
        FROM (SELECT e.item, e.n, e.event, e.at_ms, e.action, f.retries, f.skips, f.failed_at, f.claimed_at, CASE WHEN f.status = 'processing' AND e.at_ms > f.claimed_at + 300000 THEN f.claimed_at + 300000 END AS lapsed,
            CASE WHEN f.status = 'processing' AND e.at_ms > f.claimed_at + 300000 THEN 'pending' ELSE f.status END AS was FROM f JOIN e ON e.item = f.item AND e.n = f.n + 1))))),
last AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY item ORDER BY n DESC) = 1)
SELECT item, event, at_ms, action, accepted, said AS status, retries_said AS retries, skips_said AS skips FROM f WHERE n > 0
UNION ALL SELECT f.item, -1, f.lapsed, 'lapse', true, 'pending', b.retries_said, b.skips_said FROM f JOIN f b ON b.item = f.item AND b.n = f.n - 1 WHERE f.lapsed IS NOT NULL
UNION ALL SELECT item, -1, claimed_at + 300000, 'lapse', true, 'pending', retries, skips FROM last WHERE status = 'processing' AND claimed_at + 300000 <= (SELECT max(at_ms) FROM e) - 600000"""

_AT = f"CAST((at_s - {events.BEGAN}) // {TEN_DAYS} AS INT)"
registry.ORACLE_SQL["stream_cursor_intake"] = f"""WITH {events.E},
d AS (SELECT event_type, at_s, greatest(0, least({CURSOR_BATCHES - 1}, {_AT} + CASE event_id % 10 WHEN 3 THEN 1 WHEN 7 THEN -1 ELSE 0 END)) AS batch FROM e),
w AS (SELECT *, {events.BEGAN} + (batch + 1) * {TEN_DAYS} AS now FROM d),
s0 AS (SELECT *, now - {TEN_DAYS} AS start FROM w WHERE batch = 0), c0 AS (SELECT event_type, max(at_s) AS cursor FROM s0 WHERE at_s > start AND at_s <= now GROUP BY 1),
s1 AS (SELECT w.*, coalesce(cursor, now - {TEN_DAYS}) AS start FROM w LEFT JOIN c0 USING (event_type) WHERE batch = 1),
c1 AS (SELECT event_type, max(at_s) AS cursor FROM (SELECT event_type, at_s FROM s1 WHERE at_s > start AND at_s <= now UNION ALL SELECT event_type, cursor FROM c0) GROUP BY 1),
s2 AS (SELECT w.*, coalesce(cursor, now - {TEN_DAYS}) AS start FROM w LEFT JOIN c1 USING (event_type) WHERE batch = 2),
s AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)
SELECT batch, event_type, count_if(at_s > start AND at_s <= now) AS kept, count_if(at_s <= start) AS late, count_if(at_s > start AND at_s > now) AS future, CAST(0 AS BIGINT) AS undated,
  coalesce(max(at_s) FILTER (WHERE at_s > start AND at_s <= now), -1) AS cursor FROM s GROUP BY batch, event_type"""

registry.ORACLE_SQL["stream_daily_brief"] = f"""WITH {events.E},
r AS (SELECT strftime(DATE '1970-01-01' + CAST(at_s // 86400 AS INT), '%Y-%m-%d') AS day, CASE WHEN event_type IN ('purchase', 'view') AND value >= 30 THEN event_id END AS id, value,
  event_type = 'signup' AND value > 40 AND at_s % 86400 >= 43200 AS closes, at_s % 86400 // 21600 AS batch FROM e),
b AS (SELECT d.day, k.batch, (SELECT count(*) FROM r WHERE r.day = d.day AND r.batch = k.batch AND id IS NOT NULL) AS fresh, (SELECT count(*) FROM r WHERE r.day = d.day AND r.batch <= k.batch AND id IS NOT NULL) AS so_far,
  (SELECT coalesce(bool_or(closes), false) FROM r WHERE r.day = d.day AND r.batch = k.batch) AS closes FROM (SELECT DISTINCT day FROM r) d, range(4) AS k(batch)),
l AS (SELECT day, min(batch) FILTER (WHERE closes AND so_far > 0) AS lock FROM b GROUP BY day),
p AS (SELECT b.*, coalesce(b.batch = lock, false) AS locked FROM b JOIN l USING (day) WHERE so_far > 0 AND (fresh > 0 OR closes) AND batch <= coalesce(lock, 4)),
v AS (SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY batch) AS INT) AS version FROM p),
i AS (SELECT v.day, v.version, r.id, row_number() OVER (PARTITION BY v.day, v.version ORDER BY r.value DESC, r.id) AS place FROM v JOIN r ON r.day = v.day AND r.batch <= v.batch AND r.id IS NOT NULL)
SELECT v.day, v.version, CASE WHEN locked THEN 'summary' ELSE 'increment' END AS mode, locked, CAST(least(5, so_far) AS BIGINT) AS n_items, (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) FROM i WHERE i.day = v.day AND i.version = v.version AND place <= 5) AS ids FROM v"""
