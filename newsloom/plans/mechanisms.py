"""Queries over selection in rounds, limits, writers, trees, cards and the registry of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..operators import folds, settle
from ..shared import place, remove, written
from ..sources import feeds, html, registry as source_registry, trees
from ..streaming import merges
from . import registry
from .documents import ITEMS, items
from .events import BEGAN, DAY, E, timed
from .registry import query

_S = "[\\s　 ﻿]"
_TRIM = f"regexp_replace({{}}, '^{_S}+|{_S}+$', '', 'g')"

# Selection and limits -------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {ITEMS}, r AS (SELECT doc_id, source || ':' || n_chars % 50 AS k1, nullif(left(split_part(coalesce(text, ''), chr(10), 1), 12), '') AS k2, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE source IS NOT NULL),
f AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS doc_id, false AS kept, CAST([] AS VARCHAR[]) AS a, CAST([] AS VARCHAR[]) AS b
  UNION ALL SELECT n, doc_id, ok, CASE WHEN ok THEN list_append(a, k1) ELSE a END, CASE WHEN ok AND k2 IS NOT NULL THEN list_append(b, k2) ELSE b END
  FROM (SELECT r.*, f.a, f.b, NOT list_contains(f.a, k1) AND (k2 IS NULL OR NOT list_contains(f.b, k2)) AS ok FROM f JOIN r ON r.n = f.n + 1))
SELECT doc_id FROM f WHERE kept""")
def either_key_first_come(t):
    title = F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 12)
    d = t("documents").where("source is not null").select("doc_id", F.concat_ws(":", "source", (F.col("n_chars") % 50).cast("string")).alias("k1"), F.nullif(title, F.lit("")).alias("k2"))
    return settle.first_come_by_keys(d, ["k1", "k2"], F.col("doc_id")).select("doc_id")


@query(f"""WITH RECURSIVE {E}, r AS (SELECT event_type, event_id, at_s, row_number() OVER (PARTITION BY event_type ORDER BY at_s, event_id) AS n FROM e),
f AS (SELECT event_type, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, true AS accepted, CAST(NULL AS BIGINT) AS last, CAST(0 AS BIGINT) AS hits FROM (SELECT DISTINCT event_type FROM r)
  UNION ALL SELECT event_type, n, event_id, ok, CASE WHEN ok THEN at_s ELSE last END, CASE WHEN NOT ok THEN hits WHEN inside THEN hits + 1 ELSE 1 END
  FROM (SELECT r.event_type, r.n, r.event_id, r.at_s, f.last, f.hits, coalesce(r.at_s - f.last < 3600, false) AS inside, NOT coalesce(r.at_s - f.last < 3600 AND f.hits >= 5, false) AS ok FROM f JOIN r ON r.event_type = f.event_type AND r.n = f.n + 1))
SELECT event_id, accepted FROM f WHERE n > 0""")
def hits_limited_five(t):
    """Five hits of an event type in an hour that slides: events are too sparse for a minute of a user."""
    return folds.limited_hits(timed(t).select("event_id", "event_type", "at_s"), "event_type", "at_s", "event_id", 5, 3600).select("event_id", "accepted")


@query(f"""WITH {E}, d AS (SELECT at_s // 86400 AS day, event_type, count(*) AS n FROM e GROUP BY 1, 2),
c AS (SELECT day, CAST(sum(n) AS BIGINT) AS kept, CAST(sum(n) FILTER (WHERE event_type = 'view') * 3 AS BIGINT) AS duplicates, CAST(sum(n) FILTER (WHERE event_type = 'error') * 2 AS BIGINT) AS filtered, CAST(sum(n) FILTER (WHERE event_type = 'signup') AS BIGINT) AS invalid FROM d GROUP BY day)
SELECT day, concat_ws(',', CASE WHEN day % 7 >= 3 THEN 'disabled-empty' END, CASE WHEN kept > 0 AND duplicates / CAST(kept AS DOUBLE) > CAST(0.5 AS DOUBLE) THEN 'high-duplicate' END, CASE WHEN kept >= 200 THEN 'bulk-insert' END,
  CASE WHEN kept > 0 AND (coalesce(filtered, 0) + coalesce(invalid, 0)) / CAST(kept AS DOUBLE) > CAST(0.5 AS DOUBLE) THEN 'high-filter' END) AS alerts FROM c""")
def source_run_alerts(t):
    n = lambda kind, times=1: (F.count_if(F.col("event_type") == kind) * times)
    runs = timed(t).groupBy(F.floor(F.col("at_s") / DAY).alias("day")).agg(F.count("*").alias("kept"), F.count("*").alias("written"), n("view", 3).alias("duplicates"), n("error", 2).alias("filtered"), n("signup").alias("invalid"))
    return merges.source_alerts(runs, F.col("day") % 7).select("day", F.array_join("alerts", ",").alias("alerts"))


# Writers --------------------------------------------------------------------------------------------------------------


def insert_new_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What appending documents to a table of a third of them writes and counts, and the table after it."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    keyed = d.select("doc_id", F.when(F.col("doc_id") % 50 != 7, F.sha2("text", 256)).alias("body_key"), F.nullif(F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 40), F.lit("")).alias("title_key"))
    table = place(spark, "raw")
    sinks.existing(spark, table, keyed.schema)
    keyed.where("doc_id % 3 = 0 AND body_key IS NOT NULL").write.mode("append").parquet(table)
    counts = sinks.append_new(keyed.where("doc_id % 3 <> 0"), table, ["body_key", "title_key"], [F.col("doc_id")])
    have = spark.read.parquet(table).agg(F.count("*").alias("in_table"), F.sum("doc_id").alias("ids"))
    out = written(have.select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()], "in_table", "ids"), "insert-counts")
    remove(spark, table)
    return out


def snapshot_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest twenty documents of each language, then one language's snapshot replaced by its shortest."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", "lang")
    table = place(spark, "snapshot")
    sinks.replace_snapshot(d, table, "lang", [F.desc("n_chars"), F.col("doc_id")])
    sinks.replace_snapshot(d.where("lang = 'de'"), table, "lang", [F.col("n_chars"), F.col("doc_id")])
    out = written(spark.read.schema("doc_id long, n_chars long, lang string").parquet(table), "snapshot-rows")
    remove(spark, table)
    return out


def issue_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of days published three times, the last a day only, and what purging leaves in the archive."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day_no", F.datediff(F.to_date("ts"), F.lit("2024-01-01")))
    rows = lambda low, high, least: e.where(F.col("day_no").between(low, high) & (F.col("value") >= least)).select("event_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    where = place(spark, "issues")
    book = sinks.Issues(spark, where, "event_id long, value double")
    book.publish(rows(0, 9, 20), BEGAN)
    book.publish(rows(5, 14, 30), BEGAN + DAY)
    book.publish(rows(9, 9, 40), BEGAN + 8 * DAY)
    book.purge(BEGAN + 9 * DAY)
    count = [F.count("*").alias("n"), F.sum("event_id").alias("ids")]
    state = book.current().groupBy("day", "version").agg(*count).withColumn("kept_in", F.lit("current"))
    state = state.unionByName(book.archive().groupBy("day", "version").agg(*count).withColumn("kept_in", F.lit("archive")))
    state = state.unionByName(book.pointer().select("day", "version", F.lit(0).cast("long").alias("n"), F.col("upgraded_at").alias("ids"), F.lit("pointer").alias("kept_in")))
    out = written(state, "issue-state")
    remove(spark, where)
    return out


# Sources --------------------------------------------------------------------------------------------------------------


@query("""SELECT conv_id, regexp_replace(regexp_replace(coalesce(string_agg(text, chr(10) ORDER BY turn) || chr(10), '') || 'end', '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM conversations GROUP BY conv_id""")
def rich_text_tree(t):
    """Conversations as trees, a level deeper with each turn."""
    turns = t("conversations").groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("turn", "text")))).alias("turns"))
    node = F.aggregate("turns", F.lit('"end"'), lambda inner, x: F.concat(F.lit('{"type":"list","text":"not shown","children":['), F.to_json(F.struct(x["text"].alias("text"))), F.lit(","), inner, F.lit("]}")))
    return trees.tree_texts(turns.select("conv_id", F.concat(F.lit('{"root":{"children":['), node, F.lit("]}}")).alias("json")), "conv_id", "json")


#: Site, pattern of a card's address, pattern of its date.
SITES = [
    ("example.com", r"""<a[^>]+href\s*=\s*["'](/[^"']+)["'][^>]*>""", r"(\d{4}-\d{2}-\d{2})"),
    ("example.net", r"""href\s*=\s*["']([^"']+)["']""", r"([A-Z][a-z]{2,8}) "),
    ("example.org", r"""<a[^>]+href\s*=\s*["']([^"']*[aeiou][^"']*)["'][^>]*>""", r">([a-z]{3,8})<"),
]


def _site_sql(site: str, link: str, date: str) -> str:
    link, date = link.replace("'", "''"), date.replace("'", "''")
    return f"""SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS host, html, regexp_extract_all(html, '{link}') AS whole, regexp_extract_all(html, '{link}', 1) AS href, string_split_regex(html, '{link}') AS parts, '{date}' AS date_re
  FROM pages WHERE regexp_matches(url, '^https?://([^/?#]*[.])?{site.replace(".", "[.]")}([/?#]|$)')"""


_CARD_TITLE = html.CARD_TITLE.replace("'", "''")
_DATE = "CASE " + " ".join(f"WHEN date_re = '{d.replace(chr(39), chr(39) * 2)}' THEN regexp_extract(around, '{d.replace(chr(39), chr(39) * 2)}', 1)" for _, _, d in SITES) + " END"


@query(f"""WITH m AS ({" UNION ALL ".join(_site_sql(*s) for s in SITES)}),
i AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m),
s AS (SELECT page_id, html, i, date_re, CASE WHEN starts_with(href[i], '/') THEN host || href[i] ELSE href[i] END AS url, length(whole[i]) AS n,
  CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS at_c FROM i),
f AS (SELECT * FROM s WHERE regexp_matches(url, '(?i)^https?://') QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY i) = 1),
k AS (SELECT *, substr(html, greatest(0, at_c - 400) + 1, at_c + n + 200 - greatest(0, at_c - 400)) AS around FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) <= 10)
SELECT page_id, url, {_DATE} AS date, trim(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(around, '{_CARD_TITLE}', 1), ''), regexp_extract(around, '{_CARD_TITLE}', 2)), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM k""")
def site_cards(t):
    spark = t("pages").sparkSession
    rules = F.broadcast(spark.createDataFrame(SITES, "site string, link string, date_rule string"))  # one row a site
    host = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    ruled = t("pages").join(rules, (host == F.col("site")) | F.endswith(host, F.concat(F.lit("."), "site")))
    found = ruled.select("page_id", F.explode(html.cards(F.col("html"), F.col("url"), F.col("link"), F.col("date_rule"))).alias("c"))
    return found.select("page_id", "c.url", "c.title", "c.date")


def sources_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three sources; one that is off and one that fails give none."""
    read = lambda name, *columns: lambda s: s.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    adapters = [
        source_registry.Adapter("documents", read("documents", F.col("doc_id").alias("id"), "source")), source_registry.Adapter("benchmark", read("benchmark", F.col("item_id").alias("id"))),
        source_registry.Adapter("pages", read("pages", F.col("page_id").alias("id"), "url")), source_registry.Adapter("labels", read("labels", F.col("doc_id").alias("id")), enabled=False),
        source_registry.Adapter("gone", read("no such table", "id")),
    ]
    return source_registry.collected(spark, adapters, "id long")[0]


_NAME = _TRIM.format("title")


@query(f"""WITH {ITEMS}, n AS (SELECT id, {_NAME} AS name, {_TRIM.format("content")} AS body FROM items)
SELECT id, name AS title, CASE WHEN id % 3 > 0 THEN 'https://x.org/blog/p' || id ELSE 'https://x.org/blog' END AS url, CASE WHEN id % 4 > 0 THEN strftime(make_timestamp(({BEGAN} + id * 60) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') ELSE '' END AS pub_date,
  'data:' || CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) WHEN id % 3 > 0 THEN 'p' || id ELSE name END AS guid, CASE WHEN body <> '' THEN body ELSE name END AS content, 'a,b' AS category FROM n WHERE name <> ''""")
def company_news_parsed(t):
    i = F.col("id")
    news = F.struct(
        F.col("title"), F.col("content").alias("summary"), F.when(i % 4 > 0, ((F.lit(BEGAN) + i * 60) * 1000).cast("string")).alias("publishDate"), F.when(i % 3 > 0, F.concat(F.lit("p"), i.cast("string"))).alias("slug"),
        F.when(i % 2 == 0, i.cast("string")).alias("newsId"), F.array(F.lit("a"), F.lit("b")).alias("tags"),
    )
    d = items(t("documents")).select("id", F.to_json(F.struct(F.array(news).alias("data"))).alias("json"))
    return d.select("id", F.explode(feeds.company_items(F.col("json"), "https://x.org/blog")).alias("e")).select("id", *[F.col(f"e.{c}") for c in ("title", "url", "pub_date", "guid", "content", "category")])


@query(f"""WITH {ITEMS}, n AS (SELECT id, {_NAME} AS name, {_TRIM.format("content")} AS body FROM items)
SELECT id, CASE WHEN name <> '' THEN name ELSE '(无标题)' END AS title, 'https://x.org/' || id AS url, CASE WHEN id % 2 = 0 THEN 'g' || id ELSE 'wechat:' || sha256('https://x.org/' || id) END AS guid, body AS content,
  CASE WHEN body <> '' THEN body ELSE name END AS desc FROM n""")
def account_messages_parsed(t):
    i = F.col("id").cast("string")
    row = F.struct("title", F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://x.org/"), i)).alias("link"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("https://x.org/"), i)).alias("url"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("g"), i)).alias("guid"), F.col("content").alias("digest"))
    listed = F.to_json(F.array(row))
    d = items(t("documents")).select("id", F.when(F.col("id") % 2 == 0, listed).otherwise(F.concat(F.lit('{"items":'), listed, F.lit("}"))).alias("json"))
    return d.select("id", F.explode(feeds.account_items(F.col("json"))).alias("e")).select("id", *[F.col(f"e.{c}") for c in ("title", "url", "guid", "content", "desc")])


registry.QUERIES |= {f.__name__: f for f in (insert_new_counts, snapshot_partitions, issue_versions, sources_collected)}
registry.ORACLE_SQL["insert_new_counts"] = """WITH k AS (SELECT doc_id, CASE WHEN doc_id % 50 <> 7 THEN sha256(text) END AS body_key, nullif(left(split_part(coalesce(text, ''), chr(10), 1), 40), '') AS title_key FROM documents),
old AS (SELECT * FROM k WHERE doc_id % 3 = 0 AND body_key IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY body_key ORDER BY doc_id) AS b, row_number() OVER (PARTITION BY title_key ORDER BY doc_id) AS h FROM k WHERE doc_id % 3 <> 0),
j AS (SELECT *, body_key IS NULL AS failed, b > 1 OR body_key IN (SELECT body_key FROM old) OR (title_key IS NOT NULL AND (h > 1 OR title_key IN (SELECT title_key FROM old WHERE title_key IS NOT NULL))) AS twice FROM n),
c AS (SELECT count_if(NOT failed AND NOT twice) AS written, count_if(NOT failed AND twice) AS duplicates, count_if(failed) AS failed, CAST(coalesce(sum(doc_id) FILTER (WHERE NOT failed AND NOT twice), 0) AS BIGINT) AS ids FROM j)
SELECT CAST(written AS BIGINT) AS written, CAST(duplicates AS BIGINT) AS duplicates, CAST(failed AS BIGINT) AS failed, CAST(written + (SELECT count(*) FROM old) AS BIGINT) AS in_table, CAST(ids + (SELECT sum(doc_id) FROM old) AS BIGINT) AS ids FROM c"""
registry.ORACLE_SQL["snapshot_partitions"] = """SELECT doc_id, n_chars, lang FROM (SELECT doc_id, n_chars, lang, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN lang = 'de' THEN n_chars ELSE -n_chars END, doc_id) AS n FROM documents) WHERE n <= 20"""
registry.ORACLE_SQL["issue_versions"] = f"""WITH e AS (SELECT event_id, value, strftime(ts, '%Y-%m-%d') AS day, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events),
p AS (SELECT 1 AS run, * FROM e WHERE d BETWEEN 0 AND 9 AND value >= 20 UNION ALL SELECT 2, * FROM e WHERE d BETWEEN 5 AND 14 AND value >= 30 UNION ALL SELECT 3, * FROM e WHERE d = 9 AND value >= 40),
g AS (SELECT run, day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM p GROUP BY run, day),
v AS (SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY run) AS INT) AS version, lead(run) OVER (PARTITION BY day ORDER BY run) AS next_run FROM g)
SELECT day, version, n, ids, 'current' AS kept_in FROM v WHERE next_run IS NULL UNION ALL SELECT day, version, n, ids, 'archive' FROM v WHERE next_run = 3
UNION ALL SELECT day, version, 0, {BEGAN + 8 * DAY}, 'pointer' FROM v WHERE run = 3"""
registry.ORACLE_SQL["sources_collected"] = """SELECT 'documents' AS adapter, doc_id AS id, source, NULL AS url FROM documents UNION ALL SELECT 'benchmark', item_id, NULL, NULL FROM benchmark UNION ALL SELECT 'pages', page_id, NULL, url FROM pages"""
