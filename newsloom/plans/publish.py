"""Queries over publishing operators: guards, snapshots, merges, alerts, fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, publish, tables
from .documents import ITEMS, items
from .events import E, timed
from .registry import query
from .rules import TRIM

STATUS = "CASE WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'error' THEN 'failed' ELSE 'pending' END"


def _status():
    return F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("pending")


@query(f"""WITH q AS (SELECT {STATUS} AS status FROM events), g AS (SELECT count_if(status = 'pending') = 0 AND count_if(status = 'done') > 0 AS ready FROM q)
SELECT doc_id AS id FROM labels, g WHERE ready UNION ALL SELECT item_id FROM benchmark, g WHERE NOT ready""")
def batch_replace_guard(t):
    ready = publish.ready_to_replace(t("events").select(_status().alias("status")), ["pending"])
    return publish.replaced_if_ready(t("benchmark").select(F.col("item_id").alias("id")), t("labels").select(F.col("doc_id").alias("id")), ready)


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 20")
def snapshot_top20(t):
    return publish.snapshot(t("documents").select("lang", "doc_id", "n_chars"), "lang", [F.desc("n_chars"), F.col("doc_id")]).select("lang", "doc_id")


@query("SELECT doc_id, doc_id % 3 = 0 OR doc_id IN (SELECT doc_id FROM labels) AS stays, CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 1000 + 7 * 86400 END AS expires FROM documents")
def keep_list_delete(t):
    d = t("documents").select("doc_id", (F.col("doc_id") % 3 == 0).alias("retained"))
    kept, gone = publish.kept_only(d, t("labels").select("doc_id"), "doc_id")
    both = kept.withColumn("stays", F.lit(True)).unionByName(gone.withColumn("stays", F.lit(False)))
    return both.select("doc_id", "stays", publish.renewed_expiry(F.col("retained"), F.lit(5), F.lit(1000), 7).alias("expires"))


@query("""WITH d AS (SELECT n_chars AS id, lang AS category, doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 END AS rank FROM documents WHERE lang IN ('en', 'de', 'fr'))
SELECT id, category, doc_id FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, doc_id) = 1""")
def merged_category_pages(t):
    d = t("documents").select(F.col("n_chars").alias("id"), F.col("lang").alias("category"), "doc_id")
    return publish.merged_categories(d, "id", "category", ["en", "de", "fr"], [F.col("doc_id")]).select("id", "category", "doc_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, lang AS category FROM documents UNION ALL SELECT 'rec_' || doc_id, 'recommend' FROM documents WHERE n_chars > 3000")
def borrowed_items(t):
    d = t("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("category"), "n_chars")
    return publish.borrowed(d, F.col("n_chars") > 3000, "recommend").select("id", "category")


@query("""WITH f AS (SELECT lang AS category, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT category, count(DISTINCT doc_id) AS n_new FROM f GROUP BY category ORDER BY category LIMIT 1""")
def next_unseen_category(t):
    d = t("documents").select("doc_id", F.col("lang").alias("category"))
    return publish.next_category(d, t("labels"), "doc_id", F.col("category")).select("category", "n_new")


@query("""WITH c AS (SELECT conv_id, turn, string_split(text, chr(10)) AS sections FROM conversations WHERE coalesce(text, '') <> '')
SELECT conv_id, turn FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, sections ORDER BY turn) = 1""")
def first_section_entries(t):
    d = t("conversations").where("coalesce(text, '') <> ''").withColumn("sections", F.split("text", "\n", -1))
    return publish.first_of_each_section(d, "conv_id", F.col("sections"), [F.col("turn")]).select("conv_id", "turn")


@query(f"WITH q AS (SELECT event_id, ts, {STATUS} AS status FROM events) SELECT event_id FROM q WHERE status = 'pending' ORDER BY ts, event_id LIMIT 12")
def fifo_batch(t):
    return publish.oldest_batch(t("events").where(_status() == "pending"), [F.col("ts"), F.col("event_id")], 12).select("event_id")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-02' ORDER BY ts DESC, event_id LIMIT 30")
def newest_after_cursor(t):
    return publish.oldest_batch(t("events").where(F.col("ts") > F.lit("2024-01-02").cast("timestamp_ntz")), [F.desc("ts"), F.col("event_id")], 30).select("event_id")


@query("SELECT page_id FROM pages WHERE page_id % 4 <> 0 OR page_id % 8 = 0")
def changed_pages_only(t):
    known = t("pages").where("page_id % 4 = 0").select("page_id", F.sha2(F.when(F.col("page_id") % 8 == 0, "old").otherwise(F.coalesce("html", F.lit(""))), 256).alias("body_hash"))
    return publish.changed_pages(t("pages"), known, "page_id", F.coalesce("html", F.lit(""))).select("page_id")


@query(f"""WITH RECURSIVE {E}, k AS (SELECT DISTINCT event_type, at_s FROM e), r AS (SELECT event_type, min(at_s) AS at_s FROM k GROUP BY event_type
  UNION ALL SELECT r.event_type, min(k.at_s) FROM r JOIN k ON k.event_type = r.event_type AND k.at_s >= r.at_s + 3600 GROUP BY r.event_type, r.at_s)
SELECT event_type, at_s FROM r""")
def alert_debounce(t):
    return folds.debounced(timed(t), "event_type", "at_s").select("event_type", "at_s")


@query("""WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'review' END AS status, 'P' || (CAST(left(o_orderpriority, 1) AS INT) - 1) AS priority FROM orders)
SELECT status, count(*) AS n, CAST(count_if(priority IN ('P0', 'P1') AND status <> 'done') AS BIGINT) AS n_urgent_open FROM s GROUP BY status""")
def board_status(t):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("review")
    priority = F.concat(F.lit("P"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string"))
    return publish.board_summary(t("orders").select(status.alias("status"), priority.alias("priority")))


@query("SELECT source, avg(toxic) AS rate, avg(toxic) > 0.2 AS alert FROM documents JOIN labels USING (doc_id) GROUP BY source")
def safety_hit_rate(t):
    n = t("documents").select("doc_id", "source").join(t("labels"), "doc_id").groupBy("source").agg(F.sum("toxic").alias("blocked"), F.count("*").alias("checked"))
    return n.select("source", publish.hit_rate(F.col("blocked"), F.col("checked")).alias("r")).select("source", "r.rate", "r.alert")


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS body, lang FROM documents)
SELECT doc_id, length(trim(body)) >= 100 AS capable, CASE WHEN lang = 'en' AND length(body) >= 200 THEN NULL ELSE 'quality' END AS gated, doc_id >= 100 OR doc_id % 9 = 0 AS recent FROM d""")
def relaxed_gates(t):
    category = F.when(F.col("lang") == "en", "recommend").otherwise(F.col("lang"))
    return t("documents").select(
        "doc_id", publish.ai_capable(F.col("text")).alias("capable"), publish.recommend_relaxed(category, F.col("text"), F.lit("quality")).alias("gated"),
        publish.since(F.when(F.col("doc_id") % 9 != 0, F.col("doc_id")), F.lit(100), keep_undated=True).alias("recent"),
    )


_SAID = TRIM


@query(f"""WITH d AS (SELECT doc_id, replace(replace(replace(left(coalesce(text, ''), CASE WHEN n_chars % 3 = 0 THEN 70 WHEN n_chars % 3 = 1 THEN 45 ELSE n_chars END), ' the ', '。'), ' de ', '来源'), ' der ', '版权') AS said FROM documents), k AS (SELECT doc_id, {_SAID.format("said")} AS s FROM d)
SELECT doc_id, CASE WHEN length(s) < 30 THEN 'short' WHEN length(s) < 100 AND NOT contains(s, '。') THEN 'no sentence' WHEN regexp_matches(s, '(?is)^.{{0,50}}(来源|转载|版权|声明|免责).{{0,50}}$') OR regexp_matches(s, '(?is)^(推荐|相关|更多).{{0,30}}(阅读|新闻|文章)$') THEN 'noise' END AS problem FROM k""")
def content_problems(t):
    size = F.when(F.col("n_chars") % 3 == 0, 70).when(F.col("n_chars") % 3 == 1, 45).otherwise(F.col("n_chars")).cast("int")
    said = F.substring(F.coalesce("text", F.lit("")), F.lit(1), size)
    for word, by in ((" the ", "。"), (" de ", "来源"), (" der ", "版权")):
        said = F.replace(said, F.lit(word), F.lit(by))
    return t("documents").select("doc_id", publish.content_problem(said).alias("problem"))


@query("""SELECT doc_id, CASE WHEN lang = 'en' AND source = 'src1' THEN 'en=E,src1=src1,life=life' WHEN lang = 'en' THEN 'en=E,life=life' WHEN source = 'src1' THEN 'src1=src1,life=life' WHEN n_chars % 2 = 0 THEN 'life=life' ELSE 'life=life' END AS tags FROM documents""")
def scene_tags(t):
    tags = F.when((F.col("lang") == "en") | (F.coalesce("source", F.lit("")) == "src1") | (F.col("n_chars") % 2 == 0), F.array("lang", "source", "lang", F.lit("life")))
    named = publish.labelled(publish.tags_allowed(tags, ["en", "src1", "life"]), {"en": "E"})
    return t("documents").select("doc_id", F.array_join(F.transform(named, lambda x: F.concat_ws("=", x["tag"], x["label"])), ",").alias("tags"))


_BARE = r"[\d\s\-/:.\x{3000},，。、年月日时分秒]+"
_INVALID = lambda x: f"({x} = '' OR {x} = title OR length({x}) < 20 OR length(regexp_replace({x}, '{_BARE}', '', 'g')) < 5 OR {x} = coalesce(source, ''))"


@query(f"""WITH {ITEMS}, d AS (SELECT *, length(content) % 4 AS form FROM items), k AS (SELECT *, CASE WHEN form = 0 THEN left(content, 80) ELSE '' END AS ai, CASE WHEN form = 3 THEN '' ELSE content END AS body, {_SAID.format("CASE WHEN form = 1 THEN left(content, 30) ELSE left(title, 15) END")} AS given FROM d),
l AS (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: {_SAID.format("x")}), lambda x: NOT {_INVALID("x")}) AS good FROM k),
s AS (SELECT *, CASE WHEN length(ai) >= 60 THEN ai WHEN length(body) > 10 THEN coalesce(good[1], title) ELSE given END AS made, CASE WHEN length(ai) >= 60 THEN 'ai' WHEN length(body) > 10 THEN CASE WHEN len(good) > 0 THEN 'content' ELSE 'title' END WHEN {_INVALID("given")} THEN 'title' ELSE 'desc' END AS kind FROM l),
b AS (SELECT *, CASE WHEN kind = 'ai' AND made <> '' THEN made ELSE '' END AS kept, CASE WHEN made <> '' AND (kind = 'ai' OR made <> title) THEN made ELSE title END AS short FROM s)
SELECT id, made AS summary, kind, CASE WHEN {_SAID.format("kept")} = '' AND short <> '' THEN short ELSE kept END AS body, CASE WHEN ({_SAID.format("kept")} = '' AND short <> '') OR (kind = 'ai' AND made <> '') THEN 'ai_summary' ELSE '' END AS body_source FROM b""")
def summary_fallbacks(t):
    form = F.length("content") % 4
    d = items(t("documents")).select("id", "title", "source", F.when(form == 0, F.substring("content", 1, 80)).otherwise("").alias("ai"), F.when(form == 3, "").otherwise(F.col("content")).alias("body"), F.when(form == 1, F.substring("content", 1, 30)).otherwise(F.substring("title", 1, 15)).alias("given"))
    d = d.withColumn("s", publish.summary_of(F.col("ai"), F.col("given"), F.col("body"), F.col("title"), F.col("source")))
    body = publish.body_of(F.col("body"), F.lit("fetched"), F.col("body"), F.col("s.summary"), F.col("s.source"), F.col("title"), F.lit(False))
    return d.select("id", "s.summary", F.col("s.source").alias("kind"), body["content"].alias("body"), body["content_source"].alias("body_source"))


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'insert' WHEN toxic = 0 AND n_chars > 1000 + 200 THEN 'upgrade' ELSE 'drop' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)""".replace("l.doc_id IS NULL", "l.quality IS NULL"))
def topic_actions(t):
    known = t("labels").select("doc_id", F.when(F.col("toxic") == 0, "pending").otherwise("done").alias("status"))
    d = t("documents").select("doc_id", "n_chars").join(known, "doc_id", "left")
    return d.select("doc_id", tables.topic_action(F.col("n_chars"), F.lit(1000), F.col("status")).alias("action"))
