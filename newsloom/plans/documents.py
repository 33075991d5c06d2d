"""Queries over documents as news items: title from the first line, category from the language, one published each minute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import gates, scoring, tables
from .registry import query

BEGAN = 1704067200
AS_OF = BEGAN + 2 * 86400

SPACE = "[\\s　 ]"
ITEMS = f"""items AS (SELECT doc_id AS id, coalesce(text, '') AS content, left(split_part(coalesce(text, ''), chr(10), 1), 120) AS title,
  left(coalesce(text, ''), 200) AS summary, source, lang AS category, {BEGAN} + doc_id * 60 AS published FROM documents)"""


def items(documents: DataFrame) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return documents.select(
        F.col("doc_id").alias("id"), body.alias("content"), F.substring(F.substring_index(body, "\n", 1), 1, 120).alias("title"),
        F.substring(body, 1, 200).alias("summary"), "source", F.col("lang").alias("category"), (F.lit(BEGAN) + F.col("doc_id") * 60).alias("published"),
    )


COMPLETE = """CASE WHEN length(trim(content)) = 0 THEN 0 ELSE
  CASE WHEN length(content) - length(translate(content, '。！？.!?', '')) >= 2
    THEN CAST(round(b + CAST(0.1 AS DOUBLE) * (100 - b)) AS INT) ELSE b END END"""
BASE = "CASE WHEN length(trim(content)) >= 300 THEN 90 WHEN length(trim(content)) >= 80 THEN 60 ELSE 20 END AS b"
MATCH = "lower(regexp_replace(title, '[^一-龥a-zA-Z0-9]', '', 'g'))"


@query(f"""
WITH {ITEMS}, k AS (SELECT *, {MATCH} AS key, {BASE} FROM items),
s AS (SELECT id, title, category, published, {COMPLETE} AS complete, CAST(round(100 * exp(-greatest(CAST(0 AS DOUBLE), ({AS_OF} - published) / CAST(3600 AS DOUBLE)) / 48)) AS INT) AS fresh,
  CASE WHEN key <> '' AND row_number() OVER (PARTITION BY key ORDER BY published, id) > 1 THEN 0 ELSE 100 END AS uniq FROM k),
q AS (SELECT *, CAST(round(CAST(0.25 AS DOUBLE) * 40 + CAST(0.2 AS DOUBLE) * complete + CAST(0.15 AS DOUBLE) * fresh + CAST(0.15 AS DOUBLE) * 95 + CAST(0.1 AS DOUBLE) * uniq) AS INT) AS quality FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY quality DESC, published DESC, id) AS rank FROM q WHERE quality >= 40)
SELECT category, CAST(rank AS INT) AS rank, id, title, quality FROM r WHERE rank <= 8""")
def quality_score_topn_by_lang(t):
    complete = scoring.completeness(F.col("content"), F.col("summary"))
    # Contents stay behind: only their score goes through the shuffles of the duplicate keys.
    d = items(t("documents")).select("id", "title", "source", "category", "published", complete.alias("complete"), F.lit(None).cast("string").alias("url"))
    d = scoring.batch_duplicates(d, [F.col("published"), F.col("id")])
    quality = scoring.quality_score(
        scoring.source_authority(F.col("source"), F.col("url")), F.col("complete"), scoring.timeliness(F.col("published"), F.lit(AS_OF)),
        F.lit(95), F.when(F.col("dup"), 0).otherwise(100), F.lit(None).cast("string"),
    )
    d = d.select("category", "id", "title", "published", quality.alias("quality")).where(F.col("quality") >= fixed.MIN_QUALITY)
    top = tables.top_per_group(d, "category", [F.desc("quality"), F.desc("published"), F.col("id")], tables.category_cap(F.col("category"), fixed.CATEGORY_CAPS, fixed.CATEGORY_CAP_OTHER))
    return top.select("category", "rank", "id", "title", "quality")


@query(f"WITH {ITEMS}, k AS (SELECT *, {BASE} FROM items), s AS (SELECT {COMPLETE} AS complete FROM k) SELECT complete, count(*) AS n FROM s GROUP BY complete")
def completeness_bands(t):
    return items(t("documents")).groupBy(scoring.completeness(F.col("content"), F.col("summary")).alias("complete")).agg(F.count("*").alias("n"))


REASON = f"""CASE WHEN trim(title) = '' THEN 'no title' WHEN trim(summary) = '' THEN 'no summary' WHEN trim(coalesce(source, '')) = '' THEN 'no source'
  WHEN length(trim(title)) < 5 THEN 'title short' WHEN length(trim(title)) > 200 THEN 'title long' WHEN length(trim(summary)) < 10 THEN 'summary short'
  WHEN length(trim(summary)) > 1000 THEN 'summary long' WHEN length(trim(source)) < 2 THEN 'source short' WHEN regexp_matches(trim(source), '{fixed.INVALID_SOURCES}') THEN 'source invalid'
  WHEN {" OR ".join(f"contains(lower(title), '{w}')" for w in fixed.ADVERT_TITLES)} THEN 'advert' END"""


def _reasoned(t) -> DataFrame:
    return items(t("documents")).withColumn("reason", gates.news_reason(F.col("title"), F.col("summary"), F.col("source")))


@query(f"WITH {ITEMS} SELECT {REASON} AS reason, count(*) AS n FROM items GROUP BY 1")
def gate_stats(t):
    return _reasoned(t).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS}, r AS (SELECT {REASON} AS reason FROM items) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason")
def reject_reason_hist(t):
    return tables.reason_histogram(_reasoned(t), "reason")


OUTCOME = "CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'staged' ELSE 'low' END"


@query(f"""
WITH o AS (SELECT source, {OUTCOME} AS outcome FROM documents JOIN labels USING (doc_id)),
n AS (SELECT source, count(*) AS processed, count_if(outcome = 'staged') AS staged, count_if(outcome = 'low') AS low, count_if(outcome = 'rejected') AS rejected FROM o GROUP BY source)
SELECT source, processed, CAST(staged AS BIGINT) AS staged, CAST(low AS BIGINT) AS low, CAST(rejected AS BIGINT) AS rejected,
  greatest(CAST(0 AS DOUBLE), least(CAST(10 AS DOUBLE), round(CAST(10 AS DOUBLE) * staged / processed - CAST(3 AS DOUBLE) * rejected / processed, 1))) AS quality FROM n WHERE processed >= 3""")
def source_quality_score(t):
    outcome = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "staged").otherwise("low")
    joined = t("documents").select("doc_id", "source").join(t("labels"), "doc_id")
    return tables.source_quality(joined.select("source", outcome.alias("outcome")))


@query("""
WITH j AS (SELECT source, doc_id, CAST(10 * quality AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id)),
w AS (SELECT source, doc_id, avg(score) OVER k AS average, count(*) OVER k AS n_scores FROM j WINDOW k AS (PARTITION BY source ORDER BY doc_id ROWS 41 PRECEDING))
SELECT source, doc_id, average, n_scores, n_scores >= 5 AND average < 6 AS retire FROM w""")
def source_quality_rolling42(t):
    joined = t("documents").select("doc_id", "source").join(t("labels"), "doc_id").select("source", "doc_id", (10.0 * F.col("quality")).alias("score"))
    return tables.rolling_quality(joined, "source", ["doc_id"], "score").drop("score")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def doc_exact_dedup_first(t):
    d = t("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    return tables.first_per_key(d, ["key"], [F.col("doc_id")]).select("doc_id")


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def doc_best_per_key(t):
    return tables.best_per_key(t("documents").select("source", "doc_id", "n_chars"), "source", F.struct("n_chars", -F.col("doc_id")))


@query(f"""WITH {ITEMS}, k AS (SELECT id, left(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 20) AS key FROM items)
SELECT CASE WHEN key <> '' THEN left(sha256(key), 24) END AS topic, count(*) AS n, min(id) AS first_id FROM k GROUP BY 1""")
def title_fingerprint(t):
    return items(t("documents")).groupBy(text.topic_key(F.col("title")).alias("topic")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"""WITH {ITEMS} SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(title, ''), lambda c: CAST(unicode(c) AS BIGINT))),
  lambda h, x: ((h * 31 + x + 2147483648) & 4294967295) - 2147483648) AS hash FROM items WHERE title <> ''""")
def event_hash31(t):
    return items(t("documents")).where("title <> ''").select("id", text.rolling_hash(F.col("title")).alias("hash"))


@query(f"""WITH {ITEMS}, p AS (SELECT source, id, list_distinct(string_split(title, '')) AS x, list_distinct(string_split(lag(title) OVER (PARTITION BY source ORDER BY id), '')) AS y FROM items WHERE title <> ''),
n AS (SELECT id, len(x) AS a, len(y) AS b, len(list_intersect(x, y)) AS shared FROM p WHERE y IS NOT NULL)
SELECT id, shared / CAST(a + b - shared AS DOUBLE) AS similarity FROM n""")
def char_jaccard_pairs(t):
    from pyspark.sql import Window

    d = items(t("documents")).where("title <> ''").withColumn("before", F.lag("title").over(Window.partitionBy("source").orderBy("id"))).where("before is not null")
    return d.select("id", text.char_jaccard(F.col("title"), F.col("before")).alias("similarity"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_new_rows(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query(f"""WITH {ITEMS}, old AS (SELECT left(split_part(text, chr(10), 1), 120) AS title, sha256(text) AS body FROM benchmark)
SELECT id FROM items WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.title = items.title) AND NOT EXISTS (SELECT 1 FROM old WHERE old.body = sha256(items.content))""")
def two_key_anti_join(t):
    keyed = lambda d, title, body: d.select("*", title.alias("title_key"), F.sha2(body, 256).alias("body_key"))
    new = keyed(items(t("documents")), F.col("title"), F.col("content"))
    old = keyed(t("benchmark"), F.substring(F.substring_index("text", "\n", 1), 1, 120), F.col("text"))
    return tables.two_key_anti_join(new, old, "title_key", "body_key").select("id")


@query("""SELECT doc_id, CASE WHEN d.doc_id IS NOT NULL THEN CAST(n_chars > 1000 AS INT) ELSE quality END AS quality, CASE WHEN l.doc_id IS NOT NULL THEN toxic ELSE 0 END AS toxic
FROM documents d FULL JOIN labels l USING (doc_id)""")
def upsert_latest_wins(t):
    incoming = t("documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return tables.upsert(t("labels"), incoming, "doc_id", keep=["toxic"])


_BARE = r"[\d\s\-/:.\x{3000},，。、年月日时分秒]+"


@query(f"""WITH {ITEMS}, e AS (SELECT title, any_value(content ORDER BY id) AS summary, min(published) AS created FROM items WHERE title <> '' AND category = 'en' GROUP BY title),
i AS (SELECT title, min(summary) AS summary FROM items WHERE title <> '' GROUP BY title)
SELECT 'T:' || title AS dedup_key, CASE WHEN e.summary <> title AND length(e.summary) >= 20 AND length(regexp_replace(e.summary, '{_BARE}', '', 'g')) >= 5 AND length(e.summary) > length(i.summary) THEN e.summary ELSE i.summary END AS summary,
  CAST(coalesce(e.created, {AS_OF}) AS BIGINT) AS created FROM i LEFT JOIN e USING (title)""")
def left_merge_priority(t):
    d = items(t("documents")).where("title <> ''").withColumn("dedup_key", tables.dedup_key(F.lit(""), F.col("title")))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    rest = [*none("string", "source", "summary_source", "content", "content_source", "opinion"), *none("boolean", "retained"), *none("long", "retained_at", "expires")]
    existing = d.where("category = 'en'").groupBy("dedup_key").agg(F.first("title").alias("title"), F.min_by("content", "id").alias("summary"), F.min("published").alias("created")).select("*", *rest)
    incoming = d.groupBy("dedup_key").agg(F.first("title").alias("title"), F.min("summary").alias("summary"), F.min("published").alias("created")).select("*", *rest)
    return tables.merge_published(existing, incoming, AS_OF).select("dedup_key", "summary", "created")


@query(f"""WITH {ITEMS}, f AS (SELECT id FROM items WHERE published > {AS_OF} - 86400), n AS (SELECT count(*) AS n FROM f)
SELECT id FROM items, n WHERE published > {AS_OF} - 86400 OR n.n = 0""")
def freshness_window(t):
    return tables.fresh_or_all(items(t("documents")), F.col("published") > AS_OF - 86400).select("id")


@query("""WITH u AS (SELECT doc_id AS id, 0 AS tier FROM documents WHERE source = 'none' UNION ALL SELECT item_id, 1 FROM benchmark UNION ALL SELECT page_id, 2 FROM pages)
SELECT id, tier FROM u WHERE tier = (SELECT min(tier) FROM u)""")
def fallback_tiers(t):
    tiers = [t("documents").where("source = 'none'").select(F.col("doc_id").alias("id")), t("benchmark").select(F.col("item_id").alias("id")), t("pages").select(F.col("page_id").alias("id"))]
    return tables.fallback_tiers(tiers).select("id", "tier")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5")
def per_source_cap(t):
    return tables.source_capped(t("documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 5).select("source", "doc_id")


@query(f"""WITH {ITEMS}, c AS (SELECT *, CAST(published / 86400 AS BIGINT) AS x, published // 86400 AS day FROM items),
p AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY day, source ORDER BY length(content) DESC, id) <= 5)
SELECT day, CAST(row_number() OVER (PARTITION BY day ORDER BY length(content) DESC, id) AS INT) AS rank, id, source FROM p""")
def brief_rank_assign(t):
    d = items(t("documents")).withColumn("day", F.floor(F.col("published") / 86400)).withColumn("size", F.length("content"))
    brief = tables.daily_brief(d, "day", [F.desc("size"), F.col("id")])
    return brief.select("day", F.inline("items")).select("day", "rank", "id", "source")


_SINGLE = [w for w in fixed.AI_WORDS if w.isascii() and " " not in w]
_OTHER = [w for w in fixed.AI_WORDS if w not in _SINGLE]
_LIST = lambda words: "[" + ", ".join(f"'{w.lower()}'" for w in words) + "]"


@query(f"""WITH {ITEMS}, b AS (SELECT id, lower(content) AS body FROM items), w AS (SELECT id, body, list_distinct(string_split_regex(body, '[^a-z0-9_A-Z]+')) AS tokens FROM b),
h AS (SELECT id, body, len(list_filter({_LIST(_SINGLE)}, lambda k: len(list_filter(tokens, lambda t: starts_with(t, k) AND regexp_full_match(substr(t, length(k) + 1, 1), '[a-z0-9]?'))) > 0))
  + len(list_filter({_LIST(_OTHER)}, lambda k: contains(body, k))) AS hits FROM w),
s AS (SELECT id, least(hits, 3) + least(CASE WHEN contains(body, 'data') THEN 2 ELSE 0 END + CASE WHEN contains(body, 'energy') THEN 2 ELSE 0 END, 6) AS score FROM h)
SELECT id, CAST(score AS INT) AS score, CASE WHEN score >= 4 THEN 'high' WHEN score >= 1 THEN 'medium' ELSE 'low' END AS level FROM s""")
def keyword_router_level(t):
    d = items(t("documents")).select("id", scoring.relevance(F.lower("content"), ["data", "energy"]).alias("r"))
    return d.select("id", F.col("r.score").cast("int").alias("score"), "r.level")


_BODY = "lower(content)"
for _phrase in fixed.NAVIGATION:
    _BODY = f"split_part({_BODY}, '{_phrase}', 1)"


@query(f"""WITH {ITEMS}, m AS (SELECT id, regexp_replace({_BODY}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS b, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS h FROM items)
SELECT id, CAST(CASE WHEN length(b) > 0 AND b = h THEN 0 ELSE length(b) END AS INT) AS n FROM m""")
def meaningful_length(t):
    return items(t("documents")).select("id", text.meaningful_length(F.col("content"), F.col("title")).alias("n"))


_TRIM = f"regexp_replace(x, '^[\\s　 ﻿]+|[\\s　 ﻿]+$', '', 'g')"  # noqa: F541
_NOISE = "(?i)" + "|".join(f"(?:{p})" for p in fixed.NOISE_LINES)


@query(f"""WITH {ITEMS}, l AS (SELECT id, unnest(string_split(content, chr(10))) AS x FROM items), c AS (SELECT id, {_TRIM} AS y FROM l)
SELECT id, count(*) AS n_lines, CAST(count_if(length(y) > 0 AND (regexp_matches(y, '{_NOISE}') OR (length(y) <= 25 AND (regexp_matches(y, '{fixed.PHOTO_WORDS}') OR (regexp_matches(y, '{fixed.CREDIT_WORDS}') AND length(y) <= 15))))) AS BIGINT) AS n_noise FROM c GROUP BY id""")
def noise_line_removal(t):
    d = items(t("documents")).select("id", "content", F.size(F.split("content", "\n", -1)).cast("long").alias("n_lines"))
    left = F.filter(F.split("content", "\n", -1), lambda x: text.is_noise_line(x))
    return d.select("id", "n_lines", F.size(left).cast("long").alias("n_noise"))


@query()
def clean_content_full(t):
    d = items(t("documents"))
    return d.select("id", text.clean_content(F.col("content"), F.col("title"), F.col("source")).alias("clean"), text.clean_title(F.col("title")).alias("title"))


@query(f"""WITH {ITEMS} SELECT category, count(*) AS n, CAST(count_if({" OR ".join(f"contains(lower(regexp_replace(title, '\\s+', '', 'g')), '{w}')" for w in fixed.BLOCKED_TITLES)}) AS BIGINT) AS blocked FROM items GROUP BY category""")
def keyword_blocklist_filter(t):
    word = gates.title_block_reason(F.col("title"))
    return items(t("documents")).groupBy("category").agg(F.count("*").alias("n"), F.count_if(word.startswith("word ")).alias("blocked"))
