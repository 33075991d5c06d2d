"""Queries that hold single rules to the tables' own titles, texts, addresses and times; SQL is written from the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text, times, urls
from ..operators import gates, scoring, tables
from .documents import BASE, COMPLETE, ITEMS, items
from .events import BEGAN, E, timed
from .registry import query

HOUR, DAY = 3600, 86400
AS_OF = BEGAN + 10 * DAY

_S = "[\\s　 ﻿]"
TRIM = f"regexp_replace({{}}, '^{_S}+|{_S}+$', '', 'g')"
_sql = lambda s: s.replace("'", "''")


def first_words(documents: DataFrame) -> DataFrame:
    """doc_id, plain: a text's ASCII letters with single spaces between words, and the columns of documents."""
    return documents.withColumn("plain", text.latin_words(F.col("text")))


PLAIN = "d AS (SELECT *, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', '', 'g'), ' +', ' ', 'g')) AS plain FROM documents)"

# Gates ----------------------------------------------------------------------------------------------------------------

_HOST = "regexp_replace(lower(regexp_extract(u, '(?i)^https?://([^/?#:]+)', 1)), '^www\\.', '')"
_OWN = lambda domains: " OR ".join(f"h = '{d}' OR ends_with(h, '.{d}')" for d in domains)
_STRANGE = "CASE source " + " ".join(f"WHEN '{name}' THEN NOT ({_OWN(ds)})" for name, ds in fixed.EXPECTED_DOMAINS.items()) + " ELSE false END"
_PLACEHOLDER = " OR ".join(f"regexp_matches(u, '{p}')" for p in fixed.PLACEHOLDER_URLS)
_PAGE_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
#: Addresses of pages under hosts of their own, of sources, and as given.
_PAGES = f"""p AS (SELECT page_id, {_PAGE_TITLE} AS title, url, replace(replace(replace(url, 'example.com', 'people.com.cn'), 'example.org', 'site.org'), 'https://m.', 'ftp://m.') AS moved, CASE WHEN contains(url, '/en/') THEN '人民日报' WHEN contains(url, '/de/') THEN 'BBC' ELSE 'other' END AS source FROM pages)"""


def _pages(t) -> DataFrame:
    moved = F.replace(F.replace(F.replace("url", F.lit("example.com"), F.lit("people.com.cn")), F.lit("example.org"), F.lit("site.org")), F.lit("https://m."), F.lit("ftp://m."))
    source = F.when(F.contains("url", F.lit("/en/")), "人民日报").when(F.contains("url", F.lit("/de/")), "BBC").otherwise("other")
    return t("pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), "url", moved.alias("moved"), source.alias("source"))


@query(f"""WITH {_PAGES}, c AS (SELECT *, regexp_replace(regexp_replace({TRIM.format("regexp_replace(title, '\\s+', ' ', 'g')")}, '^[【\\[]+', ''), '[】\\]]+$', '') AS name, {TRIM.format("moved")} AS u FROM p), h AS (SELECT *, {_HOST} AS h FROM c)
SELECT page_id, CASE WHEN name = '' THEN 'no title' WHEN u = '' THEN 'no url' WHEN NOT regexp_matches(u, '(?i)^https?://') THEN 'url scheme' WHEN length(name) < 4 THEN 'title short' WHEN length(name) > 300 THEN 'title long' END AS intel,
  CASE WHEN u = '' THEN 'empty' WHEN NOT regexp_matches(u, '(?i)^https?://') THEN 'scheme' WHEN {_PLACEHOLDER} THEN 'placeholder' WHEN h = '' THEN 'parse' WHEN {_STRANGE} THEN 'source mismatch' WHEN NOT contains(h, '.') OR length(h) < 6 THEN 'host' END AS url_reason FROM h""")
def record_gates(t):
    return _pages(t).select("page_id", gates.intel_record_reason(F.col("title"), F.col("moved")).alias("intel"), gates.source_url_reason(F.col("moved"), F.col("source")).alias("url_reason"))


@query(f"""WITH {ITEMS}, l AS (SELECT *, lower(title) AS low, string_split_regex(lower(title), '[；;]') AS parts FROM items)
SELECT id, category IN ('en', 'fr') AS allowed, contains(low, 'the') OR contains(low, 'und') AS required,
  len(list_filter(parts, lambda x: length(trim(x)) > 0)) > 0 AND len(list_filter(parts, lambda x: length(trim(x)) > 0 AND NOT contains(x, 'e'))) = 0 AS pure, contains(source, 'src1') OR contains(lower(category), 'es') AS blocked FROM l""")
def title_gates(t):
    extra = F.array(F.lit("E N"), F.lit("Fr"))
    return items(t("documents")).select(
        "id", gates.category_allowed(F.col("category"), extra).alias("allowed"), gates.holds_required(F.col("title"), ["The", "und"]).alias("required"), gates.is_pure_topic(F.col("title"), ["E"]).alias("pure"),
        gates.categories_blocked(F.array("source", "category"), ["SRC1", "es"]).alias("blocked"),
    )


@query(f"""WITH {E}, d AS (SELECT event_id, CASE WHEN value < 5 THEN at_s // 86400 * 86400 ELSE at_s END AS pub, CASE WHEN value < 40 THEN at_s + CAST(floor(value * 100) AS BIGINT) END AS fetched, CAST(floor(value / 5) AS INT) AS days,
  CASE WHEN event_type = 'view' THEN DATE '1970-01-01' + CAST(at_s // 86400 - 2 AS INT) END AS in_url FROM e),
k AS (SELECT *, coalesce(CASE WHEN pub % 86400 = 0 AND fetched IS NOT NULL THEN fetched ELSE pub END, fetched) AS at_c FROM d)
SELECT event_id, CASE WHEN in_url IS NOT NULL AND {AS_OF} - datediff('day', DATE '1970-01-01', in_url) * 86400 > 172800 THEN 'url date' WHEN at_c IS NULL THEN 'no time' WHEN {AS_OF} - at_c < -3600 THEN 'future' WHEN {AS_OF} - at_c > 172800 THEN 'stale' END AS fresh,
  {AS_OF} - pub BETWEEN 0 AND days * 86400 AS within, {AS_OF} - pub <= days * 86400 AS passes, pub > {AS_OF - 5 * DAY} AND pub <= {AS_OF} AS polled FROM k""")
def time_gates(t):
    at = F.when(F.col("value") < 5, F.floor(F.col("at_s") / DAY) * DAY).otherwise(F.col("at_s"))
    fetched = F.when(F.col("value") < 40, F.col("at_s") + F.floor(F.col("value") * 100))
    in_url = F.when(F.col("event_type") == "view", F.date_from_unix_date((F.floor(F.col("at_s") / DAY) - 2).cast("int")))
    days, as_of = F.floor(F.col("value") / 5).cast("int"), F.lit(AS_OF)
    return timed(t).select(
        "event_id", gates.freshness_reason(at, fetched, in_url, as_of).alias("fresh"), gates.within_days(at, fetched, days, as_of).alias("within"), gates.passes_freshness(at, days, as_of).alias("passes"),
        gates.in_poll_window(at, F.lit(AS_OF - 5 * DAY), as_of).alias("polled"),
    )


_LATE = BEGAN + 30 * DAY


@query(f"""WITH {E}, s AS (SELECT user_id, max(at_s) AS last_fetch, arg_max(event_type, (at_s, event_id)) AS last_type, count_if(event_type = 'signup') > 0 AS enabled, 3600 * count_if(event_type = 'view') AS poll, max(at_s) FILTER (WHERE event_type = 'error' AND value > 40) AS disabled_at FROM e GROUP BY user_id)
SELECT user_id FROM s WHERE enabled AND CASE WHEN last_type IN ('error', 'click') THEN coalesce({_LATE} - coalesce(disabled_at, last_fetch) >= 86400, true) ELSE {_LATE} - last_fetch >= CASE WHEN poll = 0 THEN 3600 ELSE poll END END""")
def due_source_polls(t):
    last = F.max_by("event_type", F.struct("at_s", "event_id"))
    d = timed(t).groupBy("user_id").agg(
        F.max("at_s").alias("last_fetch"), F.when(last.isin("error", "click"), "disabled").otherwise("active").alias("status"), (F.count_if(F.col("event_type") == "signup") > 0).alias("enabled"),
        (F.count_if(F.col("event_type") == "view") * 3600).alias("poll_seconds"), F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 40), F.col("at_s"))).alias("disabled_at"),
    )
    return gates.due_sources(d, F.lit(_LATE)).select("user_id")


_SOFT = "CASE " + " ".join(f"WHEN contains(hay, '{w}') THEN '{w}'" for w in fixed.SOFT_SIGNALS) + " " + " ".join(f"WHEN regexp_matches(hay, '{p}') THEN 'pattern'" for p in fixed.SOFT_PATTERNS) + " END"
_HARD = "CASE WHEN old THEN 'url date' " + " ".join(f"WHEN contains(hay, '{w}') THEN 'word {w}'" for w in fixed.SENSITIVE_WORDS) + " END"


@query(f"""WITH {ITEMS}, d AS (SELECT id, title, replace(content, ' the ', ' 点击链接 ') AS body, replace(summary, ' der ', ' 关注我们 ') AS said, published, published % 3 = 0 AS dated FROM items),
h AS (SELECT *, title || ' ' || said || ' ' || body AS hay, dated AND {BEGAN + 3 * DAY} - published // 86400 * 86400 > 172800 AS old FROM d),
r AS (SELECT *, {_HARD} AS hard, {_SOFT} AS soft FROM h)
SELECT id, hard, CASE WHEN hard IS NULL THEN soft END AS soft FROM r""")
def compliance_signals(t):
    """Words planted where common words of the texts stand."""
    d = items(t("documents")).withColumn("body", F.replace("content", F.lit(" the "), F.lit(" 点击链接 "))).withColumn("said", F.replace("summary", F.lit(" der "), F.lit(" 关注我们 ")))
    in_url = F.when(F.col("published") % 3 == 0, F.date_from_unix_date(F.floor(F.col("published") / DAY).cast("int")))
    hard, soft = gates.compliance(F.col("title"), F.col("said"), F.col("body"), in_url, F.lit(BEGAN + 3 * DAY))
    return d.select("id", hard.alias("hard"), soft.alias("soft"))


@query(f"""WITH {PLAIN}, q AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN replace(left(plain, 40), ' ', '；') WHEN n_chars % 3 = 1 THEN '盘点' || left(plain, 20) ELSE left(plain, 40) END AS title, plain, {BEGAN} + doc_id * 60 AS published FROM d),
k AS (SELECT *, length(regexp_replace(lower(plain), '[^a-z]', '', 'g')) AS n, length(title) AS size FROM q)
SELECT doc_id, concat_ws(',', CASE WHEN n < 60 THEN 'short' END, CASE WHEN NOT {BEGAN + 2 * DAY} - published BETWEEN 0 AND 86400 THEN 'stale' END, CASE WHEN trim(title) = '' AND plain = '' THEN 'empty' END,
  CASE WHEN contains(title, '；') THEN 'several' WHEN contains(title, '盘点') AND length(trim(title)) >= 15 THEN 'roundup' END) AS reasons FROM k""")
def qualify_reasons(t):
    d = first_words(t("documents"))
    title = F.when(F.col("n_chars") % 3 == 0, F.replace(F.substring("plain", 1, 40), F.lit(" "), F.lit("；"))).when(F.col("n_chars") % 3 == 1, F.concat(F.lit("盘点"), F.substring("plain", 1, 20))).otherwise(F.substring("plain", 1, 40))
    reasons = gates.qualify_reasons(title, F.col("plain"), F.lit(""), F.lit(BEGAN) + F.col("doc_id") * 60, F.lit(None).cast("long"), F.lit(1), F.lit(BEGAN + 2 * DAY))
    return d.select("doc_id", F.array_join(reasons, ",").alias("reasons"))


# Texts ----------------------------------------------------------------------------------------------------------------

_MARK = "replace(coalesce(text, ''), ' the ', ' ——【一页说】：· ')"
_TAIL, _LEAD = r"[\s\x{3000}—\-·]+$", r"^[\s\x{3000}:：—\-·]+"
_BOLD = "string_split(replace(plain, ' e', '**'), '**')"


@query(f"""WITH {PLAIN}, m AS (SELECT *, {_MARK} AS said, strpos({_MARK}, '【一页说】') AS at_c FROM d)
SELECT doc_id, CASE WHEN at_c = 0 THEN said ELSE regexp_replace({TRIM.format("left(said, at_c - 1)")}, '{_TAIL}', '') END AS body, CASE WHEN at_c = 0 THEN '' ELSE regexp_replace({TRIM.format("substr(said, at_c + 5)")}, '{_LEAD}', '') END AS opinion,
  regexp_replace(replace(plain, ' die ', ' 相关阅读：'), '(?s)相关阅读[：:].*$', '') AS cut, len(list_filter({_BOLD}, lambda x, i: x <> '' AND i % 2 = 0)) AS n_bold, len(list_filter({_BOLD}, lambda x: x <> '')) AS n_parts,
  CASE WHEN length(split_part(plain, ' ', 1)) <= 8 THEN 'title' ELSE 'text' END AS kind FROM m""")
def text_rules(t):
    d = first_words(t("documents"))
    opinion = text.split_opinion(F.replace(F.coalesce("text", F.lit("")), F.lit(" the "), F.lit(" ——【一页说】：· ")))
    bold = text.split_bold(F.replace("plain", F.lit(" e"), F.lit("**")))
    return d.select(
        "doc_id", opinion["body"].alias("body"), opinion["opinion"].alias("opinion"), text.remove_trailers(F.replace("plain", F.lit(" die "), F.lit(" 相关阅读："))).alias("cut"),
        F.size(F.filter(bold, lambda p: p["bold"])).cast("long").alias("n_bold"), F.size(bold).cast("long").alias("n_parts"), text.block_kind(F.substring_index("plain", " ", 1)).alias("kind"),
    )


# Scores ---------------------------------------------------------------------------------------------------------------

_TOPIC = {"en": ("recommend", 15), "de": ("tech", 10), "fr": ("life", 5), "es": ("auto", 8)}
_SUMMARY_COMPLETE = COMPLETE.replace("content", "summary")
_SUMMARY_BASE = BASE.replace("content", "summary")


@query(f"""WITH {ITEMS}, d AS (SELECT id, category, length(content) % 50 AS age, length(content) % 7 AS n, length(content) % 101 AS q FROM items),
h AS (SELECT *, CASE category {" ".join(f"WHEN '{k}' THEN {v}" for k, (_, v) in _TOPIC.items())} ELSE 8 END + CASE WHEN n >= 2 THEN 10 ELSE 0 END AS topic, 10 * n + least(10, 2 * n) AS event FROM d),
s AS (SELECT *, CAST(round(greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), (event + topic) * exp(-CAST(age AS DOUBLE) / 24)))) AS INT) AS heat FROM h)
SELECT id, CAST(topic AS INT) AS topic, CAST(event AS BIGINT) AS event, heat, CAST(round(CAST(0.6 AS DOUBLE) * q + CAST(0.4 AS DOUBLE) * heat) AS INT) AS final,
  CAST(round([20, 15, 12, 8, 6][CAST(n % 5 + 1 AS INT)] * exp(-CAST(age AS DOUBLE) / 24)) AS INT) AS feed, CAST(q - age AS DOUBLE) AS decayed FROM s""")
def heat_scores(t):
    size = F.length("content")
    d = items(t("documents")).select("id", "category", (size % 50).alias("age"), (size % 7).alias("n"), (size % 101).alias("q"))
    category = F.col("category")
    named = F.lit("other")
    for lang, (name, _) in _TOPIC.items():
        named = F.when(category == lang, name).otherwise(named)
    at, as_of = F.lit(AS_OF) - F.col("age") * HOUR, F.lit(AS_OF)
    d = d.withColumn("topic", scoring.topic_heat(named, F.col("n"))).withColumn("event", scoring.event_heat(F.col("n"), 2 * F.col("n")).cast("long"))
    d = d.withColumn("heat", scoring.heat_score(F.col("event"), F.col("topic"), F.lit(0), at, as_of))
    # A feed's own heat by its source's authority, faded like an event's.
    authority = F.get(F.array(*[F.lit(a) for a in (100, 85, 80, 60, 40)]), (F.col("n") % 5).cast("int"))
    feed = scoring.heat_score(scoring.feed_heat(authority), F.lit(0), F.lit(0), at, as_of)
    return d.select("id", "topic", "event", "heat", scoring.final_score(F.col("q"), F.col("heat")).alias("final"), feed.alias("feed"), scoring.decayed(F.col("q"), at, as_of).alias("decayed"))


@query(f"""WITH {ITEMS}, k AS (SELECT id, published, {TRIM.format("summary")} AS summary, replace(replace(replace(source, 'src1', '新华社'), 'src2', '澎湃新闻'), 'src3', '36氪') AS source, contains(content, 'token = ') AS hit FROM items),
b AS (SELECT *, CASE source WHEN '新华社' THEN 100 WHEN '澎湃新闻' THEN 85 WHEN '36氪' THEN 80 ELSE 40 END AS authority, {_SUMMARY_BASE} FROM k),
s AS (SELECT *, {_SUMMARY_COMPLETE} AS complete, CAST(round(100 * exp(-greatest(CAST(0 AS DOUBLE), ({BEGAN + 2 * DAY} - published) / CAST(3600 AS DOUBLE)) / 48)) AS INT) AS fresh FROM b),
q AS (SELECT *, CASE WHEN hit THEN 0 ELSE CAST(round(CAST(0.25 AS DOUBLE) * authority + CAST(0.2 AS DOUBLE) * complete + CAST(0.15 AS DOUBLE) * fresh + CAST(0.15 AS DOUBLE) * CASE WHEN summary = '' THEN 0 ELSE 70 END + CAST(0.1 AS DOUBLE) * 100) AS INT) END AS quality,
  CASE WHEN authority >= 100 THEN 20 WHEN authority >= 85 THEN 15 WHEN authority >= 80 THEN 12 WHEN authority >= 60 THEN 8 ELSE 6 END AS heat FROM s)
SELECT id, quality, heat, CAST(round(CAST(0.6 AS DOUBLE) * quality + CAST(0.4 AS DOUBLE) * heat) AS INT) AS final, CASE WHEN hit THEN 'compliance' WHEN quality < 40 THEN 'quality' END AS gated FROM q""")
def feed_scores(t):
    """Official feeds' items, scored each by itself."""
    source = F.replace(F.replace(F.replace("source", F.lit("src1"), F.lit("新华社")), F.lit("src2"), F.lit("澎湃新闻")), F.lit("src3"), F.lit("36氪"))
    hard = F.when(F.contains("content", F.lit("token = ")), "word")
    d = items(t("documents")).select("id", scoring.feed_score(source, F.lit(""), F.col("summary"), F.col("published"), hard, F.lit(BEGAN + 2 * DAY)).alias("s"))
    return d.select("id", "s.quality", F.col("s.heat").alias("heat"), "s.final", "s.gated")


_BARE = r"[\d\s\-/:.\x{3000},，。、年月日时分秒]+"


@query(f"""WITH {ITEMS}, d AS (SELECT *, regexp_replace(content, '[#*$%&|<>]', '', 'g') AS tidy, CASE WHEN length(content) % 3 = 0 THEN regexp_replace(title, '[a-zA-Z]', '1', 'g') ELSE title END AS said, left(title, 45) AS head FROM items)
SELECT id, CASE WHEN trim(tidy) = '' THEN 0 ELSE CAST(round(100 * (1 - (1 - length(trim(tidy)) / CAST(length(trim(content)) AS DOUBLE)))) AS INT) END AS quality, length(summary) >= 60 AS adopted, length(title) >= greatest(50, CAST(floor((length(content) % 500) * CAST(0.25 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INT)) AS accepted,
  said = '' OR said = head OR length(said) < 20 OR length(regexp_replace(said, '{_BARE}', '', 'g')) < 5 OR said = source AS no_desc FROM d""")
def quality_rules(t):
    d = items(t("documents"))
    tidy = F.regexp_replace("content", "[#*$%&|<>]", "")
    said = F.when(F.length("content") % 3 == 0, F.regexp_replace("title", "[a-zA-Z]", "1")).otherwise(F.col("title"))
    usable = scoring.accepted_output(F.col("summary"), F.col("title"), F.length("content") % 500)
    return d.select("id", scoring.text_quality(tidy, F.col("content")).alias("quality"), usable["summary_adopted"].alias("adopted"), usable["interpretation"].alias("accepted"), gates.invalid_description(said, F.substring("title", 1, 45), F.col("source")).alias("no_desc"))


# Addresses and times ----------------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, 'intel_src_' || sha256(url) AS guid, CASE WHEN contains(url, '/en/') THEN regexp_replace(url, '^https?://', '') END AS aggregator, regexp_matches(url, '^https?://([^/?#:]*\.)?example\.com([/?#:]|$)') AS matches, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS url_key FROM pages""")
def url_rules(t):
    item = F.concat(F.when(F.contains("url", F.lit("/en/")), "juhe_tech_").otherwise("tian_"), F.regexp_replace("url", "^https?://", ""))
    return t("pages").select("page_id", urls.guid(F.lit("src"), F.col("url")).alias("guid"), urls.aggregator_key(item).alias("aggregator"), urls.host_matches(F.col("url"), "example.com").alias("matches"), urls.url_key(F.col("url")).alias("url_key"))


_TS = "make_timestamp(at_s * 1000000)"
_LOCAL = "make_timestamp((at_s + 28800) * 1000000)"
_NOW = BEGAN + 15 * DAY + 5 * HOUR


@query(f"""WITH {E}, h AS (SELECT event_id, event_type, at_s, (at_s + 28800) % 86400 // 3600 AS h, {_NOW} - at_s AS age, ({_NOW} + 28800) // 86400 - (at_s + 28800) // 86400 AS days FROM e)
SELECT event_id, CASE WHEN h >= 15 OR h < 5 THEN 18 WHEN h >= 8 THEN 11 ELSE 5 END AS slot, CASE WHEN h >= 18 OR h < 5 THEN 18 WHEN h >= 11 THEN 11 ELSE 5 END AS batch, CASE h WHEN 5 THEN 'morning' WHEN 11 THEN 'noon' ELSE 'summary' END AS mode,
  CASE WHEN event_type = 'signup' THEN -1 ELSE at_s END AS instant,
  CASE WHEN age < 60 THEN '刚刚' WHEN age < 3600 THEN age // 60 || '分钟前' WHEN age < 86400 THEN age // 3600 || '小时前' WHEN age < 259200 THEN age // 86400 || '天前' ELSE strftime({_LOCAL}, '%-m月%-d日') END AS relative,
  strftime({_LOCAL}, '%-m/%-d %H:%M') AS absolute, CASE WHEN days <= 0 THEN strftime({_LOCAL}, '%H:%M') WHEN days = 1 THEN '昨天' WHEN days <= 7 THEN days || '天前' ELSE '' END AS browse,
  CASE WHEN days = 0 THEN '今天 ' || strftime({_LOCAL}, '%H:%M') ELSE strftime({_LOCAL}, '%m-%d %H:%M') END AS label FROM h""")
def time_rules(t):
    at = F.col("at_s")
    stamp = F.timestamp_add("SECOND", at, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    kind = F.col("event_type")
    said = F.when(kind == "view", at.cast("string")).when(kind == "click", (at * 1000).cast("string")).when(kind == "error", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    said = said.when(kind == "purchase", F.concat(F.date_format(stamp, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("None")
    hour = times.beijing_hour(at)
    return timed(t).select(
        "event_id", times.slot_hour(hour).alias("slot"), times.batch_slot(hour).alias("batch"), times.mode_of_hour(hour).alias("mode"), F.coalesce(times.parse_instant(said), F.lit(-1)).alias("instant"),
        times.relative_label(at, F.lit(_NOW)).alias("relative"), times.absolute_label(at).alias("absolute"), times.browse_label(at, F.lit(_NOW)).alias("browse"), times.day_label(at, F.lit(_NOW)).alias("label"),
    )


# Cards and merges -------------------------------------------------------------------------------------------------------


@query(f"""WITH {ITEMS}, p AS (SELECT *, {TRIM.format("title")} AS name, list_transform(list_filter(string_split_regex({TRIM.format("content")}, '\\n+'), lambda x: x <> '')[1:2], lambda x: left({TRIM.format("x")}, 160)) AS paragraphs FROM items),
f AS (SELECT *, left(replace(name, '*', ''), 20) AS one FROM p)
SELECT id, '### ' || CASE WHEN name = '' THEN '（无标题）' ELSE name END || CASE WHEN length(content) % 2 = 0 THEN chr(10) || '> ⭐ 合同 / 接口变更 · 需重点关注' ELSE '' END || chr(10) || '- **溯源**：' || coalesce(nullif(source, ''), '未知来源') || ' · ' || published || ' · '
  || CASE WHEN length(content) % 3 = 0 THEN '[https://x.org/' || id || '](https://x.org/' || id || ')' ELSE '无链接' END || CASE WHEN array_to_string(paragraphs, ' ') <> '' THEN chr(10) || '- **发生了什么**：' || array_to_string(paragraphs, ' ') ELSE '' END
  || CASE WHEN {TRIM.format("one")} <> '' THEN chr(10) || '- **一句话**：' || {TRIM.format("one")} ELSE '' END AS card, trim({TRIM.format("one")}) AS definition FROM f""")
def brief_cards(t):
    row = {
        "title": F.col("title"), "contract": F.length("content") % 2 == 0, "source": F.col("source"), "published": F.col("published"), "url": F.when(F.length("content") % 3 == 0, F.concat(F.lit("https://x.org/"), F.col("id").cast("string"))), "happened": F.col("content"),
        "definition": F.substring(F.replace(text.trimmed(F.col("title")), F.lit("*"), F.lit("")), 1, 20), "scene": F.lit(" "),
    }
    d = items(t("documents")).select("id", tables.brief_card(row).alias("card"))
    return d.select("id", "card", text.card_field(F.col("card"), fixed.CARD["definition"]).alias("definition"))


@query(f"""WITH {PLAIN} SELECT doc_id, n_chars AS k, left(plain, 30) AS s FROM d""")
def cards_and_answers(t):
    """The object that a model's answer ends with: bare, fenced, or between sentences."""
    d = first_words(t("documents")).withColumn("json", F.to_json(F.struct(F.col("n_chars").alias("k"), F.substring("plain", 1, 30).alias("s"))))
    answer = F.when(F.col("n_chars") % 3 == 0, F.col("json")).when(F.col("n_chars") % 3 == 1, F.concat(F.lit("```json\n"), F.col("json"), F.lit("\n```"))).otherwise(F.concat(F.lit("It is "), F.col("json"), F.lit(" I think")))
    return d.select("doc_id", text.last_json_object(answer, "k long, s string").alias("o")).select("doc_id", "o.k", "o.s")


_OLD, _NEW = 1000, 2000
_PUBLISHED = f"""k AS (SELECT id, 'T:' || title AS dedup_key, title, source, content, length(content) AS n FROM items WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY title ORDER BY id) = 1),
o AS (SELECT dedup_key, title, CASE WHEN n % 4 = 0 THEN left(content, 300) WHEN n % 4 = 1 THEN title ELSE left(content, 25) END AS summary, CASE WHEN n % 5 = 0 THEN 'ai' END AS summary_source, left(content, 50) AS content,
  CASE WHEN n % 3 = 0 THEN 'ai_interpretation' ELSE 'ai_summary' END AS content_source, CASE WHEN n % 6 = 0 THEN 'old view' END AS opinion, {_OLD} AS created, n % 7 = 0 AS retained, CASE WHEN n % 14 = 0 THEN {_OLD} + 5 END AS retained_at, {_OLD} + 9 AS expires FROM k WHERE n % 11 > 1),
i AS (SELECT dedup_key, title, source, CASE WHEN n % 2 = 0 THEN left(content, 60) ELSE '' END AS summary, CASE WHEN n % 9 = 0 THEN 'ai' END AS summary_source, CASE WHEN n % 13 = 0 THEN '' ELSE left(content, 80) END AS content,
  CASE WHEN n % 8 = 0 THEN 'ai_interpretation' WHEN n % 8 = 1 THEN 'official_rss' ELSE 'fetched' END AS content_source, CASE WHEN n % 10 = 0 THEN 'new view' END AS opinion FROM k WHERE n % 11 < 9)"""
_FAKE = f"(o.summary = '' OR o.summary = coalesce(i.title, '') OR length(o.summary) < 20 OR length(regexp_replace(o.summary, '{_BARE}', '', 'g')) < 5 OR o.summary = coalesce(i.source, ''))"


@query(f"""WITH {ITEMS}, {_PUBLISHED},
j AS (SELECT i.dedup_key AS ik, o.dedup_key AS ok, i.summary AS s, o.summary AS os, coalesce(i.summary_source, CASE WHEN i.summary = '' OR i.summary = i.title THEN 'title' ELSE 'desc' END) AS kind, coalesce(o.summary_source, CASE WHEN o.summary <> '' AND o.summary <> o.title THEN 'desc' ELSE 'title' END) AS okind, o.summary_source AS okind_raw,
  {_FAKE} AS fake, i.content AS c, o.content AS oc, i.content_source AS cs, o.content_source AS ocs, i.opinion AS op, o.opinion AS oop, o.created, o.retained, o.retained_at, o.expires FROM i FULL JOIN o ON i.dedup_key = o.dedup_key),
a AS (SELECT *, ok IS NOT NULL AND okind = 'ai' AND kind <> 'ai' AS keep_ai, ok IS NOT NULL AND okind <> 'ai' AND kind <> 'ai' AND NOT fake AND length(os) > length(s) AS keep_desc FROM j),
b AS (SELECT *, CASE WHEN keep_ai OR keep_desc THEN os ELSE s END AS ns, CASE WHEN keep_ai THEN 'ai' WHEN keep_desc THEN 'desc' ELSE kind END AS nk FROM a),
m AS (SELECT *, CASE WHEN cs = 'fetched' AND nk = 'ai' AND ns <> '' THEN 'ai_summary' WHEN cs = 'fetched' AND {TRIM.format("c")} = '' THEN '' ELSE cs END AS mark FROM b),
g AS (SELECT *, ok IS NOT NULL AND ocs = 'ai_interpretation' AND mark NOT IN ('ai_interpretation', 'official_rss') AS guarded FROM m)
SELECT coalesce(ik, ok) AS dedup_key, CASE WHEN ik IS NULL THEN os ELSE ns END AS summary, CASE WHEN ik IS NULL THEN okind_raw ELSE nk END AS summary_source, CASE WHEN ik IS NULL THEN oc WHEN guarded AND oc <> '' THEN oc ELSE c END AS content,
  CASE WHEN ik IS NULL THEN ocs WHEN guarded THEN 'ai_interpretation' ELSE mark END AS content_source, CASE WHEN ik IS NULL THEN oop WHEN guarded THEN coalesce(nullif(oop, ''), op, '') ELSE coalesce(op, '') END AS opinion, CAST(coalesce(created, {_NEW}) AS BIGINT) AS created,
  CASE WHEN ik IS NULL THEN retained ELSE coalesce(retained, false) END AS retained, CAST(coalesce(CASE WHEN ik IS NULL THEN retained_at WHEN retained THEN coalesce(retained_at, {_NEW}) END, -1) AS BIGINT) AS retained_at,
  CAST(CASE WHEN ik IS NULL THEN expires WHEN retained THEN coalesce(retained_at, {_NEW}) + 30 * 86400 ELSE {_NEW} + 7 * 86400 END AS BIGINT) AS expires FROM g""")
def merge_all_branches(t):
    d = items(t("documents")).where("title <> ''").withColumn("dedup_key", tables.dedup_key(F.lit(""), F.col("title"))).withColumn("n", F.length("content"))
    d = tables.first_per_key(d.select("id", "dedup_key", "title", "source", "content", "n"), ["dedup_key"], [F.col("id")])
    n, head = F.col("n"), lambda k: F.substring("content", 1, k)
    nothing = F.lit(None)
    old = d.where(n % 11 > 1).select(
        "dedup_key", "title", "source", F.when(n % 4 == 0, head(300)).when(n % 4 == 1, F.col("title")).otherwise(head(25)).alias("summary"), F.when(n % 5 == 0, "ai").alias("summary_source"), head(50).alias("content"),
        F.when(n % 3 == 0, "ai_interpretation").otherwise("ai_summary").alias("content_source"), F.when(n % 6 == 0, "old view").alias("opinion"), F.lit(_OLD).cast("long").alias("created"), (n % 7 == 0).alias("retained"),
        F.when(n % 14 == 0, _OLD + 5).cast("long").alias("retained_at"), F.lit(_OLD + 9).cast("long").alias("expires"),
    )
    new = d.where(n % 11 < 9).select(
        "dedup_key", "title", "source", F.when(n % 2 == 0, head(60)).otherwise("").alias("summary"), F.when(n % 9 == 0, "ai").alias("summary_source"), F.when(n % 13 == 0, "").otherwise(head(80)).alias("content"),
        F.when(n % 8 == 0, "ai_interpretation").when(n % 8 == 1, "official_rss").otherwise("fetched").alias("content_source"), F.when(n % 10 == 0, "new view").alias("opinion"), nothing.cast("long").alias("created"), nothing.cast("boolean").alias("retained"),
        nothing.cast("long").alias("retained_at"), nothing.cast("long").alias("expires"),
    )
    return tables.merge_published(old, new, _NEW).drop("title", "source").withColumn("retained_at", F.coalesce("retained_at", F.lit(-1)))


@query("""WITH d AS (SELECT doc_id, lang, n_chars, n_chars % 101 - 2.0 * (doc_id % 48) AS x FROM documents) SELECT lang, doc_id FROM d QUALIFY row_number() OVER (PARTITION BY lang ORDER BY x DESC, doc_id) <= 10""")
def decayed_top_n(t):
    score = scoring.decayed(F.col("n_chars") % 101, F.lit(AS_OF) - (F.col("doc_id") % 48) * HOUR, F.lit(AS_OF), per_hour=2.0)
    d = t("documents").select("lang", "doc_id", score.alias("score"))
    return tables.top_per_group(d, "lang", [F.desc("score"), F.col("doc_id")], 10).select("lang", "doc_id")
