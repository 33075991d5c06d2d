"""Queries over lists, channels, reports and single rules that read pages, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import gates, publish
from ..shared import forget, place, remove, written
from ..sources import exports, feeds, reports
from . import registry
from .documents import ITEMS, items
from .events import BEGAN, DAY, E, timed
from .registry import query
from .rules import PLAIN, TRIM, first_words

_NAMED = "CASE category WHEN 'en' THEN 'tech' WHEN 'de' THEN 'life' WHEN 'fr' THEN 'science' ELSE 'other' END"
_LABEL = "CASE k " + " ".join(f"WHEN '{n}' THEN '{label}'" for n, label in fixed.CATEGORY_LABELS.items()) + " ELSE '' END"


def _named():
    c = F.col("category")
    return F.when(c == "en", "tech").when(c == "de", "life").when(c == "fr", "science").otherwise("other")


@query(f"""WITH {PLAIN}, d2 AS (SELECT doc_id AS id, left(plain, 60) AS title, nullif(left(plain, 20), '') AS summary, source, lang AS category, n_chars, {BEGAN} + doc_id * 60 AS created FROM d), n AS (SELECT *, {_NAMED} AS k FROM d2)
SELECT CAST(id AS VARCHAR) AS id, trim(title) AS title, summary, '' AS summary_source, k AS category, CASE WHEN n_chars % 5 = 0 THEN 'Own' ELSE {_LABEL} END AS category_name, source, '' AS source_url, '' AS content_source, coalesce(source, '') AS source_name, n_chars % 2 = 0 AS retained,
  CAST(n_chars % 101 AS DOUBLE) AS final, CASE WHEN n_chars % 3 > 0 THEN title ELSE '' END AS content, created FROM n""")
def list_shapes(t):
    d = first_words(t("documents")).select(F.col("doc_id").alias("id"), F.substring("plain", 1, 60).alias("title"), F.nullif(F.substring("plain", 1, 20), F.lit("")).alias("summary"), "source", F.col("lang").alias("category"), "n_chars", (F.lit(BEGAN) + F.col("doc_id") * 60).alias("created"))
    row = {
        "id": F.col("id"), "title": F.concat(F.lit(" <b>"), "title", F.lit("</b>  ")), "summary": F.col("summary"), "category": _named(), "category_name": F.when(F.col("n_chars") % 5 == 0, "Own"), "source": F.col("source"), "source_name": F.col("source"),
        "retained": F.when(F.col("n_chars") % 2 == 0, F.lit(True)), "final": F.col("n_chars") % 101, "content": F.when(F.col("n_chars") % 3 > 0, F.col("title")), "created": F.col("created"),
    }
    made = d.select(publish.list_shape(row).alias("l"), publish.list_shape(row, since=True).alias("s"))
    return made.select(*[F.col(f"l.{c}").alias(c) for c in ("id", "title", "summary", "summary_source", "category", "category_name", "source", "source_url", "content_source", "source_name", "retained", "final", "content")], "s.created")


@query(f"""WITH {ITEMS}, k AS (SELECT category, id, length(content) AS n FROM items QUALIFY row_number() OVER (PARTITION BY category ORDER BY length(content) DESC, id) <= 12)
SELECT category, string_agg(CAST(id AS VARCHAR), ',' ORDER BY n DESC, id) AS ids FROM k GROUP BY category""")
def category_lists(t):
    d = items(t("documents")).select("category", "id", F.length("content").alias("n"))
    found = publish.grouped_lists(d, "category", "id", [F.desc("n"), F.col("id")], 12)
    return found.select("category", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"""WITH {ITEMS}, i AS (SELECT source, id, {TRIM.format("replace(title, '*', '')")} AS name, length(content) AS n, row_number() OVER (PARTITION BY source ORDER BY id) AS place FROM items WHERE source IS NOT NULL),
k AS (SELECT * FROM i WHERE place <= 4), s AS (SELECT source, {BEGAN} + min(id) * 60 AS at_s, CAST(count(*) AS INT) AS version, string_agg(name || '=' || CASE WHEN n % 2 = 0 THEN trim(left(name, 15)) ELSE '' END || '=' || CASE WHEN n % 3 = 0 THEN '生活' ELSE '' END, chr(10) ORDER BY place) FILTER (WHERE name <> '') AS shown FROM k GROUP BY source)
SELECT source, version, strftime(make_timestamp((at_s + 28800) * 1000000), '%H:%M') AS clock, '数据截至 ' || strftime(make_timestamp((at_s + 28800) * 1000000), '%H:%M') AS label, coalesce(shown, '') AS shown, shown IS NOT NULL AS has_content FROM s""")
def channel_payloads(t):
    """A brief of each source's first four items, as a channel shows it."""
    d = items(t("documents")).where("source is not null").withColumn("name", F.regexp_replace(F.replace("title", F.lit("*"), F.lit("")), "^[\\s　 ﻿]+|[\\s　 ﻿]+$", ""))
    n = F.length("content")
    card = F.concat(F.lit(f"### x\n- **{fixed.CARD['source']}**：s\n"), F.when(n % 2 == 0, F.concat(F.lit(f"- **{fixed.CARD['definition']}**：  "), F.substring("name", 1, 15), F.lit(" \n"))).otherwise(""))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(x) for x in names]
    item = F.struct(F.col("id").cast("string").alias("id"), F.col("name").alias("title"), *none("string", "url", "source_name"), F.col("source").alias("source_id"), *none("string", "published"), card.alias("card"), *none("boolean", "contract", "tryable"),
                    F.when(n % 3 == 0, F.array(F.lit("life"))).alias("scenes"), *none("string", "relevance"), *none("int", "rank"))
    grouped = publish.grouped_lists(d.select("source", "id", item.alias("item")), "source", "item", [F.col("id")], 4)
    first = F.element_at("items", 1)["id"].cast("long")
    payload = publish.channel_payload({"version": F.size("items"), "generated": F.lit(BEGAN) + first * 60, "items": F.col("items")})
    made = grouped.select("source", payload.alias("p"))
    said = F.transform("p.items", lambda x: F.concat_ws("=", x["title"], x["definition"], F.array_join(F.transform(x["scenes"], lambda s: s["label"]), ",")))
    return made.select("source", "p.version", "p.clock", "p.label", F.array_join(said, "\n").alias("shown"), "p.has_content")


@query(f"""WITH {PLAIN}, w AS (SELECT doc_id, plain, n_chars, source, array_to_string(string_split(plain, ' ')[1:5], ' ') AS a, array_to_string(string_split(plain, ' ')[6:10], ' ') AS b FROM d WHERE len(string_split(plain, ' ')) >= 10 AND source IS NOT NULL)
SELECT doc_id, '2024-01-0' || n_chars % 9 + 1 || CASE WHEN n_chars % 2 = 0 THEN ' 10:30' ELSE '' END AS time, source AS who, a AS content, b || chr(10) AS body, 'RQ-' || doc_id || '/' || a || '/' || source || '/P1/✅ ok/✅' AS board, 'h' || doc_id || '/' || source || '/2024/' || a || '|' || b AS commit FROM w""")
def reports_parsed(t):
    """A log, a board and a list of commits put together from a text's first words."""
    d = first_words(t("documents")).withColumn("w", F.split("plain", " ", -1)).where((F.size("w") >= 10) & F.col("source").isNotNull())
    part = lambda n: F.array_join(F.slice("w", n, 5), " ")
    d = d.select("doc_id", "n_chars", "source", part(1).alias("a"), part(6).alias("b"))
    day = F.concat(F.lit("2024-01-0"), (F.col("n_chars") % 9 + 1).cast("string"), F.when(F.col("n_chars") % 2 == 0, " 10:30").otherwise(""))
    log = F.concat(F.lit("# Log\nintro\n## ["), day, F.lit("] ✅ `"), "a", F.lit("` | 会话：["), "source", F.lit("]\n"), "b", F.lit("\n"))
    number = F.col("doc_id").cast("string")
    board = F.concat(F.lit("| id | name | owner | priority | status |\n|---|---|---|---|---|\n| RQ-"), number, F.lit(" | "), "a", F.lit(" | "), "source", F.lit(" | P1 | ✅ ok |\n| no | row | of | a | task |\n"))
    listed = F.concat(F.lit("h"), number, F.lit("|"), "source", F.lit("|2024|"), "a", F.lit("|"), "b", F.lit("\n\n"))
    found = d.select("doc_id", F.inline(reports.log_blocks(log)), reports.board_rows(board).alias("rows"), reports.commits(listed).alias("made"))
    row, one = F.get("rows", F.lit(0)), F.get("made", F.lit(0))
    return found.select("doc_id", "time", "who", "content", "body", F.concat_ws("/", *[row[c] for c in ("id", "name", "owner", "priority", "status", "sign")]).alias("board"), F.concat_ws("/", *[one[c] for c in ("hash", "author", "date", "subject")]).alias("commit"))




@query(rf"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '[^a-zA-Z ]', '', 'g') AS title, CASE WHEN page_id % 7 = 0 THEN 'ftp://x' ELSE url END AS url FROM pages), k AS (SELECT *, trim(regexp_replace(title, '\s+', ' ', 'g')) AS name FROM p)
SELECT page_id, CASE WHEN name = '' THEN 'no title' WHEN url = '' THEN 'no url' WHEN NOT regexp_matches(url, '(?i)^https?://') THEN 'url scheme' WHEN NOT length(url) BETWEEN 10 AND 1024 THEN 'url length' WHEN length(name) < 4 THEN 'title short' WHEN length(name) > 200 THEN 'title long' END AS reason,
  CASE WHEN page_id % 3 = 0 THEN 'named' WHEN regexp_matches(url, '^https?://([^/?#:]*\.)?example\.com([/?#:]|$)') THEN 'BBC' ELSE regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') END AS source FROM k""")
def raw_records(t):
    """Gate of raw records, and the name of a page's source, with one of the hosts moved to a known one."""
    title = F.regexp_replace(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), "[^a-zA-Z ]", "")
    url = F.when(F.col("page_id") % 7 == 0, "ftp://x").otherwise(F.col("url"))
    named = F.when(F.col("page_id") % 3 == 0, " named ")
    moved = F.regexp_replace(url, r"^(https?://[^/?#:]*)example\.com", "$1bbc.com")
    return t("pages").select("page_id", gates.raw_record_reason(title, url).alias("reason"), feeds.source_of(named, moved).alias("source"))


_WORDS = ["the", "und", "que", "les", "token"]


@query(f"""WITH {E}, d AS (SELECT at_s // 86400 AS day, count_if(event_type = 'purchase' AND value > 45) AS done, count_if(event_type = 'view' AND value > 25) AS backlog FROM e GROUP BY 1) SELECT day, done > 0 OR backlog >= 36 AS yields FROM d""")
def stage_yields(t):
    n = timed(t).groupBy(F.floor(F.col("at_s") / DAY).alias("day")).agg(F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 45)).alias("done"), F.count_if((F.col("event_type") == "view") & (F.col("value") > 25)).alias("backlog"))
    return n.select("day", publish.yields_to(F.col("done"), F.col("backlog")).alias("yields"))


@query(f"""SELECT doc_id, {" + ".join(f"CAST(contains(lower(coalesce(text, '')), '{w}') AS INT)" for w in _WORDS)} AS hits FROM documents""")
def indicator_words(t):
    return t("documents").select("doc_id", publish.indicator_hits(F.col("text"), _WORDS).alias("hits"))


@query(f"""WITH {PLAIN}, b AS (SELECT doc_id, source, left(plain, 40) AS title, plain, n_chars FROM d)
SELECT doc_id, 'stories:' || doc_id AS guid, title, 'https://x.org/' || doc_id AS url, left(CASE WHEN plain = '' THEN title ELSE plain END, 5000) AS raw, left(plain, 300) AS summary, CAST(n_chars AS VARCHAR) || '/0' AS meta FROM b WHERE title <> '' AND n_chars % 5 > 0
UNION ALL SELECT doc_id, 'papers:' || CASE WHEN n_chars % 2 = 0 THEN 'p' || doc_id ELSE 'https://x.org/' || doc_id END, trim(title), 'https://x.org/' || doc_id, left(plain, 5000), left(plain, 300), coalesce(source, '') FROM b WHERE trim(title) <> ''
UNION ALL SELECT doc_id, 'keywords:' || sha256('https://x.org/' || doc_id), trim(title), 'https://x.org/' || doc_id, left(plain, 5000), left(plain, 300), 'aggregated' FROM b WHERE trim(title) <> ''""")
def adapters_parsed(t):
    """Answers of a story search, a paper search and a keyword feed, made of each text."""
    d = first_words(t("documents")).withColumn("title", F.substring("plain", 1, 40))
    i = F.col("doc_id").cast("string")
    hit = F.struct("title", F.when(F.col("n_chars") % 5 > 0, F.concat(F.lit("https://x.org/"), i)).alias("url"), i.alias("objectID"), F.col("plain").alias("story_text"), F.col("n_chars").cast("string").alias("points"))
    stories = F.to_json(F.struct(F.array(hit).alias("hits")))
    number = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("<id>p"), i, F.lit("</id>"))).otherwise("")
    papers = F.concat(F.lit("<feed><title>f</title><entry>"), number, F.lit("<title> "), "title", F.lit("</title><link rel='alternate' href='https://x.org/"), i, F.lit("'/><summary>\n"), "plain", F.lit("</summary><author><name>"), F.coalesce("source", F.lit("")), F.lit("</name></author></entry><entry><title>no link</title></entry></feed>"))
    words = F.concat(F.lit("<rss version='2.0'><channel><title>c</title><item><title>"), "title", F.lit("</title><link>https://x.org/"), i, F.lit("</link><description>"), "plain", F.lit("</description></item></channel></rss>"))
    found = F.concat(feeds.story_search_items(stories), feeds.paper_items(papers), feeds.keyword_feed_items(words))
    return d.select("doc_id", F.explode(found).alias("x")).select("doc_id", *[F.col(f"x.{c}") for c in ("guid", "title", "url", "raw", "summary")], F.array_join(F.map_values("x.meta"), "/").alias("meta"))


@query(f"""WITH {ITEMS}, d AS (SELECT id, title, content, published, regexp_replace(replace(content, ' e', ' ' || chr(65533) || 'e'), 'zzz', '') AS broken FROM items)
SELECT id, title, content AS happened, len(list_filter(list_transform(string_split_regex(content, '\n+'), lambda x: {TRIM.format("x")}), lambda x: x <> '')) AS n_lines, CASE WHEN length(content) % 2 = 0 AND title <> '' THEN 'text=' || title ELSE '' END AS blocks, 'todo' AS research,
  strftime(make_timestamp((published + 28800) * 1000000), '%-m/%-d %H:%M') AS processed FROM d""")
def intel_details(t):
    """Details of texts into which broken characters are planted."""
    d = items(t("documents"))
    broken = F.replace("content", F.lit(" e"), F.lit(" \ufffde"))
    blocks = F.array(F.struct(F.lit("odd").alias("type"), F.when(F.length("content") % 2 == 0, F.col("title")).alias("text")))
    made = d.select("id", publish.intel_detail({"id": F.col("id"), "title": F.col("title"), "happened": broken, "blocks": blocks, "processed": F.col("published")}).alias("d"))
    return made.select("id", "d.title", "d.happened", F.size("d.happened_lines").cast("long").alias("n_lines"), F.array_join(F.transform("d.blocks", lambda b: F.concat_ws("=", b["type"], b["text"])), "|").alias("blocks"), "d.research", "d.processed")


def export_files_read(spark, sf_dir):
    """Items and broken rows of exports that are written from the documents as lines and as CSV."""
    d = first_words(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.substring("plain", 1, 60).alias("title"), F.concat(F.lit("https://x.org/"), F.col("doc_id").cast("string")).alias("link"), F.lit("2024-01-02").alias("publish_time"), F.col("plain").alias("digest"))
    where = place(spark, "exports")
    line = F.to_json(F.struct("title", "link", "publish_time", "digest"))
    d.select(F.when(F.col("doc_id") % 10 == 3, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(f"{where}/lines")
    d.select("title", "link", "publish_time", "digest").write.csv(f"{where}/csv", header=True)
    out, parsed = [], []
    for form in ("lines", "csv"):
        rows = written(exports.read_export(spark, f"{where}/{form}", form), "export-rows")
        made = exports.export_items(exports.good_rows(rows))
        kept = made.agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"), F.sum("published").alias("times"), F.count_if(F.col("title") == exports.NO_TITLE).alias("untitled"))
        broken = rows.agg(F.count(exports.BROKEN).alias("broken"))
        parsed.append(rows)
        out.append(kept.crossJoin(broken).withColumn("form", F.lit(form)))  # one row each
    done = written(out[0].unionByName(out[1]), "export-counts")
    remove(spark, where)
    for rows in parsed:
        forget(rows)
    return done


registry.QUERIES["export_files_read"] = export_files_read
registry.ORACLE_SQL["export_files_read"] = f"""WITH {PLAIN}, e AS (SELECT 'lines' AS form, doc_id % 10 = 3 AS bad, plain FROM d UNION ALL SELECT 'csv', false, plain FROM d)
SELECT form, count_if(NOT bad) AS n, CAST(sum(CASE WHEN bad THEN 0 ELSE length(left(plain, 5000)) END) AS BIGINT) AS chars, CAST(count_if(NOT bad) * 1704153600 AS BIGINT) AS times, count_if(NOT bad AND plain = '') AS untitled, count_if(bad) AS broken FROM e GROUP BY form"""
