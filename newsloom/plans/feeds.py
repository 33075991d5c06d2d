"""Queries over feeds, answers and raw documents that are built from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import scoring
from ..sources import feeds
from .registry import query

#: Letters and single spaces of a text, as SQL and as a column.
PLAIN = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', '', 'g'), ' +', ' ', 'g'))"
BASE = f"b AS (SELECT doc_id AS id, source, {PLAIN} AS plain FROM documents)"


def base(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("id"), "source", text.latin_words(F.col("text")).alias("plain"))


def _feed(d: DataFrame) -> DataFrame:
    """xml: an RSS document for most rows, an Atom one for every third; every fifth item has no title."""
    i = F.col("id").cast("string")
    title = F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("<title> Item "), i, F.lit("</title>")))
    body = F.concat(F.lit("&lt;p&gt;"), F.col("plain"), F.lit("&lt;/p&gt;&lt;script&gt;bad&lt;/script&gt;"))
    rss = F.concat(
        F.lit("<?xml version='1.0'?><rss version='2.0'><channel><title>c</title><item>"), title, F.lit("<link>https://x.org/"), i, F.lit("</link><category>"), F.col("source"),
        F.lit("</category><category>more</category><pubDate>2024-01-02</pubDate><description>"), body, F.lit("</description></item><item><title>no address</title></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><title>c</title><entry>"), title, F.lit("<link rel='self' href='https://x.org/self'/><link rel='alternate' href='https://x.org/"), i,
        F.lit("'/><updated>2024-01-02</updated><category term='"), F.col("source"), F.lit("'/><content>"), body, F.lit("</content></entry></feed>"),
    )
    return d.withColumn("xml", F.when(F.col("id") % 3 == 0, atom).otherwise(rss))


@query(f"""WITH {BASE} SELECT id, 'Item ' || id AS title, 'https://x.org/' || id AS url, '2024-01-02' AS pub_date, source AS category, CASE WHEN id % 3 = 0 THEN 1 ELSE 2 END AS n_categories,
  left(trim(plain || ' bad'), 300) AS "desc", left(plain, 5000) AS content FROM b WHERE id % 5 <> 0""")
def feed_items_parsed(t):
    found = _feed(base(t("documents"))).select("id", F.inline(feeds.feed_items(F.col("xml"))))
    return found.select("id", "title", "url", "pub_date", "category", F.size("categories").alias("n_categories"), "desc", "content")


@query(f"""WITH {BASE} SELECT id, 'Story ' || id AS title, 'https://x.org/' || id AS url, CAST(id AS VARCHAR) AS guid, CASE WHEN plain = '' THEN 'Story ' || id ELSE plain END AS "desc", plain AS content
FROM b WHERE id % 4 <> 0""")
def story_hits_parsed(t):
    hit = F.struct(
        F.concat(F.lit("Story "), "id").alias("title"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("https://x.org/"), "id")).alias("url"), F.col("id").cast("string").alias("objectID"), F.col("plain").alias("story_text")
    )
    d = base(t("documents")).withColumn("json", F.when(F.col("id") % 8 == 0, "{broken").otherwise(F.to_json(F.struct(F.array(hit).alias("hits")))))
    return d.select("id", F.inline(feeds.story_hits(F.col("json")))).select("id", "title", "url", "guid", "desc", "content")


@query(f"""WITH {BASE} SELECT id AS doc, kind || '_science_' || id AS id, 'Title ' || id AS title, left(trim(CASE WHEN plain = '' THEN CASE kind WHEN 'juhe' THEN 'Title ' || id ELSE '2024' END ELSE plain END), 150) AS summary,
  CASE kind WHEN 'juhe' THEN 'science' ELSE 'recommend' END AS category, CASE WHEN id % 2 = 0 THEN source WHEN kind = 'juhe' THEN '聚合数据' ELSE '天行数据' END AS source
FROM b, (VALUES ('juhe'), ('tian')) AS k(kind) WHERE id % 7 <> 0""")
def aggregator_items_parsed(t):
    i = F.col("id").cast("string")
    row = lambda **names: F.array(F.struct(*[c.alias(n) for n, c in names.items()]))
    title, source = F.concat(F.lit("Title "), i), F.when(F.col("id") % 2 == 0, F.col("source"))
    juhe = F.struct(F.when(F.col("id") % 7 == 0, "10012").otherwise("0").alias("error_code"), F.struct(row(uniquekey=i, title=title, description=F.col("plain"), author_name=source).alias("data")).alias("result"))
    tian = F.struct(F.when(F.col("id") % 7 == 0, 500).otherwise(200).alias("code"), F.struct(row(id=i, title=title, description=F.col("plain"), ctime=F.lit("2024"), src=source).alias("newslist")).alias("result"))
    d = base(t("documents")).select(F.col("id").alias("doc"), F.to_json(juhe).alias("juhe"), F.to_json(tian).alias("tian"))
    both = F.concat(feeds.juhe_items(F.col("juhe"), F.lit("science")), feeds.tian_items(F.col("tian"), F.lit("science")))
    return d.select("doc", F.inline(both)).select("doc", "id", "title", "summary", "category", "source")


@query(f"""WITH {BASE}, a AS (SELECT id, list_filter([left(plain, 30), source, substr(plain, 31, 30)], lambda x: x IS NOT NULL) AS names, length(plain) % 4 AS form FROM b)
SELECT id AS doc_id, CAST(i - 1 AS BIGINT) AS pos, names[i] AS title FROM a, unnest(range(1, 4)) AS u(i) WHERE form <> 3 AND i <= len(names)""")
def answer_lists_parsed(t):
    """Lists of a text's parts in a model's answer: bare, fenced, between sentences, or not there."""
    d = base(t("documents"))
    names = F.filter(F.array(F.substring("plain", 1, 30), F.col("source"), F.substring("plain", 31, 30)), lambda x: x.isNotNull())
    rows, form = F.to_json(F.transform(names, lambda x: F.struct(x.alias("title")))), F.length("plain") % 4
    forms = F.when(form == 0, rows).when(form == 1, F.concat(F.lit("Here:\n```json\n"), rows, F.lit("\n```"))).when(form == 2, F.concat(F.lit("I found "), rows, F.lit(" so far."))).otherwise(F.col("plain"))
    # Within the generator: of a column, Spark would infer a filter that parses every answer once more.
    found = d.select(F.col("id").alias("doc_id"), F.posexplode(feeds.answer_items(forms, "struct<title: string>")).alias("pos", "x"))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "x.title")


_NAMES = [n for names in fixed.FEED_TABS.values() for n in names] + ["科学前沿", "Sicprobe", "unknown"]


@query(f"""WITH c AS (SELECT doc_id, [{", ".join(f"'{n}'" for n in _NAMES)}][CAST(n_chars % {len(_NAMES)} + 1 AS INT)] AS c FROM documents)
SELECT c AS category, CASE WHEN c IN ('科学前沿', 'Sicprobe', 'science', 'sci', 'sports') THEN 'science' WHEN c IN ('tech', 'digital', 'auto', 'it') THEN 'tech'
  WHEN c IN ('world', 'international', 'global') THEN 'international' WHEN c = 'recommend' THEN 'recommend' ELSE 'life' END AS tab, count(*) AS n FROM c GROUP BY ALL""")
def category_tabs(t):
    names = F.array(*[F.lit(n) for n in _NAMES])
    c = F.get(names, (F.col("n_chars") % len(_NAMES)).cast("int"))
    return t("documents").groupBy(c.alias("category"), feeds.feed_tab(c).alias("tab")).agg(F.count("*").alias("n"))


_PAGE = """p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'ftp://' || url ELSE url || '?id=' || page_id END AS url, regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '[^a-zA-Z]', '', 'g') AS title FROM pages)"""
_NORMAL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '(?i)^(https?://)?', ''), '/+$', ''), '(?i)([?&])(utm_[a-z]+|spm|from|from_|source|ref)=[^&]*(&|$)', '\\1', 'g'), '[?&]+$', '')"


@query(f"""WITH {_PAGE}, n AS (SELECT *, {_NORMAL} AS normal FROM p)
SELECT page_id, 'aggregate' AS kind, sha256(normal) AS id, sha256(title) AS title_fp, url, title, 'juhe_tech' AS source_id FROM n WHERE page_id % 3 <> 0 AND length(title) >= 4
UNION ALL SELECT page_id, 'official', 'official_' || sha256(normal), sha256(title), url, title, 'xinhua' FROM n""")
def aggregate_documents(t):
    """Raw documents of pages: ids by the whole address, so one that differs in its query is another one."""
    p = t("pages").select(
        "page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("ftp://"), "url")).otherwise(F.concat("url", F.lit("?id="), F.col("page_id").cast("string"))).alias("url"),
        F.regexp_replace(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), "[^a-zA-Z]", "").alias("title"),
    )
    item = F.struct(F.col("url").alias("source_url"), "url", "title", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("source"), F.lit("tech").alias("category"), F.lit("2024").alias("publish_time"), F.lit("2024").alias("pub_date"))
    feed = F.struct(F.lit("xinhua").alias("id"), F.lit("新华社").alias("name"), F.lit("tech").alias("category"))
    kinds = {"aggregate": feeds.aggregate_document(F.col("item"), "juhe", F.lit("tech")), "official": feeds.official_document(F.col("item"), feed)}
    made = [p.select("page_id", item.alias("item")).select("page_id", F.lit(kind).alias("kind"), made.alias("d")).where("d is not null").select("page_id", "kind", "d.id", "d.title_fp", "d.url", "d.title", "d.source_id") for kind, made in kinds.items()]
    return made[0].unionByName(made[1])


_LENS_CATEGORY = "CASE source WHEN 'src1' THEN 'life' WHEN 'src2' THEN 'science' WHEN 'src3' THEN 'recommend' WHEN 'src4' THEN 'international' ELSE 'tech' END"


@query(f"""WITH i AS (SELECT doc_id, contains(coalesce(text, ''), 'token = ') AS barred, n_chars % 11 = 1 AS open_question, {_LENS_CATEGORY} AS category, CASE WHEN n_chars % 6 = 5 THEN 50 ELSE n_chars % 101 END AS score FROM documents),
l AS (SELECT *, CASE WHEN barred THEN 'brief' WHEN open_question AND score >= 40 THEN 'ask' WHEN category = 'life' AND score >= 40 THEN 'life' WHEN score >= 65 AND category <> 'science' AND category <> 'life' THEN 'cold'
  WHEN score >= 45 THEN 'depth' ELSE 'brief' END AS lens FROM i)
SELECT doc_id, lens, lens <> 'brief' AS allow_opinion, CASE lens WHEN 'brief' THEN 180 WHEN 'ask' THEN 255 WHEN 'life' THEN 255 ELSE 300 END AS t_min, CASE lens WHEN 'brief' THEN 360 WHEN 'ask' THEN 510 WHEN 'life' THEN 510 ELSE 600 END AS t_max FROM l""")
def lens_routes(t):
    summary = F.when(F.contains(F.coalesce("text", F.lit("")), F.lit("token = ")), "某地地震").otherwise("")
    title = F.when(F.col("n_chars") % 11 == 1, "方案拟定").otherwise("新闻")
    category = F.lit("tech")
    for name, c in (("src1", "life"), ("src2", "science"), ("src3", "recommend"), ("src4", "international")):
        category = F.when(F.col("source") == name, c).otherwise(category)
    score = F.when(F.col("n_chars") % 6 != 5, (F.col("n_chars") % 101).cast("int"))
    routed = t("documents").select("doc_id", scoring.lens_route(title, summary, category, score, F.lit(None).cast("int"), F.col("text")).alias("r"))
    sized = routed.select("doc_id", "r.lens", "r.allow_opinion", scoring.length_budget(F.col("r.lens"), F.lit(None).cast("int"), F.lit(None).cast("int")).alias("b"))
    return sized.select("doc_id", "lens", "allow_opinion", "b.t_min", "b.t_max")


_HOLDS = lambda words, x: " OR ".join(f"contains({x}, '{w.lower()}')" for w in words)


@query(f"""WITH {BASE}, q AS (SELECT id, lower(left(plain, 25)) || CASE WHEN source = 'src1' THEN ' 房价' ELSE '' END AS q FROM b)
SELECT id AS doc_id, CASE WHEN {_HOLDS(fixed.SEARCH_OTHER, "q")} THEN 'model' WHEN {_HOLDS(fixed.SEARCH_WORDS, "q")} THEN 'true' ELSE 'model' END AS related FROM q""")
def search_fast_paths(t):
    """The first words of a text as a search."""
    q = F.concat(F.substring("plain", 1, 25), F.when(F.col("source") == "src1", " 房价").otherwise(""))
    return base(t("documents")).select(F.col("id").alias("doc_id"), F.coalesce(scoring.search_fast_path(q).cast("string"), F.lit("model")).alias("related"))


@query(f"""WITH {BASE}, h AS (SELECT id, plain, left(plain, CASE WHEN length(plain) < 200 THEN 40 ELSE 50 END) AS head, CASE WHEN length(plain) < 200 THEN 40 ELSE 50 END AS target FROM b),
g AS (SELECT *, length(head) - strpos(reverse(head), ' ') AS gap FROM h), c AS (SELECT *, CASE WHEN contains(head, ' ') AND gap > target * 0.5 THEN left(head, gap) ELSE head END AS cut FROM g)
SELECT id, CASE WHEN id % 3 = 0 THEN 'A model that sorts its news' WHEN plain = '' THEN '' WHEN length(plain) > length(cut) THEN trim(cut || '…') ELSE trim(cut) END AS summary FROM c""")
def brief_summaries(t):
    definition = F.when(F.col("id") % 3 == 0, "作者｜Xu A model that sorts its news").otherwise("")
    body = F.concat(F.lit("（AI 预测）：\n**"), F.col("plain"), F.lit("**\n\nNext part"))
    body = F.when(F.col("plain") == "", "").otherwise(body)
    return base(t("documents")).select("id", text.brief_summary(definition, body).alias("summary"))


@query(f"""WITH {BASE} SELECT id AS doc_id, CASE WHEN length(plain) % 3 = 0 THEN trim(coalesce('src ' || source, '')) ELSE '' END AS origin, source <> 'src1' AND regexp_matches(said, '[A-Za-z]{{4}}') AS english
FROM (SELECT *, left(plain, 20) AS said FROM b)""")
def card_fields(t):
    card = F.concat(F.lit("# t\n- **一句话**：x\n"), F.when(F.length("plain") % 3 == 0, F.concat(F.lit("- **溯源**： src "), F.col("source"), F.lit(" \n"))).otherwise(""))
    said = F.concat(F.substring("plain", 1, 20), F.when(F.col("source") == "src1", "模型").otherwise(""))
    return base(t("documents")).select(F.col("id").alias("doc_id"), text.card_field(F.coalesce(card, F.lit("")), "溯源").alias("origin"), text.is_mostly_english(said).alias("english"))
