"""Feeds and answers as columns: RSS and Atom, JSON interfaces, aggregators, lists in a model's answer.

Every reader takes a text column and gives an array of structs, empty where the
text is null, broken or of another kind, so it runs on any table of fetched
bodies and never fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed, text, urls

RSS = "channel struct<title: string, item: array<struct<title: string, link: string, pubDate: string, `dc:date`: string, date: string, category: array<string>, description: string, summary: string, `content:encoded`: string, guid: string>>>"
ATOM = "title string, entry array<struct<id: string, title: string, link: array<struct<_href: string, _rel: string>>, published: string, updated: string, category: array<struct<_term: string, _VALUE: string>>, summary: string, content: string>>"
ITEM = "array<struct<title: string, url: string, pub_date: string, category: string, categories: array<string>, guid: string, desc: string, content: string>>"


def _said(value: Column) -> Column:
    """Trimmed text; empty for null."""
    return text.trimmed(F.coalesce(value, F.lit("")))


def _first(*values: Column) -> Column:
    """The first value that is not empty, else empty."""
    return F.coalesce(*[text.let(_said(v), lambda x: F.when(x != "", x)) for v in values], F.lit(""))


def feed_summary(value: Column, limit: int = 300) -> Column:
    """Text without tags, one space for white space, at most limit characters."""
    plain = F.regexp_replace(F.regexp_replace(value, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"<[^>]+>", " ")
    return F.substring(text.trimmed(F.regexp_replace(plain, r"\s+", " ")), 1, limit)


def feed_content(value: Column, limit: int = 5000) -> Column:
    """Text with a line for each block, without scripts, styles and tags."""
    out = value
    for pattern, by in (
        (r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), (r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"(?i)<br\s*/?>|</p>|</div>", "\n"), (r"<[^>]+>", ""),
    ):
        out = F.regexp_replace(out, pattern, by)
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.substring(text.trimmed(F.regexp_replace(out, r"\n{3,}", "\n\n")), 1, limit)


def feed_items(xml: Column, need_content: bool = False) -> Column:
    """Items of an RSS or Atom document that have a title and a URL; need_content puts the description where content is missing."""

    def rss(it: Column) -> Column:
        body = _first(it["content:encoded"], it["description"], it["summary"])
        url = _said(it["link"])
        return F.struct(
            _said(it["title"]).alias("title"), url.alias("url"), _first(it["pubDate"], it["dc:date"], it["date"]).alias("pub_date"), _said(F.get(it["category"], F.lit(0))).alias("category"),
            F.coalesce(it["category"], F.array().cast("array<string>")).alias("categories"), _first(it["guid"], url).alias("guid"),
            feed_summary(_first(it["description"], it["summary"], it["content:encoded"])).alias("desc"), feed_content(body).alias("content"),
        )

    def atom(it: Column) -> Column:
        plain = F.filter(it["link"], lambda k: (F.coalesce(k["_rel"], F.lit("")) == "") | (k["_rel"] == "alternate"))
        url = _first(F.get(plain, F.lit(0))["_href"], F.get(it["link"], F.lit(0))["_href"])
        names = F.transform(F.coalesce(it["category"], F.array().cast("array<struct<_term: string, _VALUE: string>>")), lambda c: _first(c["_term"], c["_VALUE"]))
        content, desc = feed_content(_said(it["content"])), feed_summary(_first(it["summary"], it["content"]))
        body = text.let(content, lambda c: F.when(c == "", desc).otherwise(c)) if need_content else content
        return F.struct(
            _said(it["title"]).alias("title"), url.alias("url"), _first(it["published"], it["updated"]).alias("pub_date"), _said(F.get(names, F.lit(0))).alias("category"), names.alias("categories"),
            _first(it["id"], url).alias("guid"), desc.alias("desc"), body.alias("content"),
        )

    is_atom = F.coalesce(xml, F.lit("")).rlike(r"<feed[\s>]")
    of_rss = F.transform(F.from_xml(F.when(~is_atom, xml), RSS, {"rowTag": "rss"})["channel"]["item"], rss).cast(ITEM)
    of_atom = F.transform(F.from_xml(F.when(is_atom, xml), ATOM, {"rowTag": "feed"})["entry"], atom).cast(ITEM)
    found = F.coalesce(of_rss, of_atom, F.array().cast(ITEM))
    return F.filter(found, lambda x: (x["title"] != "") & (x["url"] != ""))


def story_hits(json: Column) -> Column:
    """Items of a search interface: hits that have a title and a URL."""
    hits = F.from_json(json, "hits array<struct<title: string, url: string, created_at: string, objectID: string, story_text: string>>")["hits"]
    found = F.transform(
        hits,
        lambda h: F.struct(
            _said(h["title"]).alias("title"), _said(h["url"]).alias("url"), _said(h["created_at"]).alias("pub_date"), _first(h["objectID"], h["url"]).alias("guid"),
            _first(h["story_text"], h["title"]).alias("desc"), _said(h["story_text"]).alias("content"),
        ),
    )
    return F.coalesce(F.filter(found, lambda x: (x["title"] != "") & (x["url"] != "")), F.array())


ADAPTED = "array<struct<source: string, guid: string, title: string, url: string, published: string, raw: string, summary: string, meta: map<string, string>>>"


def story_search_items(json: Column, source: str = "stories") -> Column:
    """Items of a story search that have a title, a URL and an id, with points and comments as meta; texts up to 5,000 characters, summaries 300."""
    hits = F.from_json(json, "hits array<struct<title: string, url: string, created_at: string, objectID: string, story_text: string, points: string, num_comments: string>>")["hits"]
    kept = F.filter(hits, lambda h: (F.coalesce(h["title"], F.lit("")) != "") & (F.coalesce(h["url"], F.lit("")) != "") & (F.coalesce(h["objectID"], F.lit("")) != ""))
    said = lambda h: F.coalesce(h["story_text"], F.lit(""))
    found = F.transform(
        kept,
        lambda h: F.struct(
            F.lit(source).alias("source"), F.concat(F.lit(f"{source}:"), h["objectID"]).alias("guid"), h["title"].alias("title"), h["url"].alias("url"), h["created_at"].alias("published"),
            F.substring(F.when(said(h) == "", h["title"]).otherwise(said(h)), 1, 5000).alias("raw"), F.substring(F.regexp_replace(said(h), "<[^>]+>", " "), 1, 300).alias("summary"),
            F.create_map(F.lit("points"), F.coalesce(h["points"], F.lit("0")), F.lit("num_comments"), F.coalesce(h["num_comments"], F.lit("0"))).alias("meta"),
        ),
    )
    return F.coalesce(found.cast(ADAPTED), F.array().cast(ADAPTED))


def paper_items(xml: Column, source: str = "papers") -> Column:
    """Entries of a paper search's Atom that have a title and a link: the summary stands for the text, the first author is meta."""
    blocks = F.split(F.coalesce(xml, F.lit("")), "(?i)<entry>|<entry ", -1)

    def entry(b: Column) -> Column:
        of = lambda tag: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(b, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), "<[^>]+>", " "), r"\s+", " "))
        url, number = F.regexp_extract(b, r"(?i)<link[^>]*href\s*=\s*[\"']([^\"']+)[\"']", 1), F.regexp_extract(b, "(?i)<id>([^<]+)</id>", 1)
        made = lambda u, summary: F.struct(
            F.lit(source).alias("source"), F.concat(F.lit(f"{source}:"), F.coalesce(text.let(number, lambda x: F.when(x != "", x)), u)).alias("guid"), of("title").alias("title"), u.alias("url"), of("published").alias("published"),
            F.substring(summary, 1, 5000).alias("raw"), F.substring(summary, 1, 300).alias("summary"), F.create_map(F.lit("authors"), of("author")).alias("meta"),
        )
        return text.let(url, lambda u: text.let(of("summary"), lambda summary: made(u, summary)))

    found = F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), entry)
    return F.filter(found, lambda x: (x["title"] != "") & (x["url"] != "")).cast(ADAPTED)


def keyword_feed_items(xml: Column, source: str = "keywords") -> Column:
    """Items of a keyword search's feed; the guid is the hash of the address, which stays as it is."""
    return F.transform(
        feed_items(xml),
        lambda x: F.struct(
            F.lit(source).alias("source"), F.concat(F.lit(f"{source}:"), F.sha2(x["url"], 256)).alias("guid"), x["title"].alias("title"), x["url"].alias("url"), x["pub_date"].alias("published"), x["content"].alias("raw"), x["desc"].alias("summary"),
            F.create_map(F.lit("note"), F.lit("aggregated")).alias("meta"),
        ),
    ).cast(ADAPTED)


def company_items(json: Column, site: str) -> Column:
    """Items of a company's news interface: data that have a title; times are milliseconds, tags one category."""
    kind = "data array<struct<title: string, summary: string, publishDate: string, slug: string, newsId: string, tags: array<string>>>"
    when = lambda d: F.when(d["publishDate"].try_cast("double") > 0, F.date_format(F.timestamp_millis(d["publishDate"].try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    found = F.transform(
        F.from_json(json, kind)["data"],
        lambda d: F.struct(
            _said(d["title"]).alias("title"), F.concat_ws("/", F.lit(site), F.nullif(_said(d["slug"]), F.lit(""))).alias("url"), F.coalesce(when(d), F.lit("")).alias("pub_date"),
            F.concat(F.lit("data:"), _first(d["newsId"], d["slug"], d["title"])).alias("guid"), _first(d["summary"], d["title"]).alias("desc"), _first(d["summary"], d["title"]).alias("content"),
            _said(F.array_join(d["tags"], ",")).alias("category"),
        ),
    )
    return F.coalesce(F.filter(found, lambda x: x["title"] != ""), F.array())


def research_items(json: Column, site: str) -> Column:
    """Items of a research interface: docs that have a title in either language; body is the rich-text tree for trees.tree_texts()."""
    kind = "docs array<struct<id: string, title_zh: string, title_en: string, createAt: string, resume_zh: string, category: string, content_zh: variant>>"
    found = F.transform(
        F.from_json(json, kind)["docs"],
        lambda d: F.struct(
            _first(d["title_zh"], d["title_en"]).alias("title"), F.concat(F.lit(f"{site}/"), d["id"]).alias("url"), _said(d["createAt"]).alias("pub_date"), F.concat(F.lit("docs:"), d["id"]).alias("guid"),
            _first(d["resume_zh"], d["title_zh"], d["title_en"]).alias("desc"), _said(d["resume_zh"]).alias("short"), _said(d["category"]).alias("category"), F.to_json(d["content_zh"]).alias("body"),
        ),
    )
    return F.coalesce(F.filter(found, lambda x: x["title"] != ""), F.array())


def account_items(json: Column) -> Column:
    """Items of a local message account's answer, a list or {items: []}: those with a title or an address; broken answers give none."""
    names = ("title", "url", "link", "app_msg_url", "published_at", "publish_time", "guid", "summary", "digest", "content", "author")
    row = "array<struct<" + ", ".join(f"{n}: string" for n in names) + ">>"
    rows = F.when(F.trim(json).startswith("["), F.from_json(json, row)).otherwise(F.from_json(json, f"items {row}")["items"])
    kept = F.filter(rows, lambda r: (_said(r["title"]) != "") | (_said(r["url"]) != "") | (_said(r["link"]) != ""))
    found = F.transform(
        kept,
        lambda r: F.struct(
            F.coalesce(F.nullif(_said(r["title"]), F.lit("")), F.lit("(无标题)")).alias("title"), _first(r["url"], r["link"], r["app_msg_url"]).alias("url"), _first(r["published_at"], r["publish_time"]).alias("pub_date"),
            _first(r["guid"], F.concat(F.lit("wechat:"), F.sha2(_first(r["url"], r["link"], F.concat(_said(r["title"]), _said(r["published_at"]))), 256))).alias("guid"),
            _first(r["summary"], r["digest"], r["content"], r["title"]).alias("desc"), _first(r["content"], r["digest"]).alias("content"), _said(r["author"]).alias("category"),
        ),
    )
    return F.coalesce(found, F.array())


def _aggregated(rows: Column, prefix: str, category: Column, out_category: Column, fields: dict[str, list[str]]) -> Column:
    pick = lambda r, name: _first(*[r[c] for c in fields[name]])
    return F.coalesce(
        F.transform(
            rows,
            lambda r: F.struct(
                F.concat(F.lit(f"{prefix}_"), category, F.lit("_"), pick(r, "id")).alias("id"), text.clean_title(r["title"]).alias("title"), text.clean_summary(pick(r, "summary"), 150).alias("summary"),
                out_category.alias("category"), _first(*[r[c] for c in fields["source"]], F.lit(fixed.AGGREGATOR_NAMES[prefix])).alias("source"), _said(r["url"]).alias("source_url"), pick(r, "time").alias("publish_time"),
            ),
        ),
        F.array(),
    )


def juhe_items(json: Column, category: Column) -> Column:
    """Items of an answer with error_code 0 (a number or a string)."""
    names = ("uniquekey", "id", "title", "description", "author_name", "src", "url", "date")
    said = F.from_json(json, "error_code string, result struct<data: array<struct<" + ", ".join(f"{n}: string" for n in names) + ">>>")
    rows = text.let(said, lambda s: F.when(s["error_code"].try_cast("double") == 0, s["result"]["data"]))
    return _aggregated(rows, "juhe", category, category, {"id": ["uniquekey", "id"], "summary": ["description", "title"], "source": ["author_name", "src"], "time": ["date"]})


def tian_items(json: Column, category: Column) -> Column:
    """Items of an answer with code 200; science goes to recommend."""
    row = "array<struct<" + ", ".join(f"{n}: string" for n in ("uniq_id", "id", "title", "description", "ctime", "source", "src", "url", "pub_time")) + ">>"
    said = F.from_json(json, f"code string, result struct<newslist: {row}, list: {row}>")
    rows = text.let(said, lambda s: F.when(s["code"].try_cast("double") == 200, F.coalesce(s["result"]["newslist"], s["result"]["list"])))
    tab = F.when(category == "science", "recommend").otherwise(category)
    return _aggregated(rows, "tian", category, tab, {"id": ["uniq_id", "id"], "summary": ["description", "ctime"], "source": ["source", "src"], "time": ["pub_time", "ctime"]})


def answer_items(answer: Column, schema: str) -> Column:
    """The list in a model's answer: the text itself, a fenced block, or the first stretch that looks like a list of objects."""
    read = lambda t: F.when(F.trim(t).startswith("["), F.from_json(t, f"array<{schema}>"))
    usable = lambda t: text.let(text.let(t, read), lambda x: F.when(F.size(x) > 0, x))

    def tried(a: Column) -> Column:
        return F.coalesce(*[usable(t) for t in (a, F.regexp_extract(a, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(a, r"(?s)(\[\s*\{.*\}\s*\])", 1))])

    return F.coalesce(text.let(answer, tried), F.array().cast(f"array<{schema}>"))


def source_of(name: Column, url: Column) -> Column:
    """The source's name, else that of the URL's domain, else the domain."""
    domain = F.regexp_replace(urls.host(url), r"^www\.", "")
    known = F.lit(None).cast("string")
    for d, n in fixed.SOURCE_DOMAINS.items():
        known = F.when((domain == d) | domain.endswith(f".{d}"), n).otherwise(known)
    return F.coalesce(F.nullif(_said(name), F.lit("")), known, domain)


# Projections to raw documents.


def is_science(category: Column) -> Column:
    c = F.lower(_said(category))
    return text.any_of(fixed.SCIENCE_PARTS, c) | c.isin(*fixed.SCIENCE_NAMES)


def feed_tab(category: Column) -> Column:
    """The tab of an official feed's category; life for unknown ones."""
    c, out = F.lower(_said(category)), F.lit("life")
    for tab, names in fixed.FEED_TABS.items():
        out = F.when(c.isin(*names), tab).otherwise(out)
    return F.when(is_science(category), "science").otherwise(out)


def official_document(item: Column, feed: Column) -> Column:
    """Raw document of an official feed's item (title, url, summary, category, pub_date) of a feed (id, name, category); content stays empty.

    Fingerprints are hashes of the normalised URL and of the title; the id is the URL's.
    """
    url_fp = urls.url_fingerprint(item["url"])
    return F.struct(
        F.concat(F.lit("official_"), url_fp).alias("id"), url_fp.alias("url_fp"), F.sha2(text.fingerprint_title(item["title"]), 256).alias("title_fp"), item["title"].alias("title"), item["url"].alias("url"),
        F.coalesce(item["summary"], F.lit("")).alias("summary"), F.lit("").alias("content"), F.lit("official_rss").alias("source_type"), F.coalesce(feed["id"], feed["name"]).alias("source_id"), F.coalesce(feed["name"], F.lit("")).alias("source"),
        feed_tab(_first(item["category"], feed["category"], F.lit("tech"))).alias("category"), item["pub_date"].alias("publish_time"),
    )


def aggregate_document(item: Column, source_type: str, category: Column) -> Column:
    """Raw document of an aggregator's item; null without an http address or with a title of under four characters.

    The id is the hash of the normalised URL, the same whatever source or category brings the item.
    """
    url, title = _said(item["source_url"]), text.fingerprint_title(item["title"])
    url_fp = urls.url_fingerprint(url)
    made = F.struct(
        url_fp.alias("id"), url_fp.alias("url_fp"), F.sha2(title, 256).alias("title_fp"), title.alias("title"), url.alias("url"), _first(item["summary"], item["title"]).alias("summary"), F.lit("").alias("content"), F.lit(source_type).alias("source_type"),
        F.concat(F.lit(f"{source_type}_"), category).alias("source_id"), _first(item["source"], F.lit(fixed.AGGREGATOR_NAMES[source_type])).alias("source"), category.alias("category"), item["publish_time"].alias("publish_time"),
    )
    return F.when(url.rlike("(?i)^https?://") & (F.length(title) >= 4), made)
