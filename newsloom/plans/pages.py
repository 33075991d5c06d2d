"""Queries over web pages and their addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, urls
from ..operators import tables
from ..sources import html
from .registry import query
from .rules import TRIM

NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(url, '')), '(?i)^(https?://)?', ''), '/+$', ''), '(?i)([?&])(utm_[a-z]+|spm|from|from_|source|ref)=[^&]*(&|$)', '\1', 'g'), '[?&]+$', '')"""
HOST = r"lower(regexp_replace(regexp_extract(coalesce(url, ''), '(?i)^https?://([^/?#:]+)', 1), '(?i)^www\.', ''))"
PLAIN = lambda x: rf"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"


@query(f"WITH n AS (SELECT page_id, {NORMAL} AS normal FROM pages) SELECT normal, min(page_id) AS page_id, sha256(normal) AS fingerprint FROM n GROUP BY normal")
def url_normalize_dedup(t):
    d = t("pages").select("page_id", urls.normalize_url(F.col("url")).alias("normal"), urls.url_fingerprint(F.col("url")).alias("fingerprint"))
    return tables.first_per_key(d, ["normal"], [F.col("page_id")])


@query(f"SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def url_host_stats(t):
    return t("pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(r"""WITH d AS (SELECT page_id, regexp_extract(url, '/((?:19|20)\d{2})[/-](0?[1-9]|1[0-2])[/-](0?[1-9]|[12]\d|3[01])(?:/|$|[.?#])', ['y', 'm', 'd']) AS p,
  regexp_extract(url, '/((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?:/|$|[.?#])', ['y', 'm', 'd']) AS q FROM pages)
SELECT page_id, strftime(try_cast(coalesce(nullif(q.y, ''), p.y) || '-' || lpad(coalesce(nullif(q.m, ''), p.m), 2, '0') || '-' || lpad(coalesce(nullif(q.d, ''), p.d), 2, '0') AS DATE), '%Y-%m-%d') AS day FROM d""")
def url_date_extract(t):
    return t("pages").select("page_id", F.date_format(urls.url_date(F.col("url")), "yyyy-MM-dd").alias("day"))


@query(rf"""WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(coalesce(html, ''), '{html.PARAGRAPH}', 1), lambda x: {PLAIN("x")}), lambda x: length(x) >= 15) AS found FROM pages)
SELECT page_id, len(found) AS n, CAST(coalesce(list_sum(list_transform(found, lambda x: length(x))), 0) AS BIGINT) AS chars FROM p""")
def html_paragraph_extract(t):
    d = t("pages").select("page_id", html.paragraphs(F.coalesce("html", F.lit(""))).alias("found"))
    return d.select("page_id", F.size("found").cast("long").alias("n"), F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query(rf"""WITH a AS (SELECT page_id, list_zip(regexp_extract_all(coalesce(html, ''), '{html.ANCHOR}', 1), list_transform(regexp_extract_all(coalesce(html, ''), '{html.ANCHOR}', 2), lambda x: {PLAIN("x")})) AS found FROM pages),
l AS (SELECT page_id, f, unnest(range(1, len(f) + 1)) AS i FROM (SELECT page_id, list_filter(found, lambda x: length(x[2]) > 0) AS f FROM a)),
d AS (SELECT page_id, f[i][1] AS href, f[i][2] AS title, i FROM l QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY i) = 1)
SELECT page_id, href, title FROM d QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) <= 30""")
def html_link_list(t):
    return t("pages").select("page_id", F.inline(html.links(F.coalesce("html", F.lit("")))))


_quoted = lambda s: s.replace("'", "''")
_CLEANED = "coalesce(html, '')"
for _block in fixed.PAGE_BLOCKS:
    _CLEANED = f"regexp_replace({_CLEANED}, '{_quoted(_block)}', ' ', 'g')"
_HELD = ", ".join(f"nullif(regexp_extract(page, '{_quoted(c)}', 1), '')" for c in fixed.ARTICLE_CONTAINERS)
_AT = lambda p: f"strpos(held, regexp_extract(held, '{_quoted(p)}'))"
_CUT = "CASE " + " ".join(f"WHEN regexp_matches(held, '{_quoted(p)}') AND {_AT(p)} > 101 THEN {TRIM.format(f'left(held, {_AT(p)} - 1)')}" for p in fixed.ARTICLE_CUTS) + " ELSE held END"
_SAID = "regexp_replace(x, '<[^>]+>', ' ', 'g')"
for _name, _char in fixed.PARAGRAPH_ENTITIES:
    _SAID = f"replace({_SAID}, '{_name}', '{_char}')"
_SAID = TRIM.format(f"regexp_replace(regexp_replace({_SAID}, '&#\\d+;', ' ', 'g'), '\\s+', ' ', 'g')")
_INSIDE = lambda x: f"list_filter(list_transform(regexp_extract_all({x}, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: {_SAID}), lambda x: length(x) >= 15)"
#: Where related items begin, for the pages that have none.
_RELATED = "replace(html, '<footer', '<div class=\"related\"><p>Something else that is long enough</p></div><footer')"


@query(f"""WITH s AS (SELECT page_id, CASE WHEN length(html) % 4 = 0 THEN replace({_RELATED}, 'article>', 'section>') WHEN length(html) % 4 = 1 THEN replace(html, '</article>', '<h2>相关推荐</h2><p>Something else that is long enough</p></article>') ELSE html END AS html FROM pages),
c AS (SELECT page_id, {_CLEANED} AS page FROM s), h AS (SELECT *, coalesce({_HELD}, '') AS held FROM c), k AS (SELECT *, {_INSIDE(_CUT)} AS inside, {_INSIDE("page")} AS every FROM h)
SELECT page_id, CASE WHEN len(inside) >= 2 THEN array_to_string(inside, chr(10)) WHEN len(every) > 0 THEN array_to_string(every, chr(10)) END AS body FROM k""")
def html_article_body(t):
    """Pages as they are, and with related items inside their article, or without an article."""
    size = F.length("html")
    outside = F.replace(F.replace("html", F.lit("<footer"), F.lit('<div class="related"><p>Something else that is long enough</p></div><footer')), F.lit("article>"), F.lit("section>"))
    inside = F.replace("html", F.lit("</article>"), F.lit("<h2>相关推荐</h2><p>Something else that is long enough</p></article>"))
    return t("pages").select("page_id", html.article(F.when(size % 4 == 0, outside).when(size % 4 == 1, inside).otherwise(F.col("html"))).alias("body"))


_LI = '<li><a href="([^"]+)">([^<]*)</a></li>'


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS host, regexp_extract_all(html, '{_LI}', 1) AS hrefs, regexp_extract_all(html, '{_LI}', 2) AS names FROM pages),
i AS (SELECT page_id, host, unnest(range(1, len(hrefs) + 1)) AS i, hrefs, names FROM p), k AS (SELECT page_id, i, hrefs[i] AS href, host || CASE WHEN starts_with(hrefs[i], '/') THEN hrefs[i] ELSE '/' || hrefs[i] END AS url, trim(regexp_replace(names[i], '\\s+', ' ', 'g')) AS title FROM i),
a AS (SELECT page_id, 1 AS pass, i, url, title, '' AS pub_date, '' AS "desc" FROM k WHERE i % 3 = 1 AND length(title) >= 4 AND regexp_matches(url, '(?i)/[a-t]')
  UNION ALL SELECT page_id, 2, i, url, title, '2024-0' || i % 9 || '-03T00:00:00+08:00', '' FROM k WHERE i % 3 = 2 AND i % 9 > 0 AND length(title) >= 6 AND regexp_matches(href, '(?i)/[a-t]')
  UNION ALL SELECT page_id, 3, i, url, title, '2023-11-02', CASE WHEN 'About ' || title || ' and more' <> title THEN left('About ' || title || ' and more', 300) END FROM k WHERE i % 3 = 0 AND length(title) >= 4 AND regexp_matches(url, '(?i)/[a-t]')),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pass, i) = 1)
SELECT page_id, url, title, pub_date, "desc" FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pass, i) <= 30""")
def list_links_parsed(t):
    """The pages' menus, their entries set in turn as headings, as links with a date behind, and as cards."""
    menu = F.arrays_zip(F.regexp_extract_all("html", F.lit(_LI), F.lit(1)).alias("h"), F.regexp_extract_all("html", F.lit(_LI), F.lit(2)).alias("t"))
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def entry(x, i):
        n = i + 1
        card = join('<a href="', x["h"], '" class="card"><h3>', x["t"], "</h3><p>动态 2023 年 11 月 2 日</p><p>About ", x["t"], " and more</p><p>", F.repeat(F.lit("x"), 300), "</p></a>")
        # A date of its own behind each link, far enough from the next one.
        dated = join('<a class=x href="', x["h"], '">', x["t"], "</a> 2024/", (n % 9).cast("string"), "/3", F.repeat(F.lit(" ."), 160))
        return F.when(n % 3 == 1, join("<h2><a class=k href='", x["h"], "'>", x["t"], "</a></h2>")).when(n % 3 == 2, F.when(n % 9 > 0, dated).otherwise("")).otherwise(card)

    page = F.array_join(F.transform(menu, entry), "\n")
    return t("pages").select("page_id", F.inline(html.list_links(page, F.regexp_extract("url", "^https?://[^/?#]+", 0), "/[a-t]")))
