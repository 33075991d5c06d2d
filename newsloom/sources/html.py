"""Lists and paragraphs of web pages by patterns, as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed, text

PARAGRAPH = "(?is)<p(?:\\s[^>]*)?>(.*?)</p>"
ANCHOR = "(?is)<a\\s[^>]*href=\"([^\"]+)\"[^>]*>(.*?)</a>"


def plain(markup: Column) -> Column:
    """Text of a stretch of markup on one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]*>", ""), r"\s+", " "))


def paragraphs(html: Column, shortest: int = 15) -> Column:
    """Paragraphs of at least that many characters."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(PARAGRAPH), F.lit(1)), plain), lambda x: F.length(x) >= shortest)


def _paragraphs_of(markup: Column, shortest: int) -> Column:
    """Texts of <p> elements with spaces for tags, in order; short ones are left out."""

    def said(x: Column) -> Column:
        out = F.regexp_replace(x, "<[^>]+>", " ")
        for name, char in fixed.PARAGRAPH_ENTITIES:
            out = F.replace(out, F.lit(name), F.lit(char))
        return text.trimmed(F.regexp_replace(F.regexp_replace(out, r"&#\d+;", " "), r"\s+", " "))

    return F.filter(F.transform(F.regexp_extract_all(markup, F.lit("(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), said), lambda x: F.length(x) >= shortest)


def article(html: Column, shortest: int = 15) -> Column:
    """Text of a page's article, a line a paragraph; null if it has none.

    Scripts, menus and the like go first.  The article is the first container of the list that is there, cut where related
    items begin if that is after its first 100 characters; with under two paragraphs the whole page counts.
    """
    cleaned = F.coalesce(html, F.lit(""))
    for block in fixed.PAGE_BLOCKS:
        cleaned = F.regexp_replace(cleaned, block, " ")

    def held(page: Column) -> Column:
        return F.coalesce(*[text.let(F.regexp_extract(page, c, 1), lambda x: F.when(x != "", x)) for c in fixed.ARTICLE_CONTAINERS], F.lit(""))

    def cut(body: Column, patterns: list[str] = fixed.ARTICLE_CUTS) -> Column:
        # The first pattern is sought first, the next one only where it is not found.
        if not patterns:
            return body
        head = lambda at: F.when(at > 101, text.trimmed(F.substring(body, F.lit(1), at - 1))).otherwise(cut(body, patterns[1:]))
        return text.let(F.regexp_instr(body, F.lit(patterns[0])), head)

    def body(page: Column) -> Column:
        every = lambda inside: F.when(F.size(inside) >= 2, inside).otherwise(_paragraphs_of(page, shortest))
        return text.let(text.let(_paragraphs_of(text.let(held(page), lambda b: cut(b)), shortest), every), lambda found: F.when(F.size(found) > 0, F.array_join(found, "\n")))

    return text.let(cleaned, body)


def links(html: Column, most: int = 30) -> Column:
    """array<struct<href, title>> of the first distinct links with a text, at most 30 a page as list scrapes take."""
    hrefs, titles = (F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(k)) for k in (1, 2))
    both = F.filter(F.arrays_zip(hrefs.alias("href"), F.transform(titles, plain).alias("title")), lambda x: F.length(x["title"]) > 0)
    return _first_by(both, "href", most)


def _first_by(found: Column, field: str, most: int) -> Column:
    """The first ``most`` elements with different values of a field, in order: each value is sought once, not among all before it."""

    def kept(all_: Column) -> Column:
        values = F.transform(all_, lambda x: x[field])
        return F.transform(F.slice(F.array_distinct(values), 1, most), lambda v: F.element_at(all_, F.array_position(values, v).cast("int")))

    return text.let(found, kept)


DATED = r"(?i)<h2[^>]*>\s*Date:\s*(\d{4})-(\d{1,2})-(\d{1,2})"


def changelog_entries(html: Column, base: Column, most: int = 30) -> Column:
    """array<struct<title, url, date, content>> of a page of dated blocks: one entry a block, by its first heading, each address once.

    A page without a dated heading has none; a null page too.
    """
    page = F.coalesce(html, F.lit(""))
    blocks = F.filter(F.split(page, f"(?={DATED})", -1), lambda b: b.rlike(f"^{DATED}"))

    def entry(b: Column) -> Column:
        day = F.concat_ws("-", F.regexp_extract(b, DATED, 1), F.lpad(F.regexp_extract(b, DATED, 2), 2, "0"), F.lpad(F.regexp_extract(b, DATED, 3), 2, "0"))
        title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(b, r"(?is)<h3[^>]*>(.*?)</h3>", 1), "<[^>]+>", " "), "​", ""), r"\s+", " "))
        slug = lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), r"[^a-z0-9\x{4e00}-\x{9fa5}]+", "-"), "^-|-$", "")
        anchor = lambda t: text.let(slug(t), lambda s: F.when(s != "", s).otherwise(F.substring(F.sha2(t, 256), 1, 12)))
        content = F.substring(F.trim(F.regexp_replace(F.regexp_replace(b, "<[^>]+>", " "), r"\s+", " ")), 1, 500)
        return text.let(title, lambda t: F.struct(t.alias("title"), F.concat(base, F.lit("#"), anchor(t)).alias("url"), day.alias("date"), content.alias("content")))

    found = F.filter(F.transform(blocks, entry), lambda e: F.length(e["title"]) >= 4)
    return _first_by(found, "url", most)


HEADING_ANCHOR = r"(?is)<h([1-4])[^>]*>\s*<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>\s*</h\1>"


def _address(href: Column, base: Column) -> Column:
    """An address as it stands, or set on the host of the base."""
    host = F.regexp_extract(base, "^(https?://[^/?#]+)", 1)
    return F.when(href.rlike("(?i)^https?://"), href).otherwise(F.concat(host, F.when(href.startswith("/"), href).otherwise(F.concat(F.lit("/"), href))))


def _spaced(markup: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]+>", " "), r"\s+", " "))


def _headings(page: Column, base: Column) -> Column:
    hrefs, titles = (F.regexp_extract_all(page, F.lit(HEADING_ANCHOR), F.lit(k)) for k in (2, 3))
    none = F.lit("")
    both = F.zip_with(hrefs, titles, lambda h, x: F.struct(_address(F.trim(h), base).alias("url"), _spaced(x).alias("title"), none.alias("pub_date"), none.alias("desc")))
    return F.filter(both, lambda x: F.length(x["title"]) >= 4)


def heading_links(html: Column, base: Column, most: int = 30) -> Column:
    """array<struct<url, title>> of links that are headings, each address once; titles have four characters or more.

    A path is set on the base's host.  A null page has no links.
    """
    first = _first_by(_headings(F.coalesce(html, F.lit("")), base), "url", most)
    return F.transform(first, lambda x: F.struct(x["url"], x["title"]))


#: A link with a text of up to 300 characters and the 300 behind it; a link that holds a whole card.
PLAIN_ANCHOR = r"(?is)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>(.{2,300}?)</a>(?=(.{0,300}))"
CARD_ANCHOR = r"(?is)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>(.{0,6000}?)</a>"
NO_ADDRESS = r"^(#|javascript:|mailto:)"


def list_links(html: Column, base: Column, pattern: str, most: int = 30) -> Column:
    """array<struct<url, title, pub_date, desc>> of a list page whose addresses match a pattern: headings, then links with a text, then cards.

    Headings need a title of 4 characters, links one of 6 and take a date from the link or the 300 characters behind it; a card is
    a link around 60 characters or more with a heading in it, its date and first paragraph that says something.  Each
    address counts once, as it is found first.  A null page has none.
    """
    page, none = F.coalesce(html, F.lit("")), F.lit("")
    fits = lambda x: x.rlike(f"(?i){pattern}")
    pad = lambda x: F.lpad(x, 2, "0")
    part = lambda x, p, k: F.regexp_extract(x, p, k)

    def behind(x: Column) -> Column:
        first, last = r"(20\d{2})[-/](\d{1,2})[-/](\d{1,2})", r"(\d{1,2})[-/](\d{1,2})[-/](20\d{2})"
        day = lambda y, m, d: F.concat(y, F.lit("-"), pad(m), F.lit("-"), pad(d), F.lit("T00:00:00+08:00"))
        return F.when(x.rlike(first), day(*(part(x, first, k) for k in (1, 2, 3)))).when(x.rlike(last), day(part(x, last, 3), part(x, last, 1), part(x, last, 2))).otherwise("")

    whole, hrefs, said, rest = (F.regexp_extract_all(page, F.lit(PLAIN_ANCHOR), F.lit(k)) for k in range(4))
    plain_ones = F.transform(
        F.arrays_zip(whole.alias("w"), hrefs.alias("h"), said.alias("s"), rest.alias("r")),
        lambda x: F.struct(F.trim(x["h"]).alias("raw"), _address(F.trim(x["h"]), base).alias("url"), _spaced(x["s"]).alias("title"), behind(F.concat(x["w"], x["r"])).alias("pub_date"), none.alias("desc")),
    )
    plain_ones = F.filter(plain_ones, lambda x: ~x["raw"].rlike(NO_ADDRESS) & fits(x["raw"]) & (F.length(x["title"]) >= 6))

    def card(h: Column, inner: Column) -> Column:
        title = _spaced(part(inner, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1))
        dates = [r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{4})/(\d{1,2})/(\d{1,2})"]
        day = none
        for p in reversed(dates):
            day = F.when(inner.rlike(p), F.concat(part(inner, p, 1), F.lit("-"), pad(part(inner, p, 2)), F.lit("-"), pad(part(inner, p, 3)))).otherwise(day)
        says = lambda x: (F.length(x) > 10) & (x != title) & ~x.rlike(r"^(动态|新闻|公告|更新|资讯)?\s*\d{4}\s*[年/\-]")
        lines = F.filter(F.transform(F.regexp_extract_all(inner, F.lit(r"(?is)(<p[^>]*>.*?</p>)")), _spaced), says)
        desc = F.substring(F.coalesce(F.get(lines, F.lit(0)), none), 1, 300)
        return F.struct(F.trim(h).alias("raw"), _address(F.trim(h), base).alias("url"), title.alias("title"), day.alias("pub_date"), desc.alias("desc"), F.length(inner).alias("n"))

    cards_ = F.zip_with(*(F.regexp_extract_all(page, F.lit(CARD_ANCHOR), F.lit(k)) for k in (1, 2)), card)
    cards_ = F.filter(cards_, lambda x: ~x["raw"].rlike("^(#|javascript:)") & fits(x["url"]) & (x["n"] >= 60) & (F.length(x["title"]) >= 4))
    same = lambda found: F.transform(found, lambda x: F.struct(*[x[c].alias(c) for c in ("url", "title", "pub_date", "desc")]))
    every = F.concat(F.filter(same(_headings(page, base)), lambda x: fits(x["url"])), same(plain_ones), same(cards_))
    return _first_by(every, "url", most)


#: A card's title: a title attribute, or a heading, near its link.
CARD_TITLE = r"""(?i)<[^>]*title\s*=\s*["']([^"']+)["']|<h\d[^>]*>([\s\S]{4,200}?)</h\d>"""
CARDS = "array<struct<url: string, title: string, date: string>>"


def cards(html: Column, base: Column, link: Column, date: Column, most: int = 10) -> Column:
    """The first ``most`` cards of a list page by a site's rule: distinct addresses that match link, with title and date from the markup around.

    link captures an address, date a date; a title stands within 400 characters before the link or 200 behind it.  A path
    is set on the base's host, other relative addresses are left out.  Nulls give no cards.  Places of matches are beyond
    built-in functions, so this is one pass of Python over Arrow batches.
    """
    return F.pandas_udf(_cards, CARDS)(html, base, link, date, F.lit(most))


def _cards(html: pd.Series, base: pd.Series, link: pd.Series, date: pd.Series, most: pd.Series) -> pd.Series:
    title = re.compile(CARD_TITLE)

    def page(markup: str | None, base: str | None, link: str | None, date: str | None, most: int) -> list[dict]:
        found: dict[str, dict] = {}
        if not markup or not link:
            return []
        host = re.match(r"(?i)https?://[^/?#]+", base or "")
        for m in re.finditer(link, markup):
            url = (host[0] if host else "") + m[1] if m[1].startswith("/") else m[1]
            if url in found or not re.match(r"(?i)https?://", url):
                continue
            around = markup[max(0, m.start() - 400) : m.end() + 200]
            head, day = title.search(around), re.search(date, around) if date else None
            plain = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", head[1] or head[2] or "")).strip() if head else ""
            found[url] = {"url": url, "title": plain, "date": day[1] if day else ""}
            if len(found) == most:
                break
        return list(found.values())

    return pd.Series([page(*row) for row in zip(html, base, link, date, most, strict=True)], index=html.index)
