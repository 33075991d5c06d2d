"""Gates: each adds a reject reason (null where the row passes); rows are split or counted by it afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text, times, urls


def first_reason(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that holds, else null."""
    out = None
    for name, test in rules:
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def split(df: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Rows that passed, and rows that were rejected."""
    return df.where(F.col(reason).isNull()), df.where(F.col(reason).isNotNull())


def raw_record_reason(title: Column, url: Column) -> Column:
    t, u = text.fingerprint_title(title), F.trim(F.coalesce(url, F.lit("")))
    return first_reason(
        ("no title", t == ""), ("no url", u == ""), ("url scheme", ~u.rlike("(?i)^https?://")), ("url length", ~F.length(u).between(10, 1024)),
        ("title short", F.length(t) < 4), ("title long", F.length(t) > 200),
    )


def news_reason(title: Column, summary: Column, source: Column) -> Column:
    """Title 5 to 200, summary 10 to 1000, a real source, no advertising title; the first failing rule counts."""
    t, s, o = (F.trim(F.coalesce(c, F.lit(""))) for c in (title, summary, source))
    return first_reason(
        ("no title", t == ""), ("no summary", s == ""), ("no source", o == ""), ("title short", F.length(t) < 5), ("title long", F.length(t) > 200),
        ("summary short", F.length(s) < 10), ("summary long", F.length(s) > 1000), ("source short", F.length(o) < 2), ("source invalid", o.rlike(fixed.INVALID_SOURCES)),
        ("advert", text.any_of(fixed.ADVERT_TITLES, F.lower(t))),
    )


def intel_record_reason(title: Column, url: Column) -> Column:
    """Why a candidate is no record: no title, no URL, another scheme, a title of under 4 or over 300 characters."""
    t, u = text.fingerprint_title(title), text.trimmed(F.coalesce(url, F.lit("")))
    return first_reason(("no title", t == ""), ("no url", u == ""), ("url scheme", ~u.rlike("(?i)^https?://")), ("title short", F.length(t) < 4), ("title long", F.length(t) > 300))


def source_url_reason(url: Column, source: Column) -> Column:
    """Why a source URL is blanked (the row stays): none, scheme, a placeholder, a host that is not the named source's, an odd host."""
    u = text.trimmed(F.coalesce(url, F.lit("")))
    h = urls.host(u)
    strange = F.lit(False)
    for name, domains in fixed.EXPECTED_DOMAINS.items():
        own = F.lit(False)
        for d in domains:
            own = own | (h == d) | h.endswith("." + d)
        strange = F.when(source == name, ~own).otherwise(strange)
    placeholder = F.lit(False)
    for p in fixed.PLACEHOLDER_URLS:
        placeholder = placeholder | u.rlike(p)
    return first_reason(("empty", u == ""), ("scheme", ~u.rlike("(?i)^https?://")), ("placeholder", placeholder), ("parse", h == ""), ("source mismatch", strange), ("host", ~h.contains(".") | (F.length(h) < 6)))


def category_allowed(category: Column, extra: Column | None = None) -> Column:
    """Whether the category or an alias of it is allowed, or among the feed's own extras."""
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    names = sorted({a for aliases in fixed.CATEGORY_ALIASES.values() for a in aliases})
    ok = plain(category).isin(*names)
    return ok if extra is None else ok | F.coalesce(F.exists(extra, lambda x: plain(x) == plain(category)), F.lit(False))


def title_block_reason(title: Column, extra: list[str] | None = None) -> Column:
    plain = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", ""))
    word = text.first_of([w.lower() for w in fixed.BLOCKED_TITLES + (extra or [])], plain)
    return F.when(plain == "", "empty title").when(word.isNotNull(), F.concat(F.lit("word "), word))


def holds_required(title: Column, words: list[str]) -> Column:
    """Whether one of the required words is there; no words require nothing."""
    return text.any_of([w.lower() for w in words], F.lower(title)) if words else F.lit(True)


def is_pure_topic(title: Column, words: list[str]) -> Column:
    """Whether every part of the title between semicolons is about the topic."""
    parts = F.filter(F.split(F.lower(title), "[；;]", -1), lambda x: F.length(F.trim(x)) > 0)
    return (F.size(parts) > 0) & F.forall(parts, lambda x: text.any_of([w.lower() for w in words], x))


def categories_blocked(categories: Column, words: list[str]) -> Column:
    return F.exists(categories, lambda c: text.any_of([w.lower() for w in words], F.lower(c)))


def freshness_reason(published: Column, fetched: Column, url_date: Column, as_of: Column) -> Column:
    """URL date over 48 h old; else the time published, for date-only values the time fetched, within -1 h and 48 h."""
    from_url = F.unix_date(url_date) * times.DAY
    date_only = F.pmod(published, F.lit(times.DAY)) == 0
    at = F.coalesce(F.when(date_only & fetched.isNotNull(), fetched).otherwise(published), fetched)
    age = as_of - at
    return first_reason(("url date", as_of - from_url > 48 * times.HOUR), ("no time", at.isNull()), ("future", age < -times.HOUR), ("stale", age > 48 * times.HOUR))


def within_days(published: Column, fetched: Column, days: Column, as_of: Column) -> Column:
    """Published, else fetched, within so many days before as_of; no time or a later one fails."""
    age = as_of - F.coalesce(published, fetched)
    return F.coalesce((age >= 0) & (age <= days * times.DAY), F.lit(False))


def passes_freshness(published: Column, days: Column, as_of: Column) -> Column:
    """As within_days with 7 days unless the row says otherwise; a missing date passes."""
    return F.coalesce(as_of - published <= F.coalesce(days, F.lit(fixed.FRESH_DAYS)) * times.DAY, F.lit(True))


def in_poll_window(published: Column, cursor: Column, as_of: Column) -> Column:
    """Strictly after the cursor and not later than as_of."""
    return (published > cursor) & (published <= as_of)


def qualify_reasons(title: Column, content: Column, summary: Column, published: Column, fetched: Column, days: Column, as_of: Column, min_content: Column | int = fixed.MIN_CONTENT, lenient: bool = False) -> Column:
    """All reasons against an intel item, an empty array if there are none.

    min_content may go by row; days of 0 or less leave age out, null ones are the default.  A lenient gate, for summaries and
    archives, looks at neither length nor age.
    """
    t, c, s = (text.clean_intel(x) for x in (title, content, summary))
    least = F.coalesce(min_content, F.lit(fixed.MIN_CONTENT)) if isinstance(min_content, Column) else F.lit(min_content)
    strict, span = F.lit(not lenient), F.coalesce(days, F.lit(fixed.FRESH_DAYS))
    return F.array_compact(
        F.array(
            F.when(strict & (text.meaningful_length(c, t) < least), "short"),
            F.when(strict & (span > 0) & ~within_days(published, fetched, span, as_of), "stale"),
            F.when((t == "") & (c == "") & (s == ""), "empty"),
            F.when(t.rlike("[；;]"), "several").when(t.rlike(fixed.ROUNDUP) & (F.length(t) >= 15), "roundup"),
        )
    )


def compliance(title: Column, summary: Column, content: Column, url_date: Column, as_of: Column) -> tuple[Column, Column]:
    """Hard reason (a URL date over 48 h old, or a word of the list) and soft signal, each null where there is none."""
    hay = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, summary, content)])
    old = as_of - F.unix_date(url_date) * times.DAY > 48 * times.HOUR
    word = text.first_of(fixed.SENSITIVE_WORDS, hay)
    hard = F.when(old, "url date").when(word.isNotNull(), F.concat(F.lit("word "), word))
    soft = text.first_of(fixed.SOFT_SIGNALS, hay)
    for p in fixed.SOFT_PATTERNS:
        soft = F.coalesce(soft, F.when(hay.rlike(p), "pattern"))
    return hard, F.when(hard.isNull(), soft)


def due_sources(sources: DataFrame, as_of: Column) -> DataFrame:
    """Sources to poll now: enabled and never fetched or the interval (an hour unless stated) over.

    A disabled one is tried again a day after it was disabled, or last fetched where that is not known, and at once if neither is.
    """
    interval = F.coalesce(F.nullif(F.col("poll_seconds").cast("long"), F.lit(0).cast("long")), F.lit(times.HOUR).cast("long"))
    elapsed = F.coalesce(as_of - F.col("last_fetch") >= interval, F.lit(True))
    rested = F.coalesce(as_of - F.coalesce("disabled_at", "last_fetch") >= times.DAY, F.lit(True))
    off = F.coalesce(F.col("status") == "disabled", F.lit(False))
    return sources.where(F.coalesce(F.col("enabled"), F.lit(False)) & F.when(off, rested).otherwise(elapsed))


def invalid_description(desc: Column, title: Column, source: Column) -> Column:
    """Whether a description says nothing: empty, the title or the source's name, under 20 characters, or dates and punctuation but for 4."""
    d = F.coalesce(desc, F.lit(""))
    bare = F.regexp_replace(d, fixed.DATE_CHARACTERS, "")
    return (d == "") | F.coalesce(d == title, F.lit(False)) | (F.length(d) < 20) | (F.length(bare) < 5) | F.coalesce(d == source, F.lit(False))
