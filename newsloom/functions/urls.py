"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_url(url: Column) -> Column:
    """Without scheme, slashes at the end and tracking parameters; empty for null."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"(?i)^(https?://)?", "")
    u = F.regexp_replace(u, r"/+$", "")
    u = F.regexp_replace(u, r"(?i)([?&])(utm_[a-z]+|spm|from|from_|source|ref)=[^&]*(&|$)", "$1")
    return F.regexp_replace(u, r"[?&]+$", "")


def url_fingerprint(url: Column) -> Column:
    return F.sha2(normalize_url(url), 256)


def url_key(url: Column) -> Column:
    """Without scheme, query and fragment; null for an empty URL, which is no key."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?i)^https?://", ""), r"[?#].*$", "")), F.lit(""))


def host(url: Column) -> Column:
    """Lower-case host without www."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^https?://([^/?#:]+)", 1), r"(?i)^www\.", ""))


def host_matches(url: Column, domain: str) -> Column:
    h = host(url)
    return (h == domain) | h.endswith("." + domain)


def url_date(url: Column) -> Column:
    """Date in the path: /YYYYMMDD/, /Y/M/D/ or /Y-M-D/; null for none or an impossible one."""
    u = F.coalesce(url, F.lit(""))
    tight = r"/((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?:/|$|[.?#])"
    loose = r"/((?:19|20)\d{2})[/-](0?[1-9]|1[0-2])[/-](0?[1-9]|[12]\d|3[01])(?:/|$|[.?#])"
    part = lambda p, k: F.nullif(F.regexp_extract(u, p, k), F.lit("")).cast("int")
    found = [F.coalesce(part(tight, k), part(loose, k)) for k in (1, 2, 3)]
    text = F.format_string("%04d-%02d-%02d", *found)
    return F.when(found[0].isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def guid(source: Column, url: Column) -> Column:
    return F.concat(F.lit("intel_"), source, F.lit("_"), F.sha2(url, 256))


def aggregator_key(item_id: Column) -> Column:
    return F.nullif(F.regexp_extract(item_id, "^juhe_[^_]*_(.+)$", 1), F.lit(""))
