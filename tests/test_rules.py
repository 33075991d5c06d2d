"""Single rules at stated values."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text, times, urls
from newsloom.operators import gates, publish, scoring, tables
from newsloom.sources import feeds

DAY = 86400


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lits(*values):
    return [F.lit(v) for v in values]


@pytest.mark.parametrize(
    ("url", "source", "reason"),
    [
        ("", "s", "empty"), (None, None, "empty"), ("ftp://x.org/a", "s", "scheme"), ("https://fakenews.org/a", "新华社", "source mismatch"), ("https://www.news.cn/a", "新华社", None), ("https://a.xinhuanet.com/a1", "新华网", None),
        ("https://www.bbc.co.uk/a", "BBC", None), ("https://notbbc.com/a", "BBC", "source mismatch"), ("https://x-site.org/123456-a.html", "s", None), ("https://x-site.org/article/1234568.html", "s", None),
        ("https://x-site.org/article/1234567.html", "s", "placeholder"), ("https://36kr.com/p/12345678901", "36氪", "placeholder"), ("https://36kr.com/p/2811234567", "36氪", None), ("https://x-site.org/1234", "s", "placeholder"),
        ("https://your-domain.com/a", "s", "placeholder"), ("http://LOCALHOST/a", "s", "placeholder"), ("https://t.cn/a", "s", "host"), ("https://news/a", "s", "host"),
    ],
)
def test_source_urls(spark, url, source, reason):
    assert value(spark, gates.source_url_reason(*[F.lit(x).cast("string") for x in (url, source)])) == reason


def test_intel_records(spark):
    reason = lambda title, url: value(spark, gates.intel_record_reason(*[F.lit(x).cast("string") for x in (title, url)]))
    cases = [(None, "https://x.org"), ("abcd", " "), ("abcd", "x.org"), ("abc", "https://x.org"), ("x" * 301, "https://x.org"), ("x" * 300, "https://x.org"), ("【abcd】", "HTTPS://x.org")]
    assert [reason(*c) for c in cases] == ["no title", "no url", "url scheme", "title short", "title long", None, None]


def test_invalid_descriptions(spark):
    bad = lambda d, title="T", source="S": value(spark, gates.invalid_description(*[F.lit(x).cast("string") for x in (d, title, source)]))
    assert [bad(d) for d in (None, "", "abcdefghijklmno", "2026年8月10日 12:00:00 2026-08-10", "A sentence of more than twenty characters")] == [True, True, True, True, False]
    long = "A title of more than twenty characters"
    assert bad(long, title=long) and bad(long, source=long) and not bad(long, title=None, source=None)


def test_due_sources(spark):
    schema = "id int, enabled boolean, status string, poll_seconds int, last_fetch long, disabled_at long"
    rows = [
        (1, True, "active", 60, None, None), (2, True, "active", 60, 950, None), (3, True, "active", None, 1000 - 3599, None), (4, True, None, 0, 1000 - 3600, None), (5, False, "active", 1, None, None), (6, None, "active", 1, None, None),
        (7, True, "disabled", 60, None, None), (8, True, "disabled", 60, 1000 - DAY, None), (9, True, "disabled", 60, 1000 - DAY, 1000 - DAY + 1), (10, True, "disabled", 60, 999, 1000 - DAY),
    ]
    got = gates.due_sources(spark.createDataFrame(rows, schema), F.lit(1000))
    assert sorted(r.id for r in got.collect()) == [1, 4, 7, 8, 10]


def test_opinions(spark):
    split = lambda t: tuple(value(spark, text.split_opinion(F.lit(t).cast("string"))))
    assert split(None) == ("", "") and split("fact only") == ("fact only", "")
    assert split("fact ——\n【一页说】：—— view 【一页说】 more") == ("fact", "view 【一页说】 more")
    assert split("fact。一页说: view") == ("fact。", "view")


def test_labels(spark):
    now = 1704067200 + 10 * DAY + 3 * 3600  # 11:00 in Beijing
    label = lambda ago: value(spark, times.relative_label(F.lit(now - ago), F.lit(now)))
    assert [label(a) for a in (-5, 59, 60, 3599, 3600, DAY - 1, DAY, 3 * DAY - 1, 3 * DAY)] == ["刚刚", "刚刚", "1分钟前", "59分钟前", "1小时前", "23小时前", "1天前", "2天前", "1月8日"]
    browse = lambda ago: value(spark, times.browse_label(F.lit(now - ago), F.lit(now)))
    assert [browse(a) for a in (0, 11 * 3600, 12 * 3600, DAY, 36 * 3600, 7 * DAY, 8 * DAY)] == ["11:00", "00:00", "昨天", "昨天", "2天前", "7天前", ""]
    assert value(spark, times.absolute_label(F.lit(now))) == "1/11 11:00"
    assert value(spark, times.day_label(F.lit(now - DAY), F.lit(now))) == "01-10 11:00" and value(spark, times.day_label(F.lit(now), F.lit(now))) == "今天 11:00"
    none = F.lit(None).cast("long")
    assert [value(spark, x) for x in (times.relative_label(none, F.lit(now)), times.absolute_label(none), times.browse_label(none, F.lit(now)), times.day_label(none, F.lit(now)))] == [""] * 4
    assert [times.duration_seconds(x) for x in ("24h", "3d", "1w")] == [DAY, 3 * DAY, 7 * DAY]


def test_feed_scores(spark):
    score = lambda source, summary, hard=None: tuple(value(spark, scoring.feed_score(F.lit(source), F.lit(""), F.lit(summary).cast("string"), F.lit(0), F.lit(hard).cast("string"), F.lit(0))))
    long = "一" * 300 + "。二。"
    assert score("新华社", long) == (79, 20, 55, None)
    assert score("某报", None) == (35, 6, 23, "quality")
    assert score("新华社", long, "word") == (0, 20, 8, "compliance")
    assert [value(spark, scoring.feed_heat(F.lit(a))) for a in (100, 85, 80, 60, 40)] == [20, 15, 12, 8, 6]


def test_accepted_output(spark):
    accepted = lambda s, i, n: tuple(value(spark, scoring.accepted_output(F.lit(s), F.lit(i), F.lit(n))))
    assert accepted("s" * 30, "i" * 50, 180) == (True, False, True)
    assert accepted("s" * 60, "i" * 49, 180) == (True, True, False)
    assert accepted("s" * 29, "i" * 75, 302) == (False, False, False) and accepted("", "i" * 76, 302)[2]


def test_summaries_and_bodies(spark):
    of = lambda *a: tuple(value(spark, publish.summary_of(*[F.lit(x).cast("string") for x in a])))
    body = "2026年8月10日 12:00:00 10:00:00\n The first paragraph that says something \nmore"
    assert of("m" * 60, "d", body, "T", "S") == ("m" * 60, "ai")
    assert of("m" * 59, "A description that is long enough", body, "T", "S") == ("The first paragraph that says something", "content")
    assert of(None, "A description that is long enough", "short", "T", "S") == ("A description that is long enough", "desc")
    assert of(None, "2026-08-10", "only short\nlines here", "T", "S") == ("T", "title")
    assert of(None, " 2026-08-10 ", None, "T", "S") == ("2026-08-10", "title")
    made = lambda *a: tuple(value(spark, publish.body_of(*[F.lit(x).cast("string") for x in a[:-1]], F.lit(a[-1]))))
    assert made("read", "ai_interpretation", "raw", "s", "ai", "T", False) == ("read", "ai_interpretation")
    assert made("raw", "fetched", "raw", "sum", "ai", "T", False) == ("sum", "ai_summary")
    assert made("raw", "fetched", "raw", "desc", "desc", "T", False) == ("desc", "ai_summary")
    assert made("raw", "official_rss", "raw", "desc", "desc", "T", True) == ("desc", "official_rss")
    assert made("read", "official_rss", "raw", "desc", "desc", "T", True) == ("read", "official_rss")
    assert made(None, None, None, "T", "title", "T", False) == ("T", "ai_summary") and made(None, None, None, None, None, None, None) == ("", "")


PUBLISHED = "dedup_key string, title string, source string, summary string, summary_source string, content string, content_source string, opinion string, created long, retained boolean, retained_at long, expires long, views int"


def test_merge_keeps_what_is_better(spark):
    long, longer = "An old description of some length", "An old description of some length and more"
    old = [
        ("a", "T", "S", "by model", "ai", "read", "ai_interpretation", "view", 1, True, None, 5, 7), ("b", "T", "S", longer, None, "", "", None, 1, True, 50, 5, 7), ("c", "T", "S", "2024-01-01 10:00:00 2024-01-01", "desc", "x", "ai_summary", None, 1, False, None, 5, 7),
        ("d", "T", "S", "only old", None, "x", "ai_summary", None, 1, None, None, 5, 7), ("e", "T", "S", "s", "ai", "read", "ai_interpretation", "view", 1, False, None, 5, 7),
    ]
    new = [
        ("a", "T", "S", "fetched words", "desc", "weak", "fetched", None, None, None, None, None, 0), ("b", "T", "S", long, None, " ", "fetched", None, None, None, None, None, 0), ("c", "T", "S", "new", "desc", "raw", "fetched", "n", None, None, None, None, 0),
        ("e", "T", "S", "m", "ai", "raw", "official_rss", None, None, None, None, None, 0), ("f", "T", "S", "T", None, "raw", "fetched", None, None, None, None, None, 0), ("g", "T", "S", "by model", "ai", "raw", "fetched", None, None, None, None, None, 0),
    ]
    merged = tables.merge_published(*[spark.createDataFrame(rows, PUBLISHED) for rows in (old, new)], as_of=100)
    got = {r.dedup_key: tuple(r)[3:] for r in merged.collect()}
    week, month = 100 + 7 * DAY, 30 * DAY
    assert got == {
        "a": ("by model", "ai", "read", "ai_interpretation", "view", 1, True, 100, 100 + month, 0), "b": (longer, "desc", " ", "", "", 1, True, 50, 50 + month, 0), "c": ("new", "desc", "raw", "fetched", "n", 1, False, None, week, 0),
        "d": ("only old", None, "x", "ai_summary", None, 1, None, None, 5, 7), "e": ("m", "ai", "raw", "official_rss", "", 1, False, None, week, 0), "f": ("T", "title", "raw", "fetched", "", 100, False, None, week, 0),
        "g": ("by model", "ai", "raw", "ai_summary", "", 100, False, None, week, 0),
    }


def test_best_of_batch(spark):
    rows = [("k", "ai_summary", " ", 99, 1), ("k", "ai_summary", "view", 0, 2), ("k", None, "view", 100, 3), ("m", None, None, None, 4), ("m", None, None, None, 5)]
    best = tables.best_of_batch(spark.createDataFrame(rows, "dedup_key string, content_source string, opinion string, quality int, id int"), order=F.col("id"))
    assert sorted(r.id for r in best.collect()) == [1, 4]


def test_cards(spark):
    row = dict(zip(("title", "source_id", "published", "happened", "action"), lits("T", "src", "2024", " one \n\n\n" + "x" * 200 + "\nthree", " do "), strict=True))
    card = value(spark, tables.brief_card({**row, "contract": F.lit(True)}))
    assert card == "### T\n> ⭐ 合同 / 接口变更 · 需重点关注\n- **溯源**：src · 2024 · 无链接\n- **发生了什么**：one " + "x" * 160 + "\n- **最小行动**：do"
    assert value(spark, tables.brief_card({})) == "### （无标题）\n- **溯源**：未知来源 ·  · 无链接"


def test_ids_by_the_whole_address(spark):
    item = lambda url: F.struct(F.lit(url).alias("source_url"), F.lit(url).alias("url"), F.lit("A title").alias("title"), *[F.lit(None).cast("string").alias(n) for n in ("summary", "source", "publish_time", "category", "pub_date")])
    one, two = (value(spark, feeds.aggregate_document(item(f"https://x.org/read?id={k}"), "juhe", F.lit("tech"))) for k in (1, 2))
    assert one.id != two.id and one.title_fp == two.title_fp and one.id == value(spark, urls.url_fingerprint(F.lit("http://x.org/read?id=1&utm_source=a")))
    feed = F.struct(F.lit("f").alias("id"), F.lit("F").alias("name"), F.lit("world").alias("category"))
    made = value(spark, feeds.official_document(item("https://x.org/read?id=1"), feed))
    assert (made.id, made.category) == (f"official_{one.id}", "international")


def test_older_cases(spark):
    """Values that the rule queries held before they read the tables' own texts."""
    assert [value(spark, text.block_kind(F.lit(x))) for x in ("要点", "这是一个完整的句子。")] == ["title", "text"]
    assert value(spark, text.remove_bracketed_meta(F.lit("News （编辑：张三）"))) == "News "
    assert value(spark, text.truncate_at_sentence(F.lit("one two. three"), 9)) == "one two."
    assert value(spark, text.clean_intel(F.lit("x \t &nbsp;y"))) == "x y"
    assert value(spark, F.trim(text.strip_markup(F.lit("<p>a</p><b>b</b>")))) == "a\nb" and value(spark, F.trim(text.strip_markup(F.lit("<script>x</script>text")))) == "text"
    assert [value(spark, text.is_mostly_english(F.lit(x))) for x in ("ABC 模型 plus", "12 models", "A bc d1", None)] == [False, True, False, False]
    assert [value(spark, scoring.search_fast_path(F.lit(q))) for q in ("How to train a GPU model", "房价 与 AI", "weather today")] == [True, None, None]
    assert [value(spark, publish.yields_to(F.lit(d), F.lit(b))) for d, b in ((0, 35), (1, 0), (0, 36))] == [False, True, True]
    assert value(spark, publish.indicator_hits(F.lit("An API and a Model"), ["api", "model", "chip"])) == 2
    assert [value(spark, feeds.source_of(F.lit(n).cast("string"), F.lit(u))) for n, u in (("x", "https://bbc.com/a"), (None, "https://news.bbc.com/a"), ("", "https://www.y.org/a"))] == ["x", "BBC", "y.org"]
    instants = ("1704067200", "1704067200000", "2024-01-01T00:00:00Z", "Mon, 1 Jan 2024 08:00:00 +0800", "Mon, 1 Jan 2024 00:00:00 GMT", "None")
    assert [value(spark, times.parse_instant(F.lit(x))) for x in instants] == [1704067200] * 5 + [None]
    long = "w" * 80
    reasons = lambda t, c, p: value(spark, gates.qualify_reasons(F.lit(t), F.lit(c), F.lit(""), F.lit(p), F.lit(None).cast("long"), F.lit(7), F.lit(10 * DAY)))
    assert [reasons("Title", long, 10 * DAY), reasons("", "", 0), reasons("One; two", long, 10 * DAY), reasons("早报一二三四五六七八九十一二三四", "few", 10 * DAY)] == [[], ["short", "stale", "empty"], ["several"], ["short", "roundup"]]
