"""Lists, channels, reports, adapters, exports and page readers on small and odd values."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import gates, publish
from newsloom.shared import place, remove
from newsloom.sources import exports, feeds, html, reports


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def said(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize("body", [None, "", "no", "## no\n", "a | b", "{"])
def test_nothing_to_read(spark, body):
    assert value(spark, reports.log_blocks(said(body))) == [] and value(spark, reports.board_rows(said(body))) == []
    assert value(spark, feeds.story_search_items(said(body))) == [] and value(spark, feeds.paper_items(said(body))) == [] and value(spark, feeds.keyword_feed_items(said(body))) == []
    assert value(spark, html.list_links(said(body), F.lit("https://x.org"), "a")) == [] and value(spark, html.heading_links(said(body), F.lit("https://x.org"))) == []
    assert value(spark, html.article(said(body))) is None


def test_logs(spark):
    log = "before\r\n## [2024-01-02 10:30] ✅ 🔧 `fix` it | 会话：[fe]\r\nline one\r\n\r\n## [2024-01-03] done\n## other\nrest"
    got = [tuple(b) for b in value(spark, reports.log_blocks(F.lit(log)))]
    assert got == [("2024-01-02 10:30", "fe", "fix it", "line one\n\n"), ("2024-01-03", "", "done", "## other\nrest")]


def test_boards_and_commits(spark):
    board = "| id | name | owner | p | s |\n|---|---|---|---|---|\n| x | A-01 | do | me | P0 | 🔄 on |\n| A-2 | short | row | P1 |\n| a-3 | n | o | p | s |\n||| FS-4 | n | o | p |"
    assert [tuple(r) for r in value(spark, reports.board_rows(F.lit(board)))] == [("A-01", "do", "me", "P0", "🔄 on", "🔄")]
    assert [tuple(r) for r in value(spark, reports.commits(F.lit("h|a|d|x | y\n\nz")))] == [("h", "a", "d", "x | y"), ("z", "", "", "")]


def test_articles(spark):
    long = "A paragraph that is long enough"
    page = lambda inner: f"<html><nav><p>{long} in a menu</p></nav><p>{long} outside</p>{inner}<!-- <p>{long} hidden</p> --></html>"
    read = lambda inner: value(spark, html.article(F.lit(page(inner))))
    two = f"<p>{long} &amp; one&#39;</p><p class='x'>{long}<br>two</p><p>too short</p>"
    assert read(f"<article>{two}</article>") == f"{long} & one\n{long} two"
    assert read(f"<div class=\"x post_body y\">{two}</div>") == f"{long} & one\n{long} two"
    assert read(f"<article><p>{long}</p></article>") == f"{long} outside\n{long}"
    assert read(f"<article>{two}{'<b></b>' * 10}<div class='related-items'><p>{long} of others</p></div></article>") == f"{long} & one\n{long} two"
    assert read(f"<article><div class='related'></div>{two}</article>") == f"{long} & one\n{long} two"


def test_list_links(spark):
    card = f"<a href='/news/3'><div><h4>Third one</h4></div><p>2024 年 5 月</p><p>{'A sentence about it. ' * 20}</p><time>2024年5月6日</time></a>"
    page = f"<h2><a href='/news/1'>First</a></h2><h2><a href='/other/1'>Other one</a></h2><a href='#news'>Not a page</a><a href='/news/2'>Second one</a> on 3/4/2024 <a href='/news/1'>First one again</a>{'x' * 320}{card}"
    got = [tuple(x) for x in value(spark, html.list_links(F.lit(page), F.lit("https://x.org/list"), "/news/"))]
    assert [g[:3] for g in got] == [("https://x.org/news/1", "First", ""), ("https://x.org/news/2", "Second one", "2024-03-4T00:00:00+08:00".replace("-4T", "-04T")), ("https://x.org/news/3", "Third one", "2024-05-06")]
    assert got[2][3].startswith("A sentence about it.") and len(got[2][3]) == 300
    assert len(value(spark, html.list_links(F.lit(page), F.lit("https://x.org/list"), "/news/", 2))) == 2


def test_json_answers(spark):
    last = lambda t: (lambda r: r and r.k)(value(spark, text.last_json_object(said(t), "k int")))
    cases = ['{"k": 1}', 'a {"k": 1} b {"k": 2} c', '{"k": 1} then {broken}', '```json\n{"k": 3}\n``` and {"k": 4}', '```json\n{broken\n``` and {"k": 4}', 'so {"k": 5, "m": {"n": 1}} there', "{", None, "[1]"]
    assert [last(c) for c in cases] == [1, 2, 1, 3, None, 5, None, None, None]


def test_shapes_without_values(spark):
    row = value(spark, publish.list_shape({"category": F.lit("life"), "title": F.lit(None)}))
    assert (row.id, row.title, row.category_name, row.summary_source, row.retained, row.final, row.content) == (None, "", "社会", "", False, None, "")
    assert value(spark, publish.list_shape({"created": F.lit(5)}, since=True)).created == 5
    items = F.array().cast("array<struct<id: string, title: string, url: string, source_name: string, source_id: string, published: string, card: string, contract: boolean, tryable: boolean, scenes: array<string>, relevance: string, rank: int>>")
    empty = value(spark, publish.channel_payload({"items": items}))
    assert (empty.mode, empty.version, empty.clock, empty.label, empty.items, empty.has_content) == ("increment", 0, "", "", [], False)
    assert value(spark, publish.channel_payload({"items": F.lit(None).cast("array<struct<id: string, title: string, url: string, source_name: string, source_id: string, published: string, card: string, contract: boolean, tryable: boolean, scenes: array<string>, relevance: string, rank: int>>")})).items in ([], None)
    detail = value(spark, publish.intel_detail({"title": F.lit("a�b\x01c"), "practice": F.lit(" one \n\n two\n")}))
    assert (detail.title, detail.practice_lines, detail.blocks, detail.research, detail.processed) == ("abc", ["one", "two"], [], "todo", "")


def test_grouped_lists(spark):
    d = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), (None, 9), (None, 8)], "g string, i int")
    assert {r.g: r["items"] for r in publish.grouped_lists(d, "g", "i", [F.col("i")], 2).collect()} == {"a": [1, 2], None: [8, 9]}


def test_qualify_by_row_and_mode(spark):
    reasons = lambda days, least, lenient=False: value(spark, gates.qualify_reasons(F.lit("T"), F.lit("w" * 50), F.lit(""), F.lit(0), F.lit(None).cast("long"), F.lit(days).cast("int"), F.lit(9 * 86400), F.lit(least).cast("int"), lenient))
    assert [reasons(None, None), reasons(0, 40), reasons(10, 50), reasons(3, 51, True)] == [["short", "stale"], [], [], []]


def test_exports(spark):
    where = place(spark, "test-exports")
    lines = ['{"title": "a", "link": "https://x.org/1", "digest": "d  e"}', '{"title": "b"', "{}", '{"create_time": 1704067200, "url": "https://x.org/2"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{where}/lines")
    rows = exports.read_export(spark, f"{where}/lines", "lines")
    got = sorted((r.url, r.title, r.published, r.content, r.summary) for r in exports.export_items(exports.good_rows(rows)).collect())
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [("", "(无标题)", "", ""), ("https://x.org/1", "a", "d  e", "d e"), ("https://x.org/2", "(无标题)", "", "")]
    assert got[2][2] == 1704067200 and rows.cache().where(F.col(exports.BROKEN).isNotNull()).count() == 1
    spark.createDataFrame([("[" + ",".join([lines[0], lines[3]]) + "]",)], "value string").coalesce(1).write.text(f"{where}/json")
    assert len(exports.good_rows(exports.read_export(spark, f"{where}/json", "json")).collect()) == 2
    remove(spark, where)
