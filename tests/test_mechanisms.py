"""Selection in rounds, limits, streams, writers and sources on small and odd cases."""

import http.server
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from newsloom import sinks
from newsloom.operators import folds, settle
from newsloom.shared import place, remove
from newsloom.sources import feeds, html, trees
from newsloom.sources import registry as sources
from newsloom.streaming import merges, queue
from newsloom.streaming.drain import arrivals


def fold_by_keys(rows):
    kept, seen = [], set()
    for i, *keys in sorted(rows):
        own = {(n, k) for n, k in enumerate(keys) if k is not None}
        if not own & seen:
            kept.append(i)
            seen |= own
    return kept


def test_first_come_by_keys(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *"abcdefgh"]), rng.choice([None, *range(9)])) for i in range(60)]
    chain = [(100 + i, f"c{(i + 1) // 2}", 100 + i // 2) for i in range(12)]
    rows = rows + chain
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "id int, u string, t int, o string, k0 int")
    got = settle.first_come_by_keys(d, ["u", "t"], F.col("id"))
    assert got.columns == d.columns and sorted(r.id for r in got.collect()) == fold_by_keys(rows)
    assert settle.first_come_by_keys(d.limit(0), ["u", "t"], F.col("id")).count() == 0


def test_first_come_by_links(spark):
    rng = random.Random(4)
    links = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(50)}
    kept = []
    for n in range(42):
        if not any((k, n) in links for k in kept):
            kept.append(n)
    want = {n: n if n in kept else min(k for k in kept if (min(k, n), max(k, n)) in links) for n in range(42)}
    nodes = spark.range(42).withColumnRenamed("id", "node")
    ends = spark.createDataFrame([*links, (3, 3)], "a long, b long")
    assert {r.node: r.leader for r in settle.first_come_by_links(nodes, ends).collect()} == want
    assert settle.first_come_by_links(nodes.limit(0), ends.limit(0)).count() == 0


def test_limited_hits(spark):
    rng = random.Random(6)
    times = sorted(rng.randint(0, 900) for _ in range(150)) + [86400 - 5, 86400 - 4, 86400 - 3, 86400 - 2, 86400 - 1, 86400, 86400 + 1, 86400 + 60, 86400 + 61]
    want, last, count = [], None, 0
    for t in times:
        inside = last is not None and t - last < 60
        ok = not (inside and count >= 5)
        if ok:
            last, count = t, count + 1 if inside else 1
        want.append(ok)
    rows = [("u", t, i, "keep") for i, t in enumerate(times)] + [(None, 5, 900, "a"), ("u", None, 901, "b"), ("v", 5, 902, "c"), ("v", 5, 902, "c")]
    d = spark.createDataFrame(rows, "user string, at long, id int, stretch string")
    got = folds.limited_hits(d, "user", "at", "id")
    assert got.columns == [*d.columns, "accepted"]
    verdicts = [(r.id, r.accepted) for r in got.collect()]
    assert sorted(verdicts) == sorted([*enumerate(want), (900, True), (901, True), (902, True), (902, True)])
    assert False in want and folds.limited_hits(d.limit(0), "user", "at", "id").count() == 0


def test_debounced(spark):
    times = [0, 10, 3599, 3600, 3601, 7199, 7200, 90000, 90001, None]
    d = spark.createDataFrame([("k", t) for t in times] + [("k", 0), (None, 1)], "key string, at long")
    assert sorted(r.at for r in folds.debounced(d, "key", "at").collect()) == [0, 3600, 7200, 90000]


def test_append_new_counts_in_one_pass(spark):
    table = place(spark, "test-append")
    schema = "id int, u string, t string"
    sinks.existing(spark, table, schema)
    sinks.existing(spark, table, schema)
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, None, "z"), (5, "c", None), (6, "d", None), (6, "d", None)]
    d = spark.createDataFrame(rows, schema)
    assert sinks.append_new(d, table, ["u", "t"], [F.col("id")]) == {"written": 3, "duplicates": 3, "failed": 1}
    assert sinks.append_new(d, table, ["u", "t"], [F.col("id")]) == {"written": 0, "duplicates": 6, "failed": 1}
    assert sinks.append_new(d.limit(0), table, ["u", "t"], [F.col("id")]) == {"written": 0, "duplicates": 0, "failed": 0}
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [1, 5, 6]
    remove(spark, table)


def test_issues(spark):
    where = place(spark, "test-issues")
    book = sinks.Issues(spark, where, "id int")
    days = lambda *rows: spark.createDataFrame(rows, "id int, day string")
    assert book.publish(days((1, "2024-01-01"), (2, None)), 100) == 1
    assert book.publish(days(), 150) == 0
    assert book.publish(days((3, "2024-01-01"), (4, "2024-01-02")), 200) == 2
    assert sorted((r.id, r.day, r.version) for r in book.current().collect()) == [(3, "2024-01-01", 2), (4, "2024-01-02", 1)]
    assert [(r.id, r.version, r.archived_at) for r in book.archive().collect()] == [(1, 1, 200)]
    assert [tuple(r) for r in book.pointer().collect()] == [("2024-01-02", 1, 200)]
    book.purge(200 + 7 * 86400)
    assert book.archive().count() == 1
    book.purge(201 + 7 * 86400)
    assert book.archive().count() == 0
    remove(spark, where)


def test_brief_batches(spark):
    where = place(spark, "test-brief")
    tables = merges.BatchTables(spark, where, items="day string, id long, score double", briefs=merges.BRIEF)
    batch = lambda *rows: spark.createDataFrame(rows, "day string, id long, score double, closes boolean")
    first = batch(("d1", 1, 5.0, False), ("d1", 1, 7.0, None), ("d2", None, None, True), (None, 9, 9.0, True))
    second = batch(("d1", 2, 6.0, False), ("d1", 1, 1.0, False), ("d2", 3, 3.0, False))
    third = batch(("d1", None, None, True), ("d2", None, None, False))
    last = batch(("d1", 4, 9.0, True), ("d2", 3, 3.0, True))
    for number, rows in enumerate((first, second, third, last)):
        merges.publish_brief(rows, number, tables)
        before = sorted(map(str, tables.read("briefs").collect()))
        merges.publish_brief(rows, number, tables)  # a batch that runs again changes nothing
        assert sorted(map(str, tables.read("briefs").collect())) == before
    got = sorted((r.day, r.version, r.mode, r.locked, [(i.id, i.score) for i in r["items"]]) for r in tables.read("briefs").collect())
    assert got == [
        ("d1", 1, "increment", False, [(1, 7.0)]), ("d1", 2, "increment", False, [(2, 6.0), (1, 1.0)]), ("d1", 3, "summary", True, [(2, 6.0), (1, 1.0)]), ("d2", 1, "increment", False, [(3, 3.0)]), ("d2", 2, "summary", True, [(3, 3.0)]),
    ]
    remove(spark, where)


def test_cursor_batches(spark):
    where = place(spark, "test-cursor")
    tables = merges.BatchTables(spark, where, kept="s string, t long", cursors="s string, cursor long", counts="s string, kept long, late long, future long, undated long")
    batch = lambda now, *rows: spark.createDataFrame([(*r, now) for r in rows], "s string, t long, now long")
    runs = [
        batch(100, ("a", 40), ("a", 50), ("a", 101), ("a", None), (None, 60)), batch(200, ("a", 50), ("a", 51), ("a", 201), (None, 60), (None, 61)),
        batch(300, ("b", 250), ("b", 260)), batch(400, ("a", 10)), batch(500, ("a", 51), ("a", 52)),
    ]
    for number, rows in enumerate(runs):
        for _ in range(2):
            merges.take_from_cursor(rows, number, tables, "s", "t", F.col("now"), 50)
    got = {(r.batch, r.s): (r.kept, r.late, r.future, r.undated) for r in tables.read("counts").collect()}
    # In the first batch a source looks back 50 seconds from 100.
    assert got == {(0, "a"): (0, 2, 1, 1), (0, None): (1, 0, 0, 0), (1, "a"): (0, 2, 1, 0), (1, None): (1, 1, 0, 0), (2, "b"): (1, 1, 0, 0), (3, "a"): (0, 1, 0, 0), (4, "a"): (0, 2, 0, 0)}
    remove(spark, where)


def test_item_rules():
    item = queue.Item(300, 600, 3, 20)
    assert not item.step(0, "claim") and item.step(0, "queued") and not item.step(1, "queued")
    assert item.step(10, "claim") and not item.step(11, "claim") and item.step(12, "failed") and item.retries == 1
    assert not item.step(611, "claim") and item.step(612, "claim")
    assert not item.lapses(912) and item.lapses(913) and item.status == "pending"
    assert item.step(914, "failed") and not item.step(915, "failed")
    assert item.step(1600, "claim") and item.step(1601, "failed") and item.status == "discarded" and not item.step(9999, "claim")
    other = queue.Item(300, 600, 3, 2, state=("processing", 0, 1, None, 5, None, None))
    assert other.step(6, "postponed") and other.status == "discarded"


def test_queue_state_goes_on_between_runs(spark):
    """Claims of one run lapse by a timer in a later one."""
    schema = "item long, event long, at timestamp, action string"
    day = "2024-01-01 00:"
    rows = lambda *r: spark.createDataFrame(r, "item long, event long, at string, action string").withColumn("at", F.col("at").cast("timestamp"))
    batches = [
        rows((1, 1, day + "00:00", "queued"), (1, 2, day + "01:00", "claim"), (2, 3, day + "01:00", "queued"), (None, 4, day + "01:00", "queued"), (2, 5, day + "01:30", "odd"), (2, 6, None, "claim")),
        rows((2, 7, day + "20:00", "claim"), (2, 8, day + "20:00", "claim")), rows((2, 9, day + "40:00", "done"), (2, 10, day + "41:00", "queued")),
    ]
    where = place(spark, "test-queue")

    def start(stream, log):
        steps = queue.queue_steps(stream, F.col("item"), F.col("event"), "at", F.col("action"), delay="0 seconds")
        return steps.writeStream.format("parquet").option("path", where).option("checkpointLocation", log).trigger(availableNow=True).start()

    arrivals(batches, spark.createDataFrame([], schema).schema, start)
    got = sorted((r.item, r.at_ms // 1000 % 86400, r.action, r.accepted, r.status) for r in spark.read.parquet(where).collect())
    assert got == [
        (1, 0, "queued", True, "pending"), (1, 60, "claim", True, "processing"), (1, 360, "lapse", True, "pending"), (2, 60, "queued", True, "pending"), (2, 1200, "claim", False, "processing"), (2, 1200, "claim", True, "processing"),
        (2, 1500, "lapse", True, "pending"), (2, 2400, "done", True, "done"), (2, 2460, "queued", True, "pending"),
    ]
    remove(spark, where)


def test_trees(spark):
    deep = '"x"'
    for k in range(20):
        deep = json.dumps({"children": [json.loads(deep), f"t{k}"]})
    odd = [
        (1, '{"root":{"children":["a",{"text":"b"},{"text":5},{"children":[{"text":"c"}],"text":"no"},{"children":{},"text":"d"},null,"\\n\\n\\n\\ne"]}}'), (2, None), (3, "{broken"), (4, '{"root":{"children":7}}'), (5, '{"root":{"children":[]}}'),
        (6, json.dumps({"root": {"children": [json.loads(deep)]}})), (6, '{"root":{"children":["z"]}}'), (None, '{"root":{"children":[" n "]}}'),
    ]
    got = sorted((str(r.id), r.text) for r in trees.tree_texts(spark.createDataFrame(odd, "id int, body string"), "id", "body").collect())
    want = [("1", "a\nb\nc\nd\n\ne"), ("2", ""), ("3", ""), ("4", ""), ("5", ""), ("6", "x\n" + "\n".join(f"t{k}" for k in range(20))), ("6", "z"), ("None", "n")]
    assert got == sorted(want)
    assert trees.tree_texts(spark.createDataFrame([], "id int, body string"), "id", "body").count() == 0


def test_cards(spark):
    page = '<h2>Second story here</h2>' + "x" * 390 + '<a href="/b">b</a><a href="/b">again</a><a href="mailto:x">m</a><div title=\'By <b>name</b>\'><a class=k href="https://y.org/c">c</a> on 2024-02-03</div>' + '<a href="/z1">'.join(str(k) for k in range(3))
    d = spark.createDataFrame([(page, "https://x.org/list?p=1"), (None, None), ("", "https://x.org")], "html string, base string")
    link, date = F.lit(r'<a[^>]+href\s*=\s*["\']([^"\']+)["\'][^>]*>'), F.lit(r"(\d{4}-\d{2}-\d{2})")
    got = [[tuple(c) for c in r.c] for r in d.select(html.cards(F.col("html"), F.col("base"), link, date).alias("c")).collect()]
    assert got[1:] == [[], []]
    assert [c[0] for c in got[0]] == ["https://x.org/b", "https://y.org/c", "https://x.org/z1"]
    assert got[0][1][1:] == ("By name", "2024-02-03")
    assert len(d.select(html.cards(F.col("html"), F.col("base"), link, date, 1).alias("c")).first().c) == 1


def test_sources_that_fail_or_are_off(spark):
    def broken(_):
        raise ValueError("no key")

    one = sources.Adapter("one", lambda s: s.createDataFrame([(1, "x")], "id long, more string"))
    rows, outcome = sources.collected(spark, [one, sources.Adapter("two", broken), sources.Adapter("off", broken, enabled=False), sources.Adapter("gone", lambda s: s.read.parquet("/no/such/place"))], "id long, url string")
    assert outcome == {"one": "ok", "two": "failed: ValueError", "off": "disabled", "gone": "failed: AnalysisException"}
    assert [r.asDict() for r in rows.collect()] == [{"adapter": "one", "id": 1, "url": None, "more": "x"}]
    assert sources.collected(spark, [], "id long")[0].count() == 0


def test_accounts_over_http(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            ok = self.path == "/good"
            self.send_response(200 if ok else 500)
            self.end_headers()
            self.wfile.write(b'{"items":[{"title":"T","link":"https://x.org/1"},{"digest":"none"}]}' if ok else b"")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(sources.AccountSource)
        base = f"http://127.0.0.1:{server.server_port}"
        bodies = spark.read.format("accounts").option("good", f"{base}/good").option("bad", f"{base}/bad").option("closed", "http://127.0.0.1:1/").load()
        found = bodies.select("account", F.explode(feeds.account_items(F.col("body"))).alias("e")).collect()
        assert [(r.account, r.e.title, r.e.url) for r in found] == [("good", "T", "https://x.org/1")]
    finally:
        server.shutdown()


@pytest.mark.parametrize("said", [None, "", "[", "{}", "[]", '{"items":null}', "no"])
def test_broken_answers(spark, said):
    d = spark.createDataFrame([(said,)], "j string")
    assert [r[0] for r in d.select(F.size(feeds.account_items(F.col("j")))).collect()] == [0]
    assert [r[0] for r in d.select(F.size(feeds.company_items(F.col("j"), "https://x.org"))).collect()] == [0]
    assert [r[0] for r in d.select(F.size(feeds.research_items(F.col("j"), "https://x.org"))).collect()] == [0]


def test_research_items(spark):
    docs = {"docs": [{"id": 7, "title_en": "E", "content_zh": {"root": {"children": [{"text": "body"}]}}}, {"id": 8}]}
    d = spark.createDataFrame([(1, json.dumps(docs))], "k int, j string")
    rows = d.select(F.explode(feeds.research_items(F.col("j"), "https://x.org/r")).alias("e")).select("e.*")
    assert [(r.title, r.url, r.guid) for r in rows.collect()] == [("E", "https://x.org/r/7", "docs:7")]
    assert [r.text for r in trees.tree_texts(rows, "guid", "body").collect()] == ["body"]
