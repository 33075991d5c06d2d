"""Registered queries against DuckDB on whole small tables, and operators on small cases."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from newsloom.functions import text, times, urls
from newsloom.operators import gates, scoring, similar, tables
from newsloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLE_SQL:
        assert got.count() > 0
        return
    found = con.execute(registry.ORACLE_SQL[name])
    names, want = [c[0] for c in found.description], found.fetchall()
    assert sorted(got.columns) == sorted(names)
    tidy = lambda rows: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert tidy(map(tuple, got.select(*[f"`{n}`" for n in names]).collect())) == tidy(want)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scores(spark):
    authority = lambda s: value(spark, scoring.source_authority(F.lit(s), F.lit("")))
    assert [authority(s) for s in ("新华社", "澎湃新闻", "36氪", "聚合数据", "某报")] == [100, 85, 80, 60, 40]
    assert value(spark, scoring.timeliness(F.lit(None).cast("long"), F.lit(0))) == 50
    assert value(spark, scoring.timeliness(F.lit(0), F.lit(48 * 3600))) == 37
    assert value(spark, scoring.final_score(F.lit(80), F.lit(50))) == 68


def test_functions(spark):
    assert value(spark, text.decode_entities(F.lit("a &amp;lt; &#65;&#x42;"))) == "a < AB"
    assert value(spark, urls.normalize_url(F.lit("https://x.org/a/?utm_source=b&k=1"))) == value(spark, urls.normalize_url(F.lit("http://x.org/a/?k=1")))
    assert str(value(spark, urls.url_date(F.lit("https://x.org/2024/02/03/a")))) == "2024-02-03"
    assert value(spark, urls.url_date(F.lit("https://x.org/2024/02/31/a"))) is None
    assert value(spark, times.parse_instant(F.lit("1704067200000"))) == 1704067200
    assert value(spark, gates.raw_record_reason(F.lit("abc"), F.lit("https://x.org/abc"))) == "title short"


def test_page(spark):
    d = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    assert [r.id for r in tables.page(d, [F.col("id")], 2, 3).collect()] == [4]


def test_title_clusters(spark):
    rows = [(1, "k", "央行宣布降准", "a"), (2, "k", "央行今日宣布降准", "b"), (3, "k", "足球比赛结果", "a"), (4, None, "", None), (5, None, None, None), (6, None, "央行宣布降准", "a")]
    d = spark.createDataFrame(rows, "id int, block string, title string, source string")
    events = {r.id: (r.event_key, r.event_heat) for r in similar.event_clusters(d, "block", "id").collect()}
    assert events == {1: ("央行宣布降准", 22), 2: ("央行宣布降准", 22), 3: ("足球比赛结果", 11), 4: (None, 10), 5: (None, 10), 6: ("央行宣布降准", 11)}
    assert sorted(r.id for r in similar.dedup_titles(d, "block", "id").collect()) == [1, 3, 4, 5, 6]
    assert similar.event_clusters(d.limit(0), "block", "id").count() == similar.dedup_titles(d.limit(0), "block", "id").count() == 0


def test_leaders_over_many_rounds(spark):
    # More leaders than a round settles, in one block, against the fold that they stand for.
    draw = random.Random(1)
    names = ["".join(draw.sample("abcdefghijklmnopqrstuvwxyz", 6)) for _ in range(900)]
    kept = []
    for i, name in enumerate(names):
        if not any(len(set(name) & set(names[j])) / len(set(name) | set(names[j])) > 0.7 for j in kept):
            kept.append(i)
    assert len(kept) > similar.ROUNDS * similar.WIDTH
    d = spark.createDataFrame([(i, "k", n) for i, n in enumerate(names)], "id int, block string, title string")
    assert sorted(r.id for r in similar.dedup_titles(d, "block", "id").collect()) == kept


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
