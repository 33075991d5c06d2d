"""Queries on inputs that showed a fault: each against its SQL on a table of its own."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import similar
from newsloom.plans import registry


def against_sql(spark, folder, query, documents):
    """Rows of a query and of its SQL over documents (doc_id, text, lang, source, n_chars)."""
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = registry.QUERIES[query](spark, str(folder))
    found = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in got.columns)} FROM ({registry.ORACLE_SQL[query]})")
    tidy = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    return tidy(map(tuple, got.collect())), tidy(found.fetchall())


def document(i, text, source="src1", lang="en"):
    return i, text, lang, source, len(text or "")


def test_markdown_answers_of_long_words(spark, tmp_path):
    # The fifth to eighth word reach 60 characters together, the next ones 300.
    long = [document(1, "a b c d " + "e" * 70 + " f g h i j k l m n o p"), document(2, "a b c d e f g h " + "i" * 400 + " j k l " + "m" * 500 + " n o p"), document(3, "a b c d e f g h i j k l m n o p")]
    got, want = against_sql(spark, tmp_path, "markdown_answers", long)
    assert len(want) == 3 and got == want


def test_heat_scores_have_the_heat_of_feeds(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "heat_scores", [document(i, "x" * n, lang="de") for i, n in enumerate((0, 1, 2, 3, 4, 30, 99))] + [document(9, None)])
    assert got == want
    rows = registry.QUERIES["heat_scores"](spark, str(tmp_path))
    assert {r.id: r.feed for r in rows.collect()} == {0: 20, 1: 14, 2: 11, 3: 7, 4: 5, 5: 3, 6: 2, 9: 20}


def occurrences(frame, name):
    """How often a function stands in a query's optimized plan: once for each time that a row computes it."""
    return frame._jdf.queryExecution().optimizedPlan().toString().count(name)


ODD = [
    None, "", " ", "　", "plain words of a text that is longer than thirty characters in all, with more", "Zwei  Wörter — und 3 Zahlen 12,5 &#65; &#x42; &amp; &lt;p&gt; [1] {x}", "新闻 text 中文 words here are more than six in all",
    "one two three four five six seven eight nine ten " * 30, "tab\tand\nline\r\n   end ", "```json\n[{\"title\": 1}]\n``` [ {\"a\": 2} ]", "作者：某人\n转发朋友圈\n-----\n" + "long line of text that stays here. " * 5,
]


def odd_documents(sources=("src3", "src1", "src2")):
    return [document(i + 10 * k, x, sources[k], "en") for k in range(3) for i, x in enumerate(ODD[:10])] + [document(100 + i, "abcdefgh "[: i % 9] + ODD[4 + i % 7]) for i in range(40)]


def test_answers_are_parsed_once(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "answer_lists_parsed", odd_documents((None, "src1", "src2")))
    assert got == want and len(got) > 50
    assert occurrences(registry.QUERIES["answer_lists_parsed"](spark, str(tmp_path)), "from_json") <= 3


#: Replacements by pattern in a query's plan at most: steps that stand in it several times are computed several times a row.
REPLACEMENTS = {
    "clean_content_full": 50, "aggregator_items_parsed": 60, "changelog_entries_parsed": 12, "brief_summaries": 8, "adapters_parsed": 40, "noise_line_removal": 0, "feed_items_parsed": 30, "story_hits_parsed": 2,
}


@pytest.mark.parametrize("query", sorted(REPLACEMENTS))
def test_steps_are_computed_once(spark, tmp_path, query):
    if query in registry.ORACLE_SQL:
        got, want = against_sql(spark, tmp_path, query, odd_documents())
        assert got == want and got
    else:
        against_sql(spark, tmp_path, "heat_scores", odd_documents())
    assert occurrences(registry.QUERIES[query](spark, str(tmp_path)), "regexp_replace(") <= REPLACEMENTS[query]


def test_article_is_cut_once(spark):
    assert occurrences(registry.QUERIES["html_article_body"](spark, "/root/testdata/sf0.001"), "regexp_replace(") <= 60


def test_noise_lines_of_any_script(spark):
    noise = ["(IC photo)", "(ic  Photo / x)", "-----", "●●●", "（新华社发 x）", "下一页：2", "第12页", ">> 全文", "x 供图", "分享到微信"]
    other = ["plain words", "IC photo", "----", "●●", "新闻正文。", "", "# heading"]
    d = spark.createDataFrame([(x,) for x in noise + other], "x string")
    assert [r.n for r in d.select(text.is_noise_line(F.col("x")).alias("n")).collect()] == [True] * len(noise) + [False] * len(other)
    assert occurrences(d.select(text.is_noise_line(F.col("x"))), "trim(x#") == 1


def brute_pairs(sets, similarity):
    return {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) > similarity}


@pytest.mark.parametrize("similarity", (0.55, 0.8))
def test_similar_pairs_of_any_alphabet(spark, monkeypatch, similarity):
    # Far more characters than have a bit of their own, beside Latin ones, long sets, and characters beyond 16 bits; in one part and in several.
    draw = random.Random(3)
    alphabets = ["abcdefghijklmnopqrstuvwxyzäöüß ", [chr(0x4E00 + k) for k in range(900)], [chr(0x1F300 + k) for k in range(300)] + list("abcdefgh")]
    sets = {}
    for i in range(450):
        near = sets[draw.randrange(i)] if i % 2 else None
        kept = sorted(near)[draw.randrange(3) :] if near else []
        sets[i] = frozenset(kept) | frozenset(draw.sample(sorted(alphabets[i % 3]), draw.randrange(1, 4) if near else draw.choice((1, 2, 5, 12, 25, 31 if i % 3 == 0 else 200))))
    first = {s: i for i, s in reversed(sets.items())}
    d = spark.createDataFrame([(i, "".join(draw.sample(sorted(s), len(s)))) for i, s in sets.items()] + [(900, ""), (901, None)], "id long, title string")
    want = brute_pairs({i: s for s, i in first.items()}, similarity)
    assert len(want) > 100
    for least in (similar.LEAST, 50):
        monkeypatch.setattr(similar, "LEAST", least)
        got = similar.similar_pairs(d, "id", "title", similarity).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.similarity for r in got} == want


def shuffled(spark, run):
    """Rows that the jobs of run() shuffle."""
    jvm = spark._jvm
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()))}
    before = stages()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def test_similar_pairs_are_not_shuffled(spark):
    # Any two titles lack two letters of 26 each, so all are alike: 52,650 pairs of 325 titles.
    letters = "abcdefghijklmnopqrstuvwxyz"
    titles = [(i * 26 + j, letters[:i] + letters[i + 1 : j] + letters[j + 1 :]) for i in range(26) for j in range(i + 1, 26)]
    d, found = spark.createDataFrame(titles, "id long, title string"), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are not small
    try:
        rows = shuffled(spark, lambda: found.append(similar.similar_pairs(d, "id", "title", 0.8).agg(F.count("*"), F.max("similarity")).first()[0]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == [52_650] and rows < 5_000
