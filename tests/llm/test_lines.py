"""Texts without the frequent lines of their hosts."""

import corpus_pipeline
from newsloom.llm import quality

LINE = "Read more 3 on our site"


def letters(*numbers):
    """Numbers as letters: digits of a line are normalised to 0."""
    return "x".join("".join(chr(97 + int(c)) for c in str(n)) for n in numbers)


def test_frequent_lines_leave_the_texts(spark):
    own = lambda i: "\n".join(" ".join(letters(i, j, k) for k in range(8)) for j in range(4))
    rows = [(i, f"{own(i)}\n\n{LINE.replace('3', str(i % 10))}", "en", "h", 1) for i in range(60)] + [(60, own(60) + "\n", "en", "h", 1), (61, own(61) + "\n" + LINE, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.quality_rules(spark, docs, "")
    assert out.dtypes == docs.dtypes
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    want = {i: (own(i) + "\n", len(own(i)) + 1) for i in range(1, 60)}
    # The first document keeps the line; a text that loses none, and another host, stay as they are.
    want |= {i: (rows[i][1], 1) for i in (0, 60, 61)}
    assert got == want


def test_copies_count_once_on_both_sides(spark):
    own = lambda i: " ".join(letters(i, k) for k in range(30))
    rows = [(i, f"{own(i)}\n{LINE}", "h") for i in range(40)] + [(1000 + i, own(9999), "h") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r.n_docs for r in quality.frequent_lines(docs).collect()] == [40]
    assert quality.remove_lines(docs).where("doc_id between 1 and 39").orderBy("doc_id").select("text").collect() == [(own(i),) for i in range(1, 40)]


def test_a_missing_source_is_not_a_missing_text(spark):
    rows = [(1, None, "abc"), (1, "abc", None), (1, None, None), (1, "", ""), (2, None, "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert docs.select(quality.row_key().alias("k")).distinct().count() == 5
