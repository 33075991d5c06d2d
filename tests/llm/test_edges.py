"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import htmltree, jaccard, lblm, mixing, packing, pii, quality, sharding, substrings, topk

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, class string, start int, size int, rank int"
LONG = " ".join(f"w{k % 997}x{k % 31}" for k in range(30_000))
TEXTS = [None, "", " \t\n", "one", LONG, LONG, "same words here again " * 12, "Same words here again " * 12, "mail a.b@c.de or +49 170 1234567 from 10.0.0.255 with 4111 1111 1111 1111", "é ü 漢字 " * 9, None]
ROWS = [(i if i != 10 else None, t, "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), 1, "c", 2, 3, 4) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*ROWS, ROWS[8]], SCHEMA)


@pytest.fixture(scope="module")
def model():
    return htmltree.train(htmltree.labelled_pages(60), rounds=40)


OPERATORS = {
    "substrings": substrings.substring_dedup, "quality": quality.line_frequency_quality, "packing": packing.pack_documents, "scores": lblm.score_texts, "jaccard": jaccard.jaccard_components,
    "mixing": mixing.pareto_mix, "sharding": sharding.consistent_hash_shards, "pii": pii.find_pii,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_all_rows_come_back(docs, name):
    got = OPERATORS[name](docs).collect()
    assert len(got) == docs.count() if name != "packing" else len(got) > 0


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_substrings_agree_with_brute_force(docs):
    rows = [(r[0], r[1]) for r in ROWS]
    want = brute.substring_dedup([*rows, rows[8]])
    got = substrings.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_long_shared_passage(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = spark.createDataFrame([(i, f"a{i} b{i} {passage} c{i}") for i in range(40)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substrings.substring_dedup(docs).collect()}
    assert got == {i: 60 if i else 0 for i in range(40)}


def test_jaccard_chain(spark):
    """Near copies whose neighbours link, though the ends do not: one component."""
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words[4 * i : 4 * i + 100]) for i in range(20)] + ["other text of five words"]
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == sorted(brute.jaccard_components(list(enumerate(texts))))


def test_one_of_each_keeps_clean_documents(docs):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["0", "1", "2", "3", "4", "6", "8", "9", "None"])


def test_depleted_documents_go(spark):
    line = "this line stands in very many documents of the host"
    rows = [(i, f"{line}\n" + (" ".join(f"own{i}word{k}" for k in range(40)) if i % 2 else f"tail {i}"), "h") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r[0]: r[-1] for r in brute.line_frequency([(i, s, t) for i, t, s in rows])}
    assert {r.doc_id: r.kept for r in quality.line_frequency_quality(docs).collect()} == want
    assert {r.doc_id for r in quality.reject_by_lines(docs).collect()} == {i for i, k in want.items() if k}


def test_best_fit_is_tightest():
    bins = packing.best_fit([(60, 0, 0), (50, 0, 0), (45, 0, 0), (40, 0, 0)], 100)
    assert bins == [[0, 3], [1, 2]]
    # Copies of one cluster never meet; a source with one bit stands once in a bin.
    assert packing.best_fit([(10, 1, 1), (10, 2, 1), (10, 1, 0)], 100) == [[0], [1, 2]]


def test_pii_mask(docs):
    got = {r.doc_id: r.text for r in pii.mask_pii(docs).collect()}
    assert got[8] == "mail <EMAIL> or <PHONE> from <IP> with <CARD>"
    assert got[0] is None and got[4] == LONG


def test_base_pii(docs):
    rows = [(r[0], r[1]) for r in ROWS]
    got = pii.find_pii(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.base_pii([*rows, rows[8]])))


def test_top_k_odd_vectors(spark):
    vectors = [(0, [0.5, -1.0]), (1, None), (2, []), (3, [math.nan, 1.0]), (4, [None, 1.0]), (5, [2.0**40, 1.0]), (6, [0.25, 0.25]), (7, [0.25, 0.25]), (100, [1.0]), (200, [3.0, -2.0])]
    got = topk.exact_top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(brute.top_k(vectors, lambda q: q % 100 == 0))
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


def test_model_is_normalised():
    p = lblm.parameters(np.log(np.full(6, 1 / 6)))
    near, far, norm = lblm.tables(p)
    total = np.exp(near[3] + far[5] - norm[3, 5]).sum()
    assert abs(total - 1) < 1e-5


def test_pages(spark, model):
    html = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title of it</h1><p>Some words &amp; more of them, long enough to be text.</p></article><script>x()</script></body></html>"
    pages = spark.createDataFrame([(1, "u", html), (2, "u", None), (3, None, ""), (3, None, "<p>cut")], "page_id long, url string, html string")
    got = htmltree.main_text(pages, model).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id == 2} == {""}
    assert htmltree.main_text(pages.where("false"), model).count() == 0


def test_messages_are_marginals(model):
    """Sum-product agrees with sums over all labellings of a small tree."""
    import itertools

    page = htmltree.Page("<div><p>a b c</p><ul><li>d</li></ul></div>")
    forest = htmltree.Forest([page])
    weights, pairs = model
    marginal, _ = forest.messages(weights, pairs)
    score = np.bincount(forest.row, weights[forest.column], len(marginal))
    total, each = 0.0, np.zeros(len(marginal))
    for labels in itertools.product((0, 1), repeat=len(marginal)):
        x = sum(score[k] for k, v in enumerate(labels) if v) + sum(pairs[forest.pair[k]][labels[p], labels[k]] for k, p in enumerate(forest.parent) if p >= 0)
        total += math.exp(x)
        each += math.exp(x) * np.array(labels)
    assert np.allclose(each / total, marginal)


def test_lists_stream_alike_in_any_batches():
    """Short lists give their pairs, long ones their length, wherever batches end."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = sorted((code, code * 1000 + k, int(rng.integers(0, 3)) if code % 3 else 7, 100, 0) for code, size in enumerate((1, 3, 64, 65, 200, 2, 130, 70)) for k in range(size))
    names = ["code", "class", "component", "n", "at"]
    want = set()
    for code in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == code]
        if len({r[2] for r in own}) > 1:
            want |= {(code, None, len(own))} if len(own) > jaccard.SHORT_LIST else {(x[1], y[1], None) for x in own for y in own if x[1] < y[1] and x[2] != y[2]}
    for step in (1, 7, 64, 90, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + step], strict=True)], names=names) for i in range(0, len(rows), step)]
        got = [tuple(r.values()) for b in jaccard._open_lists(iter(batches)) for r in b.to_pylist()]
        assert set(got) == want and len(got) == len(want)
        stars = {tuple(r.values()) for b in jaccard._list_stars(iter([b.select(names[:4]) for b in batches])) for r in b.to_pylist()}
        hub = {c: min(r[1:3] for r in rows if r[0] == c) for c in {r[0] for r in rows}}
        assert stars == {(r[1], hub[r[0]][0]) for r in rows if r[2] != hub[r[0]][1]}
