"""Two-level log-bilinear model: probabilities add up, and words beyond the most frequent have vectors of their own."""

import random

import numpy as np

from newsloom.llm import lblm


def test_two_levels_are_normalised():
    rng = np.random.default_rng(1)
    counts = np.sort(rng.integers(5, 5000, 300))[::-1]
    kinds = lblm.Classes(counts)
    assert len(kinds.of) == 302 and kinds.size.sum() == 302 and kinds.size[:2].tolist() == [1, 1] and kinds.size.max() > 1
    p = lblm.parameters(rng.normal(size=len(kinds.size)), rng.normal(size=302))
    p["inner"] = rng.normal(size=p["inner"].shape).astype(np.float32)
    slots = np.arange(302)
    total = np.exp(lblm.log_probabilities(p, kinds, slots, np.full(302, 7), np.full(302, 300))).sum()
    assert abs(total - 1) < 1e-4


def test_classes_alone_agree_with_tables():
    p = lblm.parameters(np.log(np.arange(1, 7) / 21))
    kinds = lblm.Classes(np.ones(4))
    kinds.of, kinds.size, kinds.first = np.arange(6), np.ones(6, int), np.arange(6)
    near, far, norm = lblm.tables(p)
    got = lblm.log_probabilities(p, kinds, np.arange(6), np.full(6, 3), np.full(6, 5))
    assert np.allclose(got, near[3] + far[5] - norm[3, 5], atol=1e-4)


def test_words_beyond_the_most_frequent_know_their_context(spark):
    """1,500 pairs of words: the second follows the first, though 1,500 words are as frequent or more."""
    r = random.Random(2)
    texts = [" ".join(f"a{k} b{k}" for k in r.choices(range(1500), k=60)) for _ in range(2000)]
    right = " ".join(f"a{k} b{k}" for k in range(0, 1500, 10))
    wrong = " ".join(f"a{k} b{(k + 750) % 1500}" for k in range(0, 1500, 10))
    rows = [*enumerate(texts, 10_000), (1, right), (2, wrong)]
    got = {x.doc_id: x.score for x in lblm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 10").collect()}
    assert got[1] > got[2] + 10


def test_floor_rises_with_the_histogram(spark):
    counts = spark.createDataFrame([("", 50), *[(f"w{k}", 1 + k // 10) for k in range(100)]], "word string, n long")
    top = lblm.frequent_words(counts, 5, 1000)
    assert len(top) == 60 and top[0] == ("w90", 10)
    assert len(lblm.frequent_words(counts, 5, 25)) == 20
