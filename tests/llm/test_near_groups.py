"""Large groups of near copies: blocks of long lists against brute force."""

import numpy as np
import pytest

from newsloom.llm import jaccard

from . import brute


def test_common_counts_and_forest():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in rng.integers(1, 40, 50)]
    left, right = np.arange(0, 20), np.arange(10, 50)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    got = jaccard.common_counts(sets, left, right)
    different = left[:, None] != right
    assert (got == want)[different].all()
    near = rng.random((40, 40)) < 0.03
    near |= near.T
    links = jaccard.spanning_forest(near)
    part = np.arange(40)
    for i, j in np.argwhere(near):
        part[part == part[i]] = part[j]
    of_forest = np.arange(40)
    for i, j in links:
        assert near[i, j] and of_forest[i] != of_forest[j]
        of_forest[of_forest == of_forest[i]] = of_forest[j]
    assert {tuple(part == x) for x in part} == {tuple(of_forest == x) for x in of_forest}


@pytest.mark.parametrize("block", [1000, 60])
def test_long_lists(spark, monkeypatch, block):
    """Most pairs of the group lie just below the bound, and links chain it together; copies and repeated rows are among them."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(220):
        words = list(base)
        for at in rng.choice(len(words), 3, replace=False):
            words[at] = f"x{k}-{at}" if rng.random() < 0.7 else f"y{at}"
        texts.append(" ".join(words))
    texts += texts[:5] + ["", None, "a b c"]
    docs = [*enumerate(texts), (3, texts[3]), (3, texts[3])]
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    want = brute.jaccard_components(docs)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == sorted(want)
    parts = {r[2] for r in want}
    assert 5 < len(parts) < 225
