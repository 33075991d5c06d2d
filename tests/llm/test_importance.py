"""Importance resampling against brute force, and its edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import importance

SCHEMA = "doc_id long, text string, rank string, score int, weight string, bin string, source string"


def brute(docs, target, percent=5, min_words=20):
    def grams(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % 10000
    own, s, t = [grams(x) for _, x in docs], Counter(), Counter()
    for _, g in own:
        s.update(map(bucket, g))
    for x in target:
        t.update(map(bucket, grams(x)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for (i, _), (n, g) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in g)
        out.append([i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(str, map(tuple, out)))


def found(spark, docs, target, **how):
    rows = spark.createDataFrame([(i, t, "r", 1, "w", "b", "s") for i, t in docs], SCHEMA)
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    return sorted(map(str, map(tuple, importance.importance_resample(rows, items, **how).collect())))


def test_odd_texts(spark):
    words = [f"w{k}" for k in range(30)]
    long = " ".join(f"W{k % 997}x{k % 31}" for k in range(30_000))
    texts = [None, "", " \t!?", "one", long, long, "Ünïcode 漢字 naïve " * 9, "x" * 5000 + " y " + "é" * 300, "a\x00b\x7fc", *(" ".join(words[k % 7 :]) for k in range(60)), None]
    docs = [(k if k != 8 else None, t) for k, t in enumerate(texts)] + [(5, long), (20, " ".join(words))]
    target = ["w1 w2 w3 w4 " * 5, None, "", "naïve 漢字"]
    assert found(spark, docs, target, percent=40) == brute(docs, target, percent=40)
    assert found(spark, docs, [], percent=100) == brute(docs, [], percent=100)


def test_small_and_empty_tables(spark):
    docs = [(1, "a b c"), (2, "d " * 25)]
    assert found(spark, docs, ["a"]) == brute(docs, ["a"])
    assert found(spark, [], ["a"]) == []


def test_equal_scores_and_wide_ranges(spark):
    """Ranks are those of a plain sort, with ties, over stretches of any width."""
    rng = random.Random(3)
    for spread in (3, 1000, 10**9):
        rows = [(rng.choice([None, *range(500)]), rng.randint(-spread, spread)) for _ in range(2000)]
        scored = spark.createDataFrame(rows, "doc_id long, score long")
        top = importance.ranked(scored, 700, min(r[1] for r in rows), max(r[1] for r in rows), lambda d, _: d.cache())
        got = sorted(((r["rank"], r.score, r.doc_id) for r in top.collect() if r["rank"] is not None), key=lambda r: r[0])
        order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:700]
        assert got == [(k + 1, s, i) for k, (i, s) in enumerate(order)]


def test_crc_of_runs_is_composed():
    texts = ["a bb " + "c" * 70 + " d", "é" * 5000 + " f g", "", None, "h"]
    got = Counter()
    for begin, _, _, runs in importance.features(pa.array(texts), 1 << 31):
        for doc, bucket in runs:
            got.update(zip((doc + begin).tolist(), bucket.tolist(), strict=True))
    want = Counter()
    for k, t in enumerate(texts):
        w = (t or "").split()
        want.update((k, zlib.crc32(" ".join(w[i : i + n]).encode()) % (1 << 31)) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert got == want
    assert importance.shifted(np.array([7], np.uint32), np.array([0]))[0] == 7


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(k, f"t{k} " * 20, "r", k, "w", "b", None) for k in range(40)], SCHEMA)
    target = spark.createDataFrame([(1, "t3 " * 50)], "item_id long, text string")
    got = importance.resampled_documents(docs, target)
    assert got.columns == docs.columns and got.count() == 2


@pytest.mark.parametrize("percent", [0, 100])
def test_whole_share(spark, percent):
    docs = [(k, f"t{k} " * 20) for k in range(10)]
    assert found(spark, docs, ["t3"], percent=percent) == brute(docs, ["t3"], percent=percent)
