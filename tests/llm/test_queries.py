"""Registered queries on whole small tables, against brute force and DuckDB."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from newsloom.llm import queries

from . import brute

SF = "/root/testdata/sf0.001"
BY_NUMBER = {int(re.match(r"op(\d+)_", n)[1]): f for n, f in queries.QUERIES.items()}


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()]


def rows(spark, number, *columns):
    return [tuple(r) for r in BY_NUMBER[number](spark, SF).select(*columns).collect()]


def test_every_operator_has_a_query():
    assert sorted(BY_NUMBER) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    names, want = [c[0] for c in found.description], found.fetchall()
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    tidy = lambda rows: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert tidy(map(tuple, got.select(*names).collect())) == tidy(want)


def test_substring_dedup(spark, documents):
    want = brute.substring_dedup([(i, t) for i, _, t in documents])
    assert sorted(rows(spark, 1, "doc_id", "n_words", "n_removed", "kept_sha256")) == sorted(want)
    assert sum(r[2] for r in want) > 0


def test_main_text(spark):
    got = BY_NUMBER[2](spark, SF).toPandas()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert sorted(got.page_id) == sorted(pages)
    for r in got.itertuples():
        assert r.n_chars == len(r.text) and "<p>" not in r.text and "  " not in r.text
    assert (got.n_chars > 0).mean() > 0.99


def test_line_frequency(spark, documents):
    want = brute.line_frequency(documents)
    got = rows(spark, 3, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted(got) == sorted(want)


def test_packing(spark, documents):
    sizes = {i: len(brute.words(t)) for i, _, t in documents}
    text = {i: t for i, _, t in documents}
    got = BY_NUMBER[4](spark, SF).collect()
    covered = Counter()
    for r in got:
        assert r.n_words == sum(r.sizes) <= 2048
        assert len({text[i] for i in r.doc_ids}) == len(r.doc_ids)
        for i, start, n in zip(r.doc_ids, r.starts, r.sizes, strict=True):
            assert start % 2048 == 0 and start + n <= sizes[i]
            covered[i] += n
    assert covered == Counter({i: n for i, n in sizes.items() if n})
    assert sum(sizes.values()) > 0.85 * 2048 * len(got)


def test_scores(spark, documents):
    want = sorted(brute.base_score([(i, t) for i, _, t in documents]))
    got = sorted(rows(spark, 5, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    held = [r for r in got if r[1]]
    # The model beats the smoothed counts on texts that it has not seen.
    assert sum(r[6] for r in held) > sum(r[5] for r in held)
    assert all(np.isfinite(r[6]) and r[6] < 0 for r in got)


def test_jaccard_components(spark, documents):
    want = brute.jaccard_components([(i, t) for i, _, t in documents])
    assert sorted(rows(spark, 6, "doc_id", "n_shingles", "component_id")) == sorted(want)
    assert any(r[0] != r[2] for r in want)


def test_mix(spark, documents):
    got = rows(spark, 7, "doc_id", "size", "source_size", "target", "taken")
    size, source = ({i: x for i, x in ((i, f(s, t)) for i, s, t in documents)} for f in (lambda s, t: len(brute.words(t)), lambda s, t: s))
    of = Counter()
    for i, n in size.items():
        of[source[i]] += n
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(of))}
    free, total = dict(weight), 1.5 * sum(of.values())
    target = {}
    while free:  # what is above a cap goes to the others
        rest = (total - sum(target.values())) / sum(free.values())
        over = {s for s, w in free.items() if w * rest > 2 * of[s]}
        if not over:
            target |= {s: w * rest for s, w in free.items()}
            break
        target |= {s: 2.0 * of[s] for s in over}
        free = {s: w for s, w in free.items() if s not in over}
    taken, longest = Counter(), defaultdict(int)
    for i, n, source_size, want, t in got:
        assert n == size[i] and source_size == of[source[i]] and want == pytest.approx(target[source[i]])
        assert 0 <= t <= 2 * n and (n == 0 or t % n == 0)
        taken[source[i]] += t
        longest[source[i]] = max(longest[source[i]], n)
    assert len(got) == len(size)
    for s, want in target.items():
        assert abs(taken[s] - want) <= longest[s]
    assert sorted(got) == sorted(rows(spark, 7, "doc_id", "size", "source_size", "target", "taken"))


def test_top_k(spark):
    vectors = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(rows(spark, 8, "query_id", "rank", "vec_id", "score")) == sorted(brute.top_k(vectors, lambda q: q % 100 == 0))


def test_shards(spark, documents):
    text = {i: t or "" for i, _, t in documents}
    got = rows(spark, 9, "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert sorted(r[0] for r in got) == sorted(text)
    load, slots = Counter(), defaultdict(list)
    for i, size, crc, law, shard, slot, grown in got:
        assert size == len(text[i].encode()) + 8 and crc == zlib.crc32(text[i].encode()) and law == "bytes" and grown is None
        load[shard] += size
        slots[shard].append(slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean = sum(load.values()) / 24
    assert max(abs(load[s] - mean) for s in range(24)) <= max(len(t.encode()) for t in text.values()) + 8


def test_base_pii(spark, documents):
    want = brute.base_pii([(i, t) for i, _, t in documents])
    got = rows(spark, 10, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    assert sorted(r[:6] for r in got) == sorted(want)
    text = {i: t for i, _, t in documents}
    for r in got:
        for span in filter(None, r[6].split(",")):
            kind, a, b = span.split(":")
            assert 0 <= int(a) < int(b) <= len(text[r[0]])
