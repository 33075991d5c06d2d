"""Mixture-controlled packing: every id in one piece, no padding, windows at the target proportions."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsloom.llm import mixpack, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, docs, tokenizer, capacity=4096):
    """rows hold every id of docs (doc_id, text; repeated rows allowed) once, in sequences without gaps or padding."""
    want, got = Counter(), Counter()
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.update((doc_id, len(ids), k, int(x)) for k, x in enumerate(ids))
    sequences = defaultdict(list)
    for r in rows:
        ids = np.array(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(ids.tobytes()) == r.ids_crc32
        got.update((r.doc_id, r.doc_tokens, r.start + k, int(x)) for k, x in enumerate(ids))
        sequences[r.sequence_id].append(r)
    assert got == want
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & (at - 1) == 0
    return sequences


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixpack.mixture_pack(docs, PATH, with_ids=True, lane_windows=8).collect()
    sequences = check(rows, [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    total = Counter()
    for r in rows:
        total[r.source] += r.length
    every = sum(total.values())
    for own in (s for s in sequences.values() if sum(r.length for r in s) == 4096):
        held = Counter()
        for r in own:
            held[r.source] += r.length
        assert all(abs(held[s] - 4096 * n / every) < 3 * max(mixpack.LEAST_PIECE, 4096 * n / every) for s, n in total.items())
    # Over any run of windows of a lane the error does not add up: deficits are carried.
    for lane in {r.sequence_id >> 32 for r in rows}:
        sent, tokens = Counter(), 0
        for number in sorted(n for n in sequences if n >> 32 == lane):
            for r in sequences[number]:
                sent[r.source] += r.length
                tokens += r.length
            assert all(abs(sent[s] - tokens * n / every) < 3 * max(mixpack.LEAST_PIECE, 4096 * n / every) for s, n in total.items())


def test_query_has_the_columns(spark):
    got = queries.op12_mixture_controlled_packing(spark, SF)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got.columns)


def test_odd_documents(spark, tokenizer):
    texts = [None, "", " \t\n", "one", "Straße ÉTÉ été don't   x y <|endoftext|> 12 345,6", "long " * 30_000, "same words " * 40, "same words " * 40, "漢字" * 50, "\x00\x1f"]
    rows = [(k if k != 3 else None, t, None if k % 3 == 0 else f"s{k % 3}", 1, "l") for k, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int, lane string")
    check(mixpack.mixture_pack(docs, PATH, with_ids=True, lane_windows=4).collect(), [r[:2] for r in rows], tokenizer)
    check(mixpack.mixture_pack(docs, PATH, capacity=64, with_ids=True).collect(), [r[:2] for r in rows], tokenizer, 64)
    assert mixpack.mixture_pack(docs.where("false"), PATH).count() == 0


def test_stated_proportions(spark):
    """Windows hold the stated shares until a queue runs dry."""
    docs = spark.createDataFrame([(k, "word " * 299, "ab"[k % 2]) for k in range(200)], "doc_id long, text string, source string")
    rows = mixpack.mixture_pack(docs, PATH, capacity=1024, weights={"a": 3, "b": 1}).collect()
    first = Counter()
    for r in rows:
        if r.sequence_id < 30:
            first[r.source] += r.length
    assert abs(first["a"] / first["b"] - 3) < 0.1


def test_windows_are_powers_of_two():
    assert list(mixpack.windows(2 * 16 + 11, 16)) == [16, 16, 8, 2, 1]
    assert list(mixpack.windows(0, 16)) == []
