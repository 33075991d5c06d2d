"""The prefix trie against brute force, however rows are cut into partitions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, words int, parent_conv_id string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, heads=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, key, (role or "", text or "")))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    built = {c: (own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + t[h:]) for c, t in own.items()} if heads else own
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    total = {}
    for path in sorted(members, key=len, reverse=True):
        saved = (len(members[path]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        total[path] = (sum(total[k][0] for k in children[path]) if children[path] else 1, saved + sum(total[k][1] for k in children[path]))
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p)).encode()).hexdigest()
    return sorted(str((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *total[p], ends(p))) for p, m in members.items())


def got(spark, rows, heads=True, **how):
    table = spark.createDataFrame([(*r, "d", 1, "p") for r in rows], SCHEMA)
    arrays = trie.turn_arrays(table)
    return sorted(str(tuple(r)) for r in trie.prefix_trie(trie.with_common_heads(arrays) if heads else arrays, **how).select(*COLUMNS).collect())


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_random_tries(spark, parts):
    rng = random.Random(parts)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a b", "c", None, "d e f"])) for c in range(150) for t in range(rng.randint(1, 6)) if rng.random() < 0.9]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert got(spark, rows) == brute(rows)
        assert got(spark, rows, heads=False) == brute(rows, heads=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_large_group_over_many_partitions(spark):
    """Equal conversations and one long one: ids that end at a node are hashed in order over partitions."""
    rows = [(c, t, "user", f"turn {t} of all") for c in range(300) for t in range(3)] + [(1000, t, "user", f"turn {t} of all") for t in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        assert got(spark, rows, heads=False) == brute(rows, heads=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, 1, "a", "b"), (7, 1, "a", "b"), (7, 1, "ab", ""), (9, 5, "", "w " * 100_000), (9, None, "s", "t"), (40, 1, "user", "hi"), (41, 0, "user", "hi"), (55, 0, "u", "t")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, rows[:1]) == []


def test_pieces_stitch_alike_wherever_rows_are_cut():
    rng = random.Random(9)
    paths = sorted((bytes([rng.randint(0, 1)]) * 16 * rng.randint(0, 2) + bytes([rng.randint(0, 2)]) * 16, c) for c in range(60))
    rows = [(c, k, [1] * (len(k) // 16)) for k, c in paths]
    want = None
    for cuts in ([], [30], [1, 2, 3], [10, 11, 40, 59], list(range(1, 60))):
        parts = [rows[i:j] for i, j in zip([0, *cuts], [*cuts, 60], strict=True)]
        swept = [r for p, own in enumerate(parts) for r in trie.sweep(iter(own), p)]
        names = ("kind", "part", "side", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "turn", "words", "stays")
        pieces = sorted((dict(zip(names, r, strict=True)) for r in swept if r[0] == trie.OPEN), key=lambda p: (p["part"], p["side"], p["depth"]))
        nodes = [(r[4], r[5], r[6], r[7], r[8], r[9]) for r in trie.stitch(iter(pieces)) if r[2] is None]
        nodes += [(r[3], r[4], *r[6:10]) for r in swept if r[0] != trie.OPEN]
        want = want or sorted(nodes)
        assert sorted(nodes) == want


def test_query_is_rebuilt_by_the_contract(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in range(45) for t in range(4)]
    table = spark.createDataFrame([(*r, "d", 1, "p") for r in rows], SCHEMA)
    rebuilt = {r.conv_id: len(r.turns) for r in trie.with_common_heads(trie.turn_arrays(table)).withColumn("turns", F.col("turns.key")).collect()}
    assert set(rebuilt.values()) == {4} and len(rebuilt) == 45
