"""Conflict-constrained best-fit packing of documents into fixed-size sequences.

Sizes are words.  A document longer than a bin fills whole bins and leaves a
remainder.  The rest is packed by best fit, largest first: bins stand in order
of what is left in them, and each carries a bitmap of its sources and one of its
duplicate clusters.  A piece goes to the successor of its size, the bin that it
would fill best; if that bin already has its source or its cluster, the search
continues to the next, until the tightest compatible bin is found, else a bin is
opened.  Pieces of equal text share a cluster (or the caller names a column of
near-duplicate clusters), so copies never meet in a bin.  A source has
``SOURCE_PIECES`` bits of the bitmap and each of its pieces takes one: no bin
holds more pieces of a source than that, whatever the counts.  With a single bit,
a source with a third of all rows would leave most bins nearly empty.

Pieces are dealt to packers by hash, so many that each gets about
``PACKER_WORDS`` words and ``PACKER_PIECES`` pieces at most: a packer's memory
and the bins that a search passes are bounded and packers run in parallel, at
the price of a few part-filled bins each.  Only ids and sizes are shuffled.

Edge cases: null and empty texts have no pieces; a null source is a source of
its own; repeated rows are separate pieces of one cluster; an empty table gives
no bins; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_count

CAPACITY = 2048
#: Pieces of one source that a bin holds at most.
SOURCE_PIECES = 8
PACKER_WORDS = 4_000_000
PACKER_PIECES = 10_000


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[list[int]]:
    """Bins as lists of positions in pieces; pieces: (size, bits of the source, cluster bit), 0 for none, sizes not rising.

    A piece takes one of its source's bits that the bin has free.
    """
    left: list[tuple[int, int]] = []  # (residual, bin), rising
    sources: list[int] = []
    clusters: list[int] = []
    bins: list[list[int]] = []
    for k, (size, source, cluster) in enumerate(pieces):
        at = bisect_left(left, (size, -1))
        while at < len(left):
            b = left[at][1]
            if not clusters[b] & cluster and (not source or source & ~sources[b]):
                break
            at += 1
        if at < len(left):
            residual, b = left.pop(at)
        else:
            residual, b = capacity, len(bins)
            bins.append([])
            sources.append(0)
            clusters.append(0)
        bins[b].append(k)
        free = source & ~sources[b]
        sources[b] |= free & -free
        clusters[b] |= cluster
        if residual > size:
            insort(left, (residual - size, b))
    return bins


def _source_bits(values: list, pieces: int) -> list[int]:
    """So many bits for each distinct value, in order of first sight."""
    number: dict = {}
    return [((1 << pieces) - 1) << pieces * number.setdefault(v, len(number)) for v in values]


def _cluster_bits(values: list) -> list[int]:
    """A bit for each value that stands more than once, in order of first sight; 0 for the others."""
    count: dict = {}
    for v in values:
        count[v] = count.get(v, 0) + 1
    number: dict = {}
    out = []
    for v in values:
        out.append(0 if count[v] == 1 else 1 << number.setdefault(v, len(number)))
    return out


_BINS = "packer int, bin int, n_words long, doc_ids array<long>, starts array<int>, sizes array<int>"
_SCHEMA = pa.schema([("packer", pa.int32()), ("bin", pa.int32()), ("n_words", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])


def _packer(capacity: int, source_pieces: int):
    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["size", "doc_id", "start", "source", "cluster"]).to_pylist(), key=lambda r: (-r["size"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["cluster"]))
        full = [[k] for k, r in enumerate(rows) if r["size"] == capacity]
        rest = rows[len(full) :]
        pieces = list(zip([r["size"] for r in rest], _source_bits([r["source"] for r in rest], source_pieces), _cluster_bits([r["cluster"] for r in rest]), strict=True))
        bins = full + [[len(full) + k for k in b] for b in best_fit(pieces, capacity)]
        of = lambda b, c: [rows[k][c] for k in b]
        out = [[key[0].as_py()] * len(bins), list(range(len(bins))), [sum(of(b, "size")) for b in bins], [of(b, "doc_id") for b in bins], [of(b, "start") for b in bins], [of(b, "size") for b in bins]]
        return pa.table([pa.array(x, f.type) for x, f in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)

    return pack


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, source_pieces: int = SOURCE_PIECES, packer_words: int = PACKER_WORDS, packer_pieces: int = PACKER_PIECES, cluster: str | None = None) -> DataFrame:
    """packer, bin, n_words, and the doc_ids, first words and sizes of a bin's pieces.

    source_pieces: pieces of a source a bin holds at most, 0 for no limit; cluster: a column of duplicate clusters in
    place of equal texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(cluster or "text").alias("cluster"), word_count(F.col("text")).alias("words"))
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    total = rows.agg(zero("words").alias("words"), zero(F.ceil(F.col("words") / capacity)).alias("pieces")).first()
    packers = max(1, -(-total.words // packer_words), -(-total.pieces // packer_pieces))
    starts = F.sequence(F.lit(0), F.floor((F.col("words") - 1) / capacity).cast("int"))
    pieces = rows.where("words > 0").withColumn("k", F.explode(starts)).select(
        "doc_id", "source", "cluster", (F.col("k") * capacity).cast("int").alias("start"),
        F.least(F.lit(capacity), F.col("words") - F.col("k") * capacity).cast("int").alias("size"),
    )
    # By row content alone, so a task that runs again deals alike.
    dealt = pieces.withColumn("packer", F.pmod(F.xxhash64("doc_id", "start", "cluster"), F.lit(packers)).cast("int"))
    return dealt.groupBy("packer").applyInArrow(_packer(capacity, source_pieces), _BINS)
