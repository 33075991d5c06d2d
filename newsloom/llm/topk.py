"""Exact top-k by inner product over a bit-sliced index.

Vectors are cut into blocks of at most ``BLOCK`` rows.  A block keeps each
quantised attribute as bit slices: one bitmap a binary digit, a bit a row
(O'Neil & Quass 1997).  A query's scores over the block are sums of slices: for
each binary digit of the query's values, the attributes whose value has that
digit are added by bitmap arithmetic (carry-save adders; the sums of each group
of four attributes are kept ready), shifted and added up.  The best rows are
selected from the most significant slice downward; rows that stay equal at the
boundary are settled by vec_id, and the chosen rows get their exact scores.

The query set is stated by the caller; it meets the blocks in blocks of its own,
so neither side is ever held whole, and it is broadcast only if its counted rows
are few enough.  A block's slices are built once for all query blocks that it
meets in a task.  Packing needs no shuffle; each pair of
blocks gives k rows a query, and a ranking over those is the result.

Edge cases: vectors that are null, empty, or hold null or non-finite components
take no part, and vectors only meet vectors of their length; fewer than k
candidates give fewer rows; repeated vec_ids are separate rows, and a query skips
every row of its own vec_id; an empty table gives an empty result; columns other
than vec_id and the vector are ignored.  Blocks with quantised components of
2**24 or more are scored by whole numbers without slices, and a score that no
long can hold is the nearest one that it can.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side

BLOCK = 8192
QUERY_BLOCK = 1024
SCALE = 1024
GROUP = 4
LARGE = 1 << 24


def _up(x: np.ndarray) -> np.ndarray:
    """A bit-sliced number times two, in the same width."""
    y = np.zeros_like(x)
    y[1:] = x[:-1]
    return y


def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of two bit-sliced numbers of one width, modulo 2**width."""
    while True:
        x, carry = x ^ y, x & y
        if not carry.any():
            return x
        y = _up(carry)


def add_all(numbers: list[np.ndarray], width: int, words: int) -> np.ndarray:
    """Sum of bit-sliced numbers by carry-save adders and one final addition."""
    total, carry = np.zeros((width, words), np.uint64), np.zeros((width, words), np.uint64)
    for x in numbers:
        part = total ^ carry
        w = len(x)
        over = total & carry
        over[:w] |= part[:w] & x
        part[:w] ^= x
        total, carry = part, _up(over)
    return add(total, carry)


def slices(values: np.ndarray, width: int) -> np.ndarray:
    """(width, words) bitmaps of non-negative integers."""
    bits = np.zeros((width, -(-len(values) // 64) * 64), np.uint8)
    bits[:, : len(values)] = (values[None, :] >> np.arange(width)[:, None]) & 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


class BitSlicedBlock:
    """Bit slices of a block of integer vectors, shifted to be non-negative."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.n, self.dims = vectors.shape
        shifted = vectors - vectors.min()
        width = max(1, int(shifted.max()).bit_length()) + 2
        self.groups = []
        for g in range(0, self.dims, GROUP):
            each = [slices(shifted[:, d], width) for d in range(g, min(g + GROUP, self.dims))]
            sums = [np.zeros_like(each[0])]
            for x in each:  # sums of every subset of the group's attributes
                sums += [add(s, x) if i else x for i, s in enumerate(sums)]
            self.groups.append(sums)
        self.words = self.groups[0][0].shape[1]
        self.width = width + len(self.groups).bit_length()
        self.all = slices(np.ones(self.n, np.int64), 1)[0]

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Slices of the scores in two's complement, all off by one constant."""
        digits = max(abs(int(query.min())), abs(int(query.max()))).bit_length() + 1
        full = self.width + digits + 1
        parts = []
        for j in range(digits):
            chosen = [sum(((int(q) >> j) & 1) << i for i, q in enumerate(query[k * GROUP : k * GROUP + GROUP])) for k in range(len(self.groups))]
            part = np.zeros((full, self.words), np.uint64)
            part[j : j + self.width] = add_all([t[s] for t, s in zip(self.groups, chosen, strict=True) if s], self.width, self.words)
            parts.append(part if j < digits - 1 else ~part)  # the sign digit counts negative
        return add_all(parts, full, self.words)

    def top(self, query: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of rows that are surely among the k best, and of those equal at the boundary."""
        planes = self.scores(query)
        planes[-1] = ~planes[-1]  # negative below positive
        sure, equal, have = np.zeros_like(allowed), allowed.copy(), 0
        for plane in planes[::-1]:
            bigger = equal & plane
            n = int(np.bitwise_count(bigger).sum())
            if have + n > k:
                equal = bigger
            else:
                sure |= bigger
                have += n
                equal &= ~plane
                if have == k:
                    equal = np.zeros_like(equal)
                    break
        return sure, equal


def _set_rows(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])


def best_rows(block: BitSlicedBlock | None, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the block's k best for a query, ties to the smaller id."""
    if block is None:
        rows = np.flatnonzero(ids != query_id)
        score = vectors[rows].astype(object) @ query.astype(object)
        order = sorted(range(len(rows)), key=lambda i: (-score[i], ids[rows[i]]))[:k]
        return rows[order], np.array([max(-(1 << 63), min((1 << 63) - 1, int(score[i]))) for i in order], np.int64)
    allowed = block.all.copy()
    for r in np.flatnonzero(ids == query_id):
        allowed[r // 64] &= ~np.uint64(1 << int(r % 64))
    sure, equal = block.top(query, allowed, k)
    rows, edge = _set_rows(sure, block.n), _set_rows(equal, block.n)
    edge = edge[np.argsort(ids[edge], kind="stable")][: k - len(rows)]
    rows = np.concatenate([rows, edge])
    return rows, vectors[rows] @ query


_PACKED = "dims int, ids binary, vectors binary"


def _pack(most: int):
    """Arrow function: (id, vector) rows to packed blocks, one length a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(dims: int) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dims), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["dims", "ids", "vectors"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begins = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths).tolist():
                some = np.flatnonzero(lengths == dims)
                values = np.floor(SCALE * flat[begins[some][:, None] + np.arange(dims)])
                values = np.clip(values, -(2.0**62), 2.0**62).astype(np.int64)
                for at in range(0, len(some), most):
                    held.setdefault(dims, []).append((ids[some[at : at + most]].astype(np.int64), values[at : at + most]))
                    if sum(len(x[0]) for x in held[dims]) >= most:
                        yield packed(dims)
        for dims in list(held):
            yield packed(dims)

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: tuple = (None, None)  # the last block's bytes and its slices: a block's pairs follow one another
        for batch in batches:
            for r in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if r["dims"] != r["q_dims"]:
                    continue
                ids, query_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                vectors, queries = np.frombuffer(r["vectors"], np.int64).reshape(len(ids), -1), np.frombuffer(r["q_vectors"], np.int64).reshape(len(query_ids), -1)
                large = max(np.abs(vectors).max(), np.abs(queries).max()) >= LARGE
                if not large and built[0] != r["vectors"]:
                    built = r["vectors"], BitSlicedBlock(vectors)
                block = None if large else built[1]
                out: list[list[np.ndarray]] = [[], [], []]
                for q, own in zip(queries, query_ids.tolist(), strict=True):
                    rows, scores = best_rows(block, vectors, ids, q, own, k)
                    for column, x in zip(out, (np.full(len(rows), own, np.int64), ids[rows], scores), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows of vectors for each row where is_query holds."""
    finite = F.forall(F.col(vector_column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & (F.size(vector_column) > 0) & finite)
    part = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    blocks = part.mapInArrow(_pack(BLOCK), _PACKED)
    chosen = rows.where(is_query).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    n, dims = chosen.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    queries = chosen.repartition(max(1, -(-n // QUERY_BLOCK))).mapInArrow(_pack(QUERY_BLOCK), _PACKED).toDF("q_dims", "q_ids", "q_vectors")
    # A stated query set against all rows, both as packed blocks: one row a pair of blocks.
    found = blocks.crossJoin(small_side(queries, n, 8 * (dims + 1))).mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
