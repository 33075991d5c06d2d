"""Substring dedup by relative Lempel-Ziv parsing over a distributed reference index.

The reference of a document is every document with a smaller doc_id.  Its index
is cut into blocks by anchor: a window of ``length`` words is filed under its
minimizer, the smallest hash of its ``anchor``-word sequences, so equal windows
meet in one block wherever they stand, and consecutive windows that share an
anchor travel as one row.  A factor (start, words, reference document and start)
is a run of windows that meet, each one step further, the windows of one
reference document: the first that holds the run's first window.  Runs are found
by window hashes and end with a block's windows, where the longest match in some
other document may go on; a document's runs from all blocks are put together from
left to right, the longest next, and runs in step with the same reference become
one factor again.  Words that a factor of at least ``length`` words covers are
the duplicate spans: which words are covered does not depend on how runs are cut.

Scale: windows found twice within a task's chunk stay there (only the first
document's goes to the index); anchors that a large share of the documents hold
would make a hot block, so their windows are filed under the hash of the whole
window instead.  Those anchors are found over all documents first; their number
is at most ``100 / HEAVY_SHARE`` of the mean anchors of a document, which bounds
what is broadcast.  Blocks stream through tasks in key order; texts are shuffled
once, to meet their factors.

Window hashes carry 40 bits beside the anchor's 64 (or 64 and 40 for heavy ones) and
matches are not compared word by word: within a block of n windows about n * n / 2**41
pairs of different windows would meet.

Edge cases: a null or empty text has no words; doc_id must name one text
(repeated rows are repeated in the result, and are no reference for each other);
rows with a null doc_id are kept whole and are no reference; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import Grams, WordHashes, chunks, mixed

LENGTH = 13
ANCHOR = 4
#: Windows in one index row at most.
RUN = 16
#: An anchor is heavy if this share of all documents holds it.
HEAVY_SHARE = 0.004
HASH_BYTES = 5

_INDEX = "key long, doc_id long, start int, windows binary, ref_doc long, ref_start int, n int"
_FACTOR = "doc_id long, start int, n int, ref_doc long, ref_start int"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


class _Windows:
    """Windows of some documents laid end to end: anchors, hashes, documents and positions."""

    def __init__(self, docs: list[list[bytes]], ids: np.ndarray, hashes: WordHashes, length: int, anchor: int) -> None:
        counts = np.fromiter(map(len, docs), np.int64, len(docs))
        grams = Grams(hashes.of([w for d in docs for w in d]))
        ends = np.cumsum(counts)
        n = max(0, grams.n - length + 1)
        self.slot = np.repeat(np.arange(len(docs)), counts)[:n]
        at = np.arange(n)
        keep = np.flatnonzero(at + length <= ends[self.slot])
        self.slot = self.slot[keep]
        self.pos = (keep - (ends - counts)[self.slot]).astype(np.int32)
        self.doc = ids[self.slot]
        self.hash = grams.of(length)[keep] if n else np.zeros(0, np.uint64)
        self.anchor = _sliding_min(grams.of(anchor), length - anchor + 1)[keep] if n else np.zeros(0, np.uint64)


def _repeats(value: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): windows i whose value also stands in a smaller document, and the first window j of the smallest one."""
    order = np.sort(value)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    at = np.searchsorted(twice, value)
    at[at == len(twice)] = 0
    some = np.flatnonzero(twice[at] == value)
    some = some[np.lexsort((pos[some], doc[some], value[some]))]
    v = value[some]
    first = np.concatenate([[True], v[1:] != v[:-1]])
    lead = some[np.flatnonzero(first)[np.cumsum(first) - 1]]
    later = doc[some] > doc[lead]
    return some[later], lead[later]


def _factors(row: np.ndarray, doc: np.ndarray, pos: np.ndarray, ref_doc: np.ndarray, ref_pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows in step with their reference: doc, start, words, reference document and start."""
    order = np.lexsort((pos, row))
    row, doc, pos, ref_doc, ref_pos = (x[order] for x in (row, doc, pos, ref_doc, ref_pos))
    if not len(row):
        return doc, pos, pos, ref_doc, ref_pos
    cut = np.concatenate([[True], (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1) | (ref_doc[1:] != ref_doc[:-1]) | (ref_pos[1:] != ref_pos[:-1] + 1)])
    at = np.flatnonzero(cut)
    n = np.diff(np.append(at, len(row)))
    return doc[at], pos[at], n.astype(np.int32), ref_doc[at], ref_pos[at]


def _filed(length: int, anchor: int, heavy: np.ndarray):
    """Arrow function: (doc_id, text) to index rows, and factors found within a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, some in chunks(batch.column(1)):
                w = _Windows([t.split() for t in some], ids[a:b], hashes, length, anchor)
                if not len(w.doc):
                    continue
                i, j = _repeats(w.hash, w.doc, w.pos)
                doc, start, n, ref_doc, ref_start = _factors(w.slot[i], w.doc[i], w.pos[i], w.doc[j], w.pos[j])
                if len(doc):
                    none = pa.nulls(len(doc))
                    yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), pa.array(doc), pa.array(start), none.cast(pa.binary()), pa.array(ref_doc), pa.array(ref_start), pa.array(n)], names=_names(_INDEX))
                rest = np.ones(len(w.doc), bool)
                rest[i] = False
                rest = np.flatnonzero(rest)
                slot, pos, key, value = w.slot[rest], w.pos[rest], w.anchor[rest], w.hash[rest]
                hot = np.isin(key, heavy) if len(heavy) else np.zeros(len(rest), bool)
                key = np.where(hot, mixed(value, 1), key)
                cut = np.ones(len(rest), bool)
                cut[1:] = (key[1:] != key[:-1]) | (slot[1:] != slot[:-1]) | (pos[1:] != pos[:-1] + 1)
                at = np.flatnonzero(cut)
                since = np.arange(len(rest)) - at[np.cumsum(cut) - 1]
                at = np.flatnonzero(cut | (since % RUN == 0))
                data = np.ascontiguousarray(value.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
                offsets = (np.append(at, len(rest)) * HASH_BYTES).astype(np.int32)
                windows = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                none = pa.nulls(len(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[at].view(np.int64)), pa.array(w.doc[rest[at]]), pa.array(pos[at]), windows, none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int32())],
                    names=_names(_INDEX),
                )

    return run


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _anchor_counts(length: int, anchor: int):
    """Arrow function: anchors that at least half a heavy share of a chunk's documents hold, with that number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids = np.zeros(batch.num_rows, np.int64)
            for a, b, some in chunks(batch.column(1)):
                w = _Windows([t.split() for t in some], ids[a:b], hashes, length, anchor)
                new = np.ones(len(w.doc), bool)
                new[1:] = (w.anchor[1:] != w.anchor[:-1]) | (w.slot[1:] != w.slot[:-1])
                value = np.sort(w.anchor[new])
                at = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
                n = np.diff(np.append(at, len(value)))
                often = n >= max(3, (b - a) * HEAVY_SHARE / 2)
                yield pa.RecordBatch.from_arrays([pa.array(value[at][often].view(np.int64)), pa.array(n[often])], names=["anchor", "n"])

    return run


def heavy_anchors(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """Hashes of the anchors that about HEAVY_SHARE of all documents hold.

    Which anchors count as heavy only decides where windows meet, never which.
    """
    n = docs.count()
    counts = docs.mapInArrow(_anchor_counts(length, anchor), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= max(8, n * HEAVY_SHARE)).select("anchor").collect()
    return np.sort(np.array([r.anchor for r in found], np.int64).view(np.uint64))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows in key order to factors; the last key of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []

    def solve(table: pa.Table) -> pa.RecordBatch | None:
        key = table.column("key").to_numpy()
        cut = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(cut) - 1
        some = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(some):
            return None
        windows = table.column("windows").combine_chunks()
        windows = (windows.chunk(0) if isinstance(windows, pa.ChunkedArray) else windows).take(pa.array(some))
        offsets = np.frombuffer(windows.buffers()[1], np.int32)[windows.offset : windows.offset + len(some) + 1]
        data = np.frombuffer(windows.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, HASH_BYTES)
        count = np.diff(offsets) // HASH_BYTES
        value = np.zeros((len(data), 8), np.uint8)
        value[:, :HASH_BYTES] = data
        row = np.repeat(np.arange(len(some)), count)
        value = value.view(np.uint64).ravel() | (group[some][row].astype(np.uint64) << np.uint64(8 * HASH_BYTES))
        doc = table.column("doc_id").to_numpy()[some][row]
        pos = table.column("start").to_numpy()[some][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        i, j = _repeats(value, doc, pos)
        out = _factors(row[i], doc[i], pos[i], doc[j], pos[j])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=_names(_FACTOR)) if len(out[0]) else None

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1])) if held or len(key) else 0
        if last:
            table = pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
            if (out := solve(table)) is not None:
                yield out
        held.append(batch.slice(last))
    if held and (out := solve(pa.Table.from_batches(held))) is not None:
        yield out


def factors(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, start, n (windows), ref_doc, ref_start: what parsing against the blocks of the index finds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    heavy = heavy_anchors(rows, length, anchor)
    filed = rows.mapInArrow(_filed(length, anchor, heavy), _INDEX)
    near = filed.where(F.col("key").isNull()).select(*_names(_FACTOR))
    index = filed.where(F.col("key").isNotNull()).select("key", "doc_id", "start", "windows")
    far = index.repartition("key").sortWithinPartitions("key").mapInArrow(_parsed, _FACTOR)
    return near.unionByName(far)


def greedy(found: np.ndarray, n_words: int, length: int) -> list[tuple[int, int, int, int]]:
    """(start, words, ref_doc, ref_start) of the greedy parse; found: rows start, windows, ref_doc, ref_start.

    At each word the factor that reaches furthest is taken.  A window that
    straddles the boundary of two factors but belongs to a third one is among
    the rows too, so the next factor may begin before the last one ends.
    """
    out: list[tuple[int, int, int, int]] = []
    done = 0
    for start, n, ref_doc, ref_start in found[np.lexsort((-found[:, 1], found[:, 0]))].tolist():
        end = min(start + n + length - 1, n_words)
        if end <= done:
            continue
        if out and out[-1][2] == ref_doc and out[-1][3] - out[-1][0] == ref_start - start and start <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], end - out[-1][0], ref_doc, out[-1][3])
        else:
            out.append((start, end - start, ref_doc, ref_start))
        done = end
    return out


_CLEAN = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:int,n:int,ref_doc:long,ref_start:int>>"


def _cleaned(length: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])))])
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            table = np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], 1) if len(flat) else np.zeros((0, 4), np.int64)
            sizes = np.array([x or 0 for x in lists.value_lengths().to_pylist()], np.int64)
            ends = np.cumsum(sizes)
            for a, b, some in chunks(batch.column(1)):
                cols: list[list] = [[] for _ in schema]
                for k, text in enumerate(some, a):
                    words = text.split()
                    spans = greedy(table[ends[k] - sizes[k] : ends[k]], len(words), length) if sizes[k] else []
                    kept, at = [], 0
                    for start, n, _, _ in spans:
                        kept += words[at:start]
                        at = max(at, start + n)
                    kept += words[at:]
                    joined = b" ".join(kept)
                    row = (batch.column(0)[k].as_py(), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if whole else None, [dict(zip(("start", "n", "ref_doc", "ref_start"), x)) for x in spans] if whole else None)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def substring_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, whole: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (text) and spans for every row of docs; whole=False leaves the last two null."""
    found = factors(docs, length, anchor).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "ref_doc", "ref_start")).alias("found"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(found, "doc_id", "left")
    return joined.select("doc_id", "text", "found").mapInArrow(_cleaned(length, whole), _CLEAN)
