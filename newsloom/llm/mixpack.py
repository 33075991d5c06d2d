"""Mixture-controlled packing: deficit round-robin over source queues fills fixed-size windows of tokens.

Every source has a queue of its documents' tokens and a quantum, its target share
of a window.  Each round (a window) adds a source's quantum to its deficit; a
source is due once its deficit covers its next piece, which is what is left of its
head document or, if that is long, one quantum (``LEAST_PIECE`` tokens at least).
Due sources send in the order in which they came due, the piece that meets the
end of a window is cut there and goes on in the next one, and a window that due
sources leave unfilled takes from the source that comes due next.  What was sent
is subtracted, so a source that was cut short or went ahead carries its deficit
into the windows that follow.  Sources are kept in a heap by the window in which
they come due: a window costs its pieces, however many sources wait.

Queues are dealt to partitions ("lanes") by closed form.  With S tokens in a
source and P lanes, lane p holds the source's tokens floor(p S / P) to
floor((p + 1) S / P): each lane has the corpus mixture, and the fraction of a
token by which the quota is ahead of what the lanes before it sent is the deficit
that it starts with.  So deficits carry from lane to lane without one waiting for
another.  A target other than the corpus mixture (``weights``) holds until a
source's share of a lane is used up; the others then share its place.

Nothing is padded: the last windows of a lane are the powers of two that add up to
its remainder.  Tokens are made once, as the ids of each distinct word of a
stretch of texts, and written with the place of each document in its source's
queue; they are shuffled once, to their lane.

Edge cases: a null or empty text is the end token alone; a null source is a source
of its own; repeated rows are documents of their own; an empty table gives no
pieces; a document of any length is cut over as many windows and lanes as it
fills; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, small_side, written
from .ngrams import ranges

CAPACITY = 4096
END = 2
LEAST_PIECE = 128
LANE_WINDOWS = 512
CHUNK_BYTES = 4_000_000
#: Words whose ids a worker remembers.
CACHE_WORDS = 400_000
#: Words in one call of the tokenizer.
CALL_WORDS = 1000


class WordIds(dict):
    """Ids of a word as little-endian bytes, remembered as long as a worker lives; any tokenizer whose pieces never cross white space will do.

    Where the tokenizer marks the last id of each piece that a text is cut into, words of plain characters are encoded side
    by side in one text, without normalising it again, and told apart by their numbers of pieces.  Their sum is checked: where it is another than that of
    the marked ids, the words go one by one.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = _kind(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.closes[[k for token, k in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def _cut(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw = ids.astype(self.kind).tobytes()
        ends = (ends * self.kind.itemsize).tolist()
        found = [raw[begin:end] for begin, end in zip([0, *ends[:-1]], ends, strict=True)]
        self.update(zip(words, found, strict=True))
        return found

    def learn(self, words: list[str], pieces: np.ndarray | None) -> list[bytes]:
        """Ids of words that are not known yet; pieces: of each word of plain characters."""
        if len(self) + len(words) > CACHE_WORDS:
            self.clear()
        out: list[bytes] = []
        for k in range(0, len(words), CALL_WORDS):
            some = words[k : k + CALL_WORDS]
            if pieces is not None:
                ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
                ends = np.flatnonzero(self.closes[ids]) + 1
                count = np.cumsum(pieces[k : k + CALL_WORDS])
                if len(ends) == count[-1] and ends[-1] == len(ids):
                    out += self._cut(some, ids, ends[count - 1])
                    continue
            found = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            out += self._cut(some, np.array(found.ids, np.int64), np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(some)), "right"))
        return out


#: ASCII and Latin-1 letters: in lower case they are what any normaliser of case, composition and white space leaves of them.
PLAIN = r"^[\x21-\x7EÀ-ÖØ-öø-ÿ]+$"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Taken off behind a letter before a word is looked up.
TAILS = (".", ",")
SPECIAL = "<|"


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of some stretches of n places, end to end."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def _encoded(words: pa.Array, ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some words laid end to end, and how many each has."""
    plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, SPECIAL)))
    low = pc.utf8_lower(words)
    tailed = pc.and_(plain, pc.match_substring_regex(low, r"\p{L}[.,]$"))
    cores = pc.if_else(plain, pc.if_else(tailed, pc.utf8_slice_codeunits(low, 0, -1), low), words).dictionary_encode()
    told = tailed.to_numpy(zero_copy_only=False)
    at = cores.indices.to_numpy()
    of_plain = np.zeros(len(cores.dictionary), bool)
    of_plain[at] = plain.to_numpy(zero_copy_only=False)
    names = [*cores.dictionary.to_numpy(zero_copy_only=False).tolist(), *TAILS]
    pieces = list(map(ids.get, names))
    new = np.array([k for k, piece in enumerate(pieces) if piece is None], np.int64)
    known = new < len(of_plain)
    is_plain = np.zeros(len(new), bool)
    is_plain[known] = of_plain[new[known]]
    for some, count in ((new[is_plain], pc.count_substring_regex(cores.dictionary.take(pa.array(new[is_plain])), PIECE).to_numpy()), (new[~is_plain], None)):
        for k, piece in zip(some.tolist(), ids.learn([names[k] for k in some.tolist()], count), strict=True):
            pieces[k] = piece
    flat = np.frombuffer(b"".join(pieces), ids.kind)
    n = np.fromiter(map(len, pieces), np.int64, len(pieces)) // ids.kind.itemsize
    start = np.cumsum(n) - n
    # A word is its core and, maybe, its tail: two stretches.
    stretch = np.full((len(words), 2), -1)
    stretch[:, 0] = at
    for k, t in enumerate(TAILS):
        stretch[told & pc.ends_with(words, t).to_numpy(zero_copy_only=False), 1] = len(of_plain) + k
    size = np.where(stretch >= 0, n[stretch], 0)
    return flat[_spread(start[stretch].ravel(), size.ravel())], size.sum(axis=1)


_KNOWN: dict[str, WordIds] = {}


@cache
def _kind(path: str) -> np.dtype:
    """Two bytes an id where the vocabulary allows it."""
    from tokenizers import Tokenizer

    return np.dtype("<u2") if Tokenizer.from_file(path).get_vocab_size() <= 65536 else np.dtype("<u4")


def token_ids(column: pa.Array, ids: WordIds, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each stretch of texts: begin, end, ids laid end to end, and where each text's ids end."""
    for first, last in ranges(column, CHUNK_BYTES):
        parts = pc.ascii_split_whitespace(pc.fill_null(column.slice(first, last - first), ""))
        words = parts.values.dictionary_encode()
        flat, length = _encoded(words.dictionary, ids)
        at = words.indices.to_numpy()
        n = length[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        tokens = flat[_spread((np.cumsum(length) - length)[at], n)]
        # One end token after each text.
        close = ends[parts.offsets.to_numpy()[1:] - parts.offsets.to_numpy()[0]]
        yield first, last, np.insert(tokens, close, end).astype(ids.kind), close + np.arange(1, len(close) + 1)


_DOCS = "doc_id long, source string, part int, before long, n long, ids binary"
_DOCS_ARROW = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def _tokeniser(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if path not in _KNOWN:
            _KNOWN[path] = WordIds(path)
        ids, part = _KNOWN[path], TaskContext.get().partitionId()
        sent: dict[str, int] = {}
        for batch in batches:
            for first, last, tokens, ends in token_ids(batch.column("text"), ids, end):
                raw, starts = tokens.tobytes(), np.concatenate([[0], ends[:-1]])
                sources, before = batch.column("source").slice(first, last - first), []
                for source, n in zip(sources.to_pylist(), (ends - starts).tolist(), strict=True):
                    before.append(sent.get(source, 0))
                    sent[source] = before[-1] + n
                offsets = np.concatenate([[0], ends]) * ids.kind.itemsize
                stored = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw)])
                columns = [batch.column("doc_id").slice(first, last - first), sources, pa.array([part] * len(ends), pa.int32()), pa.array(before, pa.int64()), pa.array(ends - starts), stored.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=_DOCS_ARROW)

    return run


def windows(total: int, capacity: int) -> Iterator[int]:
    """Sizes of the windows that hold so many tokens without padding."""
    yield from (capacity for _ in range(total // capacity))
    rest = total % capacity
    yield from (1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1)


class Queue:
    """A source's pieces in a lane, its deficit at the start of the lane and its quantum a window."""

    def __init__(self, pieces: list[tuple[int, int]], deficit: float, quantum: float) -> None:
        self.pieces = pieces  # (row, tokens)
        self.deficit, self.quantum = deficit, max(quantum, 1e-9)
        self.head = self.used = self.rounds = 0

    def next_size(self, least: int) -> int:
        """What the source sends next: the rest of its head document, or a quantum of it."""
        return min(self.pieces[self.head][1] - self.used, max(least, int(self.quantum)))

    def due(self, least: int) -> int:
        """The round in which the deficit covers the next piece."""
        missing = self.next_size(least) - self.deficit
        return self.rounds + max(0, -int(-missing // self.quantum))

    def reach(self, round_: int) -> None:
        """Add the quanta of the rounds up to this one."""
        self.deficit += max(0, round_ - self.rounds) * self.quantum
        self.rounds = max(round_, self.rounds)


def round_robin(queues: list[Queue], capacity: int, least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(window, offset in it, row, first token in the row's piece, tokens) until all queues are empty."""
    waiting = [(q.due(least), k) for k, q in enumerate(queues)]
    heapify(waiting)
    total = sum(n for q in queues for _, n in q.pieces)
    for window, size in enumerate(windows(total, capacity)):
        filled = 0
        while filled < size:
            _, k = heappop(waiting)
            q = queues[k]
            q.reach(window + 1)
            n = min(q.next_size(least), size - filled)
            row, tokens = q.pieces[q.head]
            yield window, filled, row, q.used, n
            filled += n
            q.used += n
            q.deficit -= n
            if q.used == tokens:
                q.head, q.used = q.head + 1, 0
            if q.head < len(q.pieces):
                heappush(waiting, (q.due(least), k))


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
_PIECES_ARROW = pa.schema([*((c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("source", pa.string())])
#: Sequences of a lane are numbered from lane * LANE_IDS.
LANE_IDS = 1 << 32


def _lane_packer(capacity: int, least: int, weights: dict[str | None, float] | None, kind: str, with_ids: bool):
    schema = _PIECES_ARROW.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _PIECES_ARROW

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("source", "ascending"), ("x", "ascending")]).combine_chunks()
        n, sources = table.column("n").to_pylist(), table.column("source").to_pylist()
        quota, deficit, raw = table.column("quantum").to_pylist(), table.column("deficit").to_pylist(), table.column("ids")
        queues: list[Queue] = []
        for row, source in enumerate(sources):
            if not row or source != sources[row - 1]:
                queues.append(Queue([], deficit[row], quota[row] if weights is None else float(weights.get(source, 1.0))))
            queues[-1].pieces.append((row, n[row]))
        if weights is not None:
            every = sum(q.quantum for q in queues)
            for q in queues:
                q.quantum = max(q.quantum * capacity / every, 1e-9)
        doc_id, begin, whole = (table.column(c).to_pylist() for c in ("doc_id", "begin", "doc_tokens"))
        out: list[list] = [[] for _ in schema]
        last, ids = -1, np.zeros(0, np.uint32)
        held: dict[int, np.ndarray] = {}
        for window, offset, row, used, size in round_robin(queues, capacity, least):
            if row not in held:
                held[row] = np.frombuffer(raw[row].as_py(), kind).astype("<u4")
            ids = held[row][used : used + size]
            if used + size == n[row]:
                del held[row]
            values = [doc_id[row], begin[row] + used, size, zlib.crc32(ids.tobytes()), whole[row], key[0].as_py() * LANE_IDS + window, offset, sources[row]]
            for c, v in zip(out, [*values, ids.astype(np.int32)] if with_ids else values, strict=True):
                c.append(v)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return pack


def mixture_pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, least_piece: int = LEAST_PIECE, lane_windows: int = LANE_WINDOWS, weights: dict[str | None, float] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source (and the ids) of each piece.

    capacity: a power of two; weights: target proportions by source, 1 for one not named, in place of the corpus mixture.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    with scratch() as keep:
        made = keep(rows.mapInArrow(_tokeniser(tokenizer, end), _DOCS), "tokens")
        # A source's queue runs through the parts in their order; one row a part and source.
        totals = made.groupBy("source", "part").agg(F.sum("n").alias("part_n"))
        by_source = Window.partitionBy("source")
        places = keep(totals.select("source", "part", (F.sum("part_n").over(by_source.orderBy("part")) - F.col("part_n")).alias("ahead"), F.sum("part_n").over(by_source).alias("all")), "places")
        found = places.groupBy("source").agg(F.first("all").alias("all"), F.count("*").alias("rows")).agg(F.sum("all").alias("tokens"), F.sum("rows").alias("rows")).first()
        lanes = max(1, -(-(found.tokens or 0) // (lane_windows * capacity)))
        places = places.withColumnsRenamed({"source": "s", "part": "p"})
        joined = made.join(small_side(places, found.rows or 0, 60), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
        placed = joined.withColumn("x", F.col("ahead") + F.col("before"))
        # Whole-number arithmetic: lane p of a source begins at floor(p * all / lanes).
        lane = lambda x: F.expr(f"CAST((CAST({x} + 1 AS DECIMAL(38, 0)) * {lanes} - 1) div CAST(all AS DECIMAL(38, 0)) AS LONG)")
        border = lambda p: f"CAST(CAST({p} AS DECIMAL(38, 0)) * all div {lanes} AS LONG)"
        cut = placed.withColumn("lane", F.explode(F.sequence(lane("x"), lane("x + n - 1")))).withColumn("doc_tokens", F.col("n"))
        cut = cut.withColumn("begin", F.greatest(F.lit(0), F.expr(f"{border('lane')} - x"))).withColumn("n", F.least("n", F.expr(f"{border('lane + 1')} - x")) - F.col("begin")).where("n > 0")
        size = 2 if _kind(tokenizer).itemsize == 2 else 4
        cut = cut.select(
            "lane", "doc_id", "source", "doc_tokens", "begin", "n", (F.col("x") + F.col("begin")).alias("x"),
            F.expr(f"CAST((CAST(lane AS DECIMAL(38, 0)) * all) % {lanes} AS DOUBLE) / {lanes}").alias("deficit"),
            (F.col("all") / float(found.tokens or 1) * capacity).alias("quantum"),
            F.expr(f"substring(ids, CAST(begin * {size} + 1 AS INT), CAST(n * {size} AS INT))").alias("ids"),
        )
        packed = cut.groupBy("lane").applyInArrow(_lane_packer(capacity, least_piece, weights, _kind(tokenizer).str, with_ids), _PIECES + ", ids array<int>" * with_ids)
        return written(packed, "packed")
