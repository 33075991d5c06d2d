"""Language-model scoring with a log-bilinear neural model trained by noise-contrastive estimation.

The model (Mnih & Hinton 2007) predicts a word from the two before it: context
vectors pass position matrices, are added, and meet the output vectors in a dot
product.  Every training word met ``FLOOR`` times or more has its own context and
output vectors.  A word's probability has two levels: its class, then the word
within the class.  The most frequent words are alone in their classes; the others
are runs of words of like counts, with equal sums of square roots of counts, which
makes both levels cheapest.  The end of a text is a class, and so are all words below the
floor, within which a word has its smoothed share of counts; so probabilities of
a token add up to one over everything the base score knows.

Training (Mnih & Teh 2012): each task runs through all its training documents
with batches that share noise classes, and with noise words of their class for
tokens of larger classes, from common weights.  After a round the changes are
averaged row by row, by how often a task met the row.  Rounds take disjoint parts
of the training documents, so every one is used once.

Both levels are normalised exactly, by matrix products over blocks: all classes
first, once for each distinct pair of context words of a stretch, then the
distinct triples of each class with the words of it.

Counts of all words stay a table.  The words above the floor travel to the tasks,
``FREQUENT`` of them at most: where more are met ``FLOOR`` times, a histogram of
counts gives the lowest floor that keeps within it.  Every other word of a
document is counted by a join, so nothing is cut.

Edge cases: a null or empty text is one token, its end; a null doc_id is a
training document; repeated rows are counted and scored as often as they stand;
an empty table gives an empty result; no training tokens at all leave only the
smoothed base; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written
from .ngrams import ranges

#: A word met less often has no vector of its own.
FLOOR = 5
DIMS = 16
NOISE = 64
#: Noise words of a token within its class.
INNER_NOISE = 4
BATCH = 1024
ROUNDS = 2
FREQUENT = 150_000
#: Tokens of a trainer of a round, or more if input partitions are larger: trainers follow the input.
TRAINER_TOKENS = 1_000_000
#: Rows of weights that travel as one.
ROWS = 64
#: Bytes of text handled at once; more contexts repeat in a longer stretch.
STRETCH_BYTES = 4_000_000
#: Contexts normalised at once.
BLOCK = 512
#: exp() of twice this is finite in float32, and so is its inverse.
SAFE = 40
#: Distinct words a task counts before it hands them on.
COUNTED = 400_000
#: Contexts whose exponentials of both places are kept for a stretch; any value gives the same result.
COMMON = 4_000
OTHER, END = 0, 1
#: No word is empty, so this stands for the end of a text among words.
END_WORD = ""


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """Ranges of texts: begin, end, distinct words, the place of each token among these (their number for the end of a text), tokens of each text."""
    for a, b in ranges(column, STRETCH_BYTES):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.slice(a, b - a), "")))
        parts = lists.flatten()
        words = parts.dictionary_encode()
        # A text that begins or ends with white space has an empty part there.
        full = np.flatnonzero(pc.binary_length(parts).to_numpy(zero_copy_only=False))
        doc = np.repeat(np.arange(b - a), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[full]
        tokens = np.full(len(full) + b - a, len(words.dictionary))
        tokens[np.arange(len(full)) + doc] = words.indices.to_numpy(zero_copy_only=False)[full]
        yield a, b, words.dictionary, tokens, np.bincount(doc, minlength=b - a) + 1


def _places(words: pa.Array, known: pa.Array, tokens: np.ndarray) -> np.ndarray:
    """The place of each token among known words, -1 for others; their number for the end of a text."""
    found = pc.fill_null(pc.index_in(words, known), -1).to_numpy(zero_copy_only=False)
    return np.append(found, len(known)).astype(np.int64)[tokens]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, merged as long as a task can hold them; the end of a text as END_WORD."""
    pending: list[pa.Table] = []

    def merged() -> pa.Table:
        found = pa.concat_tables(pending).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return found.select(["word", "n_sum"]).rename_columns(["word", "n"])

    for batch in batches:
        column = batch.column(0)
        for a, b in ranges(column, STRETCH_BYTES):
            met = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.slice(a, b - a), ""))).flatten().value_counts()
            here = pa.table([met.field("values"), met.field("counts")], names=["word", "n"])
            here = here.filter(pc.greater(pc.binary_length(here["word"]), 0))
            pending += [here, pa.table([pa.array([END_WORD], here.schema.field("word").type), pa.array([b - a], pa.int64())], names=["word", "n"])]
            if sum(map(len, pending)) >= 2 * COUNTED:
                pending = [merged()]
                if len(pending[0]) >= COUNTED:
                    yield from pending.pop().to_batches()
    if pending:
        yield from merged().to_batches()


class Classes:
    """Classes of slots: OTHER, END, then words by falling count; the slots of a class follow one another.

    Of the square root of the number of words, half are classes of one word each, and half share the other words.
    """

    def __init__(self, counts: np.ndarray) -> None:
        n = max(1, int(np.sqrt(len(counts))) // 2)
        alone = np.arange(min(n, len(counts)))
        roots = np.sqrt(np.asarray(counts[n:], np.float64))
        run = ((np.cumsum(roots) - roots) / max(roots.sum(), 1) * n).astype(np.int64)
        run = np.unique(run, return_inverse=True)[1].reshape(-1) + len(alone)
        self.of = np.concatenate([[OTHER, END], alone + 2, run + 2]).astype(np.int64)
        self.size = np.bincount(self.of)
        self.first = np.cumsum(self.size) - self.size


def parameters(bias: np.ndarray, inner: np.ndarray | None = None, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights at the start; bias of the classes, and inner: bias of the slots within their classes (none: classes are slots)."""
    r = np.random.default_rng(seed)
    inner = np.zeros(len(bias)) if inner is None else inner
    return {
        "context": r.normal(0, 0.1, (len(inner) + 1, DIMS)).astype(np.float32),  # the last one stands before a text
        "word": r.normal(0, 0.1, (len(bias), DIMS)).astype(np.float32),
        "near": np.eye(DIMS, dtype=np.float32),
        "far": (0.5 * np.eye(DIMS)).astype(np.float32),
        "bias": bias.astype(np.float32),
        "inner": np.zeros((len(inner), DIMS), np.float32),
        "inner_bias": inner.astype(np.float32),
    }


def _slots(ids: np.ndarray, known: int) -> np.ndarray:
    """Slots of word indices; the end has index known."""
    return np.where(ids == known, END, np.where(ids >= 0, ids + 2, OTHER))


def _contexts(slots: np.ndarray, counts: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots one and two places before each token."""
    near, far = np.full(len(slots), start), np.full(len(slots), start)
    near[1:] = slots[:-1]
    begins = np.cumsum(counts) - counts
    near[begins] = start
    far[1:] = near[:-1]
    far[begins] = start
    return near, far


@lru_cache(8)
def _flat(n: int) -> np.ndarray:
    """Where each number of n rows stands in a flat array."""
    return np.arange(n * DIMS).reshape(n, DIMS)


def _summed(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of x, DIMS wide, over each of n places, in one pass over the flat array."""
    return np.bincount(_flat(1 << n.bit_length()).take(at, 0).ravel(), x.ravel(), n * DIMS).reshape(n, DIMS).astype(np.float32)


def _distinct(at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of at, and where in them each stands; place: an integer for every row there is, of any value."""
    here = np.arange(len(at))
    place[at] = here
    last = place.take(at)  # where each row stands last: no sorting
    kept = last == here
    return at[kept], (np.cumsum(kept) - 1).take(last)


def nce_steps(p: dict[str, np.ndarray], kinds: Classes, slots: np.ndarray, near: np.ndarray, far: np.ndarray, noise: np.ndarray, state: dict[str, np.ndarray], rng: np.random.Generator, rate: float = 0.1) -> None:
    """Adagrad steps of noise-contrastive estimation over a stretch of tokens, in place; noise: probabilities of classes.

    state holds sums of squares, for rows of context and inner one number each, and how often these rows were met.
    """
    log_noise = np.log(NOISE * noise).astype(np.float32)
    heap = np.cumsum(noise)
    n_classes = len(p["word"])
    place = np.zeros(len(p["context"]), np.int64)

    def step(name: str, rows: np.ndarray, g: np.ndarray) -> None:
        squares = state[name].take(rows) + np.einsum("ij,ij->i", g, g) / DIMS
        state[name][rows] = squares
        changed = p[name].take(rows, 0) + g * (rate / np.sqrt(squares + 1e-4)).astype(np.float32)[:, None]
        row = np.dtype((np.void, changed.itemsize * DIMS))  # a row stored as one item
        p[name].view(row)[rows, 0] = changed.view(row)[:, 0]

    for a in range(0, len(slots), BATCH):
        s, c, d = slots[a : a + BATCH], near[a : a + BATCH], far[a : a + BATCH]
        w = kinds.of[s]
        drawn = np.minimum(np.searchsorted(heap, rng.random(NOISE)), n_classes - 1)
        qc, qd = p["context"].take(c, 0), p["context"].take(d, 0)
        h = qc @ p["near"] + qd @ p["far"]
        rw, rn = p["word"][w], p["word"][drawn]
        over = p["bias"] - log_noise
        true = np.einsum("ij,ij->i", h, rw) + over[w]
        gt = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        gf = h @ -rn.T
        gf -= over[drawn]
        np.clip(gf, -30, 30, out=gf)
        np.exp(gf, out=gf)
        gf += 1
        np.divide(-1, gf, out=gf)
        gh = gt[:, None] * rw + gf @ rn
        met = np.concatenate([w, drawn])
        grads = {"word": _summed(met, np.concatenate([gt[:, None] * h, gf.T @ h]), n_classes), "bias": np.bincount(met, np.concatenate([gt, gf.sum(0)]), n_classes)}

        at = np.flatnonzero(kinds.size[w] > 1)
        if len(at):
            size, hs = kinds.size[w[at]][:, None], h[at]
            others = kinds.first[w[at]][:, None] + (rng.random((len(at), INNER_NOISE)) * size).astype(np.int64)
            ids = np.concatenate([s[at][:, None], others], 1)
            r = p["inner"].take(ids, 0)
            x = np.clip(np.einsum("mki,mi->mk", r, hs) + p["inner_bias"].take(ids) - np.log(INNER_NOISE / size), -30, 30).astype(np.float32)
            g = -1 / (1 + np.exp(-x))
            g[:, 0] += 1
            gh[at] += np.einsum("mk,mki->mi", g, r)
            rows, back = _distinct(ids.ravel(), place)
            step("inner", rows, _summed(back, (g[:, :, None] * hs[:, None, :]).reshape(-1, DIMS), len(rows)))
            bias = np.bincount(back, g.ravel())
            squares = state["inner_bias"].take(rows) + bias**2
            state["inner_bias"][rows] = squares
            p["inner_bias"][rows] = p["inner_bias"].take(rows) + rate * bias / np.sqrt(squares + 1e-4)
            state["met_inner"][rows] = state["met_inner"].take(rows) + np.bincount(back)

        grads["near"], grads["far"] = qc.T @ gh, qd.T @ gh
        rows, back = _distinct(np.concatenate([c, d]), place)
        step("context", rows, _summed(back, np.concatenate([gh @ p["near"].T, gh @ p["far"].T]), len(rows)))
        state["met_context"][rows] = state["met_context"].take(rows) + np.bincount(back)
        for k, g in grads.items():
            state[k] += g * g
            p[k] += (rate * g / np.sqrt(state[k] + 1e-4)).astype(np.float32)


def first_state(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    state = {k: np.zeros(len(v) if k in ("context", "inner") else v.shape, np.float32) for k, v in p.items()}
    return state | {f"met_{k}": np.zeros(len(p[k]), np.float32) for k in ("context", "inner")}


def _log_sums(h: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logarithm of the sum over rows of exp(h . row + bias), for every h."""
    if not len(h):
        return np.zeros(0)
    weights = np.concatenate([rows, bias[:, None]], 1).T
    h = np.concatenate([h, np.ones((len(h), 1), np.float32)], 1)
    # No product leaves this bound; within it neither overflow nor a sum of zeros is possible, and no maximum is needed.
    safe = np.sqrt(np.einsum("ij,ij->i", h, h).max() * np.einsum("ij,ij->j", weights, weights).max()) < SAFE
    one, out = np.ones(len(rows), np.float32), np.empty(len(h))
    for a in range(0, len(h), BLOCK):
        x = h[a : a + BLOCK] @ weights
        top = 0 if safe else x.max(1, keepdims=True)
        if not safe:
            x -= top
            top = top[:, 0]
        out[a : a + BLOCK] = np.log(np.exp(x, out=x) @ one) + top
    return out


def _pair_sums(p: dict[str, np.ndarray], c: np.ndarray, d: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Log normalisers of the classes after pairs of contexts (c, d) with predictions h.

    The exponential of a sum is a product, so pairs of common contexts need only the exponentials of either place.
    """
    near, far = p["context"][:COMMON] @ p["near"] @ p["word"].T, p["context"][:COMMON] @ p["far"] @ p["word"].T
    near += p["bias"]
    common = (c < COMMON) & (d < COMMON) if max(np.abs(near).max(), np.abs(far).max()) < SAFE / 2 else np.zeros(len(c), bool)
    out = np.empty(len(c))
    out[~common] = _log_sums(h[~common], p["word"], p["bias"])
    np.exp(near, out=near)
    np.exp(far, out=far)
    at = np.flatnonzero(common)
    for a in range(0, len(at), BLOCK):
        some = at[a : a + BLOCK]
        out[some] = np.log(np.einsum("ij,ij->i", near.take(c[some], 0), far.take(d[some], 0)))
    return out


def log_probabilities(p: dict[str, np.ndarray], kinds: Classes, slots: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Normalised natural log-probability of each token's slot after its contexts."""
    n = len(p["context"])
    pairs, pair = np.unique(near * n + far, return_inverse=True)
    c, d = pairs // n, pairs % n
    h = (p["context"] @ p["near"]).take(c, 0) + (p["context"] @ p["far"]).take(d, 0)
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    w = kinds.of[slots]
    out = dot(h.take(pair, 0), p["word"].take(w, 0)) + p["bias"][w] - _pair_sums(p, c, d, h)[pair]
    at = np.flatnonzero(kinds.size[w] > 1)
    # Slots of a class follow one another, so sorted triples lie class by class.
    triples, triple = np.unique(slots[at] * len(pairs) + pair[at], return_inverse=True)
    slot, pair = np.divmod(triples, max(1, len(pairs)))
    inner = dot(h.take(pair, 0), p["inner"].take(slot, 0)) + p["inner_bias"][slot]
    ends = np.searchsorted(kinds.of[slot], np.arange(len(kinds.size) + 1))
    for k in np.flatnonzero(np.diff(ends) > 0):
        some, words = slice(ends[k], ends[k + 1]), slice(kinds.first[k], kinds.first[k] + kinds.size[k])
        inner[some] -= _log_sums(h[pair[some]], p["inner"][words], p["inner_bias"][words])
    out[at] += inner[triple]
    return out


def tables(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of classes by near and by far context (bias in the first), and log normalisers of all pairs of contexts.

    For small models: a row a context, and a number a pair of them.
    """
    near = p["context"] @ p["near"] @ p["word"].T + p["bias"]
    far = p["context"] @ p["far"] @ p["word"].T
    top_near, top_far = near.max(1, keepdims=True), far.max(1, keepdims=True)
    z = np.exp(near - top_near).astype(np.float64) @ np.exp(far - top_far).astype(np.float64).T
    return near.astype(np.float32), far.astype(np.float32), (np.log(z) + top_near + top_far.T).astype(np.float32)


def _packed(p: dict[str, np.ndarray]) -> np.ndarray:
    """All weights as rows of DIMS + 1: inner and word with their biases, context, near, far."""
    wide = lambda x, last=None: np.concatenate([x, np.zeros((len(x), 1), np.float32) if last is None else last[:, None]], 1)
    return np.concatenate([wide(p["inner"], p["inner_bias"]), wide(p["word"], p["bias"]), wide(p["context"]), wide(p["near"]), wide(p["far"])])


def _unpacked(x: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in ("inner", "word", "context", "near", "far"):
        out[k] = np.ascontiguousarray(x[at : at + len(like[k]), :DIMS])
        if k in ("inner", "word"):
            out["inner_bias" if k == "inner" else "bias"] = x[at : at + len(like[k]), DIMS].copy()
        at += len(like[k])
    return out


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of blocks of rows, averaged by how often each row was met; all of a block come to one task."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, x, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = np.frombuffer(n, np.float32).astype(np.float64)
            x = np.frombuffer(x, np.float16).reshape(len(n), -1) * n[:, None]
            if block in sums:
                sums[block][0].__iadd__(x)
                sums[block][1].__iadd__(n)
            else:
                sums[block] = (x, n)
    for block, (x, n) in sums.items():
        mean = (x / np.maximum(n, 1e-9)[:, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mean.tobytes()], pa.binary())], names=["block", "x"])


def train(rows: DataFrame, n_tokens: int, known: pa.Array, kinds: Classes, noise: np.ndarray, inner: np.ndarray) -> dict[str, np.ndarray]:
    """Weights after ROUNDS rounds over the training rows (key, text)."""
    p = parameters(np.log(noise), inner)

    def run_with(p: dict[str, np.ndarray], number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {k: v.copy() for k, v in p.items()}
            state = first_state(p)
            rng, total = np.random.default_rng(number), 0
            for batch in batches:
                for _, _, words, tokens, counts in _tokens(batch.column(0)):
                    slots = _slots(_places(words, known, tokens), len(known))
                    nce_steps(own, kinds, slots, *_contexts(slots, counts, len(kinds.of)), noise, state, rng)
                    total += len(tokens)
            if total:
                x = (_packed(own) - _packed(p)).astype(np.float16)
                n = np.concatenate([state["met_inner"], np.full(len(noise), total), state["met_context"], np.full(2 * DIMS, total)]).astype(np.float32)
                at = [a for a in range(0, len(n), ROWS) if n[a : a + ROWS].any()]
                for b in range(0, len(at), 256):
                    some = at[b : b + 256]
                    columns = [pa.array([a // ROWS for a in some], pa.int32()), pa.array([x[a : a + ROWS].tobytes() for a in some], pa.binary()), pa.array([n[a : a + ROWS].tobytes() for a in some], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "x", "n"])

        return run

    for number in range(ROUNDS):
        part = rows.where(F.pmod(F.xxhash64("key"), F.lit(ROUNDS)) == number).select("text").coalesce(max(1, n_tokens // TRAINER_TOKENS))
        changes = part.mapInArrow(run_with(p, number), "block int, x binary, n binary").repartition("block").mapInArrow(_averaged, "block int, x binary").toArrow()
        packed = _packed(p)
        for block, x in zip(*(c.to_pylist() for c in changes.columns), strict=True):
            packed[block * ROWS : (block + 1) * ROWS] += np.frombuffer(x, np.float32).reshape(-1, DIMS + 1)
        p = _unpacked(packed, p)
    return p


def frequent_words(counts: DataFrame, floor: int, most: int) -> list[tuple[str, int]]:
    """Words met floor times or more, by falling count; a higher floor, from a histogram of counts, where they are more than most."""
    words = counts.where((F.col("word") != END_WORD) & (F.col("n") >= floor))
    # One row a count; counts of so many words that they matter here are few, and each may stand for itself.
    tail = words.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("words")).toArrow().to_pylist()
    kept, floor = 0, (1 << 16) + 1
    for row in sorted(tail, key=lambda r: -r["n"]):
        kept += row["words"]
        if kept > most:
            break
        floor = row["n"]
    found = words.where(F.col("n") >= floor).toArrow()
    return sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))


def score_texts(docs: DataFrame, floor: int = FLOOR, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs; a written table, all others are deleted."""
    with scratch() as keep:
        return written(_scores(docs, floor, frequent, keep), "scores")


def _scores(docs: DataFrame, floor: int, frequent: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = keep(training.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = total.n, total.v
    top = frequent_words(counts, floor, frequent)
    ends = n_ends[0].n if (n_ends := counts.where(F.col("word") == END_WORD).collect()) else 0
    known = pa.array([w for w, _ in top], pa.string())
    size = np.array([n for _, n in top] + [ends], np.float64)
    rare_n = n_all - ends - size[:-1].sum()
    rare_v = max(0, v_all - len(top) - (ends > 0))
    kinds = Classes(size[:-1])
    met = np.concatenate([[rare_n + 1.0], [ends + 1.0], size[:-1]])
    noise = np.bincount(kinds.of, met)
    inner = np.log(met / noise[kinds.of])
    noise /= noise.sum()
    p = train(training.select(F.xxhash64("doc_id", "text").alias("key"), "text"), n_all, known, kinds, noise, inner)

    all_log, rare_log = log10(n_all + 0.5 * (v_all + 1)), log10(rare_n + 0.5 * (rare_v + 1))
    smoothed = np.log10(size + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = len(known)
        for batch in batches:
            for a, b, words, tokens, counts in _tokens(batch.column(2)):
                ids = _places(words, known, tokens)
                doc = np.repeat(np.arange(b - a), counts)
                slots = _slots(ids, end)
                model = log_probabilities(p, kinds, slots, *_contexts(slots, counts, len(kinds.of))) / np.log(10)
                here = ids >= 0
                base = np.where(here, smoothed[ids] - all_log, 0)
                sums = lambda x: np.bincount(doc, x, b - a)
                rare, times = np.unique((doc * (len(words) + 1) + tokens)[~here], return_counts=True)
                rare_doc, rare = np.divmod(rare, len(words) + 1)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(rare_doc, minlength=b - a))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), x) for x in (words.take(pa.array(rare)).cast(pa.string()), pa.array(times.astype(np.int64)))]
                known_here = sums(here & ((ids != end) | (ends > 0))).astype(np.int64)
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(counts), pa.array(known_here), pa.array(sums(base)), pa.array(sums(model)), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "word", "times"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, word array<string>, times array<long>")
    scored = keep(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # Words beyond the frequent ones: their counts by a join, one row a document and distinct word before it.
    rare = scored.select("row", F.inline(F.arrays_zip("word", "times")))
    c = F.coalesce(F.col("n"), F.lit(0))
    rare = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (F.log10(c + 0.5) - all_log)).alias("more_base"),
        F.sum(F.col("times") * (F.log10(c + 0.5) - rare_log)).alias("more_score"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    return scored.drop("word", "times").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + zero(F.col("more_known"))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero(F.col("more_base"))).alias("base_score"),
        (F.col("score") + zero(F.col("more_score"))).alias("score"),
    )
