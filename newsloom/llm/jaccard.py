"""Grouped prefix join for n-gram Jaccard similarity.

A document's set is its distinct word shingles, in one order that all documents
share: rare first.  Two sets of similarity 0.8 or more have a shingle in common
among the first ``n - ceil(0.8 n) + 1`` of each (their prefixes), so candidates
meet in the list of such a shingle.

1. Documents with the same prefix and size form a group, and only groups enter
   the lists; documents with the same whole set form a class within it.
2. Stars: every group of a list is paired with the list's hub, a class of the
   group with fewest rare shingles; pairs pass the size filter, expand to classes
   and are verified on whole sets.  Links give first components.
3. More stars over the lists that still hold several components, as long as they
   find links and for ``ROUNDS`` rounds at most.  A list's hub is the first of
   its classes in one of ``ORDERS`` random orders, so a class of a large group
   meets up to so many hubs a round: a round costs pairs in proportion to the
   members, and such groups fall into few components before the rest is compared.
4. The rest: lists that still hold several components.  Short ones give their
   pairs of different components that pass the size and position filters, at most
   ``SHORT_LIST`` a member and list, and these are verified.  Long ones are cut
   into blocks of at most about ``BLOCK`` members and ``BLOCK_CODES`` shingles;
   each pair of blocks compares whole sets by matrix products, and only a
   spanning forest of the links found there leaves the task: rows in proportion
   to the members of the blocks, not to their pairs.

No link between different texts is lost: each filter only drops pairs that
cannot reach 0.8, and a forest reaches what its links reach.  Pairs already in
one component need no comparison.

The order (rare first) comes from counts over one in ``SAMPLE`` documents and
holds at most ``FREQUENT`` shingles; any order gives the same result, a bad one
only longer lists.

Edge cases: null and empty texts, or texts of white space, have the empty set
and are linked with nothing; fewer than five words are one shingle; repeated
rows are repeated in the result; a null doc_id gets a null component unless its
class has another document; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, scratch, small_side, written
from .components import connected_components, merged_components
from .ngrams import Grams, WordHashes, chunks, mixed

SHINGLE = 5
#: Similarity in hundredths.
PERCENT = 80
SAMPLE = 16
FREQUENT = 400_000
ROUNDS = 1
#: Orders in which a round's lists choose their hubs.
ORDERS = 16
BLOCK = 1000
BLOCK_CODES = 1_000_000
#: Shingles of so many members of a pair of blocks or fewer are counted pair by pair, others by matrix products.
FEW = 8
#: Columns of a matrix at once.
COLUMNS = 4096
#: Lists of up to so many classes give their pairs as rows; longer ones are compared in blocks.
SHORT_LIST = 64


def prefix_length(n):
    return n - (PERCENT * n + 99) // 100 + 1


def _sets(column: pa.Array, hashes: WordHashes, frequent: np.ndarray | None, rank: np.ndarray | None) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Ranges of texts with the sorted shingle codes of each; frequent shingles (sorted hashes with ranks) come after all others."""
    for a, b, some in chunks(column):
        out: list[np.ndarray] = []
        docs = [t.lower().split() for t in some]
        flat = hashes.of([w for d in docs for w in d])
        grams, begin = Grams(flat).of(SHINGLE), 0
        for d in docs:
            if len(d) >= SHINGLE:
                codes = grams[begin : begin + len(d) - SHINGLE + 1]
            else:
                codes = Grams(flat[begin : begin + len(d)]).of(len(d)) if d else np.zeros(0, np.uint64)
            begin += len(d)
            if frequent is not None:
                plain = codes >> np.uint64(2)
                if len(frequent):
                    at = np.searchsorted(frequent, codes)
                    at[at == len(frequent)] = 0
                    plain = np.where(frequent[at] == codes, np.uint64(1 << 62) | rank[at], plain)
                codes = plain
            codes = np.sort(codes)
            out.append(codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes)
        yield a, b, out


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles met most in the sample, and their ranks, rarest first; at most FREQUENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for _, _, sets in _sets(batch.column(0), hashes, None, None):
                value, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["code", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    with scratch() as keep:
        counts = keep(some.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where("n >= 3"), "shingle-counts")
        # One row a count tells the lowest count that keeps within FREQUENT, so that tasks send only what is kept.
        kept, floor = 0, 1 << 62
        for row in counts.groupBy("n").agg(F.count("*").alias("shingles")).orderBy(F.desc("n")).toLocalIterator():
            kept += row.shingles
            if kept > FREQUENT:
                break
            floor = row.n
        top = counts.where(F.col("n") >= floor).toArrow()
    code, n = top.column("code").to_numpy().view(np.uint64), top.column("n").to_numpy()
    rank = np.zeros(len(code), np.uint64)
    rank[np.lexsort((code, n))] = np.arange(len(code))
    order = np.argsort(code)
    return code[order], rank[order]


def _set_hash(codes: np.ndarray, size: int, salt: int) -> int:
    return int(mixed(mixed(Grams(codes).sums[-1:], salt) ^ np.uint64(size))[0].astype(np.int64))


def _keys(codes: np.ndarray) -> tuple[int, int]:
    """Class (whole set) and group (prefix and size) of a non-empty set."""
    n = len(codes)
    return _set_hash(codes, n, 7), _set_hash(codes[: prefix_length(n)], n, 9)


_MEMBER = "doc_id long, n int, class long, group long, rare int, codes binary"


def _members(order):
    """Arrow function: (doc_id, text) to set size, class, group, number of rare shingles and the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for a, b, sets in _sets(batch.column(1), hashes, *order):
                keys = [_keys(s) if len(s) else (None, None) for s in sets]
                rare = [int(np.searchsorted(s, np.uint64(1 << 62))) for s in sets]
                heads = [s[: prefix_length(len(s))].tobytes() for s in sets]
                columns = [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int32()), *(pa.array([k[i] for k in keys], pa.int64()) for i in range(2)), pa.array(rare, pa.int32()), pa.array(heads, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "class", "group", "rare", "codes"])

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, class, n, rare, codes) to (code, group, class, n, rare), once a group and batch, by its first class there."""
    for batch in batches:
        _, first = np.unique(batch.column(0).to_numpy(), return_index=True)
        for at in range(0, len(first), 1024):
            part = batch.take(pa.array(np.sort(first)[at : at + 1024]))
            codes = [np.frombuffer(x, np.int64) for x in part.column(4).to_pylist()]
            counts = [len(c) for c in codes]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes)), *(pa.array(np.repeat(part.column(k).to_numpy(), counts)) for k in range(4))], names=["code", "group", "class", "n", "rare"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists in order of code, size and rare shingles: (group, hub) of the stars, a hub being a class, and (group, null) of
    groups that stand next to one of fitting size.

    The class of a list's first group is the hub of the groups whose sizes fit it, the next one begins another star, and
    so on.  Only the last row and the hub are kept between batches.
    """
    fits = lambda p, q: 100 * min(p, q) >= PERCENT * max(p, q)
    code = hub = hub_class = hub_n = last = last_n = None
    for batch in batches:
        if not batch.num_rows:
            continue
        c, g, k, n = (batch.column(i).to_numpy() for i in range(4))
        # rows of lists with one row only need no look
        near = np.zeros(len(c), bool)
        near[1:] = c[1:] == c[:-1]
        near[:-1] |= near[1:]
        near[0] |= c[0] == code
        near[-1] = True
        out = set()
        for x, y, z, m in zip(c[near].tolist(), g[near].tolist(), k[near].tolist(), n[near].tolist(), strict=True):
            if x != code:
                code, hub, hub_class, hub_n, last, last_n = x, y, z, m, y, m
                continue
            if y != last and fits(m, last_n):
                out |= {(y, None), (last, None)}
            if not fits(m, hub_n):
                hub, hub_class, hub_n = y, z, m
            elif y != hub:
                out.add((y, hub_class))
            last, last_n = y, m
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["group", "hub"])


def _pairs_that(test):
    """Arrow function: pairs (a, b) that come with codes x, y and sizes p, q, kept where test(x, y, p, q) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = [part.column(k).to_pylist() for k in range(2, 6)]
                keep = [test(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), p, q) for x, y, p, q in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar(x: np.ndarray, y: np.ndarray, p: int, q: int) -> bool:
    """Similarity of whole sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return bool(100 * both >= PERCENT * (p + q - both))


def maybe_similar(x: np.ndarray, y: np.ndarray, p: int, q: int) -> bool:
    """Whether prefixes x, y of sets of sizes p, q leave the similarity possible.

    Up to the end of the prefix that ends sooner both sets are known; what they
    do not share there is part of their difference, at most (p + q) / 9.
    """
    last = min(x[-1], y[-1])
    seen = np.searchsorted(x, last, side="right") + np.searchsorted(y, last, side="right")
    return bool(9 * (seen - 2 * len(np.intersect1d(x, y, assume_unique=True))) <= p + q)


def _list_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, hub) of every list's members whose component is not the hub's and whose size fits it; lists arrive in order of
    code, each with its hub first.  Only the hub of the current list is kept between batches."""
    hub = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(4)]
        if hub is not None:
            columns = [np.append(h, x) for h, x in zip(hub, columns, strict=True)]
        code, node, part, n = columns
        start = np.concatenate([[True], code[1:] != code[:-1]])
        at = np.maximum.accumulate(np.where(start, np.arange(len(code)), 0))
        fit = (part != part[at]) & (100 * np.minimum(n, n[at]) >= PERCENT * np.maximum(n, n[at]))
        found = np.unique(np.stack([node[fit], node[at][fit]], 1), axis=0)
        hub = [x[at[-1] : at[-1] + 1] for x in columns]
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])


def _short_pairs(code: np.ndarray, node: np.ndarray, part: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Pairs of different components within lists of up to SHORT_LIST rows, by size and position."""
    out = [np.zeros((0, 2), np.int64)]
    for step in range(1, SHORT_LIST):
        i = np.flatnonzero(code[step:] == code[:-step])
        if not len(i):
            break
        j = i + step
        fit = (part[i] != part[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])) & (9 * (at[i] + at[j]) <= n[i] + n[j])
        out.append(np.stack([np.minimum(node[i], node[j])[fit], np.maximum(node[i], node[j])[fit]], 1))
    return np.unique(np.concatenate(out), axis=0)


def _open_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lists that hold several components: (a, b, null) for the pairs of short ones, (code, null, rows) for long ones.

    Lists arrive in order of code.  Of the current list its rows are kept only
    while it may still be short; of a long one, the number of rows and the least
    and largest component.
    """
    held: list[np.ndarray] | None = None
    long: tuple[int, int, int, int] | None = None  # code, rows, least and largest component
    names = ["a", "b", "k"]

    def of_long(code: list[int], k: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.nulls(len(code), pa.int64()), pa.array(k, pa.int64())], names=names)

    def settled(columns: list[np.ndarray], last_too: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, long
        code, part = columns[0], columns[2]
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        count = np.diff(np.append(begin, len(code)))
        low, high = np.minimum.reduceat(part, begin), np.maximum.reduceat(part, begin)
        if not last_too:
            held = None
            if count[-1] > SHORT_LIST:
                long = int(code[-1]), int(count[-1]), int(low[-1]), int(high[-1])
            else:
                held = [x[begin[-1] :] for x in columns]
        done = np.arange(len(begin)) < len(begin) - (not last_too)
        big = done & (low < high) & (count > SHORT_LIST)
        if big.any():
            yield of_long(code[begin[big]].tolist(), count[big].tolist())
        small = np.repeat(done & (low < high) & (count <= SHORT_LIST), count)
        pairs = _short_pairs(*[x[small] for x in columns])
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(len(pairs), pa.int64())], names=names)

    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(5)]
        if long is not None and len(columns[0]):
            code, k, low, high = long
            same = columns[0] == code
            if same.any():
                long = code, k + int(same.sum()), min(low, int(columns[2][same].min())), max(high, int(columns[2][same].max()))
                columns = [x[~same] for x in columns]
            if len(columns[0]):
                if long[2] < long[3]:
                    yield of_long([code], [long[1]])
                long = None
        if held is not None:
            columns = [np.concatenate([h, x]) for h, x in zip(held, columns, strict=True)]
        if len(columns[0]):
            yield from settled(columns, False)
    if held is not None:
        yield from settled(held, True)
    if long is not None and long[2] < long[3]:
        yield of_long([long[0]], [long[1]])


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered left with those numbered right."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    often = np.diff(np.append(begin, len(flat)))
    place = {x: np.full(len(sets), -1) for x in ("left", "right")}
    place["left"][left], place["right"][right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    # Shingles of few sets: every ordered pair of theirs, at one distance after the other.
    for k in range(2, FEW + 1):
        rows = row[begin[often == k][:, None] + np.arange(k)]
        for x in range(k):
            for y in range(k):
                i, j = place["left"][rows[:, x]], place["right"][rows[:, y]]
                use = (x != y) & (i >= 0) & (j >= 0)
                np.add.at(both, (i[use], j[use]), 1)
    # The others: a column each, so many at once.
    many = np.flatnonzero(often > FEW)
    for at in range(0, len(many), COLUMNS):
        some = many[at : at + COLUMNS]
        column = np.repeat(np.arange(len(some)), often[some])
        rows = np.concatenate([row[b : b + k] for b, k in zip(begin[some].tolist(), often[some].tolist(), strict=True)])
        grid = np.zeros((len(sets), len(some)), np.float32)
        grid[rows, column] = 1
        both += grid[left] @ grid[right].T
    return both


def spanning_forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links of a symmetric matrix that reach all that its links reach."""
    new, out = np.ones(len(near), bool), []
    for root in range(len(near)):
        todo = [root] if new[root] else []
        new[root] = False
        while todo:
            i = todo.pop()
            found = np.flatnonzero(near[i] & new)
            new[found] = False
            out += [(i, j) for j in found.tolist()]
            todo += found.tolist()
    return out


def _long_blocks(table: pa.Table) -> pa.Table:
    """A spanning forest of the links between different components in a pair of blocks of a long list, on whole sets."""
    node, part, n, side = (table.column(k).to_numpy() for k in ("class", "component", "n", "side"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("codes").to_pylist()]
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    near = np.zeros((len(sets), len(sets)), bool)
    if len(left) and len(right) and part.min() < part.max():
        both = common_counts(sets, left, right)
        linked = (100 * both >= PERCENT * (n[left][:, None] + n[right] - both)) & (part[left][:, None] != part[right])
        near[np.ix_(left, right)] = linked
        near |= near.T
    links = spanning_forest(near)
    return pa.table({k: pa.array([node[x[i]] for x in links], pa.int64()) for i, k in enumerate("ab")})


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, group, n, component, codes) to (code, class, component, n, at); a group is a list of its own for its classes, at 0."""
    for batch in batches:
        c, g, n, p = (batch.column(k).to_numpy() for k in (0, 1, 2, 3))
        for begin in range(0, batch.num_rows, 1024):
            some = slice(begin, begin + 1024)
            codes = [np.frombuffer(x, np.int64) for x in batch.column(4).slice(begin, 1024).to_pylist()]
            counts = np.array([len(h) + 1 for h in codes])
            code = np.concatenate([np.append(h, k) for h, k in zip(codes, g[some], strict=True)])
            at = np.concatenate([np.append(np.arange(len(h)), 0) for h in codes]).astype(np.int32)
            arrays = [code, np.repeat(c[some], counts), np.repeat(p[some], counts), np.repeat(n[some], counts), at]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["code", "class", "component", "n", "at"])


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; the result is a written table, all others are deleted."""
    with scratch() as keep:
        return _components(docs, keep)


def _components(docs: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = frequent_shingles(rows)
    members = keep(rows.mapInArrow(_members(order), _MEMBER), "members")
    classes = members.where("class is not null").groupBy("class", "group", "n").agg(F.min("doc_id").alias("doc_id"))

    # 1. Lists of groups.
    known_groups = members.where("group is not null").select("group", "class", "n", "rare", "codes")
    lists = known_groups.mapInArrow(_postings, "code long, group long, class long, n int, rare int").repartition("code").sortWithinPartitions("code", "n", "rare", "group", "class")
    stars = keep(lists.mapInArrow(_stars, "group long, hub long").distinct(), "stars")
    hubs = stars.where("hub is not null")
    meeting = stars.select("group").distinct()
    twins = classes.groupBy("group").agg(F.min("class").alias("first"), F.count("*").alias("k")).where("k > 1")
    busy = keep(classes.join(meeting.unionByName(twins.select("group")).distinct(), "group", "left_semi"), "busy")
    n_busy = busy.count()

    # 2. Prefixes of the classes that may have a partner, and the links of the stars.
    chosen_rows = small_side(busy.select(F.col("class").alias("c"), F.col("doc_id").alias("d")), n_busy, 16)
    heads = keep(members.join(chosen_rows, (F.col("class") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("class", "group", "n", "codes").dropDuplicates(["class"]), "heads")

    def whole_sets(some: DataFrame) -> DataFrame:
        """class, n and all codes, sorted, of some classes, each once."""
        chosen = keep(busy.join(some.distinct(), "class", "left_semi").select("class", "doc_id"), "chosen")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                for a, b, sets in _sets(batch.column(1), hashes, *order):
                    own = pa.array([len(s) > 0 and _keys(s)[0] == c for s, c in zip(sets, batch.column(0).slice(a, b - a).to_pylist(), strict=True)], pa.bool_())
                    columns = [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["class", "n", "codes"]).filter(own)

        texts_of = rows.join(small_side(chosen.select("class", F.col("doc_id").alias("d")), chosen.count(), 16), F.col("doc_id").eqNullSafe(F.col("d")))
        return keep(texts_of.select("class", "text").mapInArrow(run, "class long, n int, codes binary").dropDuplicates(["class"]), "sets")

    def tested(pairs: DataFrame, n_pairs: int, sets: DataFrame, test) -> DataFrame:
        one = sets.select(F.col("class").alias("a"), F.col("codes").alias("x"), F.col("n").alias("p"))
        two = sets.select(F.col("class").alias("b"), F.col("codes").alias("y"), F.col("n").alias("q"))
        joined = small_side(pairs, n_pairs, 16).join(one, "a").join(two, "b").select("a", "b", "x", "y", "p", "q")
        return keep(joined.mapInArrow(_pairs_that(test), "a long, b long"), "pairs")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among the pairs: their prefixes rule most out, whole sets settle the rest."""
        pairs = keep(pairs.distinct(), "pairs")
        possible = tested(pairs, pairs.count(), heads, maybe_similar)
        return tested(possible, possible.count(), whole_sets(ends(possible)), similar)

    member = busy.select("class", "group")
    outer = hubs.join(member, "group").where("class <> hub").select(F.col("class").alias("a"), F.col("hub").alias("b"))
    inner = member.join(twins, "group").where("class <> first").select(F.col("class").alias("a"), F.col("first").alias("b"))
    parts = connected_components(verified(outer.unionByName(inner)))

    def posted() -> DataFrame:
        """Prefix rows with the components so far."""
        known = heads.join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        return known.select("class", "group", "n", "component", "codes").mapInArrow(_prefix_rows, "code long, class long, component long, n int, at int")

    def joined_by(links: DataFrame) -> DataFrame:
        grown = merged_components(parts, links)
        forget(parts)
        return grown

    # 3. More stars.
    for salt in range(ROUNDS):
        by_hub = F.xxhash64("class", F.pmod("code", F.lit(ORDERS)), F.lit(salt))
        in_lists = posted().select("code", "class", "component", "n").repartition("code").sortWithinPartitions("code", by_hub, "class")
        found = verified(in_lists.mapInArrow(_list_stars, "a long, b long"))
        if found.isEmpty():
            break
        parts = joined_by(found)

    # 4. Lists that still hold several components.
    rest = posted()
    in_lists = rest.repartition("code").sortWithinPartitions("code", "class")
    still_open = keep(in_lists.mapInArrow(_open_lists, "a long, b long, k long"), "open")
    short = still_open.where("k is null").select("a", "b")
    long_lists = still_open.where("k is not null").select(F.col("a").alias("code"))
    n_long = long_lists.count()
    in_long = keep(rest.join(small_side(long_lists, n_long, 8), "code").select("code", "class", "component", "n"), "long")
    # Long lists: a class goes, with its whole set, to every pair of blocks that its own block takes part in.
    blocks = in_long.groupBy("code").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_CODES)).cast("int").alias("blocks"))
    long = in_long.drop("n").join(small_side(blocks, n_long, 12), "code").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    long = long.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "class", "component",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1).alias("side"),
    )
    long = long.join(whole_sets(in_long.select("class")), "class")
    forests = keep(long.groupBy("code", "i", "j").applyInArrow(_long_blocks, "a long, b long"), "forests")
    parts = joined_by(verified(short).unionByName(forests))

    # Components of classes, then of documents: the smallest doc_id of the component.
    class_part = classes.join(parts.withColumnRenamed("node", "class"), "class", "left").select("class", F.coalesce("component", "class").alias("part"), "doc_id")
    smallest = class_part.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    of_class = class_part.join(smallest, "part").select("class", "component_id")
    out = members.join(of_class, "class", "left")
    out = written(out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "similar")
    forget(parts)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with only the smallest doc_id of each component, once; columns unchanged, rows without a doc_id stay."""
    found = jaccard_components(docs)
    kept = written(found.where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct(), "kept")
    forget(found)
    rows = docs.where("doc_id is not null").join(small_side(kept, kept.count(), 16), F.col("doc_id") == F.col("__kept"), "left_semi")
    repeated = written(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__again")).agg(F.count("*").alias("n")).where("n > 1").select("__again"), "repeated")
    repeated = small_side(repeated, repeated.count(), 16)
    # Only rows whose doc_id stands more than once need a look at each other.
    once = rows.join(repeated, F.col("doc_id") == F.col("__again"), "left_anti")
    again = rows.join(repeated, F.col("doc_id") == F.col("__again"), "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(again).unionByName(docs.where("doc_id is null"))
