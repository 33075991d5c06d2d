"""Titles that are alike by their sets of characters: pairs above a threshold, greedy dedup and greedy event clusters.

Titles with equal sets are one class from the start, so copies never meet each other as pairs.

Pairs come from parts that are compared as wholes: the classes of a block are cut into parts by hash, and each two parts
are one group, in which all classes of the one meet all of the other as bits, a bit for each of the most frequent
characters.  So a class is shuffled once for each part, whatever it is like, and no pair is shuffled.  There are ``PARTS``
parts at most as long as that leaves none with more than ``LARGEST`` classes.  What grows with the square of the classes
is the comparison, a few instructions a pair; sizes too far apart are not compared.

The greedy operators give what a fold in order gives (the first title leads).  A few rounds take the next ``WIDTH`` open
classes of every block, settle the leaders among them and give every open class the first leader that it is like: where
nearly all titles are alike, that settles nearly all.  The rest is far apart, so its links are few: they are found once,
and settled by first_come_by_links() in rounds that do not grow with the number of leaders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..shared import forget, small_side, written
from .settle import first_come_by_links

#: Classes of a block settled in a round: at most so many sets come together in a row.
WIDTH = 32
#: Rounds of leaders before links are found.
ROUNDS = 5
#: Classes of a part at least, parts of a block at most, and the classes of a part from which on there are more parts.
LEAST, PARTS, LARGEST = 1024, 24, 32_768
#: Tasks that compare, if there are as many groups; more for more than four groups a task.
TASKS = 200
#: Rows and columns compared at once, and pairs of a batch.
ROWS, COLUMNS, FOUND = 64, 2048, 65_536


def char_set(title: Column) -> Column:
    """Distinct characters in order; empty for a null title."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(title, F.lit("")), "", -1), lambda c: c != "")))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def least_overlap(n: int, m: int, similarity: float) -> int | None:
    """Characters that sets of n and m share at least if they are above the threshold; None if no such sets are."""
    first = max(0, int((n + m) * similarity / (1 + similarity)) - 1)
    return next((k for k in range(first, min(n, m) + 1) if k / (n + m - k) > similarity), None)


class _Sets:
    """Sets of characters as bits: 128 characters have one each, the others share 64."""

    def __init__(self, n: np.ndarray, codes: np.ndarray) -> None:
        _, code, often = np.unique(codes, return_inverse=True, return_counts=True)
        place = np.empty(len(often), np.int64)
        place[np.argsort(-often, kind="stable")] = np.arange(len(often))
        self.place, self.n, self.start = place[code], n, np.cumsum(n) - n
        word, bit = np.minimum(self.place // 64, 2), np.uint64(1) << (self.place % 64).astype(np.uint64)
        self.words = [np.bitwise_or.reduceat(np.where(word == k, bit, np.uint64(0)), self.start) for k in range(3)]
        self.others = np.add.reduceat((word == 2).astype(np.int32), self.start)
        self.hidden = self.others - np.bitwise_count(self.words[2])  # other characters behind another one's bit

    def most(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """What each of x can share with each of y at most; that is what it does share if one of the two has no others."""
        first, second, third = ((w[x][:, None], w[y]) for w in self.words)
        frequent = np.bitwise_count(np.bitwise_and(*first)) + np.bitwise_count(np.bitwise_and(*second))
        if not (self.others[x].any() and self.others[y].any()):
            return frequent
        others = np.bitwise_count(np.bitwise_and(*third)) + np.minimum(self.hidden[x][:, None], self.hidden[y])
        return frequent + np.minimum(others, np.minimum(self.others[x][:, None], self.others[y]))

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """What i[k] shares with j[k]."""
        both = sum(np.bitwise_count(w[i] & w[j]).astype(np.int32) for w in self.words[:2])
        unsure = np.flatnonzero((self.others[i] > 0) & (self.others[j] > 0))
        for at in range(0, len(unsure), 4096):
            some = unsure[at : at + 4096]
            pair, other = [], []
            for sets in (i[some], j[some]):
                n = self.n[sets]
                place = self.place[np.repeat(self.start[sets] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                pair.append(np.repeat(np.arange(len(some)), n)[place >= 128])
                other.append(place[place >= 128])
            key = np.sort(np.concatenate(pair) * len(self.place) + np.concatenate(other))
            both[some] += np.bincount(key[1:][key[1:] == key[:-1]] // len(self.place), minlength=len(some)).astype(np.int32)
        return both


def _met(sets: _Sets, left: np.ndarray, right: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, similarity) of sets of left and right above the threshold; where left and right are one, each pair once."""
    same = left is right
    of_size = [[(int(k), rows[sets.n[rows] == k]) for k in np.unique(sets.n[rows])] for rows in (left, right)]
    for n, xs in of_size[0]:
        for m, ys in of_size[1]:
            need = least_overlap(n, m, similarity)
            if need is None or (same and m < n):
                continue
            for at in range(0, len(xs), ROWS):
                x = xs[at : at + ROWS]
                for to in range(at if same and m == n else 0, len(ys), COLUMNS):
                    y = ys[to : to + COLUMNS]
                    found = np.flatnonzero(sets.most(x, y) >= need)
                    i, j = x[found // len(y)], y[found % len(y)]
                    if same and m == n:
                        i, j = i[i < j], j[i < j]
                    both = sets.shared(i, j)
                    sure = both >= need
                    yield i[sure], j[sure], both[sure] / (n + m - both[sure])


def _pairs_of_parts(similarity: float) -> Callable:
    """(part, id, codes) of a group (..., p, q) to the pairs of part p with part q."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, codes = (table.column(k).combine_chunks() for k in ("id", "codes"))
        sets = _Sets(pc.list_value_length(codes).to_numpy(), pc.list_flatten(codes).to_numpy())
        part, p, q = table.column("part").to_numpy(), key[-2].as_py(), key[-1].as_py()
        left = np.flatnonzero(part == p)
        right = left if p == q else np.flatnonzero(part == q)
        held, size = [], 0
        for found in chain(_met(sets, left, right, similarity), [None]):
            if found and len(found[0]):
                held.append(found)
                size += len(found[0])
            if size >= (FOUND if found else 1):
                i, j, alike = (np.concatenate(x) for x in zip(*held, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(alike)], names=["a", "b", "similarity"])
                held, size = [], 0

    return run


def _pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity) of sets (block, id, chars) of a block, a before b; sets are not empty, ids differ over all blocks and a block may be null."""
    blocks = sets.groupBy(F.col("block").alias("of")).agg(F.count("*").alias("n"))
    blocks = blocks.select("of", F.greatest(F.least(F.lit(PARTS), F.ceil(F.col("n") / LEAST)), F.ceil(F.col("n") / LARGEST)).cast("int").alias("parts"))
    n, groups = blocks.agg(F.count("*"), F.coalesce(F.sum(F.expr("parts * (parts + 1L) div 2")), F.lit(1))).first()
    dealt = sets.join(small_side(blocks, n, 256), F.col("block").eqNullSafe(F.col("of"))).withColumn("part", F.expr("cast(pmod(xxhash64(id), parts) as int)"))
    dealt = dealt.select("block", "id", "part", F.transform("chars", lambda c: F.ascii(c)).alias("codes"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("block", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "id", "codes")
    dealt = dealt.repartition(min(groups, max(TASKS, groups // 4)), "block", "p", "q")
    kind = sets.schema["id"].dataType
    found = dealt.groupBy("block", "p", "q").applyInArrow(_pairs_of_parts(similarity), StructType().add("a", kind).add("b", kind).add("similarity", "double"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def similar_pairs(titles: DataFrame, key: str, title: str, similarity: float) -> DataFrame:
    """(a, b, similarity) of the classes whose similarity is above the threshold; a class is named by its least key.

    Null and empty titles are like nothing.
    """
    sets = titles.select(F.col(key).alias("id"), char_set(F.col(title)).alias("chars")).where(F.size("chars") > 0).groupBy("chars").agg(F.min("id").alias("id"))
    return _pairs(written(sets.withColumn("block", F.lit(0)), "sets"), similarity)


def _led(classes: DataFrame, similarity: float) -> DataFrame:
    """block, chars, first and leader (the first of the leader's class) of every class (block, chars, first)."""
    waiting = written(classes, "classes")
    done: list[DataFrame] = []
    for _ in range(ROUNDS):
        nth = F.row_number().over(Window.partitionBy("block").orderBy("first"))
        next_ones = waiting.withColumn("__n", nth).where(F.col("__n") <= WIDTH).groupBy(F.col("block").alias("__block")).agg(F.sort_array(F.collect_list(F.struct("first", "chars"))).alias("__next"))
        like = lambda x: lambda led: jaccard(led["chars"], x["chars"]) > similarity
        leaders = F.aggregate("__next", F.slice("__next", 1, 0), lambda led, x: F.when(F.exists(led, like(x)), led).otherwise(F.concat(led, F.array(x))))
        next_ones = written(next_ones.select("__block", leaders.alias("__led")), "next")
        met = waiting.join(small_side(next_ones, next_ones.count(), 40_000), F.col("block").eqNullSafe(F.col("__block")))
        found = F.get(F.filter("__led", lambda led: jaccard(led["chars"], F.col("chars")) > similarity), F.lit(0))["first"]
        judged = written(met.select("block", "chars", "first", found.alias("leader")), "judged")
        forget(waiting)
        forget(next_ones)
        done.append(judged)
        waiting = written(judged.where("leader is null").drop("leader"), "classes")
        if waiting.isEmpty():
            break
    else:
        # Numbers in the order of first.
        numbered = written(waiting.orderBy("first").withColumn("node", F.monotonically_increasing_id()), "numbered")
        links = _pairs(numbered.select("block", F.col("node").alias("id"), "chars"), similarity).select("a", "b")
        led = first_come_by_links(numbered.select("node"), links)
        leaders = numbered.select(F.col("node").alias("leader"), F.col("first").alias("led_by"))
        rest = numbered.join(led, "node").join(leaders, "leader").select("block", "chars", "first", F.col("led_by").alias("leader"))
        done.append(written(rest, "judged"))
        forget(led)
        forget(numbered)
    forget(waiting)
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    out = written(every.where("leader is not null"), "led")
    for part in done:
        forget(part)
    return out


def dedup_titles(items: DataFrame, block: str, order: str, title: str = "title", similarity: float = 0.7) -> DataFrame:
    """Items whose title is not too like one kept before in their block; order has no ties within a block.

    Null and empty titles always stay; a null block is a block of its own.
    """
    chars = char_set(F.col(title))
    classes = items.where(F.size(chars) > 0).groupBy(F.col(block).alias("block"), chars.alias("chars")).agg(F.min(order).alias("first"))
    kept = _led(classes, similarity).where("first = leader").select(F.col("block").alias("__block"), F.col("first").alias("__first"))
    with_title = items.where(F.size(chars) > 0).join(kept, F.col(block).eqNullSafe(F.col("__block")) & (F.col(order) == F.col("__first")), "left_semi")
    return with_title.unionByName(items.where(F.size(chars) == 0))


def event_clusters(items: DataFrame, block: str, order: str, title: str = "title", source: str = "source", similarity: float = 0.55) -> DataFrame:
    """Items with event_key (the leader's title as matched) and event_heat: ten a source, and one a member up to ten.

    Items whose title has nothing to match have no key and a heat of ten.
    """
    d = items.withColumn("__norm", text.match_title(F.col(title))).withColumn("__chars", char_set(F.col("__norm")))
    classes = d.where("__norm <> ''").groupBy(F.col(block).alias("block"), F.col("__chars").alias("chars")).agg(F.min(F.struct(F.col(order).alias("at"), F.col("__norm").alias("norm"))).alias("first"))
    led = _led(classes, similarity).select(F.col("block").alias("__block"), F.col("chars").alias("__set"), "leader")
    named = d.join(led, F.col(block).eqNullSafe(F.col("__block")) & (F.col("__chars") == F.col("__set")), "left").drop("__block", "__set", "__chars", "__norm")
    heat = named.where("leader is not null").groupBy(F.col(block).alias("__block"), F.col("leader").alias("__leader")).agg(
        (F.countDistinct(F.trim(F.coalesce(F.col(source), F.lit("")))) * 10 + F.least(F.lit(10), F.count("*"))).alias("event_heat")
    )
    out = named.join(heat, F.col(block).eqNullSafe(F.col("__block")) & (F.col("leader") == F.col("__leader")), "left")
    return out.select(*items.columns, F.col("leader.norm").alias("event_key"), F.coalesce("event_heat", F.lit(10)).alias("event_heat"))
