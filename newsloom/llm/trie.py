"""Prefix trie of conversations: which openings are shared, by how many, and what sharing saves.

A conversation becomes the array of its turns' keys (128 bits of the sha256 of
role and text) and is sorted by it over the whole table, so that all that share
an opening stand side by side, whatever the order of keys.  One sweep over each
sorted partition compares neighbours: the turns two of them have in common (their
longest common prefix) tell which nodes of an open stack end and which begin.  A
node that begins and ends within a partition is done there.  Those on the path of
a partition's first or last row may go on next door; they leave the sweep as open
pieces, at most two paths a partition, and a second sweep over the pieces alone
stitches them by the keys of their turns.  Children of stitched nodes learn their
parent's number in a join with that small table.

Conversation ids are part of the sort key, so a group of equal conversations of
any size is spread over partitions like any other rows.  Ids that end at a
stitched node are hashed in order from one string a partition.

Edge cases: a null role or text counts as empty, turns come null first and equal
turn numbers by key; rows without conv_id are left out; a table without
conversations has no nodes, not even a root; repeated rows are repeated turns; a
conversation's keys (16 bytes a turn) travel as one row; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_side, word_count, written

KEY_BYTES = 16
#: A sorted partition holds about so many turns.
PARTITION_TURNS = 250_000
#: Rows in an outgoing batch.
BATCH = 8192


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: an array of (key as hex, words) in the order of turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY_BYTES)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), key.alias("key"), word_count(text).alias("words"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def with_common_heads(turns: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """turn_arrays() with the first h turns of each taken from the first conversation of its block of ids, h = crc32 of the id modulo ``heads``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = turns.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), h.alias("h"))
    first = turns.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads).alias("head"))
    none = F.slice("turns", 1, 0)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(first, "base", "left").select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), rest).alias("turns"))


_SWEPT = "kind int, part int, side int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, turn binary, words long, stays boolean"
_SWEPT_ARROW = pa.schema(
    [("kind", pa.int32()), ("part", pa.int32()), ("side", pa.int32()), *((c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends", pa.string()), ("turn", pa.binary()), ("words", pa.int64()), ("stays", pa.bool_())]
)
#: Kinds of swept rows: a node and its parent's number, a node whose parent is open (its side and part are the parent's), an open piece.
DONE, BELOW, OPEN = range(3)
LEFT, RIGHT = range(2)


class Node:
    """A node on the stack: what is known of it without its open children."""

    __slots__ = ("turn", "words", "left", "low", "n", "ends", "kids", "n_children", "leaves", "saved")

    def __init__(self, turn: bytes, words: int, left: bool) -> None:
        self.turn, self.words, self.left = turn, words, left
        self.low: int | None = None
        self.n = self.n_children = self.leaves = self.saved = 0
        self.ends: list[str] = []
        self.kids: list[tuple] = []  # closed children, until this node's number is known

    def members(self, n: int, low: int | None) -> None:
        self.n += n
        if low is not None:
            self.low = low if self.low is None else min(self.low, low)

    def child(self, n: int, low: int, leaves: int, saved: int) -> None:
        self.members(n, low)
        self.n_children += 1
        self.leaves += leaves
        self.saved += saved

    def totals(self) -> tuple[int, int, int, int]:
        """Members, smallest member, leaves and saved tokens, this node included."""
        return self.n, self.low, self.leaves if self.n_children else 1, self.saved + (self.n - 1) * self.words


def _hash(ends: str) -> str:
    return hashlib.sha256(ends.encode()).hexdigest()


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def sweep(rows: Iterator[tuple[int, bytes, list[int]]], part: int) -> Iterator[tuple]:
    """Swept rows of one sorted partition: (conv_id, keys laid end to end, words of each turn)."""
    stack: list[Node] = []

    def kids(node: Node, depth: int, side: int | None) -> Iterator[tuple]:
        for k in node.kids:
            yield (DONE, None, None, depth + 1, k[0], node.low, *k[1:], None, None, None) if side is None else (BELOW, part, side, depth + 1, k[0], None, *k[1:], None, None, None)

    def piece(node: Node, depth: int, side: int, stays: bool) -> tuple:
        return OPEN, part, side, depth, node.low, None, node.n, node.n_children, node.leaves, node.saved, ",".join(node.ends), node.turn, node.words, stays

    def close() -> Iterator[tuple]:
        node, depth = stack.pop(), len(stack)
        if node.left:
            yield from kids(node, depth, LEFT)
            yield piece(node, depth, LEFT, False)
            return
        yield from kids(node, depth, None)
        n, low, leaves, saved = node.totals()
        parent = stack[-1]
        parent.child(n, low, leaves, saved)
        parent.kids.append((low, n, node.n_children, leaves, saved, _hash(",".join(node.ends))))

    for conv_id, keys, words in rows:
        first = not stack
        if first:
            stack.append(Node(b"", 0, True))
        turns = [keys[k : k + KEY_BYTES] for k in range(0, len(keys), KEY_BYTES)]
        common = 0
        while common < len(turns) and common + 1 < len(stack) and stack[common + 1].turn == turns[common]:
            common += 1
        while len(stack) > common + 1:
            yield from close()
        for k in range(common, len(turns)):
            stack.append(Node(turns[k], words[k], first))
        stack[-1].members(1, conv_id)
        stack[-1].ends.append(str(conv_id))
    while stack:
        node, depth = stack.pop(), len(stack)
        side = LEFT if node.left else RIGHT
        yield from kids(node, depth, side)
        yield piece(node, depth, side, True)


def _sweeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    rows = (r for b in batches for r in zip(b.column("conv_id").to_pylist(), b.column("keys").to_pylist(), b.column("words").to_pylist(), strict=True))
    yield from _batches(sweep(rows, TaskContext.get().partitionId()), _SWEPT_ARROW)


_STITCHED = "node long, parent long, part int, side int, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_STITCHED_ARROW = pa.schema([("node", pa.int64()), ("parent", pa.int64()), ("part", pa.int32()), ("side", pa.int32()), *((c, pa.int64()) for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))])


def stitch(pieces: Iterator[dict]) -> Iterator[tuple]:
    """Whole nodes (part null), and the node that each piece belongs to (conv_id null), from pieces in order of part, side and depth."""
    stack: list[tuple[int, Node]] = []
    made = 0

    def close() -> Iterator[tuple]:
        number, node = stack.pop()
        n, low, leaves, saved = node.totals()
        if stack:
            stack[-1][1].child(n, low, leaves, saved)
        yield number, stack[-1][0] if stack else None, None, None, len(stack), low, n, node.n_children, leaves, saved

    def close_part(stays: int | None) -> Iterator[tuple]:
        while stays is not None and len(stack) > stays:
            yield from close()

    part, stays, matching = None, None, False
    for p in pieces:
        if p["part"] != part:
            yield from close_part(stays)
            part, stays, matching = p["part"], 0, True
        if p["side"] == RIGHT and len(stack) > p["depth"]:
            # What the first row's path had below goes no further than this partition.
            while len(stack) > p["depth"]:
                yield from close()
        if p["side"] == LEFT:
            matching = matching and len(stack) > p["depth"] and stack[p["depth"]][1].turn == p["turn"]
            if not matching:
                while len(stack) > p["depth"]:
                    yield from close()
        if p["side"] == RIGHT or not matching:
            made += 1
            stack.append((made, Node(p["turn"], p["words"], False)))
        number, node = stack[p["depth"]]
        node.members(p["n_convs"], p["conv_id"])
        node.n_children += p["n_children"]
        node.leaves += p["n_leaves"]
        node.saved += p["saved_tokens"]
        stays = p["depth"] + 1 if p["stays"] else stays
        yield number, None, part, p["side"], p["depth"], None, None, None, None, None
    while stack:
        yield from close()


def _stitcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(stitch(r for b in batches for r in b.to_pylist()), _STITCHED_ARROW)


def _ends_hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, ends_sha256 from (node, part, ends) in order."""

    def hashed() -> Iterator[tuple]:
        node, state = None, None
        for b in batches:
            for n, ends in zip(b.column("node").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if n != node:
                    if node is not None:
                        yield node, state.hexdigest()
                    node, state, any_yet = n, hashlib.sha256(), False
                if ends:
                    state.update(b"," * any_yet + ends.encode())
                    any_yet = True
        if node is not None:
            yield node, state.hexdigest()

    yield from _batches(hashed(), pa.schema([("node", pa.int64()), ("ends_sha256", pa.string())]))


def prefix_trie(turns: DataFrame, partition_turns: int = PARTITION_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the trie of turn_arrays()."""
    spark = turns.sparkSession
    with scratch() as keep:
        flat = turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("keys"), F.transform("turns", lambda t: t["words"]).alias("words"))
        flat = keep(flat, "turns")
        n = flat.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // partition_turns))
        ordered = flat.repartitionByRange(parts, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
        swept = keep(ordered.mapInArrow(_sweeper, _SWEPT), "swept")
        pieces = swept.where(F.col("kind") == OPEN).select("part", "side", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "turn", "words", "stays")
        # At most two paths a partition, whatever it holds.
        stitched = keep(pieces.repartition(1).sortWithinPartitions("part", "side", "depth").mapInArrow(_stitcher, _STITCHED), "stitched")
        numbers = stitched.where("part IS NOT NULL").select("node", "part", "side", "depth")
        whole = stitched.where("part IS NULL").drop("part", "side")
        few = stitched.count()
        ends = swept.where(F.col("kind") == OPEN).select("part", "side", "depth", "ends")
        ends = ends.join(small_side(numbers, few, 40), ["part", "side", "depth"]).select("node", "part", "ends")
        hashes = ends.repartition("node").sortWithinPartitions("node", "part").mapInArrow(_ends_hasher, "node long, ends_sha256 string")
        above = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        out = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        top = whole.join(hashes, "node").join(small_side(above, few, 40), "parent", "left").select(*out)
        parents = numbers.join(whole.select("node", F.col("conv_id").alias("number")), "node").select("part", "side", (F.col("depth") + 1).alias("depth"), "number")
        below = swept.where(F.col("kind") == BELOW).join(small_side(parents, few, 40), ["part", "side", "depth"])
        below = below.withColumn("parent_conv_id", F.col("number")).withColumnRenamed("ends", "ends_sha256").select(*out)
        done = swept.where(F.col("kind") == DONE).withColumnRenamed("ends", "ends_sha256").select(*out)
        return written(done.unionByName(below).unionByName(top), "trie")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they stand."""
    return prefix_trie(turn_arrays(conversations))
