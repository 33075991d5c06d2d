"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of ``SLOTS`` positions.  A
document's key is its text, so equal texts start at one position.  A shard
holds at most its share of all bytes; what overflows continues clockwise to the
next virtual node whose shard has room.

The ring has a fixed number of positions, so the load of each position is a
table of at most ``SLOTS`` rows whatever the input: the driver walks that table
only, and the rows are placed by running sums on the executors.  A position
that holds very many rows (a third of all documents may be copies) is cut into
pieces by document, so no task sorts a hot group whole.

Edge cases: a null text weighs 8 bytes, has the crc32 of the empty text and
shares its ring position; repeated rows are separate rows; an empty table gives
an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 65536
#: Bytes a row costs besides its text.
ROW_BYTES = 8


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order."""
    spot = lambda s, v: int(hashlib.md5(f"shard-{s}-vnode-{v}".encode()).hexdigest()[:4], 16)
    return sorted((spot(s, v), s) for s in range(shards) for v in range(vnodes))


def place_loads(loads: list[tuple[int, int]], points: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Bounded loads over (position, bytes): rows (position, from, to, shard), bytes of a position in running order.

    In each round every position with bytes left offers them to its next virtual
    node clockwise, lowest position first.
    """
    total = sum(b for _, b in loads)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    starts = [p for p, _ in points]
    left = [[slot, 0, size, bisect.bisect_left(starts, slot)] for slot, size in sorted(loads)]
    out = []
    while left:
        later = []
        for slot, done, size, node in left:
            shard = points[node % len(points)][1]
            fits = min(size - done, room[shard])
            if fits or not size:
                out.append((slot, done, done + fits, shard))
                room[shard] -= fits
            if done + fits < size:
                later.append([slot, done + fits, size, node + 1])
        left = later
    # The last piece of a position also takes what stands exactly at its end.
    return out


def consistent_hash_shards(docs: DataFrame, shards: int = 24, vnodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    The law is ``bytes``: shares of all bytes are equal to within a document, so
    adding a shard also moves what overflows, and grown_shard is null.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    ).withColumn("spot", F.shiftrightunsigned("key", 48).cast("int"))
    spots = [(r.spot, r.n, r.size) for r in rows.groupBy("spot").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()]
    n_rows = sum(n for _, n, _ in spots)
    piece = min(200_000, max(64, n_rows // 4096))
    shares = place_loads([(s, size) for s, _, size in spots], ring_points(shards, vnodes), shards)
    pieces = {s: -(-n // piece) for s, n, _ in spots}
    ring = F.broadcast(spark.createDataFrame([(s, k) for s, k in pieces.items()] or [(0, 1)], "spot int, pieces int"))  # at most SLOTS rows
    last = {}
    for spot, lo, _, shard in shares:
        last[spot] = max(last.get(spot, -1), lo)
    owners = F.broadcast(spark.createDataFrame([(s, lo, hi if lo < last[s] else None, k) for s, lo, hi, k in shares] or [(0, 0, None, 0)], "spot int, lo long, hi long, shard int"))  # at most SLOTS + shards rows

    rows = rows.join(ring, "spot").withColumn("piece", F.pmod(F.xxhash64("doc_id", "key"), F.col("pieces")).cast("int"))
    sums = rows.groupBy("spot", "piece").agg(F.sum("size").alias("piece_size"))
    before = sums.select("spot", "piece", (F.sum("piece_size").over(Window.partitionBy("spot").orderBy("piece")) - F.col("piece_size")).alias("offset"))
    run = Window.partitionBy("spot", "piece").orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("start", F.coalesce(F.sum("size").over(run), F.lit(0)))
        .join(before, ["spot", "piece"])
        .withColumn("middle", F.col("offset") + F.col("start") + F.shiftright("size", 1))
        .join(owners, "spot")
        .where((F.col("middle") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("middle") < F.col("hi"))))
    )
    counts = placed.groupBy("shard", "spot", "piece").agg(F.count("*").alias("n"))
    bases = counts.select("shard", "spot", "piece", (F.sum("n").over(Window.partitionBy("shard").orderBy("spot", "piece")) - F.col("n")).alias("base"))
    place = Window.partitionBy("shard", "spot", "piece").orderBy("key", "doc_id", "size", "text_crc32")
    return (
        placed.withColumn("nth", F.row_number().over(place))
        .join(bases, ["shard", "spot", "piece"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
