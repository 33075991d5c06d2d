"""Sequential rules over a key's events, in constant memory: stretches first, then one pass over sorted rows.

A rule that forgets everything after a long enough gap is a fold over each stretch
without such a gap.  Stretches are found by pieces of a key's time (``BUCKET``
seconds), so a key with a third of all rows is many groups; a stretch is read row by
row, never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BUCKET = 86400


def with_stretch(events: DataFrame, key: str, at: str, gap: int, name: str = "stretch", bucket: int = BUCKET) -> DataFrame:
    """events (no null key or time) with the time at which their stretch began: one begins after ``gap`` seconds without an event."""
    e = events.withColumn("__b", F.floor(F.col(at) / bucket))
    inside = Window.partitionBy(key, "__b").orderBy(at)
    e = e.withColumn("__before", F.lag(at).over(inside))
    # One row a key and bucket: the last event of the bucket before.
    ends = e.groupBy(key, "__b").agg(F.max(at).alias("__end"))
    ends = ends.withColumn("__came", F.lag("__end").over(Window.partitionBy(key).orderBy("__b"))).drop("__end")
    e = e.join(ends, [key, "__b"]).withColumn("__new", F.coalesce(F.col(at) - F.coalesce("__before", "__came") >= gap, F.lit(True)))
    started = F.max(F.when(F.col("__new"), F.col(at))).over(inside.rangeBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("__start", started)
    last = e.groupBy(key, "__b").agg(F.max("__start").alias("__last"))
    carried = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("__carried", F.max("__last").over(carried)).drop("__last")
    out = e.join(last, [key, "__b"]).withColumn(name, F.coalesce("__start", "__carried"))
    return out.drop("__b", "__before", "__came", "__new", "__start", "__carried")


def judged(rows: DataFrame, keys: list[str], order: list[str], at: str, rule: Callable[[], Callable[[int], bool]], name: str = "accepted") -> DataFrame:
    """rows with the verdict of a rule on their times, in order, begun anew for each key."""
    schema = StructType(rows.schema.fields).add(name, "boolean")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, verdict = None, None
        for batch in batches:
            out = []
            for *key, when in zip(*(batch.column(c).to_pylist() for c in (*keys, at)), strict=True):
                if key != current:
                    current, verdict = key, rule()
                out.append(verdict(when))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=arrow.names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def hit_window(most: int, seconds: int) -> Callable[[], Callable[[int], bool]]:
    """So many hits in a window that every accepted hit extends; refused ones do not."""

    def begin() -> Callable[[int], bool]:
        last, count = None, 0

        def verdict(at: int) -> bool:
            nonlocal last, count
            if last is not None and at - last < seconds:
                if count >= most:
                    return False
                last, count = at, count + 1
            else:
                last, count = at, 1
            return True

        return verdict

    return begin


def limited_hits(events: DataFrame, user: str, at: str, tie: str, most: int = 5, seconds: int = 60) -> DataFrame:
    """events with accepted: at most ``most`` hits of a user in a window of so many seconds.

    The window starts at a hit and is extended by each accepted one; a refused hit leaves it as it is.  An event without user
    or time cannot be judged and passes.
    """
    known = events.where(F.col(user).isNotNull() & F.col(at).isNotNull())
    rest = events.where(F.col(user).isNull() | F.col(at).isNull()).withColumn("accepted", F.lit(True))
    rows = with_stretch(known, user, at, seconds, "__stretch")
    return judged(rows, [user, "__stretch"], [at, tie], at, hit_window(most, seconds)).drop("__stretch").unionByName(rest)


def debounced(events: DataFrame, key: str, at: str, quiet: int = 3600) -> DataFrame:
    """(key, at) of the alerts sent: one per key, then silence for quiet seconds; suppressed ones do not prolong it.

    Equal times of a key count once; events without key or time raise no alert.
    """
    known = events.select(key, F.col(at).cast("long").alias(at)).where(F.col(key).isNotNull() & F.col(at).isNotNull()).distinct()
    rows = with_stretch(known, key, at, quiet, "__stretch")
    sent = judged(rows, [key, "__stretch"], [at], at, hit_window(1, quiet), "__sent")
    return sent.where("__sent").select(key, at)
