"""Greedy first-come selection without a fold: rows are settled in rounds over their conflicts.

A fold that keeps a row unless an earlier kept row conflicts with it gives, whatever
the conflicts, one set.  A round finds it in parallel: an open row with no open
earlier conflict is kept, and all that conflict with a kept row are dropped.  In an
order that has nothing to do with the conflicts, rounds grow with the logarithm of
the rows (Fischer and Noever 2018); a chain in order needs more, so a round also says
how many rows are left, and there is no limit on rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import forget, written


def first_come_by_keys(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Rows kept where two conflict if they share the value of any of the keys; order has no ties.

    Only keys and order take part in the rounds: minima by key, combined before the shuffle, so a value that a third of all
    rows share is no large group.  Rows without any key are kept; null keys conflict with nothing.
    """
    names = [f"k{n}" for n in range(len(keys))]
    rows = df.select(order.alias("o"), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    none = F.coalesce(*[F.when(F.col(n).isNotNull(), True) for n in names]).isNull()
    waiting = written(rows.where(~none), "waiting")
    rounds = []
    while not waiting.isEmpty():
        low = waiting
        for n in names:
            low = low.join(waiting.groupBy(n).agg(F.min("o").alias(f"min_{n}")), n, "left")
        lead = [F.coalesce(F.col("o") == F.col(f"min_{n}"), F.lit(True)) for n in names]
        leads = lead[0]
        for x in lead[1:]:
            leads = leads & x
        judged = written(low.withColumn("leads", leads).select("o", *names, "leads"), "judged")
        forget(waiting)
        winners = judged.where("leads")
        open_rows = judged.where("not leads")
        for n in names:
            open_rows = open_rows.join(winners.where(F.col(n).isNotNull()).select(n), n, "left_anti")
        waiting = written(open_rows.select("o", *names), "waiting")
        rounds.append(written(winners.select("o"), "kept"))
        forget(judged)
    forget(waiting)
    chosen = rows.where(none).select("o")
    for part in rounds:
        chosen = chosen.unionByName(part)
    out = written(df.withColumn("__o", order).join(chosen.withColumnRenamed("o", "__chosen"), F.col("__o").eqNullSafe(F.col("__chosen")), "left_semi").drop("__o"), "settled")
    for part in rounds:
        forget(part)
    return out


def first_come_by_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and leader of every node (long; the smaller comes first): the first kept node that it is linked with, itself if it is kept.

    links: (a, b) of conflicting nodes, in either order or both.
    """
    every = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    edges, waiting = every, written(nodes.select("node").distinct(), "waiting")
    done: list[DataFrame] = []
    while not waiting.isEmpty():
        # Links between open nodes only: both ends are still waiting.
        blocked = edges.where("b < a").select(F.col("a").alias("node")).distinct()
        kept = written(waiting.join(blocked, "node", "left_anti"), "kept")
        done.append(kept)
        gone = kept.union(edges.join(kept.withColumnRenamed("node", "b"), "b", "left_semi").select("a")).distinct()
        gone = written(gone, "gone")
        rest = written(waiting.join(gone, "node", "left_anti"), "waiting")
        fewer = written(edges.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "links")
        for old in (waiting, gone, *([edges] if edges is not every else [])):
            forget(old)
        waiting, edges = rest, fewer
    kept = nodes.select("node").limit(0)
    for part in done:
        kept = kept.unionByName(part)
    # Only now: a leader found in a later round may come before one found earlier.
    led = every.join(kept.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("b").alias("leader"))
    out = written(led.unionByName(kept.withColumn("leader", F.col("node"))), "leaders")
    for old in (waiting, every, *done, *([edges] if edges is not every else [])):
        forget(old)
    return out
