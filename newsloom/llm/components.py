"""Connected components of a table of links, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _mark(edges: DataFrame) -> tuple:
    """Number of rows and a hash over all of them, in one small aggregate."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (smallest reachable node) for every node of links (a, b long).

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each
    moves every node's links to its smallest neighbour, so a long chain shortens
    by half a round and no node ever gathers the links of its component in a
    group by itself: stars only aggregate a minimum.  Rounds are written to the
    shared folder, which cuts lineage, and each deletes the one before it.  Nulls
    and self-links are ignored.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        before, before_mark = edges, mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours above a node link to the node's smallest neighbour
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: neighbours below a node, and the node, link to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small, "links")
        mark = _mark(edges)
        forget(before)
        if mark == before_mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = written(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops), "components")
    forget(edges)
    return found


def merged_components(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (node, component) after more links: only links between different components are settled anew."""
    one, two = (parts.select(F.col("node").alias(x), F.col("component").alias(f"{x}_part")) for x in ("a", "b"))
    known = links.join(one, "a", "left").join(two, "b", "left")
    ends = known.select(*[F.coalesce(f"{x}_part", x).alias(x) for x in ("a", "b")])
    grown = connected_components(ends)
    moved = grown.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = parts.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # Components that were single nodes so far have no row in parts.
    new = grown.join(parts.select("node"), "node", "left_anti")
    found = written(old.unionByName(new), "components")
    forget(grown)
    return found
