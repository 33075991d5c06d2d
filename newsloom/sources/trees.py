"""Rich text as a tree in JSON: its text in document order, whatever the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import forget, written

#: Levels of a tree that one job opens.
LEVELS = 6


def tree_texts(rows: DataFrame, key: str, json: str, path: str = "$.root.children") -> DataFrame:
    """key and text: the strings and ``text`` members of the tree's nodes in document order, a line each, runs of line breaks cut to two.

    A node with ``children`` gives its children and not its own text.  The tree is opened level by level over all rows at once,
    ``LEVELS`` levels a job, until nothing is left to open.  A null, broken or other JSON has an empty text; repeated keys
    count as one tree each row (they are told apart by row).
    """
    numbered = written(rows.select(F.col(key).alias("key"), F.col(json).alias("json")).withColumn("row", F.monotonically_increasing_id()), "trees")
    nodes = numbered.select("row", F.array().cast("array<int>").alias("path"), F.try_variant_get(F.try_parse_json("json"), path, "array<variant>").alias("children"))
    texts: list[DataFrame] = []
    while True:
        leaves = None
        for _ in range(LEVELS):
            opened = nodes.select("row", "path", F.posexplode("children").alias("at", "node")).select("row", F.concat("path", F.array("at")).alias("path"), "node")
            inner = F.try_variant_get("node", "$.children", "array<variant>")
            own = F.when(F.schema_of_variant("node") == "STRING", F.try_variant_get("node", "$", "string")).when(
                F.schema_of_variant(F.try_variant_get("node", "$.text", "variant")) == "STRING", F.try_variant_get("node", "$.text", "string")
            )
            opened = opened.select("row", "path", inner.alias("children"), own.alias("text"))
            said = opened.where("children IS NULL AND text IS NOT NULL").select("row", "path", "text")
            leaves = said if leaves is None else leaves.unionByName(said)
            nodes = opened.where("children IS NOT NULL").select("row", "path", "children")
        texts.append(written(leaves, "leaves"))
        left = written(nodes.select("row", "path", F.to_json("children").alias("json")), "open")
        if left.isEmpty():
            break
        nodes = left.select("row", "path", F.try_variant_get(F.parse_json("json"), "$", "array<variant>").alias("children"))
    every = texts[0]
    for part in texts[1:]:
        every = every.unionByName(part)
    joined = every.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "\n").alias("text"))
    tidy = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\n{3,}", "\n\n"))
    out = written(numbered.join(joined, "row", "left").select(F.col("key").alias(key), F.regexp_replace(tidy, r"^\s+|\s+$", "").alias("text")), "tree-texts")
    for part in (numbered, *texts):
        forget(part)
    return out
