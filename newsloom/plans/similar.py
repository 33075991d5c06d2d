"""Queries over titles that are alike by their characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similar
from .documents import ITEMS, MATCH, items
from .registry import query

CHARS = "list_sort(list_distinct(string_split({}, '')))"
ALIKE = "len(list_intersect({0}, {1})) / CAST(len({0}) + len({1}) - len(list_intersect({0}, {1})) AS DOUBLE)"


@query(f"""WITH {ITEMS}, s AS (SELECT min(id) AS id, {CHARS.format("title")} AS chars FROM items WHERE title <> '' GROUP BY chars)
SELECT x.id AS a, y.id AS b, {ALIKE.format("x.chars", "y.chars")} AS similarity FROM s x JOIN s y ON x.id < y.id WHERE similarity > CAST(0.8 AS DOUBLE)""")
def similar_title_pairs(t):
    return similar.similar_pairs(items(t("documents")).select("id", "title"), "id", "title", 0.8)


def _fold(sql_title: str, threshold: float) -> str:
    """Leaders of each source in order of ids, one item a step."""
    return f"""r AS (SELECT id, source, {sql_title} AS name, {CHARS.format(sql_title)} AS chars, row_number() OVER (PARTITION BY source ORDER BY id) AS n FROM items WHERE {sql_title} <> ''),
g AS (SELECT source, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST([] AS STRUCT(name VARCHAR, chars VARCHAR[])[]) AS led, CAST(NULL AS VARCHAR) AS leader FROM (SELECT DISTINCT source FROM r)
  UNION ALL SELECT source, n, id, CASE WHEN len(near) = 0 THEN list_append(led, struct_pack(name := name, chars := chars)) ELSE led END, CASE WHEN len(near) = 0 THEN name ELSE near[1].name END
  FROM (SELECT r.source, r.n, r.id, r.name, r.chars, g.led, list_filter(g.led, lambda k: {ALIKE.format("k.chars", "r.chars")} > CAST({threshold} AS DOUBLE)) AS near FROM g JOIN r ON r.source IS NOT DISTINCT FROM g.source AND r.n = g.n + 1))"""


@query(f"""WITH RECURSIVE {ITEMS}, {_fold("title", 0.7)},
k AS (SELECT *, len(led) > coalesce(lag(len(led)) OVER (PARTITION BY source ORDER BY n), 0) AS kept FROM g)
SELECT id FROM k WHERE n > 0 AND kept UNION ALL SELECT id FROM items WHERE title = ''""")
def fuzzy_title_dedup(t):
    return similar.dedup_titles(items(t("documents")).select("id", "source", "title"), "source", "id").select("id")


@query(f"""WITH RECURSIVE {ITEMS}, {_fold(MATCH, 0.55)},
h AS (SELECT source, leader, CAST(10 + least(10, count(*)) AS BIGINT) AS heat FROM g WHERE n > 0 GROUP BY source, leader)
SELECT items.id, g.leader AS event_key, coalesce(h.heat, 10) AS event_heat FROM items LEFT JOIN g ON g.id = items.id LEFT JOIN h ON h.source IS NOT DISTINCT FROM g.source AND h.leader = g.leader""")
def event_cluster_heat(t):
    # One source a block, so every event has one source.
    d = items(t("documents")).select("id", "source", "title")
    return similar.event_clusters(d, "source", "id").select("id", "event_key", F.col("event_heat").cast("long").alias("event_heat"))
