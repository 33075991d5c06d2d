"""Streams that merge each batch into tables: a cursor for each source, and a day's brief in versions.

State lives in the tables themselves, one folder a batch: a batch reads what the
batches before it wrote and overwrites its own folder, so one that runs again, after
a lost driver or executor, changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed


class BatchTables:
    """Tables of a stream under one folder, with a folder for each batch."""

    def __init__(self, spark: SparkSession, where: str, **schemas: str) -> None:
        self.spark, self.where, self.schemas = spark, where, schemas
        for name, schema in schemas.items():
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{where}/{name}/batch=-1")

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """All rows, or those of the batches before this one; batch is their batch."""
        rows = self.spark.read.schema(f"{self.schemas[name]}, batch int").option("basePath", f"{self.where}/{name}").parquet(f"{self.where}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def put(self, name: str, rows: DataFrame, batch: int) -> None:
        columns = self.spark.createDataFrame([], self.schemas[name]).columns
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.where}/{name}/batch={batch}")


def take_from_cursor(batch: DataFrame, number: int, tables: BatchTables, source: str, at: str, now: Column, look_back: int = 86400) -> None:
    """One batch of each source's rows from its cursor (not included) to now (included), with cursors and counts.

    ``tables`` has kept (the rows' columns), cursors (source, cursor) and counts (source, kept, late, future, undated).
    A source without a cursor looks back so many seconds from the batch's latest now.  The cursor becomes the latest time
    kept; a source whose rows were all dropped stays where it was.  A null source is a source of its own.
    Only the cursors, one row a source, are joined to the rows: no row of a source is gathered.
    """

    cursors = tables.read("cursors", number).groupBy(F.col(source).alias("__source")).agg(F.max("cursor").alias("__cursor"))
    clock = batch.agg(F.max(now).alias("__latest"))
    dated = batch.join(cursors, F.col(source).eqNullSafe(F.col("__source")), "left").crossJoin(F.broadcast(clock))  # one row
    start = F.coalesce(F.col("__cursor"), F.col("__latest") - look_back)
    verdict = F.when(F.col(at).isNull(), "undated").when(F.col(at) <= start, "late").when(F.col(at) > now, "future").otherwise("kept")
    judged = dated.withColumn("__verdict", verdict)
    kept = judged.where("__verdict = 'kept'")
    tables.put("kept", kept, number)
    # Cursors follow what was written, not a second reading of the batch.
    mine = tables.read("kept").where(F.col("batch") == number)
    tables.put("cursors", mine.groupBy(source).agg(F.max(at).alias("cursor")), number)
    tables.put("counts", judged.groupBy(source).agg(*[F.count_if(F.col("__verdict") == v).alias(v) for v in ("kept", "late", "future", "undated")]), number)


def cursor_intake(rows: DataFrame, tables: BatchTables, source: str, at: str, now: Column, log: str, look_back: int = 86400) -> StreamingQuery:
    """A stream of take_from_cursor()."""
    each = lambda batch, number: take_from_cursor(batch, number, tables, source, at, now, look_back)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", log).trigger(availableNow=True).start()


BRIEF = "day string, version int, mode string, locked boolean, n_items long, items array<struct<score: double, id: long>>"


def publish_brief(batch: DataFrame, number: int, tables: BatchTables, cap: int = 20) -> None:
    """One batch of a running daily brief: rows (day, id, score, closes) are merged into the day's items, and a version is published.

    ``tables`` has items (day, id, score) and briefs (BRIEF).  A day's new items give the next version, of mode increment, of
    its ``cap`` best items; an item that comes again counts as it came last (the higher score within a batch).  A batch with a
    row that closes the day publishes the summary and locks the day; later items are not taken.  A day without any item is
    neither published nor locked.  Rows without a day, and items without id or score, count for nothing; such a row may
    still close its day.
    """

    briefs = tables.read("briefs", number)
    last = briefs.groupBy("day").agg(F.max("version").alias("last"), F.bool_or("locked").alias("was_locked"))
    open_rows = batch.where("day is not null").join(last.where("was_locked").select("day"), "day", "left_anti")
    fresh = open_rows.where("id is not null and score is not null").groupBy("day", "id").agg(F.max("score").alias("score"))
    tables.put("items", fresh, number)
    fresh = tables.read("items").where(F.col("batch") == number)
    closing = open_rows.where("closes").select("day").distinct().withColumn("closing", F.lit(True))
    touched = fresh.select("day").union(closing.select("day")).distinct()
    everything = tables.read("items", number + 1).join(touched, "day", "left_semi")
    current = everything.groupBy("day", "id").agg(F.max_by("score", "batch").alias("score"))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("score"), "id"))
    best = current.withColumn("rank", rank).where(F.col("rank") <= cap)
    made = best.groupBy("day").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("ranked"))
    made = made.join(last.select("day", "last"), "day", "left").join(closing, "day", "left")
    closes = F.coalesce("closing", F.lit(False))
    made = made.select(
        "day", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version"), F.when(closes, "summary").otherwise("increment").alias("mode"), closes.alias("locked"), "n_items",
        F.transform("ranked", lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("items"),
    )
    tables.put("briefs", made, number)


def brief_intake(rows: DataFrame, tables: BatchTables, log: str, cap: int = 20) -> StreamingQuery:
    """A stream of publish_brief()."""
    return rows.writeStream.foreachBatch(lambda batch, number: publish_brief(batch, number, tables, cap)).option("checkpointLocation", log).trigger(availableNow=True).start()


def source_alerts(counts: DataFrame, streak: Column, most: int = fixed.BULK_ROWS) -> DataFrame:
    """counts with alerts: the rules that a source's run (kept, written, duplicates, filtered, invalid) sets off, in their order."""
    total = F.col("kept")
    rules = {
        "disabled-empty": streak >= fixed.ERROR_STREAK,
        "high-duplicate": (total > 0) & (F.col("duplicates") / total > 0.5),
        "bulk-insert": F.col("written") >= most,
        "high-filter": (total > 0) & ((F.col("filtered") + F.col("invalid")) / total > 0.5),
    }
    found = [F.when(rule, F.array(F.lit(name))).otherwise(F.array().cast("array<string>")) for name, rule in rules.items()]
    return counts.withColumn("alerts", reduce(lambda a, b: F.concat(a, b), found))
