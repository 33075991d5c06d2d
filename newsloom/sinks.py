"""Writers: insert-if-new with counts, snapshots that replace their own partitions, issues in versions.

Tables are folders of Parquet files.  Each writer makes one pass over its input and is
safe to run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written


def append_new(new: DataFrame, table: str, keys: list[str], order: list[Column]) -> dict[str, int]:
    """Appends the rows of ``new`` that share no key with the table; returns {written, duplicates, failed}.

    Of rows of ``new`` with equal keys the first counts, the others are duplicates; a row without the first key fails, other
    null keys are no keys.  Counts come from the job that writes, by ``observe``.  The table must exist: existing() makes an empty one.
    """
    spark = new.sparkSession
    have = spark.read.schema(new.schema).parquet(table)
    judged = new.withColumn("__failed", F.col(keys[0]).isNull()).withColumn("__twice", F.lit(False))
    for k in keys:
        # Rows without this key are spread by the others, so that they do not meet in one task.
        spread = F.when(F.col(k).isNull(), F.xxhash64(*[c for c, kind in new.dtypes if "map<" not in kind]))
        place = F.row_number().over(Window.partitionBy(k, spread).orderBy(*order))
        known = have.where(F.col(k).isNotNull()).select(F.col(k).alias("__k")).distinct().withColumn("__known", F.lit(True))
        judged = judged.withColumn("__place", place).join(known, F.col(k) == F.col("__k"), "left")
        judged = judged.withColumn("__twice", F.col("__twice") | (F.col(k).isNotNull() & (F.col("__known").isNotNull() | (F.col("__place") > 1)))).drop("__place", "__k", "__known")
    counts = Observation("append_new")
    fresh = ~F.col("__failed") & ~F.col("__twice")
    seen = judged.observe(counts, F.count_if(fresh).alias("written"), F.count_if(~F.col("__failed") & F.col("__twice")).alias("duplicates"), F.count_if("__failed").alias("failed"))
    seen.where(fresh).select(*new.columns).write.mode("append").parquet(table)
    return dict(counts.get)


def existing(spark: SparkSession, table: str, schema) -> None:
    """Makes an empty table where there is none."""
    try:
        spark.read.parquet(table).schema  # noqa: B018
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        spark.createDataFrame([], schema).write.mode("append").parquet(table)


def replace_snapshot(df: DataFrame, table: str, group: str, order: list[Column], n: int = 20) -> None:
    """Writes the first n rows of each group as that group's partition; partitions of other groups stay as they are."""
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
    first.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(table)


class Issues:
    """A day's issues in versions: the current one of each day, an archive of those superseded, and a pointer.

    ``current`` holds a partition a day, ``archive`` one a day and version, ``pointer`` one row.  Publishing writes the
    archive first and the pointer last: a run that is cut off leaves the pointer at the issue before, and runs again.
    """

    def __init__(self, spark: SparkSession, where: str, schema: str) -> None:
        """schema: the columns of an item, day and version not among them."""
        self.spark, self.where = spark, where
        self.schema = f"{schema}, day string, version int, published_at long"
        self.archived = f"{schema}, published_at long, archived_at long, day string, version int"
        for name, columns in (("current", self.schema), ("archive", self.archived)):
            existing(spark, f"{where}/{name}", columns)

    def current(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.where}/current")

    def archive(self) -> DataFrame:
        return self.spark.read.schema(self.archived).parquet(f"{self.where}/archive")

    def pointer(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.where}/pointer")

    def publish(self, issues: DataFrame, as_of: int) -> int:
        """Publishes the items of each day of ``issues`` as its next version and returns how many days there are; a day without items keeps its issue."""
        now = self.current()
        last = now.groupBy("day").agg(F.max("version").alias("last"))
        days = issues.where("day is not null").select("day").distinct().join(last, "day", "left")
        days = written(days.select("day", F.coalesce("last", F.lit(0)).alias("last")), "issue-days")
        held = now.join(days.select("day"), "day", "left_semi").withColumn("archived_at", F.lit(as_of).cast("long"))
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "version").parquet(f"{self.where}/archive")
        made = issues.join(days, "day").withColumn("version", (F.col("last") + 1).cast("int")).withColumn("published_at", F.lit(as_of).cast("long")).drop("last")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.where}/current")
        newest = days.orderBy(F.desc("day")).limit(1).select("day", (F.col("last") + 1).cast("int").alias("version"), F.lit(as_of).cast("long").alias("upgraded_at"))
        if not newest.isEmpty():
            newest.coalesce(1).write.mode("overwrite").parquet(f"{self.where}/pointer")
        return days.count()

    def purge(self, as_of: int, keep_seconds: int = 7 * 86400) -> None:
        """Deletes archived issues older than that, by partition."""
        from .shared import remove

        old = self.archive().groupBy("day", "version").agg(F.max("archived_at").alias("at")).where(F.col("at") < as_of - keep_seconds)
        for r in old.select("day", "version").toLocalIterator():  # a folder each: days, not items
            remove(self.spark, f"{self.where}/archive/day={r.day}/version={r.version}")
