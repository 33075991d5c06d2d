"""Tables in the folder that driver and executors share: where lineage ends, and what is deleted again."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below so many bytes.
BROADCAST_BYTES = 16_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where none is configured, a local one will do for a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/newsloom-checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._newsloom_path = path
    return back


def forget(df: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    path = getattr(df, "_newsloom_path", None)
    if path:
        remove(df.sparkSession, path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A written() whose tables are deleted when the block ends; what the block returns must not read them any more."""
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    try:
        yield keep
    finally:
        for table in made:
            forget(table)


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df, marked for broadcast if its counted rows are few enough; else the join may shuffle it."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
