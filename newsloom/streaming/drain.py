"""Incremental runs: drain what has arrived, then stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..shared import place, remove


def drained(stream: DataFrame, output_mode: str = "append") -> DataFrame:
    """All rows of an append-only stream: each batch is appended once, by the sink's own log, and read back."""
    spark = stream.sparkSession
    where = place(spark, "stream")
    run = stream.writeStream.format("parquet").outputMode(output_mode).option("path", f"{where}/rows").option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")


def arrivals(batches: list[DataFrame], schema: StructType, start: Callable[[DataFrame, str], StreamingQuery]) -> None:
    """Runs a stream once for each batch, in order, as a job that is started whenever files have arrived.

    start(stream, log) gives the running query; log is its checkpoint, the same in each run, so state and offsets go on
    from run to run.
    """
    spark: SparkSession = batches[0].sparkSession
    inbox, log = place(spark, "inbox"), place(spark, "log")
    try:
        for batch in batches:
            batch.write.mode("append").parquet(inbox)
            start(spark.readStream.schema(schema).parquet(inbox), log).awaitTermination()
    finally:
        remove(spark, inbox)
        remove(spark, log)
