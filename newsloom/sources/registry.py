"""A registry of sources: enabled ones are read and put together, one that fails gives nothing."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Adapter:
    """A source: its name, whether it is enabled, and how it is read."""

    name: str
    read: Callable[[SparkSession], DataFrame]
    enabled: bool = True


def collected(spark: SparkSession, adapters: list[Adapter], schema: str) -> tuple[DataFrame, dict[str, str]]:
    """(rows of all enabled sources with the source's name as ``adapter``, outcome of each: ok, disabled or why it failed).

    Sources keep their own columns; the schema's columns are there even where nothing is read.  A source that cannot be
    opened or planned gives nothing; files that break or vanish while they are read are left out by the readers' own options
    (ignoreCorruptFiles, ignoreMissingFiles), which the reader of a source sets.
    """
    outcome, frames = {}, [spark.createDataFrame([], f"adapter string, {schema}")]
    for a in adapters:
        if not a.enabled:
            outcome[a.name] = "disabled"
            continue
        try:
            frame = a.read(spark).withColumn("adapter", F.lit(a.name))
            frame.schema  # noqa: B018  plans the source
        except (PySparkException, OSError, ValueError) as e:
            outcome[a.name] = f"failed: {type(e).__name__}"
            continue
        frames.append(frame)
        outcome[a.name] = "ok"
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames), outcome


@dataclass
class _Account(InputPartition):
    name: str
    url: str


class AccountSource(DataSource):
    """``spark.read.format("accounts")``: the answers of HTTP interfaces, a partition each.

    Options: an address for each account name, and ``timeout`` in seconds (8).  An account that cannot be reached, or answers with
    an error, gives no row, so that one source never fails a run.
    """

    @classmethod
    def name(cls) -> str:
        return "accounts"

    def schema(self) -> str:
        return "account string, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _AccountReader({k: v for k, v in self.options.items() if k != "timeout"}, float(self.options.get("timeout", "8")))


class _AccountReader(DataSourceReader):
    def __init__(self, accounts: dict[str, str], timeout: float) -> None:
        self.accounts, self.timeout = accounts, timeout

    def partitions(self) -> list[InputPartition]:
        return [_Account(n, u) for n, u in sorted(self.accounts.items())]

    def read(self, partition: _Account) -> Iterator[tuple[str, str]]:
        try:
            with urllib.request.urlopen(partition.url, timeout=self.timeout) as answer:  # noqa: S310
                body = answer.read().decode("utf-8", "replace")
        except (OSError, ValueError):
            return
        yield partition.name, body
