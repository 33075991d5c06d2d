"""Exports of message accounts: JSON or CSV files with a header, under several names for the same field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times

#: The names under which exports hold a field, in order of preference.
URL_NAMES = ["url", "app_msg_url", "link"]
TIME_NAMES = ["published_at", "publish_time", "create_time", "datetime"]
BODY_NAMES = ["content", "digest"]
NO_TITLE = "(无标题)"


#: Holds a row that could not be parsed, whole; null for the others.
BROKEN = "_broken"


def read_export(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Rows of an export, all columns as text, and BROKEN: form is lines (an object a line), json (an array a file) or csv (with a header).

    A row that cannot be parsed has its text in BROKEN and nulls elsewhere, so that it can be counted; good_rows() leaves it out.
    """
    if form == "csv":
        names = spark.read.csv(path, header=True).columns
        return spark.read.schema(", ".join(f"`{n}` string" for n in [*names, BROKEN])).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN)
    names = [*URL_NAMES, *TIME_NAMES, *BODY_NAMES, "title", "author", BROKEN]
    return spark.read.schema(", ".join(f"{n} string" for n in names)).json(path, multiLine=form == "json", mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN)


def good_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(BROKEN).isNull()).drop(BROKEN)


def export_items(rows: DataFrame) -> DataFrame:
    """url, title, published (epoch seconds, null if none), content and summary of export rows; fields that are missing are empty."""

    def first_of(names: list[str]) -> Column:
        return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in rows.columns], F.lit(""))

    body = first_of(BODY_NAMES)
    return rows.select(
        first_of(URL_NAMES).alias("url"), F.coalesce(F.nullif(first_of(["title"]), F.lit("")), F.lit(NO_TITLE)).alias("title"), times.parse_instant(first_of(TIME_NAMES)).alias("published"),
        F.substring(body, 1, 5000).alias("content"), F.substring(F.regexp_replace(body, r"\s+", " "), 1, 300).alias("summary"),
    )
