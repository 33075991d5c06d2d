"""Logs, boards and commit lists in Markdown or plain lines, as Column expressions; nulls and other texts give empty arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed, text


def _lines(body: Column) -> Column:
    return F.split(F.coalesce(body, F.lit("")), r"\r?\n", -1)


def log_blocks(body: Column) -> Column:
    """array<struct<time, who, content, body>> of the blocks that a heading ``## [date time] what | 会话：[who]`` begins.

    time is as it stands, ``yyyy-MM-dd`` or with the minutes; content is the heading without time, who, back quotes and signs in front.
    """
    blocks = F.filter(F.split(F.coalesce(body, F.lit("")), r"(?m)^(?=##\s+\[)", -1), lambda b: b.rlike(r"^##\s+\["))

    def block(b: Column) -> Column:
        head = F.regexp_replace(F.regexp_extract(b, r"^[^\r\n]*", 0), r"^##\s+", "")
        what = F.regexp_replace(F.regexp_replace(F.regexp_replace(head, r"^\[[^\]]+\]\s*", ""), r"\s*\|\s*会话：.*$", ""), "`", "")
        return F.struct(
            F.regexp_extract(head, r"\[(\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2})?)\]", 1).alias("time"), F.regexp_extract(head, r"会话：\[([^\]]+)\]", 1).alias("who"), text.trimmed(F.regexp_replace(what, fixed.LEADING_SIGNS, "")).alias("content"),
            F.regexp_replace(F.regexp_replace(b, r"^[^\r\n]*(\r?\n)?", ""), r"\r\n", "\n").alias("body"),
        )

    return F.transform(blocks, block)


def board_rows(body: Column) -> Column:
    """array<struct<id, name, owner, priority, status, sign>> of a table's rows: from the first cell that looks like a task's id on; empty cells do not count."""
    rows = F.filter(_lines(body), lambda x: F.contains(x, F.lit("|")) & ~x.rlike(r"^\|[\s-]+\|$"))
    cells = F.filter(F.transform(rows, lambda x: F.filter(F.transform(F.split(x, r"\|", -1), text.trimmed), lambda c: c != "")), lambda c: F.size(c) >= 5)

    def row(c: Column) -> Column:
        at = F.array_position(F.transform(c, lambda x: x.rlike(r"^[A-Z]{1,5}-\d+$")), F.lit(True)).cast("int")
        cell = lambda k: F.coalesce(F.get(c, at - 1 + k), F.lit(""))
        return F.struct(F.when(at > 0, cell(0)).alias("id"), *[cell(k + 1).alias(n) for k, n in enumerate(("name", "owner", "priority", "status"))], F.regexp_extract(cell(4), fixed.STATUS_SIGNS, 0).alias("sign"))

    kind = "array<struct<id: string, name: string, owner: string, priority: string, status: string, sign: string>>"
    return F.filter(F.transform(cells, row).cast(kind), lambda r: r["id"].isNotNull())


def commits(body: Column) -> Column:
    """array<struct<hash, author, date, subject>> of lines ``hash|author|date|subject``; a subject may hold bars."""
    parts = F.transform(F.filter(F.split(F.coalesce(body, F.lit("")), "\n", -1), lambda x: x != ""), lambda x: F.split(x, r"\|", 4))
    return F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).alias("hash"), *[F.coalesce(F.get(p, F.lit(k)), F.lit("")).alias(n) for k, n in ((1, "author"), (2, "date"))], text.trimmed(F.coalesce(F.get(p, F.lit(3)), F.lit(""))).alias("subject")))
