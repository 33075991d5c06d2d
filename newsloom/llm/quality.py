"""Quality rules: cross-document line frequency, as DataFrame operations only.

Lines are normalised and hashed; for each host (``source``) the distinct
documents of a line are counted, where exact copies of a text count once.  A
line above the limit is removed from every document but the first of its host
(smallest doc_id).  A document that keeps fewer than ``min_words`` words, or
less than ``min_share`` of them, is depleted and rejected.

A hot line costs one row per document before the count and one per task after
it (partial aggregation); the join back is on (host, line), which adaptive
execution broadcasts or splits when skewed.

Edge cases: a null or empty text has no words and fails the base rules; a null
source is a host of its own; repeated rows get the same verdict; an empty table
gives an empty result; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row even where lambdas mention it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words covered by a window of WINDOW words that stands twice or more in the array."""

    def covered(hashes: Column) -> Column:
        def of_sorted(pairs: Column) -> Column:
            same = lambda e, j: (F.get(pairs, j - 1)["h"] == e["h"]) | (F.get(pairs, j + 1)["h"] == e["h"])
            at = F.array_sort(F.transform(F.filter(pairs, lambda e, j: F.coalesce(same(e, j), F.lit(False))), lambda e: e["i"]))
            gaps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1), x + WINDOW) - x))
            return let(at, lambda p: F.aggregate(gaps(p), F.lit(0), lambda a, x: a + x))

        # Neighbours of equal hash meet by sorting: n log n also for very long texts.
        edge = let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), edge).otherwise(F.lit(0))

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return let(words, lambda w: F.when(F.size(w) > WINDOW, let(windows(w), covered)).otherwise(F.lit(0))).cast("long")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normalised(line: Column) -> Column:
    """Lower-case letters A-Z, digits as 0, one space for white space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"), SPACES, " "))


def base_columns(text: Column) -> dict[str, Column]:
    words = F.array_remove(F.split(text, SPACES, -1), "")
    lines = lines_of(text)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def row_key() -> Column:
    """A hash of doc_id, source and text in which a null is not the same as leaving it out."""
    return F.xxhash64("doc_id", F.col("source").isNull(), "source", F.col("text").isNull(), "text")


def with_key(docs: DataFrame) -> DataFrame:
    """source, doc_id, body (text without nulls) and a key of the whole row."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", body.alias("body"), row_key().alias("row_key"))


def frequent_lines(docs: DataFrame, min_docs: int = 20, max_share: float = 0.02) -> DataFrame:
    """host, line, n_docs, first_doc of every line that more than max(min_docs, max_share of the host's documents) hold.

    Exact copies of a text are one document, on both sides of the share.
    """
    rows = with_key(docs)
    of_hosts = rows.select("source", F.xxhash64("body").alias("body_key")).distinct()
    hosts = of_hosts.groupBy(F.col("source").alias("h")).agg(F.count("*").alias("host_docs"))
    hashes = F.array_distinct(F.transform(lines_of(F.col("body")), lambda x: F.xxhash64(normalised(x))))
    # What stands beside a generator is computed once a line, so the key and the hashes come first; an inner generator
    # would also test the size of the array below that projection, and so compute it twice.
    lines = rows.select("source", "doc_id", F.xxhash64("body").alias("body_key"), hashes.alias("hashes")).select("source", "doc_id", "body_key", F.explode_outer("hashes").alias("line")).where("line is not null")
    once = lines.groupBy("source", "line", "body_key").agg(F.min("doc_id").alias("doc_id"))
    counts = once.groupBy("source", "line").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where(F.col("n_docs") > min_docs)
    # hosts are a small dimension next to the lines; adaptive execution picks the join
    over = counts.join(hosts, F.col("source").eqNullSafe(F.col("h"))).where(F.col("n_docs") > F.col("host_docs") * max_share)
    return over.select(F.col("source").alias("host"), "line", "n_docs", "first_doc")


def line_losses(docs: DataFrame, min_docs: int = 20, max_share: float = 0.02) -> DataFrame:
    """row_key, n_words, n_lost (the words in removed lines) and lost_lines (hashes of these) of the documents that lose lines.

    Rows that repeat share a key, so n_lost adds up over them; it is divided by their number.
    """
    found = frequent_lines(docs, min_docs, max_share)
    pieces = F.transform(lines_of(F.col("body")), lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(F.array_remove(F.split(x, SPACES, -1), "")).alias("n")))
    lines = with_key(docs).select("row_key", "doc_id", "source", F.size(F.array_remove(F.split("body", SPACES, -1), "")).alias("n_words"), pieces.alias("pieces"))
    lines = lines.select("row_key", "doc_id", "source", "n_words", F.inline_outer("pieces")).where("line is not null")
    lost = lines.join(found.withColumnRenamed("line", "l"), (F.col("line") == F.col("l")) & F.col("source").eqNullSafe(F.col("host"))).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    lost = lost.groupBy("row_key").agg(F.sum("n").alias("n_lost"), F.first("n_words").alias("n_words"), F.collect_set("line").alias("lost_lines"))
    copies = with_key(docs).groupBy("row_key").agg(F.count("*").alias("copies"))
    return lost.join(copies, "row_key").select("row_key", "n_words", (F.col("n_lost") / F.col("copies")).alias("n_lost"), "lost_lines")


def line_frequency_quality(docs: DataFrame, min_docs: int = 20, max_share: float = 0.02, min_words: int = 10, min_share: float = 0.2) -> DataFrame:
    """doc_id, the base columns, base_failed and kept for every row of docs."""
    base = with_key(docs).select("doc_id", "row_key", *[c.alias(n) for n, c in base_columns(F.col("body")).items()])
    losses = line_losses(docs, min_docs, max_share).select("row_key", "n_lost")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    left = F.col("n_words") - F.coalesce("n_lost", F.lit(0))
    return base.join(losses, "row_key", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (left >= min_words) & (left >= F.col("n_words") * min_share)).alias("kept"),
        left.cast("long").alias("n_words_left"),
    )


def reject_by_lines(docs: DataFrame, min_docs: int = 20, max_share: float = 0.02, min_words: int = 10, min_share: float = 0.2) -> DataFrame:
    """docs without the rejected documents, columns unchanged."""
    left = F.col("n_words") - F.col("n_lost")
    depleted = line_losses(docs, min_docs, max_share).where((left < min_words) | (left < F.col("n_words") * min_share))
    depleted = depleted.select(F.col("row_key").alias("__row_key"))
    base = base_columns(F.coalesce(F.col("text"), F.lit("")))
    passed = docs.where(~base_failed(base["n_words"], base["n_repeat_words"]))
    return passed.withColumn("__row_key", row_key()).join(depleted, "__row_key", "left_anti").drop("__row_key")


def remove_lines(docs: DataFrame, min_docs: int = 20, max_share: float = 0.02, min_words: int = 10, min_share: float = 0.2) -> DataFrame:
    """docs without the rejected documents, and texts without the frequent lines; columns unchanged, n_chars follows the text.

    Copies of a text count once on both sides of the share.  The first document of a host keeps its lines, and
    so do lines without words; a text that loses none stays as it is.
    """
    names = docs.columns
    losses = line_losses(docs, min_docs, max_share)
    losses = losses.select(F.col("row_key").alias("__row_key"), F.col("n_words").alias("__n_words"), F.col("n_lost").alias("__n_lost"), F.col("lost_lines").alias("__lost_lines"))
    base = base_columns(F.coalesce(F.col("text"), F.lit("")))
    passed = docs.where(~base_failed(base["n_words"], base["n_repeat_words"])).withColumn("__row_key", row_key())
    left = F.col("__n_words") - F.col("__n_lost")
    kept = passed.join(losses, "__row_key", "left").where(F.col("__n_lost").isNull() | ((left >= min_words) & (left >= F.col("__n_words") * min_share)))
    stays = lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~F.array_contains("__lost_lines", F.xxhash64(normalised(x)))
    text = F.when(F.col("__n_lost").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n", -1), stays), "\n"))
    cleaned = kept.withColumn("text", text)
    if "n_chars" in names:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("__n_lost").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return cleaned.select(*names)
