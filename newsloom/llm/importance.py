"""Importance resampling of documents towards a target distribution.

Features are word runs of one to three words, hashed into buckets.  A bucket's
gain is its log odds in the target texts over those in all documents, as whole
thousandths; a document's weight is the sum of its features' gains, read from an
array of gains.  Gumbel noise drawn from the doc_id is added, so that taking the
highest scores draws without replacement in proportion to the weights.

The draw sorts no table.  Scores are integers, so an exact histogram (one row a
score) replaces the documents; its suffix sums give the number of documents above
each score, and where they reach the size of the draw lies the cutoff.  Suffix
sums run over ``BINS`` equal stretches of the range of scores first and then
within each stretch.  Only documents at the cutoff or above are joined with their
offsets, and row_number by doc_id within a score gives the rank.

Hashing is numpy over Arrow batches.  A run's crc32 is composed from its words'
(a crc is linear: that of AB is that of A shifted by the bytes of B, xor that of
B), so no run is ever built as a string.  Counts leave a task once, as one row a
bucket.  Texts are read twice; nothing but numbers is shuffled.

Edge cases: a null or wordless text has no features and weight 0; a null doc_id
draws with the noise of an empty one and ranks last among equal scores; repeated
rows are separate rows with equal scores and ranks in a row; with too few
documents for a whole draw no rank is given; an empty target takes its odds from
the smoothing alone; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, small_side, written
from .ngrams import ranges

BUCKETS = 10_000
ORDER = 3
MIN_WORDS = 20
PERCENT = 5
BINS = 4096
CHUNK_BYTES = 4_000_000
#: Shifts by fewer bytes than this have a table each; longer ones are put together from powers of two.
SHORT = 64
#: What a byte becomes: lower case for A-Z, a space for any other ASCII character but letters and digits.
_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def _crc_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Shift tables [byte of the crc][value]: one for each short length, and one for each power of two from SHORT on."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    short = np.empty((SHORT, 4, 256), np.uint32)
    short[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, SHORT):
        short[n] = (short[n - 1] >> 8) ^ one[short[n - 1] & 255]
    last = short[SHORT - 1]
    powers = [(last >> 8) ^ one[last & 255]]
    while len(powers) < 26:
        powers.append(_through(powers[-1], powers[-1]))
    return short.reshape(-1), powers


def _through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


_SHORT, _POWERS = _crc_tables()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc32 values after n more zero bytes each, up to the constants that cancel when the crc of those bytes is xored in."""
    at = (n % SHORT) * 1024
    out = _SHORT[at + (crc & 255)] ^ _SHORT[at + 256 + ((crc >> 8) & 255)] ^ _SHORT[at + 512 + ((crc >> 16) & 255)] ^ _SHORT[at + 768 + (crc >> 24)]
    rest = n // SHORT
    for k, table in enumerate(_POWERS):
        if not rest.any():
            break
        odd = np.flatnonzero(rest & 1)
        out[odd] = _through(table, out[odd])
        rest = rest >> 1
    return out


def _words(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Index of the text that each word stands in, and the words as a dictionary array."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    plain = _BYTES[np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    texts = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(plain.tobytes()))
    parts = pc.ascii_split_whitespace(texts)
    words = parts.values.dictionary_encode()
    doc = np.repeat(np.arange(len(column)), np.diff(parts.offsets.to_numpy()))
    blank = pc.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()
    if blank >= 0:  # what split leaves at the ends of a text
        keep = words.indices.to_numpy() != blank
        return doc[keep], words.filter(pa.array(keep))
    return doc, words


def features(column: pa.Array, buckets: int, order: int = ORDER) -> Iterator[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For each stretch of texts: begin, end, words of each text, and for each run length (text of each run, bucket of each run)."""
    for begin, end in ranges(column, CHUNK_BYTES):
        doc, words = _words(column.slice(begin, end - begin))
        known = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        space = zlib.crc32(b" ")
        single = np.fromiter((zlib.crc32(w) for w in known), np.uint32, len(known))
        spaced = np.fromiter((zlib.crc32(w, space) for w in known), np.uint32, len(known))
        length = np.fromiter(map(len, known), np.int64, len(known)) + 1
        at = words.indices.to_numpy()
        crc, found = single[at], []
        for n in range(1, order + 1):
            if n > 1:
                crc = shifted(crc[: max(0, len(at) - n + 1)], length[at[n - 1 :]]) ^ spaced[at[n - 1 :]]
            whole = doc[: len(crc)] == doc[n - 1 :] if len(crc) else np.zeros(0, bool)
            found.append((doc[: len(crc)][whole], (crc[whole] % np.uint32(buckets)).astype(np.int64)))
        yield begin, end, np.bincount(doc, minlength=end - begin), found


def _counter(buckets: int, order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found in features(batch.column("text"), buckets, order):
                for _, bucket in found:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": some, "n": total[some]}, pa.schema([("bucket", pa.int64()), ("n", pa.int64())]))

    return count


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """bucket, n: features of all texts; each task sends one row a bucket."""
    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counter(buckets, order), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> list[int]:
    """The gain of each bucket: ``buckets`` integers, whatever the corpus."""
    spark = docs.sparkSession
    sides = bucket_counts(docs, buckets, order).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    sides = sides.unionByName(bucket_counts(target, buckets, order).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    sides = sides.unionByName(spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    counts = sides.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    sums = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    odds = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    rows = counts.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(odds)).cast("long").alias("gain")).collect()
    return [r.gain for r in sorted(rows, key=lambda r: r.bucket)]


_WEIGHED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def _weigher(gains: list[int], order: int):
    array = np.array(gains, np.float64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, n_words, found in features(batch.column("text"), len(array), order):
                weight = sum(np.bincount(doc, array[bucket], end - begin) for doc, bucket in found)  # whole numbers below 2**53
                n_features = sum(np.bincount(doc, minlength=end - begin) for doc, _ in found)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), *(pa.array(x.astype(np.int64)) for x in (n_words, n_features, weight))], schema=_WEIGHED)

    return weigh


def importance_scores(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, order: int = ORDER, seed: str = "42:") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs."""
    gains = bucket_gains(docs, target, buckets, order)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = rows.mapInArrow(_weigher(gains, order), "doc_id long, n_words long, n_features long, weight long")
    digits = F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / 4294967296.0
    return weighed.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long"))


def ranked(scored: DataFrame, drawn: int, low: int, high: int, keep) -> DataFrame:
    """The rows of scored (doc_id, score, ...) that are among the ``drawn`` highest scores, with their rank from 1; ties to the smaller doc_id."""
    width = -(-(high - low + 1) // BINS)
    hist = keep(scored.groupBy("score").agg(F.count("*").alias("n")).withColumn("bin", F.floor((F.col("score") - low) / width)), "histogram")
    # At most BINS rows, however many documents.
    coarse = hist.groupBy("bin").agg(F.sum("n").alias("bin_n"))
    coarse = coarse.select("bin", (F.sum("bin_n").over(Window.orderBy(F.desc("bin"))) - F.col("bin_n")).alias("bin_above"))
    within = F.sum("n").over(Window.partitionBy("bin").orderBy(F.desc("score"))) - F.col("n")
    offsets = hist.withColumn("within", within).join(F.broadcast(coarse), "bin")
    offsets = keep(offsets.select("score", (F.col("bin_above") + F.col("within")).alias("above")).where(F.col("above") < drawn), "offsets")
    found = offsets.agg(F.min("score").alias("cutoff"), F.count("*").alias("rows")).first()
    survivors = scored.where(F.col("score") >= found.cutoff).join(small_side(offsets, found.rows, 16), "score")
    rank = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    return survivors.withColumn("rank", F.when(rank <= drawn, rank)).drop("above")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, order: int = ORDER, seed: str = "42:") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs; rank is null where a document is not drawn.

    The draw takes ``percent`` of the documents with at least ``min_words`` words.
    """
    none = F.lit(None).cast("long")
    with scratch() as keep:
        scored = keep(importance_scores(docs, target, buckets, order, seed), "importance")
        fit = scored.where(F.col("n_words") >= min_words)
        found = fit.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
        drawn = percent * found.n // 100
        if not drawn:
            return written(scored.withColumn("rank", none), "resampled")
        top = keep(ranked(fit, drawn, found.low, found.high, keep), "ranked")
        least = top.agg(F.min("score")).first()[0]
        rest = scored.where((F.col("n_words") < min_words) | (F.col("score") < least)).withColumn("rank", none)
        return written(rest.unionByName(top.select(rest.columns)), "resampled")


def resampled_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents themselves, columns unchanged: all rows of each drawn doc_id."""
    drawn = importance_resample(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["drawn_id"]), "left_semi")
