"""Importance resampling towards a target distribution, on hashed n-gram features.

The bucket of an n-gram is the CRC-32 of its words joined by single spaces, modulo the number of buckets. No such string
is ever made: each word's CRC is computed once, and CRCs of n-grams are composed from them. Appending m bytes to a
message multiplies its CRC by a power of x modulo the polynomial, which is a linear map over GF(2); so

    crc(a + b) = shift(crc(a), len(b)) ^ crc(b)

where shift is the product of the matrices of the powers of two in len(b). A matrix is kept as four tables of 256 columns'
sums, so that applying it to an array of CRCs is four look-ups.

At scale: texts are read twice and never move. A task's features leave it as at most one count for each bucket; the table
of gains has one number for each bucket. The draw sorts narrow rows by ranges of score, and a row's rank is its place in
its range plus the sizes of the ranges before it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settled, steps, utf8, with_row_id, written

BUCKETS = 10_000
MOST_WORDS = 2
LEAST_WORDS = 20
SHARE_PERCENT = 10
SEED = "2024"
#: Words of at most so many bytes are handled together, longer ones one at a time.
TOGETHER = 48
POLYNOMIAL = 0xEDB88320

# bytes of words: digits, letters, and all of other than ASCII characters; upper-case ones are lower-cased first
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


def _step_table() -> np.ndarray:
    """What the register's low byte turns into when a byte is fed: the table of the usual CRC loop."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(POLYNOMIAL), value >> 1)
    return value


STEP = _step_table()


def _as_tables(columns: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), given by the images of the 32 single bits, as four tables of 256 images each."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.array([np.bitwise_xor.reduce(np.where(bits, columns[8 * k : 8 * k + 8], 0).astype(np.uint32), axis=1) for k in range(4)])


def _applied(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


@cache
def _shift_by_power(k: int) -> np.ndarray:
    """The matrix of 2**k zero bytes: that of one byte, or the square of the one before."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if not k:
        return _as_tables(STEP[unit & 255] ^ (unit >> 8))
    half = _shift_by_power(k - 1)
    return _as_tables(_applied(half, _applied(half, unit)))


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers after so many zero bytes each."""
    crc, k = crc.astype(np.uint32), 0
    while (length >> k).any():
        crc = np.where((length >> k) & 1, _applied(_shift_by_power(k), crc), crc)
        k += 1
    return crc


def joined(left: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """CRC-32 of left texts, each followed by a right one of that length, from the CRCs of both."""
    return shift(left, right_length) ^ right


SPACE_CRC = np.uint32(zlib.crc32(b" "))


def word_crcs(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each word raw[start : start + length]. Byte by byte over all words that have one there."""
    order = np.argsort(-length, kind="stable")
    by_length = length[order]
    long = int(np.searchsorted(-by_length, -TOGETHER, side="left"))
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    at = start[order]
    most = int(by_length[long]) if long < len(order) else 0
    # how many words have a byte at each place
    alive = len(order) - np.searchsorted(by_length[::-1], np.arange(most), side="right")
    for j in range(most):
        now = slice(long, alive[j])
        crc[now] = STEP[(crc[now] ^ raw[at[now] + j]) & 255] ^ (crc[now] >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~crc
    for i in order[:long]:
        out[i] = zlib.crc32(raw[start[i] : start[i] + length[i]])
    return out


def features(raw: np.ndarray, at: np.ndarray, most_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1, 2, ... most_words: CRC of each run of n words, the text that it is in, and the words of each text.
    raw and at: the bytes of the texts, and where each begins and the last ends."""
    raw = _LOWER[raw]
    inside = _INSIDE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    first[edge], last[edge - 1] = inside[edge], inside[edge - 1]  # words end with their text
    start = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - start
    doc = np.searchsorted(at, start, side="right") - 1
    words = np.bincount(doc, minlength=len(at) - 1)
    own = word_crcs(raw, start, length)
    crc = own
    for n in range(1, most_words + 1):
        if n > 1:
            # runs of n words: those of n - 1 words, a space, and the word behind them, in the same text
            crc = joined(joined(crc[:-1], SPACE_CRC, np.int64(1)), own[n - 1 :], length[n - 1 :])
        same = doc[: max(len(doc) - n + 1, 0)] == doc[n - 1 :]
        yield crc[same], doc[n - 1 :][same], words
        if len(doc) < n + 1:
            return


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select("rid", "doc_id", "text")


def bucket_counts(docs: DataFrame, text_col: str = "text", most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket. A task sends one count for each of its buckets."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            raw, at = utf8(b.column(0))
            for i, j in steps(at):
                for crc, _, _ in features(raw[at[i] : at[j]], at[i : j + 1] - at[i], most_words):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    sums = docs.select(F.col(text_col).cast("string")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():  # as many rows as buckets at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares of each bucket, rounded down."""
    rooms = len(source)
    ratio = (target + 1.0) * (source.sum() + float(rooms)) / ((source + 1.0) * (target.sum() + float(rooms)))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """One row for each document row: rid, doc_id, n_words, n_features, weight.

    weight: the sum of the gains of the document's features; without features it is 0. Null texts have no words; repeated
    rows are counted and weighed each. Without target rows, or without documents, shares are those of the smoothing."""
    gain = gains(bucket_counts(docs, text_col, most_words, buckets), bucket_counts(target, target_text_col, most_words, buckets))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = utf8(b.column(2))
            n_words, number, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for i, j in steps(at):
                for crc, doc, words in features(raw[at[i] : at[j]], at[i : j + 1] - at[i], most_words):
                    n_words[i:j] = words
                    number[i:j] += np.bincount(doc, minlength=j - i)
                    total = np.r_[0, np.cumsum(gain[crc % np.uint32(buckets)])]
                    ends = np.searchsorted(doc, np.arange(j - i + 1))
                    weight[i:j] += total[ends[1:]] - total[ends[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (n_words, number, weight))], names=["rid", "doc_id", "n_words", "n_features", "weight"])

    rows = _rows(docs, id_col, text_col)
    return rows.mapInArrow(weighed, f"rid long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Adds 1, 2, 3, ... in that order, which has to decide between any two rows. Rows are sorted by ranges; the driver sees
    the size of each range only."""
    spark = df.sparkSession
    # places in a range mean something only while the ranges stay, so the sorted rows are written
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    sorted_rows = written(sorted_rows.withColumn("__range", F.shiftright("__at", 33).cast("int")).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1)))
    sizes = sorted(sorted_rows.groupBy("__range").count().collect())
    before, offsets = 0, []
    for number, n in sizes:
        offsets.append((number, before))
        before += n
    offset = spark.createDataFrame(offsets, "__range int, __before long")
    return sorted_rows.join(F.broadcast(offset), "__range").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__range", "__at", "__before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", most_words: int = MOST_WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share_percent: int = SHARE_PERCENT, seed: str = SEED) -> DataFrame:
    """One row for each document row: rid, doc_id, n_words, n_features, weight, score, rank.

    score: the weight in thousandths plus Gumbel noise of the seed and the id, so that the highest scores are a draw
    without replacement. Of the documents with so many words at least, that share (rounded down) is drawn; rank is null for
    the others. Ties go to the smaller id, then to the earlier row; a null id comes last and has the noise of the empty
    string. Empty tables give no rows."""
    docs = settled(docs)
    weights = weigh(docs, target, id_col, text_col, target_text_col, most_words, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weights.withColumn("score", F.col("weight") + noise))
    able = F.col("n_words") >= least_words
    wanted = scored.filter(able).count() * share_percent // 100
    # those that can be drawn come first, so one order serves all rows
    placed = ranked(scored, [able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("rid").asc()])
    return placed.withColumn("rank", F.when(able & (F.col("rank") <= wanted), F.col("rank")))
