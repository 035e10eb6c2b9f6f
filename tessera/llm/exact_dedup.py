"""Exact duplicates through counting quotient filters.

Each partition builds a counting quotient filter of the 48-bit fingerprints of its texts: the upper 16 bits are the
quotient, the lower 32 the remainder, and each distinct (quotient, remainder) has a count. Filters are cut by quotient
into slices; slices of the same quotients merge without loss, because both keep their remainders sorted. Fingerprints
whose merged count is above one go to verification: their texts are grouped by the bytes themselves, so a shared
fingerprint never makes two different texts equal.

At scale: a filter holds one entry for a text however often the partition repeats it, so a hot text costs one entry a
partition; the number of slices follows the row count, so a merge is of bounded size; grouping by text combines copies
before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, joinable, small, settled, texts, trimmed, with_row_id

QUOTIENT_BITS = 16
REMAINDER_BITS = 32
#: Entries that a slice of the merged filter has on average at most.
SLICE_ENTRIES = 500_000
#: Bits of the filter that texts pass before they are moved: 128 MB at most.
FILTER_BITS = 30
#: Rows of a group from which on it counts as hot.
HOT_GROUP = 10_000
#: Entries that a task's filter gathers before it sends its slices on.
FILTER_ENTRIES = 2_000_000


class CountingQuotientFilter:
    """Sorted remainders with counts under each quotient, for the quotients from ``first`` on."""

    def __init__(self, first: int, quotients: int, keys: np.ndarray, counts: np.ndarray):
        self.first, self.quotients, self.keys, self.counts = first, quotients, keys, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        keys, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls(0, 1 << QUOTIENT_BITS, keys, counts.astype(np.uint32))

    def slices(self, number: int) -> Iterator[tuple[int, bytes]]:
        """Pieces by ranges of quotients: (slice, bytes); empty ones are left out."""
        width = (1 << QUOTIENT_BITS) // number
        edges = np.searchsorted(self.keys, (np.arange(number + 1, dtype=np.uint64) * np.uint64(width)) << np.uint64(REMAINDER_BITS))
        for i in np.flatnonzero(np.diff(edges)):
            part = slice(edges[i], edges[i + 1])
            yield int(i), CountingQuotientFilter(int(i) * width, width, self.keys[part], self.counts[part]).to_bytes()

    def to_bytes(self) -> bytes:
        """Entries under each quotient, then remainders, then counts; the quotients themselves are implied."""
        quotient = (self.keys >> np.uint64(REMAINDER_BITS)).astype(np.int64) - self.first
        runs = np.bincount(quotient, minlength=self.quotients).astype(np.uint32)
        return runs.tobytes() + (self.keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + self.counts.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, first: int, quotients: int) -> CountingQuotientFilter:
        words = np.frombuffer(raw, np.uint32)
        runs = words[:quotients]
        n = int(runs.sum())
        quotient = np.repeat(np.arange(first, first + quotients, dtype=np.uint64), runs)
        keys = (quotient << np.uint64(REMAINDER_BITS)) | words[quotients : quotients + n].astype(np.uint64)
        return cls(first, quotients, keys, words[quotients + n :])

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both in order of quotient and remainder; equal entries add their counts."""
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")  # two sorted runs: a merge
        keys, counts = keys[order], np.concatenate([self.counts, other.counts])[order].astype(np.int64)
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        counts = np.add.reduceat(counts, new) if len(new) else counts
        return CountingQuotientFilter(self.first, self.quotients, keys[new], np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))


def merged(filters: Iterator[CountingQuotientFilter]) -> CountingQuotientFilter | None:
    """All of them as one. Only filters of like size merge, so an entry moves once for each doubling, however many there are."""
    held: list[CountingQuotientFilter] = []
    for one in filters:
        while held and len(held[-1].keys) <= 2 * len(one.keys):
            one = held.pop().merge(one)
        held.append(one)
    while len(held) > 1:
        one = held.pop()
        held.append(held.pop().merge(one))
    return held[0] if held else None


def fingerprint(normalised: bytes) -> int:
    return xxhash.xxh3_64_intdigest(normalised) >> (64 - QUOTIENT_BITS - REMAINDER_BITS)


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, doc_id, fp, sha (hex of the normalised text) of each row."""

    @trimmed
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, sha = [], []
            for t in texts(b.column(2)):
                t = t.lower()  # of bytes: A-Z only
                fp.append(fingerprint(t))
                sha.append(hashlib.sha256(t).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64()), pa.array(sha, pa.string())], names=["rid", "doc_id", "fp", "sha"])

    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select("rid", "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(digest, f"rid long, doc_id {kind}, fp long, sha string")


def repeated_fingerprints(rows: DataFrame, number: int) -> DataFrame:
    """fp of each fingerprint that the merged filter counts more than once. rows: column fp. number: slices, a power of two."""
    width = (1 << QUOTIENT_BITS) // number

    @trimmed
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            pieces = list(CountingQuotientFilter.of(np.concatenate(parts)).slices(number))
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in pieces], pa.int32()), pa.array([x for _, x in pieces], pa.binary())], names=["slice", "filter"])

        held: list[np.ndarray] = []
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= FILTER_ENTRIES:
                yield out(held)
                held = []
        if sum(map(len, held)):
            yield out(held)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        first = int(key[0].as_py()) * width
        whole = merged(CountingQuotientFilter.from_bytes(raw.as_py(), first, width) for raw in table.column("filter"))
        return pa.table({"fp": whole.keys[whole.counts > 1].astype(np.int64)})

    built = rows.select("fp").mapInArrow(build, "slice int, filter binary")
    return built.groupBy("slice").applyInArrow(merge, "fp long")


def slices_for(rows: int) -> int:
    n = 1
    while n < 1 << QUOTIENT_BITS and rows > n * SLICE_ENTRIES:
        n *= 2
    return n


def _bitmap(repeated: DataFrame, number: int) -> tuple[int, np.ndarray]:
    """Bits and bytes of a filter of one hash over the repeated fingerprints: eight bits for each of them, 2**FILTER_BITS at
    most. It lets all of them pass; the bytes are gathered as words of 64 bits, so at most 2**FILTER_BITS / 8 bytes."""
    bits = min(FILTER_BITS, max(16, (8 * number).bit_length()))
    drop = QUOTIENT_BITS + REMAINDER_BITS - bits
    at = F.shiftright("fp", drop)
    words = repeated.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(shiftright(fp, {drop}), 64) as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits, out


def verified_groups(docs: DataFrame, repeated: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """sha, keep (doc_id and rid of the row that stays) and group_size of each text that more than one row has.

    Texts whose fingerprint is in ``repeated`` (checkpointed) are grouped by their bytes; copies in one partition are
    combined before the shuffle. A filter of bounded size leaves the others out where they are read, so they are not moved."""
    number = repeated.count()
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(repeated, number))

    @trimmed
    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words = shared.value
        drop = QUOTIENT_BITS + REMAINDER_BITS - bits
        for b in batches:
            norm, fp, row = [], [], []
            for i, t in enumerate(texts(b.column(2))):
                t = t.lower()
                f = fingerprint(t)
                at = f >> drop
                if int(words[at >> 6]) >> (at & 63) & 1:
                    norm.append(t)
                    fp.append(f)
                    row.append(i)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(fp, pa.int64()), pa.array(norm, pa.binary())], names=["rid", "doc_id", "fp", "norm"])

    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select("rid", "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(normalise, f"rid long, doc_id {kind}, fp long, norm binary").join(joinable(repeated), "fp", "left_semi")
    groups = found.groupBy("norm").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return groups.filter("group_size > 1").select(F.sha2("norm", 256).alias("sha"), "keep", "group_size")


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with the columns of their group, if they have one. Where groups are too many to broadcast, the large ones still
    are (each has HOT_GROUP rows at least), so that no key of the shuffled join is hot."""
    if small(groups):
        return rows.join(F.broadcast(groups), "sha", "left")
    large = checkpoint(groups.filter(F.col("group_size") >= HOT_GROUP))
    hot = rows.join(joinable(large), "sha", "left")
    alone = F.when(F.col("keep").isNull(), F.col("sha")).otherwise(F.concat(F.lit("#"), F.col("rid").cast("string")))
    cold = groups.filter(F.col("group_size") < HOT_GROUP).select(F.col("sha").alias("own"), F.col("keep").alias("keep_"), F.col("group_size").alias("size_"))
    both = hot.withColumn("own", alone).join(cold, "own", "left")
    return both.select("rid", "doc_id", "sha", F.coalesce("keep", "keep_").alias("keep"), F.coalesce("group_size", "size_").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: rid, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is the empty text and equals it. The row with the
    largest id stays (a null id is the smallest); of rows with the same id and text the last one stays. An empty table
    gives no rows; further columns of the input are not looked at."""
    docs = settled(docs)
    rows = checkpoint(fingerprints(docs, id_col, text_col))
    repeated = checkpoint(repeated_fingerprints(rows, slices_for(rows.count())))
    groups = checkpoint(verified_groups(docs, repeated, text_col, id_col))
    alone = F.col("keep").isNull()
    return _with_groups(rows.select("rid", "doc_id", "sha"), groups).select(
        "rid",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("keep.rid") == F.col("rid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the rows that ``exact_duplicates`` marks as not kept; all columns stay."""
    docs = settled(docs)
    dropped = checkpoint(exact_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("rid").alias("__rid")))
    return with_row_id(docs, "__rid").join(joinable(dropped), "__rid", "left_anti").drop("__rid")
