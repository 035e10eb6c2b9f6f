"""Near duplicates by SimHash, found through anchors of a covering code.

A 64-bit fingerprint is cut into blocks of 23, 23 and 18 bits (the last one padded with zeros to 23). The anchors of a
block are the 4,096 words of the perfect binary Golay code [23,12], which covers all block values with radius 3: each is
within 3 of exactly one anchor. The anchors of whole fingerprints are triples, and each fingerprint has one home triple.

A fingerprint is replicated to every anchor within the covering radius plus the threshold: to all triples whose distances
exceed 3 by ``max_bits`` at most, over the three blocks together. If two fingerprints differ in at most ``max_bits``, the
home of either is among the anchors of the other, so each pair meets where one of both is at home. A fingerprint has 130
anchors or so for 2 bits.

At an anchor, the fingerprints that are at home there are compared with all that are, and only a spanning forest of the
links leaves the comparison. An anchor with more than ANCHOR_ROWS fingerprints is refined instead: its members go to
anchors of covering radius 0 (all points within half the threshold of them), where any two that meet are linked, and a star
needs no comparison. Two fingerprints within the threshold have a midpoint, so both ways find the same components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain, combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, joinable, settled, texts, with_row_id
from tessera.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
#: Fingerprints of one anchor that are compared there; more are refined. It decides the way, not which links are found.
ANCHOR_ROWS = 1024
#: Shingles of a text that are hashed at once.
SHINGLES_AT_ONCE = 50_000

GOLAY = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code
RADIUS = 3
BLOCKS = ((0, 23), (23, 23), (46, 18))  # first bit and width


def fingerprint(text: bytes, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if over half of the hashes of the shingles, repeats included, have it; without words all are 0."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return 0
    k = min(words_in_shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: len(words) - k + 1], ends[k - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(first), SHINGLES_AT_ONCE):
        part = slice(i, i + SHINGLES_AT_ONCE)
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(first[part].tolist(), last[part].tolist(), strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """rid, doc_id, fp (as a signed long) of each row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, words_in_shingle) for t in texts(b.column(2))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["rid", "doc_id", "fp"])

    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select("rid", "doc_id", "text")
    return rows.mapInArrow(digest, f"rid long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


@cache
def _tables(excess: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Remainders modulo the generator of the upper 12 bits; for each distance beyond the radius (0: up to the radius) the
    error words of each remainder, one row each, filled up with -1."""

    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GOLAY << (bit - 11)
        return v

    upper = np.array([remainder(h << 11) for h in range(1 << 12)], np.int64)
    single = np.array([remainder(1 << x) for x in range(23)], np.int64)
    errors = []
    for beyond in range(excess + 1):
        words, left = [np.zeros(1, np.int64)] if not beyond else [], [np.zeros(1, np.int64)] if not beyond else []
        for n in (1, 2, 3) if not beyond else (RADIUS + beyond,):
            bits = np.array(list(combinations(range(23), n)))
            words.append((1 << bits).sum(axis=1))
            left.append(np.bitwise_xor.reduce(single[bits], axis=1))
        word, rest = np.concatenate(words), np.concatenate(left)
        order = np.argsort(rest, kind="stable")
        word, rest = word[order], rest[order]
        number = np.bincount(rest, minlength=1 << 11)
        table = np.full((1 << 11, number.max()), -1, np.int64)
        table[rest, np.arange(len(rest)) - (np.cumsum(number) - number)[rest]] = word
        errors.append(table)
    return upper, errors


def anchors(fp: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors within the radius plus ``excess``, a row for each fingerprint, the home first; and which places are filled."""
    upper, errors = _tables(excess)
    blocks = []
    for first, width in BLOCKS:
        v = (fp >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
        error = [table[upper[v >> 11] ^ (v & 0x7FF)] for table in errors]
        blocks.append([((v[:, None] ^ e) >> 11, e >= 0) for e in error])
    keys, filled = [], []
    for x, y, z in product(range(excess + 1), repeat=3):
        if x + y + z <= excess:
            (a, in_a), (b, in_b), (c, in_c) = blocks[0][x], blocks[1][y], blocks[2][z]
            key = a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :]
            keys.append(key.reshape(len(fp), -1))
            filled.append((in_a[:, :, None, None] & in_b[:, None, :, None] & in_c[:, None, None, :]).reshape(len(fp), -1))
    return np.concatenate(keys, axis=1), np.concatenate(filled, axis=1)


def _masks(reach: int) -> np.ndarray:
    return np.array([sum(1 << x for x in bits) for n in range(reach + 1) for bits in combinations(range(64), n)], np.uint64)


def _replicate(max_bits: int):
    """Rows (anchor, fp, home): one for each anchor of a fingerprint."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(every), 4000):
                fp = every[i : i + 4000]
                key, filled = anchors(fp.view(np.uint64), max_bits)
                row, place = np.nonzero(filled)
                yield pa.RecordBatch.from_arrays([pa.array(key[row, place]), pa.array(fp[row]), pa.array(place == 0)], names=["anchor", "fp", "home"])

    return out


def _midpoints(reach: int):
    """Rows (point, fp) for all points within ``reach`` of each fingerprint."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _masks(reach)
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(every), 4000):
                fp = every[i : i + 4000]
                points = fp.view(np.uint64)[:, None] ^ masks[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(points.view(np.int64).ravel()), pa.array(np.repeat(fp, len(masks)))], names=["point", "fp"])

    return out


def forest(fp: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and the first member that each reaches over links between those at home and all."""
    near = np.bitwise_count(fp[home][:, None] ^ fp[None, :]) <= max_bits
    label = np.arange(len(fp))
    while True:
        low = np.where(near, label[None, :], len(fp)).min(axis=1)
        new = np.minimum(label, np.where(near, low[:, None], len(fp)).min(axis=0))
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(fp)))
    return fp[other], fp[label[other]]


def _compare(max_bits: int):
    """Over rows sorted by anchor: rows (a, b) of a spanning forest for each anchor; b null for members of anchors to refine."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, home, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), None
        for b in chain(_of(batches), [None]):
            last = b is None
            if not last:
                key, fp, home = np.concatenate([key, b[0]]), np.concatenate([fp, b[1]]), np.concatenate([home, b[2]])
            if not len(key):
                continue
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            length = np.diff(np.r_[start, len(key)])
            whole = len(start) if last else len(start) - 1  # the last run may go on
            too_many = (length > ANCHOR_ROWS) | (key[start] == crowded if crowded is not None else False)
            inhabited = np.logical_or.reduceat(home, start)
            left, right, refine = [], [], [fp[start[j] : start[j] + length[j]] for j in np.flatnonzero(too_many[:whole])]
            few = start[:whole][(length == 2)[:whole] & ~too_many[:whole] & inhabited[:whole]]
            few = few[np.bitwise_count(fp.view(np.uint64)[few] ^ fp.view(np.uint64)[few + 1]) <= max_bits]
            left.append(fp[few])
            right.append(fp[few + 1])
            for j in np.flatnonzero((length > 2)[:whole] & ~too_many[:whole] & inhabited[:whole]):
                run = slice(start[j], start[j] + length[j])
                x, y = forest(fp[run].view(np.uint64), home[run], max_bits)
                left.append(x.view(np.int64))
                right.append(y.view(np.int64))
            rest = len(key)
            if not last:
                rest = start[-1]
                if too_many[-1]:  # sent on at once: a run of any length fits
                    crowded = int(key[rest])
                    refine.append(fp[rest:])
                    rest = len(key)
            key, fp, home = key[rest:], fp[rest:], home[rest:]
            a = np.concatenate([*left, *refine, np.zeros(0, np.int64)])
            b_ = np.concatenate([*right, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.concat_arrays([pa.array(b_), pa.nulls(len(a) - len(b_), pa.int64())])], names=["a", "b"])

    return out


def _of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        if b.num_rows:
            yield tuple(c.to_numpy(zero_copy_only=False) for c in b.columns)


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (point, fp): links each fingerprint to the first one of its point."""
    point = first = None
    for key, fp in _of(batches):
        new = np.r_[len(key) > 0 and (point is None or key[0] != point), key[1:] != key[:-1]][: len(key)]
        group = np.cumsum(new) - 1
        heads = fp[new]
        head = np.where(group < 0, first if first is not None else 0, heads[np.maximum(group, 0)] if len(heads) else 0)
        if len(key):
            point, first = int(key[-1]), int(head[-1])
        take = head != fp
        yield pa.RecordBatch.from_arrays([pa.array(fp[take]), pa.array(head[take].astype(np.int64))], names=["a", "b"])


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of different fingerprints whose components are those of all pairs within ``max_bits``. distinct: column fp."""
    if max_bits < 2 or max_bits % 2:
        raise ValueError("max_bits must be even and at least 2")
    near = distinct.mapInArrow(_replicate(max_bits), "anchor long, fp long, home boolean")
    found = checkpoint(near.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(max_bits), "a long, b long"))
    crowded = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    points = crowded.mapInArrow(_midpoints(max_bits // 2), "point long, fp long")
    stars = points.repartition("point").sortWithinPartitions("point", "fp").mapInArrow(_star, "a long, b long")
    return found.filter("b is not null").unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each input row: rid, doc_id, fp, first (doc_id and rid of the smallest row that links reach from it).

    Null texts are empty; texts without words have fingerprint 0 and link like any other. Rows with equal fingerprints
    are one node, so a hot text costs one row. A null id is larger than any other. Further columns are not looked at."""
    docs = settled(docs)
    rows = checkpoint(fingerprints(docs, id_col, text_col, words_in_shingle))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("low")))
    roots = connected_components(links(nodes.select("fp"), max_bits), "a", "b").select(F.col("node").alias("fp"), "root")
    linked = nodes.join(roots, "fp")
    lowest = linked.groupBy("root").agg(F.min("low").alias("first"))
    moved = checkpoint(linked.join(lowest, "root").filter("first.rid <> low.rid").select("fp", "first"))
    own = nodes.select("fp", F.col("low").alias("own"))
    firsts = own.join(joinable(moved), "fp", "left").select("fp", F.coalesce("first", "own").alias("first"))
    return rows.join(firsts, "fp").select("rid", "doc_id", "fp", F.struct("first.doc_id", "first.rid").alias("first"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The input with one row of each group of linked rows: the one with the smallest id. All columns stay."""
    docs = settled(docs)
    dropped = checkpoint(near_duplicates(docs, id_col, text_col, words_in_shingle, max_bits).filter("rid <> first.rid").select(F.col("rid").alias("__rid")))
    return with_row_id(docs, "__rid").join(joinable(dropped), "__rid", "left_anti").drop("__rid")
