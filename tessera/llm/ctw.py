"""Language-model scores by context-tree weighting over bytes.

The bytes of a text (words joined by a space, then an end byte) are coded bit by bit: each of the 255 inner nodes of the
code tree of a byte has a context tree of its own, whose nodes are the last 0 .. DEPTH bytes. A node's counts give a
Krichevsky-Trofimov estimate; the weighted probability of a node is half its own estimate and half the product of its
children's. Prediction mixes the estimates of all depths on the context's path with the weights that follow from that.

Every context of the training texts is in the tree, however rare, and none of it is in one place. A gram is a context and
the byte after it, as a number: the byte just before first, then the one before that, the coded byte last. So the grams
below a context follow each other in order. All different grams, of held-out texts too, are one table with their training
counts (a gram without any has a node that predicts one half, as it should):

* up, within slices of equal SLICE first bytes, in tasks; then level by level to the root by grouped sums,
* down, from the root level by level by joins, then within the slices: the code length of each gram.

A slice spans DEPTH - SLICE = 2 more bytes of context and the coded one: 2**24 grams at most, whatever the corpus.

Texts meet their grams so: the most frequent ones, 2**HEAD_BITS at most, are looked up where the text is read; the others
meet theirs in a shuffled join. The same goes for the words of the unigram base score, with WORD_BITS. Which gram is
frequent decides where it is looked up, never its value.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, fold, steps, texts, trimmed, utf8, with_row_id, written

#: Bytes of context, and the most that there may be: a gram of 7 bytes is a positive long with room for a flag.
DEPTH, MAX_DEPTH = 6, 6
#: Levels that are worked on inside of a slice, beside its own.
SPAN = 2
HEAD_BITS = 20
WORD_BITS = 18
FOLDS, HELD_OUT = 5, 1
#: Closes a text and stands before it; no UTF-8 text has it.
END = 0xFF
#: Places of a stream that are worked on at once.
AT_ONCE = 250_000
#: Bits of a packed count, beside the 57 of a gram and its flag.
COUNT_BITS = np.uint64(7)
MOST_COUNT = np.uint64(127)
PACKED_AT_ONCE = 1_000_000
#: Different words that a counting task gathers before it sends them on.
GATHERED = 300_000
#: Grams of whole slices that are worked on at once, about.
BLOCK = 100_000
LOG_2 = float(np.log(2))


# --- Krichevsky-Trofimov estimates -------------------------------------------------------------------------------


def log_gamma(x):
    """Of values from 0.5 on, as an array or as a column; the error is below 1e-9 of the value or of 1."""
    log = F.log if isinstance(x, Column) else np.log
    y = x + 8
    z = 1 / (y * y)
    fix = x
    for k in range(1, 8):
        fix = fix * (x + k)
    return (y - 0.5) * log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - log(fix)


def log_kt(zeros, ones):
    """Log probability of any sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - float(np.log(np.pi))


# --- a slice of the tree -------------------------------------------------------------------------------------------


class Levels:
    """Nodes of some whole slices, from the depth of the grams up to that of the slices.

    A level has sorted keys (context << 8 | bit node), zeros, ones, log weighted probabilities, the weight of a node's own
    estimate and, for the nodes of the level below, their place in it. gram: sorted; n: training counts."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, span: int):
        byte, context = gram & 255, gram >> 8
        keys, zeros, ones, inverse, base = [], [], [], [], 0
        for j in range(8):
            key = context << 8 | (256 | byte) >> (8 - j)
            first = np.r_[True, key[1:] != key[:-1]]
            at, bit = np.flatnonzero(first), byte >> (7 - j) & 1
            keys.append(key[at])
            zeros.append(np.add.reduceat(n * (1 - bit), at))
            ones.append(np.add.reduceat(n * bit, at))
            inverse.append(base + np.cumsum(first) - 1)
            base += len(at)
        order = np.argsort(np.concatenate(keys), kind="stable")
        rank = np.empty(base, np.int64)
        rank[order] = np.arange(base)
        self.byte, self.bits = byte, [rank[x] for x in inverse]
        self.keys = [np.concatenate(keys)[order]]
        self.zeros, self.ones = ([np.concatenate(x)[order].astype(np.float64)] for x in (zeros, ones))
        self.weighted = [log_kt(self.zeros[0], self.ones[0])]
        self.weight, self.parent = [np.ones(base)], []
        for _ in range(span):
            key = self.keys[-1] >> 16 << 8 | self.keys[-1] & 255
            order = np.argsort(key, kind="stable")
            first = np.r_[True, key[order][1:] != key[order][:-1]]
            at = np.flatnonzero(first)
            parent = np.empty(len(key), np.int64)
            parent[order] = np.cumsum(first) - 1
            self.parent.append(parent)
            self.keys.append(key[order][at])
            z, o, split = (np.add.reduceat(x[-1][order], at) for x in (self.zeros, self.ones, self.weighted))
            own = log_kt(z, o)
            self.zeros.append(z)
            self.ones.append(o)
            self.weighted.append(np.logaddexp(own, split) - LOG_2)
            self.weight.append(np.exp(own - LOG_2 - self.weighted[-1]))

    def log10_probabilities(self, known: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Of the last byte of each gram. For each node of the slices' level what the levels above it predict: the
        probability of a one is ``known`` and ``left`` times the prediction from here on."""
        for up in range(len(self.keys) - 1, -1, -1):
            estimate = (self.ones[up] + 0.5) / (self.zeros[up] + self.ones[up] + 1)
            known, left = known + left * self.weight[up] * estimate, left * (1 - self.weight[up])
            if up:
                known, left = known[self.parent[up - 1]], left[self.parent[up - 1]]
        out = np.zeros(len(self.byte))
        for j, node in enumerate(self.bits):
            out += np.log10(np.where(self.byte >> (7 - j) & 1, known[node], 1 - known[node]))
        return out


def _blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[list[np.ndarray]]:
    """Columns of rows that are sorted by the first one, in blocks that hold all rows of each of its values."""
    held: list[list[np.ndarray]] = []
    limit = most

    def joined() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    for b in batches:
        if b.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        if sum(len(x[0]) for x in held) > limit:
            whole = joined()
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            if cut:
                yield [x[:cut] for x in whole]
            held = [[x[cut:] for x in whole]]
            limit = max(most, 2 * len(held[0][0]))
    if held:
        yield joined()


# --- the tree ------------------------------------------------------------------------------------------------------


def slice_depth(depth: int) -> int:
    return max(1, depth - SPAN)


def sliced(grams: DataFrame, depth: int) -> DataFrame:
    """Adds ``context``, the first bytes of a gram that name its slice."""
    return grams.withColumn("context", F.shiftright("gram", 8 * (depth + 1 - slice_depth(depth))))


def slice_nodes(grams: DataFrame, depth: int) -> DataFrame:
    """context, m (bit node), zeros, ones, weighted (log probability) of the nodes at the depth of slices."""
    span = depth - slice_depth(depth)

    @trimmed
    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, gram, train in _blocks(batches):
            levels = Levels(gram, train, span)
            key = levels.keys[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key >> 8, key & 255, levels.zeros[-1], levels.ones[-1], levels.weighted[-1])], names=["context", "m", "zeros", "ones", "weighted"])

    rows = sliced(grams, depth).select("context", "gram", "train").repartition("context").sortWithinPartitions("context", "gram")
    return rows.mapInArrow(up, "context long, m long, zeros double, ones double, weighted double")


def upper_levels(nodes: DataFrame, depth: int) -> DataFrame:
    """context, m, known, left of the nodes at the depth of slices: what all levels above them predict."""
    levels = []
    for _ in range(slice_depth(depth)):
        below = levels[-1] if levels else nodes
        own, split = log_kt(F.col("zeros"), F.col("ones")), F.col("split")
        level = below.groupBy(F.shiftright("context", 8).alias("context"), "m").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("split"))
        level = level.withColumn("own", own).withColumn("weighted", F.greatest("own", split) + F.log1p(F.exp(-F.abs(F.col("own") - split))) - LOG_2)
        levels.append(checkpoint(level.select("context", "m", "zeros", "ones", "weighted", F.exp(F.col("own") - LOG_2 - F.col("weighted")).alias("weight"))))
    estimate = F.col("weight") * (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    above = None
    for level in reversed(levels):
        here = level if above is None else level.withColumn("parent", F.shiftright("context", 8)).join(above, ["parent", "m"])
        known, left = (F.lit(0.0), F.lit(1.0)) if above is None else (F.col("known"), F.col("left"))
        above = here.select(F.col("context").alias("parent"), "m", (known + left * estimate).alias("known"), (left * (1 - F.col("weight"))).alias("left"))
    return nodes.select("context", "m", F.shiftright("context", 8).alias("parent")).join(above, ["parent", "m"]).select("context", "m", "known", "left")


def gram_costs(grams: DataFrame, depth: int) -> DataFrame:
    """gram, n, cost: log10 probability of the last byte of each gram after the bytes before it. grams: gram, n, train
    (its count in training texts, which may be 0)."""
    span = depth - slice_depth(depth)
    nodes = written(slice_nodes(grams, depth))

    @trimmed
    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, gram, m, n, train, known, left in _blocks(batches):
            node = m > 0
            own = ~node
            # the nodes are those of the grams: in order of context and bit node, one for one
            cost = Levels(gram[own], train[own], span).log10_probabilities(known[node], left[node])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram[own], n[own], cost)], names=["gram", "n", "cost"])

    none = F.lit(0).cast("long")
    above = upper_levels(nodes, depth).select("context", none.alias("gram"), "m", none.alias("n"), none.alias("train"), "known", "left")
    own = sliced(grams, depth).select("context", "gram", none.alias("m"), "n", "train", F.lit(0.0).alias("known"), F.lit(0.0).alias("left"))
    both = own.unionByName(above).repartition("context").sortWithinPartitions("context", "gram", "m")
    return both.mapInArrow(down, "gram long, n long, cost double")


# --- reading texts ------------------------------------------------------------------------------------------------


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z, and the six ASCII white-space characters


class Stream:
    """Texts with END bytes between them, and one after the last. ``begin``: where each text begins."""

    def __init__(self, parts: list[bytes], depth: int):
        gap = bytes([END]) * depth
        self.depth = depth
        self.raw = np.frombuffer(gap + gap.join(parts) + bytes([END]), np.uint8)
        end = np.cumsum(np.array([len(p) + depth for p in parts], np.int64))  # of the texts: the END byte that is coded
        self.begin = np.r_[depth, end[:-1] + depth]
        self.pads = (end[:-1, None] + np.arange(1, depth)).ravel()  # END bytes that only stand before a text

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first place, gram of each place, places among those that are pads), AT_ONCE of them at a time."""
        for low in range(self.depth, len(self.raw), AT_ONCE):
            high = min(low + AT_ONCE, len(self.raw))
            window = self.raw[low - self.depth : high].astype(np.int64)
            gram = np.zeros(high - low, np.int64)
            for first in (*range(self.depth - 1, -1, -1), self.depth):
                np.left_shift(gram, 8, out=gram)
                np.bitwise_or(gram, window[first : first + high - low], out=gram)
            i, j = np.searchsorted(self.pads, (low, high))
            yield low, gram, self.pads[i:j] - low


def _packed(x: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Sums of packed counts (code << COUNT_BITS | n) that are sorted. Packed again, what does not fit into COUNT_BITS apart as
    codes and counts."""
    kept, codes, counts, i = [x[:0]], [], [], 0
    while i < len(x):  # in blocks of whole codes
        j = len(x) if len(x) - i <= PACKED_AT_ONCE else int(np.searchsorted(x, x[i + PACKED_AT_ONCE] | MOST_COUNT, side="right"))
        own = x[i:j]
        at = np.r_[0, np.flatnonzero((own[1:] ^ own[:-1]) > MOST_COUNT) + 1]
        n, code = np.add.reduceat(own & MOST_COUNT, at), own[at] & ~MOST_COUNT
        more = n > MOST_COUNT
        codes.append((code[more] >> COUNT_BITS).astype(np.int64))
        counts.append((n[more] & ~MOST_COUNT).astype(np.int64))
        n &= MOST_COUNT
        kept.append((code | n)[n > 0])
        i = j
    return np.concatenate(kept), tuple(np.concatenate([*c, np.zeros(0, np.int64)]) for c in (codes, counts))


def _split(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows gram, n, train of codes (gram << 1 | whether it is of a training text); codes of one gram that follow each other are one row."""
    gram, train = code >> 1, n * (code & 1)
    at = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    columns = gram[at], np.add.reduceat(n, at), np.add.reduceat(train, at)
    for i in range(0, len(at), AT_ONCE):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + AT_ONCE]) for x in columns], names=["gram", "n", "train"])


def gram_counts(plain: DataFrame, depth: int, most: int = 4_000_000) -> DataFrame:
    """gram, n, train of each different gram of all texts. plain: text, learn (whether it is a training text).

    A task holds up to ``most`` different codes as sorted packed counts and merges new ones into them; so what it sends
    on has a gram once for each flag or little more, and is shuffled without a further aggregate before."""

    @trimmed
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        new = 0

        def added() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(held)
            held.clear()
            x.sort(kind="stable")  # merges the sorted runs
            x, apart = _packed(x)
            held.append(x)
            if len(apart[0]):
                yield from _split(*apart)

        def rows() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(held[0]), 4 * AT_ONCE):
                x = held[0][i : i + 4 * AT_ONCE]
                yield from _split((x >> COUNT_BITS).astype(np.int64), (x & MOST_COUNT).astype(np.int64))

        for b in batches:
            parts = [b" ".join(words_of(t)) for t in texts(b.column(0))]
            learn = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for flag in (0, 1):
                own = [p for p, x in zip(parts, learn, strict=True) if x == flag]
                for i, j in steps(np.cumsum([0, *map(len, own)])):
                    for _, gram, pads in Stream(own[i:j], depth).grams():
                        code = np.delete(gram, pads).view(np.uint64)
                        code.sort()
                        x, apart = _packed((code << np.uint64(1) | np.uint64(flag)) << COUNT_BITS | np.uint64(1))
                        if len(apart[0]):
                            yield from _split(*apart)
                        held.append(x)
                        new += len(x)
                        if new > most // 2:
                            yield from added()
                            new = 0
                            if len(held[0]) > most:
                                yield from rows()
                                held.clear()
        if held:
            yield from added()
            yield from rows()

    coded = plain.select(F.col("text"), F.col("learn")).mapInArrow(out, "gram long, n long, train long")
    return coded.repartition("gram").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("train").alias("train"))


class Lookup:
    """Values of keys from 0 on, by buckets of hashes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(1, len(keys).bit_length())
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        self.keys, self.values = np.r_[keys[order], -1], np.r_[values[order], 0.0]
        self.start = np.searchsorted(bucket[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 for other keys, and the places of those others in order."""
        bucket = self._bucket(keys)
        at, end = self.start[bucket], self.start[bucket + 1]
        out = self.values[at]
        left = np.flatnonzero(self.keys[at] != keys)  # the first one of a bucket decides for most
        out[left] = 0.0
        at, end, absent = at[left] + 1, end[left], []
        while len(left):
            some = at < end
            absent.append(left[~some])
            left, at, end = left[some], at[some], end[some]
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left, at, end = left[~hit], at[~hit] + 1, end[~hit]
        return out, np.sort(np.concatenate([*absent, np.zeros(0, np.int64)]))


# --- unigram base ---------------------------------------------------------------------------------------------------


#: The end token; no word is empty.
END_WORD = b""


def word_keys(words) -> np.ndarray:
    """128-bit hashes of words, as rows of two longs. Of ten thousand million different words two share one with a
    probability under 1e-18."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.int64).reshape(-1, 2)


def word_counts(train: DataFrame, text_col: str) -> DataFrame:
    """k, k2 (key), c of each different training token, the end token included."""

    @trimmed
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            keys = word_keys(count)
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.fromiter(count.values(), np.int64, len(count)))], names=["k", "k2", "c"])

        count: Counter = Counter()
        for b in batches:
            for t in texts(b.column(0)):
                count.update(words_of(t))
                count[END_WORD] += 1
                if len(count) > GATHERED:
                    yield rows()
                    count = Counter()
        if count:
            yield rows()

    partial = train.select(F.col(text_col).cast("string").alias("text")).mapInArrow(out, "k long, k2 long, c long")
    return partial.groupBy("k", "k2").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, n: str, most: int) -> Column:
    """Whether a row is among the most frequent ones, ``most`` at most; equal counts are on one side. By a histogram with eight
    steps for each doubling."""
    step = F.floor(F.log2(F.col(n)) * 8)
    first, total = None, 0
    for at, number in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += number
        if total > most:
            break
        first = at
    return F.lit(False) if first is None else step >= first


# --- scores -----------------------------------------------------------------------------------------------------------


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, head_bits: int = HEAD_BITS, word_bits: int = WORD_BITS) -> DataFrame:
    """One row for each input row: rid, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from rows outside the held-out fold. Null is the empty text, which has its end alone; a null id is in the fold
    of the empty string. Without training rows all bytes are equally likely. Further columns are not looked at."""
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be between 1 and {MAX_DEPTH}")
    sc = docs.sparkSession.sparkContext
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = written(word_counts(plain.filter(~held_out), "text"))
    tokens, different = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    bottom = tokens + 0.5 * (different + 1)
    head_words = counts.filter(head_of(counts, "c", 1 << word_bits)).toArrow()
    own_keys = [head_words.column(c).to_numpy() for c in ("k", "k2")]
    words = sc.broadcast((Lookup(own_keys[0], np.arange(1.0, len(own_keys[0]) + 1)), np.r_[0, own_keys[1]], np.r_[0.0, np.log10((head_words.column("c").to_numpy() + 0.5) / bottom)]))
    costs = written(gram_costs(written(gram_counts(plain.select("text", (~held_out).alias("learn")), depth)), depth))
    is_head = head_of(costs, "n", 1 << head_bits)
    head = costs.filter(is_head).select("gram", "cost").toArrow()
    grams = sc.broadcast(Lookup(head.column("gram").to_numpy(), head.column("cost").to_numpy()))

    @trimmed
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (places, second, logs), lookup = words.value, grams.value
        unknown = float(np.log10(0.5 / bottom))
        for b in (whole.slice(i, j - i) for whole in batches for i, j in steps(utf8(whole.column(2))[1])):
            parts, keys, ns, sizes = [], [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], []
            for t in texts(b.column(2)):
                own = words_of(t)
                count = Counter(own)
                count[END_WORD] += 1
                keys.append(word_keys(count))
                ns.append(np.fromiter(count.values(), np.int64, len(count)))
                sizes.append(len(count))
                parts.append(b" ".join(own))
            key, n, row = np.concatenate(keys), np.concatenate(ns), np.repeat(np.arange(len(parts)), np.array(sizes, np.int64))
            at = places.get(np.ascontiguousarray(key[:, 0]))[0].astype(np.int64)  # 0: not there
            known = (at > 0) & (second[at] == key[:, 1])
            n_tokens, n_known = (np.bincount(row, x, len(parts)).astype(np.int64) for x in (n, n * known))
            base = np.bincount(row, n * np.where(known, logs[at], unknown), len(parts))
            word_ends = pa.array(np.searchsorted(row[~known], np.arange(len(parts) + 1)).astype(np.int32))
            word_lists = [pa.ListArray.from_arrays(word_ends, pa.array(x[~known])) for x in (key[:, 0], key[:, 1], n)]
            sums = np.zeros(len(parts))
            tail_text, tail_gram, tail_n = [], [], []
            for i, j in steps(np.cumsum([0, *map(len, parts)])):
                stream = Stream(parts[i:j], depth)
                for low, gram, pads in stream.grams():
                    value, absent = lookup.get(gram)
                    value[pads] = 0.0
                    some, end = np.searchsorted(stream.begin, (low, low + len(gram) - 1), side="right")
                    some, end = max(some - 1, 0), max(end, 1)
                    sums[i + some : i + end] += np.add.reduceat(value, np.maximum(stream.begin[some:end] - low, 0))
                    absent = np.setdiff1d(absent, pads, assume_unique=True)
                    t, g = np.searchsorted(stream.begin, low + absent, side="right") - 1, gram[absent]
                    order = np.lexsort((g, t))
                    t, g = t[order], g[order]
                    first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (t[1:] != t[:-1])]) if len(g) else np.zeros(0, np.int64)
                    tail_text.append(i + t[first])
                    tail_gram.append(g[first])
                    tail_n.append(np.diff(np.r_[first, len(g)]))
            each = np.concatenate([*tail_text, np.zeros(0, np.int64)])  # in order of texts
            ends = pa.array(np.searchsorted(each, np.arange(len(parts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*x, np.zeros(0, np.int64)]))) for x in (tail_gram, tail_n)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (n_tokens, n_known, [len(p) + 1 for p in parts])), pa.array(base, pa.float64()), pa.array(sums), *word_lists, *lists,
                ],
                names=["rid", "doc_id", "n_tokens", "n_known", "n_bytes", "base", "score", "words", "words2", "word_ns", "grams", "gram_ns"],
            )

    rows = with_row_id(plain).select("rid", "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = written(rows.mapInArrow(out, f"rid long, doc_id {kind}, n_tokens long, n_known long, n_bytes long, base double, score double, words array<long>, words2 array<long>, word_ns array<long>, grams array<long>, gram_ns array<long>"))

    def tail(**columns: str) -> DataFrame:
        x = F.explode(F.arrays_zip(*(F.col(c).alias(name) for name, c in columns.items()))).alias("x")
        return scored.select("rid", x).select("rid", "x.*")

    met_words = tail(k="words", k2="words2", n="word_ns").join(counts, ["k", "k2"])
    met_words = met_words.groupBy("rid").agg(F.sum("n").alias("known"), F.sum(F.col("n") * (F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5)))).alias("base"), F.lit(0.0).alias("score"))
    met_grams = tail(gram="grams", n="gram_ns").join(costs.filter(~is_head).select("gram", "cost"), "gram")
    met_grams = met_grams.groupBy("rid").agg(F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.sum(F.col("n") * F.col("cost")).alias("score"))
    more = met_words.unionByName(met_grams).groupBy("rid").agg(*(F.sum(c).alias(f"more_{c}") for c in ("known", "base", "score")))
    value = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return scored.select("rid", "doc_id", "n_tokens", "n_known", "n_bytes", "base", "score").join(more, "rid", "left").select(
        "rid",
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        value.alias("score"),
        (-value * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
