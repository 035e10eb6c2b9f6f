"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each document becomes its token ids and an end id. Whole windows of a long document are sequences of their own; what is
left is cut into pieces of at most PIECE ids. Pieces are dealt at random into groups of about GROUP_WINDOWS windows, and
each group is packed by itself: partial partitions, at first one for each piece, merge in order of their imbalance, the
fullest windows of one with the emptiest of the other, until one is left, whose windows are nearly equal. If one exceeds
the capacity, the group gets one window more.

At scale: texts are read once and stay in their task; what is shuffled is a row of numbers for each piece, and a group is
of the same size however large the input is.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, texts, trimmed, with_row_id

CAPACITY = 2048
PIECE = 512
GROUP_WINDOWS = 256
END_ID = 1
#: Different words that a worker remembers the ids of.
REMEMBERED = 400_000

# Latin-1 letters (after lower-casing), digits and white space, as the vocabulary's pattern has them.
_LETTER, _NUMBER, _SPACE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PIECES = re.compile(f"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


class _Ids(dict):
    """Ids of words, as bytes; a word that is not there is encoded once."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids = struct.pack(f"<{len(found := self.encode(word))}I", *found)
        return ids


class WordPieceIds:
    """Ids of texts by a vocabulary of lower-case words with word ends, as little-endian unsigned 32-bit bytes.

    A word's ids do not depend on its neighbours, so ids of words seen before are looked up. Latin-1 texts are cut into
    words here; other texts, and those that may hold special tokens, are cut at white space and cut further by the
    tokenizer itself. Equal to encoding each text in whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        word = Tokenizer(whole.model)
        word.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        merge = word.model.tokenize
        # a word of printable ASCII stands for itself among the byte-level symbols; others are mapped first
        self.known = _Ids(lambda w: [t.id for t in merge(w)] if w.isascii() and w.isprintable() else word.encode(w, add_special_tokens=False).ids)
        self.known_whole = _Ids(lambda w: whole.encode(w.decode(), add_special_tokens=False).ids)

    def __call__(self, text: bytes) -> bytes:
        s = text.decode("utf-8", "replace")
        if (s.isascii() or max(s) <= "\xff") and "<|" not in s:
            return b"".join(map(self.known.__getitem__, _PIECES.findall(s.lower())))
        return b"".join(map(self.known_whole.__getitem__, s.encode().split()))  # of bytes: the six ASCII white-space characters


_loaded: dict[str, WordPieceIds] = {}


def encoder(path: str) -> WordPieceIds:
    """One for each vocabulary and worker process."""
    if path not in _loaded:
        _loaded[path] = WordPieceIds(path)
    return _loaded[path]


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of whole windows, then of pieces; the last one is what is left, so lengths differ and fill gaps."""
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    return out + [(s, min(piece, n - s)) for s in range(len(out) * capacity, n, piece)]


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of the pieces in each of so many windows of nearly equal sums."""
    # a partial partition: (-imbalance, tie, loads in falling order without empty windows, members of each)
    heap = [(-n, i, [n], [(i,)]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        if len(a) + len(b) <= windows and a[-1] >= b[0]:
            load, member = a + b, in_a + in_b
        else:
            # the fullest of one meet the emptiest of the other, counting windows that are empty so far
            over = max(0, len(a) + len(b) - windows)
            cut_a, cut_b = len(a) - over, len(b) - over
            rows = [*zip(a[:cut_a], in_a[:cut_a], strict=True), *zip(b[:cut_b], in_b[:cut_b], strict=True)]
            rows += [(x + y, (p, q)) for x, p, y, q in zip(a[cut_a:], in_a[cut_a:], reversed(b[cut_b:]), reversed(in_b[cut_b:]), strict=True)]
            rows.sort(key=lambda r: -r[0])
            load, member = [r[0] for r in rows], [r[1] for r in rows]
        low = load[-1] if len(load) == windows else 0
        heapq.heappush(heap, (low - load[0], tie, load, member))
        tie += 1
    return [_leaves(m) for m in heap[0][3]] if heap else []


def _leaves(tree) -> list[int]:
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if len(x) == 1:
            out.append(x[0])
        else:
            stack += [x[1], x[0]]
    return out


def windows_for(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The pieces of each window; none holds more than the capacity, which no piece exceeds."""
    k = max(1, math.ceil(sum(lengths) / capacity))
    while True:
        found = difference(lengths, k)
        if all(sum(lengths[i] for i in w) <= capacity for w in found):
            return found
        k += 1


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece: int = PIECE, with_ids: bool = True) -> DataFrame:
    """rid, doc_id, start, length, ids_crc32, doc_tokens of each piece; also ids, if asked for."""

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, t in enumerate(texts(b.column(2))):
                raw = encode(t) + end
                n = len(raw) // 4
                for s, k in cuts(n, capacity, piece):
                    part = raw[4 * s : 4 * (s + k)]
                    row.append(i)
                    start.append(s)
                    length.append(k)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            at = pa.array(row, pa.int64())
            columns = [b.column(0).take(at), b.column(1).take(at), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["rid", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select("rid", "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"rid long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece: int = PIECE, group_windows: int = GROUP_WINDOWS, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset.

    Each id of each document row is in one piece. Null is the empty text, which still has its end id; repeated rows are
    packed as often as they occur; an empty table gives no rows. tokenizer: path of the vocabulary, on all machines."""
    cut = checkpoint(pieces(docs, tokenizer, id_col, text_col, capacity, piece, with_ids))
    rest = cut.filter(F.col("length") < capacity)
    total = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / (capacity * group_windows)))
    kind = cut.schema["doc_id"].dataType.simpleString()

    def place(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("rid", "ascending"), ("start", "ascending")])
        length = table.column("length").to_pylist()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for w, members in enumerate(windows_for(length, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = key[0].as_py() + groups * w, at
                at += length[i]
        return table.drop_columns(["rid", "group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("rid", "start"), F.lit(groups)))
    placed = dealt.groupBy("group").applyInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long")
    # whole windows: negative ids, from the row and the window in it
    whole = cut.filter(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.select(*columns, "sequence_id", "offset").unionByName(whole)
