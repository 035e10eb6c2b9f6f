"""Byte-level BPE with reuse of content-defined chunks.

A text is cut where a rolling hash of its last bytes says so; the cuts move with the content, so documents with a passage
in common have most of its chunks in common, wherever the passage stands. A chunk is encoded once and remembered. The ids
next to a cut are not those of the whole text, so each join is repaired: the text between a safe place in the chunk before
and one in the chunk behind it is encoded again, with one unit more on both sides, and taken when those units get the very ids
that the chunks have there; else the whole text is encoded at once. Chunks without a safe place fall into the window.

A safe place is a space behind a visible ASCII character. No piece of the vocabulary's pattern goes over it and none looks
beyond it, so the ids before it do not depend on what follows, and those behind it not on what was before. Between two
safe places, ids of a chunk are those of the whole text.

At scale: a map over whole texts; chunks are remembered by each worker process, up to a number of bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import steps, texts, utf8, with_row_id
from tessera.llm.token_counts import byte_of_symbol

#: Bytes that the rolling hash sees; a power of two.
REACH = 16
#: A cut at one place in so many, on average; a power of two.
EVERY = 1024
LEAST, MOST = 256, 8192
_CUTS_BELOW = np.uint32((1 << 32) // EVERY)
#: Bytes of chunks that a worker remembers; different pieces, and the length up to which it does.
CHUNK_BYTES = 32_000_000
REMEMBERED, LONGEST = 300_000, 512

_GEAR = np.random.default_rng(20240611).integers(0, 1 << 32, 256, dtype=np.uint32)
_SAFE = re.compile(rb"(?<=[!-~]) ")

# Latin-1 characters of the classes that the pattern of byte-level vocabularies names
_LETTER, _NUMBER, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def rolling(raw: np.ndarray) -> np.ndarray:
    """At each byte a hash of it and the REACH - 1 bytes before it, by doubling."""
    h, n = _GEAR[raw], 1
    while n < REACH:
        longer = h.copy()
        longer[n:] += h[:-n] << np.uint32(n)
        h, n = longer, 2 * n
    return h


def cuts(raw: np.ndarray, hit: np.ndarray) -> list[int]:
    """Ends of the chunks of a text. hit: where the rolling hash would cut, in order."""
    out, at = [], 0
    while len(raw) - at > LEAST:
        k = int(np.searchsorted(hit, at + LEAST))
        cut = min(int(hit[k]) if k < len(hit) else len(raw), at + MOST, len(raw))
        while cut < len(raw) and raw[cut] & 0xC0 == 0x80:  # not within a character
            cut += 1
        out.append(cut)
        at = cut
    return [*out, len(raw)] if at < len(raw) else out


class _Known(dict):
    """Ids by key; what is not there is made, and kept if it is short."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        found = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = found
        return found


class Codec:
    """Encoder and decoder of one vocabulary file; ids are little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        special = content["added_tokens"]
        if content["model"]["type"] != "BPE" or content["normalizer"] or any(t[k] for t in special for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only byte-level BPE without normalisation and with plain added tokens")
        whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        # the model merges the printable stand-ins of a piece's bytes
        byte = byte_of_symbol()
        symbols, merge = {b: c for c, b in byte.items()}, whole.model.tokenize
        self.pieces = _Known(lambda p: _packed([t.id for t in merge(p.encode().decode("latin-1").translate(symbols))]))
        self.units = _Known(lambda u: _packed(whole.encode(u.decode(), add_special_tokens=False).ids))
        self.special = {t["content"].encode(): _packed([t["id"]]) for t in special}
        self.split = re.compile(b"(" + b"|".join(map(re.escape, self.special)) + b")") if special else None
        self.chunks: dict[bytes, tuple] = {}
        self.held = self.encoded = self.reused = 0
        # the bytes of all ids, one after the other, and where each begins
        vocabulary = content["model"]["vocab"] | {t["content"]: t["id"] for t in special}
        strings = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            strings[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def plain(self, text: bytes) -> bytes:
        """Ids of a text without added tokens, by its pieces; other than Latin-1 texts are cut at safe places."""
        s = text.decode()
        if s.isascii() or max(s) <= "\xff":
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(s)))
        at = [0, *(m.start() for m in _SAFE.finditer(text)), len(text)]
        return b"".join(self.units[text[a:b]] for a, b in zip(at[:-1], at[1:], strict=True))

    def chunk(self, chunk: bytes) -> tuple[bytes, list[int], list[int]]:
        """Ids of a chunk, its safe places, and the number of ids before each of them."""
        found = self.chunks.get(chunk)
        if found is not None:
            self.reused += 1
            return found
        self.encoded += 1
        ids, safe = self.plain(chunk), [m.start() for m in _SAFE.finditer(chunk)]
        ends = np.cumsum(self.size[np.frombuffer(ids, "<u4")])
        found = ids, safe, np.searchsorted(ends, safe, side="right").tolist()
        self.held += len(chunk) + len(ids) + 80 * len(safe) + 300
        if self.held > CHUNK_BYTES:
            self.chunks.clear()
            self.held = 0
        self.chunks[chunk] = found
        return found

    def joined(self, text: bytes, ends: list[int]) -> bytes:
        """Ids of a text that is cut into chunks which end there."""
        chunks = [self.chunk(text[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        # the start of the text, all safe places, and its end: place, chunk, number of the chunk's ids before it
        places = [(0, 0, 0)]
        for k, (start, (_, safe, before)) in enumerate(zip([0, *ends[:-1]], chunks, strict=True)):
            places += [(start + p, k, n) for p, n in zip(safe, before, strict=True)]
        places.append((len(text), len(chunks) - 1, len(chunks[-1][0]) // 4))

        def own(i: int, j: int) -> bytes:
            """Ids between two places of one chunk."""
            return chunks[places[i][1]][0][4 * places[i][2] : 4 * places[j][2]]

        out, since = [], 0
        for i in range(len(places) - 1):
            if places[i][1] == places[i + 1][1]:
                continue
            # the join: one unit more on each side, where its chunk has one
            low = i - (i > 0 and places[i - 1][1] == places[i][1])
            high = i + 1 + (i + 2 < len(places) and places[i + 2][1] == places[i + 1][1])
            window, left, right = self.plain(text[places[low][0] : places[high][0]]), own(low, i), own(i + 1, high)
            if not (window.startswith(left) and window.endswith(right) and len(window) >= len(left) + len(right)):
                return self.plain(text)  # no agreement: the window is the whole text
            out += [own(since, i), window[len(left) : len(window) - len(right)]]
            since = i + 1
        return b"".join([*out, own(since, len(places) - 1)])

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text. Added tokens are found first, as the library does; what is between them is cut into chunks."""
        try:
            text.decode()
        except UnicodeDecodeError:
            text = text.decode("utf-8", "replace").encode()
        parts = self.split.split(text) if self.split else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.special[part])
            elif part:
                raw = np.frombuffer(part, np.uint8)
                hit = np.flatnonzero(rolling(raw) < _CUTS_BELOW) + 1 if len(part) > LEAST else ()
                out.append(self.joined(part, cuts(raw, hit)))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; what is no UTF-8 becomes U+FFFD, and ids outside the vocabulary are left out."""
        ids = ids[(ids >= 0) & (ids < len(self.size))]
        size = self.size[ids]
        first = self.at[ids] - (np.cumsum(size) - size)
        return self.bytes[np.repeat(first, size) + np.arange(size.sum())].tobytes().decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


_loaded: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each vocabulary and worker process."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select("rid", "doc_id", "text")
    return rows, rows.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: rid, doc_id, ids (array<int>), equal to the ids of encoding the whole text at once.

    Null and empty texts have no ids; repeated rows repeat; bytes that are no UTF-8 count as U+FFFD. tokenizer: path of the
    vocabulary, on all machines; further columns are not looked at."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for b in batches:
            for i, n in _parts(b.column(2)):
                ids = [np.frombuffer(own.encode(t), "<u4").astype(np.int32) for t in texts(b.column(2).slice(i, n))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), b.column(1).slice(i, n), pa.array(ids, pa.list_(pa.int32()))], names=["rid", "doc_id", "ids"])

    rows, kind = _rows(docs, id_col, text_col)
    return rows.mapInArrow(out, f"rid long, doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The input with one more column, the text of the ids. Null ids have null text; null elements and ids outside the
    vocabulary are left out. A column of the same name as the new one is replaced."""
    rest = [c for c in rows.columns if c != text_col]
    rows = rows.select(*rest)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for b in batches:
            found = [None if x is None else own.decode(np.array([i for i in x if i is not None], np.int64)) for x in b.column(rest.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*rest, text_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(out, f"{fields}, `{text_col}` string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: rid, doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``encode`` and ``decode`` on the
    whole text, without moving ids between processes. Null is the empty text."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for b in batches:
            number, of_ids, of_text = [], [], []
            for t in texts(b.column(2)):
                ids = own.encode(t)
                number.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(own.decode(np.frombuffer(ids, "<u4").astype(np.int64)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(number, pa.int64()), *(pa.array(x, pa.string()) for x in (of_ids, of_text))], names=["rid", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows, kind = _rows(docs, id_col, text_col)
    return rows.mapInArrow(out, f"rid long, doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of parts of a column of about as many bytes each."""
    return ((i, j - i) for i, j in steps(utf8(column)[1]))
