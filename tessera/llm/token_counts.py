"""Greedy longest-match token counts by a linear automaton.

The vocabulary is a trie. A node that is no token, or whose next symbol has no edge, pops the tokens of the longest
match so far and goes on at its failure link, which stands for the symbols after those tokens. How many tokens a pop
has is computed once for each node, so a word is counted in one pass over its bytes, without going back and without
building any piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import texts, with_row_id

#: Symbol after the last byte of a word.
WORD_END = 256
#: Different words that a worker remembers the counts of.
REMEMBERED = 400_000


class LongestMatch:
    """Counts of greedy longest-match pieces of words. pieces: sequences of symbols (bytes, WORD_END)."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        edge: dict[int, int] = {}
        parent, token = [0], [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                key = node * 257 + symbol
                if key not in edge:
                    edge[key] = len(parent)
                    parent.append(key)
                    token.append(False)
                node = edge[key]
            token[node] = bool(piece)
        depth = [0] * len(parent)
        for node in range(1, len(parent)):  # a parent's number is smaller
            depth[node] = depth[parent[node] // 257] + 1
        none = -1
        failure, popped = [none] * len(parent), [0] * len(parent)
        for node in sorted(range(1, len(parent)), key=depth.__getitem__):
            above, symbol = divmod(parent[node], 257)
            if token[node]:
                failure[node], popped[node] = 0, int(parent[node] != WORD_END)  # the word end by itself is no piece of text
                continue
            at, n = failure[above], popped[above]
            while at != none and at * 257 + symbol not in edge:
                n += popped[at]
                at = failure[at]
            if at != none:
                failure[node], popped[node] = edge[at * 257 + symbol], n
        self.edge, self.failure, self.popped = edge, failure, popped

    def count(self, word: bytes) -> int:
        """Pieces of the word; -1 if it can't be covered. Each failure step pops a token at least, so steps are linear."""
        edge, failure, popped = self.edge, self.failure, self.popped
        node = n = 0
        for symbol in (*word, WORD_END):
            while (to := edge.get(node * 257 + symbol)) is None:
                n += popped[node]
                node = failure[node]
                if node < 0:
                    return -1
            node = to
        while node > 0:
            n += popped[node]
            node = failure[node]
        return n if node == 0 else -1


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins for bytes that byte-level vocabularies use: printable ones stand for themselves, the others
    follow from 256 on in order."""
    out = {chr(b): b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = [b for b in range(256) if chr(b) not in out]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> Iterator[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary file with "</w>" at word ends; special tokens are left out. The word end is a
    piece by itself, which counts nothing: a word may also end with a piece that has no end mark."""
    yield (WORD_END,)
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    special, byte = {t["content"] for t in content["added_tokens"]}, byte_of_symbol()
    for piece in content["model"]["vocab"]:
        if piece not in special:
            end = piece.endswith("</w>")
            yield (*(byte[c] for c in (piece[:-4] if end else piece)), *[WORD_END] * end)


_loaded: dict[str, tuple[LongestMatch, dict[bytes, int]]] = {}


def automaton(path: str) -> tuple[LongestMatch, dict[bytes, int]]:
    """The automaton of a vocabulary and the counts of words seen; one of each for a worker process."""
    if path not in _loaded:
        _loaded[path] = LongestMatch(vocabulary(path)), {}
    return _loaded[path]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: rid, doc_id, n_words, n_tokens, n_unknown.

    Words are runs of other than ASCII white space, lower-cased A-Z. A word that the vocabulary can't cover counts as one
    token and one unknown word. Null is the empty text without words. tokenizer: path of the vocabulary, on all machines;
    further columns are not looked at."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, known = automaton(tokenizer)
        for b in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for t in texts(b.column(2)):
                words = t.lower().split()
                if len(known) > REMEMBERED:
                    known.clear()
                for w in set(words):
                    if w not in known:
                        known[w] = matcher.count(w)
                counts = list(map(known.__getitem__, words))
                unknown = counts.count(-1)
                n_words.append(len(words))
                n_tokens.append(sum(counts) + 2 * unknown)
                n_unknown.append(unknown)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], names=["rid", "doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select("rid", "doc_id", "text")
    return rows.mapInArrow(out, f"rid long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
