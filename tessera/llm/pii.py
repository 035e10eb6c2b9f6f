"""Personal data by patterns and a linear-chain conditional random field over word shapes.

Patterns find the strict forms of e-mail addresses, IP addresses, card and phone numbers. The field then labels words in
their context and adds spans that the patterns miss (phone numbers without a country code, spelled-out addresses, card
numbers with a wrong check digit). It is trained from the small table of ``labelled_words`` by maximum likelihood and
decoded by Viterbi in numpy batches.

Decoding is exact over whole texts, yet looks only at the few words that can be other than "outside": where the outside
label leads by more than any transitions can make up, it is outside in the best path whatever its neighbours are, and
the chain falls apart there. For words without a digit, "@", "+" or bracket near them this holds once for all (it is
checked when the model is fitted), so texts without such characters need no decoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import texts, with_row_id

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)

# --- patterns ---------------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can begin only where a run of digits does, so a long run is read once
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, by going back from each "@": linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and then start."""
    out = [(0, s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


# --- the labelled table ------------------------------------------------------------------------------------------------


def labelled_words(sentences: int = 600, seed: int = 11) -> list[list[tuple[str, str]]]:
    """Sentences of (word, label): frames and fillers combined at random with a fixed seed. Small, and made by a rule."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    plain = lambda: pick(letters(rng.integers(1, 12)), letters(rng.integers(2, 9)).title(), letters(rng.integers(2, 9)) + pick(".", ",", ";", "!!", "***", "$$$", "###", "&&&", "%%%"), letters(rng.integers(2, 6)).upper())
    tail = lambda: pick("", "", "", "", ".", ",", "!!", "***", "$$$", "###", "&&&", "%%%")

    def phone() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"+{digits(1)}", f"({a})", f"{b}-{c}"], [f"0{digits(3)}", f"{digits(7)}"], [f"+{digits(2)}", a, b, c], [f"0{digits(2)}/{digits(7)}"], [f"({a})", b, c],
            [f"0{digits(4)}", digits(6)], [f"0{digits(3)}", digits(3), digits(4)], [f"0{digits(2)}", digits(4), digits(4)], [f"+{digits(2)}", digits(2), digits(4), digits(4)], [f"(0{digits(3)})", digits(6)], [f"+{digits(2)}", digits(3), digits(7)])

    def email() -> list[str]:
        n, h, t = letters(rng.integers(1, 9)), letters(rng.integers(2, 9)), pick("com", "org", "net", "de", "example")
        return pick([f"{n}.{digits(2)}@{h}.{t}"], [f"{n}@{h}.{t}"], [n, "@", f"{h}.{t}"], [f"{n}[at]{h}.{t}"], [n, "[at]", h, "[dot]", t], [n, "(at)", h, "(dot)", t], [f"{n}(at){h}.{t}"])

    def card() -> list[str]:
        return pick([digits(16)], [digits(16)], ["-".join(digits(4) for _ in range(4))], [digits(4) for _ in range(4)], [digits(15)])

    def ip() -> list[str]:
        return pick([".".join(str(x) for x in rng.integers(0, 256, 4))], [":".join(f"{x:x}" for x in rng.integers(4096, 65536, 8))], [f"fe80::{rng.integers(16, 65536):x}:{rng.integers(16, 65536):x}"])

    def other() -> list[str]:
        return pick(
            [digits(rng.integers(1, 6))], [f"{digits(1)}.{digits(1)}"], [f"{rng.integers(1900, 2099)}"], [f"{rng.integers(1990, 2030)}-0{rng.integers(1, 9)}-{rng.integers(10, 28)}"], [f"{rng.integers(0, 24)}:{rng.integers(10, 59)}"],
            ["token", "=", '"' + "".join(f"{x:x}" for x in rng.integers(0, 16, 40)) + '"'], [f"{digits(2)}%"], [f"v{digits(1)}.{digits(2)}.{digits(1)}"], [f"${digits(3)}.{digits(2)}"], [f"({letters(4)})"], [f"({digits(1)})"], [f"[{digits(2)}]"],
            ["+", digits(2)], [f"{letters(3)}+{letters(3)}"], [f"@{letters(6)}"], [f"{digits(3)},{digits(3)}"], ["ISBN", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"], ["order", digits(8)], [f"{digits(1)}.{digits(1)}.{digits(1)}"], [letters(4) + digits(2)], [digits(22)], [f"1{digits(12)}"], [digits(14)], [f"1Z{digits(3)}{letters(2).upper()}{digits(11)}"], ["x", "=", f"{digits(1)}.{digits(5)}"], [f"{digits(2)}-{digits(2)},", f"{digits(2)}-{digits(2)},"], [f"{digits(4)}-{digits(4)}"], [digits(5)], [f"[{digits(1)}]"], [f"{digits(2)}/{digits(2)}"], ["version", digits(1) + "."], ["C++"], [f"{digits(2)}-{digits(2)}"],
        )

    makers = {"phone": phone, "email": email, "card": card, "ip": ip, "outside": other}
    out = []
    for _ in range(sentences):
        row: list[tuple[str, str]] = [(plain(), "outside") for _ in range(rng.integers(0, 5))]
        for _ in range(rng.integers(1, 3)):
            label = pick(*makers, "outside", "outside")
            words = makers[label]()
            words[-1] += tail()
            row += [(w, label) for w in words] + [(plain(), "outside") for _ in range(rng.integers(1, 5))]
        out.append(row)
    return out


# --- features ------------------------------------------------------------------------------------------------------------

#: A word with one of these, or near one, may be other than outside.
_SIGNAL = re.compile(r"[0-9@+()\[\]]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_REMEMBERED = 50_000


def shape(word: str, most: int = 24) -> tuple[str, str]:
    """The word with classes of characters for letters and digits, runs up to six long; and with runs of one."""
    long, short, run = [], [], 0
    for c in word[: 4 * most]:
        k = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        run = run + 1 if short and short[-1] == k else 1
        if run == 1:
            short.append(k)
        if run <= 6:
            long.append(k)
    return "".join(long)[:most], "".join(short)[:most]


PLAIN = ["plain"]


def word_features(word: str) -> list[str]:
    """Words without a signal share one feature, so that stretches of them have one score."""
    if not _SIGNAL.search(word):
        return PLAIN
    body = word.rstrip(".,;:!?*$#&%")
    long, short = shape(body)
    n = sum("0" <= c <= "9" for c in body)
    size = str(n) if n < 5 else "5-6" if n < 7 else "7-9" if n < 10 else "10-12" if n < 13 else "13-14" if n < 15 else "15-16" if n < 17 else "17-19" if n < 20 else "20+"
    kinds = "".join(sorted({k if k in "9Aa" else c for k, c in zip(short, short, strict=True)}))
    out = [f"long={long}", f"short={short}", f"digits={size}", f"kinds={kinds}", f"digits+kinds={size}{kinds}", f"tail={word[len(body) : len(body) + 1]}"]
    if "@" in body:
        out.append("has@")
    if n and n == len(body):
        out.append(f"all-digits={size}")
    return out


EDGE = ["edge"]
PLACES = (-2, -1, 0, 1, 2)


@dataclass
class Model:
    """weights: of (place, feature) for each label; moves: of a label after a label; from and to outside at the edges."""

    weights: dict[tuple[int, str], np.ndarray]
    moves: np.ndarray

    def __post_init__(self):
        self.cache: dict[str | None, tuple[np.ndarray, ...]] = {}

    def parts(self, word: str | None) -> tuple[np.ndarray, ...]:
        """What a word adds to the scores of words at each place around it; None: beyond the text."""
        if (got := self.cache.get(word)) is None:
            if len(self.cache) > _REMEMBERED:
                self.cache.clear()
            features, zero = EDGE if word is None else word_features(word), np.zeros(len(LABELS))
            got = tuple(sum((self.weights.get((p, f), zero) for f in features), zero) for p in PLACES)
            if word is None or len(word) < 64:
                self.cache[word] = got
        return got

    def scores(self, words: list[str | None]) -> np.ndarray:
        """Of the words in the middle; two more stand on either side."""
        parts = [self.parts(w) for w in words]
        return np.stack([sum(parts[i + p][k] for k, p in enumerate(PLACES)) for i in range(2, len(words) - 2)]) if len(words) > 4 else np.zeros((0, len(LABELS)))

    def lead(self) -> float:
        """By how much a label has to lead to be in the best path whatever its neighbours are."""
        return 2 * float(self.moves.max() - self.moves.min())

    def plain_is_outside(self) -> bool:
        """Whether words without signal, two words or more away from any, are outside in every best path."""
        stretches = [[None if i < left or i >= 5 - right else "x" for i in range(5)] for left in range(3) for right in range(3)]
        scores = np.concatenate([self.scores(x) for x in stretches])
        return bool((scores[:, 0] - scores[:, 1:].max(axis=1) > self.lead()).all())


def viterbi(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of many chains at once: scores (chain, place, label), outside before and after each chain."""
    chains, most, labels = scores.shape
    best = moves[0][None, :] + scores[:, 0]
    back = np.zeros((chains, most, labels), np.int8)
    final = best + moves[:, 0]
    last = np.where(lengths == 1, final.argmax(axis=1), 0)
    for t in range(1, most):
        way = best[:, :, None] + moves[None]
        back[:, t] = way.argmax(axis=1)
        best = way.max(axis=1) + scores[:, t]
        ended = lengths == t + 1
        last[ended] = (best[ended] + moves[:, 0]).argmax(axis=1)
    out = np.zeros((chains, most), np.int8)
    now = last
    for t in range(most - 1, -1, -1):
        inside = t < lengths
        out[inside, t] = now[inside]
        now = np.where(inside, back[np.arange(chains), t, now], now)
    return out


def fit(table: list[list[tuple[str, str]]] | None = None, rounds: int = 120, penalty: float = 0.02) -> Model:
    """Maximum likelihood with an L2 penalty, by full gradients (forward-backward over all sentences at once) and Adam."""
    table = labelled_words() if table is None else table
    index: dict[tuple[int, str], int] = {}
    places: list[list[list[int]]] = []
    most = max(map(len, table))
    for row in table:
        words = [None, None, *(w for w, _ in row), None, None]
        own = [EDGE if w is None else word_features(w) for w in words]
        places.append([[index.setdefault((p, f), len(index)) for p in PLACES for f in own[i + p]] for i in range(2, len(words) - 2)])
    n, k = len(table), len(LABELS)
    lengths = np.array([len(r) for r in table])
    mask = np.arange(most)[None, :] < lengths[:, None]
    flat = np.concatenate([np.array(f) for row in places for f in row])
    owner = np.repeat(np.flatnonzero(mask.ravel()), [len(f) for row in places for f in row])
    gold = np.zeros((n, most), np.int64)
    for i, row in enumerate(table):
        gold[i, : len(row)] = [LABELS.index(x) for _, x in row]
    one = np.eye(k)
    target = np.zeros((len(index), k))
    np.add.at(target, flat, one[gold.ravel()[owner]])
    inside = mask[:, 1:]
    target_moves = np.zeros((k, k))
    np.add.at(target_moves, (gold[:, :-1][inside], gold[:, 1:][inside]), 1)
    np.add.at(target_moves, (0, gold[:, 0]), 1)
    np.add.at(target_moves, (gold[np.arange(n), lengths - 1], 0), 1)
    theta = [np.zeros((len(index), k)), np.zeros((k, k))]
    first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.flatnonzero(mask.ravel()))
    for step in range(1, rounds + 1):
        weights, moves = theta
        scores = np.zeros((n * most, k))
        scores[np.flatnonzero(mask.ravel())] = np.add.reduceat(weights[flat[order]], starts)
        scores = scores.reshape(n, most, k)
        forward, backward = np.zeros((n, most, k)), np.zeros((n, most, k))
        forward[:, 0] = moves[0] + scores[:, 0]
        for t in range(1, most):
            x = forward[:, t - 1, :, None] + moves[None]
            top = x.max(axis=1)
            forward[:, t] = np.log(np.exp(x - top[:, None]).sum(axis=1)) + top + scores[:, t]
        backward[np.arange(n), lengths - 1] = moves[:, 0]
        for t in range(most - 2, -1, -1):
            x = moves[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :]
            top = x.max(axis=2)
            value = np.log(np.exp(x - top[:, :, None]).sum(axis=2)) + top
            backward[:, t] = np.where((t < lengths - 1)[:, None], value, backward[:, t])
        both = forward + backward
        log_z = both[:, 0].max(axis=1) + np.log(np.exp(both[:, 0] - both[:, 0].max(axis=1, keepdims=True)).sum(axis=1))
        marginal = np.exp(both - log_z[:, None, None]) * mask[:, :, None]
        expected = np.zeros_like(weights)
        np.add.at(expected, flat, marginal.reshape(-1, k)[owner])
        pair = forward[:, :-1, :, None] + moves[None, None] + (scores + backward)[:, 1:, None, :] - log_z[:, None, None, None]
        expected_moves = (np.exp(np.minimum(pair, 0)) * inside[:, :, None, None]).sum(axis=(0, 1))
        expected_moves[0] += marginal[:, 0].sum(axis=0)
        expected_moves[:, 0] += marginal[np.arange(n), lengths - 1].sum(axis=0)
        for j, gradient in enumerate((target - expected - penalty * weights, target_moves - expected_moves - penalty * moves)):
            first[j] = 0.9 * first[j] + 0.1 * gradient
            second[j] = 0.99 * second[j] + 0.01 * gradient**2
            theta[j] = theta[j] + 0.1 * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.99**step)) + 1e-8)
    return Model({f: theta[0][i] for f, i in index.items()}, theta[1])


# --- whole texts ---------------------------------------------------------------------------------------------------------


def undecided(text: str, model: Model, everywhere: bool) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """Chains of words (start, end) that may be other than outside, with their scores."""
    if not everywhere and not _SIGNAL.search(text):
        return
    spans = [m.span() for m in _WORD.finditer(text)]
    if everywhere:
        near = range(len(spans))
    else:
        starts = np.array([s for s, _ in spans])
        hit = {int(np.searchsorted(starts, m.start(), side="right")) - 1 for m in _SIGNAL.finditer(text)}
        near = sorted({j for i in hit for j in range(max(0, i - 2), min(len(spans), i + 3))})
    lead, chain, rows, before = model.lead(), [], [], -2
    word = lambda i: text[slice(*spans[i])] if 0 <= i < len(spans) else None
    for i in near:
        score = model.scores([word(i + p) for p in PLACES])[0]
        fixed = score[0] - score[1:].max() > lead
        if chain and (fixed or before != i - 1):
            yield chain, np.stack(rows)
            chain, rows = [], []
        if not fixed:
            chain.append(spans[i])
            rows.append(score)
            before = i
    if chain:
        yield chain, np.stack(rows)


def alone(text: str, span: tuple[int, int]) -> bool:
    """Whether a word is long enough to be a whole number or address; two such in a row are two spans."""
    word = text[slice(*span)]
    return "@" in word or sum("0" <= c <= "9" for c in word) >= 9


_OUTER = ".,;:!?*$#&%\"'<>|"


def added_spans(chains: list[tuple[str, list[tuple[int, int]], np.ndarray]], model: Model) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of the labelled runs of each chain, without outer punctuation; chains are decoded in batches by length."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in chains]
    order = sorted(range(len(chains)), key=lambda i: len(chains[i][1]))
    for begin in range(0, len(order), 256):
        part = order[begin : begin + 256]
        lengths = np.array([len(chains[i][1]) for i in part])
        scores = np.zeros((len(part), int(lengths.max()), len(LABELS)))
        for row, i in enumerate(part):
            scores[row, : lengths[row]] = chains[i][2]
        labels = viterbi(scores, lengths, model.moves)
        for row, i in enumerate(part):
            text, spans, _ = chains[i]
            j = 0
            while j < lengths[row]:
                k, label = j, int(labels[row, j])
                while k + 1 < lengths[row] and labels[row, k + 1] == label and not (alone(text, spans[k]) and alone(text, spans[k + 1])):
                    k += 1
                if label:
                    s, e = spans[j][0], spans[k][1]
                    while s < e and text[s] in _OUTER:
                        s += 1
                    while e > s and text[e - 1] in _OUTER:
                        e -= 1
                    if e > s and any(c.isalnum() for c in text[s:e]):
                        out[i].append((label - 1, s, e))
                j = k + 1
    return out


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: rid, doc_id, base and spans, both array<struct<kind, start, end>> by kind and start.

    base: spans of the patterns. spans: those and what the field adds without touching them; offsets are code points, end
    exclusive. Null is the empty text; further columns are not looked at."""
    model = fit() if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.moves, not model.plain_is_outside()))

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, moves, everywhere = shared.value
        own = Model(weights, moves)
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        as_rows = lambda x: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x]
        for b in batches:
            base, chains, owner = [], [], []
            for i, raw in enumerate(texts(b.column(2))):
                text = raw.decode("utf-8", "replace")
                if not everywhere and not _SIGNAL.search(text):
                    base.append([])
                    continue
                base.append(pattern_spans(text))
                for chain, scores in undecided(text, own, everywhere):
                    chains.append((text, chain, scores))
                    owner.append(i)
            more: list[list[tuple[int, int, int]]] = [[] for _ in base]
            for i, found in zip(owner, added_spans(chains, own), strict=True):
                more[i] += [x for x in found if all(x[2] <= s or e <= x[1] for _, s, e in base[i])]
            every = [sorted(x + y) for x, y in zip(base, more, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([as_rows(x) for x in base], span), pa.array([as_rows(x) for x in every], span)], names=["rid", "doc_id", "base", "spans"])

    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select("rid", "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = "array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(out, f"rid long, doc_id {kind}, base {span}, spans {span}")
