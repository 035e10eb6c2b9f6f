"""Quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams (words, pairs of words, and runs of up to three word shapes) are scaled by the log ratio of
their smoothed counts in both classes, and a linear hinge-loss model is fitted to the scaled vectors by dual coordinate
descent. The margin becomes a score from 0 to 1 by a logistic curve fitted to margins of rows left out of the fit.

The fit reads at most ``max_labelled`` labelled documents, those with the smallest hashed ids, whatever the size of the
tables; every document is scored over its whole text, in numpy steps of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold, steps, trimmed, utf8
from tessera.llm.tokens import Tokens, mix

BITS = 18
#: Text bytes whose n-grams are held at once; a longer single text is a step of its own.
AT_ONCE = 500_000
#: Labelled documents that the fit reads at most.
MAX_LABELLED = 6000
#: Folds by crc32 of the id; labels of HELD_OUT are never learned from.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

_LOWER, _UPPER, _DIGIT, _HIGH = (np.zeros(256, bool) for _ in range(4))
_LOWER[97:123] = _UPPER[65:91] = _DIGIT[48:58] = _HIGH[128:] = True
_WORD = _LOWER | _UPPER | _DIGIT | _HIGH


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, first feature of each text): the different hashed n-grams of each text; feature 0, the bias, is in each."""
    t = Tokens(raw, at)
    n_docs = len(at) - 1
    if len(t):
        h = t.hashes()
        size = np.minimum(t.end - t.start, 255)
        lower, upper, digit, high = (t.count(k) for k in (_LOWER, _UPPER, _DIGIT, _HIGH))
        letters = lower + upper
        case = np.where(letters + high == 0, 0, np.where(upper == 0, 1, np.where((lower == 0) & (upper > 1), 3, np.where(upper == 1, 2, 4))))
        first, last = raw[t.start], raw[t.end - 1]
        begin = np.where(_WORD[first], 0, first)
        tail = np.where(_WORD[last], 0, last)
        before = raw[np.maximum(t.end - 2, t.start)]
        tail2 = np.where(_WORD[before] | (size < 2), 0, before)
        same_doc = np.r_[False, t.doc[1:] == t.doc[:-1]]
        repeat = same_doc & np.r_[False, h[1:] == h[:-1]]
        shape = (((((case * 256 + begin) * 256 + tail) * 256 + tail2) * 2 + (digit > 0)) * 2 + repeat).astype(np.uint64)
        s1 = mix(shape + np.uint64(1))
        two, three = same_doc, same_doc & np.r_[False, False, (t.doc[2:] == t.doc[:-2])][: len(t)]
        two, three = np.flatnonzero(two), np.flatnonzero(three)
        prime = np.uint64(0x9E3779B97F4A7C15)
        s2 = mix(s1[two - 1] * prime + s1[two])
        s3 = mix((s1[three - 2] * prime + s1[three - 1]) * prime + s1[three])
        w2 = mix(h[two - 1] * prime + h[two] + np.uint64(7))
        keys = np.concatenate([h, s1, s2, s3, w2])
        docs = np.concatenate([t.doc, t.doc, t.doc[two], t.doc[three], t.doc[two]])
    else:
        keys, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    column = 1 + (keys % np.uint64((1 << BITS) - 1)).astype(np.int64)
    code = np.concatenate([docs << BITS | column, np.arange(n_docs, dtype=np.int64) << BITS])
    code = np.sort(code)
    code = code[np.r_[True, code[1:] != code[:-1]]]
    return (code & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(code, np.arange(n_docs + 1, dtype=np.int64) << BITS)


@dataclass
class Model:
    """scale: log-count ratio of each feature; weight: of the scaled features; slope and shift: of the logistic curve."""

    scale: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    def margins(self, feature: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of texts of which each has a feature at least."""
        x = self.scale[feature]
        norm = np.sqrt(np.add.reduceat(x * x, first[:-1]))
        return np.add.reduceat(x * self.weight[feature], first[:-1]) / norm

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = self.slope * self.margins(*features(raw, at)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = (smooth + np.bincount(np.concatenate([*(r for r, c in zip(rows, y, strict=True) if c == label), np.zeros(0, np.int32)]), minlength=1 << BITS) for label in (1, 0))
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    r[0] = 1.0  # the bias is no n-gram
    return r


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 20, seed: int = 1) -> np.ndarray:
    """Weights of the linear hinge-loss model over unit-length rows; cost: the largest dual value of each row."""
    rng = np.random.default_rng(seed)
    values = [scale[r] / np.linalg.norm(scale[r]) for r in rows]
    sign, alpha, weight = np.where(y == 1, 1.0, -1.0), np.zeros(len(rows)), np.zeros(len(scale))
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (weight[rows[i]] @ values[i]) - 1  # the rows have length 1
            new = min(max(alpha[i] - gradient, 0.0), cost[i])
            if new != alpha[i]:
                weight[rows[i]] += (new - alpha[i]) * sign[i] * values[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return weight


def logistic_curve(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """slope and shift by Newton steps, over targets drawn a little inwards."""
    pos, neg = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(b[0]), 1e-6), float(b[1])


def fit_rows(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """rows: the features of each text. With one class alone, all scores are about that class's share."""
    if len(set(y.tolist())) < 2:
        share = (float((y == 1).sum()) + 1) / (len(y) + 2)
        return Model(np.ones(1 << BITS), np.zeros(1 << BITS), 1.0, float(np.log(share / (1 - share))))
    balance = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))

    def fit(take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, labels = [rows[i] for i in take], y[take]
        scale = log_count_ratio(own, labels)
        return scale, dual_coordinate_descent(own, labels, scale, balance[take])

    margin = np.zeros(len(rows))
    for k in range(2):  # each half is scored by the fit of the other one
        take, rest = np.arange(len(rows)) % 2 != k, np.arange(len(rows)) % 2 == k
        if len(set(y[take].tolist())) < 2:
            take = rest = np.ones(len(rows), bool)
        scale, weight = fit(np.flatnonzero(take))
        half = Model(scale, weight, 1.0, 0.0)
        for i in np.flatnonzero(rest):
            margin[i] = half.margins(rows[i], np.array([0, len(rows[i])]))[0]
    slope, shift = logistic_curve(margin, y)
    scale, weight = fit(np.arange(len(rows)))
    return Model(scale, weight, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Learns from at most ``max_labelled`` labelled documents outside the held-out fold. Rows without an id or a label
    are no labels; of several labels of an id the largest counts, of several texts the first in order."""
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .filter((fold(F.col("id"), FOLDS) != HELD_OUT) & F.col("id").isNotNull() & F.col("y").isNotNull())
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    )

    @trimmed
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = utf8(b.column(1))
            for i, j in steps(at, AT_ONCE):
                feature, first = features(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                packed = [feature[first[k] : first[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(packed, pa.binary())], names=["id", "y", "features"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    kind = texts.schema["id"].dataType.simpleString()
    one = texts.groupBy("id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("id", "text", "y")
    table = one.mapInArrow(extract, f"id {kind}, y int, features binary").toArrow().sort_by("id")
    y = table.column("y").to_numpy()
    return fit_rows([np.frombuffer(x.as_py(), np.int32) for x in table.column("features")], np.asarray(y, dtype=np.int64))


def _scorer(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.scale.astype(np.float32), model.weight.astype(np.float32), model.slope, model.shift))

    def scores(column: pa.Array) -> np.ndarray:
        raw, at = utf8(column)
        out = np.zeros(len(at) - 1)
        for i, j in steps(at, AT_ONCE):
            out[i:j] = shared.value.scores(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        return out

    return scores


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row. Null is the empty text, which has a score, too; further columns are not looked at."""
    scores = _scorer(docs, model)

    @trimmed
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1)))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(out, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def drop_low_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input without rows that score below the threshold; all columns stay."""
    scores, place = _scorer(docs, model), docs.columns.index(text_col)

    @trimmed
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(b.column(place)) >= threshold))

    return docs.mapInArrow(out, docs.schema)
