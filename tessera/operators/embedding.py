"""Embeddings as a column: a pluggable function of texts, with reasons for rows that get none."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import values as V
from tessera.functions.text import token_estimate

RESULT = "struct<embedding:array<float>,reason:string>"


def hashed_terms(texts: list[str], dims: int) -> list[list[float]]:
    """Offline default: counts of words hashed into ``dims`` signed places, of unit length."""
    out = np.zeros((len(texts), dims))
    for row, text in zip(out, texts, strict=True):
        for word in text.lower().split():
            h = crc32(word.encode())
            row[h % dims] += 1 if h >> 31 else -1
        row /= np.linalg.norm(row) or 1.0
    return out.tolist()


def embed(rows: DataFrame, text: str, dims: int = 768, model: Callable[[list[str], int], list[list[float]]] = hashed_terms, most_tokens: int = V.OVERSIZE_TOKENS, batch: int = V.ITEMS_PER_BATCH) -> DataFrame:
    """Adds embedding and reason. A text over the token limit gets a reason; when a batch fails its texts are tried one by
    one, and what fails then gets its error. The vector stays on its row."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            vectors, reasons = [None] * len(texts), [None] * len(texts)
            for i in range(0, len(texts), batch):
                part = texts.iloc[i : i + batch]
                at = [i + j for j, t in enumerate(part) if t is not None and len(t) // 2 <= most_tokens]
                for j in set(range(i, i + len(part))) - set(at):
                    reasons[j] = "no text" if texts.iloc[j] is None else "too many tokens"
                try:
                    for j, v in zip(at, model([texts.iloc[j] for j in at], dims), strict=True):
                        vectors[j] = v
                except Exception:
                    for j in at:
                        try:
                            vectors[j] = model([texts.iloc[j]], dims)[0]
                        except Exception as error:
                            reasons[j] = f"failed: {error}"
            yield pd.DataFrame({"embedding": vectors, "reason": reasons})

    return rows.withColumn("__e", run(F.col(text))).withColumn("embedding", F.col("__e.embedding")).withColumn("reason", F.col("__e.reason")).drop("__e")


def skipped(rows: DataFrame, text: str) -> DataFrame:
    """The report of rows without an embedding: by reason and type, with the tokens."""
    lost = rows.filter("embedding IS NULL").withColumn("tokens", token_estimate(F.coalesce(F.col(text), F.lit(""))))
    return lost.groupBy("reason", "chunk_type").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
