"""Search: exact vector top-k, weighted keywords, references, rank fusion and what follows it.

A chunks table has an id; ties in a score are broken by it. Vector search streams the vectors through numpy products, one
top-k for each Arrow batch, so that only k rows a batch and question are left for the global top-k.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import values as V
from tessera.session import bounded, checkpointed


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def vector_scores(vectors: DataFrame, questions: list[tuple[int, list[float]]], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(qid, id, similarity) with the best k of each Arrow batch; similarity is rounded to six places, NaN is left out. Ids are
    of any type."""
    kind = vectors.schema[id_col].dataType.simpleString()
    if not questions:
        return vectors.sparkSession.createDataFrame([], f"qid long, id {kind}, similarity double")
    asked = vectors.sparkSession.sparkContext.broadcast((np.array([q for q, _ in questions], np.int64), np.array([v for _, v in questions], np.float64).reshape(len(questions), -1)))
    rows = vectors.filter(F.col(vector_col).isNotNull()).select(id_col, vector_col)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = asked.value
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            order = np.empty(b.num_rows, np.int64)
            order[pc.sort_indices(b.column(0)).to_numpy()] = np.arange(b.num_rows)
            with np.errstate(invalid="ignore", divide="ignore"):
                similarity = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ q.T, 6)
            best = []
            for j in range(len(qids)):
                good = np.flatnonzero(~np.isnan(similarity[:, j]))
                best.append(good[np.lexsort((order[good], -similarity[good, j]))[:k]])
            row, question = np.concatenate(best), np.repeat(np.arange(len(qids)), [len(x) for x in best])
            yield pa.RecordBatch.from_arrays([pa.array(qids[question]), b.column(0).take(pa.array(row)), pa.array(similarity[row, question])], names=["qid", "id", "similarity"])

    return rows.mapInArrow(out, f"qid long, id {kind}, similarity double")


def vector_topk(vectors: DataFrame, question: list[float], k: int, min_similarity: float | None = None, **columns: str) -> DataFrame:
    """(id, similarity) of the k most similar rows; the threshold is applied to those."""
    top = vector_scores(vectors, [(0, question)], k, **columns).orderBy(F.desc("similarity"), "id").limit(k).select("id", "similarity")
    return top if min_similarity is None else top.filter(F.col("similarity") >= min_similarity)


def vector_topk_many(vectors: DataFrame, questions: DataFrame, k: int, at_once: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(qid, id, similarity, rank) for a stated set of questions (qid, vector), in blocks of about ``at_once``: the driver
    holds one block at a time, and with several each one's result is checkpointed before the next begins."""
    qid, vector = questions.columns[:2]
    blocks = max(1, -(-questions.count() // at_once))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")).cast("long")
    done = []
    for i in range(blocks):
        own = questions.filter(F.pmod(F.xxhash64(qid), F.lit(blocks)) == i) if blocks > 1 else questions
        found = vector_scores(vectors, [(r[0], r[1]) for r in own.select(qid, vector).collect()], k, id_col, vector_col)
        found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        done.append(checkpointed(found) if blocks > 1 else found)
    return reduce(DataFrame.unionByName, done)


def keyword_relevance(keywords: list[str], content: Column, class_name: Column, method_name: Column) -> Column:
    """For each keyword 1 if the content has it, 2 if the class has it, 2 if the method has it; over five times their number."""
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in (content, class_name, method_name)]
    hit = lambda c, k, w: F.when(F.contains(c, F.lit(k.lower())), w).otherwise(0)
    total = reduce(lambda a, b: a + b, [hit(c, k, w) for k in keywords for c, w in zip(low, (1, 2, 2), strict=True)])
    return total.cast("double") / (5.0 * len(keywords))


def keyword_search(chunks: DataFrame, keywords: list[str], k: int, positive: bool = True) -> DataFrame:
    """chunks: id, content, class_name, method_name, documentation. Rows with a keyword anywhere, by relevance; rows found in
    documentation alone have relevance 0, use places among the k, and are left out afterwards."""
    if not keywords:
        return chunks.select("id", F.lit(0.0).alias("relevance")).limit(0)
    texts = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("content", "class_name", "method_name", "documentation")]
    found = reduce(lambda a, b: a | b, [F.contains(c, F.lit(w.lower())) for w in keywords for c in texts])
    score = F.round(keyword_relevance(keywords, F.col("content"), F.col("class_name"), F.col("method_name")), 6)
    top = chunks.filter(found).select("id", score.alias("relevance")).orderBy(F.desc("relevance"), "id").limit(k)
    return top.filter("relevance > 0") if positive else top


def ranked(top: DataFrame, score: str) -> DataFrame:
    """Adds rank from 1; for results of a limit, which are few."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "id")).cast("long"))


def fuse(semantic: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """Reciprocal-rank fusion of two top-k results: (id, score, rank), scores over the largest; ties go to the better
    semantic rank, then the better keyword rank, then the id."""
    a = ranked(semantic, "similarity").select("id", F.col("rank").alias("semantic_rank"))
    b = ranked(keyword, "relevance").select("id", F.col("rank").alias("keyword_rank"))
    both = a.join(b, "id", "full_outer")
    value = F.coalesce(1 / (V.RRF_K + F.col("semantic_rank")), F.lit(0.0)) + F.coalesce(V.KEYWORD_WEIGHT / (V.RRF_K + F.col("keyword_rank")), F.lit(0.0))
    order = [F.desc("rrf"), F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("keyword_rank"), F.asc("id")]
    top = both.withColumn("rrf", value).orderBy(*order).limit(k)
    rank = F.row_number().over(Window.orderBy(*order)).cast("long")
    return top.select("id", F.round(F.col("rrf") / F.max("rrf").over(Window.partitionBy()), 6).alias("score"), rank.alias("rank"))


def hybrid_search(vectors: DataFrame, chunks: DataFrame, question: list[float], keywords: list[str], k: int, min_similarity: float | None = None) -> DataFrame:
    """Vector search for 2k rows and keyword search for k, fused."""
    return fuse(vector_topk(vectors, question, 2 * k, min_similarity), keyword_search(chunks, keywords, k), k)


def boost(results: DataFrame, is_boosted: Column, factor: float = 2.0) -> DataFrame:
    """Boosted rows first, each part in its order; their score times the factor, 1 at most. Not sorted by score again."""
    marked = results.withColumn("boosted", is_boosted)
    rank = F.row_number().over(Window.orderBy(F.desc("boosted"), "rank")).cast("long")
    return marked.withColumn("rank", rank).withColumn("score", F.when(F.col("boosted"), F.least(F.lit(1.0), F.round(F.col("score") * factor, 6))).otherwise(F.col("score")))


def pin(results: DataFrame, pinned: DataFrame) -> DataFrame:
    """pinned (id) at the head with score 1, once each, in the order of ``place`` if there is one and of the id; the others keep
    their order behind."""
    place = F.min(F.col("place").cast("double")) if "place" in pinned.columns else F.lit(0.0)
    head = pinned.groupBy("id").agg(place.alias("place")).select("id", F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("rank"), "place")
    rest = results.select("id", "score", "rank", F.lit(0.0).alias("place")).join(head.select("id"), "id", "left_anti")
    rank = F.row_number().over(Window.orderBy("rank", "place", "id")).cast("long")
    return head.unionByName(rest).withColumn("rank", rank).drop("place")


def reference_search(references: DataFrame, name: str, k: int) -> DataFrame:
    """references: id, name. The first k ids that refer to a name."""
    return references.filter(F.col("name") == name).select("id").distinct().orderBy("id").limit(k)


def dependencies(sources: DataFrame, references: DataFrame, classes: DataFrame, per_chunk: int = 3) -> DataFrame:
    """sources: id, rank; references: id, pos, name; classes: name, class_id. Classes that the first references of each
    source name, without sources, each once at its first place: (class_id, source_rank, pos). sources is broadcast if a count
    of it allows that."""
    sources = bounded(sources)
    first = references.filter(F.col("pos") < per_chunk).join(sources, "id")
    found = first.join(classes, "name").join(sources.select(F.col("id").alias("class_id")), "class_id", "left_anti")
    low = found.groupBy("class_id").agg(F.min(F.struct(F.col("rank").alias("source_rank"), "pos")).alias("at"))
    return low.select("class_id", "at.source_rank", "at.pos")


def class_context(name: str, references: DataFrame, classes: DataFrame, referenced: int = 5, referencing: int = 5) -> DataFrame:
    """The classes a class names first, and chunks that name it, itself left out of those: (id, leg). The legs may share rows."""
    own = classes.filter(F.col("name") == name).orderBy("class_id").limit(1).select(F.col("class_id").alias("id"))
    out = references.join(F.broadcast(own), "id", "left_semi").filter(F.col("pos") < referenced).join(classes, "name").select(F.col("class_id").alias("id"), F.lit("referenced").alias("leg"))
    into = reference_search(references.join(F.broadcast(own), "id", "left_anti"), name, referencing).select("id", F.lit("referencing").alias("leg"))
    return own.select("id", F.lit("self").alias("leg")).unionByName(out).unionByName(into)


def context(rows: DataFrame, part: Column, separator: str = "\n\n") -> DataFrame:
    """One text of the parts of a few ranked rows, in order of rank."""
    parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return rows.agg(F.array_join(F.transform(parts, lambda x: x["part"]), separator).alias("context"))
