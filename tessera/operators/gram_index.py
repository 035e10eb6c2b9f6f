"""An inverted index of character grams for substring search over chunks.

Each chunk has one posting for each different run of GRAM characters in one of its lower-cased texts. A keyword can only be in
chunks that have all its grams, so the postings of its rarest grams are intersected and the chunks that are left are
compared in whole. Postings are in parts by the hash of the gram and sorted in each, chunks in blocks by the hash of
their id; a search reads the parts of its grams, the row groups there that have them, and the blocks with a candidate.

At scale: a gram in all chunks is as many rows, not one long list; what comes to the driver is one count for each gram that
is asked for, and the numbers of blocks, of which there are BLOCKS at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.session import bounded, checkpointed

GRAM = 3
#: Folders of postings and of chunks; they have to stay as an index was made.
PARTS, BLOCKS = 64, 256
#: Grams of a keyword that are intersected, the rarest ones.
MOST_GRAMS = 4
TEXTS = ("content", "class_name", "method_name", "documentation")


def grams(text: str) -> np.ndarray:
    """The different grams, each as 21 bits for a character; none if the text is shorter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(points) < GRAM:
        return np.zeros(0, np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])


class GramIndex:
    """Chunks under ``path``: ``rows`` by block, ``postings`` by part, and ``counts`` of grams."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS, blocks: int = BLOCKS):
        self.spark, self.path, self.parts, self.blocks = spark, path.rstrip("/"), parts, blocks

    def add(self, chunks: DataFrame) -> None:
        """chunks: id, the four texts, and what else there is. Ids have to be new and not null. Null texts have no grams."""

        def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 200):
                    part = b.slice(i, 200)
                    found = [np.unique(np.concatenate([grams(t) for t in texts if t] or [np.zeros(0, np.int64)])) for texts in zip(*(part.column(j).to_pylist() for j in range(2, len(part.columns))), strict=True)]
                    row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), part.column(0).take(row), part.column(1).take(row)], names=["gram", "id", "block"])

        placed = chunks.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(self.blocks)).cast("int"))
        placed.hint("rebalance", "block").write.mode("append").partitionBy("block").parquet(f"{self.path}/rows")
        kind = chunks.schema["id"].dataType.simpleString()
        low = placed.select("id", "block", *(F.lower(c).alias(c) for c in TEXTS))
        rows = low.mapInArrow(posted, f"gram long, id {kind}, block int").withColumn("part", self._part())
        rows.hint("rebalance", "part").sortWithinPartitions("part", "gram").write.mode("append").partitionBy("part").parquet(f"{self.path}/postings")
        written = self.spark.read.parquet(f"{self.path}/postings").groupBy("part", "gram").agg(F.count(F.lit(1)).alias("n"))
        written.repartition("part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/counts")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("gram"), F.lit(self.parts)).cast("int")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").drop("block")

    def _of(self, table: str, wanted: list[int], parts: dict[int, int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}").filter(F.col("part").isin(sorted({parts[g] for g in wanted})) & F.col("gram").isin(wanted))

    def candidates(self, keywords: list[str]) -> DataFrame | None:
        """id and block of all chunks that may have one of the keywords; None if a keyword is too short to tell."""
        asked = [[int(g) for g in grams(w.lower())] for w in keywords]
        if not all(asked):
            return None
        every = sorted({g for gs in asked for g in gs})
        parts = {r.gram: r.part for r in self.spark.createDataFrame([(g,) for g in every], "gram long").select("gram", self._part().alias("part")).collect()}
        counts = {r.gram: r.n for r in self._of("counts", every, parts).collect()}
        chosen = [sorted(gs, key=lambda g: (counts[g], g))[:MOST_GRAMS] for gs in asked if all(g in counts for g in gs)]
        if not chosen:
            return self._of("postings", every[:1], parts).select("id", "block").limit(0)
        used = sorted({g for gs in chosen for g in gs})
        # one look at the postings for all keywords: a chunk has a keyword's grams if it has as many of them as there are
        has = [F.count_if(F.col("gram").isin(gs)) == len(gs) for gs in chosen]
        return self._of("postings", used, parts).groupBy("id", "block").agg(reduce(lambda a, b: a | b, has).alias("all")).filter("all").select("id", "block")

    def matching(self, keywords: list[str]) -> DataFrame:
        """The chunks that may have one of the keywords; all chunks if a keyword has fewer than GRAM characters."""
        found = self.candidates(keywords)
        if found is None:
            return self.read()
        found = checkpointed(found)
        blocks = [r[0] for r in found.select("block").distinct().collect()]
        rows = self.spark.read.parquet(f"{self.path}/rows").filter(F.col("block").isin(blocks))
        return rows.join(bounded(found.select("id")), "id", "left_semi").drop("block")

    def keyword_search(self, keywords: list[str], k: int, positive: bool = True) -> DataFrame:
        """What ``search.keyword_search`` gives over all chunks of the index."""
        return search.keyword_search(self.matching(keywords) if keywords else self.read(), keywords, k, positive)
