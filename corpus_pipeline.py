"""A document pipeline: quality, exact and near duplicates, benchmark passages, packing.

Each stage works on all that the one before kept; the driver writes a stage's rows as Parquet and reads them for the next.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, exact_dedup, near_copies, packing, quality
from tessera.llm.common import checkpoint, read, released


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.drop_low_quality(docs, model)


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", keep_one_of_equal),
    ("near_dedup", keep_one_of_near),
    ("decontaminate", keep_uncontaminated),
    ("pack", pack),
]

#: Scores, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between stages rows are written to the shared folder and read again, where one is set; a
    stage's rows are removed when those of the next one are written."""
    docs = read(spark, sf_dir, "documents")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            if shared:
                path = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
                docs.write.parquet(path)
                docs = spark.read.parquet(path)
                if before:
                    _remove(spark, before)
                before = path
            else:
                docs = checkpoint(docs)
            released(spark)
    return docs
