"""Each stage of the pipeline against a brute-force version of its own input; components; guards."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import quality
from tessera.llm.components import connected_components
from test_near_copies import brute_kept

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name != "pack":
            assert docs.columns == columns
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert all(before[d] == t for d, t in texts.items())
        if name == "quality":
            model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            scores = {d: model.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for d, t in before.items()}
            assert set(texts) == {d for d, s in scores.items() if s >= quality.THRESHOLD} and len(texts) < len(before)
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for d, t in before.items():
                groups[t.encode().lower()].append(d)
            assert set(texts) == {max(g) for g in groups.values()}
        elif name == "near_dedup":
            assert sorted(texts) == brute_kept(list(before.items()))
        elif name == "decontaminate":
            windows = set()
            for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
                w = words(r.text)
                n = min(10, len(w))
                windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
            hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [words(t)] for i in range(len(w) - 9))
            assert set(texts) == {d for d, t in before.items() if not hit(t)} and len(texts) < len(before)
        else:
            encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
            spans = defaultdict(list)
            ids = {d: np.array(encode(t, add_special_tokens=False).ids + [1], "<u4") for d, t in before.items()}
            for r in docs.collect():
                assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
                spans[r.doc_id].append((r.start, r.length))
            for d, own in spans.items():
                assert [s for s, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) == len(ids[d])
            assert set(spans) == set(before)


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.select(sorted(df.columns)).collect())))


def staged(spark, sf_dir, folder):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs


def test_run_equals_stages(spark, tmp_path):
    """run() keeps its tables in the shared folder and removes them; on documents with null ids and texts, repeated rows, a
    further column and texts without words."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = base.filter("doc_id < 60")
    more = spark.createDataFrame([(None, "one two three", "en"), (None, None, "en"), (5, "", None), (5, "", None), (7, " \n", "de")], "doc_id long, text string, lang string")
    for c in base.columns:
        if c not in more.columns:
            more = more.withColumn(c, F.lit(None).cast(base.schema[c].dataType))
    odd = odd.unionByName(odd.filter("doc_id < 20")).unionByName(more.select(base.columns)).withColumn("fp", F.lit("x"))
    odd.coalesce(3).write.parquet(str(tmp_path / "in/documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"in/{name}.parquet"))
    assert spark.conf.get("spark.checkpoint.dir", None)
    got = rows_of(corpus_pipeline.run(spark, str(tmp_path / "in")))
    assert got == rows_of(staged(spark, str(tmp_path / "in"), str(tmp_path / "a"))) and len(got) > 20


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(i, i + 1) for i in range(200, 300)] + [(7, 7)] + [(400, i) for i in range(401, 460)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
