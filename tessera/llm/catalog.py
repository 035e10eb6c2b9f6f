"""Queries of the text operators over the whole tables, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, ctw, decontaminate, exact_dedup, importance, licenses, packing, pii, quality, repair, secrets, simhash, token_counts
from tessera.llm.common import fold, read

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents. A row for each row of documents; null text is empty and has none; repeated rows repeat."""
    found = pii.find(read(spark, sf_dir, "documents"))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned outside the held-out fold. A row for each row of documents; null text is empty (its end alone); a null id is in the fold of the empty string."""
    return ctw.score(read(spark, sf_dir, "documents")).drop("rid")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and their components over all documents. A row for each row; texts without words have fingerprint 0 and link like others; a null id is larger than any other."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in all documents, with the places where they are. A row for each row of documents; null text has none."""
    found = licenses.scan(read(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["licence"], m["start"], m["end"]))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))), ",").alias("licences"),
        F.array_join(spans, ",").alias("spans"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens. Null text is empty and still has its end; repeated rows are packed each; an empty table gives no rows."""
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), with_ids=False)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels outside the held-out fold. A row for each row of documents; null text is empty; labels of no document do not count."""
    docs = read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents. A row for each row; null text is empty; a null id is smaller than any other; of rows with equal text and id the last one stays."""
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents")).drop("rid")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for secrets in all documents, with the probability that they are. A row for each candidate; null text has none."""
    found = secrets.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "probability", "secret")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pieces of all documents. A row for each row of documents; null text is empty and has none."""
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)).drop("rid")


OP7_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), {AZ}) AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark in all documents. A row for each row of documents; null has no words; repeated items count once, a null item id is empty."""
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP8_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), o AS (
  SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), h AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM o) GROUP BY rid
), t AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM o GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by importance towards the benchmark, on single words. A row for each row of documents; null has no words; a null id comes last in ties."""
    drawn = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), most_words=1)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = f"""
WITH step AS (
  SELECT list(list_reduce(list_concat([b], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS t FROM range(256) r(b)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), dw AS (SELECT rid, unnest(w) AS word FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
v AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
c AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
                               lambda a, y: xor(a >> 8, t[1 + (xor(a, y) & 255)])), 4294967295) % 10000 AS bucket
  FROM v, step
), s AS (SELECT bucket, count(*) AS n FROM dw JOIN c USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN c USING (word) GROUP BY bucket),
g AS (
  SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
                                        / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM c) b LEFT JOIN s ON s.bucket = b.bucket LEFT JOIN t ON t.bucket = b.bucket
), f AS (SELECT rid, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN c USING (word) JOIN g USING (bucket) GROUP BY rid),
z AS (
  SELECT rid, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN f USING (rid)
), r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rid) AS place, 10 * count(*) OVER () // 100 AS wanted FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank FROM z LEFT JOIN r USING (rid)
"""


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by a byte-level vocabulary, and what they decode to. A row for each row of documents; null text is empty."""
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE)).drop("rid")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repairs of all conversations after the stated damage. A row for each conversation id of the table, null included."""
    return repair.repair_damaged(read(spark, sf_dir, "conversations"))


def _edit(way: str, cost: str, letter: str, when: str = "true") -> str:
    """SQL of a way (six digits of cost, then the audit; '~' if there is none) with one more edit."""
    return f"CASE WHEN {way} = '~' OR NOT ({when}) THEN '~' ELSE lpad(CAST(CAST({way}[1:6] AS INTEGER) + {cost} AS VARCHAR), 6, '0') || {way}[7:] || '{letter}' END"


_FIT, _LATE = "x[3] IN ('n', 't')", "CASE x[3] WHEN 't' THEN 5 ELSE 0 END"
_DELETED = [_edit(f"a[{q}]", "2", "D") for q in (1, 2, 3, 4)]
_KEPT = {(q, r): _edit(f"a[{q}]", _LATE, "K", f"{_FIT} AND x[2] = '{r}'") for q, r in ((1, "s"), (1, "u"), (2, "u"), (4, "u"), (3, "a"))}
_NAMED = {q: _edit(f"a[{q}]", f"1 + {_LATE}", "R", _FIT) for q in (1, 2, 3, 4)}
_ADDED = {q: _edit(f"a[{q}]", "5", "I") for q in (1, 2, 3, 4)}
OP13_SQL = f"""
WITH step AS (
  SELECT list(list_reduce(list_concat([b], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS t FROM range(256) r(b)
), o AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations
), k AS (
  SELECT rid, conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
                                             lambda a, y: xor(a >> 8, t[1 + (xor(a, y) & 255)])), 4294967295) % 20 AS kind FROM o, step
), r AS (
  SELECT rid, 0 AS copy, conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k WHERE kind <> 0
  UNION ALL SELECT rid, 1, conv_id, turn, role, text FROM k WHERE kind = 3
), f AS (
  SELECT *, role[1:1] AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, rid, copy) AS n,
         lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, rid, copy) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid, copy) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE 'n' END AS fault FROM r
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal,
         flatten(list([['I'], ['I'], ['R', i, fault]] ORDER BY n)) AS steps FROM f GROUP BY conv_id
), w AS (
  SELECT *, list_reduce(list_concat([['000000', '~', '~', '~']], steps, [['I'], ['I']]), lambda a, x: CASE x[1]
    WHEN 'I' THEN [a[1], a[2], least(a[3], {_ADDED[1]}, {_ADDED[2]}, {_ADDED[4]}), least(a[4], {_ADDED[3]})]
    ELSE [{_DELETED[0]}, least({_DELETED[1]}, {_KEPT[1, "s"]}),
          least({_DELETED[2]}, {_KEPT[1, "u"]}, {_KEPT[2, "u"]}, {_KEPT[4, "u"]}, {_NAMED[1]}, {_NAMED[2]}, {_NAMED[4]}),
          least({_DELETED[3]}, {_KEPT[3, "a"]}, {_NAMED[3]})] END) AS ways FROM c
), b AS (SELECT *, least(ways[1], ways[4]) AS best FROM w),
e AS (SELECT conv_id, best[7:] AS audit, unnest(range(1, len(best) - 5)) AS p FROM b),
l AS (
  SELECT conv_id, p, audit[p] AS letter, count(*) FILTER (audit[p] <> 'I') OVER z AS n, count(*) FILTER (audit[p] <> 'D') OVER z AS place
  FROM e WINDOW z AS (PARTITION BY conv_id ORDER BY p)
), m AS (
  SELECT l.conv_id, p, letter, place, role, CASE letter WHEN 'I' THEN '' ELSE text END AS text,
         max(CASE WHEN place = 1 AND letter = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system
  FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = l.n WHERE letter <> 'D'
), t AS (
  SELECT conv_id, sha256(string_agg(CASE letter WHEN 'K' THEN role ELSE CASE (place - system) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || text, chr(10) ORDER BY p)) AS sha FROM m GROUP BY conv_id
)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(best[1:6] AS BIGINT), 0) AS cost, coalesce(best[7:], '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM d.conv_id
"""

QUERIES = {
    "op1_pii": op1_pii,
    "op2_ctw": op2_ctw,
    "op8_decontaminate": op8_decontaminate,
    "op3_simhash": op3_simhash,
    "op4_licenses": op4_licenses,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op9_secrets": op9_secrets,
    "op10_token_counts": op10_token_counts,
    "op11_importance": op11_importance,
    "op12_bpe": op12_bpe,
    "op13_repair": op13_repair,
}

ORACLES = {
    "op8_decontaminate": OP8_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op11_importance": OP11_SQL,
    "op13_repair": OP13_SQL,
}
