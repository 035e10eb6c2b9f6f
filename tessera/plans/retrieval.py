"""Search and store queries over documents (as chunks) and embeddings, with their SQL twins.

Documents stand for chunks (doc_id: id, text: content, lang: language, source: file path and class), embeddings for their
vectors by vec_id = doc_id, capitalised words of a text for references, and the first capitalised word of a document for
the class it defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import pascal_names
from tessera.operators import graph, search, store
from tessera.operators.cell_index import CellIndex
from tessera.operators.gram_index import GramIndex
from tessera.session import checkpointed, scratch

K = 10
KEYWORDS = ["token", "license", "src1", "thing"]
QUESTION_ID = 0
PREFIX = "src1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def question(vectors: DataFrame) -> list[float]:
    return vectors.filter(F.col("vec_id") == QUESTION_ID).select("embedding").first()[0]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    nothing = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("language"), F.col("source").alias("file_path"), F.col("source").alias("class_name"), nothing.alias("method_name"), F.col("lang").alias("documentation"))


def references(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """id, pos (from 0, each name once), name; of some documents or of all."""
    names = F.array_distinct(pascal_names(F.col("text")))
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return docs.select(F.col("doc_id").alias("id"), F.posexplode(names).alias("pos", "name"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, class_id: names of over three letters that come first in a document; the smallest document has it. The search in
    a text ends at its first name."""
    first = F.regexp_extract("text", r"(?<![\p{L}\p{N}_])([A-Z][a-zA-Z0-9]*)(?![\p{L}\p{N}_])", 1)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), first.alias("name")).filter(F.length("name") > 3).groupBy("name").agg(F.min("id").alias("class_id"))


# --- vectors ---------------------------------------------------------------------------------------------------------


def vector_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return search.vector_topk(v, question(v), K)


def vector_topk_label(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return search.vector_topk(v.filter(F.col("label") == 1), question(v), K)


def vector_threshold(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return search.vector_topk(v, question(v), 50, min_similarity=0.3)


def vector_topk_many(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return search.vector_topk_many(v, v.filter(F.col("vec_id") % 50 == 0).select("vec_id", "embedding"), 5)


def vector_language(spark, sf_dir):
    v, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    of_language = v.join(d.filter("lang = 'en'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return search.vector_topk(of_language, question(v), K)


def ann_cells(spark, sf_dir):
    """Approximate search by cells for every row whose id is divisible by 50, against all rows: for each of the exact 10
    nearest, whether the probed cells have it. The mean of ``found`` is the recall; a test holds it to 0.9."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.filter(F.col("vec_id") % 50 == 0).select("vec_id", "embedding")
    near = store.search_cells(*store.build_cells(v), asked, K).select("qid", "id", F.lit(True).alias("found"))
    exact = search.vector_topk_many(v, asked, K)
    return exact.join(near, ["qid", "id"], "left").select("qid", "id", "similarity", "rank", F.coalesce("found", F.lit(False)).alias("found"))


def ann_stored(spark, sf_dir):
    """A kept index, made from nine tenths of the vectors and added the others without a new fit, asked for every row whose id
    is divisible by 50: the exact 10 nearest, and whether the index finds nine tenths of them or more."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.filter(F.col("vec_id") % 50 == 0).select("vec_id", "embedding")
    index = CellIndex(spark, scratch(spark, "cells"))
    index.create(v.filter(F.col("vec_id") % 10 != 3))
    index.add(v.filter(F.col("vec_id") % 10 == 3))
    near = index.search(asked, K).select("qid", "id", F.lit(1).alias("found"))
    exact = checkpointed(search.vector_topk_many(v, asked, K))
    recall = exact.join(near, ["qid", "id"], "left").agg((F.avg(F.coalesce("found", F.lit(0))) >= 0.9).alias("recalled"))
    return exact.crossJoin(F.broadcast(recall)).select("qid", "id", "similarity", "rank", "recalled")


def _cosine_sql(where: str = "", k: int = K) -> str:
    return f"""SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) AS similarity
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {QUESTION_ID}) q {where} ORDER BY similarity DESC, id LIMIT {k}"""


MANY_SQL = """SELECT qid, id, similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM (
    SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) AS similarity
    FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 5"""

# --- keywords and fusion ----------------------------------------------------------------------------------------------


def keyword_search(spark, sf_dir):
    return search.keyword_search(chunks(spark, sf_dir), KEYWORDS, 20)


def keyword_indexed(spark, sf_dir):
    """The same by an index of character grams."""
    index = GramIndex(spark, scratch(spark, "grams"))
    index.add(chunks(spark, sf_dir))
    return index.keyword_search(KEYWORDS, 20)


def keyword_language(spark, sf_dir):
    return search.keyword_search(chunks(spark, sf_dir).filter("language = 'de'"), KEYWORDS, 20)


def keyword_documentation_only(spark, sf_dir):
    """A word that only the documentation has: rows use the places, and are then left out."""
    return search.keyword_search(chunks(spark, sf_dir), ["fr"], 20, positive=False)


def hybrid_rrf(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return search.hybrid_search(v, chunks(spark, sf_dir), question(v), KEYWORDS, 20)


def rrf_boosted(spark, sf_dir):
    fused = hybrid_rrf(spark, sf_dir)
    # the few results are what is broadcast; documents are read past them
    named = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang").join(F.broadcast(fused.select("id")), "id", "left_semi")
    fused = fused.join(F.broadcast(named), "id", "left")
    return search.boost(fused, F.coalesce(F.col("lang") == "en", F.lit(False))).select("id", "score", "rank")


def rrf_pinned(spark, sf_dir):
    pinned = chunks(spark, sf_dir).filter(F.col("file_path") == PREFIX).orderBy("id").limit(2)
    return search.pin(hybrid_rrf(spark, sf_dir), pinned)


def _keyword_sql(keywords: list[str], where: str = "", k: int = 20, positive: bool = True) -> str:
    texts = ("text", "source", "''", "lang")
    hit = lambda c, w: f"contains(lower(coalesce({c}, '')), '{w}')"
    score = " + ".join(f"CASE WHEN {hit(c, w)} THEN {n} ELSE 0 END" for w in keywords for c, n in zip(texts, (1, 2, 2), strict=False))
    found = " OR ".join(hit(c, w) for w in keywords for c in texts)
    inner = f"SELECT doc_id AS id, round(({score})::double / (5.0 * {len(keywords)})::double, 6) AS relevance FROM documents WHERE ({found}) {where} ORDER BY relevance DESC, id LIMIT {k}"
    return f"SELECT * FROM ({inner}) WHERE relevance > 0" if positive else inner


RRF_SQL = f"""WITH sem AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS sr FROM ({_cosine_sql(k=40)})),
kw AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, id) AS kr FROM ({_keyword_sql(KEYWORDS)})),
f AS (SELECT coalesce(sem.id, kw.id) AS id, sr, kr, coalesce(1.0::double / (60 + sr), 0) + coalesce(1.1::double / (60 + kr), 0) AS rrf FROM sem FULL OUTER JOIN kw ON sem.id = kw.id),
t AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, sr NULLS LAST, kr NULLS LAST, id) AS rank FROM f)
SELECT id, round(rrf / max(rrf) OVER (), 6) AS score, rank FROM t WHERE rank <= 20"""
BOOSTED_SQL = f"""WITH r AS (SELECT r.*, coalesce(lang = 'en', false) AS b FROM ({RRF_SQL}) r LEFT JOIN documents ON doc_id = id)
SELECT id, CASE WHEN b THEN least(1.0::double, round(score * 2, 6)) ELSE score END AS score, row_number() OVER (ORDER BY b DESC, rank) AS rank FROM r"""
PINNED_SQL = f"""WITH p AS (SELECT doc_id AS id FROM documents WHERE source = '{PREFIX}' ORDER BY id LIMIT 2),
u AS (SELECT id, 1.0::double AS score, 0 AS rank FROM p UNION ALL SELECT id, score, rank FROM ({RRF_SQL}) r WHERE id NOT IN (SELECT id FROM p))
SELECT id, score, row_number() OVER (ORDER BY rank, id) AS rank FROM u"""

# --- references and dependencies ---------------------------------------------------------------------------------------


def references_count(spark, sf_dir):
    return references(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


def reference_search(spark, sf_dir):
    return search.reference_search(references(spark, sf_dir), "The", 25)


def known_classes_of(spark, sf_dir):
    """References of each document that are known classes, sorted."""
    known = references(spark, sf_dir).join(classes(spark, sf_dir), "name", "left_semi")
    return known.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def dependency_expand(spark, sf_dir):
    """Only the texts of the few sources are searched for their references."""
    sources = checkpointed(search.ranked(keyword_search(spark, sf_dir), "relevance").select("id", "rank"))
    own = table(spark, sf_dir, "documents").join(F.broadcast(sources.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    return search.dependencies(sources, references(spark, sf_dir, own), classes(spark, sf_dir))


def dependency_hops(spark, sf_dir):
    """Classes that documents lead to within three references, with the fewest hops, from those whose id is divisible by 50."""
    edges = references(spark, sf_dir).join(classes(spark, sf_dir), "name").select(F.col("id").alias("source"), F.col("class_id").alias("target"))
    starts = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("start"))
    return graph.reachable(edges, starts, 3).withColumn("depth", F.col("depth").cast("long"))


def class_context(spark, sf_dir):
    known = checkpointed(classes(spark, sf_dir))
    name = known.orderBy("class_id", "name").first()["name"]
    return search.class_context(name, checkpointed(references(spark, sf_dir)), known)


def context_build(spark, sf_dir):
    top = search.ranked(keyword_search(spark, sf_dir), "relevance").filter("rank <= 5")
    rows = top.join(chunks(spark, sf_dir), "id")
    return search.context(rows, F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "file_path", F.lit(" ("), F.format_string("%.3f", "relevance"), F.lit(")\n"), F.substring("content", 1, 500)))


REFS_SQL = """SELECT doc_id AS id, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS pos FROM (
  SELECT doc_id, list_filter(list_transform(w, lambda x, i: CASE WHEN list_position(w, x) = i THEN x END), lambda x: x IS NOT NULL) AS names FROM (
    SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+'), lambda x: regexp_matches(x, '^[A-Z][a-zA-Z0-9]*$')) AS w FROM documents))"""
CLASSES_SQL = f"SELECT name, min(id) AS class_id FROM ({REFS_SQL}) WHERE pos = 0 AND length(name) > 3 GROUP BY name"
REFERENCE_SQL = f"SELECT DISTINCT id FROM ({REFS_SQL}) WHERE name = 'The' ORDER BY id LIMIT 25"
DEPENDENCY_SQL = f"""WITH s AS (SELECT id, row_number() OVER (ORDER BY relevance DESC, id) AS rank FROM ({_keyword_sql(KEYWORDS)})),
f AS (SELECT c.class_id, s.rank, r.pos FROM ({REFS_SQL}) r JOIN s ON r.id = s.id JOIN ({CLASSES_SQL}) c ON c.name = r.name WHERE r.pos < 3 AND c.class_id NOT IN (SELECT id FROM s))
SELECT class_id, rank AS source_rank, pos FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY rank, pos) AS n FROM f) WHERE n = 1"""
CONTEXT_SQL = f"""WITH c AS ({CLASSES_SQL}), r AS ({REFS_SQL}), own AS (SELECT name, class_id AS id FROM c ORDER BY class_id, name LIMIT 1)
SELECT id, 'self' AS leg FROM own
UNION ALL SELECT c.class_id, 'referenced' FROM r JOIN own ON r.id = own.id JOIN c ON c.name = r.name WHERE r.pos < 5
UNION ALL (SELECT DISTINCT r.id, 'referencing' FROM r, own WHERE r.name = own.name AND r.id <> own.id ORDER BY 1 LIMIT 5)"""
BUILD_SQL = f"""SELECT string_agg('[' || rank || '] ' || source || ' (' || printf('%.3f', relevance) || ')' || chr(10) || left(text, 500), chr(10) || chr(10) ORDER BY rank) AS context
FROM (SELECT *, row_number() OVER (ORDER BY relevance DESC, id) AS rank FROM ({_keyword_sql(KEYWORDS)})) JOIN documents ON doc_id = id WHERE rank <= 5"""

# --- the table ----------------------------------------------------------------------------------------------------------


def stats_combined(spark, sf_dir):
    return store.stats(table(spark, sf_dir, "documents"), "lang", "source", distinct="source")


def stats_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def stats_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def stats_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("files"), F.count_if(F.col("lang") == "en").alias("english"))


def list_sorted(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source", "doc_id").orderBy("lang", "source", "doc_id")


def chunks_of_group(spark, sf_dir):
    return store.chunks_of_class(chunks(spark, sf_dir).withColumn("start_line", F.col("id")), PREFIX).select("id", "language", F.col("start_line").alias("line"))


def names_by_language(spark, sf_dir):
    found = store.names_by(chunks(spark, sf_dir).withColumn("class_name", F.concat_ws("/", "class_name", "id")), "language")
    return found.select("group", "n", F.array_join("first", ",").alias("first"))


def chunks_like(spark, sf_dir):
    """Documents with "rc1" in their source; the language stands for the type, and the metadata name the source as parent."""
    rows = chunks(spark, sf_dir).withColumn("chunk_type", F.col("language")).withColumn("metadata", F.to_json(F.struct(F.col("file_path").alias("parent_class"))))
    return store.chunks_like(rows, "rc1").select("id", "chunk_type", "size", "parent_class")


def prefix_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.startswith("source", F.lit(PREFIX))).select("doc_id", "source")


def delete_by_prefix(spark, sf_dir):
    return store.delete_by_prefix(table(spark, sf_dir, "documents"), PREFIX, "source").select("doc_id", "source")


def delete_by_file(spark, sf_dir):
    return store.delete_by_file(table(spark, sf_dir, "documents"), PREFIX, "source").select("doc_id", "source")


def upsert_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    old = docs.filter("lang <> 'fr'")
    again = docs.filter("lang IN ('en', 'fr')")
    new = again.withColumn("seq", F.lit(1)).unionByName(again.filter("n_chars % 2 = 0").withColumn("source", F.lit("late")).withColumn("seq", F.lit(2)))
    return store.upsert(old, new, created=None)


def _as_chunks(spark, sf_dir) -> DataFrame:
    whole = chunks(spark, sf_dir)
    kinds = dict(x.split(" ") for x in store.CHUNK_SCHEMA.split(", "))
    whole = whole.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in whole.columns})
    return whole.withColumns({"id": F.col("id").cast("string"), "chunk_type": F.lit("document"), "seq": F.lit(1), "number": F.col("id")})


def stats_sketched(spark, sf_dir):
    """Different files and documents of a store by language, each document a class of its own, from sketches of two changes:
    whether they are within a twentieth of the exact numbers."""
    whole = _as_chunks(spark, sf_dir).withColumn("class_name", F.concat(F.lit("Doc"), "id"))
    kept = store.ChunkStore(spark, scratch(spark, "chunks"))
    kept.create()
    kept.upsert(whole.filter("number % 3 <> 0").drop("number"))
    kept.upsert(whole.filter("number % 3 = 0").drop("number"))
    exact = whole.groupBy("language").agg(F.count_distinct("file_path").alias("files"), F.count_distinct("class_name").alias("classes"))
    near = lambda c, n: (F.abs(F.col(c) - F.col(n)) <= 0.05 * F.col(n)).alias(f"{n}_near")
    return exact.join(kept.distinct("language"), "language").select("language", "files", "classes", near("file_path", "files"), near("class_name", "classes"))


def store_changes(spark, sf_dir):
    """Documents in a store through a stack of changes: most of them, then every fifth anew or for the first time, without one
    group of sources; and what is left after folding."""
    whole = _as_chunks(spark, sf_dir)
    kept = store.ChunkStore(spark, scratch(spark, "chunks"))
    kept.create()
    kept.upsert(whole.filter("number % 10 <> 0").drop("number"))
    kept.upsert(whole.filter("number % 5 = 0").withColumn("content", F.concat(F.lit("again "), "content")).drop("number"))
    kept.delete_by_prefix(PREFIX)
    kept.compact()
    return kept.read().select("id", "language", "file_path", F.sha2("content", 256).alias("content_sha256"))


STORE_SQL = f"""SELECT CAST(doc_id AS VARCHAR) AS id, lang AS language, source AS file_path, sha256(CASE WHEN doc_id % 5 = 0 THEN 'again ' || text ELSE text END) AS content_sha256
FROM documents WHERE NOT starts_with(source, '{PREFIX}')"""
UPSERT_SQL = """SELECT doc_id AS id, lang, CASE WHEN lang IN ('en', 'fr') AND n_chars % 2 = 0 THEN 'late' ELSE source END AS source, n_chars FROM documents"""
STATS_SQL = """SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'total' END AS "grouping", coalesce(lang, source) AS value, count(*) AS n, count(DISTINCT source) AS files
FROM documents GROUP BY GROUPING SETS ((lang), (source), ())"""

HOPS_SQL = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT r.id AS source, c.class_id AS target FROM ({REFS_SQL}) r JOIN ({CLASSES_SQL}) c USING (name) WHERE r.id <> c.class_id),
h AS (
  SELECT doc_id AS start, doc_id AS node, 0 AS depth FROM documents WHERE doc_id % 50 = 0
  UNION SELECT h.start, e.target, h.depth + 1 FROM h JOIN e ON e.source = h.node WHERE h.depth < 3
) SELECT start, node, min(depth)::bigint AS depth FROM h GROUP BY start, node"""

QUERIES = {f.__name__: f for f in (
    vector_topk, vector_topk_label, vector_threshold, vector_topk_many, vector_language, ann_cells, ann_stored, keyword_search, keyword_indexed, keyword_language, keyword_documentation_only,
    hybrid_rrf, rrf_boosted, rrf_pinned, references_count, reference_search, known_classes_of, dependency_expand, dependency_hops, class_context, context_build,
    stats_combined, stats_language, stats_source, stats_distinct, stats_sketched, list_sorted, chunks_of_group, names_by_language, chunks_like, prefix_filter, delete_by_prefix, delete_by_file, upsert_merge, store_changes,
)}

ORACLES = {
    "vector_topk": _cosine_sql(),
    "vector_topk_label": _cosine_sql("WHERE e.label = 1"),
    "vector_threshold": f"SELECT * FROM ({_cosine_sql(k=50)}) WHERE similarity >= 0.3",
    "vector_topk_many": MANY_SQL,
    "vector_language": _cosine_sql("WHERE e.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"),
    "ann_stored": f"SELECT *, true AS recalled FROM ({MANY_SQL.replace('rank <= 5', f'rank <= {K}')})",
    "keyword_search": _keyword_sql(KEYWORDS),
    "keyword_indexed": _keyword_sql(KEYWORDS),
    "keyword_language": _keyword_sql(KEYWORDS, "AND lang = 'de'"),
    "keyword_documentation_only": _keyword_sql(["fr"], positive=False),
    "hybrid_rrf": RRF_SQL,
    "rrf_boosted": BOOSTED_SQL,
    "rrf_pinned": PINNED_SQL,
    "references_count": f"SELECT name, count(*) AS n FROM ({REFS_SQL}) GROUP BY name HAVING count(*) >= 3",
    "reference_search": REFERENCE_SQL,
    "known_classes_of": f"SELECT id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM ({REFS_SQL}) WHERE name IN (SELECT name FROM ({CLASSES_SQL})) GROUP BY id",
    "dependency_expand": DEPENDENCY_SQL,
    "dependency_hops": HOPS_SQL,
    "class_context": CONTEXT_SQL,
    "context_build": BUILD_SQL,
    "stats_combined": STATS_SQL,
    "stats_language": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "stats_source": "SELECT source, count(*) AS n FROM documents GROUP BY source",
    "stats_distinct": "SELECT count(*) AS n, count(DISTINCT source) AS files, count(*) FILTER (WHERE lang = 'en') AS english FROM documents",
    "stats_sketched": "SELECT lang AS language, count(DISTINCT source) AS files, count(DISTINCT doc_id) AS classes, true AS files_near, true AS classes_near FROM documents GROUP BY lang",
    "list_sorted": "SELECT lang, source, doc_id FROM documents ORDER BY ALL",
    "chunks_of_group": f"SELECT doc_id AS id, lang AS language, doc_id AS line FROM documents WHERE source = '{PREFIX}'",
    "names_by_language": """SELECT "group", max(total) AS n, string_agg(name, ',' ORDER BY place) AS first FROM (
  SELECT lang AS "group", source || '/' || doc_id AS name, row_number() OVER (PARTITION BY lang ORDER BY source || '/' || doc_id, doc_id) AS place, count(*) OVER (PARTITION BY lang) AS total FROM documents) WHERE place <= 100 GROUP BY "group\"""",
    "chunks_like": "SELECT doc_id AS id, lang AS chunk_type, length(text) AS size, source AS parent_class FROM documents WHERE contains(source, 'rc1') ORDER BY lang, source, doc_id LIMIT 50",
    "prefix_filter": f"SELECT doc_id, source FROM documents WHERE starts_with(source, '{PREFIX}')",
    "delete_by_prefix": f"SELECT doc_id, source FROM documents WHERE NOT starts_with(source, '{PREFIX}')",
    "delete_by_file": f"SELECT doc_id, source FROM documents WHERE source <> '{PREFIX}'",
    "upsert_merge": UPSERT_SQL,
    "store_changes": STORE_SQL,
}
