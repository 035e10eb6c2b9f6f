"""Queries over source files. Each document becomes a Java file, a Python file, a JSON template and a Markdown file by
expressions over its columns, so the operators read the whole table; twins in SQL say what they have to find there.

Java: a class with two fields, and a method for each line of the text, which holds it as a comment. Python: a class, and a
function with the lines as comments. Templates name two classes; every seventh is named like a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import splitlines
from tessera.operators import chunking, code, sql, strategies, training
from tessera.plans.corpus import LINES
from tessera.plans.retrieval import table
from tessera.session import checkpointed
from tessera.sources import files

#: A template that is paired by hand, and its class.
MANUAL = ("Doc3", "t10")


def _docs(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("lines", splitlines(F.col("text")))


def _id(divisor: int = 1) -> Column:
    return F.floor(F.col("doc_id") / divisor).cast("long").cast("string")


def _java_files(spark, sf_dir) -> DataFrame:
    extends = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" extends Doc"), _id(2))).otherwise("")
    implements = F.when(F.col("lang") == "en", " implements Readable").otherwise("")
    methods = F.transform("lines", lambda x, i: F.concat(F.lit("\n    public int m"), (i + 1).cast("string"), F.lit("(String text) {\n        // "), x, F.lit("\n        return "), (i + 1).cast("string"), F.lit(";\n    }\n")))
    text = F.concat(
        F.lit("package docs."), "source", F.lit(";\n\nimport docs.common.Doc"), _id(5), F.lit(";\n\n/** Document "), _id(), F.lit(". */\npublic class Doc"), _id(), extends, implements, F.lit(" {\n    private int size = "),
        F.col("n_chars").cast("string"), F.lit(";\n    private Doc"), _id(3), F.lit(" other;\n"), F.array_join(methods, ""), F.lit("}\n"),
    )
    return _docs(spark, sf_dir).select(F.concat(F.lit("java/Doc"), _id(), F.lit(".java")).alias("path"), text.alias("text"))


def _java(spark, sf_dir, texts: bool = True, **bounds):
    return code.java_types(_java_files(spark, sf_dir), texts=texts, **bounds)


def _other(spark, sf_dir) -> DataFrame:
    comments = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("    # "), x, F.lit("\n"))), "")
    text = F.concat(F.lit("class Doc"), _id(), F.lit(":\n    def size(self):\n        return "), F.col("n_chars").cast("string"), F.lit("\n\n\ndef main_"), _id(), F.lit("():\n"), comments, F.lit("    return 0\n"))
    return _docs(spark, sf_dir).select(F.concat(F.lit("tools/doc"), _id(), F.lit(".py")).alias("path"), text.alias("text"), F.lit("python").alias("language"))


def _templates(spark, sf_dir) -> DataFrame:
    name = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Doc"), _id())).otherwise(F.concat(F.lit("t"), _id()))
    text = F.concat(F.lit('{"Doc'), _id(2), F.lit('": {"use": "Doc'), _id(), F.lit('", "n": '), F.col("n_chars").cast("string"), F.lit('}, "lang": ["'), "lang", F.lit('"]}'))
    return _docs(spark, sf_dir).select(F.concat(F.lit("templates/"), name, F.lit(".json")).alias("path"), text.alias("text"), name.alias("template"))


def java_types(spark, sf_dir):
    return _java(spark, sf_dir, texts=False).select("path", "name", "class_type", "depth", "extends", F.array_join("implements", ",").alias("implements"), F.array_join("modifiers", " ").alias("modifiers"), F.size("fields").cast("long").alias("n_fields"), F.size("methods").cast("long").alias("n_methods"), "start_line", "end_line")


def sql_java_types(spark, sf_dir):
    """The rows of java_types and their ids, by one SQL text with a lateral call."""
    sql.register(spark)
    return spark.sql(
        """SELECT f.path, t.name, t.class_type, t.depth, t.extends, array_join(t.implements, ',') AS implements, CAST(size(t.methods) AS BIGINT) AS n_methods, t.start_line, t.end_line,
  chunk_key(f.path, t.name, 'class') AS id, plain_type(t.fields[1].type) AS second_type FROM {files} f, LATERAL java_types(f.text) t""",
        files=_java_files(spark, sf_dir),
    )


def java_methods(spark, sf_dir):
    return code.java_methods(_java(spark, sf_dir)).select("path", "class_name", "name", "return_type", F.size("parameters").cast("long").alias("n_parameters"), "start_line", "end_line", F.sha2("body", 256).alias("body_sha256"))


def java_references(spark, sf_dir):
    return code.known_references(_java(spark, sf_dir, texts=False, max_lines=None)).select("path", "number", F.array_join("references", ",").alias("references"))


def java_chunks(spark, sf_dir):
    return code.java_chunks(_java(spark, sf_dir), bare=_java(spark, sf_dir, texts=False)).select("id", "chunk_type", "class_name", "method_name", "start_line", "end_line", F.array_join("references", ",").alias("references"))


def generic_blocks(spark, sf_dir):
    return code.generic_blocks(_other(spark, sf_dir)).select("path", "code_type", "name", "start_line", "end_line", F.sha2("source", 256).alias("source_sha256"))


def block_chunks(spark, sf_dir):
    return code.block_chunks(code.generic_blocks(_other(spark, sf_dir), max_lines=None)).select("id", "file_path", "chunk_type", F.array_join("references", ",").alias("references"))


def markdown_sections(spark, sf_dir):
    marked = F.transform("lines", lambda x: F.when(x.rlike("^[A-Z][^ ]*[.]$"), F.concat(F.lit("## "), x)).otherwise(x))
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("# Document\n\n"), F.array_join(marked, "\n")).alias("text"))
    out = chunking.sections(docs, F.col("doc_id"), F.col("text"), chunking.markdown_header)
    return out.select("key", "section", "title", "start_line", F.sha2("content", 256).alias("content_sha256"))


def template_chunks(spark, sf_dir):
    return chunking.template_chunks(_templates(spark, sf_dir), most=0).select("id", "path", "chunk_type", "section", F.array_join("keys", ",").alias("keys"))


def template_references(spark, sf_dir):
    return files.template_references(_templates(spark, sf_dir))


def template_of_class(spark, sf_dir):
    return files.template_of_class(_templates(spark, sf_dir))


def _outer(spark, sf_dir, **bounds) -> DataFrame:
    """Names of the outer classes, kept: the files are scanned once, however often the names are joined."""
    return checkpointed(code.outer_types(_java_files(spark, sf_dir), **bounds).select("name"))


def _matched(spark, sf_dir, names: DataFrame) -> DataFrame:
    templates = _templates(spark, sf_dir)
    manual = spark.createDataFrame([MANUAL], "name string, template string")
    return training.tiered_match(names, templates.select("template"), files.template_references(templates), manual)


def tiered_match(spark, sf_dir):
    return _matched(spark, sf_dir, _outer(spark, sf_dir))


def tier_counts(spark, sf_dir):
    return training.tier_counts(_matched(spark, sf_dir, _outer(spark, sf_dir, max_lines=None)))


def unpaired_classes(spark, sf_dir):
    names = _outer(spark, sf_dir)
    return names.join(_matched(spark, sf_dir, names), "name", "left_anti")


def _examples(name: str):
    def query(spark, sf_dir):
        return strategies.convert(_java(spark, sf_dir).filter("parent = -1"), name).select("id", "name", "part", F.sha2("line", 256).alias("line_sha256"))

    query.__name__ = f"strategy_{name}"
    return query


QUERIES = {f.__name__: f for f in (
    java_types, sql_java_types, java_methods, java_references, java_chunks, generic_blocks, block_chunks, markdown_sections, template_chunks, template_references, template_of_class,
    tiered_match, tier_counts, unpaired_classes, *(_examples(s) for s in strategies.STRATEGIES),
)}

# --- SQL twins -----------------------------------------------------------------------------------------------------------

DOCS = f"(SELECT doc_id, lang, source, coalesce(n_chars, 0) AS n_chars, CASE WHEN coalesce(text, '') = '' THEN []::varchar[] ELSE {LINES} END AS lines FROM documents)"
#: Files of any length.
WHOLE_JAVA = f"(SELECT *, 'java/Doc' || doc_id || '.java' AS path, 'Doc' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 'Doc' || doc_id // 2 END AS ext FROM {DOCS})"
#: Files of more lines are left out.
JAVA = f"{WHOLE_JAVA[:-1]} WHERE 9 + 5 * len(lines) <= 10000)"
METHODS = f"(SELECT *, 10 + 5 * (i - 1) AS place, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM {JAVA}))"
JAVA_REFS = f"""(SELECT path, string_agg(DISTINCT r, ',' ORDER BY r) AS refs FROM (
  SELECT path, name, unnest([ext, 'Doc' || doc_id // 3, 'Doc' || doc_id // 5]) AS r FROM {JAVA}) WHERE r <> name AND r IN (SELECT name FROM {JAVA}) GROUP BY path)"""
BODY = "'    public int m' || i || '(String text) {' || chr(10) || '        // ' || line || chr(10) || '        return ' || i || ';' || chr(10) || '    }'"
#: Files of any length; PYTHON is those that are not too long.
WHOLE_PYTHON = f"""(SELECT *, 'tools/doc' || doc_id || '.py' AS path, 'class Doc' || doc_id || ':' || chr(10) || '    def size(self):' || chr(10) || '        return ' || n_chars || chr(10) || chr(10) AS head,
  'def main_' || doc_id || '():' || chr(10) || array_to_string(list_transform(list_append(lines, NULL), lambda x: CASE WHEN x IS NULL THEN '    return 0' ELSE '    # ' || x END), chr(10)) AS tail
  FROM {DOCS})"""
PYTHON = f"{WHOLE_PYTHON[:-1]} WHERE 7 + len(lines) <= 500)"
BLOCKS = f"""(SELECT path, 'module' AS code_type, 'doc' || doc_id AS name, 1 AS start_line, 7 + len(lines) AS end_line, head || chr(10) || tail || chr(10) AS source FROM {PYTHON}
  UNION ALL SELECT path, 'class', 'Doc' || doc_id, 1, 5, head FROM {PYTHON}
  UNION ALL SELECT path, 'function', 'main_' || doc_id, 6, 7 + len(lines), tail FROM {PYTHON})"""
TEMPLATE = "CASE WHEN doc_id % 7 = 0 THEN 'Doc' ELSE 't' END || doc_id"
NAMED = f"(SELECT {TEMPLATE} AS template, unnest(['Doc' || doc_id // 2, 'Doc' || doc_id]) AS name, unnest([0, 1]) AS pos FROM documents)"
#: The last tier: templates choose one by one, in their order, the first class they name that nobody has.
MATCH_SQL = f"""WITH RECURSIVE c AS MATERIALIZED (SELECT name FROM {JAVA}), t AS MATERIALIZED (SELECT {TEMPLATE} AS template FROM documents),
m AS MATERIALIZED (SELECT '{MANUAL[0]}' AS name, '{MANUAL[1]}' AS template, 'manual' AS tier WHERE '{MANUAL[0]}' IN (SELECT name FROM c) AND '{MANUAL[1]}' IN (SELECT template FROM t)),
e AS MATERIALIZED (SELECT c.name, t.template, 'exact' AS tier FROM c JOIN t ON t.template = c.name WHERE t.template NOT IN (SELECT template FROM m)),
p AS MATERIALIZED (SELECT * FROM m UNION ALL SELECT * FROM e),
o AS MATERIALIZED (SELECT template, names, row_number() OVER (ORDER BY template) AS n FROM (
  SELECT template, list(name ORDER BY pos) AS names FROM {NAMED} WHERE name IN (SELECT name FROM c) AND name NOT IN (SELECT name FROM p) AND template NOT IN (SELECT template FROM p) GROUP BY template)),
g AS (
  SELECT 0::bigint AS n, []::varchar[] AS taken, NULL::varchar AS name, NULL::varchar AS template
  UNION ALL
  SELECT o.n, CASE WHEN x.name IS NULL THEN g.taken ELSE list_append(g.taken, x.name) END, x.name, o.template
  FROM g JOIN o ON o.n = g.n + 1, LATERAL (SELECT list_filter(o.names, lambda y: NOT list_contains(g.taken, y))[1] AS name) x
)
SELECT * FROM p UNION ALL SELECT name, template, 'reference' AS tier FROM g WHERE name IS NOT NULL"""
ID = "left(sha256(path || ':' || {} || ':' || {}), 16)"
MARKED = f"(SELECT doc_id AS key, list_concat(['# Document', ''], list_transform(lines, lambda x: CASE WHEN regexp_matches(x, '^[A-Z][^ ]*[.]$') THEN '## ' || x ELSE x END)) AS lines FROM {DOCS})"
#: A last empty line is no line once the lines are joined.
CUT = f"(SELECT key, CASE WHEN lines[-1] = '' THEN lines[:-2] ELSE lines END AS lines FROM {MARKED})"

ORACLES: dict = {
    "java_types": f"SELECT path, name, 'class' AS class_type, 0 AS depth, ext AS extends, CASE WHEN lang = 'en' THEN 'Readable' ELSE '' END AS implements, 'public' AS modifiers, 2 AS n_fields, len(lines) AS n_methods, 6 AS start_line, 9 + 5 * len(lines) AS end_line FROM {JAVA}",
    "sql_java_types": f"SELECT path, name, 'class' AS class_type, 0 AS depth, ext AS extends, CASE WHEN lang = 'en' THEN 'Readable' ELSE '' END AS implements, len(lines) AS n_methods, 6 AS start_line, 9 + 5 * len(lines) AS end_line, left(sha256(path || ':' || name || ':class'), 16) AS id, 'Doc' || doc_id // 3 AS second_type FROM {JAVA}",
    "java_methods": f"SELECT path, name AS class_name, 'm' || i AS name, 'int' AS return_type, 1 AS n_parameters, place AS start_line, place + 3 AS end_line, sha256({BODY}) AS body_sha256 FROM {METHODS}",
    "java_references": f"SELECT path, 0 AS number, refs AS references FROM {JAVA_REFS.replace(JAVA, WHOLE_JAVA)}",
    "java_chunks": f"""SELECT {ID.format("name", "'class'")} AS id, 'class' AS chunk_type, name AS class_name, NULL AS method_name, 6 AS start_line, 9 + 5 * len(lines) AS end_line, coalesce(refs, '') AS references FROM {JAVA} LEFT JOIN {JAVA_REFS} USING (path)
UNION ALL SELECT {ID.format("name || '.m' || i", "'method'")}, 'method', name, 'm' || i, place, place + 3, '' FROM {METHODS}""",
    "generic_blocks": f"SELECT path, code_type, name, start_line, end_line, sha256(source) AS source_sha256 FROM {BLOCKS}",
    "block_chunks": f"""SELECT {ID.format("name", "code_type")} AS id, path AS file_path, code_type AS chunk_type, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(source, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Z][a-zA-Z0-9]*$')))), ',') AS references FROM {BLOCKS.replace(PYTHON, WHOLE_PYTHON)}""",
    "markdown_sections": f"""WITH x AS (SELECT key, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM {CUT}),
s AS (SELECT *, starts_with(line, '#') AS head, sum(starts_with(line, '#')::int) OVER (PARTITION BY key ORDER BY pos) AS section FROM x)
SELECT key, section::bigint AS section, coalesce(max(CASE WHEN head AND first THEN trim(regexp_replace(line, '^#+', '')) END), '') AS title, min(pos) AS start_line, sha256(string_agg(line, chr(10) ORDER BY pos)) AS content_sha256
FROM (SELECT *, pos = min(pos) OVER (PARTITION BY key, section) AS first FROM s) GROUP BY key, section""",
    "template_chunks": f"""WITH t AS (SELECT 'templates/' || template || '.json' AS path, * FROM (SELECT {TEMPLATE} AS template, ['Doc' || doc_id // 2, 'lang'] AS ks FROM documents))
SELECT {ID.format("template", "'template'")} AS id, path, 'template' AS chunk_type, NULL AS section, array_to_string(ks, ',') AS keys FROM t
UNION ALL SELECT {ID.format("template || '.' || section", "'template_section'")}, path, 'template_section', section, section FROM (SELECT path, template, unnest(ks) AS section FROM t)""",
    "template_references": f"SELECT template, pos, name FROM {NAMED}",
    "template_of_class": f"SELECT name, min('templates/' || template || '.json') AS path FROM {NAMED} GROUP BY name",
    "tiered_match": MATCH_SQL,
    "tier_counts": f"SELECT t.tier, count(m.tier) AS n FROM (VALUES ('manual'), ('exact'), ('reference')) t(tier) LEFT JOIN ({MATCH_SQL.replace(JAVA, WHOLE_JAVA)}) m ON m.tier = t.tier GROUP BY t.tier",
    "unpaired_classes": f"SELECT name FROM {JAVA} WHERE name NOT IN (SELECT name FROM ({MATCH_SQL}))",
}
