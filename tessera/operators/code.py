"""Source code: declarations, blocks, chunks and references between classes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import java
from tessera.functions import values as V
from tessera.functions.text import base_type, chunk_id, pascal_names, splitlines, strings
from tessera.operators.chunking import truncated
from tessera.session import bounded, checkpointed

METHOD = "struct<name:string,return_type:string,parameters:array<struct<type:string,name:string>>,modifiers:array<string>,annotations:array<string>,documentation:string,body:string,start_line:int,end_line:int>"
TYPES = (
    "path string, number int, parent int, depth int, name string, class_type string, package string, imports array<string>, modifiers array<string>, annotations array<string>, extends string, "
    f"implements array<string>, documentation string, source_code string, start_line int, end_line int, problems int, fields array<struct<name:string,type:string,modifiers:array<string>>>, methods array<{METHOD}>"
)

#: Characters of files whose types are made in one step; a longer file is a step of its own.
STEP_CHARS = 1_000_000

# Imports of these packages are no references.
LIBRARIES = ["java.", "javax.", "org.springframework.", "com.google.", "org.apache.", "org.slf4j.", "lombok.", "org.junit."]
# Types that are no references.
COMMON_TYPES = (
    "String Integer Long Double Float Boolean Byte Short Character Object Class Void List ArrayList LinkedList Set HashSet TreeSet Map HashMap TreeMap "
    "LinkedHashMap Collection Optional Stream Collectors Arrays Collections Exception RuntimeException Throwable Error"
).split()

# How blocks begin, by language.
BLOCKS = {
    "python": {"class": r"^class\s+(\w+).*?:", "function": r"^def\s+(\w+)\s*\("},
    "javascript": {
        "class": r"^(?:export\s+)?class\s+(\w+)", "function": r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)",
        "arrow": r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(",
    },
    "typescript": {
        "class": r"^(?:export\s+)?class\s+(\w+)", "function": r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)",
        "interface": r"^(?:export\s+)?interface\s+(\w+)", "type": r"^(?:export\s+)?type\s+(\w+)",
    },
    "go": {
        "function": r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(", "struct": r"^type\s+(\w+)\s+struct\s*\{", "interface": r"^type\s+(\w+)\s+interface\s*\{",
    },
}


def _steps(column: Iterable[str], contents: Iterable[str | None], max_lines: int | None) -> Iterator[tuple[list[str], list[str]]]:
    """Paths and texts of the files that are not longer (None: of all), about STEP_CHARS at a time. Lines are counted here (Python's are those
    of ``splitlines``): a filter of Spark would make a text that is an expression once more for each place that has it."""
    paths, texts, size = [], [], 0
    for path, text in zip(column, contents, strict=True):
        if text is None or (max_lines is not None and len(text.splitlines()) > max_lines):
            continue
        paths.append(path)
        texts.append(text)
        size += len(text)
        if size >= STEP_CHARS:
            yield paths, texts
            paths, texts, size = [], [], 0
    if paths:
        yield paths, texts


def java_types(files: DataFrame, max_lines: int | None = 10_000, include_private: bool = True, include_comments: bool = True, include_imports: bool = True, texts: bool = True) -> DataFrame:
    """files: path, text. All types of each file; inner ones have the number of their parent. Longer files are left out (None: none is). Without
    comments there is no documentation of types and methods, without imports their list is empty; without texts there is no
    documentation either, and no code of types and methods: much less to move for who needs names, types and places alone.

    The scanner reads declarations by their marks and braces, so a file with a syntax error still gives the types around it;
    ``problems`` counts the braces of the file that had to be taken for strays or for missing. Types are sent on by STEP_CHARS
    of files, so memory does not follow the number of files in a batch."""
    names = StructType.fromDDL(TYPES).names

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for paths, sources in _steps(b["path"], b["text"], max_lines):
                yield pd.DataFrame([{"path": p, "number": i, **t} for p, text in zip(paths, sources, strict=True) for i, t in enumerate(java.types_of(text, texts))], columns=names)

    found = files.select("path", "text").mapInPandas(extract, TYPES)
    if not include_comments:
        bare = F.transform("methods", lambda m: m.withField("documentation", F.lit(None).cast("string")))
        found = found.withColumn("documentation", F.lit(None).cast("string")).withColumn("methods", bare)
    if not include_imports:
        found = found.withColumn("imports", F.array().cast("array<string>"))
    if include_private:
        return found
    public = lambda c: F.filter(c, lambda x: ~F.array_contains(x["modifiers"], "private"))
    return found.filter(~F.array_contains("modifiers", "private")).withColumn("fields", public("fields")).withColumn("methods", public("methods"))


def outer_types(files: DataFrame, max_lines: int | None = 10_000) -> DataFrame:
    """path, name of the types of ``java_types`` that are in no other one, without a look inside of them. None: files of any length."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for paths, sources in _steps(*(c.to_pylist() for c in b.columns), max_lines):
                rows = [(p, name) for p, text in zip(paths, sources, strict=True) for name in java.outer_names(text)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["path", "name"])

    return files.select("path", "text").mapInArrow(extract, "path string, name string")


def java_methods(types: DataFrame) -> DataFrame:
    return types.select("path", F.col("name").alias("class_name"), "package", F.explode("methods").alias("m")).select("path", "class_name", "package", "m.*")


def signature(m: Column) -> Column:
    params = F.array_join(F.transform(m["parameters"], lambda p: F.concat_ws(" ", p["type"], p["name"])), ", ")
    return F.concat(F.array_join(F.concat(m["modifiers"], F.array(m["return_type"])), " "), F.lit(" "), m["name"], F.lit("("), params, F.lit(")"))


def type_signature() -> Column:
    return F.concat_ws(
        " ", F.array_join("modifiers", " "), "class_type", "name", F.when(F.col("extends").isNotNull(), F.concat(F.lit("extends "), "extends")),
        F.when(F.size("implements") > 0, F.concat(F.lit("implements "), F.array_join("implements", ", "))),
    )


def raw_references() -> Column:
    """Names that a type refers to: imports outside of libraries, bases, interfaces, types of fields, results and parameters."""
    own = F.when(F.col("parent") < 0, F.col("imports")).otherwise(F.array().cast("array<string>"))  # of the file's outer types
    imported = F.filter(own, lambda x: ~F.arrays_overlap(F.transform(strings(*LIBRARIES), lambda p: F.startswith(x, p)), F.array(F.lit(True))) & ~F.endswith(x, F.lit("*")))
    last = F.transform(imported, lambda x: F.element_at(F.split(x, r"\."), -1))
    typed = F.concat(
        F.transform("fields", lambda f: base_type(f["type"])), F.transform("methods", lambda m: base_type(m["return_type"])),
        F.flatten(F.transform("methods", lambda m: F.transform(m["parameters"], lambda p: base_type(p["type"])))),
    )
    every = F.concat(last, F.array_compact(F.array("extends")), "implements", F.filter(typed, lambda x: x.rlike("^[A-Z]")))
    return F.array_sort(F.array_except(F.array_except(F.array_distinct(every), strings(*COMMON_TYPES)), F.array("name")))


def _named(types: DataFrame) -> DataFrame:
    """path, number, name, parent and raw references of all types, kept: a narrow table for what needs the whole corpus."""
    return checkpointed(types.select("path", "number", "name", "parent", raw_references().alias("raw")))


def _known(named: DataFrame) -> DataFrame:
    known = named.filter("parent = -1").select("name").distinct()
    each = named.select("path", "number", F.explode("raw").alias("name")).join(known, "name", "left_semi")
    return each.groupBy("path", "number").agg(F.array_sort(F.collect_set("name")).alias("references"))


def known_references(types: DataFrame) -> DataFrame:
    """path, number, references: those that are classes of the whole corpus (found before, so order does not matter)."""
    return _known(_named(types))


def java_chunks(types: DataFrame, least: int = V.MIN_CHUNK_LINES, most: int = V.MAX_CHUNK_LINES, bare: DataFrame | None = None) -> DataFrame:
    """Chunks of classes, their methods, and inner classes and enums (first level).

    The types are read twice: for the narrow table of names and references, which is kept, and for the chunks of all three
    kinds, which one explode gives for each type. bare: the same types without texts, for the first of the two."""
    named = _named(types if bare is None else bare)
    parents = named.filter("parent = -1").select("path", F.col("number").alias("parent"), F.col("name").alias("parent_class"))
    field_lines = F.transform("fields", lambda f: F.concat(F.lit("    "), F.array_join(F.concat(f["modifiers"], F.array(f["type"], f["name"])), " "), F.lit(";")))
    method_lines = F.transform("methods", lambda m: F.concat(F.lit("\n    "), signature(m)))
    head = F.array_compact(F.array("documentation", F.when(F.size("annotations") > 0, F.array_join("annotations", "\n")), F.concat(type_signature(), F.lit(" {"))))
    full = F.array_join(F.concat(head, field_lines, method_lines, F.array(F.lit("}"))), "\n")
    counts = F.array(F.concat(F.lit("    // fields: "), F.size("fields").cast("string")), F.concat(F.lit("    // methods: "), F.size("methods").cast("string")))
    brief = F.array_join(F.concat(F.array_compact(F.array("documentation", F.concat(type_signature(), F.lit(" {")))), counts, F.transform("methods", lambda m: F.concat(F.lit("    // "), signature(m))), F.array(F.lit("}"))), "\n")
    meta = lambda *c: F.to_json(F.struct(*c))
    nothing = F.lit(None).cast("string")

    def piece(kind: Column, name: Column, text: Column, short: Column, start: Column, end: Column, class_name: Column, method: Column, doc: Column, metadata: Column) -> Column:
        values = {"kind": kind, "name": name, "text": text, "short": short, "start_line": start, "end_line": end, "class_name": class_name, "method_name": method, "documentation": doc, "metadata": metadata}
        return F.struct(*(v.alias(k) for k, v in values.items()))

    own = piece(F.lit("class"), F.col("name"), full, brief, F.col("start_line"), F.col("end_line"), F.col("name"), nothing, F.col("documentation"), meta("package", "class_type", "extends", "implements", "imports"))
    qualified = F.concat_ws(".", "parent_class", "name")
    inner = piece(
        F.col("class_type"), qualified, F.concat_ws("\n", F.concat(F.lit("// Inner type of: "), "parent_class"), "documentation", "source_code"), nothing, F.col("start_line"), F.col("end_line"), qualified, nothing, F.col("documentation"),
        meta("package", "class_type", "parent_class", "extends", "implements"),
    )

    def method(m: Column) -> Column:
        about = F.concat_ws("\n", F.concat(F.lit("// Class: "), "name"), F.when(F.col("package") != "", F.concat(F.lit("// Package: "), "package")), m["documentation"], m["body"])
        return piece(F.lit("method"), F.concat_ws(".", "name", m["name"]), about, nothing, m["start_line"], m["end_line"], F.col("name"), m["name"], m["documentation"], meta(*(m[c].alias(c) for c in ("return_type", "parameters", "modifiers"))))

    wanted = types.filter("parent = -1 OR depth = 1 AND class_type IN ('enum', 'class')").join(bounded(parents), ["path", "parent"], "left")
    # an outer explode: from an inner one Spark would derive a filter that makes all the texts once more
    pieces = F.when(F.col("parent") < 0, F.concat(F.array(own), F.transform("methods", method))).otherwise(F.array(inner))
    each = wanted.select("path", "number", F.explode_outer(pieces).alias("p")).select("path", "number", "p.*").withColumn("lines", splitlines(F.col("text"))).filter(F.size("lines") >= least)
    content = F.when(F.col("kind") == "method", truncated(F.col("lines"), most)).when(F.col("short").isNull(), truncated(F.col("lines"), most)).otherwise(F.when(F.size("lines") > most, F.col("short")).otherwise(F.col("text")))
    shaped = each.select(
        "path", F.when(F.col("kind") != "method", F.col("number")).alias("number"), chunk_id(F.col("path"), F.col("name"), F.col("kind")).alias("id"), content.alias("content"), F.lit("java").alias("language"), F.col("kind").alias("chunk_type"),
        F.col("path").alias("file_path"), "start_line", "end_line", "class_name", "method_name", "documentation", "metadata",
    )
    out = shaped.join(bounded(checkpointed(_known(named))), ["path", "number"], "left").withColumn("references", F.coalesce("references", F.array().cast("array<string>")))
    return out.select("id", "content", "language", "chunk_type", "file_path", "start_line", "end_line", "class_name", "method_name", "documentation", "references", "metadata")


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line))


def generic_blocks(files: DataFrame, max_lines: int | None = 500) -> DataFrame:
    """files: path, text, language. A module block for each file, and blocks that begin with a pattern of the language:
    (path, language, code_type, name, start_line, end_line, source, documentation). Python blocks end before the first line
    that is not indented more; others where their braces balance, or with the file. Longer files are left out; None: no file is.

    A file is read and cut once: the lines that begin a block of its language, with their kinds, are one array, and the module
    is its first element."""
    quoted = F.regexp_extract("text", r'(?s)\A\s*(?:"""(.*?)"""|\'\'\'.*?\'\'\')', 1)
    other = F.regexp_extract("text", r"(?s)\A\s*'''(.*?)'''", 1)
    jsdoc = F.regexp_extract("text", r"(?s)\A\s*/\*\*(.*?)\*/", 1)
    doc = F.when(F.col("language") == "python", F.coalesce(F.nullif(F.trim(quoted), F.lit("")), F.nullif(F.trim(other), F.lit("")))).when(F.col("language").isin("javascript", "typescript"), F.nullif(F.trim(jsdoc), F.lit("")))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    count = lambda line, c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    # a text that is an expression is made once for its lines, not once for each place that has it
    cut = files.withColumn("lines", F.get(F.transform(F.array("text"), splitlines), F.lit(0)))
    if max_lines is not None:
        cut = cut.filter(F.size("lines") <= max_lines)
    # Python has indents, the others braces: only what a file's language needs is made
    indented = F.col("language") == "python"
    cut = cut.withColumn("delta", F.when(~indented, F.transform("lines", lambda x: count(x, "{") - count(x, "}")))).withColumn("opens", F.when(~indented, F.transform("lines", lambda x: count(x, "{")))).withColumn("indents", F.when(indented, F.transform("lines", lambda x: F.when(F.trim(x) != "", _indent(x)))))

    def kinds_of(line: Column) -> Column:
        """Kinds and names of what a line begins, by its file's language."""
        found = F.array().cast("array<struct<kind:string,name:string>>")
        for language, patterns in BLOCKS.items():
            own = F.array(*(F.when(line.rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, p, 1).alias("name"))) for kind, p in patterns.items()))
            found = F.when(F.col("language") == language, F.array_compact(own)).otherwise(found)
        return found

    begun = F.flatten(F.transform("lines", lambda x, i: F.transform(kinds_of(x), lambda k: F.struct((i + 1).alias("start"), k["kind"].alias("kind"), k["name"].alias("name")))))
    module = F.array(F.struct(F.lit(0).alias("start"), F.lit("module").alias("kind"), stem.alias("name")))
    each = cut.select("path", "language", "lines", "delta", "opens", "indents", "text", doc.alias("doc"), F.explode_outer(F.concat(module, begun)).alias("b")).select("*", "b.*")

    first = F.get("indents", F.col("start") - 1)
    stop = F.array_position(F.transform(F.slice("indents", F.col("start") + 1, F.size("lines")), lambda x: F.coalesce(x <= first, F.lit(False))), True)
    window = F.arrays_zip(F.slice("delta", F.greatest("start", F.lit(1)), F.size("lines")).alias("d"), F.slice("opens", F.greatest("start", F.lit(1)), F.size("lines")).alias("o"))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"), F.lit(False).alias("seen"), F.lit(0).alias("end"))

    def step(a: Column, x: Column) -> Column:
        total, seen = a["sum"] + x["d"], a["seen"] | (x["o"] > 0)
        done = (a["end"] == 0) & seen & (total == 0)
        return F.struct((a["n"] + 1).alias("n"), total.alias("sum"), seen.alias("seen"), F.when(done, a["n"] + 1).otherwise(a["end"]).alias("end"))

    rest = F.size("lines") - F.col("start") + 1
    length = F.when(F.col("start") == 0, F.size("lines")).when(F.col("language") == "python", F.when(stop == 0, rest).otherwise(stop)).otherwise(F.coalesce(F.nullif(F.aggregate(window, nothing, step, lambda a: a["end"]), F.lit(0)), rest))
    whole = F.col("start") == 0
    return each.withColumn("start_line", F.greatest("start", F.lit(1))).withColumn("length", length.cast("int")).select(
        "path", "language", F.col("kind").alias("code_type"), "name", "start_line", (F.col("start_line") + F.col("length") - 1).alias("end_line"),
        F.when(whole, F.col("text")).otherwise(F.array_join(F.slice("lines", F.col("start_line"), F.col("length")), "\n")).alias("source"), F.when(whole, F.col("doc")).alias("documentation"),
    )


def block_chunks(blocks: DataFrame, least: int = V.MIN_CHUNK_LINES, most: int = V.MAX_CHUNK_LINES) -> DataFrame:
    """Generic blocks as chunks, with the class names in their text as raw references."""
    lines = splitlines(F.col("source"))
    return blocks.filter(F.size(lines) >= least).select(
        chunk_id(F.col("path"), F.col("name"), F.col("code_type")).alias("id"), truncated(lines, most).alias("content"), "language", F.col("code_type").alias("chunk_type"), F.col("path").alias("file_path"), "start_line", "end_line",
        F.when(F.col("code_type") == "class", F.col("name")).alias("class_name"), F.when(F.col("code_type").isin("function", "arrow"), F.col("name")).alias("method_name"), "documentation",
        F.array_sort(F.array_distinct(pascal_names(F.col("source")))).alias("references"),
    )
