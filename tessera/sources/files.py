"""Sources: files of a tree as rows, JSON templates, mappings, JSONL; and the JSONL sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import values as V
from tessera.functions.text import language_of


def files(spark: SparkSession, folder: str, suffixes: list[str], recursive: bool = True) -> DataFrame:
    """path, text of all files with one of the suffixes; files that are no UTF-8 are left out."""
    glob = "*{" + ",".join(suffixes) + "}" if len(suffixes) > 1 else f"*{suffixes[0]}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(folder)
    return raw.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).filter("text IS NOT NULL")


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """path, text of a file, whatever its suffix; no row if it is no UTF-8."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).filter("text IS NOT NULL")


def relative(df: DataFrame, base: str, column: str = "path") -> DataFrame:
    """Paths below ``base``; others stay as they are."""
    clean = F.regexp_replace(column, r"^file:/+", "/")
    prefix = base.rstrip("/") + "/"
    return df.withColumn(column, F.when(F.startswith(clean, F.lit(prefix)), F.substring(clean, len(prefix) + 1, 1_000_000)).otherwise(clean))


def java_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    return files(spark, folder, [".java"], recursive)


def code_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, text, language of files other than Java by the known suffixes."""
    found = files(spark, folder, sorted(V.LANGUAGES), recursive)
    return found.withColumn("language", language_of(F.col("path"), V.LANGUAGES))


def below(df: DataFrame, sub: str) -> DataFrame:
    """Of files with paths below a folder: those in its folder ``sub``, at any depth, and those in the folder itself."""
    return df.filter(F.startswith("path", F.lit(f"{sub}/")) | ~F.contains("path", F.lit("/")))


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents under docs/ and in the root, with paths below the folder."""
    return below(relative(files(spark, folder, [".md", ".txt", ".rst"]), folder), "docs")


def template_files(spark: SparkSession, folder: str, sub: str | None = "templates") -> DataFrame:
    """Parseable JSON files under templates/ and in the root, with paths below the folder and the name of the file without its
    suffix; of the whole folder if ``sub`` is None."""
    found = relative(files(spark, folder, [".json"]), folder)
    found = (found if sub is None else below(found, sub)).filter(F.try_parse_json("text").isNotNull())
    return found.withColumn("template", F.regexp_extract("path", r"([^/]+?)\.json$", 1))


def sizes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, found, bytes, megabytes (two places) of each of some files, which need not be there. The files are not read."""
    rows = spark.createDataFrame([(p, f"{p.rstrip('/').rpartition('/')[0] or '.'}", p.rstrip("/").rpartition("/")[2]) for p in paths], "path string, folder string, name string")
    known = None
    for folder in sorted({r.folder for r in rows.select("folder").distinct().collect()}):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            one = spark.read.format("binaryFile").load(folder).select(F.lit(folder).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")
            known = one if known is None else known.unionByName(one)
    known = spark.createDataFrame([], "folder string, name string, length long") if known is None else known
    joined = rows.join(known, ["folder", "name"], "left")
    return joined.select("path", F.col("length").isNotNull().alias("found"), F.col("length").alias("bytes"), F.round(F.col("length") / (1024 * 1024), 2).alias("megabytes"))


def json_names(text_column: str = "text"):
    """Keys and string values of a JSON text that look like class names, in order, with repeats; from its tokens, at any depth."""
    return F.filter(F.regexp_extract_all(F.col(text_column), F.lit(r'"((?:[^"\\]|\\.)*)"'), 1), lambda x: x.rlike("^[A-Z][a-zA-Z0-9]+$"))


def template_references(templates: DataFrame) -> DataFrame:
    """template, pos, name of the class names in each template."""
    return templates.select("template", F.posexplode(json_names()).alias("pos", "name"))


def template_of_class(templates: DataFrame) -> DataFrame:
    """name, path of the first template (by path) that refers to each class."""
    named = templates.select("path", F.explode(F.array_distinct(json_names())).alias("name"))
    return named.groupBy("name").agg(F.min("path").alias("path"))


def manual_mapping(spark: SparkSession, path: str) -> DataFrame:
    """name, template of a JSON object; a template may be given by its path."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "template"))
    return rows.withColumn("template", F.regexp_extract("template", r"([^/]+?)(?:\.json)?$", 1))


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_jsonl(lines: DataFrame, column: str, path: str) -> None:
    lines.select(F.col(column).alias("value")).write.text(path)
