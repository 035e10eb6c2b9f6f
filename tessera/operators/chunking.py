"""Chunks of documents and templates, batches for embedding, and reports about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import values as V
from tessera.functions.text import chunk_id, splitlines, token_estimate

TRUNCATED = "... (truncated)"


def truncated(lines: Column, most: int = V.MAX_CHUNK_LINES) -> Column:
    cut = F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit(f"\n{TRUNCATED}"))
    return F.when(F.size(lines) > most, cut).otherwise(F.array_join(lines, "\n"))


def line_chunks(docs: DataFrame, path: Column, text: Column, size: int = V.MAX_CHUNK_LINES, least: int = V.MIN_CHUNK_LINES) -> DataFrame:
    """Fixed windows of lines: (id, path, start_line, end_line, content); windows below ``least`` lines are left out. Each
    window has its own lines alone, so a text is copied once."""
    cut = docs.select(path.alias("path"), splitlines(F.coalesce(text, F.lit(""))).alias("lines")).filter("size(lines) > 0")
    windows = F.transform(F.sequence(F.lit(1), F.size("lines"), F.lit(size)), lambda at: F.struct(at.cast("long").alias("start_line"), F.slice("lines", at, size).alias("part")))
    out = cut.select("path", F.explode_outer(windows).alias("x")).select("path", "x.start_line", "x.part").filter(F.size("part") >= least)
    return out.select(
        chunk_id(F.col("path"), F.concat(F.lit("lines"), F.col("start_line").cast("string")), F.lit("document")).alias("id"),
        "path",
        "start_line",
        (F.col("start_line") + F.size("part") - 1).cast("long").alias("end_line"),
        F.array_join("part", "\n").alias("content"),
    )


def sections(docs: DataFrame, key: Column, text: Column, is_header) -> DataFrame:
    """Sections of a text: (key, section, title, start_line, content). A line for which ``is_header`` holds opens one; what
    stands before the first header is section 0. Works on the lines of a row: nothing is shuffled.

    Each section gets its own lines before the rows are made, by an outer explode: from an inner one Spark derives a filter
    on the array's size, and with it the split would be done again for each line."""
    cut = docs.select(key.alias("key"), splitlines(F.coalesce(text, F.lit(""))).alias("lines")).filter("size(lines) > 0")
    heads = F.filter(F.transform("lines", lambda x, i: F.when(is_header(x), i + 1)), lambda i: i.isNotNull())
    cut = cut.select("key", "lines", heads.alias("heads"), F.size("lines").alias("n_lines"))
    first = F.get("heads", F.lit(0)) == 1
    bounds = F.when(first, F.col("heads")).otherwise(F.concat(F.array(F.lit(1)), F.col("heads")))
    cut = cut.select("key", "lines", F.when(first, 1).otherwise(0).alias("offset"), bounds.alias("bounds"), F.concat(F.slice(bounds, 2, F.col("n_lines")), F.array(F.col("n_lines") + 1)).alias("ends"))
    spans = F.transform(F.arrays_zip("bounds", "ends"), lambda x, n: F.struct(n.alias("n"), x["bounds"].alias("start"), F.slice("lines", x["bounds"], x["ends"] - x["bounds"]).alias("part")))
    one = cut.select("key", "offset", F.explode_outer(spans).alias("x")).select("key", (F.col("x.n") + F.col("offset")).cast("long").alias("section"), F.col("x.start").cast("long").alias("start_line"), F.col("x.part").alias("part"))
    title = F.when(F.col("section") > 0, F.trim(F.regexp_replace(F.get("part", F.lit(0)), "^#+", ""))).otherwise("")
    return one.select("key", "section", title.alias("title"), "start_line", F.array_join("part", "\n").alias("content"))


def markdown_header(line: Column) -> Column:
    return F.startswith(line, F.lit("#"))


def document_sections(docs: DataFrame) -> DataFrame:
    """docs: path, text. (path, language, section, start_line, content): Markdown is cut at its headers, the part before the
    first one is called "document"; other texts stay whole under the name of their file."""
    is_markdown = F.endswith(F.lower("path"), F.lit(".md"))
    cut = sections(docs.filter(is_markdown), F.col("path"), F.col("text"), markdown_header)
    cut = cut.select(F.col("key").alias("path"), F.lit("markdown").alias("language"), F.coalesce(F.nullif("title", F.lit("")), F.lit("document")).alias("section"), "start_line", "content")
    whole = docs.filter(~is_markdown).select("path", F.lit("text").alias("language"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("section"), F.lit(1).cast("long").alias("start_line"), F.col("text").alias("content"))
    return cut.unionByName(whole)


def template_chunks(templates: DataFrame, most: int = V.MAX_CHUNK_LINES, least: int = V.MIN_CHUNK_LINES) -> DataFrame:
    """templates: path, text. JSON objects as one chunk each, and one for each top-level key if the text is longer than
    ``most`` lines; what is no JSON is left out: (id, path, chunk_type, name, section, content, keys)."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    good = templates.withColumn("parsed", F.try_parse_json("text")).filter("parsed IS NOT NULL").withColumn("name", name).withColumn("lines", splitlines(F.col("text")))
    whole = good.select(
        chunk_id(F.col("path"), F.col("name"), F.lit("template")).alias("id"), "path", F.lit("template").alias("chunk_type"), "name", F.lit(None).cast("string").alias("section"),
        truncated(F.col("lines"), most).alias("content"), F.json_object_keys("text").alias("keys"),
    )
    parts = good.filter(F.size("lines") > most).select("path", "name", F.explode(F.from_json("text", "map<string,variant>")).alias("section", "value"))
    content = F.concat(F.lit('{"'), F.col("section"), F.lit('": '), F.to_json("value"), F.lit("}"))
    return whole.unionByName(
        parts.select(chunk_id(F.col("path"), F.concat_ws(".", "name", "section"), F.lit("template_section")).alias("id"), "path", F.lit("template_section").alias("chunk_type"), "name", "section", content.alias("content"), F.array(F.col("section")).alias("keys"))
    )


def oversize(chunks: DataFrame, text: str, most: int = V.OVERSIZE_TOKENS) -> DataFrame:
    """Rows over the token limit, with the reason; the others are what can be embedded."""
    return chunks.withColumn("tokens", token_estimate(F.col(text))).filter(F.col("tokens") > most).withColumn("reason", F.lit("too many tokens"))


# --- conversations ------------------------------------------------------------------------------------------------------


def history(turns: DataFrame, shown: int = V.HISTORY_SHOWN, chars: int = V.HISTORY_CHARS) -> DataFrame:
    """Each turn with the last ``shown`` ones before it, each cut to ``chars`` characters and "..."."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-shown, -1)
    line = F.concat("role", F.lit(": "), F.substring("text", 1, chars), F.lit("..."))
    return turns.select("conv_id", "turn", "role", "text", F.array_join(F.collect_list(line).over(before), "\n").alias("history"))


def enhanced_questions(turns: DataFrame) -> DataFrame:
    """User turns, with the history in front of those that have one."""
    asked = history(turns).filter("role = 'user'")
    return asked.select("conv_id", "turn", F.when(F.col("history") == "", F.col("text")).otherwise(F.concat(F.lit("Previous conversation:\n"), "history", F.lit("\n\nCurrent question: "), "text")).alias("question"))


def trimmed_history(turns: DataFrame, max_history: int) -> DataFrame:
    """The last 2 * max_history turns of each conversation."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("__back", back).filter(F.col("__back") <= 2 * max_history).drop("__back")
