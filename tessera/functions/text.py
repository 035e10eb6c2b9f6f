"""Column expressions for text: lines, identifiers, tokens, ids and similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line.
NEWLINE = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
NO_STRINGS = "array<string>"


def strings(*values: str) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast(NO_STRINGS)


def splitlines(text: Column) -> Column:
    """Lines without their ends; no empty line after the last end, none for empty text."""
    body = F.regexp_replace(text, f"({NEWLINE})\\z", "")
    return F.when(text == "", F.array().cast(NO_STRINGS)).otherwise(F.split(body, NEWLINE))


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1)


def pascal_names(text: Column) -> Column:
    return F.filter(word_tokens(text), lambda x: x.rlike("^[A-Z][a-zA-Z0-9]*$"))


def camel_names(text: Column) -> Column:
    return F.filter(word_tokens(text), lambda x: x.rlike("^[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*$"))


def chunk_id(path: Column, name: Column, kind: Column) -> Column:
    """First 16 hex digits of the SHA-256 of path:name:type."""
    return F.left(F.sha2(F.concat_ws(":", path, name, kind), 256), F.lit(16))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 2).cast("long")


def contains_any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def hash_choice(key: Column, n: int) -> Column:
    """A reproducible choice of 0 .. n-1: the first 8 hex digits of the SHA-256, modulo n."""
    return F.conv(F.left(F.sha2(key, 256), F.lit(8)), 16, 10).cast("long") % n


def jaccard(a: Column, b: Column) -> Column:
    """Of the word sets of two texts in lower case: 1 if both are empty, 0 if one is."""
    x, y = (F.array_distinct(F.array_remove(F.split(F.trim(F.lower(F.coalesce(t, F.lit("")))), r"\s+"), "")) for t in (a, b))
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def cosine(a: Column, b: Column) -> Column:
    """In double precision. Evaluated row by row; for many vectors see operators.search.vector_topk."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def embedding_text(language: Column, kind: Column, class_name: Column, method_name: Column, documentation: Column, content: Column) -> Column:
    """Labelled lines for the embedding model; empty parts are left out."""
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    return F.concat_ws("\n", line("Language", language), line("Type", kind), line("Class", class_name), line("Method", method_name), line("Documentation", documentation), F.concat(F.lit("Code:\n"), content))


def base_type(name: Column) -> Column:
    """Type name without generics and array marks."""
    return F.trim(F.replace(F.substring_index(name, "<", 1), F.lit("[]"), F.lit("")))


def split_camel(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, "([A-Z])", " $1"), " +", " ")))


def clean_javadoc(doc: Column) -> Column:
    """Without comment marks and tags with their first word, in single spaces."""
    s = F.regexp_replace(doc, r"/\*\*|\*/", "")
    s = F.regexp_replace(s, r"(?m)^\s*\*\s?", "")
    s = F.regexp_replace(s, r"@\w+\s+\S*", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def language_of(path: Column, languages: dict[str, str]) -> Column:
    """By the suffix, or null."""
    table = F.create_map(*(F.lit(x) for pair in languages.items() for x in pair))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)))


def duration_seconds(begin: Column, end: Column) -> Column:
    """Seconds between two timestamps, with their fraction; null if one is. The session's time zone does not matter."""
    part = lambda unit: F.extract(F.lit(unit), end - begin)
    return (part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60).cast("double") + part("SECOND").cast("double")


def duration_text(seconds: Column) -> Column:
    """Hours, minutes and seconds as "1h 2m 3s"; fractions are left out."""
    whole = F.floor(seconds)
    parts = [F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60]
    return F.concat(*(x for p, mark in zip(parts, ("h ", "m ", "s"), strict=True) for x in (p.cast("string"), F.lit(mark))))
