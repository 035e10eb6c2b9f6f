"""The library from SQL: a table function for lateral calls, functions of questions and texts, strategies as views.

    register(spark)
    SELECT f.path, t.name FROM files f, LATERAL java_types(f.text) t WHERE question_intent('What is Order?') = 'definition'

Only the scanner of Java files is Python (one call for each file, in the task that has the file); the other functions are SQL
bodies, which are part of the caller's plan. They give what the column functions of the same meaning give."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from tessera.functions import java
from tessera.functions import values as V
from tessera.operators import strategies
from tessera.operators.code import TYPES

_COLUMNS = TYPES.removeprefix("path string, ")
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ") if " " in c and ":" not in c.split()[0]]


@udtf(returnType=_COLUMNS)
class JavaTypes:
    """All types of one Java text, as ``code.java_types`` has them: longer texts than ``max_lines`` and null give no row."""

    def eval(self, text: str, max_lines: int = 10_000) -> Iterator[tuple]:
        if text is None or (max_lines is not None and len(text.splitlines()) > max_lines):
            return
        for number, found in enumerate(java.types_of(text)):
            row = {"number": number, **found}
            yield tuple(row[c] for c in _NAMES)


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strings(values) -> str:
    return "CAST(array(" + ", ".join(map(_quoted, values)) + ") AS array<string>)"


def _any(text: str, phrases: list[str]) -> str:
    return " OR ".join(f"contains({text}, {_quoted(p)})" for p in phrases)


_WORDS = r"regexp_extract_all({}, r'([\p{{L}}\p{{N}}_]+)', 1)"
_ASKED = "lower(trim(question))"
_SET = "array_distinct(array_remove(split(trim(lower(coalesce({}, ''))), r'\\s+'), ''))"

#: name -> (parameters, result, body), in an order in which a body only calls functions before it.
FUNCTIONS = {
    "question_intent": ("question STRING", "STRING", "CASE " + " ".join(f"WHEN {_any(_ASKED, p)} THEN {_quoted(n)}" for n, p in V.INTENT_PHRASES.items()) + f" ELSE {_quoted(V.DEFAULT_INTENT)} END"),
    "question_classes": (
        "question STRING", "ARRAY<STRING>",
        f"filter({_WORDS.format('question')}, x -> x RLIKE '^[A-Z][a-zA-Z0-9]*$' AND length(x) >= 2 AND NOT array_contains({_strings(V.COMMON_WORDS)}, x))",
    ),
    "question_methods": ("question STRING", "ARRAY<STRING>", f"filter({_WORDS.format('question')}, x -> x RLIKE '^[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*$')"),
    "question_terms": (
        "question STRING", "ARRAY<STRING>",
        f"slice(concat(question_classes(question), question_methods(question), array_except(array_except(filter({_WORDS.format(_ASKED)}, x -> x RLIKE '^[a-z][a-z0-9_]*$' AND length(x) > 2), {_strings(V.STOP_WORDS)}), "
        f"transform(concat(question_classes(question), question_methods(question)), x -> lower(x)))), 1, {V.MAX_PRIMARY})",
    ),
    "chunk_key": ("path STRING, name STRING, kind STRING", "STRING", "left(sha2(concat_ws(':', path, name, kind), 256), 16)"),
    "token_estimate": ("text STRING", "BIGINT", "CAST(floor(length(text) / 2) AS BIGINT)"),
    "word_jaccard": (
        "a STRING, b STRING", "DOUBLE",
        f"if(size(array_union({_SET.format('a')}, {_SET.format('b')})) = 0, 1.0D, size(array_intersect({_SET.format('a')}, {_SET.format('b')})) / size(array_union({_SET.format('a')}, {_SET.format('b')})))",
    ),
    "plain_type": ("name STRING", "STRING", "trim(replace(substring_index(name, '<', 1), '[]', ''))"),
}


def register(spark: SparkSession, types: DataFrame | None = None) -> None:
    """Table function ``java_types(text[, max_lines])`` and all FUNCTIONS, for this session. With a table of types, the
    examples of each strategy are views, ``code_explanation_examples`` and so on."""
    spark.udtf.register("java_types", JavaTypes)
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    if types is not None:
        for name, strategy in strategies.STRATEGIES.items():
            strategy(types).createOrReplaceTempView(f"{name}_examples")
