"""Question analysis as column expressions: intent, names, terms, recommendations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import values as V
from tessera.functions.text import NO_STRINGS, camel_names, contains_any, pascal_names, strings, word_tokens


def intent(question: Column) -> Column:
    """The first intent one of whose phrases occurs."""
    low = F.lower(F.trim(question))
    out = None
    for name, phrases in V.INTENT_PHRASES.items():
        hit = contains_any(low, phrases)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(V.DEFAULT_INTENT)


def class_names(question: Column) -> Column:
    common = strings(*V.COMMON_WORDS)
    return F.filter(pascal_names(question), lambda x: (F.length(x) >= 2) & ~F.array_contains(common, x))


def method_names(question: Column) -> Column:
    return camel_names(question)


def primary_terms(question: Column) -> Column:
    """Class and method names, then other words in order: no stop words, over two letters, each once; ten at most."""
    names = F.concat(class_names(question), method_names(question))
    stop, low_names = strings(*V.STOP_WORDS), F.transform(names, F.lower)
    words = F.filter(word_tokens(F.lower(F.trim(question))), lambda x: x.rlike("^[a-z][a-z0-9_]*$") & (F.length(x) > 2))
    more = F.array_except(F.array_except(words, stop), low_names)  # keeps order and drops repeats
    return F.slice(F.concat(names, more), 1, V.MAX_PRIMARY)


def expanded_terms(primary: Column) -> Column:
    """Expansions of terms, and those of keys that have a term among theirs, sorted; primary terms are left out; fifteen at most."""
    low = F.transform(primary, F.lower)
    parts = []
    for key, also in V.TERM_EXPANSIONS.items():
        inside = F.arrays_overlap(low, strings(*also))
        parts.append(F.when(inside, strings(key, *also)).when(F.array_contains(low, key), strings(*also)).otherwise(F.array().cast(NO_STRINGS)))
    found = F.array_sort(F.array_except(F.flatten(F.array(*parts)), low))
    return F.slice(found, 1, V.MAX_EXPANDED)


def search_keywords(question: Column) -> Column:
    """Names and primary terms, each once whatever its case, in order of the first; ten at most."""
    every = F.concat(class_names(question), method_names(question), primary_terms(question))
    first = F.filter(every, lambda x, i: F.array_position(F.transform(every, F.lower), F.lower(x)) == i + 1)
    return F.slice(first, 1, V.MAX_KEYWORDS)


def recommendation(intent_: Column, classes: Column) -> Column:
    """struct of top_k, min_similarity, include_dependencies, chunk_type."""
    out = None
    for name, (top_k, similarity, dependencies, kind) in V.RECOMMENDATIONS.items():
        chunk_type = F.lit(kind).cast("string")
        if name == "definition":
            chunk_type = F.when(F.size(classes) > 0, chunk_type)
        row = F.struct(F.lit(top_k).cast("long").alias("top_k"), F.lit(similarity).alias("min_similarity"), F.lit(dependencies).alias("include_dependencies"), chunk_type.alias("chunk_type"))
        out = F.when(intent_ == name, row) if out is None else out.when(intent_ == name, row)
    return out


def asked_language(text: Column) -> Column:
    """The language that a question names, in this order of search; "java" is in "javascript", and comes first."""
    low = F.lower(text)
    return F.coalesce(*(F.when(F.contains(low, F.lit(x)), x) for x in ("java", "python", "javascript", "typescript")))


def asks_for_class_list(text: Column) -> Column:
    low = F.lower(text)
    return contains_any(low, V.CLASS_LIST_PHRASES) & F.contains(low, F.lit("class"))
