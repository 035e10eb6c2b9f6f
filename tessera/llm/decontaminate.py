"""Benchmark decontamination by winnowing, in DataFrame functions only.

Fingerprints: of the hashes of all K-word grams, each window of W consecutive grams keeps its smallest one, so two texts
that share W + K - 1 = 10 words keep a common fingerprint. Document fingerprints join those of the benchmark items; a
document that shares one is extended there: the 10-word windows around each shared gram are compared with the windows of
the items as text, so a hash never decides. Items of fewer than 10 words are one window each; winnowing does not cover
them, so documents are searched for each such length in whole.

At scale: fingerprints of a document are distinct before they leave it (two in seven words at most), the texts of the
documents do not move unless the rows with a place in common are too many to broadcast, and all joins are equi-joins on
hashes or windows. The text of a window is made only where hashes have met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, checkpoint, joinable, settled, with_row_id

WINDOW = 10
GRAM = 5
KEPT_OF = WINDOW - GRAM + 1
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cases A-Z only and cuts at ASCII characters other than letters and digits; null has no words."""
    text = F.coalesce(text, F.lit(""))
    # for ASCII texts lower() is the same, and many times faster
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _starts(size: Column, n: int) -> Column:
    """0 .. size - n, or nothing."""
    return F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))


def _with_grams(df: DataFrame, text: str) -> DataFrame:
    """Adds w (words), h (their hashes) and g (hashes of the K-word grams)."""
    df = df.withColumn("w", words(F.col(text)))
    df = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    return df.withColumn("g", F.transform(_starts(F.size("h"), GRAM), lambda i: F.xxhash64(*(F.get("h", i + j) for j in range(GRAM)))))


def _winnowed() -> Column:
    """The distinct smallest grams of all windows of W grams."""
    return F.array_distinct(F.transform(_starts(F.size("g"), KEPT_OF), lambda i: F.least(*(F.get("g", i + j) for j in range(KEPT_OF)))))


def _window(i: Column, n: int) -> Column:
    return F.array_join(F.slice("w", i + 1, n), " ")


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, n (words of the window), window: each different window of each item."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w"))
    long = items.filter(F.size("w") >= WINDOW).select("item", F.lit(WINDOW).alias("n"), F.explode(F.transform(_starts(F.size("w"), WINDOW), lambda i: _window(i, WINDOW))).alias("window"))
    short = items.filter((F.size("w") > 0) & (F.size("w") < WINDOW)).select("item", F.size("w").alias("n"), F.array_join("w", " ").alias("window"))
    return long.unionByName(short).distinct()


def _fingerprints(benchmark: DataFrame, text_col: str) -> DataFrame:
    """gram: the different fingerprints of the items."""
    return _with_grams(benchmark.select(F.col(text_col).alias("text")), "text").select(F.explode(_winnowed()).alias("gram")).distinct()


def _places(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """rid, n, at: where a window of WINDOW words may begin that an item has, too: around each gram of an item, in documents
    that share a fingerprint."""
    shared = _with_grams(docs, "text").select("rid", F.explode(_winnowed()).alias("gram")).join(joinable(prints), "gram").select("rid").distinct()
    near = _with_grams(docs.join(joinable(checkpoint(shared)), "rid", "left_semi"), "text")
    met = near.select("rid", F.size("w").alias("size"), F.posexplode_outer("g").alias("p", "gram")).join(joinable(prints), "gram")
    # outer explodes: from inner ones Spark derives filters on the arrays and would make the words again for each element
    # a shared gram at p is in the windows that begin at p - (WINDOW - GRAM) .. p
    begin = F.explode(F.sequence(F.greatest(F.col("p") - (WINDOW - GRAM), F.lit(0)), F.least("p", F.col("size") - WINDOW)))
    return met.filter(F.col("size") >= WINDOW).filter(F.col("p") - (WINDOW - GRAM) <= F.col("size") - WINDOW).select("rid", F.lit(WINDOW).alias("n"), begin.alias("at")).distinct()


def _short_places(docs: DataFrame, known: DataFrame) -> DataFrame | None:
    """rid, n, at: where the hash of a shorter window is that of an item. Hashes meet, not texts."""
    out = None
    for (n,) in known.filter(F.col("n") < WINDOW).select("n").distinct().orderBy("n").collect():  # at most nine lengths
        wanted = checkpoint(known.filter(F.col("n") == n).select(F.xxhash64(*(F.xxhash64(F.get(F.split("window", " "), F.lit(j))) for j in range(n))).alias("gram")).distinct())
        h = F.transform(words(F.col("text")), lambda x: F.xxhash64(x))
        grams = F.transform(_starts(F.size("h"), n), lambda i: F.xxhash64(*(F.get("h", i + j) for j in range(n))))  # noqa: B023
        met = docs.select("rid", h.alias("h")).select("rid", F.posexplode_outer(grams).alias("at", "gram")).join(joinable(wanted), "gram").select("rid", F.lit(n).alias("n"), "at")
        out = met if out is None else out.unionByName(met)
    return out


def _occurrences(docs: DataFrame, benchmark: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """rid, at (first word), n, window: where a window of an item occurs in a document, by comparison of the texts."""
    known = checkpoint(windows.select("n", "window").distinct())
    places = _places(docs, checkpoint(_fingerprints(benchmark, text_col)))
    short = _short_places(docs, known)
    places = places if short is None else places.unionByName(short)
    by_row = checkpoint(places.groupBy("rid").agg(F.collect_list(F.struct("n", "at")).alias("places")))
    found = docs.join(joinable(by_row, lists="places"), "rid").select("rid", "places", words(F.col("text")).alias("w"))
    text = F.transform("places", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), F.array_join(F.slice("w", x["at"] + 1, x["n"]), " ").alias("window")))
    spans = found.filter(F.size("w") > 0).select("rid", F.explode_outer(text).alias("x")).select("rid", "x.at", "x.n", "x.window")
    return spans.join(joinable(known, 100_000), ["n", "window"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document row: rid, doc_id, n_words, n_hit, items (sorted ids as strings), contaminated.

    A word is hit if it lies in any occurrence of a window of an item. Null texts have no words; a null item id counts
    as empty text; repeated items count once. Empty tables give no rows, or rows without hits."""
    docs = settled(docs)
    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    windows = checkpoint(benchmark_windows(items, "item", "text"))
    found = checkpoint(_occurrences(rows.select("rid", "text"), items, windows, "text"))
    # words in the union of the spans: each span adds what lies behind the furthest end so far
    span = F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("end"))))
    union = F.aggregate(
        span,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["end"]).alias("end"),
            (acc["words"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["at"]))).alias("words"),
        ),
        lambda acc: acc["words"],
    )
    hit = found.groupBy("rid").agg(union.alias("n_hit"))
    by_item = found.select("rid", "n", "window").distinct().join(windows, ["n", "window"]).select("rid", "item").distinct()
    named = by_item.groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    marks = checkpoint(hit.join(named, "rid"))
    sized = rows.select("rid", "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = sized.join(joinable(marks, lists="items"), "rid", "left")
    return out.select(
        "rid",
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without contaminated documents; all columns stay."""
    docs = settled(docs)
    dropped = checkpoint(contamination(docs, benchmark, id_col, text_col).filter("contaminated").select(F.col("rid").alias("__rid")))
    return with_row_id(docs, "__rid").join(joinable(dropped), "__rid", "left_anti").drop("__rid")
