"""Training rows: splits, choices, chat format, template matching, evaluation."""

from __future__ import annotations

import math

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import jaccard
from tessera.session import bounded, checkpointed

#: Offers that one task decides in order, and rounds of proposals before that.
OFFERS_AT_ONCE, PROPOSALS = 500_000, 4


def split(rows: DataFrame, key: str, share: float = 0.1, most: int | None = 500) -> DataFrame:
    """Adds ``split``: the rows with the smallest hashed keys validate, a share of all and ``most`` at most; the others train.

    The threshold hash is found where the rows are: counts of hashes by their first three hex digits lead to the one prefix
    it has, and a top-k within that prefix to itself. key: unique."""
    n = rows.count()
    wanted = math.floor(n * share) if most is None else min(math.floor(n * share), most)
    digest = F.sha2(F.col(key).cast("string"), 256)
    if not wanted:
        return rows.withColumn("split", F.lit("train"))
    hashes = rows.select(digest.alias("h"))
    for prefix, count in sorted(hashes.groupBy(F.left("h", F.lit(3)).alias("p")).count().collect()):  # 4096 at most
        if count >= wanted:
            break
        wanted -= count
    edge = hashes.filter(F.startswith("h", F.lit(prefix))).orderBy("h").limit(wanted).agg(F.max("h")).first()[0]
    return rows.withColumn("split", F.when(digest <= edge, "validation").otherwise("train"))


def sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return rows.orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def shuffled(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """All rows in an order that looks random and is the same for the same seed: a range sort by a hash."""
    return rows.orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key)


def chat_record(system: Column, user: Column, model: Column) -> Column:
    """The JSON line of an example."""
    part = lambda role, text: F.struct(F.lit(role).alias("role"), F.array(F.struct(text.alias("text"))).alias("parts"))
    return F.to_json(F.struct(part("system", system).alias("systemInstruction"), F.array(part("user", user), part("model", model)).alias("contents")))


CHAT_SCHEMA = "systemInstruction struct<role:string,parts:array<struct<text:string>>>, contents array<struct<role:string,parts:array<struct<text:string>>>>"


def prompts(records: DataFrame, line: str = "value") -> DataFrame:
    """(prompt, expected) of lines with a user turn and then a model turn; other lines are left out."""
    parsed = records.select(F.from_json(line, CHAT_SCHEMA).alias("r"))
    good = parsed.filter((F.get("r.contents", F.lit(0))["role"] == "user") & (F.get("r.contents", F.lit(1))["role"] == "model"))
    text = lambda i: F.get(F.get("r.contents", F.lit(i))["parts"], F.lit(0))["text"]
    return good.select(text(0).alias("prompt"), text(1).alias("expected"))


def evaluate(pairs: DataFrame) -> DataFrame:
    """pairs: expected, actual (null: failed). Adds success and similarity (null without an expectation)."""
    success = F.col("actual").isNotNull()
    return pairs.withColumn("success", success).withColumn("similarity", F.when(success & F.col("expected").isNotNull(), F.round(jaccard(F.col("expected"), F.col("actual")), 6)))


def summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.round(F.coalesce(F.avg("similarity"), F.lit(0.0)), 6).alias("mean_similarity"),
    )


def compare(base: DataFrame, tuned: DataFrame, key: str = "prompt") -> DataFrame:
    """Answers of two models to the same prompts side by side."""
    return base.select(key, F.col("actual").alias("base")).join(tuned.select(key, F.col("actual").alias("tuned")), key, "full_outer")


def _first_choices(offers: DataFrame) -> DataFrame:
    """The class that each template of a bounded number of offers gets, one after the other in order, in one task."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, served, pairs = set(), None, []
        for b in batches:
            for template, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if template != served and name not in taken:
                    taken.add(name)
                    pairs.append((name, template))
                    served = template
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["name", "keeper"])

    return offers.select("template", "name", "pos").coalesce(1).sortWithinPartitions("template", "pos", "name").mapInArrow(choose, "name string, keeper string")


def serial_choice(offers: DataFrame, at_once: int = OFFERS_AT_ONCE, proposals: int = PROPOSALS) -> DataFrame:
    """offers: template, pos, name. (name, keeper): templates choose in order, each the first class it names that is free.

    First some rounds in which all templates propose at once: each proposes its next class, a class keeps the first template
    that proposes, and refused offers are gone; since all classes prefer the same order, nothing is refused that would be
    taken one by one. What is contested then is decided in stretches of ``at_once`` offers in order of their templates, each in
    one task; its classes leave the offers behind it. So there are never more rounds than offers over ``at_once``, and some."""
    offers = checkpointed(offers)
    for _ in range(proposals):
        best = offers.groupBy("template").agg(F.min(F.struct("pos", "name")).alias("at")).select("template", F.col("at.name").alias("name"))
        taken = best.groupBy("name").agg(F.min("template").alias("keeper"))
        refused = checkpointed(best.join(taken, "name").filter("template <> keeper").select("template", "name"))
        if refused.isEmpty():
            return taken
        offers = checkpointed(offers.join(refused, ["template", "name"], "left_anti"))
    done = []
    while not offers.isEmpty():
        stretch = checkpointed(offers.orderBy("template", "pos", "name").limit(at_once))
        low, high, n = stretch.agg(F.min("template"), F.max("template"), F.count(F.lit(1))).first()
        if n == at_once and low != high:  # the last template may have more offers behind
            stretch = stretch.filter(F.col("template") < high)
            rest = offers.filter(F.col("template") >= high)
        else:  # a single template takes its first free class, wherever its offers are cut
            rest = offers.filter(F.col("template") > high)
        chosen = checkpointed(_first_choices(stretch))
        done.append(chosen)
        offers = checkpointed(rest.join(bounded(chosen.select("name"), at_once), "name", "left_anti"))
    return reduce(DataFrame.unionByName, done) if done else offers.select("name", F.col("template").alias("keeper"))


def tiered_match(classes: DataFrame, templates: DataFrame, references: DataFrame, manual: DataFrame) -> DataFrame:
    """classes: name; templates: template; references: template, pos, name; manual: name, template.

    (name, template, tier): manual pairs first, then templates named like a class, then templates that refer to a class. A
    template is used once. In the last tier templates choose in order: each takes the first class it names that has no pair
    yet, see ``serial_choice``."""
    by_hand = manual.join(classes, "name", "left_semi").join(templates, "template", "left_semi")
    by_hand = by_hand.groupBy("template").agg(F.min("name").alias("name")).select("name", "template", F.lit("manual").alias("tier"))
    left = templates.join(by_hand, "template", "left_anti")
    exact = left.join(classes, left.template == classes.name).select("name", "template", F.lit("exact").alias("tier"))
    paired = by_hand.unionByName(exact)
    open_refs = references.join(left, "template", "left_semi").join(exact, "template", "left_anti").join(classes, "name", "left_semi").join(paired.select("name").distinct(), "name", "left_anti")
    taken = serial_choice(open_refs.groupBy("template", "name").agg(F.min("pos").alias("pos")))
    return paired.unionByName(taken.select("name", F.col("keeper").alias("template"), F.lit("reference").alias("tier")))


def tier_counts(pairs: DataFrame) -> DataFrame:
    """Pairs by tier, also the tiers without any."""
    spark = pairs.sparkSession
    tiers = spark.createDataFrame([("manual",), ("exact",), ("reference",)], "tier string")
    return F.broadcast(tiers).join(pairs.groupBy("tier").agg(F.count(F.lit(1)).alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def file_figures(lines: DataFrame, column: str = "value", bytes_per_token: float = 4.0) -> DataFrame:
    """Examples and tokens estimated from bytes, line ends included."""
    size = F.sum(F.octet_length(column) + 1)
    return lines.agg(F.count(F.lit(1)).alias("examples"), F.floor(F.coalesce(size, F.lit(0)) / bytes_per_token).cast("long").alias("tokens"))
