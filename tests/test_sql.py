"""The library from SQL against its column functions and DataFrame forms."""

from pyspark.sql import functions as F

from tessera.functions import analyze, text
from tessera.operators import code, sql, strategies
from tessera.plans import samples

QUESTIONS = [
    "What is OrderService?", "List all classes that use getOrder and saveOrder", "How does the Invoice table differ from Order", "what's a DAO", "  Where is processOrder called?  ", "compare A Bb Cc and getX",
    "", None, "Élan vital of naïve Types", "the and of it", "find order order Order items in stock with many other words that are longer than the limit of ten words allows here",
]


def test_functions_equal_the_column_functions(spark):
    sql.register(spark)
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(QUESTIONS)], "i int, q string")
    q = F.col("q")
    want = asked.select("i", analyze.intent(q).alias("intent"), analyze.class_names(q).alias("classes"), analyze.method_names(q).alias("methods"), analyze.primary_terms(q).alias("terms"), text.token_estimate(q).alias("tokens"), text.jaccard(q, F.lit("the order of List")).alias("same"))
    got = spark.sql("SELECT i, question_intent(q) AS intent, question_classes(q) AS classes, question_methods(q) AS methods, question_terms(q) AS terms, token_estimate(q) AS tokens, word_jaccard(q, 'the order of List') AS same FROM {asked}", asked=asked)
    assert sorted(got.collect()) == sorted(want.collect())
    names = spark.createDataFrame([("List<Order>", "a/B.java"), ("int[]", None), (None, "x")], "t string, p string")
    want = names.select(text.base_type(F.col("t")).alias("t"), text.chunk_id(F.col("p"), F.col("t"), F.lit("class")).alias("id")).collect()
    assert spark.sql("SELECT plain_type(t) AS t, chunk_key(p, t, 'class') AS id FROM {names}", names=names).collect() == want


def test_types_by_lateral_calls(spark):
    sql.register(spark)
    files = spark.createDataFrame([(p, t) for p, t, *_ in samples.JAVA] + [("none.java", None), ("empty.java", ""), ("long.java", "class Long {}\n" * 10_001)], "path string, text string")
    got = spark.sql("SELECT f.path, t.* FROM {files} f, LATERAL java_types(f.text) t", files=files)
    want = code.java_types(files.filter("text IS NOT NULL"))
    assert got.columns == want.columns
    key = lambda r: (r.path, r.number)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and want.count() > 5
    assert spark.sql("SELECT count(*) AS n FROM {files} f, LATERAL java_types(f.text, 3) t WHERE f.path <> 'empty.java'", files=files).first().n == 0


def test_strategies_as_views(spark):
    types = code.java_types(spark.createDataFrame([(p, t) for p, t, *_ in samples.JAVA], "path string, text string")).filter("parent = -1")
    sql.register(spark, types)
    for name, strategy in strategies.STRATEGIES.items():
        assert spark.table(f"{name}_examples").count() == strategy(types).count() > 0
