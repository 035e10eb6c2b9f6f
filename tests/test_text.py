"""Text expressions against Python."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import analyze, text
from tessera.operators import batches, search

ODD = st.text(alphabet=st.sampled_from(list("ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x85  é#")), max_size=20)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ODD, min_size=40, max_size=60))
def test_splitlines(spark, texts):
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.splitlines(F.col("t")).alias("l")).collect()
    assert {r.i: r.l for r in got} == {i: t.splitlines() for i, t in enumerate(texts)}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 20), min_size=1, max_size=60))
def test_batches_hold_their_limits_in_order(spark, tokens):
    rows = spark.createDataFrame([("g", i, t) for i, t in enumerate(tokens)], "g string, i long, t long")
    got = [(r.i, r.batch) for r in batches.batch_pack(rows, ["g"], "i", "t", most_tokens=30, most_items=4).orderBy("i").collect()]
    expected, batch, total, n = [], 0, 0, 0
    for i, t in enumerate(tokens):
        if n and (total + t > 30 or n >= 4):
            batch, total, n = batch + 1, 0, 0
        total, n = total + t, n + 1
        expected.append((i, batch))
    assert got == expected


def test_fusion_does_not_depend_on_labels(spark):
    a = spark.createDataFrame([(i, 1 - i / 10) for i in range(5)], "id long, similarity double")
    b = spark.createDataFrame([(i, 1 - i / 20) for i in range(3, 9)], "id long, relevance double")
    moved = lambda d: d.withColumn("id", F.col("id") + 100)
    one = [(r.id, r.score, r.rank) for r in search.fuse(a, b, 6).orderBy("rank").collect()]
    two = [(r.id - 100, r.score, r.rank) for r in search.fuse(moved(a), moved(b), 6).orderBy("rank").collect()]
    assert one == two and one[0][1] == 1.0 and all(0 <= s <= 1 for _, s, _ in one)


def test_keywords_keep_first_spelling(spark):
    q = spark.createDataFrame([("OrderDao orderdao loadOrder Loadorder find ORDERDAO",)], "q string")
    found = q.select(analyze.search_keywords(F.col("q")).alias("k")).first().k
    assert found[0] == "OrderDao" and len({k.lower() for k in found}) == len(found)


def test_identifiers(spark):
    one = spark.createDataFrame([("List<String[]>", "findOrderById", "/**\n * Finds it.\n * @param id the id\n */")], "t string, n string, d string")
    r = one.select(text.base_type(F.col("t")).alias("t"), text.split_camel(F.col("n")).alias("n"), text.clean_javadoc(F.col("d")).alias("d")).first()
    assert (r.t, r.n, r.d) == ("List", "find order by id", "Finds it. the id")


def test_blocks_of_questions(spark):
    """Several blocks give what one gives; zero vectors are left out."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(60, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    questions = vectors.filter("vec_id < 20")
    one, many = (sorted(map(tuple, search.vector_topk_many(vectors, questions, 3, at_once=n).collect())) for n in (100, 4))
    assert one == many and len(one) == 60 and all(r[1] == r[0] for r in one if r[3] == 1)
    assert search.vector_topk_many(vectors, questions.limit(0), 3).count() == 0
