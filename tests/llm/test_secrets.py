"""Secret scans: held-out accuracy of the forest and defined results on odd rows."""

import numpy as np
import pytest

from labelled_texts import FINDINGS
from tessera.llm import secrets


@pytest.fixture(scope="module")
def model(spark):
    return secrets.fit(spark)


def test_held_out_findings(spark, model):
    from pyspark.ml.functions import array_to_vector

    rows = [(secrets.features(*x[:4]), float(x[4])) for x in secrets.labelled_findings(600, seed=91)]
    table = spark.createDataFrame(rows, "features array<double>, label double").select(array_to_vector("features").alias("features"), "label")
    wrong = model.transform(table).filter("prediction <> label").count()
    assert wrong / len(rows) < 0.03


def test_candidates_in_order_without_overlap():
    text = 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y password: hunter22 z ' + "a" * 40
    spans = secrets.candidates(text)
    assert [text[s:e] for s, e in spans] == ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "hunter22"]


def test_unquoted_assignments_keep_the_value():
    found = lambda text: [text[s:e] for s, e in secrets.candidates(text)]
    assert found("password=Tr0ub4dor&3xyz\n") == ["Tr0ub4dor&3xyz"]
    assert found("x API_KEY=0a1b2c3d4e5f60718293 y SECRET_TOKEN=abc/def+123456789==") == ["0a1b2c3d4e5f60718293", "abc/def+123456789=="]
    assert found("0123456789abcdef0123/password=hunter22") == ["0123456789abcdef0123/", "hunter22"]
    assert found("NAME=0123456789abcdef") == ["NAME=0123456789abcdef"]


def test_covered_share():
    assert secrets.covered_share("default_value") > 0.8 and secrets.covered_share("x7Qp92mLkz") == 0


def test_rows(spark, model):
    hexa = "".join("0123456789abcdef"[i] for i in np.random.default_rng(3).integers(0, 16, 40))
    rows = [
        (1, f'some words token = "{hexa}" more words', "src1", "a"),
        (2, f"some words commit {hexa} more words", "src1", "a"),
        (3, None, None, "a"),
        (4, "", "src1", "a"),
        (None, f'é token = "{hexa}" x', None, "a"),
        (5, "word " * 50_000 + f'secret = "{hexa}"', "src1", "a"),
        (5, "plain text only", "src1", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, value string")
    got = {(r.doc_id, r.secret): r for r in secrets.scan(docs, model).collect()}
    assert set(got) == {(1, True), (2, False), (None, True), (5, True)}
    assert (got[1, True].start, got[1, True].value) == (20, hexa) and got[None, True].start == 11
    assert secrets.scan(docs.limit(0), model).count() == 0


def test_findings_marked_by_hand(spark):
    """Lines that the rule of the labelled table did not make; the figures are in the README."""
    model = secrets.fit(spark)
    docs = spark.createDataFrame([(i, f"first line\n{text}\nlast line", path) for i, (text, _, path, _) in enumerate(FINDINGS)], "doc_id long, text string, source string")
    got = {(r.doc_id, r.value): r.secret for r in secrets.scan(docs, model).collect()}
    found = [(got.get((i, value), False), bool(label)) for i, (_, value, _, label) in enumerate(FINDINGS)]
    good, wrong, missed = (sum(x == y for x in found) for y in ((True, True), (True, False), (False, True)))
    print(good, wrong, missed, [FINDINGS[i][0] for i, (a, b) in enumerate(found) if a != b])
    assert good / (good + missed) >= 0.7 and good / (good + wrong) >= 0.7
