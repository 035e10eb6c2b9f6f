"""Decontamination against brute force, with short items, repeats and nulls."""

import random
import re

from tessera.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            b = words(item)
            n = min(10, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add("" if item_id is None else str(item_id))
        out.append((str(doc_id), len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out)


def got(spark, docs, items):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in dc.contamination(d, b).collect())


def test_random_texts(spark):
    rnd = random.Random(8)
    for _ in range(2):
        vocabulary = ["a", "b", "É", "é", "X1", "c-d"]
        text = lambda n: rnd.choice([" ", ", "]).join(rnd.choice(vocabulary) for _ in range(n))  # noqa: E731, B023
        items = [(i, text(rnd.choice([0, 1, 4, 9, 10, 11, 14, 25]))) for i in range(12)] + [(3, text(12)), (None, text(12)), (99, None)]
        docs = [(i, text(rnd.randrange(0, 30))) for i in range(20)]
        for i in range(20, 45):  # with parts of items, of all lengths around the window
            w = (rnd.choice(items)[1] or "").split(" ")
            k = rnd.randrange(0, max(1, len(w)))
            docs.append((i, text(3) + " " + " ".join(w[k : k + rnd.choice([5, 9, 10, 11, 20])]).upper() + " " + text(3)))
        docs += [(None, items[-2][1]), (50, None), (50, ""), (50, items[-2][1])]
        assert got(spark, docs, items) == brute(docs, items)


def test_long_text_and_empty_tables(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = [(1, "w x y z " * 20_000 + item + " tail " * 10), (2, item.replace("q5", "other")), (3, item)]
    assert got(spark, docs, [(7, item)]) == brute(docs, [(7, item)])
    assert got(spark, docs, []) == brute(docs, [])
    assert got(spark, [], [(7, item)]) == []
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert [r.doc_id for r in dc.drop_contaminated(d, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [2]
