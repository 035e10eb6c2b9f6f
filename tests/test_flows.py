"""Index, question and training flows over small source trees, and streaming against batch."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import code, embedding, retriever, search, store, strategies, training
from tessera.plans import samples
from tessera.sources import files
from tessera.streaming import ingest


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    for path, text, *_ in [*samples.JAVA, *samples.OTHER, *samples.TEMPLATES, *samples.MARKDOWN]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")
    (root / "tools/bad.py").write_bytes(b"x = '\xff\xfe'")
    (root / "docs/notes.txt").write_text("one\n# two\nthree\n# four\nfive")
    (root / "tools/other.md").write_text("# not\na\nb\nc")
    (root / "tools/other.json").write_text("{}")
    return str(root)


@pytest.fixture(scope="module")
def indexed(spark, tree, tmp_path_factory):
    s = store.ChunkStore(spark, str(tmp_path_factory.mktemp("store")), dims=64)
    counts = {(r.language, r.chunk_type): r.n for r in retriever.index(spark, tree, s, reset=True).collect()}
    return s, counts


def test_scan_skips_files_that_are_no_text(spark, tree):
    assert {r.path.rsplit("/", 1)[1] for r in files.code_files(spark, tree).select("path").collect()} == {"tool.py", "client.ts", "pool.go"}


def test_index_counts(indexed):
    _, counts = indexed
    assert counts[("java", "class")] == 5 and counts[("java", "enum")] == 1 and counts[("json", "template")] == 3 and counts[("markdown", "document")] == 1


def test_index_again_keeps_ids_and_creation_time(spark, tree, indexed):
    s, _ = indexed
    before = {r.id: r.created_at for r in s.read().select("id", "created_at").collect()}
    retriever.index(spark, tree, s)
    assert {r.id: r.created_at for r in s.read().select("id", "created_at").collect()} == before
    assert s.read().select("id").distinct().count() == s.read().count()


def test_questions(indexed):
    s, _ = indexed
    r = retriever.Retriever(s.read().cache(), dims=64, generate=lambda p: f"{len(p)} characters")
    a = r.query("How does OrderService handle a missing order?", min_similarity=0.0)
    first = a.sources.orderBy("rank").first()
    assert a.analysis["intent"] == "explanation" and first.class_name == "OrderService" and first.score == 1.0
    assert {d.class_name for d in a.dependencies.collect()} <= {"Invoice", "OrderDao"} and "Snippet 1" in a.prompt and a.answer.endswith("characters")
    listed = r.query("List all classes")
    assert listed.context.splitlines()[0].startswith("1. ") and listed.sources.count() == 7
    enum = r.query("Which values does the OrderService enum have?", min_similarity=0.0)
    assert enum.sources.orderBy("rank").first().class_name == "OrderService.State"
    schema = r.query("What fields does Invoice have?", min_similarity=0.0)
    assert {x.class_name for x in schema.sources.collect()} == {"Invoice"}
    legs = {(x.leg, x.class_name) for x in r.class_with_context("OrderDao").collect()}
    assert ("self", "OrderDao") in legs and ("referenced", "Invoice") in legs and ("referencing", "OrderService") in legs
    assert r.template_dependencies("templates/list.json").count() >= 1
    assert r.retrieve_only("invoice", 3).count() == 3
    c = retriever.Conversation(r, max_history=1)
    c.ask("What is OrderDao?", min_similarity=0.0)
    assert c.ask("and who uses it?", min_similarity=0.0).question.startswith("Previous conversation:") and len(c.turns) == 2


def test_deletes(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "s"), dims=2)
    s.create()
    rows = [(str(i), f"a{i % 2}/f{i}", [1.0, 0.0], i) for i in range(6)]
    columns = "id string, file_path string, embedding array<float>, seq int"
    wide = spark.createDataFrame(rows, columns)
    for name, kind in (x.split(" ") for x in store.CHUNK_SCHEMA.split(", ")):
        if name not in wide.columns:
            wide = wide.withColumn(name, F.lit("x").cast(kind) if name in ("content", "language", "chunk_type") else F.lit(None).cast(kind))
    s.upsert(wide)
    assert not s.is_empty() and s.delete_by_prefix("a1/") == 3 and s.delete_by_prefix("a1/") == 0
    assert s.delete_by_file("a0/f0") == 1
    assert sorted(r.id for r in s.read().collect()) == ["2", "4"]
    with pytest.raises(Exception, match="dimensions"):
        s.upsert(wide.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
        s.read().count()
    s.drop()
    s.drop()
    assert not (tmp_path / "s").exists()
    got = {r.path: (r.found, r.bytes) for r in files.sizes(spark, [str(tmp_path / "x"), "/nowhere/y", "/root/testdata/sf0.001/nation.parquet"]).collect()}
    assert got[str(tmp_path / "x")] == (False, None) and got["/nowhere/y"] == (False, None) and got["/root/testdata/sf0.001/nation.parquet"][0]


def test_documents_and_templates_have_their_folders(spark, tree):
    chunks = {(r.file_path, r.language, r.chunk_type) for r in retriever.scan(spark, tree).collect()}
    assert ("docs/notes.txt", "text", "document") in chunks and ("docs/guide.md", "markdown", "document") in chunks
    assert not any(p.startswith("tools/other") for p, _, _ in chunks)


def test_dispatch(indexed, spark):
    s, _ = indexed
    chunks = s.read().cache()
    with pytest.raises(ValueError, match="nothing is indexed"):
        retriever.dispatch(chunks.limit(0), question="x")
    with pytest.raises(ValueError, match="give a question"):
        retriever.dispatch(chunks)
    assert {r.leg for r in retriever.dispatch(chunks, class_name="OrderDao", dims=64).collect()} == {"self", "referenced", "referencing"}
    assert retriever.dispatch(chunks, template="templates/list.json", dims=64).count() >= 1
    found = retriever.dispatch(chunks, question="invoice", retrieve_only=True, top_k=3, dims=64).collect()
    assert len(found) == 3 and all(len(r.preview) <= 1003 and ":" in r.place for r in found)
    assert retriever.dispatch(chunks, question="How many java classes are there?", dims=64).sources.count() == 5
    asked = retriever.Session(retriever.Retriever(chunks, dims=64))
    assert asked.ask(" ") is None and {r.chunk_type for r in asked.ask("class of invoices", min_similarity=0.0).sources.collect()} == {"class"} and not asked.turns
    asked.ask("orders", min_similarity=0.0)
    assert len(asked.turns) == 2


def test_groups_and_parts_of_names(indexed):
    s, _ = indexed
    groups = {r.group: r for r in store.names_by(s.read(), "language").collect()}
    assert groups["java"].n == sum(n for (language, _), n in indexed[1].items() if language == "java") and groups["java"].first == sorted(groups["java"].first)
    like = store.chunks_like(s.read(), "Service.State").collect()
    assert {(r.class_name, r.parent_class) for r in like} == {("OrderService.State", "OrderService")}
    assert {r.file_path for r in store.chunks_like(s.read(), "OrderDao.java").collect()} == {"java/shop/OrderDao.java"}


def test_extractor_options(spark):
    java = spark.createDataFrame(samples.JAVA, "path string, text string")
    bare = code.java_types(java, include_comments=False, include_imports=False).collect()
    assert all(r.documentation is None and not r.imports and all(m.documentation is None for m in r.methods) for r in bare)
    broken = "package a;\npublic class Good {\n  int x;\n  void f() { }\n}\nclass Bad { void g( { }\n"
    assert "Good" in {r.name for r in code.java_types(spark.createDataFrame([("b.java", broken)], "path string, text string")).collect()}


def test_recall_of_cells(spark):
    """Clustered vectors, a hundred lists of which a quarter is probed, several parts a cell and blocks of questions."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(150, 16))
    rows = [(i, [float(v) for v in centre[i % 150] + rng.normal(size=16) * 0.7]) for i in range(6000)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    asked = v.filter("vec_id % 50 = 0")
    celled, centres = store.build_cells(v, lists=100)
    near = store.search_cells(celled, centres, asked, 10, at_once=60, part_rows=40).select("qid", "id")
    exact = search.vector_topk_many(v, asked, 10).select("qid", "id")
    assert celled.count() == 6000 and near.count() == 1200 and exact.join(near, ["qid", "id"]).count() / 1200 >= 0.9


def test_recall_of_registered_cells(spark):
    from tessera.plans import retrieval

    assert retrieval.ann_cells(spark, "/root/testdata/sf0.01").agg(F.avg(F.col("found").cast("int"))).first()[0] >= 0.9


def test_deletes_of_nothing(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path / "s"), dims=2)
    s.create()
    assert s.is_empty() and s.delete_by_file("x") == 0


def test_prepare(spark, tree, tmp_path):
    for name in strategies.STRATEGIES:
        counts = {r.split: r.n for r in retriever.prepare(spark, tree, str(tmp_path / name), name, share=0.3).collect()}
        train = files.jsonl(spark, str(tmp_path / name / "train"))
        assert train.count() == counts["train"]
        assert training.prompts(train).count() == counts["train"]
        record = json.loads(train.first()[0])
        assert record["contents"][0]["role"] == "user" and record["systemInstruction"]["parts"][0]["text"]
    with pytest.raises(ValueError, match="unknown strategy"):
        retriever.prepare(spark, tree, str(tmp_path / "x"), "poems")
    counts = {r.part: r.n for r in retriever.prepare_templates(spark, tree + "/java", tree + "/templates", str(tmp_path / "t"), share=0.0).collect()}
    assert counts == {"paired": 3, "inferred": 1}


def test_matching_equals_choosing_one_by_one(spark):
    import random

    rnd = random.Random(1)
    for _ in range(3):
        classes, templates = [f"C{i}" for i in range(8)], [f"t{i}" for i in range(10)] + ["C1"]
        refs = {t: rnd.sample(classes, rnd.randrange(0, 5)) for t in templates}
        taken, expected = {"C0", "C1"}, {("C0", "t3", "manual"), ("C1", "C1", "exact")}
        for t in sorted(templates):
            if t not in ("t3", "C1") and (c := next((c for c in refs[t] if c not in taken), None)):
                taken.add(c)
                expected.add((c, t, "reference"))
        got = training.tiered_match(
            spark.createDataFrame([(c,) for c in classes], "name string"), spark.createDataFrame([(t,) for t in templates], "template string"),
            spark.createDataFrame([(t, i, c) for t, cs in refs.items() for i, c in enumerate(cs)], "template string, pos int, name string"), spark.createDataFrame([("C0", "t3"), ("nobody", "t4")], "name string, template string"),
        )
        assert {tuple(r) for r in got.select("name", "template", "tier").collect()} == expected


def test_java_declarations(spark):
    types = {r.name: r for r in code.java_types(spark.createDataFrame(samples.JAVA, "path string, text string")).collect()}
    o = types["OrderService"]
    assert [f.name for f in o.fields] == ["dao", "open", "done", "TEXT"] and [m.name for m in o.methods] == ["OrderService", "processOrder", "getOrder", "close"]
    assert o.documentation.startswith("/**") and o.annotations == ["@Component"] and o.extends == "BaseService" and o["implements"] == ["OrderApi", "ChangeListener"]
    process = o.methods[1]
    assert process.return_type == "Invoice" and [(p.type, p.name) for p in process.parameters] == [("Order", "order"), ("int", "amount")] and process.annotations == ["@Override"] and "Processes" in process.documentation and process.body.rstrip().endswith("}")
    assert [f.name for f in types["Invoice"].fields] == ["order", "amount", "a", "b"] and types["State"].parent == o.number and [m.name for m in types["State"].methods] == ["State", "isOpen"]
    public = code.java_types(spark.createDataFrame(samples.JAVA, "path string, text string"), include_private=False).filter("name = 'OrderService'").first()
    assert [f.name for f in public.fields] == ["TEXT"]


def test_embedding_failures_stay_on_their_rows(spark):
    def model(texts, dims):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[float(len(t))] * dims for t in texts]

    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None), (4, "x" * 100), (5, "fine")], "id int, text string").coalesce(1)
    got = {r.id: (r.embedding, r.reason) for r in embedding.embed(rows, "text", 2, model, most_tokens=40).collect()}
    assert got == {1: ([2.0, 2.0], None), 2: (None, "failed: no"), 3: (None, "no text"), 4: (None, "too many tokens"), 5: ([4.0, 4.0], None)}


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "e"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    q = ingest.windows(ingest.read(spark, str(tmp_path / "e"), schema), "6 hours").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.start, r.event_type)
    assert sorted(spark.table("w").collect(), key=key) == sorted(ingest.windows(events, "6 hours").collect(), key=key)
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    turns.coalesce(1).write.parquet(str(tmp_path / "t"))
    q = ingest.recent_turns(ingest.read(spark, str(tmp_path / "t"), "conv_id long, turn long, role string, text string"), 1).writeStream.format("memory").queryName("t").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.conv_id, r.turn): r.history for r in spark.table("t").collect()}
    held = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        held[r.conv_id] = [*held.get(r.conv_id, []), f"{r.role}: {r.text}"][-2:]
        assert got[(r.conv_id, r.turn)] == "\n".join(held[r.conv_id])


def test_evaluate(spark):
    prompts = spark.createDataFrame([("a", "x y"), ("b", "x"), ("boom", "z")], "prompt string, expected string")

    def generate(p):
        if p == "boom":
            raise RuntimeError("down")
        return "x y z"

    got = {r.prompt: (r.success, r.similarity, r.error) for r in retriever.evaluate(prompts, generate).collect()}
    assert got == {"a": (True, 0.666667, None), "b": (True, 0.333333, None), "boom": (False, None, "down")}


def test_one_file_by_its_suffix(spark, tree):
    whole = {r.id: r for r in retriever.scan(spark, tree).collect()}
    some = next(r.file_path for r in whole.values() if r.chunk_type == "class")
    java = retriever.scan_file(spark, f"{tree}/{some}", tree).collect()
    assert java and {r.id for r in java} == {r.id for r in whole.values() if r.file_path == some}
    tool = retriever.scan_file(spark, f"{tree}/tools/tool.py", tree).collect()
    assert {r.id for r in tool} == {r.id for r in whole.values() if r.file_path == "tools/tool.py"} and {r.file_path for r in retriever.scan_file(spark, f"{tree}/tools/tool.py").collect()} <= {"tool.py"}
    assert retriever.scan_file(spark, f"{tree}/docs/notes.txt").count() == 0 and retriever.scan_file(spark, f"{tree}/tools/bad.py").count() == 0


def test_durations(spark):
    from tessera.functions.text import duration_seconds, duration_text

    rows = spark.sql("SELECT timestamp_ntz'2024-03-30 23:30:00' AS a, timestamp_ntz'2024-04-01 01:31:02.5' AS b UNION ALL SELECT timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 00:00:59.9' UNION ALL SELECT null, timestamp_ntz'2024-01-01 00:00:00'")
    seconds = duration_seconds(F.col("a"), F.col("b"))
    assert [tuple(r) for r in rows.select(seconds, duration_text(seconds)).collect()] == [(93662.5, "26h 1m 2s"), (59.9, "0h 0m 59s"), (None, None)]
