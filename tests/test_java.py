"""The scanner of declarations: generics, documentation, broken files, and its time."""

import time

import pytest

from tessera.functions import java
from tessera.operators import code, strategies
from tessera.plans import code as plans
from tessera.plans import samples


def names(source):
    return [(t["name"], t["parent"], [m["name"] for m in t["methods"]], [f["name"] for f in t["fields"]]) for t in java.types_of(source)]


@pytest.mark.parametrize("head, expected", [
    ("public <T> List<T> f(T a)", ("f", "List", ["T"])),
    ("<T> T g(T a)", ("g", "T", ["T"])),
    ("static <K extends Comparable<? super K>, V> Map<K, List<V>> h(Map<K, V> a, final int b)", ("h", "Map", ["Map", "int"])),
    ("public <E extends Enum<E>> E[] all(Class<E> kind)", ("all", "E[]", ["Class"])),
    ("@Override public Map<String, int[]> plain()", ("plain", "Map", [])),
])
def test_generic_methods(head, expected):
    t = java.types_of(f"class A {{\n  {head} {{ return null; }}\n  int after;\n}}")[0]
    (m,) = t["methods"]
    assert (m["name"], m["return_type"], [p["type"] for p in m["parameters"]]) == expected and [f["name"] for f in t["fields"]] == ["after"]


def test_documentation_belongs_to_the_next_declaration():
    source = "/** of A */\n// line\n@Component(\"x\")\npublic class A {\n  /** of f */\n  void f() { }\n  void g() { }\n  // no\n  /* plain */ void h() { }\n  /** of i */ // and a line\n  @Deprecated int i() { return 1; }\n  String s = \"/** none */\"; int j() { return 2; }\n}\n"
    (t,) = java.types_of(source)
    assert t["documentation"] == "/** of A */" and [m["documentation"] for m in t["methods"]] == ["/** of f */", None, None, "/** of i */", None] and t["problems"] == 0


def test_records_are_no_methods():
    assert names("class A { record P(int x, int y) { int sum() { return x + y; } } void f() { } }") == [("A", -1, ["f"], [])]


BROKEN = {
    "a brace is missing in a method": ("class A {\n    int x;\n    void f() {\n        if (x) {\n            run();\n    }\n    public void g() { }\n}\nclass B {\n    void h() { }\n}\n", [("A", -1, ["f", "g"], ["x"]), ("B", -1, ["h"], [])]),
    "a brace too many": ("class A {\n    void f() {\n        run();\n        }\n    }\n    public void g() { }\n}\nclass B {\n    int y;\n}\n", [("A", -1, ["f", "g"], []), ("B", -1, [], ["y"])]),
    "a class is never closed": ("public class A {\n    public void f() {\n        run();\npublic class B {\n    private int y;\n}\n", [("A", -1, ["f"], []), ("B", -1, [], ["y"])]),
    "the end is missing": ("class A {\n  static class In {\n    int a;\n  }\n  void f() {\n    run();\n", [("A", -1, ["f"], []), ("In", 0, [], ["a"])]),
    "a head is cut": ("class A {\n  public void f(int a,\n  public void g() {\n  }\n}}\nenum E { X, Y; int n; }\n", [("A", -1, ["g"], []), ("E", -1, [], ["n"])]),
    "a comment is not closed": ("class A { void f() { } }\n/* class B { }\n", [("A", -1, ["f"], [])]),
}


@pytest.mark.parametrize("what", BROKEN)
def test_broken(what):
    source, expected = BROKEN[what]
    assert names(source) == expected
    assert java.types_of(source)[0]["problems"] > 0 or "comment" in what


def test_limits_of_broken_files():
    many = "".join(f"import a.b.C{i};\n" for i in range(130))
    late = "\n" * 30 + "package late.one;\n" + many + "class A {\n"
    (t,) = java.types_of(late)
    assert t["package"] == "" and len(t["imports"]) == 100
    (t,) = java.types_of(late + "}\n")
    assert t["package"] == "late.one" and len(t["imports"]) == 130


@pytest.mark.parametrize("broken", [False, True])
def test_time_is_linear(broken):
    def took(methods):
        body = "".join(f"    /** Does {i}. */\n    public int m{i}(int a) {{\n        return a + {i};\n    }}\n\n" for i in range(methods))
        source = "package a;\npublic class Big {\n" + body + ("    void bad( {\n" if broken else "") + "}\n"
        began = time.process_time()
        (t,) = java.types_of(source)
        assert len(t["methods"]) == methods and t["methods"][-1]["documentation"] == f"/** Does {methods - 1}. */"
        return time.process_time() - began

    assert took(2000) < 1.5  # ten thousand lines
    assert took(8000) < 12 * max(took(1000), 0.05)


def test_one_reading_for_all_chunks(spark):
    from tessera.operators import code
    from tessera.plans import samples

    chunks = code.java_chunks(code.java_types(spark.createDataFrame(samples.JAVA, "path string, text string")))
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
    kinds = {(r.chunk_type, r.class_name, r.method_name): r for r in chunks.collect()}
    assert kinds["class", "OrderService", None].references and "// Inner type of: OrderService" in kinds["enum", "OrderService.State", None].content
    assert kinds["method", "OrderService", "processOrder"].content.startswith("// Class: OrderService") and kinds["method", "OrderService", "processOrder"].references == []


def test_one_reading_for_all_blocks(spark, tmp_path):
    from tessera.operators import code

    go = "package p\n\ntype Pool struct {\n  n int\n}\n\nfunc (p *Pool) Get(a int) int {\n  if a > 0 {\n    return 1\n  }\n  return p.n\n}\nfunc open() {\n"
    ts = "/** Client. */\nexport interface Opts {\n  a: number\n}\nexport type Id = string\nexport class Client {\n  get() { return 1 }\n}\nexport async function main() {\n}\n"
    rows = [("a/pool.go", go, "go"), ("b/client.ts", ts, "typescript"), ("c/empty.py", "", "python"), ("d/x.py", '"""Doc."""\nclass A:\n  def f(self):\n    pass\n\n  x = 1\ndef g(a):\n  return a\n', "python"), ("e/y.rb", "class A\nend\n", "ruby")]
    spark.createDataFrame(rows, "path string, text string, language string").write.parquet(str(tmp_path / "f"))
    blocks = code.generic_blocks(spark.read.parquet(str(tmp_path / "f")))
    assert blocks._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = sorted((r.path, r.code_type, r.name, r.start_line, r.end_line) for r in blocks.collect())
    assert got == sorted([
        ("a/pool.go", "module", "pool", 1, 13), ("a/pool.go", "struct", "Pool", 3, 5), ("a/pool.go", "function", "Get", 7, 12), ("a/pool.go", "function", "open", 13, 13),
        ("b/client.ts", "module", "client", 1, 10), ("b/client.ts", "interface", "Opts", 2, 4), ("b/client.ts", "type", "Id", 5, 8), ("b/client.ts", "class", "Client", 6, 8), ("b/client.ts", "function", "main", 9, 10),
        ("c/empty.py", "module", "empty", 1, 0), ("d/x.py", "module", "x", 1, 8), ("d/x.py", "class", "A", 2, 6), ("d/x.py", "function", "g", 7, 8), ("e/y.rb", "module", "y", 1, 2),
    ])
    docs = {r.path: r.documentation for r in blocks.collect() if r.code_type == "module"}
    assert docs["d/x.py"] == "Doc." and docs["b/client.ts"] == "Client." and docs["a/pool.go"] is None


def test_without_texts_and_outer_types(spark):
    """Narrow readings of the same types, and memory that does not follow the batch: types are sent on by size."""
    files = spark.createDataFrame([(p, t) for p, t in samples.JAVA] + [("java/None.java", "int x;"), ("java/Empty.java", "")], "path string, text string").coalesce(1)
    whole, bare = code.java_types(files).collect(), code.java_types(files, texts=False).collect()
    left_out = lambda r: r | {"source_code": None, "documentation": None, "methods": [m | {"body": None, "documentation": None} for m in r["methods"]]}
    assert [left_out(r.asDict(True)) for r in whole] == [r.asDict(True) for r in bare]
    assert [(r.path, r.name) for r in code.outer_types(files).collect()] == [(r.path, r.name) for r in whole if r.parent < 0]
    batch = ["a", "b", "c"], ["x" * code.STEP_CHARS, "y\n" * 10, "z"]
    assert [p for p, _ in code._steps(*batch, 10)] == [["a"], ["b", "c"]] and [p for p, _ in code._steps(*batch, 9)] == [["a"], ["c"]]
    assert code.outer_types(spark.createDataFrame([("a", None), ("b", "class B { }")], "path string, text string")).collect() == [("b", "B")]


def scans(df):
    """How often the types are made in the plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapIn")


def test_types_are_made_once(spark):
    types = code.java_types(spark.createDataFrame(samples.JAVA, "path string, text string"))
    assert {name: scans(strategies.convert(types, name)) for name in strategies.STRATEGIES} == dict.fromkeys(strategies.STRATEGIES, 1)
    assert scans(plans.unpaired_classes(spark, "/root/testdata/sf0.001").select("name").distinct()) == scans(plans._outer(spark, "/root/testdata/sf0.001")) == 0  # from the kept names
