import time
import uuid

from pyspark.sql import functions as F

from hybridlake.functions.text import uuid5_url
from hybridlake.parsers import brace_source, python_source, registry
from hybridlake.parsers.model import node_id
from hybridlake.parsers.registry import module_of, node_category, parse_files
from hybridlake.sources import workspace

PY = '"""Doc."""\nfrom a.b import C as D\nimport os\n\nclass K(Base):\n    """Kdoc."""\n    async def m(self, x: D) -> int:\n        return helper(x)\n\ndef helper(y):\n    return os.path.join(y)\n'
JAVA = 'package p;\n/** Holds things. */\npublic class Box extends Base implements Runs {\n    // not { a brace\n    /** Gives it. */\n    @Override\n    public int get(int a) { if (a > 1) { return "}".length(); } return a; }\n}\n'
TS = "import { x } from './lib/tool';\nexport class A implements B {\n  run(a: string): void { go(a); }\n}\nexport const f = (n: number): number => {\n  return n;\n};\nfunction g() { return 1; }\n"
CS = "using System.Text;\npublic class C : Base, IThing {\n  public int N { get; set; }\n  public void Go() { Call(1); Call(2); }\n}\n"
C = "/* adds */\nstatic int add(int a, int b)\n{\n  return a + b;\n}\nstruct point { int x; };\n"


def by(parsed):
    return {n["name"]: n for n in parsed.nodes}, {(s, t, k) for s, t, k, *_ in parsed.edges}


def test_python():
    nodes, edges = by(python_source.parse("a/x.py", PY))
    assert {k: v["type"] for k, v in nodes.items()} == {"x": "module", "K": "class", "m": "method", "helper": "function"}
    assert nodes["m"]["fqn"] == "a/x.py::K::m" and nodes["m"]["is_async"] and nodes["m"]["signature"] == "async def m(self, x: D) -> int:" and nodes["K"]["docstring"] == "Kdoc."
    i = {k: v["id"] for k, v in nodes.items()}
    assert {(i["K"], i["m"], "CONTAINS"), (i["m"], "__unresolved__::helper", "CALLS"), (i["m"], "__unresolved_fqn__::a.b.C", "ANNOTATED_WITH"), (i["m"], "__unresolved__::int", "ANNOTATED_WITH"), (i["x"], "__unresolved_fqn__::a.b.C", "IMPORTS"), (i["x"], "__unresolved__::os", "IMPORTS"), (i["helper"], "__unresolved__::join", "CALLS")} == edges
    assert python_source.parse("a.py", "def (").nodes == []


def test_brace_languages():
    nodes, edges = by(brace_source.parse("p/Box.java", JAVA, "java"))
    assert nodes["Box"]["docstring"] == "Holds things." and nodes["get"]["type"] == "method" and nodes["get"]["raw_body"].endswith("return a; }") and (nodes["Box"]["id"], nodes["get"]["id"], "CONTAINS") in edges
    nodes, edges = by(brace_source.parse("t.ts", TS, "typescript"))
    assert {k: v["type"] for k, v in nodes.items()} == {"A": "class", "run": "method", "f": "function", "g": "function"} and (node_id("t.ts"), "__unresolved__::tool", "IMPORTS") in edges and {k for *_, k in edges} == {"IMPORTS", "CONTAINS"}
    nodes, edges = by(brace_source.parse("c.cs", CS, "csharp"))
    assert nodes["N"]["type"] == "property" and (nodes["Go"]["id"], "__unresolved__::Call", "CALLS") in edges and (nodes["C"]["id"], "__unresolved__::Base", "INHERITS") in edges and (nodes["C"]["id"], "__unresolved__::IThing", "IMPLEMENTS") in edges
    nodes, _ = by(brace_source.parse("c.c", C, "c"))
    assert nodes["add"]["docstring"] == "adds" and nodes["point"]["type"] == "struct"
    assert brace_source.parse("e.c", "", "c").nodes and brace_source.parse("e.c", "int f() {", "c").nodes


def test_scan_and_parse(spark, tmp_path):
    for name, text in {"src/x.py": PY, "src/Box.java": JAVA, "node_modules/y.py": PY, "skills/s/SKILL.md": "# S\ntext", ".agents/rules/r.md": "rule", "bad.bin": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = workspace.scan(spark, str(tmp_path), [".py", ".java", ".md"])
    assert {r.file_path for r in files.collect()} == {"src/x.py", "src/Box.java", "skills/s/SKILL.md", ".agents/rules/r.md"}
    nodes, edges = parse_files(files, F.col("file_path"), F.col("source"))
    got = {r.fqn: r.type for r in nodes.collect()}
    assert got["src/x.py::K"] == "class" and got["s::chunk_0"] == "Skill" and edges.count() > 6
    kinds = files.select("file_path", node_category(F.col("file_path")).alias("c"), module_of(F.col("file_path"), {"src/": "main"}).alias("m")).collect()
    assert {(r.c, r.m) for r in kinds} == {("SOURCE", "main"), ("SKILL", "skills"), ("RULE", ".agents")}
    assert workspace.fresh(files, F.current_timestamp(), 1).count() == 4 and workspace.fresh(files, F.current_timestamp(), 0).count() == 0


def test_git_log_and_ids(spark):
    log = workspace.git_log(spark.createDataFrame([("h1|ann|5|first|x",), ("h2|bob|9|second",), ("broken|line",)], "value string"))
    assert [tuple(r) for r in log.orderBy("at").collect()] == [("h1", "ann", 5, "first|x"), ("h2", "bob", 9, "second")]
    hist = workspace.file_history(log, spark.createDataFrame([("h1", "f"), ("h2", "f")], "commit string, file_path string")).collect()
    assert [tuple(r) for r in hist] == [("f", 2, "bob", 9)]
    names = ["", "a/b.py::C", "é漢"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5_url(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in got)


def test_python_edges():
    source = "import os.path\nimport a.b as c\nfrom . import x\nfrom m import _P, Q\ndef f(a: str, b: _P, *, k: Q) -> Q:\n    _hidden()\n    a.run()\n"
    parsed = python_source.parse("p.py", source)
    assert {(t, k) for _, t, k, *_ in parsed.edges} == {
        ("__unresolved__::os", "IMPORTS"), ("__unresolved__::c", "IMPORTS"), ("__unresolved_fqn__::m._P", "IMPORTS"), ("__unresolved_fqn__::m.Q", "IMPORTS"), ("__unresolved__::str", "ANNOTATED_WITH"), ("__unresolved_fqn__::m.Q", "ANNOTATED_WITH"), ("__unresolved__::run", "CALLS"),
    }


def test_csharp_annotations_and_far_comments():
    _, edges = by(brace_source.parse("c.cs", "class C {\n  public Box Go(Lid lid, List<Cup> cups, String s) { return null; }\n}\n", "csharp"))
    assert {t for _, t, k in edges if k == "ANNOTATED_WITH"} == {"__unresolved__::Box", "__unresolved__::Lid", "__unresolved__::Cup"}
    long = "/** " + "Tells a lot. " * 1000 + "*/\nint f(int a) { return a; }\n"
    nodes, _ = by(brace_source.parse("c.c", long, "c"))
    assert len(nodes["f"]["docstring"]) > 12_000
    wide = "class C extends " + ", ".join(f"Base{i}" for i in range(200)) + " { int f(int a) throws " + ", ".join(f"E{i}" for i in range(200)) + " { return a; } }"
    assert "f" in by(brace_source.parse("c.java", wide, "java"))[0]


def test_long_files_take_linear_time():
    start = time.time()
    brace_source.parse("big.ts", "".join(f"// Says {i}.\nfunction f{i}(a: number) {{\n  return g{i}(a);\n}}\n\n" for i in range(10_000)), "typescript")
    python_source.parse("big.py", "".join(f"def f{i}(a):\n    b = g{i}(a)\n    return h{i}(b)\n\n\n" for i in range(10_000)))
    assert time.time() - start < 40


def test_names_without_arrows_and_deep_expressions():
    start = time.time()
    nodes, _ = by(brace_source.parse("a.ts", "const a = 1;\n" + "x: y,\n" * 20_000 + "\nconst f = async (n: number): Promise<void>  => {\n  go(n);\n}\n", "typescript"))
    assert list(nodes) == ["f"] and time.time() - start < 5
    nodes, edges = by(python_source.parse("d.py", "def f():\n    if a:\n        import os\n        def g(): pass\n    return " + " + ".join(["h(1)"] * 600) + "\n"))
    assert set(nodes) == {"d", "f", "g"} and {(t, k) for _, t, k in edges} == {("__unresolved__::h", "CALLS"), ("__unresolved__::os", "IMPORTS")}


def test_many_small_files_make_few_frames(spark, monkeypatch):
    frames = []
    files = spark.createDataFrame([("a.py", PY)], "path string, source string")
    batch = registry.pd.DataFrame({"path": [f"{i}.py" for i in range(500)], "source": [PY] * 500})
    monkeypatch.setattr(type(files), "mapInPandas", lambda df, run, schema: frames.append(list(run(iter([batch])))))
    parse_files(files, F.col("path"), F.col("source"))
    nodes, edges = frames
    assert [len(x) for x in nodes] == [2000] and [len(x) for x in edges] == [3500]
