import random

from hybridlake.llm import code_origin
from hybridlake.llm.code_origin import head_notice, is_data, is_packed, winnow

NODE = "file_path string, workspace_id string, type string, raw_body string, docstring string, path string, repo string"


def body(seed, n=60):
    r = random.Random(seed)
    return "def f():\n" + "\n".join(f"    {r.choice('abcdefgh')}{r.randint(0, 999)} = call_{r.randint(0, 999)}({r.choice('xyz')}{r.randint(0, 99)}, {r.randint(0, 9)})" for _ in range(n))


def origins(spark, files, nodes, **kw):
    f = spark.createDataFrame([(p, "clash") for p in files], "file_path string, path string")
    n = spark.createDataFrame([(*x, "clash", "clash") for x in nodes], NODE)
    return {r.file_path: r.origin for r in code_origin.file_origins(f, n, **kw).collect()}


def test_paths_and_lookalikes(spark):
    want = {
        "a/vendor/lib/x.c": "vendored", "a/third_party/x.py": "vendored", "lib/leftpad-1.2.3/x.js": "vendored", "a/gen-src/x.py": "generated", "a/x_pb2.py": "generated", "a/XOuterProto.java": "generated",
        "a/x.min.js": "minified", "a/vendor_portal/x.py": "hand-written", "a/codegen/x.py": "hand-written", "a/minify.py": "hand-written", "a/generated_ids.py": "hand-written", "a/lib/x.py": "hand-written", ".agents/rules/x.md": "hand-written",
    }
    assert origins(spark, [*want, *want, None], []) == want


def test_notices():
    for text in ("# Code generated by foo. DO NOT EDIT.\nx = 1", "/* @generated by foo */ int x;", "// This file was produced automatically from a.b; manual changes will be lost.\n", "// 이 파일은 자동 생성되었습니다.\n", "// Diese Datei wurde von foo erzeugt.\n"):
        assert head_notice(text) == (True, False), text
    for text in ("// Copied verbatim from foo r3\n", "/*! foo v1.2.3 | free */", "# Vendored snapshot of foo@1.2\n", "# Part of the foo library, version 1.2\n"):
        assert head_notice(text) == (False, True), text
    for text in ("# Written by hand, not generated; see notes.\n", "# Generates the table; edit freely.\n", "/** Auto-generated method stub */ int f() {}", 'def f():\n    out.write("# Code generated by x. DO NOT EDIT.")', "# Talks to the vendor.\n", "# Copyright of this workspace.\n", None, ""):
        assert head_notice(text) == (False, False), text


def test_shapes():
    assert is_packed("!function(a){b.c=1}();x&&y(2);" * 20) and not is_packed(body(1)) and not is_packed("")
    assert is_data('X = [["a", 1, 2.5],\n' * 30) and is_data('T = "' + "aGVsbG8" * 60 + '"') and not is_data('Q = "' + "some words of a sentence " * 30 + '"') and not is_data(body(2))


def test_winnowing_finds_shared_passages():
    a, b = body(1, 40), body(2, 40)
    shared = a + "\n" + b
    assert set(winnow(a, 16, 8)) & set(winnow(shared, 16, 8)) and not set(winnow(a, 16, 8)) & set(winnow(b, 16, 8))
    assert set(winnow(a, 16, 8)) == set(winnow(a.replace("    ", "\t").replace("\n", "\n\n") + "  # note", 16, 8))
    assert len(winnow("x", 16, 8)) == 0


def test_copies_across_repositories(spark):
    nodes = [(f"./r{i}\\src\\copy.py", f"w{i}", "function", body(7), None) for i in range(6)] + [(f"r{i}/own.py", f"w{i}", "function", body(100 + i), None) for i in range(6)]
    nodes += nodes[:3] + [("ROOT/r0/null.py", None, "function", None, None), (None, "w", "module", body(7), ""), ("r0/one_repo.py", "w0", "function", body(8), None), ("r0/one_repo2.py", "w0", "function", body(8), None)]
    files = [f"r{i}/src/copy.py" for i in range(6)] + [f"r{i}/own.py" for i in range(6)] + ["r0/null.py", "r0/one_repo.py", "unknown.py"]
    got = origins(spark, files, nodes, least_repos=4)
    assert {k for k, v in got.items() if v == "vendored"} == set(files[:6]) and set(got) == set(files)
    assert origins(spark, [], nodes) == {}


def test_wordings_are_learned_from_marked_files(spark):
    note = "# quux - see quux.example - kept here so that builds work offline\n"
    nodes = [(f"r{i}/vendor/q{i}.py", f"w{i}", "module", note + body(300 + i), None) for i in range(9)]
    nodes += [("r1/src/own_copy.py", "w1", "module", note + body(400), None), ("r2/src/told.py", "w2", "module", body(401), note[2:])]
    nodes += [(f"r{i}/src/mine{i}.py", f"w{i}", "module", "# Part of this workspace; all rights stay with us\n" + body(500 + i), None) for i in range(12)]
    nodes += [(f"r{i}/vendor/n{i}.py", f"w{i}", "module", "# Part of this workspace; all rights stay with us\n" + body(600 + i), None) for i in range(4)]
    got = origins(spark, sorted({n[0] for n in nodes}), nodes)
    assert {k for k, v in got.items() if v == "noticed"} == {"r1/src/own_copy.py", "r2/src/told.py"}
    assert {k for k, v in got.items() if v == "hand-written"} == {f"r{i}/src/mine{i}.py" for i in range(12)}


def test_small_copies_count(spark):
    small = "def f(a, b):\n    return call_one(a, b) + call_two(b, a) - 1"
    nodes = [(f"r{i}/src/c.py", f"w{i}", "function", small, None) for i in range(8)]
    assert set(origins(spark, [n[0] for n in nodes], nodes).values()) == {"vendored"}
