import itertools
import random
import time

from hybridlake.llm.doc_pairs import assign, documented, matched, one_per_node, pairs

DOC = "Returns the sum that was computed by the last caller."


def told(body, sig="def f(a):", doc=None, name="f"):
    found = documented(body, name, sig, doc)
    return found and found[0]


def test_places():
    for body, sig in (
        (f'def f(a):\n    """{DOC}"""\n    return a', "def f(a):"), (f"# {DOC}\r\ndef f(a):\r\n    return a", "def f(a):"), (f"/**\n * {DOC}\n *\n * @param a x\n */\nint f(int a) {{ }}", "int f(int a)"),
        (f"/// <summary>\n/// {DOC}\n/// </summary>\nint f(int a) {{ }}", "int f(int a)"), (f"/* @param a the x @return y {DOC} */\nint f(int a) {{}}", "int f(int a)"), (f"// {DOC}\n@Override\nint f(int a) {{}}", "int f(int a)"),
    ):
        assert told(body, sig) == DOC, body
    assert told("def f(a): pass", doc=DOC) == DOC
    assert told("// TODO: rename.\n// " + DOC + "\nint f() {}", "int f()") == DOC


def test_elsewhere_is_no_documentation():
    for body in (f"def f(a):\n    x = 1\n    # {DOC}\n    return x", f"def f(a):\n    return a\n# {DOC}", f'def f(a):\n    x = 1\n    """{DOC}"""', f"def f(a):\n    # {DOC}\n    def g():\n        pass", f"# {DOC}\nx = 1\ndef f(a):\n    pass"):
        assert told(body) is None, body


def test_tells_nothing():
    for doc in (
        None, "", " \t ", "F.", "The f function.", "TODO: write documentation for this function", "See base class.", "{@inheritDoc}", "Overrides the method of the parent class.", "Auto-generated method stub", "Copyright 2019 the makers of this file, all of it.",
        "Licence: see terms. All rights in this code remain ours.", ":param a: the first value of it\n:return: nothing", "x = call(a, b)[4];", "if (a > 3) {\n    return b;\n}", "=====", "Three words only", "추후 작성", "Documentation missing for this method as of now", "Placeholder docstring, to be filled in later",
    ):
        assert told("def f(a):\n    pass", doc=doc) is None, doc
    assert told(None, doc=DOC) is None and told(" \n", doc=DOC) is None
    assert told("def load_user_cache():\n    pass", "def load_user_cache():", "Load user cache.", "load_user_cache") is None


def test_assignment_is_best():
    r = random.Random(2)
    for _ in range(60):
        n, m = r.randint(1, 4), r.randint(1, 5)
        w = [[r.choice([0.0, r.random()]) for _ in range(m)] for _ in range(n)]
        best = max(sum(w[i][c] for i, c in enumerate(p) if c < m) for p in itertools.permutations(range(max(n, m)), n))
        got = assign(w)
        used = [c for c in got if c >= 0]
        assert len(set(used)) == len(used) and abs(sum(w[i][c] for i, c in enumerate(got) if c >= 0) - best) < 1e-9


def test_sparse_assignment_is_the_dense_one():
    r = random.Random(4)
    for _ in range(200):
        n, m = r.randint(1, 5), r.randint(1, 6)
        w = [[r.choice([0.0, 0.0, r.random()]) for _ in range(m)] for _ in range(n)]
        assert matched({i: {j: x for j, x in enumerate(row) if x} for i, row in enumerate(w)}, 0) == assign(w)[0]


def test_many_comments_take_no_quadratic_time():
    start = time.time()
    body = f"# {DOC}\ndef f(a):\n" + "".join(f"    # {DOC}\n    a += {i}\n" for i in range(20_000))
    assert told(body) == DOC
    inner = "".join(f"    # {DOC}\n    def g{i}(b):\n        return b\n" for i in range(3_000))
    assert told(f"def f(a):\n{inner}") is None
    assert time.time() - start < 8


def test_operator(spark):
    rows = [("1", "function", "f", "def f():", DOC, "def f(): pass", 1), ("1", "function", "f", "def f():", DOC, "def f(): pass", 2), ("2", "class", "C", None, DOC, "class C: pass", 1), ("3", "method", None, None, None, None, 1), ("4", "method", None, None, DOC, "x" * 100_000, 1)]
    df = spark.createDataFrame(rows, "id string, type string, name string, signature string, docstring string, raw_body string, description int")
    got = {r.node_id: r.description for r in one_per_node(pairs(df)).collect()}
    assert got == {"1": DOC, "4": DOC}
    assert pairs(df.limit(0)).count() == 0
