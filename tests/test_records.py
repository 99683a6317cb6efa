import itertools
import random
from collections import deque

from pyspark.sql import functions as F

from hybridlake.functions.embedding import hashing_model, memory_text
from hybridlake.operators import graph, indexing, retrieval, vector
from hybridlake.operators import records as X
from hybridlake.sources import settings


def test_deletions_and_upserts(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "key string, n int")
    left, n = X.delete_keys(df, spark.createDataFrame([("a",), ("a",), ("z",)], "key string"), "key")
    assert {r.n for r in left.collect()} == {2, 3} and n.first().n == 1
    new = spark.createDataFrame([("a", 9), ("a", 8), (None, 7), ("c", 6)], "key string, n int")
    assert sorted(r.n for r in X.upsert_keyed(df, new, "key", [F.col("n")]).collect()) == [2, 3, 6, 7, 8]
    assert X.next_id(df, "n").first()[0] == 4 and X.next_id(df.limit(0), "n").first()[0] == 1
    assert [r.n for r in X.page(df, {"key": None}, [F.col("n")], 1, 1).collect()] == [2]


def test_paths_and_guards(spark):
    paths = {"a/b": True, "../x": False, "a/../../x": False, "a/../b": True, "/etc": False, "C:\\x": False, "": True}
    got = {r.p: r.c for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", X.contained(F.col("p")).alias("c")).collect()}
    assert got == paths
    df = spark.createDataFrame([("ROOT/a/b.py",), ("c.py",), (None,)], "p string")
    assert [r[0] for r in df.select(X.rooted(F.col("p"), "/w")).collect()] == ["/w/a/b.py", "c.py", None]
    assert [r[0] for r in df.select(X.unrooted(X.rooted(F.col("p"), "/w"), "/w")).collect()] == ["ROOT/a/b.py", "c.py", None]
    shown = spark.createDataFrame([("one two three Harbor's four " + "x " * 50,), ("none",), (None,), ("",)], "t string").select(X.highlighted(F.col("t"), ["harb"], around=4)).collect()
    assert [r[0] for r in shown] == ["...two three >>>Harbor's<<< four...", None, None, None]
    assert [r[0] for r in spark.createDataFrame([('["a","b"]',), ("bad",), (None,)], "t string").select(F.size(X.json_list(F.col("t")))).collect()] == [2, 0, 0]


def brute_betweenness(edges):
    ids = sorted({v for e in edges for v in e})
    near = {v: sorted({b for a, b in edges if a == v and b != v}) for v in ids}
    out = dict.fromkeys(ids, 0.0)
    for s, t in itertools.permutations(ids, 2):
        dist, queue = {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
        if t not in dist:
            continue
        paths, todo = [], [[s]]
        while todo:
            p = todo.pop()
            if p[-1] == t:
                paths.append(p)
                continue
            todo += [[*p, w] for w in near[p[-1]] if dist.get(w) == len(p) and len(p) <= dist[t]]
        for v in {x for p in paths for x in p[1:-1]}:
            out[v] += sum(v in p for p in paths) / len(paths)
    n = len(ids)
    return {v: round(x * 2 / ((n - 1) * (n - 2)), 9) for v, x in out.items()}


def test_betweenness_and_cycles(spark):
    r = random.Random(3)
    edges = [(f"v{r.randint(0, 8)}", f"v{r.randint(0, 8)}") for _ in range(18)]
    df = spark.createDataFrame([*edges, (None, "v1"), ("v1", None)], "src string, dst string")
    assert {x.id: round(x.betweenness, 9) for x in graph.betweenness(df).collect()} == brute_betweenness(edges)
    want = set()
    for n in range(1, 4):
        for p in itertools.permutations(sorted({v for e in edges for v in e}), n):
            if all((p[i], p[(i + 1) % n]) in edges for i in range(n)):
                want.add(tuple(sorted(p)))
    assert {tuple(x.cycle) for x in graph.cycles(df, 3).collect()} == want
    assert graph.cycles(df.limit(0)).count() == 0 and graph.betweenness(df.limit(0)).count() == 0


def test_hybrid_without_vectors_or_terms(spark):
    rows = [("skill::red-box", "skill", "all about boxes", "[]"), ("b", "resource", "red things", None), ("c", None, None, None)]
    m = spark.createDataFrame(rows, "key string, category string, content string, tags string")
    v = vector.embed(m, F.col("key"), memory_text(F.col("category"), F.col("content")), hashing_model)
    both = m.join(v, "key", "left")
    best = retrieval.hybrid(both, "red-box", hashing_model(["red box"])[0].tolist()).collect()
    assert best[0].key == "skill::red-box" and round(best[0].boost, 6) == 0.15
    assert [r.key for r in retrieval.hybrid(both, "red", [], category="Resource").collect()] == ["b"]
    assert retrieval.hybrid(both, "-", []).count() == 0 and retrieval.hybrid(both.limit(0), "red", [1.0] * 64).count() == 0


def test_vector_upsert(spark):
    old = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "key string, vector array<double>")
    new = spark.createDataFrame([("b", [3.0]), ("z", [9.0])], "key string, vector array<double>")
    got = vector.put_vectors(old, new, spark.createDataFrame([("a",), ("b",)], "key string")).collect()
    assert {(r.key, r.vector[0]) for r in got} == {("a", 1.0), ("b", 3.0)}


def test_indexing_replaces_what_changed(spark):
    cache = spark.createDataFrame([("a.py", "1", 5, 1, "w"), ("b.py", "2", 5, 1, "w"), ("gone.py", "3", 5, 1, "w")], "file_path string, hash string, last_indexed_at long, node_count int, workspace_id string")
    first = indexing.index_files(spark.createDataFrame([("a.py", "def f():\n    return g()\n", "1"), ("b.py", "x = 1\n", "2"), ("gone.py", "def h(): pass\n", "3")], "file_path string, source string, hash string"), cache.limit(0), spark.createDataFrame([], "id string, fqn string, file_path string"), spark.createDataFrame([], "source_id string, target_id string, type string"), now=1)
    assert {(r.file_path, r.node_count) for r in first.cache.collect()} == {("a.py", 2), ("b.py", 1), ("gone.py", 2)}
    files = spark.createDataFrame([("a.py", "def k():\n    return 1\n", "9"), ("b.py", "x = 1\n", "2"), ("c.py", "def (", "4")], "file_path string, source string, hash string")
    again = indexing.index_files(files, first.cache, first.nodes, first.edges, now=2, workspace="w")
    assert {(r.file_path, r.status) for r in again.status.collect()} == {("a.py", "updated"), ("b.py", "skipped"), ("c.py", "created"), ("gone.py", "deleted")}
    assert {r.fqn for r in again.nodes.collect()} == {"a.py", "a.py::k", "b.py"} and again.edges.count() == 0
    assert {(r.file_path, r.last_indexed_at, r.node_count) for r in again.cache.collect()} == {("a.py", 2, 2), ("b.py", 1, 1), ("c.py", 2, 0)}


def test_settings_and_catalogue(spark, tmp_path):
    got = settings.merged({"a": [1], "indexing_rules": {"x": ["p", "q"], "y": 1}}, {"a": [2], "indexing_rules": {"x": ["q", "r"], "y": 2}})
    assert got == {"a": [2], "indexing_rules": {"x": ["p", "q", "r"], "y": 2}}
    assert settings.gitignore_globs("# c\n\n/dist/\n*.log\n!keep.log\n") == ["dist", "*.log"]
    for _ in range(3):
        settings.append_rotating(str(tmp_path / "m.md"), "x" * 40, str(tmp_path / "old"), most=60)
    assert (tmp_path / "m.md").read_text() == "x" * 40 and len(list((tmp_path / "old").iterdir())) == 1
    files = spark.createDataFrame([("k/skills/box/SKILL.md", "s"), ("k/rules/a.md", "r"), ("k/rules/deep/b.md", "d"), ("z.md", "z")], "file_path string, source string")
    rows = indexing.catalogue(files, {"rule": "k/rules", "protocol": "k/rules/deep", "skill": "k/skills"}).collect()
    assert {r.key for r in rows} == {"skill::box", "rule::a", "protocol::b", "general::z"}
