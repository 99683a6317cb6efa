import random
from collections import Counter

from hybridlake.operators import graph
from hybridlake.plans import store_queries


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def reach(pairs):
    out = {v: {v} for p in pairs for v in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            for v in out:
                if a in out[v] and b not in out[v]:
                    out[v].add(b)
                    changed = True
    return out


def test_components_and_strong_components(spark):
    r = random.Random(4)
    pairs = [(f"n{r.randint(0, 14)}", f"n{r.randint(0, 14)}") for _ in range(16)] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x")]
    far = reach(pairs)
    strong = {v: min(u for u in far if u in far[v] and v in far[u]) for v in far}
    assert {tuple(x) for x in graph.strong_components(edges(spark, pairs)).collect()} == set(strong.items())
    both = reach(pairs + [(b, a) for a, b in pairs])
    weak = {v: min(both[v]) for v in both}
    assert {tuple(x) for x in graph.connected_components(edges(spark, pairs)).collect()} == set(weak.items())


def test_empty_graph_and_nulls(spark):
    none = edges(spark, [(None, "a"), ("a", None)])
    assert graph.connected_components(none).count() == 0
    assert graph.pagerank(edges(spark, [])).count() == 0
    assert graph.topological_levels(edges(spark, [])).count() == 0


def test_levels(spark):
    levels = graph.topological_levels(edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("d", "c")]))
    assert {tuple(x) for x in levels.collect()} == {("a", 0), ("d", 0), ("b", 1), ("c", 2)}
    assert graph.topological_levels(edges(spark, [("a", "b"), ("b", "a")])) is None


def test_resolution_never_repeats_an_edge(spark):
    e = spark.createDataFrame([(1, "s", "n1", "CALLS"), (2, "s", "__unresolved__::f", "CALLS"), (3, "s", "__unresolved__::g", "CALLS"), (4, "s", "__unresolved__::g", "CALLS"), (5, "s", "__unresolved_fqn__::a.b.f", "CALLS")], "id long, source_id string, target_id string, type string")
    n = spark.createDataFrame([("s", "s", "x.py::s", "python"), ("n1", "f", "a/b.py::f", "python"), ("n2", "g", "y.c::g", "c")], "id string, name string, fqn string, language string")
    found = graph.resolve_by_name(e, n)
    assert {tuple(x) for x in found.collect()} == {(2, "n1"), (3, "n2"), (4, "n2")}
    assert {tuple(x) for x in graph.resolve_by_path(e, n).collect()} == {(5, "n1")}
    out = {x.id: x.target_id for x in graph.apply_resolution(e, found).collect()}
    assert out[1] == "n1" and out[2] == "__unresolved__::f" and out[3] == "n2" and out[4] == "__unresolved__::g"


def brute_ranks(pairs, rounds=100, damping=0.85):
    pairs = set(pairs)
    ids = {v for p in pairs for v in p}
    out = Counter(a for a, _ in pairs)
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(rounds):
        new = dict.fromkeys(ids, (1 - damping) / len(ids))
        for a, b in pairs:
            new[b] += damping * rank[a] / out[a]
        rank = new
    return rank


def test_pagerank_runs_all_rounds(spark):
    path = [(f"p{i}", f"p{i + 1}") for i in range(20)]
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("r0", "r3"), ("p4", "r0"), ("x", "x")]
    # The ring alone keeps moving for more than 100 rounds, the path settles after 20.
    for pairs in (path, path + ring):
        got = {x.id: x["rank"] for x in graph.pagerank(edges(spark, pairs)).collect()}
        want = brute_ranks(pairs)
        assert got.keys() == want.keys() and max(abs(got[v] - want[v]) for v in want) < 1e-11
    few = {x.id: x["rank"] for x in graph.pagerank(edges(spark, path), rounds=3).collect()}
    assert max(abs(few[v] - r) for v, r in brute_ranks(path, 3).items()) < 1e-12


def test_pagerank_query_runs_all_rounds(spark):
    d = "/root/testdata/sf0.001"
    want = brute_ranks([tuple(x) for x in store_queries._directed(spark, d).collect()])
    got = {x.id: x["rank"] for x in store_queries.pagerank(spark, d).collect()}
    assert got.keys() == want.keys() and max(abs(got[v] - want[v]) for v in want) < 1e-9


def test_released_files_are_gone(spark):
    import os

    from hybridlake.session import cut_lineage, release

    df = cut_lineage(spark.range(5))
    folder = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(folder) and df.count() == 5
    release(df)
    assert not os.path.exists(folder)
