from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hybridlake.operators.integrity import orphan_references, orphan_report

DAY0 = datetime(2025, 1, 1)
EDGE = "id bigint, source_id string, target_id string, ingested_at timestamp, key string, salt int"
NODE = "id string, ingested_at timestamp, kind string"
GONE = "node_id string, deleted_at timestamp"


def run(spark, edges, nodes, gone, **kw):
    at = lambda n: None if n is None else DAY0 + timedelta(days=n)
    e = spark.createDataFrame([(i, s, t, at(x), "clash", 1) for i, s, t, x in edges], EDGE)
    n = spark.createDataFrame([(k, at(x), "clash") for k, x in nodes], NODE)
    g = spark.createDataFrame([(k, at(x)) for k, x in gone], GONE)
    return orphan_references(
        e, n, g, child_id="id", child_time="ingested_at", references={"source_id": "nodes", "target_id": "nodes"},
        parent_keys={"nodes": ("id", "ingested_at")}, deletion_keys={"nodes": ("node_id", "deleted_at")}, **kw,
    )


def rows(df):
    return {(r.child_id, r.endpoint, r.reason) for r in df.collect()}


def brute(edges, nodes, gone):
    norm = lambda k: k.strip().lower() if k else ""
    first = {}
    for i, s, t, x in edges:
        first[i] = min(first.get(i, (x, s, t)), (x, s, t))
    out = set()
    for i, (x, s, t) in first.items():
        for name, k in (("source_id", norm(s)), ("target_id", norm(t))):
            if not k or k.startswith("__unresolved"):
                continue
            born = [b for n, b in nodes if norm(n) == k]
            before = [b for b in born if b <= x]
            dead = [d for n, d in gone if norm(n) == k and d <= x and (not before or d > max(before))]
            if not before or dead:
                out.add((i, name, "never" if not born else "deleted" if dead else "late"))
    return out


def test_cases(spark):
    edges = [(1, "a", "b", 5), (1, "a", "zz", 9), (2, " A ", None, 1), (3, "", "__unresolved__::x", 3), (4, "c", "gone", 4), (5, "gone", "gone", 9), (None, "q", "q", 1)]
    nodes = [("a", 2), ("a", 3), ("b", 5), ("c", 9), ("gone", 1), ("gone", 8)]
    gone = [("gone", 3), ("gone", 3), ("b", 5)]
    got = rows(run(spark, edges, nodes, gone))
    assert got == {(2, "source_id", "late"), (4, "source_id", "late"), (4, "target_id", "deleted")}
    assert got == brute([e for e in edges if e[0]], nodes, gone)


def test_empty_tables(spark):
    assert rows(run(spark, [], [("a", 1)], [])) == set()
    assert rows(run(spark, [(1, "a", None, 1)], [], [])) == {(1, "source_id", "never")}
    assert orphan_report(run(spark, [], [], []), "edges").collect() == []


def test_hot_key_is_salted(spark):
    edges = [(i, "hot", "x", i % 7) for i in range(9000)]
    nodes, gone = [("hot", 2), ("x", 0)], [("hot", 5)]
    df = run(spark, edges, nodes, gone, salts=4)
    assert rows(df) == brute(edges, nodes, gone)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.integers(1, 6), st.sampled_from(["a", "B ", "c", "", None]), st.sampled_from(["b", "A", "d"]), st.integers(0, 6)), max_size=12),
    st.lists(st.tuples(st.sampled_from(["a", "b", "C"]), st.integers(0, 6)), max_size=6),
    st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 6)), max_size=6),
)
def test_against_brute_force(spark, edges, nodes, gone):
    edges = [(i, s or "", t, x) for i, s, t, x in edges]
    assert rows(run(spark, edges, nodes, gone)) == brute(edges, nodes, gone)
