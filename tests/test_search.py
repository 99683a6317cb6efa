import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from hybridlake.functions import text as T
from hybridlake.operators import analytics as A
from hybridlake.operators import fusion, lexical, store, vector

DOCS = [(1, "Red harbor, red queue"), (2, "harbour of the queue queue"), (3, "nothing here"), (4, None), (5, ""), (6, "Harbor café résumé x"), (7, "red " * 50), (8, "the foo_bar table, foo bars"), (9, "bar foo; foo. bar"), (10, "foo xbar")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "id long, text string")


@pytest.mark.parametrize("terms", [["harb"], ["red", "queue"], ["caf", "x"], ["Café"], ["foo_bar"], ["foo-ba", "queue"], ["the_queue_que"], ["red_red"]])
def test_prefix_rank_is_that_of_a_full_text_index(spark, terms):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(text)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index here")
    db.executemany("insert into t(rowid, text) values (?, ?)", [(i, t or "") for i, t in DOCS])
    want = {i: -r for i, r in db.execute("select rowid, rank from t where t match ?", (" OR ".join(f'"{t}"*' for t in terms),))}
    got = {r.key: r.score for r in lexical.prefix_rank(docs(spark), F.col("id"), [F.col("text")], terms).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=1e-9) for k in want)


def test_rank_edge_cases(spark):
    d = docs(spark)
    assert lexical.prefix_rank(d, F.col("id"), [F.col("text")], []).count() == 0
    assert lexical.prefix_rank(d.limit(0), F.col("id"), [F.col("text")], ["a"]).count() == 0
    assert lexical.okapi(d, F.col("id"), F.col("text"), "of a x").count() == 0
    assert T.symbol_query("a-bb_c.dd") == ["bb", "dd"] and T.memory_query("\"it's\" a ok") == ["its", "ok"]


def test_postings_rank_the_same(spark):
    d = docs(spark)
    n, mean = d.agg(F.count(F.lit(1)), F.avg(F.size(T.index_tokens(F.col("text"))))).first()
    index = lexical.postings(d, F.col("id"), F.col("text"))
    close = lambda df: {r.key: round(r.score, 9) for r in df.collect()}
    for terms in (["red", "qu"], ["CAFÉ", "foo_bar", "q"], ["--"]):
        assert close(lexical.rank_postings(index, terms, n, mean)) == close(lexical.prefix_rank(d, F.col("id"), [F.col("text")], terms)), terms


def test_phrases_stay_within_a_column(spark):
    d = spark.createDataFrame([(1, "foo", "bar"), (2, "foo bar", "")], "id long, a string, b string")
    assert [r.key for r in lexical.prefix_rank(d, F.col("id"), [F.col("a"), F.col("b")], ["foo_bar"]).collect()] == [2]


def test_nearest(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (None, [0.0, 0.0]), (5, [3.0]), (6, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    assert [(r.key, r.distance) for r in vector.nearest(df, F.col("id"), F.col("v"), [0.0, 0.0], 3).collect()] == [(1, 0.0), (2, 1.0), (3, 1.0)]
    got = vector.nearest_to_each(df.where("id <= 2"), df, query_id=F.col("id"), row_id=F.col("id"), query_vector=F.col("v"), row_vector=F.col("v"), k=2).collect()
    assert {(r.query_id, r.rank): r.row_id for r in got} == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3}
    cos = vector.nearest_to_each(df.where("id = 2"), df, query_id=F.col("id"), row_id=F.col("id"), query_vector=F.col("v"), row_vector=F.col("v"), k=9, metric="cosine").collect()
    assert {r.row_id: round(r.distance, 6) for r in cos} == {1: 1.0, 3: 1.0, 6: round(1 - 1 / math.sqrt(2), 6)}
    assert vector.nearest_to_each(df.limit(0), df, query_id=F.col("id"), row_id=F.col("id"), query_vector=F.col("v"), row_vector=F.col("v"), k=2).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "key string, place int")
    got = {r.key: r.rrf for r in fusion.rrf([a, a.where("key = 'y'"), a.limit(0)]).collect()}
    assert math.isclose(got["x"], 1 / 60) and math.isclose(got["y"], 2 / 61)
    b = spark.createDataFrame([("q", "rule"), ("a Q b", "resource"), ("z", None)], "k string, c string").select(fusion.boost(F.col("k"), F.col("c"), "Q").alias("b"))
    assert [round(r.b, 2) for r in b.collect()] == [0.55, -0.2, 0.0]


def test_store(spark):
    ddl = "key string, project_id string, category string, content string, tags string, relationships string, access_count int, created_at bigint, updated_at bigint"
    old = spark.createDataFrame([("a", "p", "rule", "old", None, "{}", 3, 1, 1), ("b", "p", "rule", "kept", None, None, None, 1, 1)], ddl)
    new = spark.createDataFrame([("a", "p", None, "new", "[]", "x", 9, 9, 9), ("a", "p", None, "newer", "[]", "x", 9, 9, 10), ("c", None, None, "made", None, None, None, None, None), ("", None, None, "no", None, None, 0, 0, 0), (None, None, None, "no", None, None, 0, 0, 0)], ddl)
    got = {r.key: (r.category, r.content, r.relationships, r.access_count, r.created_at, r.updated_at) for r in store.upsert_memories(old, new, 50).collect()}
    assert got == {"a": ("general", "newer", "{}", 4, 1, 50), "b": ("rule", "kept", None, 0, 1, 1), "c": ("general", "made", None, 0, 50, 50)}
    s = lambda rows: spark.createDataFrame(rows, "p string, h string")
    change = store.classify_changes(s([("a", "1"), ("b", "1"), ("d", None)]), s([("a", "1"), ("b", "2"), ("c", "1"), ("d", None)]), "p", "h")
    assert {tuple(r) for r in change.collect()} == {("a", "skipped"), ("b", "updated"), ("c", "created"), ("d", "skipped")}


def test_short_text_similarity(spark):
    rows = [(1, "Best practices for skills"), (2, "Best practices for skills guide"), (3, "Topic about apples"), (4, "Discussion of oranges"), (5, "topic about APPLES!"), (6, None), (7, "ab")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("g", A.ngrams(A.normal_text(F.col("t"))))
    pairs = {(r.key_a, r.key_b): round(r.similarity, 3) for r in A.similar_pairs(df, "id", "g", 0.6).collect()}
    assert set(pairs) == {(1, 2), (3, 5)} and pairs[3, 5] == 1.0
    one = df.where("id in (1, 7)").select("g").collect()
    assert one[1].g == ["ab"] and "bes" in one[0].g
    j = spark.range(1).select(A.jaccard(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("b"), F.lit("c"), F.lit("d"))).alias("j")).first().j
    assert j == 0.5 and A.similar_pairs(df.limit(0), "id", "g", 0.6).count() == 0


def test_scores(spark):
    row = spark.range(1).select(A.log1p_safe(F.lit(None).cast("int")).alias("a"), A.log1p_safe(F.lit(-5)).alias("b"), A.forum_engagement(F.lit(100), F.lit(50), F.lit(0.9)).alias("c"), A.forum_engagement(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0.9)).alias("d")).first()
    assert row.a == row.b == 0 and row.c > 0 and row.d is None
    flat = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    assert [r.s for r in A.min_max(flat, "v", "s").collect()] == [50.0, 50.0, 50.0]
    day = lambda s: F.lit(s).cast("date")
    r = spark.range(1).select(A.recency_score(day("2026-01-15"), day("2026-01-15")).alias("t"), A.recency_score(day(None), day("2026-01-15")).alias("n"), A.recency_score(day("2027-01-01"), day("2026-01-15")).alias("f"), A.date_confidence(F.lit("2025-12-01"), "2026-01-01", "2026-01-31").alias("c")).first()
    assert (r.t, r.n, r.f, r.c) == (100, 0, 100, "low")
