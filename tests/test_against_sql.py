"""Queries against their SQL in DuckDB over the smallest tables, rows and types."""

import os
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
FOLDER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
NAMES = [
    "hybrid_search", "skill_search", "unified_search", "bm25_search", "bm25_postings", "bm25_okapi", "symbol_search", "pattern_scan", "severity_score", "coupling", "cycles", "label_counts", "connected_components", "lane_replay",
    "delete_count", "gc_orphan_keys", "gc_deleted_files", "replace_nodes", "upsert_keyed", "node_lookup", "filter_page", "multi_like", "has_vector", "caller_names", "session_posts", "next_id", "outcome_counts", "work_groups", "score_trend",
    "recent_observations", "file_skeletons", "json_fields", "json_records", "tag_counts", "category_keys", "path_rewrite", "watched_files", "edit_guard", "clamped_messages", "skill_texts", "keyword_scores", "graph_nodes_json", "unique_findings",
]
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    if not FOLDER.is_dir():
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def value(x):
    return f"{x:.6g}" if isinstance(x, float) else x


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, db, name):
    df = entry.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = Counter(tuple(value(r[c]) for c in columns) for r in df.collect())
    cursor = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == {c: "VARCHAR" if k == "JSON" else k for c, k in kinds.items()}
    want = Counter(tuple(value(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want
