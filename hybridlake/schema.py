"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

_DDL = {
    "nodes": "id string, type string, name string, fqn string, file_path string, start_line int, end_line int, signature string, return_type string, docstring string, is_exported boolean, is_async boolean, is_test boolean, raw_body string, skeleton_standard string, skeleton_minimal string, language string, module string, workspace_id string, category string, ingested_at timestamp",
    "edges": "id bigint, source_id string, target_id string, type string, call_site_line int, confidence double, ingested_at timestamp",
    "node_deletions": "node_id string, file_path string, deleted_at timestamp",
    "file_cache": "file_path string, hash string, last_indexed_at bigint, node_count int, workspace_id string",
    "memories": "key string, project_id string, category string, content string, tags string, relationships string, access_count int, created_at bigint, updated_at bigint",
    "observations": "id bigint, session_id string, type string, content string, file_paths string, stale int, created_at bigint, source string, confidence double, category string, ingested_at timestamp",
    "file_lineage": "file_path string, commit_count int, churn_score double, last_author string, last_commit_ts bigint, updated_at bigint",
    "co_change_edges": "file_a string, file_b string, coupling_score double, shared_commits int, updated_at bigint",
    "ast_diffs": "id bigint, file_path string, symbol_fqn string, diff_type string, summary string, old_snippet string, new_snippet string, detected_at bigint",
    "sessions": "id string, agent_name string, started_at bigint, last_active_at bigint, status string, summary string, tool_call_count int, observation_count int",
    "search_misses": "id bigint, query string, project_id string, category string, created_at bigint",
    "meta": "key string, value string",
}
#: Table -> {column: type}.
SCHEMAS: dict[str, dict[str, str]] = {name: dict(c.split() for c in ddl.split(", ")) for name, ddl in _DDL.items()}


def ddl(name: str) -> str:
    """The schema of a table, for readers that need it stated."""
    return _DDL[name]
