"""Indexing of a workspace as one plan: compare, parse what changed, replace, collect garbage.

Defined results: files are compared by digest; unchanged ones keep their rows; a file that no longer
parses or has become empty loses its rows; repeated paths in the cache count at their latest
`last_indexed_at`; an empty workspace removes everything, an empty store indexes everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridlake.operators import store
from hybridlake.parsers.model import EDGE_COLUMNS, NODE_COLUMNS
from hybridlake.parsers.registry import module_of, node_category, parse_files


@dataclass(frozen=True)
class Indexed:
    status: DataFrame  # (file_path, status)
    nodes: DataFrame
    edges: DataFrame
    cache: DataFrame


def index_files(files: DataFrame, cache: DataFrame, nodes: DataFrame, edges: DataFrame, *, now: int, workspace: str = "") -> Indexed:
    """files: (file_path, source, hash) of the whole workspace; cache, nodes, edges: the store's tables.

    Rows of updated and deleted files are taken out, edges from or to them too; created and updated files are parsed.
    """
    known = store.keep_latest(cache.where("file_path is not null"), ["file_path"], [F.col("last_indexed_at").desc_nulls_last(), F.col("hash")])
    status = store.classify_changes(known, files, "file_path", "hash")
    gone = status.where("status in ('updated', 'deleted')").select("file_path")
    kept_nodes, kept_edges = store.delete_files(nodes, edges, gone)
    todo = files.join(status.where("status in ('created', 'updated')").select("file_path"), "file_path", "left_semi")
    new_nodes, new_edges = parse_files(todo, F.col("file_path"), F.col("source"))
    id_ = F.substring(F.md5(F.lit(workspace)), 1, 8)
    new_nodes = new_nodes.withColumns({"module": module_of(F.col("file_path")), "workspace_id": id_, "category": node_category(F.col("file_path"))})
    counts = new_nodes.groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("node_count"))
    fresh = todo.select("file_path", "hash", F.lit(now).cast("bigint").alias("last_indexed_at")).join(counts, "file_path", "left").withColumns({"node_count": F.coalesce("node_count", F.lit(0)), "workspace_id": id_})
    out_nodes = store.replace_rows(kept_nodes.select(*[c for c in [*NODE_COLUMNS, "module", "workspace_id", "category"] if c in kept_nodes.columns]), new_nodes, ["id"], [F.col("start_line"), F.col("fqn")])
    old = kept_edges.select(*[c for c in EDGE_COLUMNS if c in kept_edges.columns])
    added = store.insert_or_ignore(old, new_edges, ["source_id", "target_id", "type"], [F.col("call_site_line")])
    left = known.join(gone, "file_path", "left_anti").select("file_path", "hash", "last_indexed_at", "node_count", "workspace_id")
    return Indexed(status, out_nodes, old.unionByName(added, allowMissingColumns=True), left.unionByName(fresh))


def category_of(path: Column, folders: dict[str, str], otherwise: str = "general") -> Column:
    """The category whose folder is the longest that holds the path, so a nested folder's files don't count for the outer one."""
    out = F.lit(otherwise)
    for name, folder in sorted(folders.items(), key=lambda x: len(x[1].strip("/"))):
        out = F.when(path.startswith(folder.strip("/") + "/"), name).otherwise(out)
    return out


def catalogue(files: DataFrame, folders: dict[str, str]) -> DataFrame:
    """(key, category, content, file_path) of documents as memories: `skill::<folder>` for SKILL.md, else `<category>::<stem>`."""
    parts = F.split("file_path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    category = category_of(F.col("file_path"), folders)
    named = F.lower(F.element_at(parts, -1)) == "skill.md"
    name = F.when(named & (F.size(parts) > 1), F.get(parts, F.size(parts) - 2)).otherwise(stem)
    return files.where("file_path is not null").select(F.concat_ws("::", category, name).alias("key"), category.alias("category"), F.col("source").alias("content"), "file_path")
