"""p3: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridlake.operators.integrity import orphan_references, orphan_report
from hybridlake.plans.registry import Registry
from hybridlake.sources.tables import table

R = Registry()

_ORPHANS = r"""
WITH first_edge AS (
  SELECT id, unnest(min({'t': ingested_at, 's': source_id, 'g': target_id})) FROM edges GROUP BY id),
refs AS (
  SELECT id, t, 'source_id' AS endpoint, lower(regexp_replace(s, '^\s+|\s+$', '', 'g')) AS k FROM first_edge
  UNION ALL
  SELECT id, t, 'target_id', lower(regexp_replace(g, '^\s+|\s+$', '', 'g')) FROM first_edge),
used AS (SELECT * FROM refs WHERE k <> '' AND NOT starts_with(k, '__unresolved')),
births AS (SELECT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS k, ingested_at AS t, 1 AS alive FROM nodes),
deaths AS (SELECT lower(regexp_replace(node_id, '^\s+|\s+$', '', 'g')) AS k, deleted_at AS t, 0 AS alive FROM node_deletions),
lives AS (SELECT k, t, max(alive) AS alive FROM (FROM births UNION ALL FROM deaths) GROUP BY ALL),
keys AS (SELECT DISTINCT k FROM births),
orphans AS (
  SELECT u.id, u.endpoint, u.k, u.t,
         CASE WHEN keys.k IS NULL THEN 'never' WHEN l.alive = 0 THEN 'deleted' ELSE 'late' END AS reason
  FROM used u ASOF LEFT JOIN lives l ON u.k = l.k AND u.t >= l.t LEFT JOIN keys ON keys.k = u.k
  WHERE coalesce(l.alive, 0) = 0)
"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(
        table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "node_deletions"),
        child_id="id", child_time="ingested_at", references={"source_id": "nodes", "target_id": "nodes"},
        parent_keys={"nodes": ("id", "ingested_at")}, deletion_keys={"nodes": ("node_id", "deleted_at")},
    )


@R.add("p3_found", _ORPHANS + "SELECT DISTINCT id AS edge_id, endpoint FROM orphans")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select(F.col("child_id").alias("edge_id"), "endpoint")


@R.add(
    "p3_report",
    _ORPHANS
    + """SELECT 'edges' AS child_table, endpoint, 'nodes' AS parent_table, strftime(date_trunc('month', t AT TIME ZONE 'UTC'), '%Y-%m-%d') AS period,
         reason, count(*) AS n_references, count(DISTINCT k) AS n_keys FROM orphans GROUP BY ALL""",
)
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d), "edges")
