"""Queries whose operators are sequential within a row or a group, and capsules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridlake.functions import text as T
from hybridlake.operators import capsule, chunking, editing, fusion, graph, lanes, lexical
from hybridlake.parsers.registry import parse_files
from hybridlake.plans.registry import Registry
from hybridlake.plans.search_queries import latest_nodes, rank_sql
from hybridlake.plans.store_queries import edges_of, nodes_of
from hybridlake.sources.tables import table

R = Registry()


@R.add("chunk_docs")
def chunk_docs(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_table(table(spark, d, "documents").where("text is not null"), F.col("doc_id"), F.col("text")).withColumnRenamed("key", "doc_id")


def _parsed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = latest_nodes(spark, d, ["type", "language", "raw_body", "file_path"]).where("raw_body is not null")
    extension = F.create_map(*[F.lit(x) for p in {"python": "py", "java": "java", "csharp": "cs", "c#": "cs", "typescript": "ts", "javascript": "ts", "c": "c", "c++": "cpp", "cpp": "cpp"}.items() for x in p])
    # Code by its language, whatever the spelling; everything else is read as a document.
    kind = F.coalesce(extension[F.lower(F.trim("language"))], F.lit("md"))
    return parse_files(n, F.concat_ws(".", "id", kind), F.col("raw_body"))


@R.add("parse_symbols")
def parse_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and chunks found in each stored body, read as a file of its own: modules, documents and skills too."""
    return _parsed(spark, d)[0].select("id", "type", "name", "fqn", "language", "start_line", "end_line", "signature")


@R.add("parse_relations")
def parse_relations(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d)[1]


@R.add(
    "lane_replay",
    """WITH RECURSIVE l AS (SELECT event_id AS seq, 'lane-' || user_id AS lane, 'agent-' || (event_id % 3) AS agent, CASE event_type WHEN 'purchase' THEN 'release' WHEN 'error' THEN 'force' ELSE 'acquire' END AS op, epoch(ts)::DOUBLE AS taken, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (SELECT lane, 0::BIGINT AS n, 0::BIGINT AS seq, true AS accepted, 'IDLE' AS status, NULL::VARCHAR AS holder, 0.0::DOUBLE AS locked_at FROM (SELECT DISTINCT lane FROM l)
      UNION ALL SELECT lane, n, seq, ok, CASE WHEN NOT ok THEN status WHEN op = 'acquire' THEN 'BUSY' ELSE 'IDLE' END, CASE WHEN NOT ok THEN holder WHEN op = 'acquire' THEN agent END, CASE WHEN ok AND op = 'acquire' THEN taken WHEN ok THEN 0.0 ELSE locked_at END
      FROM (SELECT l.lane, l.n, l.seq, l.op, l.agent, l.taken, r.status, r.holder, r.locked_at, CASE l.op WHEN 'force' THEN true WHEN 'release' THEN coalesce(r.holder = l.agent, false) ELSE NOT (r.status = 'BUSY' AND r.holder <> l.agent AND l.taken - r.locked_at <= 7200) END AS ok FROM r JOIN l ON l.lane = r.lane AND l.n = r.n + 1))
    SELECT seq, lane, accepted, status, holder FROM r WHERE n > 0""",
)
def lane_replay(spark: SparkSession, d: str) -> DataFrame:
    """Events as lock requests: each user is a lane, event types are operations, items are agents."""
    op = F.when(F.col("event_type") == "purchase", "release").when(F.col("event_type") == "error", "force").otherwise("acquire")
    log = table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("lane-"), F.col("user_id")).alias("lane"), F.concat(F.lit("agent-"), F.pmod("event_id", F.lit(3))).alias("agent"), op.alias("op"), F.lit(None).cast("string").alias("handoff_to"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").__truediv__(1e6).alias("at"),
    )
    return lanes.replay(log)


@R.add("fuzzy_find")
def fuzzy_find(spark: SparkSession, d: str) -> DataFrame:
    """Each body's third to fifth line, with other blanks, found in it again."""
    n = latest_nodes(spark, d, ["raw_body"]).where("size(split(raw_body, '\n')) >= 6")
    block = F.array_join(F.transform(F.slice(F.split("raw_body", "\n"), 3, 3), lambda x: F.concat(F.lit("  "), F.regexp_replace(F.trim(x), " ", "  "))), "\n")
    return editing.find_blocks(n, F.col("id"), F.col("raw_body"), block).withColumnRenamed("key", "id")


_TERMS = ["score", "gasket"]
_CAPSULE_NODES = "one AS (SELECT id, unnest(max({'a': ingested_at, 'name': name, 'fqn': fqn, 'docstring': docstring, 'signature': signature, 'file_path': file_path, 'raw_body': raw_body})) FROM nodes GROUP BY id)"


def _pivots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    columns = ["name", "fqn", "docstring", "signature", "file_path", "raw_body"]
    nodes = latest_nodes(spark, d, columns)
    ranked = lexical.prefix_rank(nodes, F.col("id"), [F.col(c) for c in ("name", "fqn", "docstring", "signature")], T.symbol_query("score gasket"))
    places = fusion.ranked_list(ranked.withColumnRenamed("key", "id"), "fts", [F.col("score").desc(), F.col("id")], 5)
    return capsule.pivots(places.select("id", "place"), nodes, 600), nodes


@R.add(
    "capsule_pivots",
    f"""WITH RECURSIVE {_CAPSULE_NODES}, {rank_sql('r', 'one', 'id', ['name', 'fqn', 'docstring', 'signature'], _TERMS)},
    f AS (SELECT key AS id, row_number() OVER (ORDER BY score DESC, key) - 1 AS place FROM r QUALIFY place < 5),
    p AS (SELECT row_number() OVER (ORDER BY coalesce(starts_with(one.file_path, 'references/'), false)::INTEGER, place, id)::INTEGER AS position, id, fqn, coalesce(raw_body, '') AS body,
      coalesce(concat_ws(chr(10), signature, CASE WHEN trim(docstring, ' ') <> '' THEN docstring END), '') AS short FROM f JOIN one USING (id) QUALIFY position <= 3),
    w AS (SELECT 0 AS position, 0.0::DOUBLE AS used, NULL::VARCHAR AS id, NULL::VARCHAR AS fqn, false AS whole, '' AS text
      UNION ALL SELECT p.position, w.used + len(CASE WHEN w.used + len(p.body) / 4 <= 420 THEN p.body ELSE p.short END) / 4, p.id, p.fqn, w.used + len(p.body) / 4 <= 420, CASE WHEN w.used + len(p.body) / 4 <= 420 THEN p.body ELSE p.short END FROM w JOIN p ON p.position = w.position + 1)
    SELECT position, id, fqn, whole, md5(text) AS text_md5 FROM w WHERE position > 0""",
)
def capsule_pivots(spark: SparkSession, d: str) -> DataFrame:
    return _pivots(spark, d)[0].select("position", "id", "fqn", "whole", F.md5("text").alias("text_md5"))


@R.add("capsule_related")
def capsule_related(spark: SparkSession, d: str) -> DataFrame:
    found, nodes = _pivots(spark, d)
    near = graph.neighbors(graph.typed_graph(edges_of(spark, d), nodes_of(spark, d)), ["Calls", "Contains"])
    return capsule.related(found, near, nodes, 200)
