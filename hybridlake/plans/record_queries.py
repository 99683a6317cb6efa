"""Queries of the record operators, and of what builds on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridlake.functions.embedding import skill_text
from hybridlake.functions.text import clamp_message
from hybridlake.operators import records as X
from hybridlake.operators import store
from hybridlake.plans.registry import Registry
from hybridlake.plans.search_queries import latest_nodes
from hybridlake.plans.store_queries import edges_of, observations_of
from hybridlake.sources.tables import table

R = Registry()

_MEM = "m AS (SELECT key, unnest(max({'u': updated_at, 'content': content, 'tags': tags, 'relationships': relationships, 'category': category, 'created_at': created_at, 'project_id': project_id})) FROM memories GROUP BY key)"
_OBS = "ob AS (SELECT id, unnest(min({'a': ingested_at, 'content': content, 'created_at': created_at, 'type': type, 'session_id': session_id})) FROM observations GROUP BY id)"
_ONE = "one AS (SELECT id, unnest(max({'a': ingested_at, 'type': type, 'name': name, 'fqn': fqn, 'file_path': file_path, 'signature': signature, 'start_line': start_line, 'skeleton_minimal': skeleton_minimal, 'raw_body': raw_body})) FROM nodes GROUP BY id)"


def memories_of(spark: SparkSession, d: str) -> DataFrame:
    columns = ["content", "tags", "relationships", "category", "created_at", "project_id"]
    return table(spark, d, "memories").groupBy("key").agg(F.max(F.struct("updated_at", *columns)).alias("m")).select("key", *[F.col(f"m.{c}").alias(c) for c in columns])


@R.add("delete_count", f"WITH {_MEM} SELECT count(*) AS n FROM m WHERE category = 'general'")
def delete_count(spark: SparkSession, d: str) -> DataFrame:
    m = memories_of(spark, d)
    return X.delete_keys(m, m.where("category = 'general'"), "key")[1]


@R.add("gc_orphan_keys", f"WITH {_MEM} SELECT key FROM m WHERE category IN ('rule', 'protocol') AND contains(tags, 'r') AND relationships IS NOT NULL")
def gc_orphan_keys(spark: SparkSession, d: str) -> DataFrame:
    m = memories_of(spark, d)
    return X.orphaned_memories(m, m.where("relationships is null"), ["rule", "protocol"], "r").select("key")


@R.add("gc_deleted_files", "WITH gone AS (SELECT DISTINCT file_path FROM node_deletions), g AS (SELECT DISTINCT id FROM nodes WHERE file_path IN (FROM gone)) SELECT (SELECT count(*) FROM nodes WHERE file_path IS NULL OR file_path NOT IN (FROM gone)) AS n_nodes, (SELECT count(*) FROM edges WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.id = source_id OR g.id = target_id)) AS n_edges")
def gc_deleted_files(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges left when the files with deletions are taken out."""
    gone = table(spark, d, "node_deletions").select("file_path").distinct()
    nodes, edges = store.delete_files(table(spark, d, "nodes"), table(spark, d, "edges"), gone)
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes")).join(edges.agg(F.count(F.lit(1)).alias("n_edges")), F.lit(True))


@R.add("replace_nodes", "WITH a AS (SELECT * FROM nodes WHERE ingested_at < TIMESTAMPTZ '2025-06-01 00:00:00+00'), b AS (SELECT * FROM nodes WHERE ingested_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, fqn) = 1) SELECT id, fqn FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, fqn FROM b")
def replace_nodes(spark: SparkSession, d: str) -> DataFrame:
    n, cut = table(spark, d, "nodes"), F.lit("2025-06-01 00:00:00").cast("timestamp")
    return store.replace_rows(n.where(F.col("ingested_at") < cut), n.where(F.col("ingested_at") >= cut), ["id"], [F.col("ingested_at").desc(), F.col("fqn")]).select("id", "fqn")


@R.add("upsert_keyed", "WITH a AS (SELECT id, session_id, content FROM observations WHERE id % 2 = 0), n AS (SELECT id, session_id, content FROM observations WHERE id % 2 = 1), k AS (SELECT * FROM n WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id, content) = 1) SELECT id, session_id FROM a WHERE session_id IS NULL OR session_id NOT IN (SELECT session_id FROM k) UNION ALL SELECT id, session_id FROM k UNION ALL SELECT id, session_id FROM n WHERE session_id IS NULL")
def upsert_keyed(spark: SparkSession, d: str) -> DataFrame:
    """Odd observations as a batch that replaces the even ones by session."""
    o = table(spark, d, "observations").select("id", "session_id", "content")
    return X.upsert_keyed(o.where("id % 2 = 0"), o.where("id % 2 = 1"), "session_id", [F.col("id"), F.col("content")]).select("id", "session_id")


@R.add("node_lookup", f"WITH {_ONE} SELECT id, fqn FROM one WHERE fqn IN (SELECT max(fqn) FROM one)")
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = latest_nodes(spark, d, ["fqn"])
    return n.join(F.broadcast(n.agg(F.max("fqn").alias("fqn"))), "fqn", "left_semi").select("id", "fqn")


@R.add("filter_page", f"WITH {_MEM} SELECT key, category FROM m WHERE category = 'rule' ORDER BY created_at DESC, key LIMIT 20 OFFSET 10")
def filter_page(spark: SparkSession, d: str) -> DataFrame:
    return X.page(memories_of(spark, d), {"category": "rule", "project_id": None}, [F.col("created_at").desc(), F.col("key")], 20, 10).select("key", "category")


@R.add("multi_like", f"WITH {_MEM} SELECT key FROM m WHERE lower(key) LIKE '%queue%' OR lower(content) LIKE '%queue%' OR lower(tags) LIKE '%queue%'")
def multi_like(spark: SparkSession, d: str) -> DataFrame:
    return X.mentions(memories_of(spark, d), ["key", "content", "tags"], "Queue").select("key")


@R.add("has_vector", "SELECT doc_id, EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id) AS has_vec FROM documents")
def has_vector(spark: SparkSession, d: str) -> DataFrame:
    return X.with_flag(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "has_vec")


@R.add("caller_names", f"WITH {_ONE}, e AS (SELECT id, unnest(min({{'a': ingested_at, 'source_id': source_id, 'target_id': target_id, 'type': type}})) FROM edges GROUP BY id) SELECT e.id AS edge_id, (SELECT name FROM one WHERE one.id = e.source_id) AS source_name FROM e")
def caller_names(spark: SparkSession, d: str) -> DataFrame:
    names = latest_nodes(spark, d, ["name"]).select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return edges_of(spark, d).join(names, "source_id", "left").select(F.col("id").alias("edge_id"), "source_name")


@R.add("session_posts", f"WITH {_OBS}, i AS (SELECT session_id, count(*) AS n, max(created_at) AS last_at FROM ob WHERE session_id IS NOT NULL GROUP BY session_id) SELECT ob.id, i.n, i.last_at FROM ob LEFT JOIN i USING (session_id)")
def session_posts(spark: SparkSession, d: str) -> DataFrame:
    o = observations_of(spark, d)
    per = o.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_at"))
    return o.join(per, "session_id", "left").select("id", "n", "last_at")


@R.add("next_id", "SELECT max(id) + 1 AS next_id FROM edges")
def next_id(spark: SparkSession, d: str) -> DataFrame:
    return X.next_id(table(spark, d, "edges"), "id")


@R.add("outcome_counts", "SELECT count(*) FILTER (node_count > 0) AS indexed, count(*) FILTER (node_count = 0) AS skipped, count(*) FILTER (node_count IS NULL) AS errors FROM file_cache")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("node_count")
    return table(spark, d, "file_cache").agg(F.count_if(c > 0).alias("indexed"), F.count_if(c == 0).alias("skipped"), F.count_if(c.isNull()).alias("errors"))


@R.add("work_groups", "SELECT CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE 'root' END AS module, count(*) AS n FROM file_cache WHERE file_path IS NOT NULL GROUP BY 1")
def work_groups(spark: SparkSession, d: str) -> DataFrame:
    from hybridlake.parsers.registry import module_of

    return table(spark, d, "file_cache").where("file_path is not null").groupBy(module_of(F.col("file_path")).alias("module")).agg(F.count(F.lit(1)).alias("n"))


@R.add("score_trend", "WITH o AS (SELECT session_id, min(confidence) FILTER (confidence IS NOT NULL) AS x, arg_min(confidence, ingested_at) AS first_score, arg_max(confidence, ingested_at) AS last_score FROM (SELECT session_id, ingested_at, max(confidence) AS confidence FROM observations WHERE confidence IS NOT NULL GROUP BY ALL) GROUP BY session_id) SELECT session_id, first_score, last_score, CASE WHEN last_score > first_score THEN 'up' WHEN last_score < first_score THEN 'down' ELSE 'flat' END AS trend FROM o")
def score_trend(spark: SparkSession, d: str) -> DataFrame:
    at_once = table(spark, d, "observations").where("confidence is not null").groupBy("session_id", "ingested_at").agg(F.max("confidence").alias("confidence"))
    return X.severity_trend(at_once, "session_id", "ingested_at", "confidence")


@R.add("recent_observations", f"WITH {_OBS} SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS rank FROM ob QUALIFY rank <= 3")
def recent_observations(spark: SparkSession, d: str) -> DataFrame:
    return X.recent(observations_of(spark, d), "session_id", [F.col("created_at").desc(), F.col("id").desc()], 3).select("session_id", "id", "rank")


@R.add("file_skeletons", f"WITH {_ONE} SELECT file_path, md5(string_agg(coalesce(skeleton_minimal, signature, ''), chr(10) || chr(10) ORDER BY coalesce(start_line, 0), fqn NULLS FIRST, coalesce(skeleton_minimal, signature, ''))) AS skeleton_md5 FROM one WHERE file_path IS NOT NULL GROUP BY file_path")
def file_skeletons(spark: SparkSession, d: str) -> DataFrame:
    n = latest_nodes(spark, d, ["file_path", "fqn", "signature", "start_line", "skeleton_minimal"])
    return X.file_skeletons(n).select("file_path", F.md5("skeleton").alias("skeleton_md5"))


@R.add("json_fields", f"WITH {_MEM} SELECT key, len(coalesce(tags, '[]')::JSON::VARCHAR[]) AS n_tags, (coalesce(tags, '[]')::JSON::VARCHAR[])[1] AS first_tag, relationships::JSON->>'related' AS related FROM m")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    tags = X.json_list(F.col("tags"))
    return memories_of(spark, d).select("key", F.size(tags).cast("long").alias("n_tags"), F.get(tags, 0).alias("first_tag"), F.try_element_at(X.json_map(F.col("relationships")), F.lit("related")).alias("related"))


@R.add("json_records", f"WITH {_MEM} SELECT key, json_object('key', key, 'category', category) AS record FROM m WHERE category IS NOT NULL")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    return memories_of(spark, d).where("category is not null").select("key", F.to_json(F.struct("key", "category")).alias("record"))


@R.add("tag_counts", f"WITH {_MEM}, t AS (SELECT category, unnest(tags::JSON::VARCHAR[]) AS label FROM m), c AS (SELECT category, label, count(*) AS n FROM t GROUP BY ALL) SELECT category, label, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, label) AS rank FROM c QUALIFY rank <= 10")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.label_counts(memories_of(spark, d).withColumn("labels", X.json_list(F.col("tags"))), "category", "labels")


@R.add("category_keys", f"WITH {_MEM} SELECT category, count(*) AS n, md5(string_agg(key, ',' ORDER BY key)) AS keys_md5 FROM m GROUP BY category")
def category_keys(spark: SparkSession, d: str) -> DataFrame:
    return memories_of(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("key")), ",")).alias("keys_md5"))


_ROOTED = "CASE WHEN starts_with(file_path, 'ROOT/') THEN '/ws/' || substr(file_path, 6) ELSE file_path END"


@R.add("path_rewrite", f"SELECT DISTINCT file_path, {_ROOTED} AS absolute FROM nodes WHERE file_path IS NOT NULL")
def path_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").where("file_path is not null").select("file_path", X.rooted(F.col("file_path"), "/ws/").alias("absolute")).distinct()


_ANY = "list_bool_or(list_transform([{}], lambda x: contains(replace(file_path, chr(92), '/'), x)))"
_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)


@R.add(
    "watched_files",
    f"SELECT DISTINCT file_path, NOT {_ANY.format(_quoted(X.UNWATCHED))} AND CASE WHEN contains(replace(file_path, chr(92), '/'), '.agents/') THEN {_ANY.format(_quoted(X.AGENT_PARTS))} ELSE list_bool_or(list_transform([{_quoted(X.WATCHED_ENDS)}], lambda x: ends_with(file_path, x))) END AS watched FROM file_cache WHERE file_path IS NOT NULL",
)
def watched_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_cache").where("file_path is not null").select("file_path", X.watched(F.col("file_path")).alias("watched")).distinct()


@R.add("edit_guard", f"WITH {_ONE} SELECT id, CASE WHEN signature IS NULL OR raw_body IS NULL THEN 'missing' WHEN len(trim(signature, ' ')) < 5 THEN 'too short' END AS refused FROM one")
def edit_guard(spark: SparkSession, d: str) -> DataFrame:
    return latest_nodes(spark, d, ["signature", "raw_body"]).select("id", X.guarded(F.col("signature"), F.col("raw_body")).alias("refused"))


@R.add("clamped_messages", f"WITH {_OBS} SELECT id, CASE WHEN len(content) > 250 THEN left(content, 247) || '...' ELSE content END AS message FROM ob")
def clamped_messages(spark: SparkSession, d: str) -> DataFrame:
    return observations_of(spark, d).select("id", clamp_message(F.col("content")).alias("message"))


@R.add("skill_texts", f"WITH {_MEM} SELECT key, concat_ws(' ', key, category) AS text FROM m WHERE category = 'skill'")
def skill_texts(spark: SparkSession, d: str) -> DataFrame:
    return memories_of(spark, d).where("category = 'skill'").select("key", skill_text(F.col("key"), F.col("category")).alias("text"))


_WORK = "w AS (SELECT lower(source) AS source, sum(n_chars)::DOUBLE AS volume, count(*)::DOUBLE * 100 AS rivals FROM documents WHERE source IS NOT NULL GROUP BY 1)"


@R.add("keyword_scores", f"WITH {_WORK} SELECT source, CASE WHEN rivals = 0 THEN 0.0 ELSE round((least(rivals / 50000, 1) * 0.7 + least(volume / 1000000, 1) * 0.3) * 100, 1) END::DOUBLE AS difficulty, round(least(least(volume / 100000 * 40, 40) + greatest(30 - rivals / 500, 0) + 0.5 * 30, 100), 1)::DOUBLE AS potential FROM w")
def keyword_scores(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").where("source is not null").groupBy(F.lower("source").alias("source")).agg(F.sum("n_chars").cast("double").alias("volume"), (F.count(F.lit(1)).cast("double") * 100).alias("rivals"))
    return w.select("source", X.keyword_difficulty(F.col("volume"), F.col("rivals")).alias("difficulty"), X.keyword_potential(F.col("volume"), F.col("rivals"), F.lit(0.5)).alias("potential"))


@R.add("highlight")
def highlight(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a word that begins with a term, around the first one."""
    shown = table(spark, d, "documents").select("doc_id", X.highlighted(F.col("text"), ["harbor", "latt"]).alias("snippet"))
    return shown.where("snippet is not null")


@R.add("graph_nodes_json", f"WITH {_ONE} SELECT id, json_object('id', id, 'label', coalesce(fqn, name), 'kind', lower(type)) AS node FROM one WHERE coalesce(fqn, name) IS NOT NULL AND type IS NOT NULL")
def graph_nodes_json(spark: SparkSession, d: str) -> DataFrame:
    n = latest_nodes(spark, d, ["type", "name", "fqn"]).where("coalesce(fqn, name) is not null and type is not null")
    return n.select("id", F.to_json(F.struct("id", F.coalesce("fqn", "name").alias("label"), F.lower("type").alias("kind"))).alias("node"))


@R.add("unique_findings", "WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+/[a-z_]+\\.(?:py|ts)')) AS path FROM documents WHERE text IS NOT NULL) SELECT DISTINCT doc_id, path FROM f")
def unique_findings(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[a-z]+/[a-z_]+\.(?:py|ts)"), F.lit(0))).alias("path"))
    return hits.dropDuplicates(["doc_id", "path"])
