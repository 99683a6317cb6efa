"""Queries of the store, the observation log and the symbol graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridlake.operators import graph, store
from hybridlake.plans.registry import Registry
from hybridlake.plans.search_queries import latest_nodes
from hybridlake.sources.tables import table

R = Registry()

_NODES = "one AS (SELECT id, unnest(max({'a': ingested_at, 'type': type, 'name': name, 'fqn': fqn, 'language': language, 'module': module})) FROM nodes GROUP BY id)"
_EDGES = "e AS (SELECT id, unnest(min({'a': ingested_at, 'source_id': source_id, 'target_id': target_id, 'type': type})) FROM edges GROUP BY id)"
_OBS = "ob AS (SELECT id, unnest(min({'a': ingested_at, 'content': content, 'created_at': created_at, 'type': type, 'session_id': session_id, 'file_paths': file_paths})) FROM observations GROUP BY id)"


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    return latest_nodes(spark, d, ["type", "name", "fqn", "language", "module"])


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    """Each edge once, at its earliest delivery."""
    e = table(spark, d, "edges").groupBy("id").agg(F.min(F.struct("ingested_at", "source_id", "target_id", "type")).alias("m"))
    return e.select("id", "m.source_id", "m.target_id", "m.type")


def observations_of(spark: SparkSession, d: str) -> DataFrame:
    columns = ["content", "created_at", "type", "session_id", "file_paths"]
    return table(spark, d, "observations").groupBy("id").agg(F.min(F.struct("ingested_at", *columns)).alias("m")).select("id", *[F.col(f"m.{c}").alias(c) for c in columns])


# --- store -----------------------------------------------------------------------------------


@R.add(
    "keep_latest_nodes",
    "SELECT id, name, fqn, strftime(ingested_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, fqn, name) = 1",
)
def keep_latest_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = store.keep_latest(table(spark, d, "nodes"), ["id"], [F.col("ingested_at").desc(), F.col("fqn"), F.col("name")])
    return n.select("id", "name", "fqn", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@R.add(
    "edges_insert_ignore",
    """WITH a AS (SELECT * FROM edges WHERE ingested_at < TIMESTAMPTZ '2025-06-01 00:00:00+00'), b AS (SELECT * FROM edges WHERE ingested_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00')
    SELECT id, source_id, target_id, type FROM b WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.source_id = b.source_id AND a.target_id = b.target_id AND a.type = b.type)
    QUALIFY row_number() OVER (PARTITION BY source_id, target_id, type ORDER BY ingested_at, id) = 1""",
)
def edges_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    e, cut = table(spark, d, "edges"), F.lit("2025-06-01 00:00:00").cast("timestamp")
    new = e.where((F.col("ingested_at") >= cut) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    return store.insert_or_ignore(e.where(F.col("ingested_at") < cut), new, ["source_id", "target_id", "type"], [F.col("ingested_at"), F.col("id")]).select("id", "source_id", "target_id", "type")


@R.add(
    "memory_upsert",
    """WITH m AS (SELECT * FROM memories QUALIFY row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, content) = 1),
    cut AS (SELECT quantile_disc(updated_at, 0.5) AS c FROM memories),
    o AS (SELECT m.* FROM m, cut WHERE updated_at <= c), n AS (SELECT * FROM memories, cut WHERE updated_at > c QUALIFY row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, content) = 1),
    old AS (SELECT * FROM memories, cut WHERE updated_at <= c QUALIFY row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, content) = 1)
    SELECT coalesce(old.key, n.key) AS key, CASE WHEN n.key IS NOT NULL THEN coalesce(n.category, 'general') ELSE old.category END AS category,
      md5(CASE WHEN n.key IS NOT NULL THEN n.content ELSE old.content END) AS content_md5, (coalesce(old.access_count, 0) + CASE WHEN n.key IS NOT NULL AND old.key IS NOT NULL THEN 1 ELSE 0 END)::INTEGER AS access_count,
      coalesce(old.created_at, 2000000000)::BIGINT AS created_at, CASE WHEN n.key IS NOT NULL THEN 2000000000 ELSE old.updated_at END::BIGINT AS updated_at
    FROM old FULL OUTER JOIN n ON old.key = n.key""",
)
def memory_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The newer half of all rows, by update time, is written over the older half."""
    m = table(spark, d, "memories")
    cut = m.agg(F.expr("percentile_disc(0.5) within group (order by updated_at)").alias("c")).first()[0]
    order = [F.col("updated_at").desc(), F.col("content")]
    old = store.keep_latest(m.where(F.col("updated_at") <= F.lit(cut)), ["key"], order)
    out = store.upsert_memories(old, m.where(F.col("updated_at") > F.lit(cut)), 2_000_000_000)
    return out.select("key", "category", F.md5("content").alias("content_md5"), "access_count", "created_at", "updated_at")


@R.add(
    "delete_files_cascade",
    f"""WITH {_EDGES}, gone AS (SELECT DISTINCT id FROM nodes WHERE file_path IN (SELECT file_path FROM node_deletions))
    SELECT type, count(*) AS n_edges FROM e WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = e.source_id) AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = e.target_id) GROUP BY type""",
)
def delete_files_cascade(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "node_deletions").select("file_path").where("file_path is not null").distinct()
    _, kept = store.delete_files(table(spark, d, "nodes"), edges_of(spark, d), paths)
    return kept.groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"))


@R.add(
    "change_classify",
    """WITH o AS (SELECT file_path, hash FROM file_cache WHERE last_indexed_at <= 1748736000 QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY last_indexed_at DESC, hash) = 1),
    n AS (SELECT file_path, hash FROM file_cache WHERE last_indexed_at > 1743465600 QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY last_indexed_at DESC, hash) = 1)
    SELECT coalesce(n.file_path, o.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'created' WHEN n.file_path IS NULL THEN 'deleted' WHEN o.hash IS NOT DISTINCT FROM n.hash THEN 'skipped' ELSE 'updated' END AS status
    FROM n FULL OUTER JOIN o ON n.file_path = o.file_path""",
)
def change_classify(spark: SparkSession, d: str) -> DataFrame:
    """The state at one date against what was indexed since an earlier one."""
    f = table(spark, d, "file_cache")
    latest = lambda df: store.keep_latest(df, ["file_path"], [F.col("last_indexed_at").desc(), F.col("hash")])
    return store.classify_changes(latest(f.where("last_indexed_at <= 1748736000")), latest(f.where("last_indexed_at > 1743465600")), "file_path", "hash")


@R.add("vec_backlog", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def vec_backlog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@R.add(
    "index_stats",
    "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM memories) AS memories, (SELECT count(*) FROM observations) AS observations, (SELECT max(last_indexed_at) FROM file_cache) AS last_indexed_at",
)
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "file_cache").agg(F.max("last_indexed_at").alias("last_indexed_at"))
    for name in ("observations", "memories", "edges", "nodes"):
        # One row beside one row.
        out = table(spark, d, name).agg(F.count(F.lit(1)).alias(name)).join(out, F.lit(True))
    return out


@R.add("memory_stats", "SELECT coalesce(category, 'none') AS category, count(*) AS n, count(DISTINCT key) AS n_keys, sum(access_count)::BIGINT AS accesses FROM memories GROUP BY 1")
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_keys"), F.sum("access_count").alias("accesses"))


@R.add(
    "access_counter",
    """WITH m AS (SELECT key, access_count FROM memories QUALIFY row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, content) = 1)
    SELECT category, count(*) AS n_keys, sum(access_count)::BIGINT AS accesses FROM (SELECT split_part(key, '::', 1) AS category, access_count + 1 AS access_count FROM m) GROUP BY category""",
)
def access_counter(spark: SparkSession, d: str) -> DataFrame:
    """Every key is read once."""
    m = store.keep_latest(table(spark, d, "memories"), ["key"], [F.col("updated_at").desc(), F.col("content")])
    counted = store.count_accesses(m, m.select("key"))
    return counted.groupBy(F.split("key", "::")[0].alias("category")).agg(F.count(F.lit(1)).alias("n_keys"), F.sum("access_count").alias("accesses"))


# --- observations ----------------------------------------------------------------------------


@R.add("obs_search", f"WITH {_OBS} SELECT id, type, created_at FROM ob WHERE content ILIKE '%gra_ient%' ORDER BY created_at DESC, id LIMIT 30")
def obs_search(spark: SparkSession, d: str) -> DataFrame:
    return observations_of(spark, d).where(F.col("content").ilike("%gra_ient%")).orderBy(F.col("created_at").desc(), "id").limit(30).select("id", "type", "created_at")


@R.add("session_context", f"WITH {_OBS} SELECT session_id, id, type, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS step FROM ob WHERE session_id IS NOT NULL")
def session_context(spark: SparkSession, d: str) -> DataFrame:
    step = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "id")).cast("long")
    return observations_of(spark, d).where("session_id is not null").select("session_id", "id", "type", step.alias("step"))


@R.add(
    "inbox_export",
    f"WITH {_OBS} SELECT id, '- [PENDING] **[' || upper(type) || ']** ' || replace(coalesce(content, ''), chr(10), ' ') || ' (Session: ' || coalesce(left(session_id, 8), 'unknown') || ')' AS line FROM ob WHERE id > 100",
)
def inbox_export(spark: SparkSession, d: str) -> DataFrame:
    return store.inbox_lines(store.after_mark(observations_of(spark, d), "id", 100))


_RULE_WORDS = ["commit", "release", "schema", "token", "session"]


@R.add("keyword_rules", f"WITH {_OBS} SELECT id, array_to_string(list_filter({_RULE_WORDS!r}, lambda w: contains(lower(content), w)), ',') AS rules FROM ob WHERE len(list_filter({_RULE_WORDS!r}, lambda w: contains(lower(content), w))) > 0")
def keyword_rules(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in _RULE_WORDS])
    hits = F.filter(words, lambda w: F.contains(F.lower("content"), w))
    return observations_of(spark, d).select("id", F.array_join(hits, ",").alias("rules")).where("rules != ''")


@R.add(
    "debounce_sessions",
    """WITH l AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 600 SECOND, true) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(s::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM l)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS batch_start, count(*) AS n_events FROM b GROUP BY user_id, g""",
)
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = store.debounce_batches(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("ts"), [F.col("user_id")], 600)
    return e.groupBy("user_id", F.date_format("batch_start", "yyyy-MM-dd HH:mm:ss").alias("batch_start")).agg(F.count(F.lit(1)).alias("n_events"))


# --- graph -----------------------------------------------------------------------------------

_GE = """ge AS (SELECT n1.fqn AS source_fqn, n1.type AS source_type, coalesce(n2.fqn, e.target_id) AS target, coalesce(n2.type, 'EXTERNAL') AS target_type, e.type
  FROM e JOIN one n1 ON n1.id = e.source_id LEFT JOIN one n2 ON n2.id = e.target_id WHERE n2.id IS NOT NULL OR starts_with(e.target_id, '__unresolved'))"""
_LABEL = "CASE lower({0}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in graph.LABELS.items()) + " END"
_REL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in graph.RELATIONS.items()) + " END"
_OK = ", ".join(f"'{r}>{s}>{t}'" for r, pairs in graph.ALLOWED.items() for s, t in pairs)
_TYPED = f"""g AS (SELECT DISTINCT * FROM (SELECT {_LABEL.format('source_type')} AS src_label, source_fqn AS src, {_REL} AS rel, {_LABEL.format('target_type')} AS dst_label, target AS dst FROM ge)
  WHERE rel || '>' || src_label || '>' || dst_label IN ({_OK}))"""
_BASE = f"WITH {_NODES}, {_EDGES}, {_GE}"


@R.add("graph_edges", f"{_BASE} SELECT source_type, target_type, type, count(*) AS n, count(DISTINCT target) AS n_targets FROM ge GROUP BY ALL")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    g = graph.graph_edges(edges_of(spark, d), nodes_of(spark, d))
    return g.groupBy("source_type", "target_type", "type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("n_targets"))


@R.add("graph_build", f"{_BASE}, {_TYPED} SELECT * FROM g")
def graph_build(spark: SparkSession, d: str) -> DataFrame:
    return graph.typed_graph(edges_of(spark, d), nodes_of(spark, d))


_CALLERS = f"""WITH {_NODES}, {_EDGES} SELECT DISTINCT n.id AS callee_id, e.source_id AS caller_id, e.type FROM e JOIN one n ON n.id = e.target_id
UNION SELECT DISTINCT n.id, e.source_id, e.type FROM e JOIN one n ON '__unresolved__::' || n.name = e.target_id"""


@R.add("callers", _CALLERS)
def callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.callers(edges_of(spark, d), nodes_of(spark, d))


@R.add("callees", f"SELECT caller_id, type, count(*) AS n_callees FROM ({_CALLERS}) GROUP BY ALL")
def callees(spark: SparkSession, d: str) -> DataFrame:
    return graph.callees(edges_of(spark, d), nodes_of(spark, d)).groupBy("caller_id", "type").agg(F.count(F.lit(1)).alias("n_callees"))


@R.add("neighbors", f"{_BASE}, {_TYPED} SELECT src AS node, dst AS neighbor FROM g WHERE rel IN ('Calls', 'Contains') UNION SELECT dst, src FROM g WHERE rel IN ('Calls', 'Contains')")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbors(graph.typed_graph(edges_of(spark, d), nodes_of(spark, d)), ["Calls", "Contains"])


@R.add(
    "resolve_fqn",
    f"""WITH {_NODES}, {_EDGES}, p AS (SELECT id, string_split(substr(target_id, 21), '.') AS p FROM e WHERE starts_with(target_id, '__unresolved_fqn__::')),
    t AS (SELECT id, p[-1] AS name, array_to_string(p[:-2], '/') || '.py::' || p[-1] AS part FROM p WHERE len(p) > 1)
    SELECT t.id AS edge_id, max(n.id) AS node_id FROM t JOIN one n ON n.name = t.name AND lower(n.language) = 'python' AND contains(n.fqn, t.part) GROUP BY t.id""",
)
def resolve_fqn(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve_by_path(edges_of(spark, d), nodes_of(spark, d))


_BY_NAME = f"""WITH {_NODES}, {_EDGES}, u AS (SELECT e.id, substr(e.target_id, 17) AS name, s.language FROM e LEFT JOIN one s ON s.id = e.source_id WHERE starts_with(e.target_id, '__unresolved__::')),
same AS (SELECT name, language, max(id) AS id FROM one GROUP BY ALL), other AS (SELECT name, max(id) AS id FROM one GROUP BY ALL),
found AS (SELECT u.id AS edge_id, coalesce(same.id, other.id) AS node_id FROM u LEFT JOIN same ON same.name = u.name AND same.language = u.language LEFT JOIN other ON other.name = u.name WHERE coalesce(same.id, other.id) IS NOT NULL)"""


@R.add("resolve_name", f"{_BY_NAME} SELECT * FROM found")
def resolve_name(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve_by_name(edges_of(spark, d), nodes_of(spark, d))


@R.add(
    "resolve_apply",
    f"""{_BY_NAME}, j AS (SELECT e.*, coalesce(f.node_id, e.target_id) AS new FROM e LEFT JOIN found f ON f.edge_id = e.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id, new, type ORDER BY (new <> target_id)::INTEGER, id) AS n FROM j)
    SELECT id, source_id, CASE WHEN n = 1 THEN new ELSE target_id END AS target_id, type FROM r""",
)
def resolve_apply(spark: SparkSession, d: str) -> DataFrame:
    e = edges_of(spark, d)
    return graph.apply_resolution(e, graph.resolve_by_name(e, nodes_of(spark, d))).select("id", "source_id", "target_id", "type")


_DIRECTED = f"WITH RECURSIVE {_NODES}, {_EDGES}, {_GE}, {_TYPED}, s AS (SELECT DISTINCT src, dst FROM g WHERE rel IN ('Calls', 'Contains') AND dst_label <> 'External')"


def _directed(spark: SparkSession, d: str) -> DataFrame:
    g = graph.typed_graph(edges_of(spark, d), nodes_of(spark, d))
    return g.where("rel in ('Calls', 'Contains') and dst_label != 'External'").select("src", "dst").distinct()


@R.add(
    "impact_nhop",
    f"""{_DIRECTED}, top AS (SELECT dst AS start FROM s GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 5),
    w AS (SELECT start, start AS id, 0 AS hop FROM top UNION SELECT w.start, s.src, w.hop + 1 FROM w JOIN s ON s.dst = w.id WHERE w.hop < 3)
    SELECT start, id, min(hop)::INTEGER AS hop FROM w GROUP BY ALL""",
)
def impact_nhop(spark: SparkSession, d: str) -> DataFrame:
    """What depends, within three hops, on the five most used symbols."""
    s = _directed(spark, d)
    top = s.groupBy(F.col("dst").alias("start")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "start").limit(5).select("start")
    return graph.reachable(s.select(F.col("dst").alias("src"), F.col("src").alias("dst")), top, 3)


@R.add(
    "co_change",
    f"""WITH {_OBS}, c AS (SELECT DISTINCT id, unnest(string_split(file_paths, ',')) AS f FROM ob WHERE file_paths <> '')
    SELECT a.f AS file_a, b.f AS file_b, count(*) AS shared_commits FROM c a JOIN c b ON a.id = b.id AND a.f < b.f GROUP BY ALL HAVING count(*) >= 2""",
)
def co_change(spark: SparkSession, d: str) -> DataFrame:
    """Files named by the same observation; a row holds few, so pairs of one row are few."""
    o = observations_of(spark, d).where("file_paths != ''").select(F.col("id").alias("commit"), F.explode(F.split("file_paths", ",")).alias("file"))
    return graph.co_changes(o)


_PR = "".join(
    f""", r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15 / n.n + 0.85 * coalesce(sum(r{i}.rank / o.d), 0) AS rank FROM v CROSS JOIN n LEFT JOIN s ON s.dst = v.id LEFT JOIN r{i} ON r{i}.id = s.src LEFT JOIN o ON o.src = s.src GROUP BY v.id, n.n)"""
    for i in range(100)
)


@R.add(
    "pagerank",
    f"{_DIRECTED}, v AS MATERIALIZED (SELECT src AS id FROM s UNION SELECT dst FROM s), n AS (SELECT count(*) AS n FROM v), o AS MATERIALIZED (SELECT src, count(*) AS d FROM s GROUP BY src), r0 AS MATERIALIZED (SELECT id, 1.0 / n.n AS rank FROM v, n){_PR} SELECT id, round(rank::DOUBLE, 9) AS rank FROM r100",
)
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(_directed(spark, d)).select("id", F.round("rank", 9).alias("rank"))


@R.add("coupling", f"WITH {_NODES}, {_EDGES}, p AS (SELECT DISTINCT a.module AS x, b.module AS y FROM e JOIN one a ON a.id = e.source_id JOIN one b ON b.id = e.target_id WHERE a.module <> b.module), m AS (SELECT module, avg((lower(type) = 'interface')::INTEGER) AS abstraction FROM one WHERE module IS NOT NULL GROUP BY module), c AS (SELECT m.module, abstraction, (SELECT count(*) FROM p WHERE y = m.module) AS ca, (SELECT count(*) FROM p WHERE x = m.module) AS ce FROM m), i AS (SELECT *, CASE WHEN ca + ce = 0 THEN 0.0 ELSE ce / (ca + ce) END::DOUBLE AS i FROM c) SELECT module, ca, ce, round(i, 6) AS instability, round(abstraction, 6) AS abstraction, round(abs(abstraction + i - 1), 6) AS distance FROM i")
def coupling(spark: SparkSession, d: str) -> DataFrame:
    e = edges_of(spark, d).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    found = graph.coupling(e, nodes_of(spark, d).select("id", "module", (F.lower("type") == "interface").alias("is_abstract")))
    return found.withColumns({c: F.round(c, 6) for c in ("instability", "abstraction", "distance")})


@R.add(
    "scc",
    f"""{_DIRECTED}, r AS (SELECT id AS a, id AS b FROM (SELECT src AS id FROM s UNION SELECT dst FROM s) UNION SELECT r.a, s.dst FROM r JOIN s ON s.src = r.b)
    SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a""",
)
def scc(spark: SparkSession, d: str) -> DataFrame:
    """Strongly connected components of calls and containment."""
    return graph.strong_components(_directed(spark, d))


@R.add(
    "connected_components",
    f"""{_DIRECTED}, u AS (SELECT src, dst FROM s UNION SELECT dst, src FROM s), r AS (SELECT DISTINCT src AS a, src AS b FROM u UNION SELECT r.a, u.dst FROM r JOIN u ON u.src = r.b)
    SELECT a AS id, min(b) AS component FROM r GROUP BY a""",
)
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(_directed(spark, d))


@R.add(
    "cycles",
    f"""{_DIRECTED}, w AS (SELECT [src, dst] AS p FROM s WHERE src < dst UNION ALL SELECT list_append(w.p, s.dst) FROM w JOIN s ON s.src = w.p[-1] WHERE s.dst > w.p[1] AND NOT list_contains(w.p, s.dst) AND len(w.p) < 4),
    c AS (SELECT [src] AS p FROM s WHERE src = dst UNION ALL SELECT w.p FROM w JOIN s ON s.src = w.p[-1] AND s.dst = w.p[1])
    SELECT DISTINCT array_to_string(list_sort(p), ' > ') AS cycle, len(p)::INTEGER AS length FROM c""",
)
def cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of calls and containment of at most four symbols."""
    return graph.cycles(_directed(spark, d), 4).withColumn("cycle", F.array_join("cycle", " > "))


@R.add("label_counts", f"WITH {_NODES}, {_EDGES}, {_GE}, {_TYPED} SELECT rel, src_label, dst_label, count(*) AS n FROM g GROUP BY ALL")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    """The typed graph's edges by relation and labels."""
    return graph.typed_graph(edges_of(spark, d), nodes_of(spark, d)).groupBy("rel", "src_label", "dst_label").agg(F.count(F.lit(1)).alias("n"))
