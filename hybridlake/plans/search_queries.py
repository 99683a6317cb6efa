"""Search queries over documents, memories, nodes, observations and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridlake.functions import text as T
from hybridlake.functions.embedding import hashing_model, memory_text
from hybridlake.operators import fusion, lexical, retrieval, vector
from hybridlake.plans.registry import Registry
from hybridlake.session import cut_lineage
from hybridlake.sources.tables import table

R = Registry()

_FOLD = f"translate(lower(coalesce({{0}}, '')), '{T.ACCENTED}', '{T.BASE}')"
_TOKENS = "list_filter(regexp_split_to_array(" + _FOLD + r", '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def rank_sql(name: str, source: str, key: str, texts: list[str], terms: list[str], where: str = "true") -> str:
    """CTEs {name}_t, {name}_s and {name} (key, score): the prefix ranking in SQL."""
    columns = ", ".join(f"{_TOKENS.format(t)} AS t{i}" for i, t in enumerate(texts))

    def count(t: str, words: list[str]) -> str:
        if len(words) == 1:
            return f"len(list_filter({t}, lambda x: starts_with(x, '{words[0]}')))"
        same = " AND ".join([*(f"{t}[i + {j}] = '{w}'" for j, w in enumerate(words[:-1])), f"starts_with({t}[i + {len(words) - 1}], '{words[-1]}')"])
        return f"len(list_filter(range(1, len({t}) + 2 - {len(words)}), lambda i: {same}))"

    tf = ", ".join(f"({' + '.join(count(f't{c}', p.split()) for c in range(len(texts)))})::DOUBLE AS tf{i}" for i, p in enumerate(terms))
    length = " + ".join(f"len(t{c})" for c in range(len(texts)))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * d / avgd))" for i in range(len(terms)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""{name}_t AS (SELECT key, keep, {length} AS d, {tf} FROM (SELECT {key} AS key, ({where}) AS keep, {columns} FROM {source})),
    {name}_s AS (SELECT count(*) AS n, avg(d) AS avgd, {df} FROM {name}_t),
    {name} AS (SELECT key, {score} AS score FROM {name}_t, {name}_s WHERE keep AND ({hit}))"""


def vector_sql(name: str, source: str, key: str, text: str, query: str) -> str:
    """CTEs of {name} (key, place): rows by distance of their hashing vectors to the query's."""
    bucket = "('0x' || left(md5(t), 6))::BIGINT % 64"
    return f"""{name}_b AS (SELECT key, {bucket} AS b, count(*)::DOUBLE AS c FROM (SELECT {key} AS key, unnest({_TOKENS.format(text)}) AS t FROM {source}) GROUP BY ALL),
    {name}_q AS (SELECT {bucket} AS b, count(*)::DOUBLE AS c FROM (SELECT unnest(string_split('{query}', ' ')) AS t) GROUP BY ALL),
    {name}_c AS (SELECT key, sqrt(sum(v.c * v.c)) AS n, coalesce(sum(v.c * q.c), 0) AS dot FROM {name}_b v LEFT JOIN {name}_q q USING (b) GROUP BY key),
    {name}_d AS (SELECT key, round(sqrt(greatest(0, 2 - 2 * dot / (n * (SELECT sqrt(sum(c * c)) FROM {name}_q)))), 9) AS distance FROM {name}_c),
    {name} AS (SELECT key, row_number() OVER (ORDER BY distance, key) - 1 AS place FROM {name}_d)"""


# --- single rankings -------------------------------------------------------------------------

_TERMS = ["harbor", "queue", "latt"]


@R.add("bm25_search", f"WITH {rank_sql('r', 'documents', 'doc_id', ['text'], _TERMS)} SELECT key AS doc_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, key LIMIT 20")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    ranked = lexical.prefix_rank(table(spark, d, "documents"), F.col("doc_id"), [F.col("text")], _TERMS)
    return lexical.top(ranked, 20).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@R.add("bm25_postings", f"WITH {rank_sql('r', 'documents', 'doc_id', ['text'], _TERMS)} SELECT key AS doc_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, key LIMIT 20")
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    n, mean = docs.agg(F.count(F.lit(1)), F.avg(F.size(T.index_tokens(F.col("text"))))).first()
    ranked = lexical.rank_postings(lexical.postings(docs, F.col("doc_id"), F.col("text")), _TERMS, n, mean or 1.0)
    return lexical.top(ranked, 20).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


_OKAPI = """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda x: len(x) > 2) AS t FROM documents),
c AS (SELECT doc_id, len(t) AS d, len(list_filter(t, lambda x: x = 'harbor'))::DOUBLE AS a, len(list_filter(t, lambda x: x = 'ledger'))::DOUBLE AS b FROM t),
s AS (SELECT count(*) AS n, avg(d) AS avgd, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c),
r AS (SELECT doc_id, 2 * ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * d / avgd)) + ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * d / avgd)) AS score FROM c, s)
SELECT doc_id, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY r.score DESC, doc_id LIMIT 20
"""


@R.add("bm25_okapi", _OKAPI)
def bm25_okapi(spark: SparkSession, d: str) -> DataFrame:
    ranked = lexical.okapi(table(spark, d, "documents"), F.col("doc_id"), F.col("text"), "harbor of ledger, Harbor")
    return lexical.top(ranked, 20).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def _knn(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "embeddings")
        found = vector.nearest_to_each(
            rows.where("vec_id % 20 = 0"), rows, query_id=F.col("vec_id"), row_id=F.col("vec_id"), query_vector=F.col("embedding"), row_vector=F.col("embedding"), k=10, metric=metric
        )
        return found.select("query_id", "row_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))

    return run


for _name, _metric, _distance in (("knn_l2", "l2", "list_distance"), ("knn_cosine", "cosine", "list_cosine_distance")):
    R.add(
        _name,
        f"""WITH p AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, {_distance}(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS distance
            FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS rank FROM p)
        SELECT query_id, row_id, round(distance, 6) AS distance, rank FROM n WHERE rank <= 10""",
    )(_knn(_metric))

_SYMBOL = """
SELECT n.id, n.fqn, n.category, round(r.score, 6) AS score FROM r JOIN one n ON n.id = r.key
ORDER BY CASE WHEN n.category = 'SOURCE' THEN 0 ELSE 1 END, r.score DESC, n.id LIMIT 25
"""
_SYMBOL_TERMS = ["score", "gasket"]
_ONE_NODE = "one AS (SELECT id, unnest(max({'a': ingested_at, 'name': name, 'fqn': fqn, 'docstring': docstring, 'signature': signature, 'category': category})) FROM nodes GROUP BY id)"


def latest_nodes(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """Each node once, at its latest delivery."""
    return table(spark, d, "nodes").groupBy("id").agg(F.max(F.struct("ingested_at", *columns)).alias("m")).select("id", *[F.col(f"m.{c}").alias(c) for c in columns])


@R.add("symbol_search", f"WITH {_ONE_NODE}, {rank_sql('r', 'one', 'id', ['name', 'fqn', 'docstring', 'signature'], _SYMBOL_TERMS)} {_SYMBOL}")
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    nodes = latest_nodes(spark, d, ["name", "fqn", "docstring", "signature", "category"])
    ranked = lexical.prefix_rank(nodes, F.struct("id", "fqn", "category"), [F.col(c) for c in ("name", "fqn", "docstring", "signature")], T.symbol_query("score-gasket x"))
    rows = ranked.select("key.id", "key.fqn", "key.category", "score")
    source_first = F.when(F.col("category") == "SOURCE", 0).otherwise(1)
    return rows.orderBy(source_first, F.col("score").desc(), "id").limit(25).withColumn("score", F.round("score", 6))


# --- fused rankings --------------------------------------------------------------------------

_QUERY = "release queue"
_MEMORY_TERMS = ["release", "queue"]
_LIMIT = 10
_LISTS = f"""
{rank_sql('m', 'documents', 'doc_id', ['text'], _MEMORY_TERMS)},
fts AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) - 1 AS place FROM m QUALIFY place < 20),
q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
near AS (SELECT d.doc_id AS key, list_distance(e.embedding::DOUBLE[], q.v::DOUBLE[]) AS distance FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, q),
vec AS (SELECT key, row_number() OVER (ORDER BY distance, key) - 1 AS place FROM near QUALIFY place < 20)"""
_RRF_SQL = "rrf AS (SELECT key, sum(1 / (place + 60)) AS rrf FROM (SELECT key, place FROM fts UNION ALL SELECT key, place FROM vec) GROUP BY key)"


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector a test query stands for: the first of the embeddings."""
    row = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else []


def _document_lists(spark: SparkSession, d: str) -> list[DataFrame]:
    docs = table(spark, d, "documents")
    ranked = lexical.prefix_rank(docs, F.col("doc_id"), [F.col("text")], T.memory_query(_QUERY))
    fts = fusion.ranked_list(ranked, "fts", [F.col("score").desc(), F.col("key")], 2 * _LIMIT)
    vectors = table(spark, d, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id")
    near = vector.nearest(vectors, F.col("vec_id"), F.col("embedding"), query_vector(spark, d), 2 * _LIMIT)
    vec = fusion.ranked_list(near, "vec", [F.col("distance"), F.col("key")], 2 * _LIMIT)
    return [fts.select("key", "place", "list"), vec.select("key", "place", "list")]


@R.add("rrf_fusion", f"WITH {_LISTS}, {_RRF_SQL} SELECT key AS doc_id, round(rrf, 9) AS rrf FROM rrf")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_document_lists(spark, d)).select(F.col("key").alias("doc_id"), F.round("rrf", 9).alias("rrf"))


@R.add(
    "concat_search",
    f"""WITH {_LISTS}, u AS (SELECT key, place, 0 AS l FROM vec UNION ALL SELECT key, place, 1 FROM fts),
    o AS (SELECT key, min(l * 1000 + place) AS place FROM u GROUP BY key)
    SELECT key AS doc_id, row_number() OVER (ORDER BY place) AS position FROM o QUALIFY position <= {_LIMIT}""",
)
def concat_search(spark: SparkSession, d: str) -> DataFrame:
    """Vector hits, then full-text hits, each key at its first place, cut to the limit."""
    fts, vec = _document_lists(spark, d)
    both = vec.select("key", F.col("place").alias("at")).unionByName(fts.select("key", (F.col("place") + 1000).alias("at")))
    first = both.groupBy("key").agg(F.min("at").alias("at"))
    ranked = fusion.ranked_list(first, "all", [F.col("at")], _LIMIT)
    return ranked.select(F.col("key").alias("doc_id"), (F.col("place") + 1).cast("long").alias("position"))


_SKILL_ROWS = "one AS (SELECT key, unnest(max({'u': updated_at, 'content': content, 'tags': tags, 'category': category})) FROM memories GROUP BY key)"
_MEMORY_TEXT = "'category: ' || coalesce(category, '') || chr(10) || coalesce(content, '')"
_BY_CATEGORY = "CASE WHEN lower(category) IN ('rule', 'skill', 'decision', 'protocol') THEN 0.05 WHEN lower(category) IN ('resource', 'example') THEN -0.3 ELSE 0.0 END"


def _knowledge(name: str, terms: list[str], k: int, where: str = "true") -> str:
    return f"{rank_sql(name + 'r', 'one', 'key', ['key', 'content', 'tags', 'category'], terms, where)}, {name} AS (SELECT key, row_number() OVER (ORDER BY round(score, 9) DESC, key) - 1 AS place FROM {name}r QUALIFY place < {k})"


def with_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Each key's latest memory with the hashing vector of its text."""
    one = table(spark, d, "memories").groupBy("key").agg(F.max(F.struct("updated_at", "content", "tags", "category")).alias("m")).select("key", "m.content", "m.tags", "m.category")
    # Written as the store's vector table, since several lists read it.
    return one.join(cut_lineage(vector.embed(one, F.col("key"), memory_text(F.col("category"), F.col("content")), hashing_model)), "key", "left")


def text_vector(query: str) -> list[float]:
    v = hashing_model([query])[0]
    return (v / (v @ v) ** 0.5).tolist() if v.any() else []


@R.add(
    "hybrid_search",
    f"""WITH {_SKILL_ROWS}, {_knowledge('fts', ['legacy queue'], 20)}, {vector_sql('v', 'one', 'key', _MEMORY_TEXT, 'legacy queue')},
    rrf AS (SELECT key, sum(1 / (place + 60)) AS rrf FROM (SELECT key, place FROM fts UNION ALL SELECT key, place FROM v WHERE place < 20) GROUP BY key),
    s AS (SELECT key, category, left(content, 200) AS snippet, rrf, CASE WHEN lower(key) = 'legacy-queue' THEN 0.5 WHEN contains(lower(key), 'legacy-queue') THEN 0.1 ELSE 0.0 END + {_BY_CATEGORY} AS boost FROM rrf JOIN one USING (key))
    SELECT key, category, snippet, round(rrf, 6) AS rrf, round(boost::DOUBLE, 6) AS boost, round(rrf + boost::DOUBLE, 6) AS total_score FROM s ORDER BY round(s.rrf + s.boost::DOUBLE, 6) DESC, key LIMIT 10""",
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Memories by full text and vectors, each twice the limit, fused, boosted, cut to the limit."""
    found = retrieval.hybrid(with_vectors(spark, d), "legacy-queue", text_vector("legacy queue"))
    return found.withColumns({"rrf": F.round("rrf", 6), "boost": F.round("boost", 6)})


@R.add(
    "skill_search",
    f"""WITH {_SKILL_ROWS}, {_knowledge('fts', ['release', 'queue'], 10, "category = 'skill'")}, {vector_sql('v', 'one', 'key', _MEMORY_TEXT, 'release queue')},
    rrf AS (SELECT key, sum(1 / (place + 60)) AS rrf FROM (SELECT key, place FROM fts UNION ALL SELECT key, place FROM v WHERE place < 20) GROUP BY key)
    SELECT o.key, left(o.content, 400) AS summary, round(rrf, 6) AS score FROM rrf JOIN one o USING (key) ORDER BY round(rrf.rrf, 6) DESC, o.key LIMIT 10""",
)
def skill_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.skills(with_vectors(spark, d), "release queue", text_vector("release queue"))


_CODE_TEXT = "concat_ws(chr(10), concat_ws(' ', type, fqn), 'Sig: ' || signature, left(raw_body, 1200))"
_UNIFIED = f"""WITH {_SKILL_ROWS}, {_knowledge('kf', ['queue'], 20)}, {vector_sql('kv', 'one', 'key', _MEMORY_TEXT, 'queue')},
nod AS (SELECT id, unnest(max({{'a': ingested_at, 'type': type, 'name': name, 'fqn': fqn, 'docstring': docstring, 'signature': signature, 'raw_body': raw_body}})) FROM nodes GROUP BY id),
{rank_sql('cr', 'nod', 'id', ['name', 'fqn', 'docstring', 'signature'], ['queue'])},
cf AS (SELECT key, row_number() OVER (ORDER BY round(score, 9) DESC, key) - 1 AS place FROM cr QUALIFY place < 10), {vector_sql('cv', 'nod', 'id', _CODE_TEXT, 'queue')},
ob AS (SELECT id, unnest(min({{'a': ingested_at, 'content': content, 'created_at': created_at, 'type': type}})) FROM observations GROUP BY id),
obs AS (SELECT id AS key, row_number() OVER (ORDER BY created_at DESC, id) - 1 AS place FROM ob WHERE content ILIKE '%queue%' QUALIFY place < 20),
every AS (SELECT 'code:' || n.fqn AS key, place FROM cv JOIN nod n ON n.id = cv.key WHERE place < 20 UNION ALL SELECT 'knowledge:' || key, place FROM kv WHERE place < 20 UNION ALL SELECT 'observation:' || key, place FROM obs
  UNION ALL SELECT 'knowledge:' || key, place FROM kf UNION ALL SELECT 'code:' || n.fqn, place FROM cf JOIN nod n ON n.id = cf.key),
f AS (SELECT key, sum(1 / (place + 60)) AS rrf FROM every GROUP BY key),
s AS (SELECT f.key, round(rrf + CASE WHEN o.key IS NULL THEN 0.0 ELSE CASE WHEN lower(o.key) = 'queue' THEN 0.5 WHEN contains(lower(o.key), 'queue') THEN 0.1 ELSE 0.0 END + {_BY_CATEGORY} END::DOUBLE, 6) AS score FROM f LEFT JOIN one o ON f.key = 'knowledge:' || o.key)
SELECT key, score FROM s ORDER BY s.score DESC, key LIMIT 10"""


@R.add("unified_search", _UNIFIED)
def unified_search(spark: SparkSession, d: str) -> DataFrame:
    """One fused list over code and knowledge (vectors and full text) and observations (newest that contain the query)."""
    columns = ["type", "name", "fqn", "docstring", "signature", "raw_body"]
    nodes = latest_nodes(spark, d, columns)
    vectors = cut_lineage(vector.embed(nodes, F.col("id"), T.embedding_text(*[F.col(c) for c in ("type", "fqn", "signature", "raw_body")]), hashing_model))
    nodes = nodes.join(vectors.withColumnRenamed("key", "id"), "id", "left")
    seen = table(spark, d, "observations").groupBy("id").agg(F.min(F.struct("ingested_at", "content", "created_at", "type")).alias("m")).select("id", "m.content", "m.created_at", "m.type")
    return retrieval.unified(with_vectors(spark, d), nodes, seen, "queue", text_vector("queue"))
