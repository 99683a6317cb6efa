"""Queries of the operators for training data, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridlake.llm import code_origin, doc_pairs, mixing, near_dup, packing, quality, splitting, tokens
from hybridlake.plans.registry import Registry
from hybridlake.session import cut_lineage
from hybridlake.sources.tables import table

R = Registry()


def latest_memories(spark: SparkSession, d: str) -> DataFrame:
    """(key, content): of each key the row with the greatest updated_at; of equal ones the greatest content."""
    rows = table(spark, d, "memories").where("key is not null")
    return rows.groupBy("key").agg(F.max(F.struct("updated_at", "content")).alias("m")).select("key", F.col("m.content").alias("content"))


def functions_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").where(F.col("type").isin("function", "method"))


# --- p1: near-duplicate records -------------------------------------------------------------

def _p1_texts(spark: SparkSession, d: str) -> near_dup.Texts:
    bodies = functions_of(spark, d).select(F.lit("nodes").alias("t"), F.col("id").alias("k"), F.lit(None).cast("long").alias("v"), F.col("raw_body").alias("x"))
    kept = table(spark, d, "memories").select(F.lit("memories").alias("t"), F.col("key").alias("k"), F.coalesce("updated_at", F.lit(-(2**63))).alias("v"), F.col("content").alias("x"))
    return near_dup.texts(bodies.unionByName(kept), F.col("t"), F.col("k"), F.col("x"), k=3, min_words=30, version=F.col("v"))


# Exact similarities of all records that share a run of three words.
_P1_SQL = r"""
WITH x AS (
  SELECT 'nodes' AS table_name, id AS key, raw_body AS body FROM nodes WHERE type IN ('function', 'method') AND id IS NOT NULL
  UNION ALL
  SELECT 'memories', key, m.content FROM (SELECT key, max({'u': updated_at, 'content': content}) AS m FROM memories WHERE key IS NOT NULL GROUP BY key)),
w AS (SELECT table_name, key, regexp_extract_all(lower(coalesce(body, '')), '[\p{L}\p{N}_]+') AS w FROM x),
g AS (SELECT DISTINCT table_name, key, unnest(list_transform(range(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w WHERE len(w) >= 30),
n AS (SELECT table_name, key, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT a.table_name, a.key AS key_a, b.key AS key_b, count(*) AS c FROM g a JOIN g b ON a.table_name = b.table_name AND a.g = b.g AND a.key < b.key GROUP BY ALL)
SELECT c.table_name, key_a, key_b FROM c JOIN n a ON a.table_name = c.table_name AND a.key = key_a JOIN n b ON b.table_name = c.table_name AND b.key = key_b WHERE c >= 0.6 * (a.n + b.n - c)
"""


@R.add("p1_found", _P1_SQL)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    texts = _p1_texts(spark, d)
    return near_dup.expand(near_dup.members(texts), near_dup.similar_classes(texts, threshold=0.6))


@R.add("p1_groups")
def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    texts = _p1_texts(spark, d)
    return near_dup.groups(near_dup.members(texts), near_dup.similar_classes(texts, threshold=0.6))


# --- p5: splitting oversized items ----------------------------------------------------------


def _p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    # Deliveries of one node are of equal content; of others, the latest oversized one is split.
    long_bodies = table(spark, d, "nodes").where("id is not null and length(raw_body) > 2500")
    bodies = long_bodies.groupBy(F.col("id").alias("k")).agg(F.max(F.struct("ingested_at", "raw_body"))["raw_body"].alias("x"))
    texts = latest_memories(spark, d).select(F.col("key").alias("k"), F.col("content").alias("x"))
    both = bodies.withColumn("t", F.lit("nodes")).unionByName(texts.withColumn("t", F.lit("memories")))
    return splitting.split_oversized(both, F.col("t"), F.col("k"), F.col("x"), limit=2500, overlap=400)


@R.add(
    "p5_found",
    """
    SELECT DISTINCT 'nodes' AS table_name, id AS item_key FROM nodes WHERE length(raw_body) > 2500
    UNION ALL
    SELECT 'memories', key FROM (SELECT key, unnest(max({'u': updated_at, 'c': content})) FROM memories GROUP BY key) WHERE length(c) > 2500
    """,
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5_pieces(spark, d).where("piece_no = 0").select("table_name", "item_key")


@R.add("p5_pieces")
def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _p5_pieces(spark, d)


@R.add(
    "p5_tiling",
    """
    SELECT 'nodes' AS table_name, id AS item_key, length(b)::BIGINT AS n_chars, md5(b) AS text_md5, true AS within_limit, true AS overlaps_repeat FROM (SELECT id, unnest(max({'a': ingested_at, 'b': raw_body})) FROM nodes WHERE length(raw_body) > 2500 GROUP BY id)
    UNION ALL
    SELECT 'memories', key, length(c), md5(c), true, true FROM (SELECT key, unnest(max({'u': updated_at, 'c': content})) FROM memories GROUP BY key) WHERE length(c) > 2500
    """,
)
def p5_tiling(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces add up to: joined without their overlaps they are the text, and each overlap repeats the end of the piece before."""
    p = _p5_pieces(spark, d)
    body = F.substr("piece", F.col("n_overlap") + 1)
    before = F.lag("piece").over(Window.partitionBy("table_name", "item_key").orderBy("piece_no"))
    repeats = F.when(F.col("piece_no") == 0, F.col("n_overlap") == 0).otherwise((F.col("n_overlap") <= 400) & F.endswith(before, F.substring("piece", F.lit(1), F.col("n_overlap"))))
    rows = p.withColumns({"repeats": repeats, "body": body}).groupBy("table_name", "item_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "body"))), lambda x: x["body"]), "").alias("text"), F.bool_and(F.length("piece") <= 2500).alias("within_limit"), F.bool_and("repeats").alias("overlaps_repeat")
    )
    return rows.select("table_name", "item_key", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"), "within_limit", "overlaps_repeat")


# --- p6: filling containers -----------------------------------------------------------------


def _p6_packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sizes = cut_lineage(tokens.with_token_counts(docs, {"item_id": F.col("doc_id")}, F.col("text")))
    profiles = table(spark, d, "pack_profiles").select("profile", F.col("capacity_tokens").alias("capacity"))
    return packing.pack(sizes, profiles)


@R.add("p6_containers")
def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return _p6_packed(spark, d).withColumnRenamed("item_id", "doc_id")


@R.add("p6_report")
def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(_p6_packed(spark, d))


@R.add("p6_placed", "SELECT profile, (SELECT count(*) FROM documents WHERE text <> '') AS n_docs, true AS all_fit, true AS cut_only_if_larger FROM pack_profiles")
def p6_placed(spark: SparkSession, d: str) -> DataFrame:
    """Whether every document is placed, containers keep their capacity, and none is cut that fits whole."""
    p = _p6_packed(spark, d)
    used = p.groupBy("profile", "capacity", "shard", "container").agg(F.sum("n_tokens").alias("used")).groupBy("profile").agg(F.bool_and(F.col("used") <= F.col("capacity")).alias("all_fit"))
    docs = p.groupBy("profile", "capacity", "item_id").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("pieces"))
    each = docs.groupBy("profile").agg(F.count(F.lit(1)).alias("n_docs"), F.bool_and((F.col("pieces") == 1) | (F.col("size") > F.col("capacity"))).alias("cut_only_if_larger"))
    return each.join(used, "profile")


# --- p7: mixing sources ---------------------------------------------------------------------


def _p7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = tokens.with_token_counts(table(spark, d, "documents"), {"doc_id": F.col("doc_id"), "source": F.col("source")}, F.col("text"))
    return mixing.mix(sizes, table(spark, d, "mix_targets"))


@R.add("p7_mixture")
def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d)[0]


@R.add("p7_shares")
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d)[1]


_SOURCE = r"nullif(regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[\s-]+', '_', 'g'), '')"


@R.add(
    "p7_kept",
    f"WITH h AS (SELECT {_SOURCE} AS s, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1) SELECT t.source, t.target_share, coalesce(h.n, 0) AS n_docs, true AS repeats_kept, true AS share_reached FROM mix_targets t LEFT JOIN h ON h.s = {_SOURCE.replace('source', 't.source')}",
)
def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether no record is used more often than allowed, and shares are within two points of the reachable ones."""
    report = _p7(spark, d)[1]
    most = table(spark, d, "mix_targets").select("source", "max_repeats").withColumn("_s", mixing.source_name(F.col("source")))
    rows = most.join(F.broadcast(report.withColumnRenamed("source", "_s")), "_s")
    return rows.select("source", "target_share", "n_docs", (F.col("max_copies") <= F.col("max_repeats")).alias("repeats_kept"), (F.abs(F.col("actual_share") - F.col("reachable_share")) <= 0.02).alias("share_reached"))


# --- p8: text quality -----------------------------------------------------------------------


def _p8_scored(spark: SparkSession, d: str) -> DataFrame:
    return quality.outlier_scores(quality.statistics(table(spark, d, "documents"), F.col("doc_id"), F.col("lang"), F.col("text")))


@R.add("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.found(_p8_scored(spark, d)).select("doc_id")


@R.add("p8_statistics")
def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _p8_scored(spark, d)


@R.add("p8_words", r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{Nl}\p{No}]+'))::BIGINT AS n_words FROM documents")
def p8_words(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"), F.col("doc_id"), F.col("lang"), F.col("text")).select("doc_id", "n_words")


# --- p4: functions with their documentation -------------------------------------------------


@R.add("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return doc_pairs.pairs(table(spark, d, "nodes")).select("node_id").where("node_id is not null").distinct()


@R.add("p4_pairs")
def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return doc_pairs.one_per_node(doc_pairs.pairs(table(spark, d, "nodes")))


# --- p2: files that weren't written by hand -------------------------------------------------


def _p2_origins(spark: SparkSession, d: str) -> DataFrame:
    return code_origin.file_origins(table(spark, d, "file_cache"), table(spark, d, "nodes"))


@R.add("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2_origins(spark, d).where("origin != 'hand-written'").select("file_path")


@R.add("p2_origins")
def p2_origins(spark: SparkSession, d: str) -> DataFrame:
    return _p2_origins(spark, d)
