"""Hybrid retrieval: full-text and vector lists fused by reciprocal ranks, over memories, skills and symbols.

memories: (key, category, content, tags, vector), keys unique. nodes: (id, fqn, type, name, docstring,
signature, vector), ids unique. observations: (id, type, content, created_at), ids unique. Vectors come
from any model (`vector.embed`) or from `hashing_model`; rows without one stay in the full-text lists.
Every list is cut before it is fused, so what is joined and broadcast holds at most a few times the limit.

Defined results: equal scores and equal distances (to nine digits) are ordered by key; a query without
terms has an empty full-text list; null contents match nothing; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridlake.functions.text import memory_query, symbol_query
from hybridlake.operators import fusion, lexical, vector

KNOWLEDGE_COLUMNS = ("key", "content", "tags", "category")
CODE_COLUMNS = ("name", "fqn", "docstring", "signature")


def text_list(df: DataFrame, key: str, columns: tuple[str, ...], terms: list[str], k: int, where: Column | None = None) -> DataFrame:
    """(key, place): the k best by full text."""
    ranked = lexical.prefix_rank(df, F.col(key), [F.col(c) for c in columns], terms, where=where)
    return fusion.ranked_list(ranked, "text", [F.round("score", 9).desc(), F.col("key")], k).select("key", "place")


def vector_list(df: DataFrame, key: str, query: list[float], k: int) -> DataFrame:
    """(key, place): the k nearest to the query's vector; none without one."""
    if not query:
        return df.where(F.lit(False)).select(F.col(key).alias("key"), F.lit(0).alias("place"))
    near = vector.nearest(df, F.col(key), F.col("vector"), query, k, digits=9)
    return fusion.ranked_list(near, "vector", [F.col("distance"), F.col("key")], k).select("key", "place")


def hybrid(memories: DataFrame, query: str, query_vector: list[float], *, limit: int = 10, snippet: int = 200, category: str | None = None) -> DataFrame:
    """(key, category, snippet, rrf, boost, total_score): both lists of twice the limit, fused, boosted by key
    and category, the best `limit`. A category is applied to the full-text search and to the vector list's result."""
    # What is searched is compared in lower case; a category keeps full-text rows before, vector rows after their top-k.
    wanted = None if category is None else F.lower("category") == category.lower()
    lists = [text_list(memories, "key", KNOWLEDGE_COLUMNS, memory_query(query), 2 * limit, wanted), vector_list(memories, "key", query_vector, 2 * limit)]
    both = memories.select("key", "category", F.substring("content", 1, snippet).alias("snippet")).join(F.broadcast(fusion.rrf(lists)), "key")
    if wanted is not None:
        both = both.where(wanted)
    scored = both.withColumn("boost", fusion.boost(F.col("key"), F.lower("category"), query)).withColumn("total_score", F.round(F.col("rrf") + F.col("boost"), 6))
    return scored.orderBy(F.col("total_score").desc(), "key").limit(limit)


def skills(memories: DataFrame, query: str, query_vector: list[float], *, limit: int = 10) -> DataFrame:
    """(key, summary, score): skills by full text, and the nearest of any category, fused without a boost."""
    lists = [text_list(memories, "key", KNOWLEDGE_COLUMNS, symbol_query(query), limit, F.col("category") == "skill"), vector_list(memories, "key", query_vector, 2 * limit)]
    both = memories.select("key", F.substring("content", 1, 400).alias("summary")).join(F.broadcast(fusion.rrf(lists)), "key")
    return both.select("key", "summary", F.round("rrf", 6).alias("score")).orderBy(F.col("score").desc(), "key").limit(limit)


def unified(memories: DataFrame, nodes: DataFrame, observations: DataFrame, query: str, query_vector: list[float], *, limit: int = 10) -> DataFrame:
    """(key, score): five lists over code, knowledge and observations as `domain:key`; knowledge is boosted.
    Code is keyed by qualified name, so symbols of one name add up."""
    code = nodes.select("id", F.col("fqn"))

    def named(one: DataFrame, domain: str) -> DataFrame:
        return one.select(F.concat(F.lit(f"{domain}:"), F.col("key").cast("string")).alias("key"), "place")

    def by_fqn(one: DataFrame) -> DataFrame:
        return code.join(F.broadcast(one), code["id"] == one["key"]).select(F.col("fqn").alias("key"), "place")

    seen = observations.where(F.col("content").ilike(f"%{query}%"))
    latest = fusion.ranked_list(seen, "observation", [F.col("created_at").desc(), F.col("id")], 2 * limit).select(F.col("id").alias("key"), "place")
    lists = [
        named(by_fqn(vector_list(nodes, "id", query_vector, 2 * limit)), "code"), named(vector_list(memories, "key", query_vector, 2 * limit), "knowledge"), named(latest, "observation"),
        named(text_list(memories, "key", KNOWLEDGE_COLUMNS, memory_query(query), 2 * limit), "knowledge"), named(by_fqn(text_list(nodes, "id", CODE_COLUMNS, symbol_query(query), limit)), "code"),
    ]
    fused = F.broadcast(fusion.rrf(lists))
    category = memories.select(F.concat(F.lit("knowledge:"), "key").alias("key"), F.col("key").alias("_k"), F.lower("category").alias("_c")).join(fused.select("key"), "key")
    boosted = fused.join(F.broadcast(category), "key", "left")
    score = F.col("rrf") + F.when(F.col("_k").isNotNull(), fusion.boost(F.col("_k"), F.col("_c"), query)).otherwise(0.0)
    return boosted.select("key", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "key").limit(limit)
