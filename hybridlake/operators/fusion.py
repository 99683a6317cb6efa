"""Fusion of ranked lists by reciprocal ranks, and the rule-based boost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
# Categories raised and lowered.
RAISED = ("rule", "skill", "decision", "protocol")
LOWERED = ("resource", "example")


def ranked_list(df: DataFrame, name: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their place from 0 and the list's name; the limit comes before the numbering, so one task numbers k rows only."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).withColumn("list", F.lit(name))


def rrf(lists: list[DataFrame], key: str = "key", k: int = RRF_K) -> DataFrame:
    """(key, rrf): sum of 1 / (place + k) over lists; a key that a list repeats adds up."""
    every = None
    for one in lists:
        part = one.select(key, "place")
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.sum(1 / (F.col("place") + k)).alias("rrf"))


def boost(key: Column, category: Column, query: str) -> Column:
    """+0.5 for the query as key, +0.1 for a key that contains it; +0.05 and -0.3 by category."""
    q, low = query.lower(), F.lower(key)
    by_key = F.when(low == q, 0.5).when(F.contains(low, F.lit(q)), 0.1).otherwise(0.0)
    by_category = F.when(category.isin(*RAISED), 0.05).when(category.isin(*LOWERED), -0.3).otherwise(0.0)
    return by_key + by_category
