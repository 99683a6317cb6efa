"""Store operators: keep-latest merges, upserts, deletions, change classification, exports, statistics.

All work on whole tables and return the new table; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, key: list[str], newest: list[Column]) -> DataFrame:
    """One row per key, the first by the given order; a window, so rows are sorted, not collected."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*newest))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def replace_rows(old: DataFrame, new: DataFrame, key: list[str], newest: list[Column]) -> DataFrame:
    """Insert or replace: new rows win over old ones, and the last of a batch over its earlier ones."""
    fresh = keep_latest(new, key, newest)
    return old.join(fresh.select(*key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def insert_or_ignore(old: DataFrame, new: DataFrame, unique: list[str], order: list[Column]) -> DataFrame:
    """The rows of new that don't clash with old nor with an earlier row of new."""
    return keep_latest(new.join(old.select(*unique), unique, "left_anti"), unique, order)


def upsert_memories(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Existing keys take the new content, category and tags, count one access more and keep their creation
    time and relationships; new keys start with no access; empty keys are refused; the category default is general."""
    n = keep_latest(new.where("key is not null and key != ''"), ["key"], [F.col("updated_at").desc_nulls_last(), F.col("content")])
    o, n = old.alias("o"), n.alias("n")
    both = o.join(n, F.col("o.key") == F.col("n.key"), "full_outer")
    fresh, known = F.col("n.key").isNotNull(), F.col("o.key").isNotNull()
    take = lambda c, default=None: F.when(fresh, F.coalesce(f"n.{c}", F.lit(default)) if default else F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(
        F.coalesce("o.key", "n.key").alias("key"), take("project_id").alias("project_id"), take("category", "general").alias("category"), take("content").alias("content"), take("tags").alias("tags"),
        F.coalesce("o.relationships", "n.relationships").alias("relationships"),
        (F.coalesce("o.access_count", F.lit(0)) + F.when(fresh & known, 1).otherwise(0)).cast("int").alias("access_count"),
        F.coalesce("o.created_at", F.lit(now)).cast("bigint").alias("created_at"), F.when(fresh, F.lit(now)).otherwise(F.col("o.updated_at")).cast("bigint").alias("updated_at"),
    )


def count_accesses(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """memories with the accesses (one row per read of a key) added to their counters."""
    n = accesses.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    return memories.join(n, "key", "left").withColumn("access_count", (F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int")).drop("_n")


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without the files' nodes and without edges from or to them."""
    gone = nodes.join(paths, "file_path", "left_semi").select(F.col("id").alias("_id")).distinct()
    left = nodes.join(paths, "file_path", "left_anti")
    kept = edges.join(gone, edges["source_id"] == gone["_id"], "left_anti").join(gone.withColumnRenamed("_id", "_to"), F.col("target_id") == F.col("_to"), "left_anti")
    return left, kept


def classify_changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): created, updated, deleted or skipped, from the digests of two snapshots with unique keys."""
    o, n = old.select(F.col(key).alias("_k"), F.col(digest).alias("_o")), new.select(F.col(key), F.col(digest).alias("_n"))
    both = n.join(o, F.col(key) == F.col("_k"), "full_outer")
    status = F.when(F.col("_k").isNull(), "created").when(F.col(key).isNull(), "deleted").when(F.col("_o").eqNullSafe(F.col("_n")), "skipped").otherwise("updated")
    return both.select(F.coalesce(key, "_k").alias(key), status.alias("status"))


def inbox_lines(observations: DataFrame) -> DataFrame:
    """(id, line) of pending observations for a text inbox."""
    line = F.format_string(
        "- [PENDING] **[%s]** %s (Session: %s)", F.upper("type"), F.regexp_replace(F.coalesce("content", F.lit("")), "\n", " "), F.coalesce(F.substring("session_id", 1, 8), F.lit("unknown"))
    )
    return observations.select("id", line.alias("line"))


def after_mark(df: DataFrame, key: str, last: int) -> DataFrame:
    """Rows past a high-water mark; the next mark is their greatest key."""
    return df.where(F.col(key) > last)


def debounce_batches(events: DataFrame, at: Column, group: list[Column], gap_seconds: float) -> DataFrame:
    """events with batch_start: a batch ends where the next event of its group is at least the gap later."""
    names = [f"_g{i}" for i in range(len(group))]
    e = events.withColumns({"_at": at, **dict(zip(names, group, strict=True))})
    w = Window.partitionBy(*names).orderBy("_at")
    starts = F.coalesce((F.unix_micros("_at") - F.lag(F.unix_micros("_at")).over(w)) >= int(gap_seconds * 1_000_000), F.lit(True))
    first = F.last(F.when(F.col("_s"), F.col("_at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return e.withColumn("_s", starts).withColumn("batch_start", first).drop("_s", "_at", *names)
