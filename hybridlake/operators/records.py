"""Operators on stored records: lookups and pages, upserts and deletions, roll-ups, JSON fields, paths.

Defined results: null keys match nothing and are kept on the side that is not being deleted; empty
tables give empty results; ties are broken by key. Only the named columns are read or changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows left, one row (n) with the number of rows deleted)."""
    gone = keys.select(key).distinct()
    return df.join(gone, key, "left_anti"), df.join(gone, key, "left_semi").agg(F.count(F.lit(1)).alias("n"))


def orphaned_memories(memories: DataFrame, present: DataFrame, categories: list[str], tag: str) -> DataFrame:
    """Memories of the managed categories that bear the tag and whose key is no longer present (key)."""
    managed = memories.where(F.col("category").isin(categories) & F.contains("tags", F.lit(tag)))
    return managed.join(present.select("key"), "key", "left_anti")


def upsert_keyed(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """New rows with a key replace the old ones of that key (the first by the order); those without are added."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    keyed = new.where(F.col(key).isNotNull()).withColumn("_n", n).where("_n = 1").drop("_n")
    kept = old.join(keyed.select(key), key, "left_anti")
    return kept.unionByName(keyed).unionByName(new.where(F.col(key).isNull()))


def page(df: DataFrame, filters: dict[str, object], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows equal in every filter that has a value, in order, `limit` of them after `offset`."""
    for name, value in filters.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df.orderBy(*order).offset(offset).limit(limit)


def mentions(df: DataFrame, columns: list[str], word: str) -> DataFrame:
    """Rows in which any of the columns holds the word, in any case."""
    held = F.lit(False)
    for c in columns:
        held = held | F.coalesce(F.contains(F.lower(c), F.lit(word.lower())), F.lit(False))
    return df.where(held)


def with_flag(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """df with a flag that tells whether the other table has its key."""
    there = other.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(there, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def next_id(df: DataFrame, id_: str) -> DataFrame:
    """One row (next_id): the greatest id and one, 1 for an empty table."""
    return df.agg((F.coalesce(F.max(id_), F.lit(0)) + 1).cast("bigint").alias("next_id"))


def recent(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group by the order, with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def severity_trend(findings: DataFrame, group: str, at: str, score: str) -> DataFrame:
    """(group, first_score, last_score, trend): up, down or flat from the first to the last by time; groups with one value are flat."""
    g = findings.where(F.col(score).isNotNull()).groupBy(group).agg(F.min_by(score, at).alias("first_score"), F.max_by(score, at).alias("last_score"))
    return g.withColumn("trend", F.when(F.col("last_score") > F.col("first_score"), "up").when(F.col("last_score") < F.col("first_score"), "down").otherwise("flat"))


def file_skeletons(nodes: DataFrame, detail: str = "skeleton_minimal") -> DataFrame:
    """(file_path, skeleton): the skeletons of a file's symbols in the order of their lines."""
    one = F.struct(F.coalesce("start_line", F.lit(0)).alias("at"), F.col("fqn"), F.coalesce(detail, "signature", F.lit("")).alias("text"))
    rows = nodes.where("file_path is not null").groupBy("file_path").agg(F.array_sort(F.collect_list(one)).alias("s"))
    return rows.select("file_path", F.array_join(F.transform("s", lambda x: x["text"]), "\n\n").alias("skeleton"))


def json_list(text: Column) -> Column:
    """The strings of a JSON array; empty for null and what is none."""
    return F.coalesce(F.from_json(F.coalesce(text, F.lit("[]")), "array<string>"), F.array().cast("array<string>"))


def json_map(text: Column) -> Column:
    """The entries of a JSON object; empty for null and what is none."""
    return F.coalesce(F.from_json(F.coalesce(text, F.lit("{}")), "map<string,string>"), F.create_map().cast("map<string,string>"))


def label_counts(df: DataFrame, group: str, labels: str, most: int = 10) -> DataFrame:
    """(group, label, n, keys): each group's most frequent labels of an array column, equal ones by name."""
    n = df.select(group, F.explode(labels).alias("label")).groupBy(group, "label").agg(F.count(F.lit(1)).alias("n"))
    return recent(n, group, [F.col("n").desc(), F.col("label")], most)


def rooted(path: Column, root: str) -> Column:
    """`ROOT/` as the workspace's folder."""
    return F.when(path.startswith("ROOT/"), F.concat(F.lit(root.rstrip("/") + "/"), F.substr(path, F.lit(6)))).otherwise(path)


def unrooted(path: Column, root: str) -> Column:
    """The workspace's folder as `ROOT/`."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.concat(F.lit("ROOT/"), F.substr(path, F.lit(len(prefix) + 1)))).otherwise(path)


def contained(path: Column) -> Column:
    """Whether a relative path stays within its folder: not absolute, and no `..` leads out."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda s, p: F.struct((s["now"] + F.when(p == "..", -1).otherwise(1)).alias("now"), F.least(s["least"], s["now"] + F.when(p == "..", -1).otherwise(1)).alias("least")))
    return ~path.rlike(r"^(?:[/\\]|[A-Za-z]:)") & (depth["least"] >= 0)


# Parts of paths that are never watched, parts of the agents' folder that are, and endings that are.
UNWATCHED = (".git", "node_modules", "__pycache__", "venv", ".venv", ".agents/data/", ".agents/history/", ".agents/artifacts/", "/.plastic/", "/Library/", "/Temp/", "/Logs/", "/obj/", "/UserSettings/", "/Builds/", "/MemoryCaptures/", "/.vs/", "/.idea/", "/.vscode/", "/dist/", "/build/")
AGENT_PARTS = ("/rules/", "/knowledge/", "/skills/", "/docs/")
WATCHED_ENDS = (".py", ".md", ".txt", ".js", ".ts", ".json", ".pdf", ".cs", ".asset", ".prefab", ".meta", ".inputsettings")


def watched(path: Column) -> Column:
    """Whether changes of a file are followed."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    any_of = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda x: F.contains(p, x))
    ends = F.exists(F.array(*map(F.lit, WATCHED_ENDS)), lambda x: F.endswith(p, x))
    return ~any_of(UNWATCHED) & F.when(F.contains(p, F.lit(".agents/")), any_of(AGENT_PARTS)).otherwise(ends)


def guarded(old_text: Column, new_text: Column, least: int = 5) -> Column:
    """Why an edit is refused: missing arguments, or a text to replace of fewer than `least` characters; null if it isn't."""
    return F.when(old_text.isNull() | new_text.isNull(), "missing").when(F.length(F.trim(old_text)) < least, "too short")


def keyword_difficulty(volume: Column, rivals: Column) -> Column:
    """0 to 100: seven tenths from rivals (all at 50,000), three from volume (all at a million); 0 without rivals."""
    full = F.least(rivals / 50_000, F.lit(1.0)) * 0.7 + F.least(volume / 1_000_000, F.lit(1.0)) * 0.3
    return F.when(rivals == 0, 0.0).otherwise(F.round(full * 100, 1))


def keyword_potential(volume: Column, rivals: Column, relevance: Column) -> Column:
    """0 to 100: up to 40 from volume (all at 100,000), 30 less one per 500 rivals, 30 times the relevance."""
    points = F.least(volume / 100_000 * 40, F.lit(40.0)) + F.greatest(30 - rivals / 500, F.lit(0.0)) + relevance * 30
    return F.round(F.least(points, F.lit(100.0)), 1)


def highlighted(text: Column, terms: list[str], *, around: int = 40, open_: str = ">>>", close: str = "<<<") -> Column:
    """The text around its first word that begins with a term, `around` words at most, with all such words marked; null without any."""
    words = F.split(F.trim(text), r"\s+")
    hit = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+", "").rlike("^(?:" + "|".join(terms) + ")")
    first = F.array_position(F.transform(words, hit), F.lit(True))
    start = F.greatest(first - around // 2, F.lit(1)).cast("int")
    part = F.transform(F.slice(words, start, F.lit(around)), lambda w: F.when(hit(w), F.concat(F.lit(open_), w, F.lit(close))).otherwise(w))
    shown = F.concat(F.when(start > 1, "...").otherwise(""), F.array_join(part, " "), F.when(F.size(words) >= start + around, "...").otherwise(""))
    return F.when(first > 0, shown)
