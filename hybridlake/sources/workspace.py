"""Sources beside the tables: workspace files, git logs, CSV files, cached files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridlake.functions.text import glob_to_regex

# Folders and files that are never indexed.
IGNORED = [".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", "*.pyc", "*.log", "*.lock", "*.min.js"]


def ignored(path: Column, globs: list[str]) -> Column:
    """Whether any part of the path, or the whole of it, matches one of the globs: one regular expression for all."""
    one = "|".join(f"(?:{glob_to_regex(g)})" for g in globs)
    return F.exists(F.split(path, "/"), lambda p: p.rlike(one)) | path.rlike(one)


def included(path: Column, globs: list[str]) -> Column:
    return F.lit(True) if "**" in globs else path.rlike("|".join(f"(?:{glob_to_regex(g)})" for g in globs))


def scan(spark: SparkSession, root: str, extensions: list[str], ignore: list[str] | None = None, include: list[str] | None = None) -> DataFrame:
    """(file_path relative to root, source, hash, modified): files by extension, without ignored ones; rule documents are always in.

    Bytes that are no UTF-8 are replaced. Only listed and read once; the filters run before the text is decoded.
    """
    # Listings leave out hidden folders, so those of the rule documents are named.
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))
    roots = [root, *(p for p in (f"{root.rstrip('/')}/.agents/{x}" for x in ("rules", "docs")) if there(p))]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    relative = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", "")
    f = files.select(relative.alias("file_path"), "content", F.col("modificationTime").alias("modified"))
    by_kind = F.lower(F.element_at(F.split("file_path", r"\."), -1)).isin([e.lstrip(".").lower() for e in extensions])
    forced = F.col("file_path").rlike(r"^\.agents/(?:rules|docs)/.*\.md$")
    kept = f.where(forced | (by_kind & ~ignored(F.col("file_path"), [*IGNORED, *(ignore or [])]) & included(F.col("file_path"), include or ["**"])))
    return kept.select("file_path", F.decode("content", "UTF-8").alias("source"), F.md5("content").alias("hash"), "modified")


def git_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(commit, author, at epoch seconds, subject) from lines `hash|author|seconds|subject`; lines with fewer fields are dropped."""
    p = F.split(column, r"\|", 4)
    return lines.select(p.alias("p")).where(F.size("p") >= 4).select(F.col("p")[0].alias("commit"), F.col("p")[1].alias("author"), F.col("p")[2].try_cast("bigint").alias("at"), F.col("p")[3].alias("subject"))


def file_history(log: DataFrame, touched: DataFrame) -> DataFrame:
    """(file_path, commit_count, last_author, last_commit_ts); touched: (commit, file_path)."""
    return touched.join(log, "commit").groupBy("file_path").agg(F.count(F.lit(1)).alias("commit_count"), F.max_by("author", "at").alias("last_author"), F.max("at").alias("last_commit_ts"))


def csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=ddl)


def fresh(files: DataFrame, now: Column, ttl_hours: float) -> DataFrame:
    """Cached files younger than the time to live."""
    return files.where((F.unix_seconds(now) - F.unix_seconds(F.col("modified"))) < F.lit(ttl_hours * 3600))
