"""Reads the engine's tables. Columns that a file lacks are added as nulls (additive migration)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridlake.schema import SCHEMAS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` in `folder`, with its schema's columns first."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return conform(df, name) if name in SCHEMAS else df


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with every column of the table's schema; missing ones are null, further ones stay."""
    have = {c.lower() for c in df.columns}
    missing = {c: F.lit(None).cast(kind) for c, kind in SCHEMAS[name].items() if c.lower() not in have}
    return df.withColumns(missing) if missing else df
