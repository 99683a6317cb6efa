"""Salting of hot keys. A key is hot if it holds more than a stated share of all rows, so the hot
keys are few whatever the size of the table, and may go to the driver or be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1 / 128


def hot_keys(df: DataFrame, key: Column, total: int, share: float = HOT_SHARE) -> list:
    """Keys with more than share * total rows of df; there are fewer than rows(df) / (share * total) of them."""
    counts = df.select(key.alias("_k")).where(F.col("_k").isNotNull()).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in counts.where(F.col("_n") > max(1.0, share * total)).select("_k").collect()]


def salt(key: Column, hot: list, spread: Column, salts: int) -> Column:
    """0 for common keys; for hot ones a number below `salts` drawn from `spread`."""
    if not hot:
        return F.lit(0)
    return F.when(key.isin(hot), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))


def all_salts(key: Column, hot: list, salts: int) -> Column:
    """The array of salts under which the other side of a salted key must appear."""
    if not hot:
        return F.array(F.lit(0))
    return F.when(key.isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))


def join_by_count(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """left joined (inner) with right, whose keys are unique and whose column n counts left's rows of each.

    Keys with more than share * total rows are fewer than 1 / share if total is the rows' number,
    so they are broadcast and their rows of left never shuffled; the others have no hot key left.
    """
    often = F.col(n) > max(1, int(share * total))
    mark = "_hot"
    marked = left.join(F.broadcast(right.where(often).withColumn(mark, F.lit(True))), keys, "left")
    cold = left.columns
    rest = marked.where(F.col(mark).isNull()).select(*cold).join(right.where(~often), keys)
    return marked.where(mark).drop(mark).unionByName(rest)
