"""References to records that do not exist.

Parents (births and deaths) and children (references) are put in one long form of
(parent table, key, time, kind) and grouped by parent table and key. Within a group, ordered by
time, a reference sees the last birth or death before it; a group without any birth lacks the
parent flag. Hot keys are salted: their references are spread over salts, and their few births
and deaths repeated under each.

Defined results: null or blank keys and keys with an ignored prefix are no references; keys
compare in lower case without surrounding blanks; a child id that comes twice counts once, at its
earliest time (of equal times, the least keys); a null time of a reference is the earliest of all,
a null time of a birth or death is ignored; empty tables give no rows (without parents, every
reference is an orphan). Only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hybridlake.operators.skew import all_salts, hot_keys, salt

DEATH, BIRTH, REFERENCE = 0, 1, 2


def normal_key(key: Column) -> Column:
    """Lower case, no blanks around; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(key, r"^\s+|\s+$", "")), F.lit(""))


def orphan_references(
    children: DataFrame,
    parents: DataFrame,
    deletions: DataFrame,
    *,
    child_id: str,
    child_time: str,
    references: dict[str, str],
    parent_keys: dict[str, tuple[str, str]],
    deletion_keys: dict[str, tuple[str, str]] | None = None,
    ignored_prefix: str = "__unresolved",
    salts: int = 32,
) -> DataFrame:
    """One row per child and reference column whose parent isn't alive at the child's time.

    references: reference column -> parent table. parent_keys, deletion_keys: parent table ->
    (key column, time column) in `parents` and `deletions`.
    Columns: parent_table, endpoint, child_id, key, at, reason (never, deleted, late).
    """
    deletion_keys = deletion_keys or {}
    cols = list(references)
    first = (
        children.where(F.col(child_id).isNotNull())
        .groupBy(F.col(child_id).alias("_id"))
        .agg(F.min(F.struct(F.coalesce(F.col(child_time), F.timestamp_seconds(F.lit(-(10**10)))).alias("_at"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)])).alias("_e"))
    )

    def usable(key: Column) -> Column:
        return key.isNotNull() & ~key.startswith(ignored_prefix)

    def keys_of(df: DataFrame, at: list[Column]) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(references[c]).alias("t"), F.lit(c).alias("c"), normal_key(k).alias("k")) for c, k in zip(cols, at, strict=True)]))

    raw = children.select(keys_of(children, [F.col(c) for c in cols]).alias("x")).where(usable(F.col("x.k")))
    hot = hot_keys(raw, F.col("x.k"), max(children.count(), salts * 128))

    refs = first.select("_id", F.col("_e._at").alias("_at"), keys_of(first, [F.col(f"_e._c{i}") for i in range(len(cols))]).alias("x")).where(usable(F.col("x.k")))
    refs = refs.select(
        F.col("x.t").alias("parent_table"), F.col("x.k").alias("key"), F.col("_at").alias("at"), F.lit(REFERENCE).alias("kind"),
        F.col("_id").alias("child_id"), F.col("x.c").alias("endpoint"), salt(F.col("x.k"), hot, F.col("_id"), salts).alias("salt"),
    )

    def lives(df: DataFrame, where: dict[str, tuple[str, str]], kind: int) -> list[DataFrame]:
        out = []
        for name, (key, time) in where.items():
            part = df.select(F.lit(name).alias("parent_table"), normal_key(F.col(key)).alias("key"), F.col(time).cast("timestamp").alias("at"), F.lit(kind).alias("kind"))
            out.append(part.where(F.col("key").isNotNull() & F.col("at").isNotNull()).distinct())
        return out

    events = None
    for part in [*lives(parents, parent_keys, BIRTH), *lives(deletions, deletion_keys, DEATH)]:
        events = part if events is None else events.unionByName(part)
    like = {f.name: f.dataType for f in refs.schema.fields}
    events = events.withColumn("salt", F.explode(all_salts(F.col("key"), hot, salts))).withColumns({c: F.lit(None).cast(like[c]) for c in ("child_id", "endpoint")})

    long = refs.unionByName(events.select(*refs.columns))
    group = Window.partitionBy("parent_table", "key", "salt")
    state = F.when(F.col("kind") != REFERENCE, F.col("kind"))
    seen = (
        long.withColumn("state", F.last(state, ignorenulls=True).over(group.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("born", F.max((F.col("kind") == BIRTH).cast("int")).over(group))
        .where((F.col("kind") == REFERENCE) & (F.coalesce(F.col("state"), F.lit(DEATH)) != BIRTH))
    )
    reason = F.when(F.col("born") == 0, "never").when(F.col("state") == DEATH, "deleted").otherwise("late")
    return seen.select("parent_table", "endpoint", "child_id", "key", "at", reason.alias("reason"))


def orphan_report(orphans: DataFrame, child_table: str, period: str = "month") -> DataFrame:
    """Counts of orphans per child table, reference column, parent table, period and reason."""
    return orphans.groupBy(
        F.lit(child_table).alias("child_table"), "endpoint", "parent_table", F.date_format(F.date_trunc(period, "at"), "yyyy-MM-dd").alias("period"), "reason"
    ).agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("key").alias("n_keys"))
