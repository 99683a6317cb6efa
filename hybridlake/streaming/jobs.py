"""Structured Streaming jobs: debounced change batches, duplicate suppression, marks, lanes.

Each takes a streaming DataFrame and returns one; sinks, triggers and checkpoints are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hybridlake.operators.lanes import Lane


def change_batches(events: DataFrame, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """events: (path, at timestamp). (start, end, paths): the set of changed paths of each quiet-bounded batch."""
    e = events.where("path is not null").withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    # Session windows need a key that isn't constant to the optimizer; this one is true for every path.
    return e.groupBy((F.length("path") >= 0).alias("all"), F.session_window("at", gap).alias("w")).agg(F.collect_set("path").alias("paths")).select("w.start", "w.end", F.array_sort("paths").alias("paths"))


def suppress_repeats(events: DataFrame, within: str = "120 seconds") -> DataFrame:
    """The first event of each path, and of its repeats only those after the time is over."""
    return events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", within).dropDuplicatesWithinWatermark(["path"])


def access_counts(reads: DataFrame) -> DataFrame:
    """(key, n) of the reads so far; for the update mode."""
    return reads.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def lane_states(log: DataFrame) -> DataFrame:
    """The lane state machine over a stream of events; the state of each lane is kept between batches."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lane = Lane(*state.get) if state.exists else Lane()
        rows = []
        for r in pd.concat(batches).sort_values("seq").itertuples(index=False):
            none = lambda x: None if x is None or x != x else x
            accepted = lane.apply(r.op, none(r.agent), none(r.handoff_to), float(r.at))
            rows.append((r.seq, r.lane, accepted, lane.status, lane.agent))
        state.update((lane.status, lane.agent, lane.handoff_to, lane.locked_at))
        yield pd.DataFrame(rows, columns=["seq", "lane", "accepted", "status", "holder"])

    return log.select("seq", "lane", "agent", "op", "handoff_to", "at").groupBy("lane").applyInPandasWithState(
        step, "seq long, lane string, accepted boolean, status string, holder string", "status string, agent string, handoff_to string, locked_at double", "append", GroupStateTimeout.NoTimeout
    )
