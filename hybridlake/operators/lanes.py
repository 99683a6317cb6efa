"""Replay of an event log of lane locks: each lane is a state machine over its events in order.

States are IDLE, BUSY and HANDOFF. A free lane is taken by anyone, a handed-over one only by the
agent it was handed to (anyone, if none was named), a busy one by its holder, or by anyone once the
lock is older than two hours. Only the holder releases; an operator's force frees it in any state.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

ZOMBIE_SECONDS = 2 * 60 * 60


@dataclass
class Lane:
    status: str = "IDLE"
    agent: str | None = None
    handoff_to: str | None = None
    locked_at: float | None = None

    def apply(self, op: str, agent: str | None, to: str | None, at: float) -> bool:
        """Whether the event was accepted; the lane changes only if so."""
        if op == "force":
            self.status, self.agent, self.handoff_to, self.locked_at = "IDLE", None, None, None
            return True
        if op == "release":
            if self.agent is None or self.agent != agent:
                return False
            self.status, self.agent, self.handoff_to, self.locked_at = ("HANDOFF" if to else "IDLE"), None, to or None, None
            return True
        if op != "acquire":
            return False
        waiting = self.status == "HANDOFF" and self.handoff_to not in (None, agent)
        held = self.status == "BUSY" and self.agent != agent and at - (self.locked_at or 0.0) <= ZOMBIE_SECONDS
        if waiting or held:
            return False
        self.status, self.agent, self.handoff_to, self.locked_at = "BUSY", agent, None, at
        return True


def replay(log: DataFrame) -> DataFrame:
    """log: (seq long, lane, agent, op, handoff_to string, at double).

    (seq, lane, accepted, status, holder) after each event. A lane's events are taken in order of
    seq; a state machine is sequential, so one lane is one task's work.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lane, rows = Lane(), []
        for r in pdf.sort_values("seq").itertuples(index=False):
            none = lambda x: None if x is None or x != x else x
            accepted = lane.apply(r.op, none(r.agent), none(r.handoff_to), float(r.at))
            rows.append((r.seq, r.lane, accepted, lane.status, lane.agent))
        return pd.DataFrame(rows, columns=["seq", "lane", "accepted", "status", "holder"])

    return log.select("seq", "lane", "agent", "op", "handoff_to", "at").groupBy("lane").applyInPandas(run, "seq long, lane string, accepted boolean, status string, holder string")


def replay_todos(log: DataFrame) -> DataFrame:
    """log: (seq, op, id, task). The list after all events: (id, task, done). add gives the next id, check marks one, clear empties the list.

    Adds and checks before the last clear are dead; the rest needs no order but the count of adds.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    last = log.where("op = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_c"))
    live = log.join(F.broadcast(last), F.lit(True)).where(F.col("seq") > F.col("_c"))
    added = live.where("op = 'add'").select("task", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("seq")).cast("long").alias("id"))
    checked = live.where("op = 'check'").select("id").distinct().withColumn("done", F.lit(True))
    return added.join(checked, "id", "left").select("id", "task", F.coalesce("done", F.lit(False)).alias("done"))
