"""Replay of approvals: events as tables over the states of a request, composed over stretches of time.

A table says which state each state becomes. Composing tables is associative, so that the events of one request may
lie in many tasks: each task composes its own, and only the state in which a task's first request begins passes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import shared_dir, table

STATES = ("none", "pending", "approved", "rejected", "executed", "expired")
ACTIONS = ("propose", "approve", "reject", "execute")
#: Legal moves: action, state before, state after. All others leave the state as it is.
MOVES = {("propose", s): "pending" for s in ("none", "rejected", "executed", "expired")} | {("approve", "pending"): "approved", ("reject", "pending"): "rejected", ("execute", "approved"): "executed"}


def move(action: str, late: bool, own: bool, state: str) -> tuple[str, bool]:
    """The state after an action, and whether it was legal. What comes late finds the request expired; nobody approves an own proposal."""
    if (action, state) not in MOVES:
        return state, False
    if late and action != "propose":
        return "expired", False
    if own and action == "approve":
        return state, False
    return MOVES[action, state], True


#: By action, late and own, as one number: the state after each state, and whether that is legal.
_CODES = [(a, late, own) for a in ACTIONS for late in (False, True) for own in (False, True)]
_AFTER = np.array([[STATES.index(move(*code, s)[0]) for s in STATES] for code in _CODES])
_LEGAL = np.array([[move(*code, s)[1] for s in STATES] for code in _CODES])


def replayed(events: DataFrame) -> DataFrame:
    """events (id, ts, event_id, action, late, own) as id, event_id, action, legal, state: what each action meets and leaves.

    Events of a request come in order of ts and event_id, null actions and flags count as unknown actions and false. The
    rows are dealt by ranges of request and time, so that one request may fill many tasks; they are written once to the
    shared folder, and the driver gets two short rows a task.
    """
    spark = events.sparkSession
    shared_dir(spark)
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action")), F.lit(0)) - 1
    code = F.when(kind >= 0, kind * 4 + F.when(F.col("late"), 2).otherwise(0) + F.when(F.col("own"), 1).otherwise(0)).otherwise(-1).cast("int")
    rows = events.select("id", "ts", "event_id", "action", code.alias("code")).repartitionByRange("id", "ts", "event_id").sortWithinPartitions("id", "ts", "event_id")
    rows = rows.withColumn("part", F.spark_partition_id()).checkpoint()

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The composed tables of a task's first and last request."""
        made: list[list] = []
        for b in batches:
            for (id_, part), own in b.groupby(["id", "part"], sort=False, dropna=False):
                whole = reduce(lambda t, c: _AFTER[c][t], [c for c in own["code"] if c >= 0], np.arange(len(STATES)))
                if made and made[-1][1] == id_:
                    made[-1][2] = whole[made[-1][2]]
                elif len(made) < 2:
                    made.append([part, id_, whole])
                else:
                    made[-1] = [part, id_, whole]
        yield pd.DataFrame([(p, i, t.tolist(), k) for k, (p, i, t) in enumerate(made)], columns=["part", "id", "after", "place"])

    id_type = rows.schema["id"].dataType.simpleString()
    told = sorted((r["part"], r["place"], r["id"], r["after"]) for r in rows.select("id", "part", "code").mapInPandas(ends, f"part int, id {id_type}, after array<int>, place int").collect())
    begins, last, state = {}, None, 0
    for part, place, id_, after in told:
        if id_ != last:
            state = 0
        if place == 0:
            begins[part] = (id_, state)
        last, state = id_, after[state]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None
        for b in batches:
            legal, after = [], []
            for id_, part, c in zip(b["id"], b["part"], b["code"], strict=True):
                if id_ != key:
                    key = id_
                    state = begins[part][1] if begins[part][0] == id_ else 0
                legal.append(c >= 0 and bool(_LEGAL[c][state]))
                state = int(_AFTER[c][state]) if c >= 0 else state
                after.append(STATES[state])
            yield b[["id", "event_id", "action"]].assign(legal=legal, state=after)

    return rows.mapInPandas(run, f"id {id_type}, event_id long, action string, legal boolean, state string")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions on requests: a user's events are those of one request; every eleventh comes late, every seventh from the proposer."""
    action = F.when(F.col("event_type") == "signup", "propose").when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "click", "execute")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", "event_id", action.alias("action"), (F.col("event_id") % 11 == 0).alias("late"), (F.col("event_id") % 7 == 0).alias("own"))
    return rows.where("action IS NOT NULL")


_FSM_SQL = """WITH RECURSIVE e AS (SELECT user_id AS id, event_id, CASE event_type WHEN 'signup' THEN 'propose' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'execute' END AS action, event_id % 11 = 0 AS late, event_id % 7 = 0 AS own, ts FROM events),
 o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS r FROM e WHERE action IS NOT NULL),
 m(id, r, event_id, action, legal, state) AS (SELECT id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', false, 'none' FROM (SELECT DISTINCT id FROM o) UNION ALL
  SELECT o.id, o.r, o.event_id, o.action,
   CASE o.action WHEN 'propose' THEN m.state NOT IN ('pending', 'approved') WHEN 'approve' THEN m.state = 'pending' AND NOT o.late AND NOT o.own WHEN 'reject' THEN m.state = 'pending' AND NOT o.late ELSE m.state = 'approved' AND NOT o.late END,
   CASE WHEN o.action = 'propose' AND m.state NOT IN ('pending', 'approved') THEN 'pending' WHEN o.late AND (o.action IN ('approve', 'reject') AND m.state = 'pending' OR o.action = 'execute' AND m.state = 'approved') THEN 'expired'
    WHEN o.action = 'approve' AND m.state = 'pending' AND NOT o.own THEN 'approved' WHEN o.action = 'reject' AND m.state = 'pending' THEN 'rejected' WHEN o.action = 'execute' AND m.state = 'approved' THEN 'executed' ELSE m.state END
  FROM m JOIN o ON o.id = m.id AND o.r = m.r + 1)
 SELECT id, event_id, action, legal, state FROM m WHERE r > 0"""


@query("approval_fsm", _FSM_SQL)
def approval_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each action on a request, whether the rules allow it, and the state that it leaves; an illegal one changes nothing, but what comes late expires."""
    return replayed(requests(spark, sf_dir))
