"""Breaker and quota as streams with a state for each key, which give the rows of the batch forms.

A key's rows are taken in order of time within a micro-batch, and micro-batches in the order in which they come. State is a
few numbers a key; it is restored from the checkpoint, so that a query may stop between any two micro-batches. The recovery
time and the end of a day are told from the calls' own times, so no timer decides a row and a rerun gives the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.breaker import FAILURES, RECOVERY, step

MICROS_A_DAY = 86_400_000_000
#: What a caller may spend in a day, in millionths.
BUDGET = 400_000


def prepare(spark: SparkSession) -> SparkSession:
    """State of any kind needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by), kind="stable")


class Breaker(StatefulProcessor):
    """One breaker a key: failures in a row, and when it opened."""

    def __init__(self, failures: int, recovery: float) -> None:
        self.failures, self.recovery = failures, recovery

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "failed int, opened double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        failed, opened = self.state.get() if self.state.exists() else (0, None)
        calls = _in_order(rows, "at", "id")
        met, states = [], []
        for at, ok in zip(calls["at"], calls["ok"], strict=True):
            m, failed, opened = step(failed, opened, at, ok, self.failures, self.recovery)
            met.append(m)
            states.append("closed" if opened is None else "open")
        self.state.update((int(failed), None if opened is None else float(opened)))
        yield calls[["key", "id"]].assign(met=met, refused=[m == "open" for m in met], state=states)

    def close(self) -> None:
        pass


class Quota(StatefulProcessor):
    """One budget a caller and day: what was spent before a call is checked, what it costs is recorded after it."""

    def __init__(self, budget: int) -> None:
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("spent", "day long, micros long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        day, spent = self.state.get() if self.state.exists() else (None, 0)
        calls = _in_order(rows, "at", "id")
        before, resets = [], []
        for at, micros in zip(calls["at"], calls["micros"], strict=True):
            today = at // MICROS_A_DAY
            if today != day:
                day, spent = today, 0
            before.append(spent)
            resets.append((today + 1) * MICROS_A_DAY)
            spent += micros
        self.state.update((int(day), int(spent)))
        yield calls[["id"]].assign(spent=before, remaining=[max(0, self.budget - s) for s in before], allowed=[s < self.budget for s in before], resets_at=resets)

    def close(self) -> None:
        pass


def breaker_stream(calls: DataFrame, failures: int = FAILURES, recovery: float = RECOVERY) -> DataFrame:
    """calls (key, at seconds, id, ok) as `breaker_states` gives them."""
    prepare(calls.sparkSession)
    return calls.groupBy("key").transformWithStateInPandas(Breaker(failures, recovery), "key long, id long, met string, refused boolean, state string", "Append", "None")


def quota_stream(calls: DataFrame, budget: int = BUDGET) -> DataFrame:
    """calls (key, at in microseconds, id, micros) as id, spent before it, remaining, allowed, resets_at in microseconds; days are UTC's."""
    prepare(calls.sparkSession)
    return calls.groupBy("key").transformWithStateInPandas(Quota(budget), "id long, spent long, remaining long, allowed boolean, resets_at long", "Append", "None")


def effects(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """calls (tenant_id, key, ts, ...) with one row for each tenant and key: a replay within the watermark has no effect of its own.

    State is a key and its time, and goes when the watermark has passed it.
    """
    return calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["tenant_id", "key"])
