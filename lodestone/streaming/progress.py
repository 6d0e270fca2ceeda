"""Progress of streaming jobs from what their own writes observe: no second pass over the data."""

from __future__ import annotations

import threading
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: The name under which a stream observes its counters.
METRIC = "job"


def counted(stream: DataFrame, **counters: str) -> DataFrame:
    """The stream with counters (name: condition) observed in each micro-batch, and `files`, all of its rows."""
    return stream.observe(METRIC, F.count(F.lit(1)).alias("files"), *[F.sum(F.expr(f"CAST(coalesce({c}, false) AS BIGINT)")).alias(n) for n, c in counters.items()])


class Progress(StreamingQueryListener):
    """Counters of every job by micro-batch; one that is run again replaces what it had told."""

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.batches: dict[str, dict[int, dict[str, int]]] = {}
        self.state: dict[str, str] = {}

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        with self.lock:
            self.state[str(event.id)] = "running"

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        told = event.progress.observedMetrics.get(METRIC)
        if told is not None:
            with self.lock:
                self.batches.setdefault(str(event.progress.id), {})[event.progress.batchId] = {k: v or 0 for k, v in told.asDict().items()}

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        with self.lock:
            self.state[str(event.id)] = "failed" if event.exception else "done"

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def jobs(self, spark: SparkSession) -> DataFrame:
        """job, state, counter, value: what each job has counted so far."""
        with self.lock:
            rows = []
            for job, state in self.state.items():
                own = list(self.batches.get(job, {}).values())
                rows += [(job, state, name, sum(b[name] for b in own)) for name in (own[0] if own else {})]
        return spark.createDataFrame(rows, "job string, state string, counter string, value long")
