"""H7 restart with back-off and failure counts; D15 observed throughput."""

from __future__ import annotations

import random
import threading
import time
from collections import Counter, defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class PipelineListener(StreamingQueryListener):
    """Counts query terminations by reason (H7) and sums the metrics that
    queries publish with ``DataFrame.observe`` (D15)."""

    def __init__(self):
        self.terminations: Counter = Counter()
        self.rows: dict[tuple[str, str], int] = defaultdict(int)
        self._lock = threading.Lock()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        with self._lock:
            for stage, row in (p.observedMetrics or {}).items():
                for k, v in row.asDict().items():
                    self.rows[(p.name or "", f"{stage}.{k}")] += int(v or 0)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            reason = event.exception.split(":", 1)[0].strip()
            with self._lock:
                self.terminations[reason] += 1

    def throughput(self, spark: SparkSession) -> DataFrame:
        """(pipeline, stage, rows) of everything observed so far."""
        with self._lock:
            data = [(q, s, n) for (q, s), n in sorted(self.rows.items())]
        return spark.createDataFrame(data, "pipeline string, stage string, rows long")

    def failures(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            data = sorted(self.terminations.items())
        return spark.createDataFrame(data, "reason string, terminations long")


def run_with_restart(start: Callable[[], StreamingQuery], *, min_backoff_s: float = 5.0,
                     max_backoff_s: float = 30.0, random_factor: float = 0.2,
                     max_restarts: int | None = None,
                     on_failure: Callable[[Exception | None], None] | None = None) -> StreamingQuery:
    """Start a query and restart it from its checkpoint when it fails, with
    exponential back-off between ``min_backoff_s`` and ``max_backoff_s``.
    Returns the query that ended without error (or the last one)."""
    restarts, backoff = 0, min_backoff_s
    while True:
        q = start()
        try:
            q.awaitTermination()
            return q
        except Exception as e:  # noqa: BLE001 - the query's failure
            if on_failure:
                on_failure(e)
            if max_restarts is not None and restarts >= max_restarts:
                raise
            restarts += 1
            time.sleep(backoff * (1 + random.uniform(0, random_factor)))
            backoff = min(backoff * 2, max_backoff_s)
