"""What streaming queries do, as a table: start, running, done for each batch, finished or failed."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

COLUMNS = "name string, run string, seq int, event string, batch long, rows long, ms long, error string"


class ProgressTable(StreamingQueryListener):
    """Listens to every query of a session; a few numbers a batch are held on the driver until ``write`` moves them to a table."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.names: dict[str, str | None] = {}
        self.counts: dict[str, int] = {}
        self.lock = threading.Lock()

    def note(self, run: object, event: str, batch: int | None = None, rows: int | None = None, ms: int | None = None, error: str | None = None) -> None:
        with self.lock:
            run = str(run)
            n = self.counts[run] = self.counts.get(run, -1) + 1
            self.rows.append((self.names.get(run), run, n, event, batch, rows, ms, error))

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.names[str(event.runId)] = event.name
        self.note(event.runId, "start")

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        self.note(p.runId, "running", p.batchId)
        self.note(p.runId, "done", p.batchId, p.numInputRows, p.batchDuration)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.note(event.runId, "failed" if event.exception else "finished", error=event.exception.splitlines()[0][:500] if event.exception else None)

    def wait(self, run: object, seconds: float = 30) -> bool:
        """Whether the run's last event has come; events arrive a little after the query has ended."""
        end = time.time() + seconds
        while time.time() < end:
            with self.lock:
                if any(r[1] == str(run) and r[3] in ("finished", "failed") for r in self.rows):
                    return True
            time.sleep(0.05)
        return False

    def table(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return spark.createDataFrame(list(self.rows), COLUMNS)

    def write(self, spark: SparkSession, path: str) -> None:
        """Append what has come since the last call to a Parquet table."""
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(path)
