"""Running streaming queries, and what they measure."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


class Job:
    """Several queries that belong together: where one fails, the rest of this job stop too."""

    def __init__(self) -> None:
        self.queries: list[StreamingQuery] = []

    def each_batch(self, df: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, bounded: bool = False, every: str | None = None, mode: str = "append") -> StreamingQuery:
        """Runs body on each micro-batch. bounded: on what there is now, and then ends."""
        writer = df.writeStream.outputMode(mode).foreachBatch(body).option("checkpointLocation", checkpoint)
        if bounded:
            writer = writer.trigger(availableNow=True)
        elif every:
            writer = writer.trigger(processingTime=every)
        self.queries.append(writer.start())
        return self.queries[-1]

    def to_table(self, df: DataFrame, path: str, checkpoint: str, bounded: bool = True) -> StreamingQuery:
        """Appends to Parquet, exactly once."""
        writer = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        self.queries.append((writer.trigger(availableNow=True) if bounded else writer).start())
        return self.queries[-1]

    def join(self, seconds: float | None = None) -> bool:
        """Waits until all have ended; raises the first failure, after stopping the others. False when time runs out."""
        deadline = threading.Event()
        timer = threading.Timer(seconds, deadline.set) if seconds is not None else None
        if timer:
            timer.start()
        try:
            waiting = list(self.queries)
            while waiting:
                waiting = [q for q in waiting if not q.awaitTermination(0.2)]
                if deadline.is_set() and waiting:
                    return False
            return True
        except Exception:
            self.stop()
            raise
        finally:
            if timer:
                timer.cancel()

    def stop(self) -> None:
        for q in self.queries:
            q.stop()


class Metrics(StreamingQueryListener):
    """Rows, rows a second, event-time delay and rows that came too late, by query."""

    def __init__(self) -> None:
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.batches.append({"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond, "event_time": dict(p.eventTime), "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators), "state_rows": sum(s.numRowsTotal for s in p.stateOperators)})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def attach(self, spark: SparkSession) -> Metrics:
        spark.streams.addListener(self)
        return self


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark has dropped so far."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
