"""What a stream tells about its own progress: rows read, rows dropped as late, rows held as state."""

from __future__ import annotations

import json
import threading
from collections import defaultdict

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


class _Listener(StreamingQueryListener):
    def __init__(self, log: ProgressLog):
        self.log = log

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.log._add(str(event.progress.runId), json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.log._ended[str(event.runId)].set()


class ProgressLog:
    """Sums over all batches of the runs waited for, however many there are; use it as a context.

    A session keeps the last hundred reports of a run only, so they are gathered as they come.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._listener = spark, _Listener(self)
        self._reports: dict[str, list[dict]] = defaultdict(list)
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)
        self._runs: list[str] = []

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self._listener)
        return self

    def __exit__(self, *error) -> None:
        self.spark.streams.removeListener(self._listener)

    def _add(self, run: str, report: dict) -> None:
        self._reports[run].append(report)

    def wait(self, query: StreamingQuery, seconds: float = 120) -> ProgressLog:
        """Wait for the end of a run, and for its last report, which comes a little later."""
        query.awaitTermination()
        if not self._ended[str(query.runId)].wait(seconds):
            raise TimeoutError(f"no report of the end of {query.runId}")
        self._runs.append(str(query.runId))
        return self

    def _all(self) -> list[dict]:
        return [report for run in self._runs for report in self._reports[run]]

    def rows_read(self) -> int:
        """Rows that came from the sources; a batch that is planned anew counts once."""
        return sum(report["numInputRows"] for report in self._all())

    def rows_dropped(self) -> int:
        """Rows that came after the watermark, as the first stateful operator of each batch counts them."""
        return sum(o["numRowsDroppedByWatermark"] for report in self._all() for o in report["stateOperators"])

    def rows_held(self) -> int:
        """Rows of state after the last batch."""
        reports = [report for report in self._all() if report["stateOperators"]]
        return sum(o["numRowsTotal"] for o in reports[-1]["stateOperators"]) if reports else 0
