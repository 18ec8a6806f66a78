"""Lifecycles of streams for those who watch them, and a stream that beats."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from threading import Condition

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Events kept for late readers, and seconds of a beat.
KEPT, BEAT_SECONDS = 256, 15


class JobLog(StreamingQueryListener):
    """The newest KEPT events (number, query id, what, rows) of all streams of a session.  A reader that falls behind misses the oldest
    and is told how many."""

    def __init__(self, kept: int = KEPT):
        self._held: deque = deque(maxlen=kept)
        self._number, self._changed = 0, Condition()

    def _add(self, query: str, what: str, rows: int | None = None) -> None:
        with self._changed:
            self._held.append((self._number, query, what, rows))
            self._number += 1
            self._changed.notify_all()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._add(str(event.id), "started")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._add(str(event.progress.id), "progress", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._add(str(event.id), "idle")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._add(str(event.id), "failed" if event.exception else "finished")

    def since(self, number: int, wait: float = 0.0) -> tuple[list[tuple], int, int]:
        """(events from this number on, the next number, how many were missed), waiting for the first one for some seconds."""
        with self._changed:
            self._changed.wait_for(lambda: self._number > number, wait)
            first = self._held[0][0] if self._held else self._number
            return [e for e in self._held if e[0] >= number], self._number, max(0, first - number)


def heartbeat(spark: SparkSession, beat: Callable[[DataFrame, int], None], seconds: float = BEAT_SECONDS) -> StreamingQuery:
    """Call beat with a batch of ticks every some seconds, until the query is stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.trigger(processingTime=f"{seconds} seconds").foreachBatch(beat).start()
