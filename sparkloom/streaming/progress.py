"""Progress of streaming queries for readers that may be slow: a bounded tail that drops the oldest."""

from __future__ import annotations

from collections import deque

from pyspark.sql.streaming import StreamingQueryListener


class ProgressTail(StreamingQueryListener):
    """``spark.streams.addListener(ProgressTail(100))``; ``tail()`` gives the newest events as (query id, kind, rows, batch)."""

    def __init__(self, keep: int = 1000):
        self._events: deque = deque(maxlen=keep)

    def tail(self) -> list[tuple[str, str, int | None, int | None]]:
        return list(self._events)

    def onQueryStarted(self, event) -> None:
        self._events.append((str(event.id), "started", None, None))

    def onQueryProgress(self, event) -> None:
        told = event.progress
        self._events.append((str(told.id), "progress", told.numInputRows, told.batchId))

    def onQueryIdle(self, event) -> None:
        """An idle query says nothing new."""

    def onQueryTerminated(self, event) -> None:
        self._events.append((str(event.id), "ended" if event.exception is None else "failed", None, None))
