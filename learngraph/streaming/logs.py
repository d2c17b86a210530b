"""Progress lines: a bounded buffer that drops the newest when full, and a reader of its own for each subscriber."""

from __future__ import annotations

import threading
from collections import deque

from pyspark.sql.streaming import StreamingQueryListener

LIMIT = 2000


class LogBuffer:
    """Lines ``stage::text``. Every subscriber sees each line once; a full buffer refuses new lines."""

    def __init__(self, limit: int = LIMIT) -> None:
        self.limit, self._lock, self._queues = limit, threading.Lock(), {}

    def subscribe(self, name: str) -> None:
        with self._lock:
            self._queues.setdefault(name, deque())

    def write(self, stage: str, text: str) -> None:
        lines = [f"{stage}::{line}" for line in text.splitlines() if line.strip()]
        with self._lock:
            for q in self._queues.values():
                q.extend(lines[: max(0, self.limit - len(q))])

    def read(self, name: str) -> list[str]:
        with self._lock:
            q = self._queues.setdefault(name, deque())
            out = list(q)
            q.clear()
            return out

    def frames(self, name: str) -> list[str]:
        return [f"data: {line}\n\n" for line in self.read(name)]


class ProgressListener(StreamingQueryListener):
    """Writes the progress of streaming queries to a buffer, under the query's name."""

    def __init__(self, buffer: LogBuffer) -> None:
        self.buffer = buffer

    def onQueryStarted(self, event):
        self.buffer.write(event.name or "stream", "started")

    def onQueryProgress(self, event):
        p = event.progress
        self.buffer.write(p.name or "stream", f"batch {p.batchId}: {p.numInputRows} rows")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.buffer.write("stream", f"ended{': ' + event.exception if event.exception else ''}")
