"""Progress of a stage as typed events: a tracker that a driver loop or a streaming listener feeds."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from queue import Queue

from pyspark.sql.streaming.listener import StreamingQueryListener

from framelake.streaming.state import SMOOTHING

# Fixed value: seconds between two events.
THROTTLE = 0.1


def eta_text(seconds: float | None) -> str:
    if seconds is None:
        return "—"
    s = int(seconds)
    return f"{s}s" if s < 60 else f"{s // 60}m {s % 60}s" if s < 3600 else f"{s // 3600}h {s % 3600 // 60}m"


@dataclass(frozen=True)
class Progress:
    stage: str
    substage: str | None
    done: int
    total: int
    fraction: float
    eta_seconds: float | None
    eta_formatted: str


class Tracker:
    """Counts steps and puts events into a queue, at most one every THROTTLE seconds, the last always."""

    def __init__(self, queue: Queue, clock: Callable[[], float] = time.time):
        self.queue, self.clock, self.total = queue, clock, 0

    def start(self, total: int, stage: str, substage: str | None = None) -> None:
        self.total, self.done, self.stage, self.substage = max(0, total), 0, stage, substage
        self.mean, self.last, self.told = None, self.clock(), float("-inf")
        self._tell(True)

    def step(self, n: int = 1, substage: str | None = None) -> None:
        now = self.clock()
        each, self.last = (now - self.last) / max(1, n), now
        if each > 0:
            self.mean = each if self.mean is None else SMOOTHING * each + (1 - SMOOTHING) * self.mean
        self.done, self.substage = self.done + n, substage or self.substage
        self._tell(self.done >= self.total)

    def _tell(self, force: bool) -> None:
        now = self.clock()
        if not force and now - self.told < THROTTLE:
            return
        self.told = now
        left = None if self.mean is None else self.mean * max(0, self.total - self.done)
        self.queue.put({"progress": asdict(Progress(self.stage, self.substage, self.done, self.total, self.done / max(1, self.total), left, eta_text(left)))})


class Listener(StreamingQueryListener):
    """Feeds a tracker with the rows of each micro-batch."""

    def __init__(self, tracker: Tracker):
        self.tracker = tracker

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.tracker.step(event.progress.numInputRows, event.progress.name)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
