"""Sources that run as queries of their own, one of which may fail without the others."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .ingest import Breaker


class Supervisor(StreamingQueryListener):
    """Starts a streaming query for each source, counts its failures in a row, and starts it anew until there were ``most``.

    A query that ends with an error has failed; a batch that went through starts the count anew. Which query belongs to which
    source is known by the run, so restarts from a checkpoint count for the same source. ``tend`` does what is due, and is
    called by whoever waits; nothing is started from within the listener's own thread."""

    def __init__(self, spark: SparkSession, most: int = 3):
        self.spark, self.breaker = spark, Breaker(most)
        self.make: dict[str, Callable[[], StreamingQuery]] = {}
        self.of_run: dict[str, str] = {}
        self.due: set[str] = set()
        self.running: dict[str, StreamingQuery] = {}
        self.done: set[str] = set()
        self.lock = threading.RLock()
        spark.streams.addListener(self)

    def start(self, name: str, make: Callable[[], StreamingQuery]) -> None:
        """Keep a source running: ``make`` starts its query, from its checkpoint."""
        with self.lock:
            self.make[name] = make
            self._start(name)

    def _start(self, name: str) -> None:
        self.due.discard(name)
        self.done.discard(name)
        try:
            q = self.make[name]()
        except Exception:  # a source that can't even start has failed too
            self.breaker.failed(name)
            self._again(name)
            return
        self.running[name] = q
        self.of_run[str(q.runId)] = name

    def _again(self, name: str) -> None:
        self.running.pop(name, None)
        if self.breaker.open(name):
            self.done.add(name)
        else:
            self.due.add(name)

    def tend(self) -> None:
        """See which queries have ended, and start those that are due."""
        with self.lock:
            for name, q in list(self.running.items()):
                if not q.isActive:
                    if q.exception() is None:
                        self.breaker.went_well(name)
                        self.running.pop(name)
                        self.done.add(name)
                    else:
                        self.breaker.failed(name)
                        self._again(name)
            for name in sorted(self.due):
                self._start(name)

    def wait(self, seconds: float, every: float = 0.2) -> bool:
        """Tend the sources until all have ended or were given up; false if some still run after ``seconds``."""
        end = time.monotonic() + seconds
        while time.monotonic() < end:
            self.tend()
            if len(self.done) == len(self.make):
                return True
            time.sleep(every)
        return False

    def given_up(self) -> list[str]:
        return sorted(n for n in self.make if self.breaker.open(n))

    def stop(self) -> None:
        self.spark.streams.removeListener(self)
        for q in self.running.values():
            q.stop()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self.lock:
            if name := self.of_run.get(str(event.progress.runId)):
                self.breaker.went_well(name)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
