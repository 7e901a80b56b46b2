"""Streams run as a service: a heartbeat while they live, failures in a row by stream, and an end without losing a batch."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StreamingQuery


@dataclass
class Service:
    """``starts`` begins each stream by name; one that failed is begun again from its checkpoint, until it failed ``most`` times in a row.

    A stream that runs longer than one round without failing counts from 0 again.
    """

    starts: dict[str, Callable[[], StreamingQuery]]
    beat: Callable[[dict[str, int]], None] = lambda failures: None
    every: float = 30.0
    most: int = 3
    stop: threading.Event = field(default_factory=threading.Event)
    failures: dict[str, int] = field(default_factory=dict)

    def on_signal(self, *numbers: int) -> None:
        """SIGTERM and the like end the service after the batch in hand; only the main thread may ask for that."""
        for n in numbers or (signal.SIGTERM, signal.SIGINT):
            signal.signal(n, lambda *_: self.stop.set())

    def run(self) -> dict[str, int]:
        """Until stopped, or until no stream is left; the failures in a row of each."""
        self.failures = dict.fromkeys(self.starts, 0)
        live = {name: start() for name, start in self.starts.items()}
        while live:
            self.beat(dict(self.failures))
            if self.stop.wait(self.every):
                break
            for name, query in list(live.items()):
                if query.isActive:
                    self.failures[name] = 0
                    continue
                del live[name]
                try:
                    failed = query.exception() is not None
                except StreamingQueryException:
                    failed = True
                self.failures[name] = self.failures[name] + 1 if failed else 0
                if failed and self.failures[name] < self.most:
                    live[name] = self.starts[name]()
        for query in live.values():
            query.stop()
        return dict(self.failures)
