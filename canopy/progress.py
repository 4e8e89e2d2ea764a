"""Progress of a command on a terminal, from Spark's own status tracker."""

from __future__ import annotations

import sys
import threading
from typing import TextIO


class Progress:
    """with Progress(spark, "diff"): ... shows on one line the tasks done of the stages at work.

    Nothing is written unless the stream is a terminal, or `always` is given."""

    def __init__(self, spark, label: str, stream: TextIO | None = None, always: bool = False, every: float = 0.5):
        self.tracker, self.label, self.every = spark.sparkContext.statusTracker(), label, every
        self.stream = sys.stderr if stream is None else stream
        self.shown = always or self.stream.isatty()
        self.over = threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def line(self) -> str:
        infos = [s for s in map(self.tracker.getStageInfo, self.tracker.getActiveStageIds()) if s is not None]
        done, total = sum(s.numCompletedTasks for s in infos), sum(s.numTasks for s in infos)
        return f"{self.label}: {done}/{total} tasks of {len(infos)} stages" if infos else f"{self.label}: working on the driver"

    def _run(self) -> None:
        while not self.over.wait(self.every):
            self.stream.write("\r\x1b[K" + self.line())
            self.stream.flush()

    def __enter__(self) -> Progress:
        if self.shown:
            self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        if self.shown:
            self.thread.join()
            self.stream.write("\r\x1b[K")
            self.stream.flush()
