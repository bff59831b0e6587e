"""Watch a run's memory and time, and stop it beyond its caps."""

from __future__ import annotations

import json
import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class OverBudget(RuntimeError):
    """A cap was passed; Spark's jobs of the run have been cancelled."""


def _resident() -> int:
    """Bytes of this process in memory."""
    with open("/proc/self/status") as lines:
        return next((int(x.split()[1]) << 10 for x in lines if x.startswith("VmRSS:")), 0)


@dataclass
class Monitor:
    """Samples the driver's Python and JVM memory while its block runs; cancels all jobs beyond max_bytes or max_seconds.

    with Monitor(spark, max_seconds=2700) as m: ...; then m.samples (seconds, python_bytes, jvm_bytes) and m.peak.
    """

    spark: SparkSession
    max_bytes: int | None = None
    max_seconds: float | None = None
    interval: float = 0.5
    samples: list[tuple[float, int, int]] = field(default_factory=list)
    over: str | None = None

    @property
    def peak(self) -> int:
        return max((p + j for _, p, j in self.samples), default=0)

    def _sample(self) -> None:
        runtime = self.spark._jvm.java.lang.Runtime.getRuntime()
        at = time.monotonic() - self._began
        self.samples.append((at, _resident(), runtime.totalMemory() - runtime.freeMemory()))
        if self.max_bytes is not None and sum(self.samples[-1][1:]) > self.max_bytes:
            self.over = f"{sum(self.samples[-1][1:])} bytes of {self.max_bytes}"
        if self.max_seconds is not None and at > self.max_seconds:
            self.over = f"{at:.1f} of {self.max_seconds} seconds"
        if self.over:
            self.spark.sparkContext.cancelAllJobs()

    def _watch(self) -> None:
        while not self._end.wait(self.interval):
            self._sample()

    def __enter__(self) -> Monitor:
        self._began, self._end = time.monotonic(), threading.Event()
        self._sample()
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, kind, error, trace) -> bool:
        self._end.set()
        self._thread.join()
        self._sample()
        if self.over:
            raise OverBudget(self.over) from error
        return False

    def table(self) -> DataFrame:
        """The samples as rows."""
        return self.spark.createDataFrame(self.samples, "seconds double, python_bytes long, jvm_bytes long")

    def summary(self) -> str:
        return json.dumps({"samples": len(self.samples), "peak_bytes": self.peak, "seconds": round(self.samples[-1][0], 3)})
