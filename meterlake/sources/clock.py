"""One observation a tick, shared by all sources: a monotonic clock within a run, and the wall clock."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Observation:
    collector_run_id: str
    monotonic_ns: int
    wall_ms: int

    def on(self, rows: DataFrame) -> DataFrame:
        """The rows with the observation in literal columns."""
        return rows.withColumns({"collector_run_id": F.lit(self.collector_run_id), "observed_monotonic_ns": F.lit(self.monotonic_ns).cast("long")})


class CollectorClock:
    """The clock of one run; its numbers compare within the run only."""

    def __init__(self, run_id: str | None = None):
        self.run_id = run_id or f"run_{uuid.uuid4()}"
        self.started_ns, self.started_ms = time.monotonic_ns(), time.time_ns() // 1_000_000

    def observe(self) -> Observation:
        return Observation(self.run_id, time.monotonic_ns() - self.started_ns, time.time_ns() // 1_000_000)
