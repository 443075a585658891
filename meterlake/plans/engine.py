"""The metering plan: samples in; deltas, corrections, ledgers, outcomes, rates out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.usage import prepared
from meterlake.operators import counters, rates, reconcile
from meterlake.operators.counters import REQUEST
from meterlake.storage import written


@dataclass
class MeterResult:
    """Everything follows from `events`, the live deltas and finals in one table, and each agent's first sample."""

    events: DataFrame
    seen: DataFrame

    @property
    def deltas(self) -> DataFrame:
        return reconcile.accepted_deltas(self.events)

    @property
    def corrections(self) -> DataFrame:
        return reconcile.corrections(self.events)

    @property
    def ledgers(self) -> DataFrame:
        return reconcile.ledgers(self.events)

    @property
    def outcomes(self) -> DataFrame:
        return reconcile.outcomes(self.events)

    def kept(self) -> MeterResult:
        """The same, computed once and written to the shared folder; for several results of one input."""
        return MeterResult(written(self.events, "events"), written(self.seen, "seen"))

    def agent_tps(self, ticks: DataFrame) -> DataFrame:
        return rates.agent_tps(self.events, self.seen, ticks)

    def global_metrics(self, ticks: DataFrame, status: DataFrame | None = None) -> DataFrame:
        return rates.global_metrics(self.agent_tps(ticks), status)

    def total_output(self, agent_id: str | None = None) -> DataFrame:
        return reconcile.total_output(self.ledgers, agent_id)

    def ledger_of(self, agent_id: str, session_id: str, request_key: str) -> DataFrame:
        return reconcile.ledger_of(self.ledgers, agent_id, session_id, request_key)


def first_deltas(rows: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Live deltas of prepared samples, the first of each (source, stable id); none whose id is taken already."""
    live = counters.live_deltas(rows)
    if taken is not None:
        live = live.join(taken, ["source_adapter_id", "stable_ingestion_id"], "left_anti")
    return reconcile.dedup_first(live)


def first_seen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("agent_id").agg(F.min("seq").alias("seq"))


def settled(firsts: DataFrame, rows: DataFrame) -> MeterResult:
    return MeterResult(reconcile.events(reconcile.elect_sources(firsts), rows), first_seen(rows))


def meter(samples: DataFrame) -> MeterResult:
    """One hash partitioning by request serves the windows of the counters, another one the ledger; dedup is by stable id."""
    rows = prepared(samples)
    return settled(first_deltas(rows.repartition(*[F.col(k) for k in REQUEST])), rows)
