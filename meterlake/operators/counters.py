"""Cumulative counters to deltas, and gaps, as window expressions over one hash partitioning by request.

Epochs begin with an explicit reset. Within an epoch a sample whose output is below the running maximum is late and
changes nothing; every other sample adds what each counter exceeds its own running maximum by. The first sample of all
adds its value, or nothing if the source was attached to with history. Native deltas pass through and touch no maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.schema import COUNTERS
from meterlake.functions.usage import least_temporal, monotonic_delta

REQUEST = ("agent_id", "session_id", "request_key")
GAP_NS = 3_000_000_000


def _before(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def counter_deltas(rows: DataFrame) -> DataFrame:
    """Adds late and delta_* to prepared samples that are not final."""
    native = F.col("event_kind") == "Delta"
    state = Window.partitionBy(*REQUEST, "source_adapter_id", "native")
    order = state.orderBy("seq")
    rows = rows.withColumn("native", native).withColumn("rn", F.row_number().over(order))
    reset = (F.coalesce("counter_reset_hint", F.lit(False)) & (F.col("rn") > 1) & ~F.col("native")).cast("int")
    rows = rows.withColumn("epoch", F.sum(reset).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    epoch = Window.partitionBy(*REQUEST, "source_adapter_id", "native", "epoch").orderBy("seq")
    rows = rows.withColumn("late", ~F.col("native") & F.coalesce(F.col("output") < F.max("output").over(_before(epoch)), F.lit(False)))
    held = {f"last_{c}": F.max(F.when(~F.col("late"), F.col(c))).over(_before(epoch)) for c in COUNTERS}
    rows = rows.withColumns(held)
    first = F.col("last_output").isNull()
    hidden = (F.col("epoch") == 0) & F.col("baseline_mode").isin("UnknownAttach", "ReplayRestore")

    def delta(c: str) -> Column:
        return (
            F.when(F.col("native"), F.col(c))
            .when(F.col("late"), F.lit(0).cast("long"))
            .when(first & hidden, F.lit(0).cast("long"))
            .when(first, F.col(c))
            .otherwise(monotonic_delta(F.col(c), F.col(f"last_{c}")))
        )

    rows = rows.withColumns({f"delta_{c}": delta(c) for c in COUNTERS})
    return rows.drop("native", "rn", "epoch", *held)


def with_gaps(rows: DataFrame) -> DataFrame:
    """Adds gap_state and lowers temporal_accuracy; late samples neither have a gap nor move the clock."""
    order = Window.partitionBy(*REQUEST, "source_adapter_id", "collector_run_id", "late").orderBy("seq")
    rows = rows.withColumn("last_ns", F.lag("observed_monotonic_ns").over(order))
    now, last = F.col("observed_monotonic_ns"), F.col("last_ns")
    gap = F.when(now < last, "Stale").when(now - last > GAP_NS, "CatchUp").otherwise("Normal")
    known = F.when(gap == "Stale", F.lit("Unavailable")).when(gap == "CatchUp", F.lit("IntervalExact")).otherwise(F.col("temporal_accuracy"))
    rows = rows.withColumn("gap_state", F.when(~F.col("late"), gap))
    return rows.withColumn("temporal_accuracy", F.when(F.col("late"), F.col("temporal_accuracy")).otherwise(least_temporal(F.col("temporal_accuracy"), known))).drop("last_ns")


def not_empty(prefix: str = "delta_") -> Column:
    return F.greatest(*[F.col(f"{prefix}{c}") for c in COUNTERS]) > 0


def live_deltas(prepared: DataFrame) -> DataFrame:
    """Deltas of all samples that are not final: not late, not empty, with their gap."""
    rows = with_gaps(counter_deltas(prepared.filter("event_kind <> 'Final'")))
    return rows.filter(~F.col("late") & not_empty()).withColumn("delta_total", F.col("delta_context_input") + F.col("delta_output"))
