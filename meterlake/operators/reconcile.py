"""Exactly-once dedup, source election with safe handoff, finalization and ledgers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.schema import COUNTERS
from meterlake.functions.usage import derived_id, is_weak, standing
from meterlake.operators.counters import REQUEST


def dedup_first(deltas: DataFrame) -> DataFrame:
    """The first delta of each (source, stable id); a repeat counts as seen whatever became of the first."""
    order = Window.partitionBy("source_adapter_id", "stable_ingestion_id").orderBy("seq")
    return deltas.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def elect_sources(deltas: DataFrame) -> DataFrame:
    """Of several sources of a request only one counts at a time.

    The first source is active. A strictly better one takes over only if it can prove, for each counter that was
    contributed to, a cumulative position at least as high; it then adds what lies beyond. All others are suppressed.
    The order matters, so the deltas of contested requests, sorted by (request, seq), run through one fold that holds the
    active source and six sums; requests with a single source, which are nearly all, and low-confidence keys need none.
    """
    rows = deltas.repartition(*[F.col(k) for k in REQUEST])
    sure = F.when(~is_weak(F.col("correlation_confidence")), F.col("source_adapter_id"))
    request = Window.partitionBy(*REQUEST)
    rows = rows.withColumn("_contested", sure.isNotNull() & F.coalesce(F.min(sure).over(request) != F.max(sure).over(request), F.lit(False)))
    contested = rows.filter("_contested").drop("_contested")
    rank = standing()
    contested = contested.withColumn("_standing", ((rank["token"] * 8 + rank["temporal"]).cast("long") * (1 << 32)) + rank["priority"] + (1 << 31))
    schema = contested.schema
    sums = [f"delta_{c}" for c in COUNTERS]
    names, keys = [f.name for f in schema], [*REQUEST, "source_adapter_id", "_standing", *sums, *[f"cum_{c}" for c in COUNTERS]]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        request = active = standing_ = held = None
        for batch in batches:
            kept, new = [], {c: [] for c in sums}
            columns = zip(*[batch.column(names.index(k)).to_pylist() for k in keys], strict=True)
            for n, (agent, session, key, source, rank_, *values) in enumerate(columns):
                delta, cum = values[: len(COUNTERS)], values[len(COUNTERS) :]
                if request != (agent, session, key):
                    request, active, standing_, held = (agent, session, key), source, rank_, [0] * len(COUNTERS)
                elif source != active:
                    if rank_ <= standing_ or any(h > 0 and (x is None or x < h) for h, x in zip(held, cum, strict=True)):
                        continue
                    delta = [0 if x is None else x - h for h, x in zip(held, cum, strict=True)]
                    active, standing_ = source, rank_
                held = [h + d for h, d in zip(held, delta, strict=True)]
                kept.append(n)
                for c, d in zip(sums, delta, strict=True):
                    new[c].append(d)
            out = batch.take(pa.array(kept, pa.int64()))
            new["delta_total"] = [a + b for a, b in zip(new["delta_context_input"], new["delta_output"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else out.column(i) for i, f in enumerate(out.schema)], schema=out.schema)

    settled = contested.sortWithinPartitions(*REQUEST, "seq").mapInArrow(fold, schema).drop("_standing")
    return rows.filter(~F.col("_contested")).drop("_contested").unionByName(settled)


def events(deltas: DataFrame, prepared: DataFrame) -> DataFrame:
    """Live deltas and finals in one table, with what earlier events of the request say about each.

    live_before_*: accepted live tokens so far; prev_*: counters of the final before; rejected: a live delta after a final.
    """
    keep = ["seq", "collector_run_id", "source_adapter_id", "agent_id", "agent_name", "session_id", "request_key", "wall_timestamp_ms", "observed_monotonic_ns", "model", "provider", "source_priority", "token_accuracy", "temporal_accuracy", "measurement_kind", "timing"]
    live = deltas.select(*keep, F.lit(False).alias("final"), "gap_state", "stable_ingestion_id", *[F.col(f"delta_{c}").alias(c) for c in COUNTERS])
    finals = prepared.filter("event_kind = 'Final'").select(*keep, F.lit(True).alias("final"), F.lit(None).cast("string").alias("gap_state"), "stable_ingestion_id", *COUNTERS)
    rows = live.unionByName(finals)
    before = Window.partitionBy(*REQUEST).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max("final").over(before), F.lit(False))
    rows = rows.withColumn("rejected", ~F.col("final") & done)
    accepted = ~F.col("final") & ~F.col("rejected")
    rows = rows.withColumns({f"live_before_{c}": F.coalesce(F.sum(F.when(accepted, F.col(c))).over(before), F.lit(0).cast("long")) for c in COUNTERS})
    rows = rows.withColumns({f"prev_{c}": F.last(F.when(F.col("final"), F.col(c)), ignorenulls=True).over(before) for c in COUNTERS})
    return rows.withColumn("prev_source", F.last(F.when(~F.col("rejected"), F.col("source_adapter_id")), ignorenulls=True).over(before))


def corrections(rows: DataFrame) -> DataFrame:
    """Signed differences between each final and what its request had come to; none if nothing changes."""
    held = {c: F.coalesce(F.col(f"prev_{c}"), F.col(f"live_before_{c}")) for c in COUNTERS}
    out = rows.filter("final").withColumns({f"{c}_correction": F.col(c) - held[c] for c in COUNTERS})
    out = out.withColumn("old_total", held["context_input"] + held["output"]).withColumn("new_total", F.col("context_input") + F.col("output"))
    changed = F.lit(False)
    for c in COUNTERS:
        changed = changed | (F.col(f"{c}_correction") != 0)
    return out.filter(changed).select(
        derived_id("corr_", *[F.col(k) for k in REQUEST], F.col("source_adapter_id"), F.col("seq")).alias("correction_id"),
        "collector_run_id",
        *REQUEST,
        "seq",
        "wall_timestamp_ms",
        *[f"{c}_correction" for c in COUNTERS],
        F.lit("Authoritative Final Usage Reconciliation").alias("reason"),
        F.coalesce("prev_source", "source_adapter_id").alias("old_source"),
        F.col("source_adapter_id").alias("new_authoritative_source"),
        "old_total",
        "new_total",
    )


def accepted_deltas(rows: DataFrame) -> DataFrame:
    out = rows.filter("not final and not rejected").withColumn("delta_id", derived_id("delta_", F.col("source_adapter_id"), F.col("stable_ingestion_id")))
    drop = [f"{p}{c}" for p in ("live_before_", "prev_") for c in COUNTERS]
    return out.drop("final", "rejected", "prev_source", *drop).withColumnsRenamed({c: f"delta_{c}" for c in COUNTERS}).withColumn("delta_total", F.col("delta_context_input") + F.col("delta_output"))


def outcomes(rows: DataFrame) -> DataFrame:
    return rows.select("seq", *REQUEST, F.when(F.col("rejected"), "Rejected").otherwise("Committed").alias("outcome"), F.when(F.col("rejected"), "request_finalized_late_event").alias("reason"))


def ledgers(rows: DataFrame) -> DataFrame:
    """One row a request: canonical and live totals, the last final, and who won. Sums and max_by combine map-side."""
    rows = rows.filter(~F.col("rejected"))
    live, final = ~F.col("final"), F.col("final")
    zero = F.lit(0).cast("long")
    last = F.max_by(F.struct("source_adapter_id", "wall_timestamp_ms"), F.col("seq"))
    out = rows.groupBy(*REQUEST).agg(
        *[F.coalesce(F.sum(F.when(live, F.col(c))), zero).alias(f"live_contributed_{c}") for c in COUNTERS],
        F.max_by(F.when(final, F.struct(*COUNTERS)), F.when(final, F.col("seq"))).alias("_final"),
        F.bool_or("final").alias("is_finalized"),
        last.alias("_last"),
        F.min_by(F.struct("model", "provider"), "seq").alias("_first_names"),
        F.max_by(F.when(final, F.struct("model", "provider")), F.when(final, F.col("seq"))).alias("_final_names"),
        F.max_by(F.when(live, F.struct("source_priority", "token_accuracy", "temporal_accuracy")), F.when(live, F.col("seq"))).alias("_live"),
        F.min_by(F.struct("source_priority", "token_accuracy", "temporal_accuracy"), "seq").alias("_first"),
    )
    active = F.coalesce("_live", "_first")
    names = F.coalesce("_final_names", "_first_names")
    return out.select(
        *REQUEST,
        names["model"].alias("model"),
        names["provider"].alias("provider"),
        *[F.coalesce(F.col(f"_final.{c}"), F.col(f"live_contributed_{c}")).alias(f"canonical_{c}") for c in COUNTERS],
        *[f"live_contributed_{c}" for c in COUNTERS],
        *[F.col(f"_final.{c}").alias(f"authoritative_final_{c}") for c in COUNTERS],
        F.col("_last.source_adapter_id").alias("winning_source"),
        active["source_priority"].alias("active_live_source_priority"),
        active["token_accuracy"].alias("active_live_token_accuracy"),
        active["temporal_accuracy"].alias("active_live_temporal_accuracy"),
        "is_finalized",
        F.lit(1).alias("normalization_version"),
        F.col("_last.wall_timestamp_ms").alias("last_reconciled_at_ms"),
    )


def total_output(ledger: DataFrame, agent_id: str | None = None) -> DataFrame:
    rows = ledger if agent_id is None else ledger.filter(F.col("agent_id") == agent_id)
    return rows.agg(F.coalesce(F.sum("canonical_output"), F.lit(0)).cast("long").alias("total_output_tokens"))


def ledger_of(ledger: DataFrame, agent_id: str, session_id: str, request_key: str) -> DataFrame:
    """The ledger of one request: no row or one."""
    return ledger.filter((F.col("agent_id") == agent_id) & (F.col("session_id") == session_id) & (F.col("request_key") == request_key))


def agent_totals(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("agent_id").agg(F.coalesce(F.sum("canonical_output"), F.lit(0)).cast("long").alias("total_output_tokens"))
