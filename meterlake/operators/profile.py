"""Filters, keyed lookups, profiles and orderings over usage rows, ledgers and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.schema import TERMINAL

LOOKBACK_MS = 600_000


def terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def max_completed(rows: DataFrame) -> DataFrame:
    return rows.filter(terminal(F.col("status"))).agg(F.max("completed_at").alias("max_completed_at"))


def watermark_lookback(rows: DataFrame, watermark_ms: int, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """Rows from the watermark less the lookback on: rows are updated in place, so some are read again."""
    return rows.filter(F.col("completed_at") >= watermark_ms - lookback_ms)


def after_boundary(rows: DataFrame, boundary_ms: int) -> DataFrame:
    return rows.filter(F.col("completed_at") > boundary_ms)


def status_barrier(rows: DataFrame) -> DataFrame:
    """Rows in order of (completed_at, id) before the first whose status is unknown.

    One aggregate finds the barrier and a filter applies it; no window over all rows.
    """
    barrier = rows.filter(~terminal(F.col("status")) | F.col("status").isNull()).agg(F.min(F.struct("completed_at", "id")).alias("barrier"))
    # One row: an aggregate without keys.
    return rows.join(F.broadcast(barrier)).filter(F.col("barrier").isNull() | (F.struct("completed_at", "id") < F.col("barrier"))).drop("barrier")


def untracked(files: DataFrame, tracked: DataFrame) -> DataFrame:
    return files.join(tracked.select("file_hash"), "file_hash", "left_anti")


def with_checkpoint(files: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Files with their checkpoint, null where there is none."""
    return files.join(checkpoints, "source_id", "left")


def late_after_final(samples: DataFrame, ledger: DataFrame) -> DataFrame:
    """Samples of requests that are already finalized."""
    return samples.join(ledger.filter("is_finalized").select("agent_id", "session_id", "request_key"), ["agent_id", "session_id", "request_key"], "left_semi")


def classify_finals(finals: DataFrame, ledger: DataFrame, names: bool) -> DataFrame:
    """Adds new, identical or changed: six counters, and with `names` model and provider, against the ledger."""
    from meterlake.functions.schema import COUNTERS

    held = ledger.filter("is_finalized").select("agent_id", "session_id", "request_key", F.struct(*[f"canonical_{c}" for c in COUNTERS], "model", "provider").alias("held"))
    rows = finals.join(held, ["agent_id", "session_id", "request_key"], "left")
    same = F.lit(True)
    for c in COUNTERS:
        same = same & F.greatest(F.col(c), F.lit(0)).eqNullSafe(F.col(f"held.canonical_{c}"))
    if names:
        same = same & F.col("model").eqNullSafe(F.col("held.model")) & F.col("provider").eqNullSafe(F.col("held.provider"))
    return rows.withColumn("finality", F.when(F.col("held").isNull(), "new").when(same, "identical").otherwise("changed")).drop("held")


def usage_profile(rows: DataFrame) -> DataFrame:
    """Counts of a usage table in one aggregation."""
    has = lambda c: F.count(c)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("logical_request_id").alias("requests"),
        F.countDistinct("session_id").alias("sessions"),
        F.countDistinct("model_id").alias("models"),
        has("input_tokens").alias("with_input"),
        has("output_tokens").alias("with_output"),
        F.count_if(F.col("cache_read_input_tokens").isNotNull() | F.col("cache_creation_input_tokens").isNotNull()).alias("with_cache"),
        has("reasoning_tokens").alias("with_reasoning"),
        has("time_to_first_token_ms").alias("with_ttft"),
        F.bool_and(F.coalesce(F.col("input_tokens") >= F.col("cache_read_input_tokens"), F.lit(True))).alias("input_covers_cache"),
        F.bool_and(F.coalesce(F.col("reasoning_tokens") <= F.col("output_tokens"), F.lit(True))).alias("output_covers_reasoning"),
    )


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def table_state(rows: DataFrame) -> DataFrame:
    """Row count and last final row, to compare a source before and after."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.max(F.when(terminal(F.col("status")), F.col("completed_at"))).alias("last_completed"))


def reemit_groups(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Groups that occur more than once: identical_reemit if all rows are equal, else two_phase."""
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.struct(*[F.coalesce(F.col(v).cast("string"), F.lit("\u0000")) for v in values])).alias("different"))
    return out.filter("n >= 2").select(key, "n", F.when(F.col("different") == 1, "identical_reemit").otherwise("two_phase").alias("kind"))


def validation_counts(rows: DataFrame, key: str, order: str, total: str, last: str) -> DataFrame:
    """How often a cumulative counter's increase matches the increment that the source reports."""
    before = F.lag(total).over(Window.partitionBy(key).orderBy(order))
    checked = rows.withColumn("_step", F.greatest(F.col(total) - before, F.lit(0))).filter("_step is not null")
    return checked.agg(F.count_if(F.col("_step") == F.col(last)).alias("matches"), F.count_if(F.col("_step") != F.col(last)).alias("mismatches"))


def last_lines(rows: DataFrame, key: str, order: str, n: int = 2000) -> DataFrame:
    """The last n rows of each file."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_n", nth).filter(F.col("_n") <= n).drop("_n")


def newest(files: DataFrame, predicate: Column | None = None) -> DataFrame:
    """The newest file that satisfies the predicate, or the newest at all if none does."""
    good = F.lit(True) if predicate is None else F.coalesce(predicate, F.lit(False))
    return files.withColumn("_good", good).orderBy(F.desc("_good"), F.desc("modification_time"), F.desc("path")).limit(1).drop("_good")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All samples of a tick: sources in the given order, each in its own."""
    out = sources[0].withColumn("source_order", F.lit(0))
    for i, s in enumerate(sources[1:], start=1):
        out = out.unionByName(s.withColumn("source_order", F.lit(i)))
    return out


def lines_containing(rows: DataFrame, text: str, value: str = "value", by: str = "path") -> DataFrame:
    return rows.filter(F.contains(F.col(value), F.lit(text))).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def transcript_profile(parsed: DataFrame) -> DataFrame:
    """One row over parsed transcripts: files and events with usage, which fields occur, and how messages were emitted again."""
    good = parsed.filter("error is null")
    counters = [F.col(f"usage.{c}").alias(c) for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")]
    one = good.agg(
        F.countDistinct("file_hash").alias("files_with_usage"),
        F.count(F.lit(1)).alias("usage_events"),
        F.coalesce(F.bool_or(F.col("usage.cache_read_input_tokens").isNotNull()), F.lit(False)).alias("has_cache_read"),
        F.coalesce(F.bool_or(F.col("usage.cache_creation_input_tokens").isNotNull()), F.lit(False)).alias("has_cache_creation"),
        F.coalesce(F.bool_or(F.col("model").isNotNull()), F.lit(False)).alias("has_model"),
        F.countDistinct("message_id").alias("message_ids"),
    )
    again = reemit_groups(good.filter("message_id is not null").select("message_id", "finality", *counters), "message_id", ["finality", "input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"])
    # One row each: aggregates without keys.
    return one.join(F.broadcast(again.agg(F.count_if(F.col("kind") == "identical_reemit").alias("identical_reemit_groups"), F.count_if(F.col("kind") == "two_phase").alias("two_phase_groups"))))


def health(polls: DataFrame) -> DataFrame:
    """From one row a poll (source, poll, tracked, available, failures, unknown_status, consumed, wall_ms): how a source stands.

    A poll is good if some of its sources can be read, none failed and no row has an unknown status.
    """
    degraded = (F.col("failures") > 0) | (F.col("unknown_status") > 0)
    good = (F.col("available") > 0) & ~degraded
    return polls.groupBy("source").agg(
        F.max_by("tracked", "poll").alias("tracked_sources"),
        F.max_by(F.col("available") > 0, "poll").alias("source_available"),
        F.max_by(degraded, "poll").alias("source_degraded"),
        F.max_by(F.when(F.col("failures") > 0, "SourceUnavailable").otherwise("None"), "poll").alias("last_error_kind"),
        F.max(F.when(good, F.col("wall_ms"))).alias("last_successful_poll_ms"),
        F.sum("consumed").alias("consumed"),
    )
