"""Samples made from the `events` table by integer arithmetic, so that Spark and DuckDB agree on every value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> SQL that both engines read alike.
COLUMNS = {
    "seq": "event_id",
    "sample_id": "concat('e', CAST(event_id AS VARCHAR(20)))",
    "collector_run_id": "concat('run_', CAST(CAST(floor(event_id / 500) AS BIGINT) AS VARCHAR(20)))",
    "agent_id": "concat('agent_', CAST(user_id % 3 AS VARCHAR(20)))",
    "source_adapter_id": "CASE WHEN event_id % 4 = 0 THEN 'src_app' ELSE 'src_jsonl' END",
    "session_id": "concat('s', CAST(user_id % 6 AS VARCHAR(20)))",
    "request_id": "CASE WHEN event_id % 23 = 0 THEN NULL ELSE concat('q', CAST(CAST(floor(event_id / 120) AS BIGINT) AS VARCHAR(20))) END",
    "turn_id": "CASE WHEN event_id % 46 = 0 THEN concat('t', CAST(CAST(floor(event_id / 400) AS BIGINT) AS VARCHAR(20))) ELSE NULL END",
    "native_event_id": "CASE WHEN event_id % 10 = 3 THEN concat('n', CAST(event_id - 1 AS VARCHAR(20))) WHEN event_id % 7 = 0 THEN NULL ELSE concat('n', CAST(event_id AS VARCHAR(20))) END",
    "db_row_id": "CASE WHEN event_id % 14 = 0 THEN concat('r', CAST(event_id AS VARCHAR(20))) ELSE NULL END",
    "event_kind": "CASE WHEN event_id % 97 = 0 THEN 'Final' WHEN event_id % 5 = 0 THEN 'Delta' ELSE 'Snapshot' END",
    "counter_reset_hint": "(event_id % 29 = 0)",
    "observed_monotonic_ns": "CAST(event_id * 250000000 AS BIGINT)",
    "raw_input_tokens": "CAST(floor(value) AS BIGINT) * 10 + event_id % 120",
    "raw_output_tokens": "CAST(floor(value) AS BIGINT) % 50 + event_id % 120",
    "raw_cache_read_tokens": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) * 4 END",
    "raw_cache_write_tokens": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) % 13 END",
    "raw_reasoning_tokens": "CAST(floor(value) AS BIGINT) % 9",
    "temporal_accuracy": "CASE WHEN event_id % 97 = 0 THEN 'TurnExact' WHEN event_id % 5 = 0 THEN 'StreamExact' ELSE 'IntervalExact' END",
    "source_priority": "CAST(CASE WHEN event_id % 4 = 0 THEN 60 ELSE 50 END AS INTEGER)",
}

SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in COLUMNS.items()) + " FROM events"


def samples(spark: SparkSession, sf_dir: str, strategy: str = "OpenAiStyle") -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(*[F.expr(v).alias(k) for k, v in COLUMNS.items()])
    null = lambda kind: F.lit(None).cast(kind)
    identity = F.struct("native_event_id", null("string").alias("native_message_id"), null("string").alias("native_request_id"), null("string").alias("native_turn_id"), null("string").alias("file_path_hash"), null("long").alias("byte_offset"), "db_row_id", null("long").alias("native_sequence_id"))
    usage = F.struct(*[f"raw_{c}_tokens" for c in ("input", "output", "cache_read", "cache_write", "reasoning")], null("long").alias("raw_total_tokens"))
    start = F.col("seq") * 250
    timing = F.struct(start.alias("request_start_ms"), F.when(F.col("seq") % 3 == 0, start + 400).alias("first_token_ms"), null("long").alias("last_token_ms"), null("long").alias("prefill_start_ms"), null("long").alias("prefill_end_ms"), F.when(F.col("seq") % 2 == 0, F.lit(1500).cast("long")).alias("measurement_interval_ms"))
    return rows.select(
        *[c for c in rows.columns if c not in ("native_event_id", "db_row_id") and not c.startswith("raw_")],
        (F.col("seq") * 250).alias("wall_timestamp_ms"),
        F.col("agent_id").alias("agent_name"),
        null("string").alias("response_id"),
        identity.alias("native_identity"),
        F.lit("m1").alias("model"),
        F.lit("p1").alias("provider"),
        (F.col("event_kind") != "Delta").alias("is_cumulative"),
        (F.col("event_kind") == "Final").alias("is_final"),
        usage.alias("raw_usage"),
        timing.alias("timing"),
        F.lit("Exact").alias("token_accuracy"),
        F.when(F.col("event_kind") == "Delta", "NativeCounter").when(F.col("event_kind") == "Snapshot", "SnapshotDelta").otherwise("TurnAverage").alias("measurement_kind"),
        F.lit("KnownZeroOrigin").alias("baseline_mode"),
        F.lit(strategy).alias("strategy"),
        F.lit(strategy != "GenericStyle").alias("reasoning_in_output"),
    )
