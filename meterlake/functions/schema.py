"""Schemas, ordered enumerations and per-source semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Enumerations from low to high; their rank is the position.
TOKEN_ACCURACY = ("Unavailable", "Estimated", "Measured", "Exact")
TEMPORAL_ACCURACY = ("Unavailable", "Estimated", "TurnExact", "IntervalExact", "StreamExact")
CONFIDENCE = ("Unknown", "Weak", "Strong", "Exact")
#: Enumerations without an order.
EVENT_KINDS = ("Snapshot", "Delta", "Final", "Replay", "Correction")
SOURCE_TYPES = ("AppServer", "JSONL", "SQLite", "Proxy", "Hook", "Mock")
BASELINE_MODES = ("KnownZeroOrigin", "UnknownAttach", "ReplayRestore", "ContinuousEpoch")
GAP_STATES = ("Normal", "CatchUp", "Stale", "Resume")
MEASUREMENT_KINDS = ("Unknown", "NativeCounter", "StreamCounter", "SnapshotDelta", "TurnAverage", "TokenizerEstimate")
STRATEGIES = ("OpenAiStyle", "AnthropicStyle", "GenericStyle")
ERROR_KINDS = ("None", "SourceUnavailable", "CheckpointPersist", "CheckpointLoad", "EngineStorage", "Fatal")
#: Final states of a usage row.
TERMINAL = ("completed", "error", "cancelled")

#: The six counters of an account, in order.
COUNTERS = ("context_input", "fresh_input", "output", "cache_read", "cache_write", "reasoning")
KEY = ("agent_id", "session_id", "request_id")


def _struct(kind: T.DataType, *names: str) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names])


USAGE = _struct(T.LongType(), "raw_input_tokens", "raw_output_tokens", "raw_cache_read_tokens", "raw_cache_write_tokens", "raw_reasoning_tokens", "raw_total_tokens")
TIMING = _struct(T.LongType(), "request_start_ms", "first_token_ms", "last_token_ms", "prefill_start_ms", "prefill_end_ms", "measurement_interval_ms")
IDENTITY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("native_event_id", "native_message_id", "native_request_id", "native_turn_id", "file_path_hash")]
    + [T.StructField("byte_offset", T.LongType()), T.StructField("db_row_id", T.StringType()), T.StructField("native_sequence_id", T.LongType())]
)
#: One row for each observed usage record. `seq` is the order of observation; nothing relies on the order of rows.
SAMPLE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("collector_run_id", T.StringType()),
        T.StructField("source_adapter_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("observed_monotonic_ns", T.LongType()),
        T.StructField("wall_timestamp_ms", T.LongType()),
        T.StructField("source_timestamp_ms", T.LongType()),
        T.StructField("process_id", T.IntegerType()),
        T.StructField("agent_id", T.StringType()),
        T.StructField("agent_name", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("turn_id", T.StringType()),
        T.StructField("response_id", T.StringType()),
        T.StructField("native_identity", IDENTITY),
        T.StructField("model", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("event_kind", T.StringType()),
        T.StructField("is_cumulative", T.BooleanType()),
        T.StructField("is_final", T.BooleanType()),
        T.StructField("counter_reset_hint", T.BooleanType()),
        T.StructField("raw_usage", USAGE),
        T.StructField("timing", TIMING),
        T.StructField("source_priority", T.IntegerType()),
        T.StructField("token_accuracy", T.StringType()),
        T.StructField("temporal_accuracy", T.StringType()),
        T.StructField("measurement_kind", T.StringType()),
        T.StructField("baseline_mode", T.StringType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("reasoning_in_output", T.BooleanType()),
    ]
)

#: Per-source accounting: strategy, whether reasoning is part of the output, name.
SEMANTICS = {"codex": ("OpenAiStyle", True, "codex"), "claude": ("AnthropicStyle", True, "claude"), "zcode": ("OpenAiStyle", True, "zcode"), "generic": ("GenericStyle", True, "generic")}


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """Position in an ordered enumeration; unknown names and null count as the lowest."""
    out = F.lit(0)
    for i, name in enumerate(order[1:], start=1):
        out = F.when(value == name, F.lit(i)).otherwise(out)
    return out


def label(value: Column, order: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in order]), value + 1)


def parsed(value: Column, order: tuple[str, ...]) -> Column:
    """A stored name back as a member; whatever is unknown becomes the lowest."""
    return F.when(value.isin(*order), value).otherwise(F.lit(order[0]))
