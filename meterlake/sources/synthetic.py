"""Synthetic samples: what a source of a kind of event would report about accuracy and timing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.schema import SAMPLE

#: Milliseconds from a request's start to its first token, and to the sample.
FIRST_TOKEN, REQUEST = 200, 1000


def synthetic_samples(rows: DataFrame) -> DataFrame:
    """Canonical samples from rows with any of their columns; the rest follows from event_kind and wall_timestamp_ms."""
    kind, wall = F.col("event_kind"), F.col("wall_timestamp_ms")
    given = set(rows.columns)
    usage = {f.name: F.col(f.name) if f.name in given else F.lit(None) for f in SAMPLE["raw_usage"].dataType}
    if "raw_total_tokens" not in given:
        usage["raw_total_tokens"] = F.col("raw_input_tokens") + F.col("raw_output_tokens")
    timing = {"request_start_ms": wall - REQUEST, "first_token_ms": wall - REQUEST + FIRST_TOKEN, "last_token_ms": wall}
    identity = {f.name: F.col(f.name) if f.name in given else F.lit(None) for f in SAMPLE["native_identity"].dataType}

    def struct(name: str, values: dict) -> F.Column:
        return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SAMPLE[name].dataType])

    known = {
        "sample_id": F.concat(F.lit("mock_"), F.col("seq").cast("string")),
        "source_type": F.lit("Mock"),
        "source_timestamp_ms": wall,
        "process_id": F.lit(1000),
        "provider": F.lit("mock_provider"),
        "is_final": kind == "Final",
        "counter_reset_hint": F.lit(False),
        "token_accuracy": F.lit("Exact"),
        "temporal_accuracy": F.when(kind == "Delta", "StreamExact").when(kind == "Snapshot", "IntervalExact").otherwise("TurnExact"),
        "measurement_kind": F.when(kind == "Delta", "NativeCounter").when(kind == "Snapshot", "SnapshotDelta").otherwise("TurnAverage"),
        "baseline_mode": F.lit("KnownZeroOrigin"),
        "strategy": F.lit("GenericStyle"),
        "reasoning_in_output": F.lit(True),
        "native_identity": struct("native_identity", identity),
        "raw_usage": struct("raw_usage", usage),
        "timing": struct("timing", timing),
    }
    return rows.select(*[(F.col(f.name) if f.name in given else known.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in SAMPLE])
