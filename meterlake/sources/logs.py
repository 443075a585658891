"""Usage records from JSONL logs and SQLite tables: discovery, parsing with narrow schemas, canonical samples.

Parsing names only the fields that metering needs; message contents are never materialised.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.functions.schema import SAMPLE, SEMANTICS, TERMINAL
from meterlake.functions.usage import path_hash, prefixed, rfc3339_ms


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


#: The fields of the log formats.
TOKEN_USAGE = _longs("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
ROLLOUT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField(
            "payload",
            T.StructType([T.StructField("type", T.StringType()), T.StructField("info", T.StructType([T.StructField("total_token_usage", TOKEN_USAGE), T.StructField("last_token_usage", TOKEN_USAGE), T.StructField("model_context_window", T.LongType())]))]),
        ),
    ]
)
TRANSCRIPT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "timestamp", "sessionId", "uuid", "version")]
    + [T.StructField("message", T.StructType([T.StructField(n, T.StringType()) for n in ("id", "model")] + [T.StructField("usage", _longs("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"))]))]
)
USAGE_ROW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "logical_request_id", "session_id", "turn_id", "provider_id", "model_id", "variant", "status")]
    + [
        T.StructField(n, T.LongType())
        for n in (
            "started_at",
            "first_token_at",
            "completed_at",
            "duration_ms",
            "time_to_first_token_ms",
            "input_tokens",
            "output_tokens",
            "reasoning_tokens",
            "cache_creation_input_tokens",
            "cache_read_input_tokens",
            "provider_total_tokens",
            "computed_total_tokens",
            "retry_count",
            "retryable",
            "cancelled_by_user",
            "context_exceeded",
        )
    ]
)


def default_root(*below: str) -> str:
    home = os.environ.get("USERPROFILE") or os.environ.get("HOME") or "."
    return os.path.join(home, *below)


def discover(spark: SparkSession, root: str, pattern: str, recursive: bool = True) -> DataFrame:
    """path, file_hash, size, modification_time of the files under root; contents are not read. No folder: no files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, size long, modification_time timestamp, file_hash string")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modification_time"))
    return files.withColumn("file_hash", path_hash(F.regexp_replace("path", "^file:/*", "/")))


def by_age(files: DataFrame) -> DataFrame:
    return files.orderBy("modification_time", "path")


#: Where the sources lie below the home folder.
ROLLOUTS, TRANSCRIPTS, USAGE = (".codex",), (".claude", "projects"), (".zcode", "cli")


def discover_rollouts(spark: SparkSession, root: str | None = None) -> DataFrame:
    return by_age(discover(spark, os.path.join(root or default_root(*ROLLOUTS), "sessions"), "rollout-*.jsonl"))


def discover_transcripts(spark: SparkSession, root: str | None = None) -> DataFrame:
    return by_age(discover(spark, root or default_root(*TRANSCRIPTS), "*.jsonl"))


def discover_state_files(spark: SparkSession, root: str | None = None) -> DataFrame:
    return discover(spark, root or default_root(*ROLLOUTS), "state_*.sqlite", recursive=False)


def discover_usage_database(spark: SparkSession, root: str | None = None) -> DataFrame:
    """The usage database: no row or one."""
    return discover(spark, os.path.join(root or default_root(*USAGE), "db"), "db.sqlite", recursive=False)


def environment_counts(spark: SparkSession, root: str | None = None) -> DataFrame:
    """Files beside the usage database: of rollouts and of logs, not below."""
    root = root or default_root(*USAGE)
    counts = [discover(spark, os.path.join(root, name), "*.jsonl", recursive=False).agg(F.count(F.lit(1)).alias(f"{name}_files")) for name in ("rollout", "log")]
    return counts[0].join(F.broadcast(counts[1]))  # one row each


def _parsed(value: Column, schema: T.StructType) -> Column:
    return F.from_json(value.cast("string"), schema, {"mode": "PERMISSIVE"})


def _is_object(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.ltrim(text).startswith("{") & F.try_parse_json(text).isNotNull(), F.lit(False))


def parse_rollouts(lines: DataFrame) -> DataFrame:
    """Cumulative counters of token_count events; `error` marks bad JSON and bad time stamps of such events, the rest drops out."""
    rows = lines.withColumn("r", _parsed(F.col("value"), ROLLOUT))
    good = _is_object(F.col("value"))
    total = F.col("r.payload.info.total_token_usage")
    kept = (F.col("r.type") == "event_msg") & (F.col("r.payload.type") == "token_count") & total.isNotNull()
    at = rfc3339_ms(F.col("r.timestamp"))
    error = F.when(~good, "bad_json").when(at.isNull(), "bad_timestamp")
    rows = rows.filter(~good | F.coalesce(kept, F.lit(False))).withColumn("error", error).withColumn("timestamp_ms", at)
    return rows.select(*lines.columns, "error", "timestamp_ms", total.alias("total"), F.col("r.payload.info.last_token_usage").alias("last"))


def parse_transcripts(lines: DataFrame) -> DataFrame:
    """Usage of assistant messages: final if both cache counters are there (0 counts), else a placeholder."""
    rows = lines.withColumn("r", _parsed(F.col("value"), TRANSCRIPT))
    good = _is_object(F.col("value"))
    usage = F.col("r.message.usage")
    kept = (F.col("r.type") == "assistant") & usage.isNotNull()
    at = rfc3339_ms(F.col("r.timestamp"))
    final = usage["cache_read_input_tokens"].isNotNull() & usage["cache_creation_input_tokens"].isNotNull()
    rows = rows.filter(~good | F.coalesce(kept, F.lit(False))).withColumn("error", F.when(~good, "bad_json").when(at.isNull(), "bad_timestamp"))
    return rows.select(
        *lines.columns,
        "error",
        at.alias("timestamp_ms"),
        F.col("r.sessionId").alias("session"),
        F.col("r.message.id").alias("message_id"),
        F.col("r.message.model").alias("model"),
        usage.alias("usage"),
        F.when(final, "AuthoritativeFinal").otherwise("Placeholder").alias("finality"),
    )


def _sample(rows: DataFrame, adapter: str, **given: Column) -> DataFrame:
    strategy, inside, _ = SEMANTICS[adapter]
    given = {"source_adapter_id": F.lit(adapter), "agent_id": F.lit(adapter), "agent_name": F.lit(adapter), "strategy": F.lit(strategy), "reasoning_in_output": F.lit(inside), "counter_reset_hint": F.lit(False), "token_accuracy": F.lit("Exact"), "source_priority": F.lit(50)} | given
    return rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SAMPLE])


def _struct(schema: T.StructType, **given: Column) -> Column:
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def transcript_statistics(parsed: DataFrame) -> DataFrame:
    """How many records were consumed, and what became of them; unresolved ones have no session or message and count as degraded."""
    final, known = F.col("finality") == "AuthoritativeFinal", F.col("session").isNotNull() & F.col("message_id").isNotNull()
    good = F.col("error").isNull()
    return parsed.agg(
        F.count(F.lit(1)).alias("consumed"),
        F.count_if(~good).alias("errors"),
        F.count_if(good & ~final).alias("placeholders"),
        F.count_if(good & final & ~known).alias("unresolved"),
        F.count_if(good & final & known).alias("finals"),
    )


def in_sequence(samples: DataFrame) -> DataFrame:
    """Cumulative samples of files with what follows from the one before: interval and baseline mode.

    The interval is the time since the file's sample before, a baseline included; the first sample of a file starts at
    zero, later ones continue, and baselines stay baselines.
    """
    file = Window.partitionBy("agent_id", "session_id", "native_identity.file_path_hash").orderBy("seq")
    counted = (F.col("measurement_kind") == "SnapshotDelta") & F.col("is_cumulative") & F.col("native_identity.file_path_hash").isNotNull()
    before, now = F.lag("source_timestamp_ms").over(file), F.col("source_timestamp_ms")
    rows = samples.withColumn("_first", F.row_number().over(file) == 1).withColumn("_interval", F.when(now > before, now - before))
    mode = F.when(F.col("baseline_mode") == "ReplayRestore", F.col("baseline_mode")).when(F.col("_first"), "KnownZeroOrigin").otherwise("ContinuousEpoch")
    timing = F.col("timing").withField("measurement_interval_ms", F.col("_interval"))
    return rows.withColumns({"timing": F.when(counted, timing).otherwise(F.col("timing")), "baseline_mode": F.when(counted, mode).otherwise(F.col("baseline_mode"))}).drop("_first", "_interval")


def rollout_samples(parsed: DataFrame, run_id: str = "batch") -> DataFrame:
    """Cumulative samples of one request a file, in order of seq.

    Needs file_hash, offset, seq, observed_monotonic_ns; a column baseline_mode marks baselines.
    """
    rows = parsed.filter("error is null")
    mode = F.col("baseline_mode") if "baseline_mode" in parsed.columns else F.lit(None)
    t = lambda n: F.col(f"total.{n}")
    usage = _struct(SAMPLE["raw_usage"].dataType, raw_input_tokens=t("input_tokens"), raw_output_tokens=t("output_tokens"), raw_cache_read_tokens=t("cached_input_tokens"), raw_cache_write_tokens=t("cache_write_input_tokens"), raw_reasoning_tokens=t("reasoning_output_tokens"), raw_total_tokens=t("total_tokens"))
    return in_sequence(
        _sample(
            rows,
            "codex",
            seq=F.col("seq"),
            sample_id=F.concat("file_hash", F.lit("_"), "offset"),
            collector_run_id=F.lit(run_id),
            source_type=F.lit("JSONL"),
            observed_monotonic_ns=F.col("observed_monotonic_ns"),
            wall_timestamp_ms=F.col("timestamp_ms"),
            source_timestamp_ms=F.col("timestamp_ms"),
            session_id=F.concat(F.lit("codex_session_"), "file_hash"),
            request_id=F.lit("session_cumulative"),
            native_identity=_struct(SAMPLE["native_identity"].dataType, file_path_hash=F.col("file_hash"), byte_offset=F.col("offset")),
            model=F.lit("unknown"),
            provider=F.lit("openai"),
            event_kind=F.lit("Snapshot"),
            is_cumulative=F.lit(True),
            is_final=F.lit(False),
            raw_usage=usage,
            timing=_struct(SAMPLE["timing"].dataType),
            temporal_accuracy=F.lit("IntervalExact"),
            measurement_kind=F.lit("SnapshotDelta"),
            baseline_mode=mode,
        )
    )


def transcript_samples(parsed: DataFrame, run_id: str = "batch") -> DataFrame:
    """Final samples, one request a message; placeholders and records without identity drop out."""
    rows = parsed.filter("error is null and finality = 'AuthoritativeFinal' and session is not null and message_id is not null")
    u = lambda n: F.col(f"usage.{n}")
    message = prefixed("claude_message_", F.col("message_id"))
    return _sample(
        rows,
        "claude",
        seq=F.col("seq"),
        sample_id=F.concat("file_hash", F.lit("_"), "offset"),
        collector_run_id=F.lit(run_id),
        source_type=F.lit("JSONL"),
        observed_monotonic_ns=F.col("observed_monotonic_ns"),
        wall_timestamp_ms=F.col("timestamp_ms"),
        source_timestamp_ms=F.col("timestamp_ms"),
        session_id=prefixed("claude_session_", F.col("session")),
        request_id=message,
        native_identity=_struct(SAMPLE["native_identity"].dataType, native_message_id=message, file_path_hash=F.col("file_hash"), byte_offset=F.col("offset")),
        model=F.coalesce("model", F.lit("unknown")),
        provider=F.lit("anthropic"),
        event_kind=F.lit("Final"),
        is_cumulative=F.lit(False),
        is_final=F.lit(True),
        raw_usage=_struct(SAMPLE["raw_usage"].dataType, raw_input_tokens=u("input_tokens"), raw_output_tokens=u("output_tokens"), raw_cache_read_tokens=u("cache_read_input_tokens"), raw_cache_write_tokens=u("cache_creation_input_tokens")),
        timing=_struct(SAMPLE["timing"].dataType),
        temporal_accuracy=F.lit("TurnExact"),
        measurement_kind=F.lit("NativeCounter"),
        baseline_mode=F.lit("KnownZeroOrigin"),
    )


def usage_row_samples(rows: DataFrame, run_id: str = "batch") -> DataFrame:
    """Final samples of the terminal rows of a usage table; negative counters count as 0, missing ones stay missing."""
    rows = rows.filter(F.col("status").isin(*TERMINAL))
    n = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0)))
    usage = {"raw_input_tokens": n("input_tokens"), "raw_output_tokens": n("output_tokens"), "raw_cache_read_tokens": n("cache_read_input_tokens"), "raw_cache_write_tokens": n("cache_creation_input_tokens"), "raw_reasoning_tokens": n("reasoning_tokens"), "raw_total_tokens": F.coalesce("provider_total_tokens", "computed_total_tokens")}
    return _sample(
        rows,
        "zcode",
        seq=F.col("seq"),
        sample_id=F.col("id"),
        collector_run_id=F.lit(run_id),
        source_type=F.lit("SQLite"),
        observed_monotonic_ns=F.col("observed_monotonic_ns"),
        wall_timestamp_ms=F.col("completed_at"),
        source_timestamp_ms=F.col("completed_at"),
        session_id=prefixed("zcode_session_", F.col("session_id")),
        request_id=prefixed("zcode_request_", F.col("logical_request_id")),
        turn_id=prefixed("zcode_turn_", F.col("turn_id")),
        native_identity=_struct(SAMPLE["native_identity"].dataType, db_row_id=prefixed("zcode_row_", F.col("id"))),
        model=F.col("model_id"),
        provider=F.col("provider_id"),
        event_kind=F.lit("Final"),
        is_cumulative=F.lit(False),
        is_final=F.lit(True),
        raw_usage=_struct(SAMPLE["raw_usage"].dataType, **usage),
        timing=_struct(SAMPLE["timing"].dataType, request_start_ms=F.col("started_at"), first_token_ms=F.col("first_token_at"), last_token_ms=F.col("completed_at")),
        temporal_accuracy=F.lit("TurnExact"),
        measurement_kind=F.lit("NativeCounter"),
        baseline_mode=F.lit("KnownZeroOrigin"),
    )
