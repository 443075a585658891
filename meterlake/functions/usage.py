"""Scalar functions over samples, all JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.schema import CONFIDENCE, COUNTERS, TEMPORAL_ACCURACY, TOKEN_ACCURACY, label, rank


def zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("long"))


def monotonic_delta(now: Column, before: Column) -> Column:
    return F.greatest(now - before, F.lit(0).cast("long"))


def normalized(usage: str = "raw_usage", strategy: Column | None = None, reasoning_in_output: Column | None = None) -> dict[str, Column]:
    """The six canonical counters and the total of a raw usage struct; null counts as 0, and cache and reasoning are parts, never added."""
    strategy = F.col("strategy") if strategy is None else strategy
    inside = F.coalesce(F.col("reasoning_in_output") if reasoning_in_output is None else reasoning_in_output, F.lit(True))
    raw = lambda name: zero(F.col(f"{usage}.raw_{name}_tokens"))
    tokens_in, out, read, write, thought = (raw(n) for n in ("input", "output", "cache_read", "cache_write", "reasoning"))
    apart = strategy == "AnthropicStyle"
    context = F.when(apart, tokens_in + read + write).otherwise(tokens_in)
    whole = F.when(inside, out).otherwise(out + thought)
    return {
        "context_input": context,
        "fresh_input": F.when(apart, tokens_in).otherwise(monotonic_delta(tokens_in, read)),
        "output": whole,
        "cache_read": read,
        "cache_write": write,
        "reasoning": thought,
        "total": context + whole,
    }


def cumulative(usage: str = "raw_usage") -> dict[str, Column]:
    """The source's cumulative position of each counter, null where the source doesn't provide it. Needs the normalised columns."""
    given = lambda name: F.col(f"{usage}.raw_{name}_tokens").isNotNull()
    has_input = given("input")
    context = has_input & ((F.col("strategy") != "AnthropicStyle") | (given("cache_read") & given("cache_write")))
    needs = {"context_input": context, "fresh_input": has_input, "output": given("output"), "cache_read": given("cache_read"), "cache_write": given("cache_write"), "reasoning": given("reasoning")}
    return {c: F.when(F.col("is_cumulative") & needs[c], F.col(c)) for c in COUNTERS}


def _filled(value: Column) -> Column:
    return F.when(F.length(value) > 0, value)


def file_offset(identity: str = "native_identity") -> Column:
    """Null unless both the file hash and the offset are there."""
    return F.concat(F.lit("file_"), F.col(f"{identity}.file_path_hash"), F.lit("_"), F.col(f"{identity}.byte_offset").cast("string"))


def correlation() -> dict[str, Column]:
    """Request id, method and confidence: the first identity in the cascade that is not empty."""
    steps = [
        (_filled(F.col("request_id")), "explicit_request_id", "Exact"),
        (F.concat(F.lit("turn_"), _filled(F.col("turn_id"))), "turn_id", "Strong"),
        (F.concat(F.lit("resp_"), _filled(F.col("response_id"))), "response_id", "Strong"),
        (F.concat(F.lit("msg_"), _filled(F.col("native_identity.native_message_id"))), "native_message_id", "Strong"),
        (file_offset(), "file_offset", "Weak"),
    ]
    request, method, confidence = F.concat(F.lit("sample_"), F.col("sample_id")), F.lit("fallback_sample_id"), F.lit("Unknown")
    for value, name, sure in reversed(steps):
        request, method, confidence = F.coalesce(value, request), F.when(value.isNotNull(), F.lit(name)).otherwise(method), F.when(value.isNotNull(), F.lit(sure)).otherwise(confidence)
    return {"request_key": request, "correlation_method": method, "correlation_confidence": confidence}


def stable_id() -> Column:
    """What identifies a record within its source, however often it is read."""
    identity = "native_identity"
    return F.coalesce(
        F.concat(F.lit("event_"), _filled(F.col(f"{identity}.native_event_id"))),
        F.concat(F.lit("row_"), _filled(F.col(f"{identity}.db_row_id"))),
        file_offset(),
        F.concat(F.lit("seq_"), F.col(f"{identity}.native_sequence_id").cast("string")),
        F.concat(F.lit("sample_"), F.col("sample_id")),
    )


def hash16(value: Column) -> Column:
    return F.substring(F.sha2(value.cast("binary"), 256), 1, 16)


def path_hash(path: Column) -> Column:
    return hash16(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))


def prefixed(prefix: str, value: Column) -> Column:
    """Fixed values of prefix: claude_session_, claude_message_, zcode_request_, zcode_session_, zcode_turn_, zcode_row_."""
    return F.concat(F.lit(prefix), hash16(value))


def rfc3339_ms(value: Column) -> Column:
    """Milliseconds since 1970; null if it is no time stamp with a zone."""
    zoned = value.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    return F.when(zoned, F.unix_millis(F.try_to_timestamp(F.upper(value))))


def least_temporal(a: Column, b: Column) -> Column:
    return label(F.least(rank(a, TEMPORAL_ACCURACY), rank(b, TEMPORAL_ACCURACY)), TEMPORAL_ACCURACY)


def standing(token: str = "token_accuracy", temporal: str = "temporal_accuracy", priority: str = "source_priority") -> Column:
    """What sources are ranked by; a source is better only if its standing is strictly greater."""
    return F.struct(rank(F.col(token), TOKEN_ACCURACY).alias("token"), rank(F.col(temporal), TEMPORAL_ACCURACY).alias("temporal"), F.coalesce(F.col(priority), F.lit(0)).cast("int").alias("priority"))


def is_weak(confidence: Column) -> Column:
    return rank(confidence, CONFIDENCE) <= 1


def input_metric(context: Column, timing: str = "timing") -> Column:
    """struct<kind, value>: tokens a second of the prefill, else until the first token, else Unavailable with a null value."""
    t = lambda n: F.col(f"{timing}.{n}")
    prefill = (t("prefill_end_ms") - t("prefill_start_ms")) / F.lit(1000.0)
    first = (t("first_token_ms") - t("request_start_ms")) / F.lit(1000.0)
    kind = F.when(prefill > 0, "PrefillExact").when(first > 0, "EffectiveMeasured").otherwise("Unavailable")
    value = F.when(prefill > 0, context / prefill).when(first > 0, context / first)
    return F.struct(kind.alias("kind"), value.cast("double").alias("value"))


def interval_metric(output: Column, interval_ms: Column) -> Column:
    """struct<tokens, seconds, tps>; seconds and tps are null without a positive interval."""
    seconds = F.when(interval_ms > 0, interval_ms / F.lit(1000.0))
    return F.struct(output.alias("tokens"), seconds.cast("double").alias("seconds"), (output / seconds).cast("double").alias("tps"))


def derived_id(prefix: str, *parts: Column) -> Column:
    """An id that a replay makes again."""
    return F.concat(F.lit(prefix), hash16(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))


def same_final(expected: dict[str, Column], held: dict[str, Column]) -> Column:
    """Whether a final equals what a ledger holds: the given counters, and model and provider where they are given too."""
    out = F.lit(True)
    for name, value in expected.items():
        out = out & value.eqNullSafe(held[name])
    return out


def prepared(samples: DataFrame) -> DataFrame:
    """Samples with their canonical counters, request key, confidence and stable id."""
    rows = samples.withColumns(normalized())
    rows = rows.withColumns({f"cum_{c}": v for c, v in cumulative().items()} | correlation() | {"stable_ingestion_id": stable_id()})
    return rows
