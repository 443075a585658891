"""Queries of what precedes and surrounds the engine: parsing, samples of each source, filters, joins, profiles.

Their inputs are made from the driver's tables by SQL that both engines read alike: log lines with bad JSON, bad time
stamps, foreign records, missing fields and messages that are told again; a usage table; files and polls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.schema import COUNTERS, TEMPORAL_ACCURACY, parsed
from meterlake.functions.usage import correlation, derived_id, input_metric, least_temporal, prepared, rfc3339_ms, stable_id, standing
from meterlake.operators import counters, profile, rates
from meterlake.plans import fixture
from meterlake.plans.engine import meter
from meterlake.plans.queries import _all, _orders, _ORDERS, _prepared_sql, query
from meterlake.sources import logs
from meterlake.sources.synthetic import synthetic_samples

_BASE_MS = 1_735_689_600_000  # 2025-01-01


def _text(number: str) -> str:
    return f"CAST({number} AS VARCHAR(20))"


def _two(number: str) -> str:
    return f"lpad({_text(f'CAST({number} AS BIGINT)')}, 2, '0')"


#: Time of day of an event, a second each, and what it is in milliseconds.
CLOCK = f"concat({_two('floor(event_id / 3600) % 24')}, ':', {_two('floor(event_id / 60) % 60')}, ':', {_two('event_id % 60')})"
MILLIS = f"({_BASE_MS} + (event_id % 86400) * 1000)"
STAMPS = f"""CASE event_id % 7 WHEN 0 THEN concat('2025-01-01T', {CLOCK}, 'Z') WHEN 1 THEN concat('2025-01-01T', {CLOCK}, '.250+02:00') WHEN 2 THEN concat('2025-01-01t', {CLOCK}, 'z')
  WHEN 3 THEN concat('2025-01-01T', {CLOCK}) WHEN 4 THEN 'yesterday' WHEN 5 THEN concat('2025-01-01 ', {CLOCK}, '-00:30') ELSE NULL END"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query(f"SELECT event_id, CASE event_id % 7 WHEN 0 THEN {MILLIS} WHEN 1 THEN {MILLIS} - 7200000 + 250 WHEN 2 THEN {MILLIS} WHEN 5 THEN {MILLIS} + 1800000 END AS ms FROM events")
def rfc3339(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", rfc3339_ms(F.expr(STAMPS)).alias("ms"))


ROLLOUT_KIND = "CASE WHEN event_id % 31 = 0 THEN 'bad_json' WHEN event_id % 37 = 0 THEN 'other' WHEN event_id % 41 = 0 THEN 'bad_timestamp' WHEN event_id % 43 = 0 THEN 'no_total' ELSE 'good' END"
#: A counter that grows with each file's lines, and falls back now and then.
GROWN, READ_CACHE = "(floor(event_id / 7) * 10 - CASE WHEN event_id % 53 = 0 THEN 400 ELSE 0 END)", "floor(event_id / 9)"
_USAGE = f"""concat('{{"input_tokens":', {_text('CAST(floor(event_id / 2) AS BIGINT)')}, CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(',"cached_input_tokens":', {_text(f'CAST({READ_CACHE} AS BIGINT)')}) END, ',"output_tokens":', {_text(f'CAST({GROWN} AS BIGINT)')}, ',"extra":"x"}}')"""
ROLLOUT = f"""CASE {ROLLOUT_KIND} WHEN 'bad_json' THEN '{{"type":"event_msg",'
  WHEN 'other' THEN '{{"timestamp":"2025-01-01T00:00:00Z","type":"response_item","payload":{{"type":"message","content":"secret words"}}}}'
  WHEN 'bad_timestamp' THEN concat('{{"timestamp":"soon","type":"event_msg","payload":{{"type":"token_count","info":{{"total_token_usage":', {_USAGE}, '}}}}}}')
  WHEN 'no_total' THEN concat('{{"timestamp":"2025-01-01T', {CLOCK}, 'Z","type":"event_msg","payload":{{"type":"token_count","info":null}}}}')
  ELSE concat('{{"timestamp":"2025-01-01T', {CLOCK}, 'Z","type":"event_msg","payload":{{"type":"token_count","info":{{"total_token_usage":', {_USAGE}, ',"last_token_usage":{{"output_tokens":', {_text('event_id % 11')}, '}}}}}}}}') END"""
FILE = "concat('f', CAST(user_id % 5 AS VARCHAR(20)))"
_LINES = f"lines AS (SELECT event_id, {FILE} AS file_hash, {ROLLOUT_KIND} AS kind, {MILLIS} AS ms, CAST(floor(event_id / 2) AS BIGINT) AS i, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST({READ_CACHE} AS BIGINT) END AS r, CAST({GROWN} AS BIGINT) AS o FROM events)"


def _lines(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("event_id").alias("offset"), F.expr(FILE).alias("file_hash"), F.expr(value).alias("value"), F.col("event_id").alias("seq"), (F.col("event_id") * 1_000_000_000).alias("observed_monotonic_ns"))


@query(
    f"""WITH {_LINES} SELECT event_id AS "offset", file_hash, CASE WHEN kind IN ('bad_json', 'bad_timestamp') THEN kind END AS error, CASE WHEN kind = 'good' THEN ms END AS timestamp_ms,
  CASE WHEN kind <> 'bad_json' THEN i END AS input_tokens, CASE WHEN kind <> 'bad_json' THEN r END AS cached_input_tokens, CASE WHEN kind <> 'bad_json' THEN o END AS output_tokens,
  CASE WHEN kind = 'good' THEN event_id % 11 END AS last_output_tokens FROM lines WHERE kind NOT IN ('other', 'no_total')"""
)
def parse_rollouts(spark, sf_dir):
    rows = logs.parse_rollouts(_lines(spark, sf_dir, ROLLOUT))
    return rows.select("offset", "file_hash", "error", "timestamp_ms", "total.input_tokens", "total.cached_input_tokens", "total.output_tokens", F.col("last.output_tokens").alias("last_output_tokens"))


@query(
    f"""WITH {_LINES}, good AS (SELECT *, lag(ms) OVER (PARTITION BY file_hash ORDER BY event_id) AS before, row_number() OVER (PARTITION BY file_hash ORDER BY event_id) AS nth FROM lines WHERE kind = 'good')
SELECT event_id AS seq, concat(file_hash, '_', event_id) AS sample_id, concat('codex_session_', file_hash) AS session_id, 'session_cumulative' AS request_id, 'Snapshot' AS event_kind, TRUE AS is_cumulative,
  'IntervalExact' AS temporal_accuracy, 'SnapshotDelta' AS measurement_kind, 50 AS source_priority, 'unknown' AS model, 'openai' AS provider, i AS raw_input_tokens, r AS raw_cache_read_tokens, o AS raw_output_tokens,
  CASE WHEN ms > before THEN ms - before END AS measurement_interval_ms, CASE WHEN nth = 1 THEN 'KnownZeroOrigin' ELSE 'ContinuousEpoch' END AS baseline_mode FROM good"""
)
def rollout_samples(spark, sf_dir):
    rows = logs.rollout_samples(logs.parse_rollouts(_lines(spark, sf_dir, ROLLOUT)))
    return rows.select("seq", "sample_id", "session_id", "request_id", "event_kind", "is_cumulative", "temporal_accuracy", "measurement_kind", "source_priority", "model", "provider", "raw_usage.raw_input_tokens", "raw_usage.raw_cache_read_tokens", "raw_usage.raw_output_tokens", "timing.measurement_interval_ms", "baseline_mode")


@query(
    f"""WITH {_LINES}, late AS (SELECT *, coalesce(o < max(o) OVER (PARTITION BY file_hash ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS late FROM lines WHERE kind = 'good')
SELECT concat('codex_session_', file_hash) AS session_id, max(o) AS canonical_output, max(i) AS canonical_context_input, max(coalesce(r, 0)) AS canonical_cache_read FROM late WHERE NOT late GROUP BY ALL"""
)
def rollout_ledgers(spark, sf_dir):
    """Lines to ledgers: cumulative logs through the whole engine."""
    out = meter(logs.rollout_samples(logs.parse_rollouts(_lines(spark, sf_dir, ROLLOUT)))).ledgers
    return out.select("session_id", "canonical_output", "canonical_context_input", "canonical_cache_read")


TRANSCRIPT_KIND = "CASE WHEN event_id % 29 = 0 THEN 'bad_json' WHEN event_id % 17 = 0 THEN 'user' WHEN event_id % 47 = 0 THEN 'bad_timestamp' ELSE 'good' END"
_CACHE = """CASE WHEN event_id % 4 = 1 THEN '' WHEN event_id % 4 = 2 THEN ',"cache_read_input_tokens":7' ELSE concat(',"cache_read_input_tokens":', CAST(event_id % 19 AS VARCHAR(20)), ',"cache_creation_input_tokens":0') END"""
TRANSCRIPT = f"""CASE {TRANSCRIPT_KIND} WHEN 'bad_json' THEN 'not json' WHEN 'user' THEN '{{"type":"user","timestamp":"2025-01-01T00:00:00Z","message":{{"content":"private"}}}}'
  ELSE concat('{{"type":"assistant","timestamp":"', CASE WHEN {TRANSCRIPT_KIND} = 'bad_timestamp' THEN '' ELSE concat('2025-01-01T', {CLOCK}, 'Z') END, '"', CASE WHEN event_id % 13 = 0 THEN '' ELSE concat(',"sessionId":"s', {_text('user_id % 4')}, '"') END,
  ',"message":{{', CASE WHEN event_id % 23 = 0 THEN '' ELSE concat('"id":"m', {_text('CAST(floor(event_id / 6) AS BIGINT)')}, '",') END, '"model":"mo","content":[{{"text":"private"}}],"usage":{{"input_tokens":', {_text('event_id % 100')}, ',"output_tokens":', {_text('CAST(floor(event_id / 12) AS BIGINT)')}, {_CACHE}, '}}}}}}') END"""
_TRANSCRIPTS = f"""t AS (SELECT event_id, {FILE} AS file_hash, {TRANSCRIPT_KIND} AS kind, {MILLIS} AS ms, CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('s', user_id % 4) END AS session,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE concat('m', CAST(floor(event_id / 6) AS BIGINT)) END AS message_id, event_id % 100 AS i, CAST(floor(event_id / 12) AS BIGINT) AS o,
  CASE WHEN event_id % 4 = 1 THEN NULL WHEN event_id % 4 = 2 THEN 7 ELSE event_id % 19 END AS r, CASE WHEN event_id % 4 IN (1, 2) THEN NULL ELSE 0 END AS w FROM events),
finals AS (SELECT *, concat('claude_session_', substr(sha256(session), 1, 16)) AS session_id, concat('claude_message_', substr(sha256(message_id), 1, 16)) AS request_id FROM t
  WHERE kind = 'good' AND r IS NOT NULL AND w IS NOT NULL AND session IS NOT NULL AND message_id IS NOT NULL)"""


def _transcripts(spark, sf_dir):
    return logs.parse_transcripts(_lines(spark, sf_dir, TRANSCRIPT))


@query(
    f"""WITH {_TRANSCRIPTS} SELECT event_id AS "offset", CASE WHEN kind <> 'good' THEN kind END AS error, CASE WHEN kind = 'good' THEN ms END AS timestamp_ms, CASE WHEN kind <> 'bad_json' THEN session END AS session,
  CASE WHEN kind <> 'bad_json' THEN message_id END AS message_id, CASE WHEN kind <> 'bad_json' THEN o END AS output_tokens,
  CASE WHEN kind = 'bad_json' OR r IS NULL OR w IS NULL THEN 'Placeholder' ELSE 'AuthoritativeFinal' END AS finality FROM t WHERE kind <> 'user'"""
)
def parse_transcripts(spark, sf_dir):
    return _transcripts(spark, sf_dir).select("offset", "error", "timestamp_ms", "session", "message_id", "usage.output_tokens", "finality")


@query(
    f"""WITH {_TRANSCRIPTS} SELECT count(*) AS consumed, count(*) FILTER (kind <> 'good') AS errors, count(*) FILTER (kind = 'good' AND (r IS NULL OR w IS NULL)) AS placeholders,
  count(*) FILTER (kind = 'good' AND w IS NOT NULL AND (session IS NULL OR message_id IS NULL)) AS unresolved, (SELECT count(*) FROM finals) AS finals FROM t WHERE kind <> 'user'"""
)
def transcript_statistics(spark, sf_dir):
    return logs.transcript_statistics(_transcripts(spark, sf_dir))


@query(
    f"""WITH {_TRANSCRIPTS}, g AS (SELECT message_id, count(*) AS n, count(DISTINCT concat_ws('|', i, o, coalesce(r, -1), coalesce(w, -1))) AS d FROM t WHERE kind = 'good' AND message_id IS NOT NULL GROUP BY message_id)
SELECT count(DISTINCT file_hash) AS files_with_usage, count(*) AS usage_events, bool_or(r IS NOT NULL) AS has_cache_read, bool_or(w IS NOT NULL) AS has_cache_creation, TRUE AS has_model, count(DISTINCT message_id) AS message_ids,
  (SELECT count(*) FROM g WHERE n >= 2 AND d = 1) AS identical_reemit_groups, (SELECT count(*) FROM g WHERE n >= 2 AND d > 1) AS two_phase_groups FROM t WHERE kind = 'good'"""
)
def transcript_profile(spark, sf_dir):
    return profile.transcript_profile(_transcripts(spark, sf_dir))


@query(
    f"""WITH {_TRANSCRIPTS} SELECT event_id AS seq, session_id, request_id, request_id AS native_message_id, i AS raw_input_tokens, o AS raw_output_tokens, r AS raw_cache_read_tokens, w AS raw_cache_write_tokens,
  CAST(NULL AS BIGINT) AS raw_reasoning_tokens, 'mo' AS model, 'anthropic' AS provider, 'Final' AS event_kind, TRUE AS is_final, 'TurnExact' AS temporal_accuracy, 'NativeCounter' AS measurement_kind FROM finals"""
)
def transcript_samples(spark, sf_dir):
    rows = logs.transcript_samples(_transcripts(spark, sf_dir))
    usage = [f"raw_usage.raw_{c}_tokens" for c in ("input", "output", "cache_read", "cache_write", "reasoning")]
    return rows.select("seq", "session_id", "request_id", "native_identity.native_message_id", *usage, "model", "provider", "event_kind", "is_final", "temporal_accuracy", "measurement_kind")


@query(
    f"""WITH {_TRANSCRIPTS}, l AS (SELECT session_id, request_id, max_by(i, event_id) AS i, max_by(o, event_id) AS o, max_by(r, event_id) AS r, max_by(w, event_id) AS w FROM finals GROUP BY ALL)
SELECT session_id, request_id AS request_key, i + r + w AS canonical_context_input, i AS canonical_fresh_input, o AS canonical_output, r AS canonical_cache_read FROM l"""
)
def transcript_ledgers(spark, sf_dir):
    """Lines to ledgers: the last final of each message counts, whichever file tells it."""
    return meter(logs.transcript_samples(_transcripts(spark, sf_dir))).ledgers.select("session_id", "request_key", "canonical_context_input", "canonical_fresh_input", "canonical_output", "canonical_cache_read")


#: Finals of the second half against ledgers of the first.
_HALVES = f"""WITH {_TRANSCRIPTS}, half AS (SELECT *, event_id % 6 < 3 AS old FROM finals),
held AS (SELECT session_id, request_id, max_by(i, event_id) AS i, max_by(o, event_id) AS o, max_by(r, event_id) AS r FROM half WHERE old GROUP BY ALL)"""


@query(
    _HALVES
    + """ SELECT f.event_id AS seq, CASE WHEN h.request_id IS NULL THEN 'new' WHEN f.i = h.i AND f.o = h.o AND f.r = h.r THEN 'identical' ELSE 'changed' END AS finality
FROM half f LEFT JOIN held h USING (session_id, request_id) WHERE NOT f.old"""
)
def classified_finals(spark, sf_dir):
    rows = logs.transcript_samples(_transcripts(spark, sf_dir))
    ledgers = meter(rows.filter("seq % 6 < 3")).ledgers
    return profile.classify_finals(prepared(rows.filter("seq % 6 >= 3")), ledgers, names=False).select("seq", "finality")


@query(
    _HALVES
    + """ SELECT f.event_id AS seq, CASE WHEN h.request_id IS NULL THEN 'new' WHEN f.i = h.i AND f.o = h.o AND f.r = h.r AND f.event_id % 8 <> 3 THEN 'identical' ELSE 'changed' END AS finality
FROM half f LEFT JOIN held h USING (session_id, request_id) WHERE NOT f.old"""
)
def classified_finals_with_names(spark, sf_dir):
    """Model and provider count too, as for the usage table."""
    rows = logs.transcript_samples(_transcripts(spark, sf_dir)).withColumn("model", F.when(F.col("seq") % 8 == 3, "mo2").otherwise(F.col("model")))
    ledgers = meter(rows.filter("seq % 6 < 3").withColumn("model", F.lit("mo"))).ledgers
    return profile.classify_finals(prepared(rows.filter("seq % 6 >= 3")), ledgers, names=True).select("seq", "finality")


#: Rows of a usage table from orders.
USAGE_COLUMNS = {
    "id": "CAST(o_orderkey AS VARCHAR(20))",
    "logical_request_id": "concat('l', CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS VARCHAR(20)))",
    "session_id": "concat('c', CAST(o_custkey AS VARCHAR(20)))",
    "turn_id": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('t', CAST(o_orderkey % 9 AS VARCHAR(20))) END",
    "provider_id": "'pr'",
    "model_id": "concat('mo', CAST(o_orderkey % 3 AS VARCHAR(20)))",
    "status": "CASE WHEN o_orderkey % 50 = 49 THEN 'running' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'error' ELSE 'cancelled' END",
    "started_at": "o_orderkey * 1000",
    "first_token_at": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey * 1000 + 500 END",
    "completed_at": "o_orderkey * 1000 + 900",
    "input_tokens": "o_orderkey % 1000 - 5",
    "output_tokens": "o_custkey % 500",
    "reasoning_tokens": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 10 END",
    "cache_creation_input_tokens": "o_orderkey % 3",
    "cache_read_input_tokens": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 100 END",
    "provider_total_tokens": "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey + 1 END",
    "computed_total_tokens": "o_orderkey + 2",
}
_USAGE_ROWS = "u AS (SELECT o_orderkey AS seq, " + ", ".join(f"{v} AS {k}" for k, v in USAGE_COLUMNS.items()) + " FROM orders), final AS (SELECT * FROM u WHERE status <> 'running')"
_H = "substr(sha256({}), 1, 16)"


def _usage_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(F.col("o_orderkey").alias("seq"), F.lit(0).cast("long").alias("observed_monotonic_ns"), *[F.expr(v).alias(k) for k, v in USAGE_COLUMNS.items()])


@query(
    f"""WITH {_USAGE_ROWS} SELECT seq, concat('zcode_session_', {_H.format('session_id')}) AS session_id, concat('zcode_request_', {_H.format('logical_request_id')}) AS request_id, concat('zcode_turn_', {_H.format('turn_id')}) AS turn_id,
  concat('zcode_row_', {_H.format('id')}) AS db_row_id, greatest(input_tokens, 0) AS raw_input_tokens, output_tokens AS raw_output_tokens, cache_read_input_tokens AS raw_cache_read_tokens, reasoning_tokens AS raw_reasoning_tokens,
  coalesce(provider_total_tokens, computed_total_tokens) AS raw_total_tokens, started_at AS request_start_ms, first_token_at AS first_token_ms, completed_at AS last_token_ms, model_id AS model, provider_id AS provider FROM final""".replace(
        f"concat('zcode_turn_', {_H.format('turn_id')})", f"'zcode_turn_' || {_H.format('turn_id')}"
    )
)
def usage_row_samples(spark, sf_dir):
    rows = logs.usage_row_samples(_usage_rows(spark, sf_dir))
    usage = [f"raw_usage.raw_{c}_tokens" for c in ("input", "output", "cache_read", "reasoning", "total")]
    return rows.select("seq", "session_id", "request_id", "turn_id", "native_identity.db_row_id", *usage, "timing.request_start_ms", "timing.first_token_ms", "timing.last_token_ms", "model", "provider")


@query(
    f"""WITH {_USAGE_ROWS}, l AS (SELECT session_id, logical_request_id, max(seq) AS seq FROM final GROUP BY ALL), f AS (SELECT u.* FROM u JOIN l USING (seq))
SELECT concat('zcode_session_', {_H.format('session_id')}) AS session_id, concat('zcode_request_', {_H.format('logical_request_id')}) AS request_key, model_id AS model, greatest(input_tokens, 0) AS canonical_context_input,
  greatest(greatest(input_tokens, 0) - coalesce(cache_read_input_tokens, 0), 0) AS canonical_fresh_input, output_tokens AS canonical_output FROM f"""
)
def usage_ledgers(spark, sf_dir):
    """Rows to ledgers: the last final row of each request, with its model."""
    return meter(logs.usage_row_samples(_usage_rows(spark, sf_dir))).ledgers.select("session_id", "request_key", "model", "canonical_context_input", "canonical_fresh_input", "canonical_output")


#: Samples whose identities, timings and accuracies take every branch.
_PICK = {
    "request_id": "CASE WHEN event_id % 6 = 0 THEN concat('q', CAST(event_id AS VARCHAR(20))) WHEN event_id % 6 = 1 THEN '' END",
    "turn_id": "CASE WHEN event_id % 6 = 1 THEN concat('t', CAST(event_id AS VARCHAR(20))) WHEN event_id % 6 = 2 THEN '' END",
    "response_id": "CASE WHEN event_id % 6 = 2 THEN concat('r', CAST(event_id AS VARCHAR(20))) END",
    "native_message_id": "CASE WHEN event_id % 6 = 3 THEN concat('m', CAST(event_id AS VARCHAR(20))) END",
    "file_path_hash": "CASE WHEN event_id % 6 = 4 THEN 'abc' END",
    "byte_offset": "CASE WHEN event_id % 12 < 8 THEN event_id END",
    "native_event_id": "CASE WHEN event_id % 5 = 0 THEN concat('e', CAST(event_id AS VARCHAR(20))) WHEN event_id % 5 = 1 THEN '' END",
    "db_row_id": "CASE WHEN event_id % 5 = 1 THEN concat('d', CAST(event_id AS VARCHAR(20))) END",
    "native_sequence_id": "CASE WHEN event_id % 5 = 2 THEN event_id END",
}
_PICKED = "x AS (SELECT event_id AS seq, concat('e', CAST(event_id AS VARCHAR(20))) AS sample_id, " + ", ".join(f"{v} AS {k}" for k, v in _PICK.items()) + " FROM events)"


def _picked(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.expr("concat('e', CAST(event_id AS VARCHAR(20)))").alias("sample_id"), *[F.expr(v).alias(k) for k, v in _PICK.items()])
    return rows.withColumn("native_identity", F.struct(*[k for k in _PICK if k not in ("request_id", "turn_id", "response_id")]))


@query(
    f"""WITH {_PICKED} SELECT seq, CASE seq % 6 WHEN 0 THEN request_id WHEN 1 THEN concat('turn_', turn_id) WHEN 2 THEN concat('resp_', response_id) WHEN 3 THEN concat('msg_', native_message_id) ELSE
  CASE WHEN seq % 12 = 4 THEN concat('file_abc_', seq) ELSE concat('sample_', sample_id) END END AS request_key,
  CASE seq % 6 WHEN 0 THEN 'explicit_request_id' WHEN 1 THEN 'turn_id' WHEN 2 THEN 'response_id' WHEN 3 THEN 'native_message_id' ELSE CASE WHEN seq % 12 = 4 THEN 'file_offset' ELSE 'fallback_sample_id' END END AS correlation_method,
  CASE WHEN seq % 6 = 0 THEN 'Exact' WHEN seq % 6 < 4 THEN 'Strong' WHEN seq % 12 = 4 THEN 'Weak' ELSE 'Unknown' END AS correlation_confidence FROM x"""
)
def correlate_every_branch(spark, sf_dir):
    return _picked(spark, sf_dir).withColumns(correlation()).select("seq", "request_key", "correlation_method", "correlation_confidence")


@query(
    f"""WITH {_PICKED} SELECT seq, CASE WHEN seq % 5 = 0 THEN concat('event_', native_event_id) WHEN seq % 5 = 1 THEN concat('row_', db_row_id) WHEN seq % 12 = 4 THEN concat('file_abc_', seq)
  WHEN seq % 5 = 2 THEN concat('seq_', seq) ELSE concat('sample_', sample_id) END AS stable_ingestion_id FROM x"""
)
def stable_id_every_branch(spark, sf_dir):
    return _picked(spark, sf_dir).select("seq", stable_id().alias("stable_ingestion_id"))


@query(
    """WITH x AS (SELECT event_id AS seq, event_id % 4 AS k, CAST(event_id % 900 AS DOUBLE) AS c FROM events)
SELECT seq, CASE k WHEN 0 THEN 'PrefillExact' WHEN 1 THEN 'EffectiveMeasured' ELSE 'Unavailable' END AS kind, CASE k WHEN 0 THEN c / 0.25 WHEN 1 THEN c / 0.5 END AS value FROM x"""
)
def input_rate_every_branch(spark, sf_dir):
    """Prefill times first, then the first token, unless their order is wrong or they are missing."""
    kind, ms = F.col("event_id") % 4, F.col("event_id") * 10
    start = F.when(kind == 0, ms).when(kind == 1, ms + 9)
    timing = F.struct(start.alias("prefill_start_ms"), F.when(kind == 0, ms + 250).when(kind == 1, ms).alias("prefill_end_ms"), ms.alias("request_start_ms"), F.when(kind < 2, ms + 500).when(kind == 2, ms).alias("first_token_ms"))
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), (F.col("event_id") % 900).alias("c"), timing.alias("timing"))
    return rows.select("seq", input_metric(F.col("c")).alias("m")).select("seq", "m.kind", "m.value")


@query("SELECT event_id AS seq, event_id % 2 = 0 AND event_id % 3 <> 1 AND event_id % 5 <> 0 AS eligible FROM events")
def live_eligible(spark, sf_dir):
    """Streamed, without a gap, and counted by the source rather than estimated from text."""
    i = F.col("event_id")
    rows = _events(spark, sf_dir).select(i.alias("seq"), F.when(i % 2 == 0, "StreamExact").otherwise("IntervalExact").alias("temporal_accuracy"), F.when(i % 3 == 1, "CatchUp").otherwise("Normal").alias("gap_state"), F.when(i % 5 == 0, "TokenizerEstimate").otherwise("StreamCounter").alias("measurement_kind"))
    return rows.select("seq", rates.live_eligible().alias("eligible"))


_RANKS = "CASE {} WHEN 'Estimated' THEN 1 WHEN 'TurnExact' THEN 2 WHEN 'IntervalExact' THEN 3 WHEN 'StreamExact' THEN 4 ELSE 0 END"
_NAMES = "['Unavailable', 'Estimated', 'TurnExact', 'IntervalExact', 'StreamExact']"


@query(
    f"""WITH x AS (SELECT event_id AS seq, CASE WHEN event_id % 7 < 5 THEN {_NAMES}[event_id % 7 + 1] WHEN event_id % 7 = 5 THEN 'Unheard' END AS a, {_NAMES}[CAST(floor(event_id / 7) AS BIGINT) % 5 + 1] AS b FROM events)
SELECT seq, {_NAMES}[least({_RANKS.format('a')}, {_RANKS.format('b')}) + 1] AS least, {_NAMES}[{_RANKS.format('a')} + 1] AS parsed FROM x"""
)
def accuracies(spark, sf_dir):
    """The lesser of two accuracies, and a stored name back as a member; unknown names and null are the lowest."""
    names = F.array(*[F.lit(n) for n in TEMPORAL_ACCURACY])
    i = F.col("event_id")
    a = F.when(i % 7 < 5, F.get(names, (i % 7).cast("int"))).when(i % 7 == 5, "Unheard")
    rows = _events(spark, sf_dir).select(i.alias("seq"), a.alias("a"), F.get(names, (F.floor(i / 7) % 5).cast("int")).alias("b"))
    return rows.select("seq", least_temporal(F.col("a"), F.col("b")).alias("least"), parsed(F.col("a"), TEMPORAL_ACCURACY).alias("parsed"))


@query(
    "WITH "
    + _prepared_sql("OpenAiStyle")
    + """, s AS (SELECT agent_id, seq, CASE temporal_accuracy WHEN 'TurnExact' THEN 2 WHEN 'IntervalExact' THEN 3 ELSE 4 END * 1000 + source_priority AS standing FROM prep)
SELECT seq, standing > lag(standing) OVER (PARTITION BY agent_id ORDER BY seq) AS better FROM s"""
)
def better_source(spark, sf_dir):
    """Whether a sample's source would be strictly better than the one of the agent's sample before."""
    from pyspark.sql import Window

    rows = fixture.samples(spark, sf_dir)
    return rows.select("seq", (standing() > F.lag(standing()).over(Window.partitionBy("agent_id").orderBy("seq"))).alias("better"))


def _cumulative_sql(strategy: str) -> str:
    has = {"context_input": "raw_input_tokens", "fresh_input": "raw_input_tokens", "output": "raw_output_tokens", "cache_read": "raw_cache_read_tokens", "cache_write": "raw_cache_write_tokens", "reasoning": "raw_reasoning_tokens"}
    both = " AND raw_cache_read_tokens IS NOT NULL AND raw_cache_write_tokens IS NOT NULL" if strategy == "AnthropicStyle" else ""
    columns = ", ".join(f"CASE WHEN event_kind <> 'Delta' AND {has[c]} IS NOT NULL{both if c == 'context_input' else ''} THEN {c} END AS cum_{c}" for c in COUNTERS)
    return f"WITH {_prepared_sql(strategy)} SELECT seq, {columns} FROM prep"


@query(_cumulative_sql("OpenAiStyle"))
def cumulative_positions(spark, sf_dir):
    return prepared(fixture.samples(spark, sf_dir)).select("seq", *[f"cum_{c}" for c in COUNTERS])


@query(_cumulative_sql("AnthropicStyle"))
def cumulative_positions_with_cache(spark, sf_dir):
    return prepared(fixture.samples(spark, sf_dir, "AnthropicStyle")).select("seq", *[f"cum_{c}" for c in COUNTERS])


@query("SELECT event_id AS seq, concat('corr_', substr(sha256(concat(event_type, '|', CAST(user_id AS VARCHAR), '|', '')), 1, 16)) AS id FROM events")
def derived_ids(spark, sf_dir):
    return _events(spark, sf_dir).select(F.col("event_id").alias("seq"), derived_id("corr_", F.col("event_type"), F.col("user_id"), F.lit(None)).alias("id"))


@query(
    """SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'StreamExact' WHEN 1 THEN 'IntervalExact' ELSE 'TurnExact' END AS temporal_accuracy, CASE event_id % 4 WHEN 0 THEN 'NativeCounter' WHEN 1 THEN 'SnapshotDelta' ELSE 'TurnAverage' END AS measurement_kind,
  event_id % 4 = 2 AS is_final, event_id * 10 - 800 AS first_token_ms, event_id + 3 AS raw_total_tokens, 'Mock' AS source_type FROM events"""
)
def synthetic(spark, sf_dir):
    i = F.col("event_id")
    kind = F.when(i % 4 == 0, "Delta").when(i % 4 == 1, "Snapshot").when(i % 4 == 2, "Final").otherwise("Replay")
    rows = synthetic_samples(_events(spark, sf_dir).select(i.alias("seq"), kind.alias("event_kind"), (i * 10).alias("wall_timestamp_ms"), i.alias("raw_input_tokens"), F.lit(3).alias("raw_output_tokens")))
    return rows.select("seq", "temporal_accuracy", "measurement_kind", "is_final", "timing.first_token_ms", "raw_usage.raw_total_tokens", "source_type")


@query("SELECT event_id FROM events WHERE user_id % 3 <> 0")
def untracked(spark, sf_dir):
    files = _events(spark, sf_dir).select("event_id", F.col("user_id").alias("file_hash"))
    return profile.untracked(files, files.filter("file_hash % 3 = 0")).select("event_id")


@query(_ORDERS + " SELECT id, completed_at FROM rows WHERE completed_at > 700000")
def after_boundary(spark, sf_dir):
    return profile.after_boundary(_orders(spark, sf_dir), 700_000).select("id", "completed_at")


@query(_ORDERS + " SELECT count(*) AS rows, max(completed_at) FILTER (status IN ('completed', 'error', 'cancelled')) AS last_completed FROM rows")
def table_state(spark, sf_dir):
    return profile.table_state(_orders(spark, sf_dir))


@query("SELECT event_type AS path, count(*) AS n FROM events WHERE contains(props, '1') GROUP BY event_type")
def lines_containing(spark, sf_dir):
    return profile.lines_containing(_events(spark, sf_dir), "1", value="props", by="event_type").withColumnRenamed("event_type", "path")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5")
def last_lines(spark, sf_dir):
    return profile.last_lines(_events(spark, sf_dir), "user_id", "event_id", 5).select("user_id", "event_id")


@query(_ORDERS + " SELECT id FROM (SELECT *, status = 'cancelled' AS good FROM rows) ORDER BY good DESC, completed_at DESC, id DESC LIMIT 1")
def newest_with(spark, sf_dir):
    """The newest file that satisfies a predicate."""
    files = _orders(spark, sf_dir).withColumn("modification_time", F.col("completed_at")).withColumn("path", F.col("id"))
    return profile.newest(files, F.col("status") == "cancelled").select("id")


@query(_ORDERS + " SELECT row_number() OVER (ORDER BY modified, id) AS nth, id FROM (SELECT id, completed_at % 977 AS modified FROM rows WHERE id <= 500)")
def files_by_age(spark, sf_dir):
    """Oldest first; the position is that of the ordered result."""
    files = _orders(spark, sf_dir).filter("id <= 500").select((F.col("completed_at") % 977).alias("modification_time"), F.col("id").alias("path"))
    ordered = logs.by_age(files).coalesce(1)
    return ordered.select((F.monotonically_increasing_id() + 1).alias("nth"), F.col("path").alias("id"))


@query("SELECT DISTINCT o_custkey AS session_id FROM orders")
def distinct_sessions(spark, sf_dir):
    return _orders(spark, sf_dir).select("session_id").distinct()


@query(
    """WITH p AS (SELECT event_type AS source, event_id AS poll, event_id % 4 AS tracked, event_id % 3 AS available, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS failures, CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END AS unknown, event_id % 9 AS consumed FROM events)
SELECT source, max_by(tracked, poll) AS tracked_sources, max_by(available > 0, poll) AS source_available, max_by(failures > 0 OR unknown > 0, poll) AS source_degraded, max_by(CASE WHEN failures > 0 THEN 'SourceUnavailable' ELSE 'None' END, poll) AS last_error_kind,
  max(poll * 10) FILTER (available > 0 AND failures = 0 AND unknown = 0) AS last_successful_poll_ms, CAST(sum(consumed) AS BIGINT) AS consumed FROM p GROUP BY source"""
)
def health(spark, sf_dir):
    i = F.col("event_id")
    polls = _events(spark, sf_dir).select(F.col("event_type").alias("source"), i.alias("poll"), (i % 4).alias("tracked"), (i % 3).alias("available"), F.when(i % 5 == 0, 1).otherwise(0).alias("failures"), F.when(i % 7 == 0, 2).otherwise(0).alias("unknown_status"), (i % 9).alias("consumed"), (i * 10).alias("wall_ms"))
    return profile.health(polls)


@query("WITH " + _prepared_sql("OpenAiStyle") + f" SELECT seq, {_all('CAST({c} - lag({c}) OVER (PARTITION BY agent_id ORDER BY seq) AS BIGINT) AS step_{c}')} FROM prep WHERE event_kind = 'Snapshot'".replace("CAST(", "greatest(CAST(").replace(" AS BIGINT)", " AS BIGINT), 0)"))
def saturated_steps(spark, sf_dir):
    """Differences that never fall below zero."""
    from pyspark.sql import Window

    from meterlake.functions.usage import monotonic_delta

    before = Window.partitionBy("agent_id").orderBy("seq")
    rows = prepared(fixture.samples(spark, sf_dir)).filter("event_kind = 'Snapshot'")
    return rows.select("seq", *[F.when(F.lag(c).over(before).isNotNull(), monotonic_delta(F.col(c), F.lag(c).over(before))).otherwise(F.lit(0).cast("long")).alias(f"step_{c}") for c in COUNTERS])


@query("WITH " + _prepared_sql("OpenAiStyle") + " SELECT count(*) AS n FROM prep WHERE event_kind <> 'Final'")
def unfinished_samples(spark, sf_dir):
    """Every sample that is not final meets the counters once."""
    return counters.counter_deltas(prepared(fixture.samples(spark, sf_dir)).filter("event_kind <> 'Final'")).agg(F.count(F.lit(1)).alias("n"))
