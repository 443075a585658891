"""One query for each operator, over whole tables, and the SQL to check it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.schema import COUNTERS
from meterlake.functions.usage import hash16, input_metric, path_hash, prefixed, prepared
from meterlake.operators import counters, profile, rates, reconcile
from meterlake.plans import fixture
from meterlake.plans.engine import meter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
REQUEST = "agent_id, session_id, request_key"
EVENT_KEYS = ["seq", "agent_id", "session_id", "request_key", "source_adapter_id"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _prepared_sql(strategy: str) -> str:
    z = lambda c: f"coalesce(raw_{c}_tokens, 0)"
    context, fresh, out = z("input"), f"greatest({z('input')} - {z('cache_read')}, 0)", z("output")
    if strategy == "AnthropicStyle":
        context, fresh = f"{z('input')} + {z('cache_read')} + {z('cache_write')}", z("input")
    if strategy == "GenericStyle":
        out = f"{z('output')} + {z('reasoning')}"
    return f"""samples AS ({fixture.SQL}),
prep AS (SELECT *, {context} AS context_input, {fresh} AS fresh_input, {out} AS output, {z('cache_read')} AS cache_read,
  {z('cache_write')} AS cache_write, {z('reasoning')} AS reasoning, {context} + {out} AS total,
  CASE WHEN request_id IS NOT NULL THEN request_id WHEN turn_id IS NOT NULL THEN concat('turn_', turn_id) ELSE concat('sample_', sample_id) END AS request_key,
  CASE WHEN request_id IS NOT NULL THEN 'explicit_request_id' WHEN turn_id IS NOT NULL THEN 'turn_id' ELSE 'fallback_sample_id' END AS correlation_method,
  CASE WHEN request_id IS NOT NULL THEN 'Exact' WHEN turn_id IS NOT NULL THEN 'Strong' ELSE 'Unknown' END AS correlation_confidence,
  CASE WHEN native_event_id IS NOT NULL THEN concat('event_', native_event_id) WHEN db_row_id IS NOT NULL THEN concat('row_', db_row_id) ELSE concat('sample_', sample_id) END AS stable_ingestion_id
  FROM samples)"""


def _all(template: str, sep: str = ", ") -> str:
    return sep.join(template.format(c=c) for c in COUNTERS)


PREP = "WITH " + _prepared_sql("OpenAiStyle")
STATE = f"{REQUEST}, source_adapter_id, native"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
DELTAS = (
    PREP
    + f""",
d1 AS (SELECT *, event_kind = 'Delta' AS native FROM prep WHERE event_kind <> 'Final'),
d2 AS (SELECT *, row_number() OVER (PARTITION BY {STATE} ORDER BY seq) AS rn FROM d1),
d3 AS (SELECT *, sum(CASE WHEN counter_reset_hint AND rn > 1 AND NOT native THEN 1 ELSE 0 END) OVER (PARTITION BY {STATE} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS epoch FROM d2),
d4 AS (SELECT *, NOT native AND coalesce(output < max(output) OVER (PARTITION BY {STATE}, epoch ORDER BY seq {BEFORE}), FALSE) AS late FROM d3),
d5 AS (SELECT *, {_all('max(CASE WHEN NOT late THEN {c} END) OVER w AS last_{c}')} FROM d4 WINDOW w AS (PARTITION BY {STATE}, epoch ORDER BY seq {BEFORE})),
d6 AS (SELECT *, {_all('CAST(CASE WHEN native THEN {c} WHEN late THEN 0 WHEN last_output IS NULL THEN {c} ELSE greatest({c} - last_{c}, 0) END AS BIGINT) AS delta_{c}')},
  lag(observed_monotonic_ns) OVER (PARTITION BY {REQUEST}, source_adapter_id, collector_run_id, late ORDER BY seq) AS last_ns FROM d5),
d7 AS (SELECT *, CASE WHEN late THEN NULL WHEN observed_monotonic_ns < last_ns THEN 'Stale' WHEN observed_monotonic_ns - last_ns > 3000000000 THEN 'CatchUp' ELSE 'Normal' END AS gap_state FROM d6),
d8 AS (SELECT *, CASE WHEN gap_state = 'Stale' THEN 'Unavailable' WHEN gap_state = 'CatchUp' AND temporal_accuracy = 'StreamExact' THEN 'IntervalExact' ELSE temporal_accuracy END AS lowered FROM d7),
live AS (SELECT * FROM d8 WHERE NOT late AND greatest({_all('delta_{c}')}) > 0),
nth AS (SELECT *, row_number() OVER (PARTITION BY source_adapter_id, stable_ingestion_id ORDER BY seq) AS n FROM live),
firsts AS (SELECT * EXCLUDE (n) FROM nth WHERE n = 1)"""
)
_CARRIED = "collector_run_id, observed_monotonic_ns, source_priority"


def _events_sql(deltas: str, table: str) -> str:
    return (
        deltas
        + f""",
e1 AS (SELECT seq, {REQUEST}, source_adapter_id, FALSE AS final, {_CARRIED}, gap_state, lowered AS temporal_accuracy, {_all('delta_{c} AS {c}')} FROM {table}
  UNION ALL SELECT seq, {REQUEST}, source_adapter_id, TRUE, {_CARRIED}, NULL, temporal_accuracy, {_all('{c}')} FROM prep WHERE event_kind = 'Final'),
e2 AS (SELECT *, NOT final AND coalesce(bool_or(final) OVER w, FALSE) AS rejected FROM e1 WINDOW w AS (PARTITION BY {REQUEST} ORDER BY seq {BEFORE})),
e3 AS (SELECT *, {_all('coalesce(sum(CASE WHEN NOT final AND NOT rejected THEN {c} END) OVER w, 0) AS live_{c}')},
  {_all('last_value(CASE WHEN final THEN {c} END IGNORE NULLS) OVER w AS prev_{c}')},
  last_value(CASE WHEN NOT rejected THEN source_adapter_id END IGNORE NULLS) OVER w AS prev_source
  FROM e2 WINDOW w AS (PARTITION BY {REQUEST} ORDER BY seq {BEFORE}))"""
    )


EVENTS = _events_sql(DELTAS, "firsts")
_RAW = dict(zip(COUNTERS, ("input", "input", "output", "cache_read", "cache_write", "reasoning"), strict=True))
_SAME_REQUEST = " AND ".join(f"m.{k} = f.{k}" for k in REQUEST.split(", "))
_KEPT = f"seq, {REQUEST}, source_adapter_id, event_kind, {_CARRIED}, gap_state, lowered"
#: The election, row by row in a recursive query: `held` is what the active source has contributed so far.
ELECTED = (
    DELTAS.replace("WITH", "WITH RECURSIVE", 1)
    + f""",
sure AS (SELECT *, CASE WHEN correlation_confidence IN ('Strong', 'Exact') THEN source_adapter_id END AS s FROM firsts),
spread AS (SELECT *, s IS NOT NULL AND coalesce(min(s) OVER w <> max(s) OVER w, FALSE) AS contested FROM sure WINDOW w AS (PARTITION BY {REQUEST})),
many AS MATERIALIZED (SELECT *, CASE lowered WHEN 'StreamExact' THEN 4 WHEN 'IntervalExact' THEN 3 WHEN 'TurnExact' THEN 2 WHEN 'Estimated' THEN 1 ELSE 0 END * 1000 + source_priority AS standing,
  row_number() OVER (PARTITION BY {REQUEST} ORDER BY seq) AS nth, {', '.join(f"CASE WHEN event_kind <> 'Delta' AND raw_{r}_tokens IS NOT NULL THEN {c} END AS cum_{c}" for c, r in _RAW.items())} FROM spread WHERE contested),
fold AS (SELECT {REQUEST}, nth, source_adapter_id AS active, standing AS rank, TRUE AS counts, {_all('delta_{c} AS held_{c}')}, {_all('delta_{c} AS new_{c}')} FROM many WHERE nth = 1
  UNION ALL
  SELECT {REQUEST}, nth, CASE WHEN takes THEN source_adapter_id ELSE active END, CASE WHEN takes THEN standing ELSE rank END, own OR takes,
    {_all('held_{c} + CASE WHEN takes THEN coalesce(cum_{c} - held_{c}, 0) WHEN own THEN delta_{c} ELSE 0 END')}, {_all('CASE WHEN takes THEN coalesce(cum_{c} - held_{c}, 0) ELSE delta_{c} END')}
  FROM (SELECT m.*, f.active, f.rank, {_all('f.held_{c}')}, m.source_adapter_id = f.active AS own,
    m.source_adapter_id <> f.active AND m.standing > f.rank AND {_all('(f.held_{c} <= 0 OR coalesce(m.cum_{c} >= f.held_{c}, FALSE))', ' AND ')} AS takes
    FROM fold f JOIN many m ON {_SAME_REQUEST} AND m.nth = f.nth + 1)),
elected AS (SELECT {_KEPT}, {_all('delta_{c}')} FROM spread WHERE NOT contested
  UNION ALL SELECT {_KEPT}, {_all('CAST(new_{c} AS BIGINT)')} FROM many JOIN fold USING ({REQUEST}, nth) WHERE counts)"""
)
ENGINE = _events_sql(ELECTED, "elected")


def _live(spark, sf_dir):
    return counters.live_deltas(prepared(fixture.samples(spark, sf_dir)))


def _events(spark, sf_dir):
    rows = prepared(fixture.samples(spark, sf_dir))
    return reconcile.events(reconcile.dedup_first(counters.live_deltas(rows)), rows)


for _name, _strategy in (("normalize_openai", "OpenAiStyle"), ("normalize_anthropic", "AnthropicStyle"), ("normalize_generic", "GenericStyle")):

    def _normalize(spark, sf_dir, strategy=_strategy):
        return prepared(fixture.samples(spark, sf_dir, strategy)).select("seq", *COUNTERS, "total")

    QUERIES[_name] = _normalize
    ORACLES[_name] = f"WITH {_prepared_sql(_strategy)} SELECT seq, {_all('{c}')}, total FROM prep"


@query(PREP + " SELECT seq, agent_id, session_id, request_key, correlation_method, correlation_confidence FROM prep")
def correlate(spark, sf_dir):
    return prepared(fixture.samples(spark, sf_dir)).select("seq", "agent_id", "session_id", "request_key", "correlation_method", "correlation_confidence")


@query(PREP + " SELECT seq, stable_ingestion_id FROM prep")
def stable_id(spark, sf_dir):
    return prepared(fixture.samples(spark, sf_dir)).select("seq", "stable_ingestion_id")


@query(DELTAS + f" SELECT seq, {REQUEST}, source_adapter_id, late, {_all('delta_{c}')} FROM d7")
def counter_delta(spark, sf_dir):
    rows = counters.counter_deltas(prepared(fixture.samples(spark, sf_dir)).filter("event_kind <> 'Final'"))
    return rows.select(*EVENT_KEYS, "late", *[f"delta_{c}" for c in COUNTERS])


@query(DELTAS + " SELECT seq, gap_state FROM d7 WHERE NOT late")
def gap_state(spark, sf_dir):
    rows = counters.counter_deltas(prepared(fixture.samples(spark, sf_dir)).filter("event_kind <> 'Final'"))
    return counters.with_gaps(rows).filter("not late").select("seq", "gap_state")


@query(DELTAS + f" SELECT {REQUEST}, source_adapter_id, count(*) AS late FROM d7 WHERE late GROUP BY ALL")
def late_samples(spark, sf_dir):
    rows = counters.counter_deltas(prepared(fixture.samples(spark, sf_dir)).filter("event_kind <> 'Final'"))
    return rows.filter("late").groupBy("agent_id", "session_id", "request_key", "source_adapter_id").agg(F.count(F.lit(1)).alias("late"))


@query(DELTAS + f" SELECT seq, source_adapter_id, stable_ingestion_id, {_all('delta_{c}')} FROM firsts")
def dedup_first(spark, sf_dir):
    return reconcile.dedup_first(_live(spark, sf_dir)).select("seq", "source_adapter_id", "stable_ingestion_id", *[f"delta_{c}" for c in COUNTERS])


@query(ELECTED + f" SELECT seq, {REQUEST}, source_adapter_id, {_all('delta_{c}')}, delta_context_input + delta_output AS delta_total FROM elected")
def handoff(spark, sf_dir):
    return reconcile.elect_sources(reconcile.dedup_first(_live(spark, sf_dir))).select(*EVENT_KEYS, *[f"delta_{c}" for c in COUNTERS], "delta_total")


@query(EVENTS + " SELECT seq, CASE WHEN rejected THEN 'Rejected' ELSE 'Committed' END AS outcome, CASE WHEN rejected THEN 'request_finalized_late_event' END AS reason FROM e3")
def finalized_gate(spark, sf_dir):
    return reconcile.outcomes(_events(spark, sf_dir)).select("seq", "outcome", "reason")


_HELD = {c: f"coalesce(prev_{c}, live_{c})" for c in COUNTERS}


@query(
    EVENTS
    + f""" SELECT seq, {REQUEST}, {', '.join(f'CAST({c} - {h} AS BIGINT) AS {c}_correction' for c, h in _HELD.items())},
  coalesce(prev_source, source_adapter_id) AS old_source, source_adapter_id AS new_authoritative_source,
  CAST({_HELD['context_input']} + {_HELD['output']} AS BIGINT) AS old_total, context_input + output AS new_total
  FROM e3 WHERE final AND ({' OR '.join(f'{c} <> {h}' for c, h in _HELD.items())})"""
)
def corrections(spark, sf_dir):
    return reconcile.corrections(_events(spark, sf_dir)).select("seq", "agent_id", "session_id", "request_key", *[f"{c}_correction" for c in COUNTERS], "old_source", "new_authoritative_source", "old_total", "new_total")


def _ledger_sql(events: str) -> str:
    return (
        events
        + f""",
l1 AS (SELECT {REQUEST}, {_all('CAST(coalesce(sum(CASE WHEN NOT final THEN {c} END), 0) AS BIGINT) AS live_contributed_{c}')},
  {_all('max_by({c}, seq) FILTER (final) AS authoritative_final_{c}')}, bool_or(final) AS is_finalized, max_by(source_adapter_id, seq) AS winning_source,
  coalesce(max_by(source_priority, seq) FILTER (NOT final), min_by(source_priority, seq)) AS active_live_source_priority,
  coalesce(max_by(temporal_accuracy, seq) FILTER (NOT final), min_by(temporal_accuracy, seq)) AS active_live_temporal_accuracy
  FROM e3 WHERE NOT rejected GROUP BY {REQUEST}),
ledger AS (SELECT *, {_all('coalesce(authoritative_final_{c}, live_contributed_{c}) AS canonical_{c}')} FROM l1)"""
    )


LEDGER = _ledger_sql(EVENTS)


@query(LEDGER + f" SELECT {REQUEST}, {_all('canonical_{c}')}, {_all('live_contributed_{c}')}, {_all('authoritative_final_{c}')}, is_finalized, winning_source FROM ledger")
def ledger(spark, sf_dir):
    out = reconcile.ledgers(_events(spark, sf_dir))
    return out.select("agent_id", "session_id", "request_key", *[f"{p}_{c}" for p in ("canonical", "live_contributed", "authoritative_final") for c in COUNTERS], "is_finalized", "winning_source")


@query(LEDGER + " SELECT agent_id, CAST(coalesce(sum(canonical_output), 0) AS BIGINT) AS total_output_tokens FROM ledger GROUP BY agent_id")
def agent_totals(spark, sf_dir):
    return reconcile.agent_totals(reconcile.ledgers(_events(spark, sf_dir)))


@query(LEDGER + " SELECT CAST(coalesce(sum(canonical_output), 0) AS BIGINT) AS total_output_tokens FROM ledger")
def total_output(spark, sf_dir):
    return reconcile.total_output(reconcile.ledgers(_events(spark, sf_dir)))


@query(
    _ledger_sql(ENGINE)
    + f""" SELECT {REQUEST}, 'm1' AS model, 'p1' AS provider, {_all('canonical_{c}')}, {_all('live_contributed_{c}')}, {_all('authoritative_final_{c}')}, winning_source,
  active_live_source_priority, 'Exact' AS active_live_token_accuracy, active_live_temporal_accuracy, is_finalized, 1 AS normalization_version FROM ledger"""
)
def engine_ledger(spark, sf_dir):
    """The whole engine, election included."""
    return meter(fixture.samples(spark, sf_dir)).ledgers.drop("last_reconciled_at_ms")


@query(_ledger_sql(ENGINE) + f" SELECT {REQUEST}, canonical_output FROM ledger WHERE agent_id = 'agent_1' AND session_id = 's1' AND request_key = 'q2'")
def ledger_lookup(spark, sf_dir):
    return meter(fixture.samples(spark, sf_dir)).ledger_of("agent_1", "s1", "q2").select("agent_id", "session_id", "request_key", "canonical_output")


@query(ENGINE + f", done AS (SELECT DISTINCT {REQUEST} FROM e3 WHERE final) SELECT p.seq, p.agent_id, p.session_id, p.request_key FROM prep p SEMI JOIN done USING ({REQUEST})")
def late_after_final(spark, sf_dir):
    """Samples of requests that have a final, against the engine's own ledgers."""
    rows = prepared(fixture.samples(spark, sf_dir))
    ledgers = meter(fixture.samples(spark, sf_dir)).ledgers
    return profile.late_after_final(rows, ledgers).select("seq", "agent_id", "session_id", "request_key")


RATES = (
    DELTAS
    + """,
r1 AS (SELECT *, CASE WHEN gap_state = 'Normal' AND temporal_accuracy = 'StreamExact' THEN delta_output END AS o,
  CASE WHEN gap_state = 'Normal' AND temporal_accuracy = 'StreamExact' THEN observed_monotonic_ns END AS t FROM firsts),
r2 AS (SELECT *, CAST(coalesce(sum(o) OVER (PARTITION BY collector_run_id, agent_id ORDER BY observed_monotonic_ns RANGE BETWEEN 1000000000 PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS out_1s,
  CAST(coalesce(sum(o) OVER w, 0) AS BIGINT) AS out_5s, min(t) OVER w AS oldest
  FROM r1 WINDOW w AS (PARTITION BY collector_run_id, agent_id ORDER BY observed_monotonic_ns RANGE BETWEEN 5000000000 PRECEDING AND CURRENT ROW))"""
)


@query(RATES + " SELECT seq, agent_id, out_1s FROM r2")
def out_tps_1s(spark, sf_dir):
    return rates.event_rates(reconcile.dedup_first(_live(spark, sf_dir))).select("seq", "agent_id", "out_1s")


@query(RATES + " SELECT seq, agent_id, CAST(out_5s AS DOUBLE) / greatest(CAST(observed_monotonic_ns - coalesce(oldest, observed_monotonic_ns) AS DOUBLE) / 1e9, 1.0) AS avg_5s FROM r2")
def out_tps_5s_avg(spark, sf_dir):
    return rates.event_rates(reconcile.dedup_first(_live(spark, sf_dir))).select("seq", "agent_id", "avg_5s")


@query(DELTAS + " SELECT seq, CASE WHEN seq % 3 = 0 THEN 'EffectiveMeasured' ELSE 'Unavailable' END AS kind, CASE WHEN seq % 3 = 0 THEN CAST(delta_context_input AS DOUBLE) / 0.4 END AS in_tps FROM firsts")
def in_tps(spark, sf_dir):
    rows = reconcile.dedup_first(_live(spark, sf_dir)).withColumn("m", input_metric(F.col("delta_context_input")))
    return rows.select("seq", F.col("m.kind").alias("kind"), F.col("m.value").alias("in_tps"))


#: An instant of query after each 40 samples; a push dies with the next one of another run or one more than 5 s later.
TICKS = (
    ENGINE
    + """,
ticks AS (SELECT CAST(seq / 40 AS BIGINT) AS tick, seq AS tick_seq, collector_run_id AS tick_run, observed_monotonic_ns AS now_ns FROM prep WHERE seq % 40 = 0),
first AS (SELECT agent_id, min(seq) AS first FROM prep GROUP BY agent_id),
instant AS (SELECT agent_id, tick, tick_seq, tick_run, now_ns FROM ticks JOIN first ON first <= tick_seq),
good AS (SELECT * FROM e3 WHERE NOT rejected),
push AS (SELECT agent_id, seq, collector_run_id AS run, observed_monotonic_ns AS ns, output, temporal_accuracy = 'StreamExact' AND gap_state = 'Normal' AS eligible FROM good WHERE NOT final),
death AS (SELECT p.agent_id, p.seq, min(q.seq) AS death FROM push p JOIN push q ON q.agent_id = p.agent_id AND q.seq > p.seq AND (q.run <> p.run OR q.ns - p.ns > 5000000000) GROUP BY p.agent_id, p.seq),
alive AS (SELECT a.agent_id, a.tick, a.now_ns, p.ns, p.output FROM instant a JOIN push p ON p.agent_id = a.agent_id AND p.seq <= a.tick_seq AND p.run = a.tick_run AND p.eligible AND p.seq > a.tick_seq - 1000
  LEFT JOIN death d ON d.agent_id = p.agent_id AND d.seq = p.seq WHERE d.death IS NULL OR d.death > a.tick_seq),
rates AS (SELECT agent_id, tick, CAST(coalesce(sum(output) FILTER (greatest(now_ns - ns, 0) <= 1000000000), 0) AS DOUBLE) AS out_tps,
  CAST(sum(output) AS DOUBLE) / greatest(greatest(max(now_ns) - min(ns), 0) / 1e9, 1.0) AS avg_5s_out_tps FROM alive GROUP BY agent_id, tick),
fact AS (SELECT agent_id, seq, collector_run_id AS run, observed_monotonic_ns AS ns, CAST(context_input AS DOUBLE) / 0.4 AS in_value FROM good WHERE seq % 3 = 0),
span AS (SELECT agent_id, seq, output AS interval_tokens, CASE WHEN seq % 2 = 0 THEN 1.5 END AS interval_seconds, CASE WHEN seq % 2 = 0 THEN CAST(output AS DOUBLE) / 1.5 END AS interval_tps
  FROM good WHERE NOT final AND temporal_accuracy = 'IntervalExact' AND output > 0),
m AS (SELECT a.*, f.run, f.ns, f.in_value FROM instant a ASOF LEFT JOIN fact f ON a.agent_id = f.agent_id AND a.tick_seq >= f.seq),
i AS (SELECT m.*, s.interval_tokens, s.interval_seconds, s.interval_tps FROM m ASOF LEFT JOIN span s ON m.agent_id = s.agent_id AND m.tick_seq >= s.seq),
tps AS (SELECT i.agent_id, i.tick, coalesce(r.out_tps, 0) AS out_tps, coalesce(r.avg_5s_out_tps, 0) AS avg_5s_out_tps,
  CASE WHEN run = tick_run AND greatest(now_ns - ns, 0) <= 1000000000 THEN in_value END AS in_tps, interval_tokens, CAST(interval_seconds AS DOUBLE) AS interval_seconds, interval_tps
  FROM i LEFT JOIN rates r ON r.agent_id = i.agent_id AND r.tick = i.tick)"""
)


@query(
    TICKS
    + """ SELECT agent_id, tick, out_tps, avg_5s_out_tps, max(out_tps) OVER (PARTITION BY agent_id ORDER BY tick) AS peak_out_tps, in_tps,
  CASE WHEN in_tps IS NULL THEN 'Unavailable' ELSE 'EffectiveMeasured' END AS in_kind, interval_tokens, interval_seconds, interval_tps FROM tps"""
)
def agent_tps(spark, sf_dir):
    rows = fixture.samples(spark, sf_dir)
    return meter(rows).kept().agent_tps(ticks(rows))


@query(TICKS + " SELECT agent_id, max(out_tps) AS peak_out_tps FROM tps GROUP BY agent_id")
def agent_peak(spark, sf_dir):
    rows = fixture.samples(spark, sf_dir)
    last = meter(rows).kept().agent_tps(ticks(rows)).groupBy("agent_id").agg(F.max_by("peak_out_tps", "tick").alias("peak_out_tps"))
    return last.select("agent_id", "peak_out_tps")


@query(TICKS + " SELECT agent_id, interval_tokens AS tokens, interval_seconds AS seconds, interval_tps AS tps FROM tps WHERE tick = (SELECT max(tick) FROM ticks)")
def interval_avg(spark, sf_dir):
    """Each agent's last interval at the last tick."""
    rows = fixture.samples(spark, sf_dir)
    last = meter(rows).kept().agent_tps(ticks(rows)).groupBy("agent_id").agg(F.max_by(F.struct("interval_tokens", "interval_seconds", "interval_tps"), "tick").alias("i"))
    return last.select("agent_id", F.col("i.interval_tokens").alias("tokens"), F.col("i.interval_seconds").alias("seconds"), F.col("i.interval_tps").alias("tps"))


def ticks(samples: DataFrame, every: int = 40) -> DataFrame:
    """An instant of query after each `every` samples."""
    at = samples.filter(F.col("seq") % every == 0)
    return at.select(F.floor(F.col("seq") / every).alias("tick"), F.col("seq").alias("tick_seq"), "collector_run_id", F.col("observed_monotonic_ns").alias("now_ns"))


@query(
    TICKS
    + """, g AS (SELECT tick, sum(out_tps) AS global_out_tps, sum(in_tps) AS global_in_tps, count(in_tps) AS in_coverage_measured, count(*) AS in_coverage_total,
  count(*) FILTER (out_tps > 0) AS generating_agents, CAST(0 AS BIGINT) AS working_agents FROM tps GROUP BY tick)
SELECT *, max(global_out_tps) OVER (ORDER BY tick) AS peak_out_tps FROM g"""
)
def global_metrics(spark, sf_dir):
    rows = fixture.samples(spark, sf_dir)
    return meter(rows).kept().global_metrics(ticks(rows))


_STATUS = ("agent_id", "agent_name", "model", "provider", "session_id", "source_adapter_id", "event_kind", "wall_timestamp_ms", "observed_monotonic_ns")


@query(
    "WITH "
    + _prepared_sql("OpenAiStyle")
    + """ SELECT agent_id, agent_id AS agent_name, 'm1' AS model, 'p1' AS provider, max_by(session_id, seq) AS session_id, max_by(source_adapter_id, seq) AS source_adapter_id,
  max_by(event_kind, seq) AS event_kind, max(seq) * 250 AS wall_timestamp_ms, max_by(observed_monotonic_ns, seq) AS observed_monotonic_ns FROM prep GROUP BY agent_id"""
)
def agent_status(spark, sf_dir):
    return rates.agent_status(fixture.samples(spark, sf_dir)).select(*_STATUS)


@query(
    TICKS
    + """, s AS (SELECT agent_id, max_by(session_id, seq) AS session_id FROM prep GROUP BY agent_id)
SELECT s.agent_id, s.session_id, t.out_tps, t.avg_5s_out_tps, t.in_tps FROM s LEFT JOIN (SELECT * FROM tps WHERE tick = (SELECT max(tick) FROM ticks)) t USING (agent_id)"""
)
def status_with_rates(spark, sf_dir):
    """Agents with their rates at the last instant of query."""
    rows = fixture.samples(spark, sf_dir)
    last = ticks(rows).orderBy(F.desc("tick")).limit(1)
    return rates.status_with_rates(rates.agent_status(rows), meter(rows).kept().agent_tps(last)).select("agent_id", "session_id", "out_tps", "avg_5s_out_tps", "in_tps")


def _orders(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderkey") % 5000 == 4999, "future").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "error").otherwise("cancelled")
    return rows.select(F.col("o_orderkey").alias("id"), status.alias("status"), (F.col("o_orderkey") * 1000).alias("completed_at"), F.col("o_custkey").alias("session_id"))


_ORDERS = """WITH rows AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5000 = 4999 THEN 'future' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'error' ELSE 'cancelled' END AS status,
  o_orderkey * 1000 AS completed_at, o_custkey AS session_id FROM orders)"""


@query(_ORDERS + " SELECT id, status, completed_at FROM rows WHERE (completed_at, id) < (SELECT (completed_at, id) FROM rows WHERE status = 'future' ORDER BY completed_at, id LIMIT 1) OR NOT EXISTS (SELECT 1 FROM rows WHERE status = 'future')")
def status_barrier(spark, sf_dir):
    return profile.status_barrier(_orders(spark, sf_dir)).select("id", "status", "completed_at")


@query(_ORDERS + " SELECT id, status, completed_at FROM rows WHERE completed_at >= (SELECT max(completed_at) FROM rows WHERE status IN ('completed', 'error', 'cancelled')) - 600000")
def watermark_lookback(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    mark = profile.max_completed(rows).first()[0]
    return profile.watermark_lookback(rows, mark).select("id", "status", "completed_at")


@query(_ORDERS + " SELECT max(completed_at) AS max_completed_at FROM rows WHERE status IN ('completed', 'error', 'cancelled')")
def max_completed(spark, sf_dir):
    return profile.max_completed(_orders(spark, sf_dir))


@query(_ORDERS + " SELECT status, count(*) AS n FROM rows GROUP BY status")
def status_counts(spark, sf_dir):
    return profile.status_counts(_orders(spark, sf_dir))


@query(_ORDERS + " SELECT id, status, completed_at FROM rows ORDER BY completed_at DESC, id DESC LIMIT 1")
def latest_file(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumn("modification_time", F.col("completed_at")).withColumn("path", F.col("id"))
    return profile.newest(rows).select("id", "status", "completed_at")


@query("SELECT user_id AS source_id, event_id, value IS NOT NULL AND event_id % 2 = 0 AS has_checkpoint, CASE WHEN event_id % 2 = 0 THEN event_id * 10 END AS byte_offset FROM events")
def checkpoint_left_join(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("source_id"), F.col("user_id"))
    marks = files.filter("source_id % 2 = 0").select("source_id", (F.col("source_id") * 10).alias("byte_offset"))
    out = profile.with_checkpoint(files, marks)
    return out.select(F.col("user_id").alias("source_id"), F.col("source_id").alias("event_id"), F.col("byte_offset").isNotNull().alias("has_checkpoint"), "byte_offset")


_USAGE = "WITH " + _prepared_sql("OpenAiStyle")


@query(
    _USAGE
    + """ SELECT count(*) AS rows, count(DISTINCT request_id) AS requests, count(DISTINCT session_id) AS sessions, count(DISTINCT agent_id) AS models, count(raw_input_tokens) AS with_input,
  count(raw_output_tokens) AS with_output, count(*) FILTER (raw_cache_read_tokens IS NOT NULL OR raw_cache_write_tokens IS NOT NULL) AS with_cache, count(raw_reasoning_tokens) AS with_reasoning, 0 AS with_ttft,
  bool_and(coalesce(raw_input_tokens >= raw_cache_read_tokens, TRUE)) AS input_covers_cache, bool_and(coalesce(raw_reasoning_tokens <= raw_output_tokens, TRUE)) AS output_covers_reasoning FROM prep"""
)
def profile_counts(spark, sf_dir):
    rows = fixture.samples(spark, sf_dir)
    u = lambda c: F.col(f"raw_usage.raw_{c}_tokens")
    return profile.usage_profile(
        rows.select(
            F.col("request_id").alias("logical_request_id"),
            "session_id",
            F.col("agent_id").alias("model_id"),
            u("input").alias("input_tokens"),
            u("output").alias("output_tokens"),
            u("cache_read").alias("cache_read_input_tokens"),
            u("cache_write").alias("cache_creation_input_tokens"),
            u("reasoning").alias("reasoning_tokens"),
            F.lit(None).cast("long").alias("time_to_first_token_ms"),
        )
    )


@query("SELECT conv_id, n, CASE WHEN d = 1 THEN 'identical_reemit' ELSE 'two_phase' END AS kind FROM (SELECT conv_id, count(*) AS n, count(DISTINCT concat(coalesce(role, chr(1)), chr(2), coalesce(text, chr(1)))) AS d FROM conversations GROUP BY conv_id) WHERE n >= 2")
def reemit_groups(spark, sf_dir):
    return profile.reemit_groups(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", ["role", "text"])


@query("SELECT event_id, substr(sha256(props), 1, 16) AS hashed, substr(sha256(lower(replace(concat('C:\\Logs\\', event_type), '\\', '/'))), 1, 16) AS path_hash, concat('zcode_row_', substr(sha256(CAST(event_id AS VARCHAR)), 1, 16)) AS row_key FROM events")
def hash_ids(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", hash16(F.col("props")).alias("hashed"), path_hash(F.concat(F.lit("C:\\Logs\\"), F.col("event_type"))).alias("path_hash"), prefixed("zcode_row_", F.col("event_id").cast("string")).alias("row_key"))


@query(
    _USAGE
    + """, s AS (SELECT greatest(output - lag(output) OVER (PARTITION BY agent_id ORDER BY seq), 0) AS step, cache_write FROM prep)
SELECT count(*) FILTER (step = cache_write) AS matches, count(*) FILTER (step <> cache_write) AS mismatches FROM s WHERE step IS NOT NULL"""
)
def validation_match(spark, sf_dir):
    rows = prepared(fixture.samples(spark, sf_dir))
    return profile.validation_counts(rows, "agent_id", "seq", "output", "cache_write")


@query(_USAGE + " SELECT 0 AS source_order, seq FROM prep WHERE source_adapter_id = 'src_app' UNION ALL SELECT 1, seq FROM prep WHERE source_adapter_id <> 'src_app'")
def union_sources(spark, sf_dir):
    rows = fixture.samples(spark, sf_dir)
    return profile.union_sources(rows.filter("source_adapter_id = 'src_app'"), rows.filter("source_adapter_id <> 'src_app'")).select("source_order", "seq")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: per-agent totals of the whole engine."""
    return reconcile.agent_totals(meter(fixture.samples(spark, sf_dir)).ledgers)
