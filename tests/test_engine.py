"""Scenarios of the metering engine with literal results, and every query against DuckDB."""

import json
import sqlite3

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meterlake.functions.schema import COUNTERS, SAMPLE
from meterlake.plans import queries as plans
from meterlake.plans.engine import meter


def sample(seq, out, kind="Snapshot", **more):
    usage = {"raw_input_tokens": more.pop("inp", 100), "raw_output_tokens": out, "raw_cache_read_tokens": more.pop("cr", 0), "raw_cache_write_tokens": 0, "raw_reasoning_tokens": 0, "raw_total_tokens": None}
    row = dict.fromkeys(SAMPLE.names)
    row |= {"seq": seq, "sample_id": f"s{seq}", "collector_run_id": "r", "source_adapter_id": "a", "observed_monotonic_ns": seq * 200_000_000, "wall_timestamp_ms": seq, "agent_id": "x", "agent_name": "x", "session_id": "s", "request_id": "q", "model": "m", "provider": "p", "event_kind": kind, "is_cumulative": kind != "Delta", "is_final": kind == "Final", "counter_reset_hint": False, "raw_usage": usage, "source_priority": 50, "token_accuracy": "Exact", "temporal_accuracy": "StreamExact", "measurement_kind": "StreamCounter", "baseline_mode": "KnownZeroOrigin", "strategy": "OpenAiStyle", "reasoning_in_output": True}
    return row | more


def run(spark, *rows):
    return meter(spark.createDataFrame(list(rows), SAMPLE))


def outputs(result):
    return [r.delta_output for r in result.deltas.orderBy("seq").collect()]


def test_accumulation_and_out_of_order(spark):
    assert outputs(run(spark, *[sample(i, v) for i, v in enumerate((20, 71, 133, 196), 1)])) == [20, 51, 62, 63]
    assert outputs(run(spark, *[sample(i, v) for i, v in enumerate((100, 180, 150, 230), 1)])) == [100, 80, 50]


def test_reset_and_attach(spark):
    rows = [sample(1, 500, baseline_mode="UnknownAttach"), sample(2, 550), sample(3, 30, counter_reset_hint=True), sample(4, 70)]
    assert outputs(run(spark, *rows)) == [50, 30, 40]


def test_corrections_and_late_after_final(spark):
    out = run(spark, sample(1, 160), sample(2, 196, "Final"), sample(3, 50, "Delta"))
    assert [r.output_correction for r in out.corrections.collect()] == [36]
    ledger = out.ledgers.first()
    assert ledger.canonical_output == 196 and ledger.is_finalized
    assert [r.outcome for r in out.outcomes.orderBy("seq").collect()] == ["Committed", "Committed", "Rejected"]
    assert run(spark, sample(1, 200), sample(2, 196, "Final")).corrections.first().output_correction == -4
    assert run(spark, sample(1, 196, "Final"), sample(2, 196, "Final")).corrections.count() == 1


def test_handoff(spark):
    rows = [sample(1, 100, source_adapter_id="a"), sample(2, 80, source_adapter_id="b", source_priority=90), sample(3, 110, source_adapter_id="b", source_priority=90)]
    out = run(spark, *rows)
    assert outputs(out) == [100, 10] and out.ledgers.first().winning_source == "b"
    rows = [sample(1, 10, cr=60), sample(2, 20, source_adapter_id="b", source_priority=90, raw_usage={"raw_input_tokens": 100, "raw_output_tokens": 20, "raw_cache_read_tokens": None, "raw_cache_write_tokens": 0, "raw_reasoning_tokens": 0, "raw_total_tokens": None})]
    assert outputs(run(spark, *rows)) == [10]


def test_rates(spark):
    out = run(spark, sample(1, 60, "Delta"), sample(2, 50, "Delta", agent_id="y"), sample(3, 30, "Delta", agent_id="z"))
    ticks = spark.createDataFrame([(1, 3, "r", 600_000_000), (2, 3, "r", 3_000_000_000)], "tick long, tick_seq long, collector_run_id string, now_ns long")
    rows = {r.tick: r for r in out.global_metrics(ticks).collect()}
    assert rows[1].global_out_tps == 140 and rows[1].generating_agents == 3
    assert rows[2].global_out_tps == 0 and rows[2].peak_out_tps == 140 and rows[1].global_in_tps is None


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("events", "orders", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = plans.QUERIES[name](spark, sf).collect()
    want = con.execute(plans.ORACLES[name])
    names = [d[0] for d in want.description]
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    left = sorted((tuple(plain(r[n]) for n in names) for r in got), key=key)
    right = sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=key)
    assert left == right


def test_election_by_one_row_after_another(spark):
    """Random deltas of several sources against a plain loop over them in order."""
    from meterlake.functions.usage import prepared
    from meterlake.operators import counters, reconcile

    rng = np.random.default_rng(14)
    rows = []
    for seq in range(1, 1200):
        source, total = "abc"[rng.integers(0, 3)], int(rng.integers(0, 60)) + seq
        kind = "Delta" if rng.random() < 0.3 else "Snapshot"
        rows.append(sample(seq, total, kind, inp=int(rng.integers(0, 50)) + seq, source_adapter_id=source, request_id=f"q{rng.integers(0, 12)}", source_priority=int(rng.choice([50, 60, 90])), temporal_accuracy=str(rng.choice(["StreamExact", "IntervalExact"])), token_accuracy=str(rng.choice(["Exact", "Measured"])), observed_monotonic_ns=seq * 2_000_000_000 if rng.random() < 0.1 else seq * 100_000))
        if rng.random() < 0.2:
            rows[-1]["raw_usage"]["raw_cache_read_tokens"] = None
        if rng.random() < 0.05:
            rows[-1]["request_id"] = None
            rows[-1]["native_identity"] = (None, None, None, None, "h", seq, None, None)
    live = reconcile.dedup_first(counters.live_deltas(prepared(spark.createDataFrame(rows, SAMPLE)))).orderBy("seq").collect()
    token, temporal = ("Unavailable", "Estimated", "Measured", "Exact"), ("Unavailable", "Estimated", "TurnExact", "IntervalExact", "StreamExact")
    active, want = {}, []
    for r in live:
        delta = [r[f"delta_{c}"] for c in COUNTERS]
        rank = (token.index(r.token_accuracy), temporal.index(r.temporal_accuracy), r.source_priority)
        state = active.get(r.request_key)
        if r.correlation_confidence in ("Weak", "Unknown"):
            want.append((r.seq, delta))
        elif state is None:
            active[r.request_key] = [r.source_adapter_id, rank, delta]
            want.append((r.seq, delta))
        elif state[0] == r.source_adapter_id:
            state[2] = [a + b for a, b in zip(state[2], delta, strict=True)]
            want.append((r.seq, delta))
        elif rank > state[1]:
            at = [r[f"cum_{c}"] for c in COUNTERS]
            if all(h == 0 or (x is not None and x >= h) for h, x in zip(state[2], at, strict=True)):
                delta = [0 if x is None else x - h for h, x in zip(state[2], at, strict=True)]
                active[r.request_key] = [r.source_adapter_id, rank, [a + b for a, b in zip(state[2], delta, strict=True)]]
                want.append((r.seq, delta))
    got = reconcile.elect_sources(spark.createDataFrame(live, live_schema(spark, rows))).orderBy("seq").collect()
    assert [(r.seq, [r[f"delta_{c}"] for c in COUNTERS]) for r in got] == want and len(want) < len(live)
    assert all(r.delta_total == r.delta_context_input + r.delta_output for r in got)


def live_schema(spark, rows):
    from meterlake.functions.usage import prepared
    from meterlake.operators import counters

    return counters.live_deltas(prepared(spark.createDataFrame(rows, SAMPLE))).schema


def test_rates_by_one_push_after_another(spark, monkeypatch):
    """Random deltas of several agents and runs, clocks that fall back a little, spans of a few rows; against a list of pushes."""
    from meterlake.operators import rates

    monkeypatch.setattr(rates, "SPAN", 16)
    rng = np.random.default_rng(15)
    rows, clock, run = [], 0, 0
    for seq in range(1, 400):
        clock += int(rng.integers(-200, 1500)) * 1_000_000
        if rng.random() < 0.02:
            run, clock = run + 1, 10_000_000_000
        rows.append(sample(seq, int(rng.integers(1, 30)), "Delta", agent_id="xyz"[rng.integers(0, 3)], collector_run_id=f"r{run % 3}", observed_monotonic_ns=max(clock, 0), request_id=f"q{seq}", temporal_accuracy=str(rng.choice(["StreamExact", "IntervalExact"]))))
    ticks = [(i, i * 9, rows[i * 9 - 1]["collector_run_id"], rows[i * 9 - 1]["observed_monotonic_ns"] + int(rng.integers(0, 2000)) * 1_000_000) for i in range(1, 44)]
    result = run_of(spark, rows)
    got = {(r.agent_id, r.tick): r for r in result.agent_tps(spark.createDataFrame(ticks, "tick long, tick_seq long, collector_run_id string, now_ns long")).collect()}
    deltas = {r.seq: r for r in result.deltas.collect()}
    buffers, want = {}, {}
    for r in rows:
        d = deltas[r["seq"]]
        own = buffers.setdefault(d.agent_id, [])
        own.append(d)
        own[:] = [b for b in own if b.collector_run_id == d.collector_run_id and d.observed_monotonic_ns - b.observed_monotonic_ns <= 5 * 10**9]
        for tick, at, name, now in ticks:
            if at == r["seq"]:
                for agent, held in buffers.items():
                    good = [b for b in held if b.collector_run_id == name and b.temporal_accuracy == "StreamExact" and b.gap_state == "Normal"]
                    ages = [max(0, now - b.observed_monotonic_ns) for b in good]
                    want[agent, tick] = (sum(b.delta_output for b, a in zip(good, ages, strict=True) if a <= 10**9), sum(b.delta_output for b in good) / max(max(ages, default=0) / 1e9, 1.0))
    assert got.keys() == want.keys() and any(v[0] for v in want.values())
    for k, (now, average) in want.items():
        assert got[k].out_tps == now and abs(got[k].avg_5s_out_tps - average) < 1e-9, k


def run_of(spark, rows):
    return run(spark, *rows)


def _record(**usage):
    at = usage.pop("at", 1)
    return json.dumps({"timestamp": f"2025-01-01T00:00:{at:02d}Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": usage}}}) + "\n"


def _message(session, message, output, at=1, **cache):
    usage = {"input_tokens": 10, "output_tokens": output} | {f"cache_{k}_input_tokens": v for k, v in cache.items()}
    return json.dumps({"type": "assistant", "timestamp": f"2025-01-01T00:00:{at:02d}Z", "sessionId": session, "message": {"id": message, "model": "mo", "usage": usage, "content": "private"}}) + "\n"


COLUMNS = ("id", "logical_request_id", "session_id", "turn_id", "provider_id", "model_id", "variant", "status", "started_at", "first_token_at", "completed_at", "duration_ms", "time_to_first_token_ms", "input_tokens", "output_tokens", "reasoning_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "provider_total_tokens", "computed_total_tokens", "retry_count", "retryable", "cancelled_by_user", "context_exceeded")


def _usage_row(con, i, status, at, output):
    row = dict.fromkeys(COLUMNS) | {"id": i, "logical_request_id": f"l{i}", "session_id": "s", "turn_id": "t", "provider_id": "p", "model_id": "m", "status": status, "started_at": at, "completed_at": at, "input_tokens": 20, "output_tokens": output}
    con.execute(f"INSERT INTO model_usage VALUES ({','.join('?' * len(COLUMNS))})", [row[c] for c in COLUMNS])
    con.commit()


def test_metering_engine(spark, tmp_path):
    """Attach, growth, new files, truncation, restart; placeholders, finals told again, changed and half written; a table that changes in place."""
    from meterlake.sources.clock import CollectorClock, Observation
    from meterlake.sources.logs import in_sequence
    from meterlake.streaming.engine import FatalNeedsRestart, MeteringEngine

    sessions, projects, db = tmp_path / "codex" / "sessions" / "2025", tmp_path / "projects", tmp_path / "db.sqlite"
    sessions.mkdir(parents=True)
    projects.mkdir()
    con = sqlite3.connect(db)
    con.execute(f"CREATE TABLE model_usage ({', '.join(COLUMNS)})")
    old, new, slow = (sessions / f"rollout-{n}.jsonl" for n in ("old", "new", "slow"))
    old.write_text(_record(output_tokens=4900) + _record(output_tokens=5000) + '{"type":"other"}\n')
    (projects / "old.jsonl").write_text(_message("s0", "m0", 999, read=0, creation=0))
    _usage_row(con, "old", "completed", 2000, 5000)

    def engine(run):
        return MeteringEngine(spark, str(tmp_path / "store"), str(tmp_path / "codex"), str(projects), str(db), clock=CollectorClock(run))

    def outputs():
        return {(r.agent_id, r.session_id, r.request_key): r.canonical_output for r in one.store.ledgers().collect()}

    def by_agent():
        out = {}
        for (agent, *_), n in outputs().items():
            out.setdefault(agent, []).append(n)
        return {k: sorted(v) for k, v in out.items()}

    one = engine("run_1")
    first = one.tick(Observation("run_1", 0, 1))
    assert one.total_output() == 0 and first.health["rollouts"]["source_available"] and not one.due(Observation("run_1", 10, 1))

    with old.open("a") as f:
        f.write(_record(output_tokens=5050, at=2) + "{bad\n")
    new.write_text(_record(output_tokens=100) + _record(output_tokens=160, at=2) + _record(output_tokens=160, at=3))
    slow.write_text(_record(output_tokens=100, at=1) + _record(output_tokens=300, at=5))
    half = _message("s1", "m3", 7, read=0, creation=0)
    (projects / "p.jsonl").write_text(_message("s1", "m1", 1) + _message("s1", "m1", 750, read=1024, creation=0) + _message("s1", "m2", 100, read=0, creation=0) * 3 + half[:40])
    (projects / "q.jsonl").write_text(_message("s1", "m2", 100, read=0, creation=0) + json.dumps({"type": "assistant", "timestamp": "2025-01-01T00:00:01Z", "message": {"usage": {"output_tokens": 9, "cache_read_input_tokens": 0, "cache_creation_input_tokens": 0}}}) + "\n")
    _usage_row(con, "n", "completed", 4000, 50)
    _usage_row(con, "A", "future", 5000, 100)
    _usage_row(con, "B", "completed", 6000, 60)
    second = one.tick(Observation("run_1", 10**9, 2))
    assert by_agent() == {"codex": [50, 160, 300], "claude": [100, 750], "zcode": [50]}
    assert second.health["usage"]["source_degraded"] and second.statistics["transcripts"]["placeholders"] == 1 and second.statistics["transcripts"]["unresolved"] == 1
    rate = {r.agent_id: r for r in one.rates().collect()}
    assert (rate["codex"].interval_tokens, rate["codex"].interval_seconds, rate["codex"].interval_tps, rate["codex"].out_tps) == (200, 4.0, 50.0, 0)
    fresh = {r.request_key: r for r in one.store.ledgers().filter("agent_id = 'claude'").collect()}
    assert sorted((r.canonical_fresh_input, r.canonical_context_input) for r in fresh.values()) == [(10, 10), (10, 1034)]

    new.write_text(_record(output_tokens=40))
    with (projects / "p.jsonl").open("a") as f:
        f.write(half[40:] + _message("s1", "m2", 150, read=0, creation=0))
    con.execute("UPDATE model_usage SET status = 'completed' WHERE id = 'A'")
    con.execute("UPDATE model_usage SET model_id = 'm2' WHERE id = 'n'")
    con.commit()
    third = one.tick(Observation("run_1", 2 * 10**9, 3))
    assert by_agent() == {"codex": [50, 160, 300], "claude": [7, 150, 750], "zcode": [50, 60, 100]}
    assert {r.model for r in one.store.ledgers().filter("agent_id = 'zcode' and canonical_output = 50").collect()} == {"m2"}
    assert not third.health["usage"]["source_degraded"]

    one = engine("run_2")
    with old.open("a") as f:
        f.write(_record(output_tokens=5100, at=9))
    one.tick(Observation("run_2", 0, 4))
    assert by_agent() == {"codex": [100, 160, 300], "claude": [7, 150, 750], "zcode": [50, 60, 100]}
    assert one.store.seen().count() > 0 and one.store.checkpoints().filter("last_file_offset is not null").count() >= 4

    log = one.store.read("samples").select(*SAMPLE.names)
    whole = {(r.agent_id, r.session_id, r.request_key): r.canonical_output for r in meter(in_sequence(log)).ledgers.collect()}
    assert whole == outputs()
    db.rename(tmp_path / "away")
    assert one._probe("usage")[1:3] == (0, 1)
    one.fatal = "lost"
    with pytest.raises(FatalNeedsRestart):
        one.tick()


def test_stream_like_batch_and_store_versions(spark, tmp_path):
    """An id that two sessions tell counts once, in whichever order batches come; a batch again changes nothing; an old store is made anew, a newer one refused."""
    from meterlake.streaming.live import Store, process

    def told(seq, session, out, event):
        row = sample(seq, out, "Delta", session_id=session)
        row["native_identity"] = (event, None, None, None, None, None, None, None)
        return row

    batches = [[told(1, "s1", 5, "e1"), told(2, "s1", 7, "e2")], [told(3, "s2", 5, "e1"), told(4, "s2", 9, "e3")], [told(5, "s2", 1, "e4"), told(6, "s3", 7, "e2")], [sample(7, 40, "Final", session_id="s3")]]
    store = Store(spark, str(tmp_path / "store"))
    for n, rows in enumerate(batches):
        process(store, spark.createDataFrame(rows, SAMPLE), n)
    process(store, spark.createDataFrame(batches[1], SAMPLE), 1)
    want = {r.session_id: r.canonical_output for r in run(spark, *sum(batches, [])).ledgers.collect()}
    got = lambda: {r.session_id: r.canonical_output for r in store.ledgers().collect()}
    assert got() == want == {"s1": 12, "s2": 10, "s3": 40}
    uncommitted = Store(spark, str(tmp_path / "store"))
    uncommitted.write("events", store.latest("events").limit(1), 99)
    assert got() == want
    spark.createDataFrame([(2,)], "version int").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "store" / "version"))
    store = Store(spark, str(tmp_path / "store"))
    assert got() == want
    spark.createDataFrame([(99,)], "version int").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "store" / "version"))
    with pytest.raises(RuntimeError):
        Store(spark, str(tmp_path / "store"))


def test_discovery_and_tables(spark, tmp_path, monkeypatch):
    from meterlake.sources import logs
    from meterlake.sources.connectors import SqliteTable

    monkeypatch.setenv("HOME", str(tmp_path))
    monkeypatch.delenv("USERPROFILE", raising=False)
    assert logs.discover_usage_database(spark).count() == 0 and logs.discover_rollouts(spark).count() == 0
    for name in (".codex/sessions/a/rollout-1.jsonl", ".codex/sessions/other.jsonl", ".codex/state_1.sqlite", ".claude/projects/x/y.jsonl", ".zcode/cli/db/db.sqlite", ".zcode/cli/rollout/r.jsonl", ".zcode/cli/rollout/deep/r.jsonl", ".zcode/cli/log/l.jsonl", ".zcode/cli/log/l.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [logs.discover_rollouts(spark).count(), logs.discover_transcripts(spark).count(), logs.discover_state_files(spark).count(), logs.discover_usage_database(spark).count()] == [1, 1, 1, 1]
    assert tuple(logs.environment_counts(spark).first()) == (1, 1)

    spark.dataSource.register(SqliteTable)
    db = tmp_path / "t.sqlite"
    con = sqlite3.connect(db)
    con.execute("CREATE TABLE model_usage (id TEXT, status TEXT, completed_at INT)")
    con.executemany("INSERT INTO model_usage VALUES (?, ?, ?)", [("b", "completed", 2000), ("a", "error", 1000)])
    con.commit()
    rows = spark.read.format("sqlite_table").option("path", str(db)).schema("id string, status string, completed_at long").load()
    assert [r.id for r in rows.collect()] == ["a", "b"] and rows.filter("completed_at > 1500").count() == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("sqlite_table").option("path", str(db)).option("pushdown", "true").schema("id string, status string, completed_at long").load()
    assert [r.id for r in rows.filter("completed_at > 1500").collect()] == ["b"]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def _token_line(n):
    return _record(output_tokens=n)


def _read(ranges):
    """(line, baseline mode) of byte ranges, as executors read them."""
    import pyarrow as pa

    from meterlake.sources.connectors import read_ranges

    names = ["path", "file_hash", "begin", "start", "end", "stop", "baseline", "nth"]
    rows = [dict(zip(names, r, strict=True)) for r in ranges]
    batches = list(read_ranges(iter([pa.RecordBatch.from_pylist(rows)]))) if rows else []
    out = [r for b in batches for r in b.to_pylist()]
    assert [r["pos"] for r in out] == sorted({r["pos"] for r in out})
    return [(r["value"] + "\n", r["baseline_mode"]) for r in out]


@pytest.mark.parametrize("block", [7, 100, 8 << 20])
def test_tail_baseline_on_attach(tmp_path, monkeypatch, block):
    """start=latest, a last line of another type, truncation, and the replay of each batch."""
    from meterlake.sources import connectors

    monkeypatch.setattr(connectors, "READ", block)
    log, other = tmp_path / "a.jsonl", json.dumps({"type": "other", "text": "token_count " * 30}) + "\n"
    log.write_text(_token_line(1) + _token_line(500) + other * 3 + "{part")
    (tmp_path / "b.jsonl").write_text(other)
    tail = connectors.JsonlTailReader({"path": str(tmp_path), "start": "latest"})

    def step(start):
        rows, end = tail.read(start)
        rows = list(rows)
        plain = lambda rs: sorted(r[:-1] for r in rs)
        assert plain(tail.readBetweenOffsets(start, end)) == plain(rows)
        return _read(rows), end

    got, at = step(tail.initialOffset())
    assert got == [(_token_line(500), "ReplayRestore")]
    assert step(at) == ([], at)
    with log.open("a") as f:
        f.write("}\n" + _token_line(530))
    got, at = step(at)
    assert got == [("{part}\n", None), (_token_line(530), None)]
    log.write_text(_token_line(40) + other)
    got, at = step(at)
    assert got == [(_token_line(40), "ReplayRestore")] and step(at) == ([], at)
    again = connectors.JsonlTailReader({"path": str(tmp_path), "truncated": "start", "baselines": "false"})
    assert _read(again.read({str(log): 10**6, str(tmp_path / "b.jsonl"): 10**6})[0]) == [(other, None), (_token_line(40), None), (other, None)]


def test_tail_records_longer_than_a_read(tmp_path, monkeypatch):
    from meterlake.sources import connectors

    monkeypatch.setattr(connectors, "READ", 64)
    lines = ["a", "x" * 1000, "b", "", "c" * 63, "d" * 64, "e\r"]
    (tmp_path / "a.jsonl").write_bytes(("\n".join(lines) + "\n" + "y" * 300).encode())
    tail = connectors.JsonlTailReader({"path": str(tmp_path)})
    rows, at = tail.read({})
    assert [v[:-1] for v, _ in _read(list(rows))] == [x.rstrip("\r") for x in lines]
    rows, end = tail.read(at)
    assert list(rows) == [] and end == at


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
