"""A metering engine over the three sources: one call reads what is new of each, meters it, and says how things stand.

    engine = MeteringEngine(spark, "/shared/store", rollouts=root, transcripts=projects, usage=database)
    snapshot = engine.tick()          # or engine.start(seconds=3) for a query that goes on by itself
"""

from __future__ import annotations

import glob
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterlake.functions.schema import TERMINAL
from meterlake.operators import profile, rates
from meterlake.sources import logs
from meterlake.sources.clock import CollectorClock, Observation
from meterlake.sources.connectors import tail, usage_rows
from meterlake.streaming.live import Store, process

#: Sources in the order in which a tick takes them; positions of a batch's lines stay below 2^38 a source, a batch's below 2^40.
SOURCES = ("rollouts", "transcripts", "usage")
SOURCE_BITS, BATCH_BITS = 38, 40
DISCOVERY_NS = 3_000_000_000


class FatalNeedsRestart(RuntimeError):
    """A durable write has failed; a new engine goes on from the checkpoint."""


@dataclass
class Snapshot:
    observation: Observation
    health: dict[str, dict]
    statistics: dict[str, dict] = field(default_factory=dict)


class MeteringEngine:
    """Start: `latest` attaches to what exists without counting its history, `earliest` counts all of it."""

    def __init__(self, spark: SparkSession, path: str, rollouts: str | None = None, transcripts: str | None = None, usage: str | None = None, start: str = "latest", clock: CollectorClock | None = None):
        self.spark, self.clock, self.start_at = spark, clock or CollectorClock(), start
        self.paths = {"rollouts": rollouts, "transcripts": transcripts, "usage": usage}
        self.store, self.checkpoint = Store(spark, path), f"{path.rstrip('/')}/checkpoint"
        self.store.record_run(self.clock.run_id, self.clock.started_ms)
        self.fatal: str | None = None
        self.statistics: dict[str, dict] = {}
        self.polls: list[tuple] = []
        self.last_ns: int | None = None
        self.observation = self.clock.observe()

    def lines(self) -> DataFrame:
        """The new lines of all sources in one stream, so that a batch has one id and one commit."""
        made = {
            "rollouts": lambda p: tail(self.spark, os.path.join(p, "sessions"), pattern="rollout-*.jsonl", start=self.start_at),
            "transcripts": lambda p: tail(self.spark, p, start=self.start_at, truncated="start", baselines="false"),
            "usage": lambda p: usage_rows(self.spark, p, start=self.start_at),
        }
        streams = [made[s](self.paths[s]).withColumn("source", F.lit(i)) for i, s in enumerate(SOURCES) if self.paths[s]]
        out = streams[0]
        for other in streams[1:]:
            out = out.unionByName(other)
        return out

    def samples(self, lines: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
        """Canonical samples of a batch of lines, and parsed transcripts."""
        seq = F.lit(batch).cast("long") * (1 << BATCH_BITS) + F.col("source") * (1 << SOURCE_BITS) + F.col("pos")
        lines = self.observation.on(lines).withColumn("seq", seq)
        run = self.clock.run_id
        rollouts = logs.rollout_samples(logs.parse_rollouts(lines.filter("source = 0")), run)
        parsed = logs.parse_transcripts(lines.filter("source = 1").drop("baseline_mode"))
        rows = lines.filter("source = 2").select("seq", "observed_monotonic_ns", F.from_json("value", logs.USAGE_ROW).alias("r")).select("seq", "observed_monotonic_ns", "r.*")
        finals = logs.transcript_samples(parsed, run).unionByName(logs.usage_row_samples(rows, run))
        return rollouts.unionByName(self.news(finals)), parsed

    def news(self, finals: DataFrame) -> DataFrame:
        """Without finals that the ledgers hold already, or that an earlier one of the batch has just told."""
        told = F.struct("raw_usage", "model", "provider")
        request = Window.partitionBy("agent_id", "session_id", "request_id").orderBy("seq")
        finals = finals.withColumn("_again", F.coalesce(F.lag(told).over(request) == told, F.lit(False))).filter("not _again").drop("_again")
        ledgers = self.store.ledgers()
        if ledgers is None:
            return finals
        from meterlake.functions.usage import prepared

        rows = prepared(finals)
        exact = profile.classify_finals(rows.filter("agent_id = 'zcode'"), ledgers, names=True).unionByName(profile.classify_finals(rows.filter("agent_id <> 'zcode'"), ledgers, names=False))
        return exact.filter("finality <> 'identical'").select(*finals.columns)

    def _batch(self, lines: DataFrame, batch: int) -> None:
        lines.persist()
        try:
            samples, parsed = self.samples(lines, batch)
            counts = lines.groupBy("source").agg(F.count(F.lit(1)).alias("consumed")).collect()  # one row a source
            self.statistics = {SOURCES[r[0]]: {"consumed": r[1]} for r in counts}
            if "transcripts" in self.statistics:
                self.statistics["transcripts"] |= logs.transcript_statistics(parsed).first().asDict()
            process(self.store, samples, batch)
        finally:
            lines.unpersist()

    def start(self, seconds: float | None = None) -> StreamingQuery:
        """A query that takes what is new every so many seconds, or once."""
        trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}

        def batch(lines: DataFrame, n: int) -> None:
            if seconds is not None:
                self.observation = self.clock.observe()
            self._batch(lines, n)

        return self.lines().writeStream.foreachBatch(batch).option("checkpointLocation", self.checkpoint).trigger(**trigger).start()

    def due(self, observation: Observation) -> bool:
        return self.last_ns is None or observation.monotonic_ns - self.last_ns >= DISCOVERY_NS

    def tick(self, observation: Observation | None = None) -> Snapshot:
        """Read what is new of every source, meter it, and say how the sources stand. A source that can't be read is degraded;
        a failure to commit is fatal, for every later tick too."""
        if self.fatal:
            raise FatalNeedsRestart(self.fatal)
        self.observation = observation or self.clock.observe()
        self.statistics, self.last_ns = {}, self.observation.monotonic_ns
        try:
            self.start().awaitTermination()
        except Exception as cause:
            self.fatal = f"{type(cause).__name__}: {cause}"
            raise FatalNeedsRestart(self.fatal) from cause
        for source in SOURCES:
            if self.paths[source]:
                tracked, available, failures, unknown = self._probe(source)
                self.polls.append((source, len(self.polls), tracked, available, failures, unknown, self.statistics.get(source, {}).get("consumed", 0), self.observation.wall_ms))
        return Snapshot(self.observation, self.health(), self.statistics)

    def _probe(self, source: str) -> tuple[int, int, int, int]:
        """How many files a source has, can be read and can't, and whether an unknown status holds the table up."""
        path = self.paths[source]
        if source == "usage":
            import sqlite3

            try:
                db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
                unknown = db.execute(f"SELECT count(*) FROM model_usage WHERE status NOT IN ({','.join('?' * len(TERMINAL))})", TERMINAL).fetchone()[0]
                db.close()
                return 1, 1, 0, unknown
            except sqlite3.Error:
                return int(os.path.exists(path)), 0, 1, 0
        files = glob.glob(os.path.join(path, "sessions", "**", "rollout-*.jsonl") if source == "rollouts" else os.path.join(path, "**", "*.jsonl"), recursive=True)
        good = sum(os.access(f, os.R_OK) for f in files)
        return len(files), good, len(files) - good, 0

    def health(self) -> dict[str, dict]:
        if not self.polls:
            return {}
        rows = self.spark.createDataFrame(self.polls, "source string, poll long, tracked long, available long, failures long, unknown_status long, consumed long, wall_ms long")
        return {r.source: r.asDict() for r in profile.health(rows).collect()}

    def rates(self) -> DataFrame | None:
        """The rates of the agents at the last tick."""
        result = self.store.result()
        if result is None:
            return None
        at = self.observation
        last = self.store.read("samples").agg(F.max("seq")).first()[0]
        return result.agent_tps(self.spark.createDataFrame([(0, last, at.collector_run_id, at.monotonic_ns)], "tick long, tick_seq long, collector_run_id string, now_ns long"))

    def global_metrics(self) -> DataFrame | None:
        tps = self.rates()
        return None if tps is None else rates.global_metrics(tps)

    def total_output(self, agent_id: str | None = None) -> int:
        result = self.store.result()
        return 0 if result is None else result.total_output(agent_id).first()[0]
