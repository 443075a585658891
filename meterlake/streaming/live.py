"""Metering on Structured Streaming: the batch plan over the sessions that a micro-batch touches, with one atomic commit a batch.

Samples are appended to a log partitioned by a hash of agent and session, under the batch's id. A micro-batch reads the
parts it touches, keeps the touched sessions and runs the batch plan on them: their first deltas are written, then the
events that follow, and last the commit, a table of the touched sessions. Whatever has no commit is not there for a
reader, so all results of a batch appear at once; writing a batch again replaces it, so a replay after a failure changes
nothing, and offsets advance only after the commit. An id that a session outside the batch has taken stays taken, as in
the batch plan, where ids are unique over all sessions.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterlake.functions.schema import SAMPLE
from meterlake.functions.usage import prepared
from meterlake.plans.engine import MeterResult, first_deltas, first_seen, settled
from meterlake.sources.logs import in_sequence

VERSION, PARTS = 3, 64
DERIVED = ("firsts", "events", "commits")
SESSION = ["agent_id", "session_id"]


class Store:
    """Versioned Parquet tables in a folder. An older version's results are made anew from its samples; a newer one is refused."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        found = self.spark.read.parquet(f"{self.path}/version").first()[0] if self._exists("version") else None
        if found is not None and found > VERSION:
            raise RuntimeError(f"the store has version {found}; this library writes {VERSION}")
        if found != VERSION:
            if found is not None:
                self.rebuild()
            spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        fs, path = self._fs(name)
        return fs.exists(path)

    def rebuild(self) -> None:
        """Meter the whole log again; the samples, which no stream gives twice, stay."""
        for name in (*DERIVED, "deltas", "corrections", "ledgers", "outcomes"):
            fs, path = self._fs(name)
            fs.delete(path, True)
        log = self.read("samples")
        if log is not None and not log.isEmpty():
            settle(self, log.agg(F.max("batch")).first()[0], whole=True)

    def write(self, name: str, df: DataFrame, batch: int, by: list[str] | None = None) -> DataFrame:
        """The rows as they lie in the store."""
        out = df.withColumn("batch", F.lit(batch).cast("long"))
        if by:
            out = out.repartition(*[F.col(c) for c in by])  # one file for each part
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(by or []), "batch").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(out.schema).parquet(f"{self.path}/{name}").filter(F.col("batch") == batch).drop("batch")

    def read(self, name: str) -> DataFrame | None:
        """A table, None as long as it has no rows."""
        if not self._exists(name):
            return None
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as cause:
            if cause.getCondition() == "UNABLE_TO_INFER_SCHEMA":
                return None
            raise

    def latest(self, name: str) -> DataFrame | None:
        """firsts or events as of the newest committed batch of each session."""
        commits, rows = self.read("commits"), self.read(name)
        if commits is None or rows is None:
            return None
        newest = commits.groupBy(*SESSION).agg(F.max("batch").alias("batch"))
        return rows.join(newest, [*SESSION, "batch"], "left_semi").drop("batch")

    def result(self) -> MeterResult | None:
        """Everything metered so far."""
        events, log = self.latest("events"), self.read("samples")
        return None if events is None else MeterResult(events, first_seen(log))

    def ledgers(self) -> DataFrame | None:
        result = self.result()
        return None if result is None else result.ledgers

    def seen(self) -> DataFrame | None:
        """(source, stable id) of what has been counted once."""
        rows = self.latest("firsts")
        return None if rows is None else rows.select("source_adapter_id", "stable_ingestion_id").distinct()

    def checkpoints(self) -> DataFrame | None:
        """How far each file or table has been metered, by its samples."""
        log, commits = self.read("samples"), self.read("commits")
        if log is None or commits is None:
            return None
        done = log.join(commits.select(*SESSION, "batch").distinct(), [*SESSION, "batch"], "left_semi")
        return done.groupBy(F.concat_ws(":", "source_adapter_id", "native_identity.file_path_hash").alias("source_id")).agg(
            F.max("native_identity.byte_offset").alias("last_file_offset"), F.max_by("native_identity.db_row_id", "seq").alias("last_db_row_id"), F.max("source_timestamp_ms").alias("watermark_timestamp_ms")
        )

    def record_run(self, run_id: str, started_ms: int) -> None:
        self.spark.createDataFrame([(run_id, started_ms)], "collector_run_id string, started_ms long").coalesce(1).write.mode("append").parquet(f"{self.path}/runs")


def part() -> F.Column:
    return F.pmod(F.xxhash64(*SESSION), F.lit(PARTS)).cast("int")


def process(store: Store, samples: DataFrame, batch: int) -> MeterResult | None:
    """Take one micro-batch of canonical samples into the store."""
    samples = samples.select(*[F.col(f.name).cast(f.dataType) for f in SAMPLE])
    store.write("samples", samples.withColumn("part", part()), batch, ["part"])
    return settle(store, batch)


def settle(store: Store, batch: int, whole: bool = False) -> MeterResult | None:
    """Meter the sessions that a batch of the log touches, all of them if `whole`."""
    log = store.read("samples")
    if log is None:
        return None
    log = log.filter(F.col("batch") <= batch)
    now = log if whole else log.filter(F.col("batch") == batch)
    parts = [r[0] for r in now.select("part").distinct().collect()]  # at most PARTS numbers
    if not parts:
        return None
    touched = now.select(*SESSION).distinct()
    history = log.filter(F.col("part").isin(parts)).join(touched, SESSION, "left_semi").select(*SAMPLE.names)
    rows = prepared(in_sequence(history))
    others = store.latest("firsts")
    taken = None if others is None or whole else others.join(touched, SESSION, "left_anti").select("source_adapter_id", "stable_ingestion_id")
    firsts = store.write("firsts", first_deltas(rows, taken), batch)
    store.write("events", settled(firsts, rows).events, batch)
    store.write("commits", touched.coalesce(1), batch)
    return store.result()


def meter_stream(samples: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start metering a stream of canonical samples; a failure that the store can't undo ends the query."""

    def batch(df: DataFrame, n: int) -> None:
        process(store, df, n)

    return samples.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
