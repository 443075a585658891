"""Python data sources: a byte-offset tail of growing JSONL files, read-only SQLite tables, and a poll of one that changes in place.

    tail(spark, root, start="latest")                     # streaming lines of JSONL files
    usage_rows(spark, db)                                 # streaming rows of a usage table
    spark.dataSource.register(SqliteTable); spark.read.format("sqlite_table").option("path", db).option("table", t).schema(s).load()

The driver decides which byte ranges are new, from file sizes and the last newline; executors read them. Files lie where
all of them can open them.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, SimpleDataSourceStreamReader

from meterlake.functions.schema import TERMINAL
from meterlake.operators.profile import LOOKBACK_MS

#: Bytes of a file that one task reads at a time; lines that begin in them number less than LINES.
READ, LINES = 8 << 20, 1 << 23
LINE = "path string, file_hash string, offset long, end_offset long, value string, baseline_mode string, pos long"


def file_hash(path: str) -> str:
    return hashlib.sha256(os.path.abspath(path).replace("\\", "/").lower().encode()).hexdigest()[:16]


def range_lines(path: str, begin: int, start: int, end: int, stop: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, end offset, line) of the lines that begin from start up to end, in a range of whole lines from begin to stop."""
    with open(path, "rb") as f:
        if start > begin:
            f.seek(start - 1)
            at = start - 1 + len(f.readline())
        else:
            f.seek(start)
            at = start
        while at < end:
            line = f.readline()
            if not line.endswith(b"\n") or at + len(line) > stop:
                return
            yield at, at + len(line), line[:-1].rstrip(b"\r")
            at += len(line)


def safe_end(path: str, limit: int | None = None) -> int:
    """The offset after the last newline within the limit."""
    size = os.path.getsize(path) if limit is None else min(limit, os.path.getsize(path))
    with open(path, "rb") as f:
        while size > 0:
            start = max(0, size - 65_536)
            f.seek(start)
            at = f.read(size - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            size = start
    return 0


def lines_back(path: str, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, end offset, line) of the lines before the offset (the end of a line), the last one first; memory: a block and a line."""
    with open(path, "rb") as f:
        rest: list[bytes] = []  # what is read of the line that began before, its last part first
        stop, at = end, end
        while at > 0:
            start = max(0, at - READ)
            f.seek(start)
            data = f.read(at - start)
            upto = len(data)
            while (cut := data.rfind(b"\n", 0, upto)) >= 0:
                line = b"".join([data[cut + 1 : upto], *reversed(rest)])
                if start + cut + 1 < stop:
                    yield start + cut + 1, stop, line.rstrip(b"\r\n")
                rest, stop, upto = [], start + cut + 1, cut
                rest.append(data[cut : cut + 1])
            rest.append(data[:upto])
            at = start
        if stop:
            yield 0, stop, b"".join(reversed(rest)).rstrip(b"\r\n")


def is_token_count(line: bytes) -> bool:
    """Whether parse_rollouts() finds a snapshot of the counters in the line."""
    if b"token_count" not in line:
        return False
    try:
        record = json.loads(line)
        at = record["payload"]
        return record["type"] == "event_msg" and at["type"] == "token_count" and isinstance(at["info"]["total_token_usage"], dict) and isinstance(record["timestamp"], str)
    except (ValueError, KeyError, TypeError):
        return False


class JsonlTail(DataSource):
    """New byte ranges of growing files, for tail(). Options: path; pattern (*.jsonl); start: `earliest`, or `latest` to skip
    what is there at the start; truncated: `end` to go on after the last line of a file that has shrunk, or `start` to read
    it again; baselines: `true` to give the last token_count record before where a file is attached or has shrunk."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "path string, file_hash string, begin long, start long, end long, stop long, baseline boolean, nth long"

    def simpleStreamReader(self, schema) -> JsonlTailReader:
        return JsonlTailReader(self.options)


class JsonlTailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.pattern = options["path"], options.get("pattern", "*.jsonl")
        self.latest, self.rewind = options.get("start", "earliest") == "latest", options.get("truncated", "end") == "start"
        self.baselines = options.get("baselines", "true") == "true"

    def files(self) -> list[str]:
        found = glob.glob(os.path.join(self.root, "**", self.pattern), recursive=True)
        return sorted(found, key=lambda p: (os.path.getmtime(p), p))

    def initialOffset(self) -> dict:
        """Files there at the start are skipped with `latest`; one that can't be read yet is skipped once it can."""
        out: dict[str, int] = {}
        for p in self.files() if self.latest else ():
            try:
                end = safe_end(p)
                out[p] = -1 - end if end else 0  # below -1: attached there, baseline not yet given
            except OSError:
                out[p] = -1
        return out

    def _ranges(self, path: str, start: int, end: int) -> Iterator[tuple]:
        for at in range(start, end, READ):
            yield path, file_hash(path), start, at, min(at + READ, end), end, False

    def _warm(self, path: str, end: int) -> Iterator[tuple]:
        """The last token_count record before the offset, as a baseline that adds nothing."""
        for a, b, line in lines_back(path, end) if self.baselines else ():
            if is_token_count(line):
                yield path, file_hash(path), a, a, b, b, True
                return

    def _step(self, path: str, at: int, stop: int) -> Iterator[tuple]:
        """What a file gives between two offsets; the same when a batch is read again."""
        if at == -1 or (0 <= stop < abs(at) - (at < 0) and not self.rewind):
            yield from self._warm(path, stop)
            return
        attached, at = at < 0, -1 - at if at < 0 else at
        if stop < at:
            attached, at = False, 0
        if attached:
            yield from self._warm(path, at)
        yield from self._ranges(path, at, stop)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows: list[tuple] = []
        end = dict(start)
        for path in self.files():
            try:
                at, stop = start.get(path, 0), safe_end(path)
                if os.path.getsize(path) >= abs(at) - (at < 0) and at != -1:
                    stop = max(stop, -1 - at if at < 0 else at)
                rows += self._step(path, at, stop) if stop != at else ()
                end[path] = stop
            except OSError:  # unreadable just now: the state stays and the file is read later
                continue
        return iter([r + (n,) for n, r in enumerate(rows)]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """Replay of a batch after a restart: the same bytes give the same rows, baselines included."""
        rows = (r for path, stop in end.items() if stop >= 0 and start.get(path, 0) != stop for r in self._step(path, start.get(path, 0), stop))
        return iter([r + (n,) for n, r in enumerate(rows)])


def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of byte ranges; pos is the order of the ranges and of the lines within them."""
    names = ["path", "file_hash", "offset", "end_offset", "value", "baseline_mode", "pos"]
    for batch in batches:
        for r in batch.to_pylist():
            rows = [(r["path"], r["file_hash"], a, b, line.decode("utf-8", "replace"), "ReplayRestore" if r["baseline"] else None, r["nth"] * LINES + i) for i, (a, b, line) in enumerate(range_lines(r["path"], r["begin"], r["start"], r["end"], r["stop"]))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=names)


def tail(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The lines that are appended to files under a folder, as a stream; options of JsonlTail."""
    spark.dataSource.register(JsonlTail)
    ranges = spark.readStream.format("jsonl_tail").options(path=path, **options).load()
    return ranges.repartition(F.col("path"), F.col("start")).mapInArrow(read_ranges, LINE)


class UsageTail(DataSource):
    """A usage table whose rows change in place, polled. Options: path, table, start (`earliest` or `latest`), lookback_ms.

    Each poll reads rows from the watermark less the lookback on, in order of (completed_at, id), up to the first one whose
    status is unknown; the watermark is the largest completed_at that was consumed and never falls. With `latest`, what
    was final at the start is history and never read. A poll that finds the rows of the one before gives nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "usage_tail"

    def schema(self) -> str:
        return LINE

    def simpleStreamReader(self, schema) -> UsageTailReader:
        return UsageTailReader(self.options)


class UsageTailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.table, self.latest = options["path"], options.get("table", "model_usage"), options.get("start", "earliest") == "latest"
        self.lookback = int(options.get("lookback_ms", LOOKBACK_MS))

    def _query(self, sql: str, *values: object) -> list[dict]:
        import sqlite3

        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            db.row_factory = sqlite3.Row
            return [dict(r) for r in db.execute(sql, values)]
        finally:
            db.close()

    def initialOffset(self) -> dict:
        boundary = None
        if self.latest:
            try:
                boundary = self._query(f'SELECT max(completed_at) AS m FROM "{self.table}" WHERE status IN ({",".join("?" * len(TERMINAL))})', *TERMINAL)[0]["m"] or 0
            except Exception:  # noqa: BLE001  not there yet: the first poll that can read it sets the boundary
                boundary = -1
        return {"boundary": boundary, "watermark": boundary if boundary is not None and boundary >= 0 else 0, "digest": ""}

    def _rows(self, offset: dict) -> list[dict]:
        from meterlake.sources.logs import USAGE_ROW

        names = ", ".join(f'"{f.name}"' for f in USAGE_ROW)
        since = offset["watermark"] - self.lookback
        rows = self._query(f'SELECT {names} FROM "{self.table}" WHERE completed_at >= ? AND completed_at > ? ORDER BY completed_at, id', since, -1 if offset["boundary"] is None else offset["boundary"])
        known = [r["status"] in TERMINAL for r in rows]
        return rows[: known.index(False)] if False in known else rows

    def _lines(self, rows: list[dict]) -> Iterator[tuple]:
        key = file_hash(self.path)
        return iter([(self.path, key, None, None, json.dumps(r), None, n) for n, r in enumerate(rows)])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        import sqlite3

        try:
            if start["boundary"] == -1:
                start = self.initialOffset()
                return iter(()), start
            rows = self._rows(start)
        except sqlite3.Error:  # unavailable just now: nothing moves and the next poll reads again
            return iter(()), start
        digest = hashlib.sha256(json.dumps(rows).encode()).hexdigest() if rows else ""
        if digest == start["digest"]:
            return iter(()), start
        return self._lines(rows), start | {"watermark": max([start["watermark"], *(r["completed_at"] for r in rows)]), "digest": digest}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """Rows change in place, so a replay gives what they are now; finals are idempotent."""
        return self._lines([r for r in self._rows(start) if r["completed_at"] <= end["watermark"]]) if start != end else iter(())


def usage_rows(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The rows of a usage table as a stream, each as JSON in `value`; options of UsageTail."""
    spark.dataSource.register(UsageTail)
    return spark.readStream.format("usage_tail").options(path=path, **options).load()


class SqliteTable(DataSource):
    """Options: path, table, order (columns), pushdown (true: comparisons go to SQLite). The file is opened read-only."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        from meterlake.sources.logs import USAGE_ROW

        return USAGE_ROW

    def reader(self, schema) -> SqliteReader:
        return (PushingReader if self.options.get("pushdown", "false") == "true" else SqliteReader)(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.table = options["path"], options.get("table", "model_usage")
        self.order = options.get("order", "completed_at, id")
        self.columns = [f.name for f in schema]
        self.where: list[tuple[str, object]] = []

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # SQLite files have one writer and are small; a file is read by one task

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import sqlite3

        names = ", ".join('"' + c.replace('"', '""') + '"' for c in self.columns)
        sql = f'SELECT {names} FROM "{self.table}"' + (" WHERE " + " AND ".join(w for w, _ in self.where) if self.where else "") + f" ORDER BY {self.order}"
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            yield from db.execute(sql, [v for _, v in self.where])
        finally:
            db.close()


class PushingReader(SqliteReader):
    """Needs spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        signs = {GreaterThanOrEqual: ">=", GreaterThan: ">", EqualTo: "="}
        for f in filters:
            if type(f) in signs and len(f.attribute) == 1 and isinstance(f.value, (int, str)):
                self.where.append((f'"{f.attribute[0]}" {signs[type(f)]} ?', f.value))
            else:
                yield f
