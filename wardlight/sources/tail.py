"""Tails as streaming sources: files that grow line by line, and the shared log with its late rows.

Both are Python data sources of Structured Streaming. Offsets say all that a restart needs, so a query goes on from its
checkpoint alone; files are opened by ``pyarrow.fs``, in the planner for their ends and in tasks for their rows.
"""

from __future__ import annotations

import io
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timezone

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .ledger import hadoop_path

#: Bytes before an offset that must still be there, bytes that a task reads, and bytes that are searched for a line end at once.
CHECK, SPLIT, STEP = 64, 64 << 20, 1 << 16
#: How far behind the newest stamp the shared log is read again.
LAG_MS = 300_000


def _open(root: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")


def _files(root: str) -> tuple[pa.fs.FileSystem, list[pa.fs.FileInfo]]:
    fs, path = _open(root)
    found = fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True, recursive=True))
    own = lambda f: f.path[len(path) :].split("/")
    return fs, sorted((f for f in found if f.is_file and not any(p.startswith(("_", ".")) for p in own(f) if p)), key=lambda f: f.path)


def _line_end(file, size: int, low: int) -> int:
    """The place behind the last line end of file[low:size]; low if there is none."""
    high = size
    while high > low:
        begin = max(low, high - STEP)
        file.seek(begin)
        at = file.read(high - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        high = begin
    return low


def _before(file, at: int) -> str:
    """The last CHECK bytes before a place, in hex."""
    begin = max(0, at - CHECK)
    file.seek(begin)
    return file.read(at - begin).hex()


@dataclass
class LineRange(InputPartition):
    """Lines of a file that begin in [begin, end). ``size`` and ``check`` are those of the offset that the batch ends with."""

    path: str
    begin: int
    end: int
    first: bool
    reset: bool
    size: int
    check: str


class LineTail(DataSource):
    """Whole lines of the files below ``path`` as they are appended: (file, at, reset, value).

    An offset has for each file the place behind its last whole line and the bytes before it. A file whose bytes there
    have changed (rewritten, truncated, replaced) is read from its start again: its rows are marked ``reset``, and a row
    without value at -1 announces them, also if nothing is left or the file is gone. A line without its end isn't read yet.
    """

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "file string, at long, reset boolean, value string"

    def streamReader(self, schema) -> LineTailReader:
        return LineTailReader(self.options["path"])


class LineTailReader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root
        self.looked: dict[str, tuple] = {}  # what a file was like at the last look

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, files = _files(self.root)
        out, looked = {}, {}
        for f in files:
            state, known = (f.size, f.mtime_ns), self.looked.get(f.path)
            if known is None or known[0] != state:
                with fs.open_input_file(f.path) as file:
                    end = _line_end(file, f.size, 0)
                    known = state, {"end": end, "check": _before(file, end)}
            looked[f.path] = known
            out[f.path] = known[1]
        self.looked = looked
        return out

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        fs, _ = _files(self.root)
        out = [LineRange(path, 0, 0, True, True, 0, "") for path in start if path not in end and start[path]["end"]]
        for path, now in end.items():
            before = start.get(path, {"end": 0, "check": ""})
            if before == now:
                continue
            begin, reset = before["end"], False
            if begin > now["end"] or not self._holds(fs, path, before):
                begin, reset = 0, True
            cuts = [*range(begin, now["end"], SPLIT), now["end"]] if now["end"] > begin else [begin, begin]
            out += [LineRange(path, a, b, a == begin, reset, now["end"], now["check"]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a or reset]
        return out

    @staticmethod
    def _holds(fs, path: str, offset: dict) -> bool:
        try:
            with fs.open_input_file(path) as file:
                return _before(file, offset["end"]) == offset["check"] if file.size() >= offset["end"] else False
        except FileNotFoundError:
            return False

    def read(self, part: LineRange) -> Iterator[pa.RecordBatch]:
        batch = lambda rows: pa.RecordBatch.from_pydict({"file": pa.array([part.path] * len(rows), pa.string()), "at": pa.array([a for a, _ in rows], pa.int64()), "reset": pa.array([part.reset] * len(rows), pa.bool_()), "value": pa.array([v for _, v in rows], pa.string())})
        if part.reset and part.first:
            yield batch([(-1, None)])
        if part.end == part.begin:
            return
        fs, _ = _open(self.root)
        try:
            file = fs.open_input_file(part.path)
        except FileNotFoundError:
            return  # gone since; the next batch says so
        with file:
            if file.size() < part.size or _before(file, part.size) != part.check:
                return  # rewritten since; the next batch starts it anew
            file, at = io.BufferedReader(file, 1 << 20), part.begin
            if not part.first:  # a line that began before belongs to the range before
                file.seek(part.begin - 1)
                at = part.begin - 1 + len(file.readline())
            file.seek(at)
            rows: list[tuple[int, str]] = []
            held = 0
            while at < part.end:
                line = file.readline()
                text = line.decode().rstrip("\r\n")
                if text.strip():
                    rows.append((at, text))
                at, held = at + len(line), held + len(line)
                if held >= 1 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


@dataclass
class LogFile(InputPartition):
    path: str
    floor: int | None


class LogTail(DataSource):
    """The shared log below ``path`` (Parquet of envelopes) behind a cursor: (uid, ledger, writer, written_at, record, floor).

    An offset is the newest written_at, the largest uid with it, the wall clock at the time of the look and what files there were. A batch
    reads everything from ``floor`` on, ``lag_ms`` before the older of the last cursor's stamp and clock, so late rows
    within the lag are seen, and a stamp in the future doesn't move the window past honest ones. The first batch
    reads all (floor null). Files whose statistics end before the floor aren't opened.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "uid string, ledger string, writer string, written_at timestamp, record string, floor long"

    def streamReader(self, schema) -> LogTailReader:
        return LogTailReader(self.options["path"], int(self.options.get("lag_ms", LAG_MS)))


def _millis(value) -> int:
    """Of a value of a timestamp column, rounded down."""
    return pa.scalar(value.replace(tzinfo=value.tzinfo or timezone.utc), pa.timestamp("us", "UTC")).value // 1000


def _counted(column) -> bool:
    """Whether a column of a row group has its extremes; INT96, which Spark writes for timestamps unless told otherwise, never has."""
    return column.physical_type != "INT96" and column.statistics is not None and column.statistics.has_min_max


class LogTailReader(DataSourceStreamReader):
    def __init__(self, root: str, lag_ms: int):
        self.root, self.lag_ms = root, lag_ms
        self.tops: dict[tuple, tuple[int, str] | None] = {}  # by file: its newest stamp, and the uid there

    def _top(self, fs, f) -> tuple[int, str] | None:
        """The newest stamp of a file and its largest uid: from its statistics, or by one look at these columns in files that have none for them."""
        key = (f.path, f.size, f.mtime_ns)
        if key not in self.tops:
            file = pq.ParquetFile(fs.open_input_file(f.path))
            meta = file.metadata
            names = [meta.schema.column(i).path for i in range(meta.num_columns)]
            stamps = names.index("written_at")
            if all(_counted(meta.row_group(g).column(stamps)) and _counted(meta.row_group(g).column(names.index("uid"))) for g in range(meta.num_row_groups)):
                groups = [[meta.row_group(g).column(names.index(c)).statistics.max for c in ("written_at", "uid")] for g in range(meta.num_row_groups) if meta.row_group(g).num_rows]
            else:
                groups = [[pa.compute.max(b.column(i)).as_py() for i in (0, 1)] for b in file.iter_batches(columns=["written_at", "uid"]) if len(b)]
            self.tops[key] = max(((_millis(t), u or "") for t, u in groups if t is not None), default=None)
        return self.tops[key]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, files = _files(self.root)
        tops = [t for t in (self._top(fs, f) for f in files) if t is not None]
        if not tops:
            return {}
        stamp, uid = max(tops)
        # the clock moves with the files only, so that a quiet log makes no batches
        seen = {"files": len(files), "bytes": sum(f.size for f in files), "changed": max(f.mtime_ns for f in files)}
        return {"written_at": stamp, "uid": uid, "clock": seen["changed"] // 1_000_000, **seen}

    def partitions(self, start: dict, end: dict) -> list[LogFile]:
        if start == end:
            return []
        floor = min(start["written_at"], start["clock"], int(time.time() * 1000)) - self.lag_ms if start else None
        fs, files = _files(self.root)
        return [LogFile(f.path, floor) for f in files if (top := self._top(fs, f)) is not None and (floor is None or top[0] >= floor)]

    def read(self, part: LogFile) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.root)
        with fs.open_input_file(part.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=["uid", "ledger", "writer", "written_at", "record"], batch_size=8192):
                table = pa.Table.from_batches([batch]).select(["uid", "ledger", "writer", "written_at", "record"])
                table = table.set_column(3, "written_at", table["written_at"].cast(pa.timestamp("us"), safe=False).cast(pa.timestamp("us", "UTC")))
                if part.floor is not None:
                    table = table.filter(pa.compute.greater_equal(table["written_at"], pa.scalar(part.floor * 1000, pa.timestamp("us", "UTC"))))
                table = table.append_column("floor", pa.array([part.floor] * len(table), pa.int64()))
                yield from table.combine_chunks().to_batches()


def tail_lines(spark: SparkSession, path: str) -> DataFrame:
    """The stream of a folder's lines."""
    spark.dataSource.register(LineTail)
    return spark.readStream.format("line_tail").option("path", path).load()


def tail_log(spark: SparkSession, path: str, lag_ms: int = LAG_MS) -> DataFrame:
    """The stream of the shared log's windows."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", path).option("lag_ms", lag_ms).load()


def _store(stream: DataFrame, target: str, checkpoint: str, interval: str | None):
    """Each batch becomes a folder of its own number, so one that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def mirror_lines(spark: SparkSession, path: str, target: str, checkpoint: str, interval: str | None = None):
    """Keeps ``target`` up to date with a folder of growing files; every ``interval``, or once what is there now."""
    return _store(tail_lines(spark, path), target, checkpoint, interval)


def mirror_log(spark: SparkSession, path: str, target: str, checkpoint: str, interval: str | None = None, lag_ms: int = LAG_MS):
    return _store(tail_log(spark, path, lag_ms), target, checkpoint, interval)


_LINES = "file string, at long, reset boolean, value string, batch long"
_LOG = "uid string, ledger string, writer string, written_at timestamp, record string, floor long, batch long"


def _mirror(spark: SparkSession, target: str, schema: str) -> DataFrame:
    fs, path = hadoop_path(spark, target)
    return spark.read.schema(schema).parquet(target) if fs.exists(path) else spark.createDataFrame([], schema)


def lines(spark: SparkSession, target: str) -> DataFrame:
    """(file, at, value): what the mirrored files hold now. Of a file that was started anew, only rows since."""
    rows = _mirror(spark, target, _LINES)
    anew = rows.where("reset and value is null").groupBy(F.col("file").alias("_f")).agg(F.max("batch").alias("_since"))
    return rows.join(anew, F.col("file") == F.col("_f"), "left").where("value is not null and batch >= coalesce(_since, -1)").select("file", "at", "value")


def log_rows(spark: SparkSession, target: str) -> DataFrame:
    """The mirrored log, in the columns of an envelope: every batch replaces the window that it has read, older rows stay.

    A row counts if no later batch has read the time that it stands in; so it is dropped, with the window, if it was
    taken back, and a late row stands where it belongs.
    """
    rows = _mirror(spark, target, _LOG)
    floors = rows.groupBy("batch").agg(F.min("floor").alias("floor"))  # a row a batch
    later = F.min("floor").over(Window.orderBy(F.desc("batch")).rowsBetween(Window.unboundedPreceding, -1))
    bounds = floors.select(F.col("batch").alias("_b"), later.alias("_until"))
    live = rows.join(bounds, F.col("batch") == F.col("_b")).where("_until is null or unix_millis(written_at) < _until")
    return live.select("uid", "ledger", "writer", "written_at", "record").dropDuplicates(["uid"])


def compact(spark: SparkSession, target: str, log: bool) -> None:
    """Writes what counts of all finished batches into the newest of them, while no query writes to the mirror; the rest goes.

    The newest batch is replaced by renames, so a crash leaves the old state or a copy of it under a name that readers skip.
    """
    now = (log_rows if log else lines)(spark, target)
    rows = _mirror(spark, target, _LOG if log else _LINES)
    last = rows.agg(F.max("batch").alias("b")).first()["b"]
    if last is None:
        return
    whole = now.withColumn("floor", F.lit(None).cast("long")) if log else now.select("file", "at", F.lit(False).alias("reset"), "value")
    fs, root = hadoop_path(spark, target)
    fresh, place = (spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{x}") for x in ("_compacted", f"batch={last}"))
    whole.write.mode("overwrite").parquet(f"{target}/_compacted")
    old = [s.getPath() for s in fs.listStatus(root) if str(s.getPath().getName()).startswith("batch=") and str(s.getPath().getName()) != f"batch={last}"]
    fs.delete(place, True)
    fs.rename(fresh, place)
    for path in old:
        fs.delete(path, True)
