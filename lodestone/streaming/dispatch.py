"""An event log as a streaming source, and a dispatcher that hands its events to several handlers, each from a bookmark of its own.

A log is a folder of segments, Parquet folders named by the offsets they hold: `segment=<first>-<next>`. The source plans a
batch as ranges of offsets, cut at segments and after a number of rows, and each task reads its range alone. A batch takes
at most `most` events past the last one's end, so a handler gets them in order, batch by batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lodestone.operators import events
from lodestone.sources import files
from lodestone.streaming.queries import subscribe

BATCH, RANGE = 100, 50_000  # events a batch, unless the caller says otherwise; events a task reads
BLOCK = 4 << 20  # bytes of a segment's row groups, of which a task reads those that its range touches


def segments(names: list[str]) -> list[tuple[int, int, str]]:
    """(first, next, name) of a log's segments in order; a gap or an overlap is an error."""
    out = sorted((*map(int, n.split("=")[1].split("-")), n) for n in names if n.startswith("segment="))
    for (_, a, _), (b, _, name) in zip(out, out[1:], strict=False):
        if a != b:
            raise ValueError(f"offset {a} is missing or doubled before {name}")
    return out


def append(rows: DataFrame, path: str, ts: str = "ts", id_col: str = "event_id") -> tuple[int, int]:
    """Appends events as one segment, numbered by time and id from the log's end on; returns its first and next offset. Readers see a segment whole or not at all; one writer at a time."""
    spark = rows.sparkSession
    with files.locked(spark, f"{path}/_writer"):
        held = segments(files.names(spark, path))
        first = held[-1][1] if held else 0
        staged = f"{path}/_segment-{uuid.uuid4().hex}"
        numbered = events.append_offsets(rows, first - 1, ts, id_col)
        numbered.repartitionByRange("offset").sortWithinPartitions("offset").write.option("parquet.block.size", BLOCK).parquet(staged)
        n = spark.read.parquet(staged).count()
        if n:
            files.rename(spark, staged, f"{path}/segment={first:020d}-{first + n:020d}")
        return first, first + n


class Range(InputPartition):
    def __init__(self, folder: str, first: int, end: int):
        super().__init__((folder, first, end))


class EventLog(DataSource):
    """Options: path, most (events a batch), rows (events a task), from (the offset that a new stream begins at). The reader names the schema."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_event_log"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return EventLogReader(dict(self.options), schema)


class EventLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.shape = options["path"], schema
        self.most, self.rows, self.at = int(options.get("most", BATCH)), int(options.get("rows", RANGE)), int(options.get("from", 0))
        self.first = self.at

    def _segments(self) -> list[tuple[int, int, str]]:
        fs, path = _filesystem(self.path)
        return segments(_names(fs, path))

    def initialOffset(self) -> dict:
        """Where a stream without a checkpoint begins; asked for after the first latestOffset."""
        return {"offset": self.first}

    def latestOffset(self) -> dict:
        """At most `most` events past what was planned last, which a restarted stream says by `from`."""
        held = self._segments()
        self.at = max(self.at, min(self.at + self.most, held[-1][1] if held else 0))
        return {"offset": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for first, after, name in self._segments():
            low, high = max(first, start["offset"]), min(after, end["offset"])
            out += [Range(f"{self.path}/{name}", a, min(a + self.rows, high)) for a in range(low, high, self.rows)]
        return out

    def read(self, partition: Range) -> Iterator:
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        folder, first, end = partition.value
        (fs, path), shape, offset = _filesystem(folder), to_arrow_schema(self.shape), ds.field("offset")
        form = ds.ParquetFileFormat(coerce_int96_timestamp_unit="us")
        for batch in ds.dataset(path, filesystem=fs, format=form).to_batches(columns=shape.names, filter=(offset >= first) & (offset < end)):
            yield batch.cast(shape)

    def commit(self, end: dict) -> None:
        """Nothing to give back: a log keeps its events."""


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _names(fs, path: str) -> list[str]:
    from pyarrow.fs import FileSelector, FileType

    return [f.base_name for f in fs.get_file_info(FileSelector(path, allow_not_found=True)) if f.type == FileType.Directory]


class Dispatcher:
    """Hands a log's events to handlers. Bookmarks and the keys that were handled lie below `state`, so another dispatcher goes on where this one stopped."""

    def __init__(self, spark: SparkSession, log: str, state: str, batch: int = BATCH, keep: int = 10_000):
        self.spark, self.log, self.state, self.batch, self.keep = spark, log, state.rstrip("/"), max(1, batch), keep
        self.handlers: dict[str, tuple[Column, Callable[[DataFrame], None], str]] = {}

    def register(self, name: str, handle: Callable[[DataFrame], None], wanted: Column | None = None) -> Dispatcher:
        """handle: gets each batch's wanted events that it hasn't had yet; it must bear to get a batch again whose end was not recorded."""
        if name in self.handlers or not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"{name} is registered, or no name")
        # A source for each: Spark changes a registered one's environment when its reader starts, which must not be while another handler's tasks are sent with it.
        source = f"{EventLog.name()}_{uuid.uuid4().hex}"
        self.spark.dataSource.register(type("HandlersLog", (EventLog,), {"name": classmethod(lambda _: source)}))
        self.handlers[name] = (F.lit(True) if wanted is None else wanted, handle, source)
        return self

    def bookmark(self, name: str) -> int:
        """The offset after the last batch that a handler is done with."""
        return self._recorded(name, done=True)

    def _recorded(self, name: str, done: bool) -> int:
        """The end of the last batch that is done, or planned, in a handler's stream."""
        base = f"{self.state}/{name}/checkpoint"
        batches = [int(n) for n in files.names(self.spark, f"{base}/{'commits' if done else 'offsets'}") if n.isdigit()]
        if not batches:
            return 0
        return json.loads(files.read_text(self.spark, f"{base}/offsets/{max(batches)}").split("\n")[-1])["offset"]

    def start(self, name: str):
        """A handler's stream, running until it is stopped."""
        wanted, handle, source = self.handlers[name]
        shape = self.spark.read.option("basePath", self.log).parquet(self.log).drop("segment").schema
        stream = self.spark.readStream.format(source).schema(shape).options(**{"path": self.log, "most": str(self.batch), "from": str(self._recorded(name, done=False))}).load()
        base = f"{self.state}/{name}"
        return subscribe(stream, wanted, handle, f"{base}/handled", f"{base}/checkpoint", self.keep, -(-self.batch // RANGE)).trigger(processingTime="0 seconds").queryName(f"dispatch-{name}-{uuid.uuid4().hex[:8]}").start()

    def poll(self) -> dict[str, int]:
        """Lets all handlers catch up with the log's present end, side by side; returns their bookmarks. A handler's error ends its own stream, and is raised when the others are done."""
        end = max((after for _, after, _ in segments(files.names(self.spark, self.log))), default=0)
        running, failed = {}, []
        if end:
            running = {name: self.start(name) for name in self.handlers if self.bookmark(name) < end}
        for name, query in running.items():
            try:
                query.processAllAvailable()
            except Exception as e:
                failed.append((name, e))
            finally:
                query.stop()
        if failed:
            raise RuntimeError(f"handler {failed[0][0]} failed at offset {self.bookmark(failed[0][0])}") from failed[0][1]
        return {name: self.bookmark(name) for name in self.handlers}
