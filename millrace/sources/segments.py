"""A log of Arrow segments, a format that Spark has no source for: read whole, by key, or as a stream from an offset.

A log is a folder. `data` holds segments, files of the Arrow stream format; `batches` one file a batch, which names the
batch's segments with the bounds of their keys. A batch counts once its file is there, and that appears in one rename:
segments of broken or repeated attempts are named by none. A stream's offset is the number of the last batch read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: A segment ends after so many rows, and a task reads segments of so many bytes together.
SEGMENT_ROWS, TASK_BYTES = 200_000, 64 << 20
_WRITTEN = "name string, rows long, bytes long, low long, high long"


def _batch_files(path: str) -> dict[int, str]:
    store, folder = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(f"{folder}/batches", allow_not_found=True))
    return {int(f.base_name.removesuffix(".json")): f.path for f in found if f.base_name.endswith(".json")}


def _load(path: str, file: str) -> dict:
    store, _ = fs.FileSystem.from_uri(path)
    with store.open_input_stream(file) as f:
        return json.loads(f.read())


def append(df: DataFrame, path: str, key: str, batch_id: int, segment_rows: int = SEGMENT_ROWS) -> None:
    """Adds df to the log as a batch, without a shuffle: each task writes segments of what it has.

    A batch that is there already is passed over, so a repeated attempt of `foreachBatch` changes nothing. Batches come
    in the order of their ids from one writer; a lower id than the last raises ValueError, as do another schema than the
    log's, a negative id and a key that is no whole number. Null keys are kept. A batch may have no rows. The driver
    holds a line a segment, as Spark does of files. path is a URI that driver and executors reach by pyarrow.
    """
    if not isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{key} is no whole number")
    if batch_id < 0 or segment_rows < 1:
        raise ValueError("a batch's id is 0 at least, and a segment has a row")
    there = _batch_files(path)
    if batch_id in there:
        return
    if there:
        last = max(there)
        if batch_id < last:
            raise ValueError(f"batch {batch_id} comes after batch {last}")
        before = _load(path, there[last])
        if before["fields"] != _fields(df.schema) or before["key"] != key:
            raise ValueError("the log has another schema or key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(f"{folder}/data", recursive=True)
        sink = writer = None
        rows, lows, highs = 0, [], []

        def closed() -> pa.RecordBatch:
            writer.close()
            size = sink.tell()
            sink.close()
            found = [[name], [rows], [size], [min(lows, default=None)], [max(highs, default=None)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, [pa.string()] + [pa.int64()] * 4, strict=True)], names=["name", "rows", "bytes", "low", "high"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if writer is None:
                    name = f"{uuid.uuid4().hex}.arrows"
                    sink = store.open_output_stream(f"{folder}/data/{name}", compression=None)
                    writer = ipc.new_stream(sink, batch.schema, options=ipc.IpcWriteOptions(compression="zstd"))
                    rows, lows, highs = 0, [], []
                part = batch.slice(at, segment_rows - rows)
                bounds = pc.min_max(part.column(part.schema.get_field_index(key))).as_py()
                if bounds["min"] is not None:
                    lows, highs = [min([*lows, bounds["min"]])], [max([*highs, bounds["max"]])]
                writer.write_batch(part)
                rows, at = rows + part.num_rows, at + part.num_rows
                if rows >= segment_rows:
                    yield closed()
                    writer = None
        if writer is not None:
            yield closed()

    segments = [r.asDict() for r in df.mapInArrow(run, _WRITTEN).collect()]
    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(f"{folder}/batches", recursive=True)
    name = f"{folder}/batches/{batch_id:020d}.json"
    opened = f"{name}.{uuid.uuid4().hex}.open"
    with store.open_output_stream(opened, compression=None) as f:
        f.write(json.dumps({"fields": _fields(df.schema), "key": key, "segments": segments}).encode())
    store.move(opened, name)


def _fields(schema: T.StructType) -> list[dict]:
    return [{"name": f.name, "type": f.dataType.jsonValue()} for f in schema.fields]


class _Task(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Log:
    """What both readers share: which segments there are, dealt to tasks, and their rows."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def _tasks(self, segments: list[dict]) -> list[_Task]:
        tasks, names, size = [], [], 0
        for s in segments:
            if names and size + s["bytes"] > TASK_BYTES:
                tasks.append(_Task(names))
                names, size = [], 0
            names.append(s["name"])
            size += s["bytes"]
        return [*tasks, _Task(names)] if names or not tasks else tasks

    def read(self, partition: _Task) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(self.path)
        for name in partition.names:
            with store.open_input_file(f"{folder}/data/{name}") as f:
                names = ipc.open_stream(f).schema.names
                f.seek(0)
                wanted = ipc.IpcReadOptions(included_fields=[names.index(c) for c in self.columns])
                for batch in ipc.open_stream(f, options=wanted):
                    yield batch.select(self.columns)


class _Reader(_Log, DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        super().__init__(path, columns)
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        # Each is given back, too: bounds leave out segments, not rows.
        self.tests = [f for f in filters if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual)) and len(f.attribute) == 1]
        return iter(filters)

    def partitions(self) -> list[_Task]:
        files = _batch_files(self.path)
        kept = []
        for n in sorted(files):
            batch = _load(self.path, files[n])
            tests = [f for f in self.tests if f.attribute[0].lower() == batch["key"].lower()]
            kept += [s for s in batch["segments"] if all(_may_hold(s, f) for f in tests)]
        return self._tasks(kept)


def _may_hold(segment: dict, test: Filter) -> bool:
    low, high = segment["low"], segment["high"]
    if low is None:
        return False  # Null keys alone, which no comparison holds for.
    match test:
        case EqualTo(value=v):
            return v is not None and low <= v <= high
        case In(value=vs):
            return any(v is not None and low <= v <= high for v in vs)
        case GreaterThan(value=v):
            return high > v
        case GreaterThanOrEqual(value=v):
            return high >= v
        case LessThan(value=v):
            return low < v
        case LessThanOrEqual(value=v):
            return low <= v
    return True


class _StreamReader(_Log, DataSourceStreamReader):
    def __init__(self, path: str, columns: list[str], after: int):
        super().__init__(path, columns)
        self.after = after

    def initialOffset(self) -> dict:
        return {"batch": self.after}

    def latestOffset(self) -> dict:
        return {"batch": max(_batch_files(self.path), default=self.after)}

    def partitions(self, start: dict, end: dict) -> list[_Task]:
        files = _batch_files(self.path)
        within = [n for n in sorted(files) if start["batch"] < n <= end["batch"]]
        return self._tasks([s for n in within for s in _load(self.path, files[n])["segments"]])


class SegmentLog(DataSource):
    """Format `segments`. Options: path; columns (by commas, all by default), the only ones that are decoded; afterBatch,
    the batch after which a new stream begins (-1, the first one, by default)."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> T.StructType:
        files = _batch_files(self.options["path"])
        if not files:
            raise ValueError("the log has no batch")
        fields = _load(self.options["path"], files[max(files)])["fields"]
        whole = T.StructType.fromJson({"type": "struct", "fields": [f | {"nullable": True, "metadata": {}} for f in fields]})
        wanted = [c for c in self.options.get("columns", "").split(",") if c] or whole.names
        return T.StructType([whole[c] for c in wanted])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], schema.names)

    def streamReader(self, schema: T.StructType) -> _StreamReader:
        return _StreamReader(self.options["path"], schema.names, int(self.options.get("afterBatch", "-1")))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SegmentLog)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All rows of a log that has a batch. Filters on the key leave out the segments whose bounds are outside."""
    register(spark)
    return spark.read.format("segments").option("columns", ",".join(columns or [])).load(path)


def read_stream(spark: SparkSession, path: str, columns: list[str] | None = None, after_batch: int = -1) -> DataFrame:
    """The rows of a log as a stream, those of batches to come included; what was read is in the stream's checkpoint."""
    register(spark)
    return spark.readStream.format("segments").option("columns", ",".join(columns or [])).option("afterBatch", str(after_batch)).load(path)
