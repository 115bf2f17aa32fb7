"""A streaming source over the commit log, by position: catch-up first, then new commits as they are published.

The driver's side reads the manifests since the last offset only; executors read the Parquet files whose positions a micro-batch covers. Offsets are
positions that are safe by construction, since a commit allots its positions when it is published.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from weftlog.sources import schema

NAME = "weftlog_positions"
#: Rows that a reader of a file holds at a time, and bytes of a column's chunk that it fetches at once.
ROWS, BUFFER = 8192, 1 << 20


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root.removeprefix("file:"))


def _read(fs: pafs.FileSystem, name: str) -> dict[str, Any] | None:
    """A JSON file; None if there is none."""
    if fs.get_file_info(name).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(name) as f:
        return json.loads(f.read())


def manifests(root: str, after: int = 0, upto: int | None = None) -> Iterator[dict[str, Any]]:
    """Manifests of a log's folder after a commit, in order, up to one or to the newest."""
    fs, path = _opened(root)
    while (upto is None or after < upto) and (found := _read(fs, f"{path}/_log/{after + 1:020d}.json")):
        yield found
        after += 1


def last_checkpoint(root: str) -> dict[str, Any]:
    """The state that the log's last checkpoint holds, or that of an empty log."""
    fs, path = _opened(root)
    name = f"{path}/_checkpoints/last"
    if fs.get_file_info(name).type == pafs.FileType.File:
        with fs.open_input_stream(name) as f:
            if found := _read(fs, f"{path}/_checkpoints/{f.read().decode()}"):
                return found
    return {"commit_id": 0, "last_position": 0, "folders": {"events": []}, "ranges": {}}


def _groups(meta: pq.FileMetaData, low: int, high: int) -> list[int]:
    """The groups of rows that may hold positions after ``low`` up to ``high``, by their statistics where there are any."""
    out = []
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        found = next(c.statistics for c in map(group.column, range(group.num_columns)) if c.path_in_schema == "global_position")
        if not (found and found.has_min_max) or found.max > low and found.min <= high:
            out.append(g)
    return out


class _Slice(InputPartition):
    def __init__(self, folder: str, file: str, low: int, high: int) -> None:
        self.folder, self.file, self.low, self.high = folder, file, low, high


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.start = options["path"].rstrip("/"), int(options.get("after", "0"))
        self.seen: dict[str, int] | None = None

    def initialOffset(self) -> dict[str, int]:
        return {"position": self.start, "commit": 0}

    def latestOffset(self) -> dict[str, int]:
        """Manifests after those seen before only; the first time, after the last checkpoint."""
        if self.seen is None:
            found = last_checkpoint(self.root)
            self.seen = {"position": found["last_position"], "commit": found["commit_id"]}
        for m in manifests(self.root, self.seen["commit"]):
            self.seen = {"position": m["last_position"], "commit": m["commit_id"]}
        return {"position": max(self.start, self.seen["position"]), "commit": self.seen["commit"]}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[_Slice]:
        """Files that may hold positions of the range: manifests after the start's commit name them, since a folder that
        replaces others has their positions; a start without a commit begins at the last checkpoint that is not after the end."""
        live: dict[str, list[int]] = {}
        first = start["commit"]
        if not first and (found := last_checkpoint(self.root))["commit_id"] <= end["commit"]:
            first = found["commit_id"]
            live = {f: found["ranges"].get(f, [1, found["last_position"]]) for f in found["folders"]["events"]}
        for m in manifests(self.root, first, end["commit"]):
            for gone in m.get("replaced", {}).get("events", ()):
                live.pop(gone, None)
            for folder in m.get("folders", {}).get("events", ()):
                live[folder] = m.get("ranges", {}).get(folder, [1, m["last_position"]])
        fs, path = _opened(self.root)
        out = []
        for folder, (low, high) in live.items():
            if low <= end["position"] and high > start["position"]:
                for f in fs.get_file_info(pafs.FileSelector(f"{path}/{folder}")):
                    if f.path.endswith(".parquet"):
                        out.append(_Slice(self.root, f.path, start["position"], end["position"]))
        return out

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        """A file's rows batch by batch: a commit may leave all of a partition in one file, and in one group of rows."""
        fs, _ = _opened(partition.folder)
        with fs.open_input_file(partition.file) as source:
            file = pq.ParquetFile(source, buffer_size=BUFFER, pre_buffer=False, coerce_int96_timestamp_unit="us")
            groups = _groups(file.metadata, partition.low, partition.high)
            for batch in file.iter_batches(ROWS, groups, schema.EVENT_COLUMNS, use_threads=False) if groups else ():
                at = batch["global_position"]
                rows = batch.filter(pc.and_(pc.greater(at, partition.low), pc.less_equal(at, partition.high)))
                if rows.num_rows:
                    columns = (rows[n].cast(pa.timestamp("us", "UTC")) if n in ("time", "created_at") else rows[n] for n in schema.EVENT_COLUMNS)
                    yield pa.RecordBatch.from_arrays(list(columns), schema.EVENT_COLUMNS)

    def commit(self, end: dict[str, int]) -> None:
        pass


class PositionSource(DataSource):
    """``spark.readStream.format("weftlog_positions").option("after", n).load(<folder of the log>)``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return T.StructType([f for name in schema.EVENT_COLUMNS for f in schema.LOG.fields if f.name == name])

    def streamReader(self, schema: T.StructType) -> _Reader:
        return _Reader(dict(self.options))


def stream(spark: SparkSession, root: str, after: int = 0) -> DataFrame:
    """New and old events after a position as a streaming DataFrame of clean data (neither decrypted nor upcast)."""
    spark.dataSource.register(PositionSource)
    return spark.readStream.format(NAME).option("after", str(after)).load(root)
