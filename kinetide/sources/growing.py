"""Recordings that still grow, as a streaming data source.

The stream's offset is, for every file, the byte up to which frame starts have been read. A start counts as ready once a whole
frame would fit behind it, so a frame that is still being written waits for the next trigger, and whether a start is accepted
depends only on bytes that no longer change. Offsets live in the query's checkpoint: after a restart each frame comes once.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from kinetide.sources import packets


@dataclass
class ByteRange(InputPartition):
    path: str
    begin: int
    stop: int

    def __init__(self, path: str, begin: int, stop: int):
        self.path, self.begin, self.stop = path, begin, stop


class GrowingRecordings(DataSource):
    """Options: path (a folder, searched with its subfolders), kind (imu, emg, eda), chunk (bytes a task reads at most).

    Columns: path, session_id, file_offset and the payload columns of the kind. An offset names every file of the folder, so
    finished recordings should be moved away before they are many.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_recordings"

    def schema(self) -> str:
        frame = packets.FRAMES[self.options.get("kind", "imu")]
        return "path string, session_id string, file_offset long, " + ", ".join(f"{n} {t}" for n, t in packets._columns(frame))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(self.options["path"], self.options.get("kind", "imu"), int(self.options.get("chunk", packets.CHUNK_BYTES)))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, root: str, kind: str, chunk: int):
        self.root, self.frame, self.chunk = root, packets.FRAMES[kind], chunk

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, path = fs.FileSystem.from_uri(self.root) if ":/" in self.root else (fs.LocalFileSystem(), self.root)
        prefix = self.root[:len(self.root) - len(path)] if self.root.endswith(path) else "file://"
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return {f"{prefix or 'file://'}{f.path}": f.size - self.frame.length + 1 for f in found if f.path.endswith(".bin") and f.size >= self.frame.length}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        return [ByteRange(path, a, min(a + self.chunk, stop)) for path, stop in sorted(end.items()) for a in range(start.get(path, 0), stop, self.chunk)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        size = partition.stop + self.frame.length - 1
        data, low, pos, _, _ = packets.scan(packets._open(partition.path), size, partition.begin, partition.stop, [self.frame])
        session = partition.path.rsplit("/", 1)[-1].removesuffix(".bin")
        for i in range(0, len(pos), packets.ROWS_PER_BATCH):
            rows = packets._unpack(data, low, pos[i:i + packets.ROWS_PER_BATCH], self.frame)
            names = ["file_offset", *[n for n, _ in packets._columns(self.frame)]]
            columns = [pa.array([partition.path] * len(rows)), pa.array([session] * len(rows)), pa.array(rows["file_offset"].to_numpy(np.int64)), *[pa.array(rows[n].to_numpy()) for n in names[1:]]]
            yield pa.RecordBatch.from_arrays(columns, ["path", "session_id", *names])


def stream_growing(spark: SparkSession, root: str, kind: str = "imu", chunk: int = packets.CHUNK_BYTES) -> DataFrame:
    """Frames of one kind of all recordings below root, and of what is appended to them later."""
    spark.dataSource.register(GrowingRecordings)
    return spark.readStream.format("growing_recordings").options(path=root, kind=kind, chunk=chunk).load()
