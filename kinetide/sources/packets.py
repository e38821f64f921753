"""Framed binary recordings as tables.

A recording is a run of frames: start byte, type, payload, XOR checksum, end byte. Files are cut into byte ranges that
executors read on their own, so one huge file is decoded by many tasks without a shuffle. A scan that loses its place
moves on by one byte; a valid frame that starts inside an accepted frame is not a frame. A range looks back far enough
to know which frames were accepted before it.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinetide.sources.recordings import stem

# Fixed values of the frame formats.
START, END = 0xAA, 0xBB


@dataclass(frozen=True)
class Frame:
    kind: str
    code: int
    layout: tuple[tuple[str, str], ...]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(list(self.layout))

    @property
    def length(self) -> int:
        return self.dtype.itemsize


_HEAD = (("start", "u1"), ("type", "u1"), ("version", "u1"), ("timestamp_ms", "<u4"))
_TAIL = (("checksum", "u1"), ("end", "u1"))
IMU = Frame("imu", 1, _HEAD + tuple((c, "<i2") for c in ("accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z"))
            + (("ppg_ir", "<u4"), ("ppg_red", "<u4"), ("ambient_c", "<f4"), ("object_c", "<f4")) + _TAIL)
EMG = Frame("emg", 2, _HEAD + (("emg_raw", "<i2"),) + _TAIL)
EDA = Frame("eda", 3, _HEAD + (("eda_raw", "<i2"),) + _TAIL)
FRAMES = {f.kind: f for f in (IMU, EMG, EDA)}
SPARK_TYPES = {"u1": "short", "<u4": "long", "<i2": "short", "<f4": "float"}
CHUNK_BYTES = 32 << 20
MOST_TASKS = 100_000
LOOK_BACK = 64 << 10
ROWS_PER_BATCH = 200_000


def _columns(frame: Frame) -> list[tuple[str, str]]:
    return [(n, SPARK_TYPES[t]) for n, t in frame.layout if n not in ("start", "type", "checksum", "end")]


def _valid(data: np.ndarray, frames: Sequence[Frame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, lengths and frame numbers of everything that reads as a frame."""
    running = np.concatenate([[0], np.bitwise_xor.accumulate(data)]) if len(data) else np.zeros(1, np.uint8)
    starts = np.flatnonzero(data == START)
    found = []
    for number, frame in enumerate(frames):
        p = starts[starts + frame.length <= len(data)]
        p = p[data[p + 1] == frame.code]
        last = p + frame.length - 1
        good = (data[last] == END) & (data[last - 1] == running[last - 1] ^ running[p + 1])
        found.append(np.column_stack([p[good], np.full(good.sum(), frame.length), np.full(good.sum(), number)]))
    table = np.concatenate(found).astype(np.int64)
    table = table[np.argsort(table[:, 0], kind="stable")]
    return table[:, 0], table[:, 1], table[:, 2]


def _accepted(pos: np.ndarray, length: np.ndarray) -> np.ndarray:
    """First-come acceptance of overlapping frames; only clusters of overlaps are walked one by one."""
    keep = np.ones(len(pos), dtype=bool)
    if len(pos) < 2:
        return keep
    reach = np.maximum.accumulate(pos + length)
    tangled = np.concatenate([[False], pos[1:] < reach[:-1]])
    free = 0
    for i in np.flatnonzero(tangled):
        if not tangled[i - 1]:
            free = pos[i - 1] + length[i - 1]  # a cluster's first frame is always accepted
        keep[i] = pos[i] >= free
        if keep[i]:
            free = pos[i] + length[i]
    return keep


def scan(read: Callable[[int, int], bytes], size: int, begin: int, stop: int, frames: Sequence[Frame]):
    """Accepted frames and stray start bytes whose position lies in [begin, stop).

    Returns the bytes read, their offset in the file, and positions and frame numbers relative to those bytes, plus
    the positions of start bytes outside every accepted frame.
    """
    longest = max(f.length for f in frames)
    back = LOOK_BACK
    while True:
        low, high = max(0, begin - back), min(size, stop + longest - 1)
        data = np.frombuffer(read(low, high), dtype=np.uint8)
        pos, length, number = _valid(data, frames)
        here = begin - low
        reach = np.concatenate([[0 if low == 0 else longest - 1], pos + length])
        reach = np.maximum.accumulate(reach)
        clean = np.flatnonzero((pos >= reach[:-1]) & (pos <= here))
        before = int(np.searchsorted(pos, here))
        if low == 0:
            first = 0
        elif reach[before] <= here:
            first = before
        elif len(clean):
            first = int(clean[-1])
        else:
            back *= 4
            continue
        break
    pos, length, number = pos[first:], length[first:], number[first:]
    keep = _accepted(pos, length)
    pos, length, number = pos[keep], length[keep], number[keep]
    marks = np.flatnonzero(data == START)
    at = np.searchsorted(pos, marks, side="right") - 1
    covered = (at >= 0) & (marks < np.where(at >= 0, (pos + length)[np.maximum(at, 0)] if len(pos) else 0, 0))
    inside = lambda p: (p >= here) & (p < here + stop - begin)
    stray = marks[~covered & inside(marks)]
    mine = inside(pos)
    return data, low, pos[mine], number[mine], stray


def _typed(raw: np.ndarray, frame: Frame) -> pd.DataFrame:
    """Frames as rows of bytes to typed columns."""
    rows = np.ascontiguousarray(raw).view(frame.dtype)[:, 0]
    kinds = {"short": np.int16, "long": np.int64, "float": np.float32}
    return pd.DataFrame({name: rows[name].astype(kinds[kind]) for name, kind in _columns(frame)})


def _unpack(data: np.ndarray, low: int, pos: np.ndarray, frame: Frame) -> pd.DataFrame:
    return _typed(data[pos[:, None] + np.arange(frame.length)], frame).assign(file_offset=pos + low)


def _open(uri: str) -> Callable[[int, int], bytes]:
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:"):]
    system, path = fs.FileSystem.from_uri(uri)
    handle = system.open_input_file(path)

    def read(begin: int, stop: int) -> bytes:
        handle.seek(begin)
        return handle.read(stop - begin)

    return read


def byte_ranges(files: DataFrame, chunk: int = CHUNK_BYTES, begin: str | None = None) -> DataFrame:
    """path, length, begin, stop for every chunk of every file; `begin` names a column with the first offset wanted."""
    first = F.col(begin) if begin else F.lit(0).cast("long")
    return (
        files.where(F.col("length") > first)
        .select("path", "length", F.explode(F.sequence(first, F.col("length") - 1, F.lit(chunk).cast("long"))).alias("begin"))
        .withColumn("stop", F.least(F.col("begin") + F.lit(chunk), F.col("length")))
    )


def list_recordings(spark: SparkSession, root: str) -> DataFrame:
    """path and length of every recording; contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(root)
        .select(F.col("path"), F.col("length"))
    )


def listing(spark: SparkSession, root: str) -> str:
    """A name for the recordings under root and their lengths: it changes when one is added or grows."""
    row = list_recordings(spark, root).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length").cast("decimal(38,0)")).alias("s")).first()
    return hashlib.md5(repr((row.n, str(row.s))).encode()).hexdigest()


def spread_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges dealt evenly to one task each (at most MOST_TASKS). The number is given, so the adaptive planner keeps it:
    ranges are tiny rows, and by their own size they would all end in one task."""
    return ranges.repartition(max(1, min(ranges.count(), MOST_TASKS)))


def decode_ranges(ranges: DataFrame, kind: str, keep_path: bool = False) -> DataFrame:
    """Typed rows of one frame kind: session_id, file_offset, payload columns, and the file's path if wanted."""
    frame = FRAMES[kind]
    names = ["session", "file_offset", *[n for n, _ in _columns(frame)]]
    schema = "session string, file_offset long, " + ", ".join(f"{n} {t}" for n, t in _columns(frame))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            for row in batch.itertuples(index=False):
                data, low, pos, _, _ = scan(_open(row.path), row.length, row.begin, row.stop, [frame])
                for i in range(0, len(pos), ROWS_PER_BATCH):
                    yield _unpack(data, low, pos[i:i + ROWS_PER_BATCH], frame).assign(session=row.path)[names]

    decoded = ranges.mapInPandas(decode, schema)
    path = [F.col("session").alias("path")] * keep_path
    return decoded.select(*path, stem(F.col("session"), r"\.bin").alias("session_id"), *names[1:])


def read_packets(spark: SparkSession, root: str, kind: str = "imu", chunk: int = CHUNK_BYTES) -> DataFrame:
    """All frames of one kind of every recording under root."""
    ranges = byte_ranges(list_recordings(spark, root), chunk)
    return decode_ranges(spread_ranges(ranges), kind)


def read_samples(spark: SparkSession, root: str, kind: str = "imu", chunk: int = CHUNK_BYTES) -> DataFrame:
    """Packets with the canonical time column t."""
    return read_packets(spark, root, kind, chunk).withColumnRenamed("timestamp_ms", "t")


def scan_frames(spark: SparkSession, root: str, kinds: Sequence[str] = ("imu", "emg"), chunk: int = CHUNK_BYTES) -> DataFrame:
    """Every start byte outside accepted frames and every accepted frame: session_id, file_offset, kind."""
    frames = [FRAMES[k] for k in kinds]
    labels = np.array([*kinds, "unclassified"])

    def audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                _, low, pos, number, stray = scan(_open(row.path), row.length, row.begin, row.stop, frames)
                yield pd.DataFrame({
                    "path": row.path, "file_offset": np.concatenate([pos, stray]) + low,
                    "kind": labels[np.concatenate([number, np.full(len(stray), len(kinds))]).astype(int)],
                })

    ranges = spread_ranges(byte_ranges(list_recordings(spark, root), chunk))
    found = ranges.mapInPandas(audit, "path string, file_offset long, kind string")
    return found.select(stem(F.col("path"), r"\.bin").alias("session_id"), "file_offset", "kind")


def decode_blobs(blobs: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Frames of messages held in a `content` column (each a short piece of a recording): session_id, file_offset, kind,
    timestamp_ms and the payload columns of all kinds."""
    frames = [FRAMES[k] for k in kinds]
    payload = {n: t for f in frames for n, t in _columns(f)}
    names = ["session_id", "file_offset", "kind", *payload]
    schema = "session_id string, file_offset long, kind string, " + ", ".join(f"{n} {t}" for n, t in payload.items())

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[list] = [[] for _ in frames]
            for session, content in zip(batch["session_id"], batch["content"]):
                content = bytes(content)
                data, low, pos, number, _ = scan(lambda a, b: content[a:b], len(content), 0, len(content), frames)
                for k, frame in enumerate(frames):
                    p = pos[number == k]
                    found[k].append((np.full(len(p), session, object), p + low, data[p[:, None] + np.arange(frame.length)]))
            for frame, parts in zip(frames, found):
                sessions, offsets, raw = (np.concatenate(x) for x in zip(*parts))
                part = _typed(raw, frame).assign(session_id=sessions, file_offset=offsets, kind=frame.kind)
                yield part.reindex(columns=names).astype({c: object for c in names if c not in part})

    return blobs.select(F.col("session_id").cast("string").alias("session_id"), "content").mapInPandas(decode, schema)


def encode_imu(rows: DataFrame) -> DataFrame:
    """A `frame` column with the 37-byte IMU frame of each row, built from native expressions (used to feed checks)."""
    def little(c: str, size: int):
        text = F.lpad(F.hex(F.pmod(F.col(c).cast("long"), F.lit(1 << (8 * size)))), 2 * size, "0")
        return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])

    body = F.concat(F.lit("0101"), little("timestamp_ms", 4),
                    *[little(c, 2) for c in ("accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z")],
                    little("ppg_ir", 4), little("ppg_red", 4), little("ambient_bits", 4), little("object_bits", 4))
    def folded(c: str, size: int):
        v = F.pmod(F.col(c).cast("long"), F.lit(1 << (8 * size)))
        return reduce(lambda x, y: x.bitwiseXOR(y), [F.shiftright(v, 8 * i).bitwiseAND(F.lit(255).cast("long")) for i in range(size)])

    wide = ["timestamp_ms", "ppg_ir", "ppg_red", "ambient_bits", "object_bits"]
    check = reduce(lambda x, y: x.bitwiseXOR(y), [folded(c, 4) for c in wide] + [
        folded(c, 2) for c in ("accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z")])  # type and version, both 1, cancel out
    return rows.withColumn("__body", body).withColumn(
        "frame", F.unhex(F.concat(F.lit("AA"), F.col("__body"), F.lpad(F.hex(check), 2, "0"), F.lit("BB")))
    ).drop("__body")


def stream_recordings(spark: SparkSession, root: str, kind: str = "imu", chunk: int = CHUNK_BYTES, files_per_trigger: int = 100) -> DataFrame:
    """Streaming decode of recordings as their (finished) files arrive."""
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.bin").option("maxFilesPerTrigger", files_per_trigger).load(root).select("path", "length")
    )
    # a batch's ranges are not counted beforehand; a few for each core keep a large file from one task
    tasks = 4 * spark.sparkContext.defaultParallelism
    return decode_ranges(byte_ranges(files, chunk).repartition(tasks), kind)


def ingest_increment(spark: SparkSession, root: str, out: str, ledger: str, kind: str = "imu", chunk: int = CHUNK_BYTES) -> int:
    """Decode only what was appended to growing recordings since the last call; returns the batch number.

    The ledger keeps, per file, the end of the last complete frame and the batch that reached it. Packets of a batch
    are written before its ledger entry, both under the batch number, so a failed call is simply repeated. An
    incomplete frame at the end of a file waits for the next call.
    """
    schema = "path string, next_offset long, batch long"
    known = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(ledger) if _exists(spark, ledger) else spark.createDataFrame([], schema)
    batch = (known.agg(F.max("batch")).first()[0] or 0) + 1
    latest = known.groupBy("path").agg(F.max("next_offset").alias("next_offset"))
    files = list_recordings(spark, root).join(latest, "path", "left").withColumn("from", F.coalesce("next_offset", F.lit(0).cast("long")))
    ranges = spread_ranges(byte_ranges(files, chunk, "from"))
    frame = FRAMES[kind]
    decode_ranges(ranges, kind, keep_path=True).write.mode("overwrite").parquet(f"{out}/batch={batch}")
    # by path: recordings in two folders may have one name
    written = spark.read.parquet(f"{out}/batch={batch}").groupBy("path").agg((F.max("file_offset") + frame.length).alias("reached"))
    entries = files.join(written, "path")
    entries.select("path", F.col("reached").alias("next_offset"), F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{ledger}/part={batch}")
    return batch


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise
