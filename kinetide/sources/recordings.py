"""Sidecar files of recordings: metadata, markers, candidate and label intervals, public recordings."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from kinetide.operators.matching import coalesce_override, minutes_seconds

# File schemas, the marker vocabulary and the swapped timestamp files of the public recordings.
SESSION_SCHEMA = (
    "session_id string, port string, baud int, start_utc string, end_utc string, pkt_version int, "
    "imu_ppg_packets long, emg_packets long, eda_packets long"
)
MARKER_SCHEMA = "timestamp_ms long, event string"
MARKER_EVENTS = ["skin_picking_hand", "lip_picking", "skin_picking_face"]
CANDIDATE_SCHEMA = "start_ms long, end_ms long, peak_emg int"
LABEL_SCHEMA = "start_ms long, end_ms long, label int"
STREAM_SCHEMA = "timestamp long, x double, y double, z double"
EVENT_SCHEMA = "start double, label string, stage int"
TIMESTAMP_SOURCES = {"exp-5": "exp-6", "exp-6": "exp-5", "exp-8": "exp-9", "exp-9": "exp-8"}
GRAVITY = 9.80665
EXCLUDED_STAGE = 7
PUBLIC_WINDOW_MS = 60_000
PUBLIC_HZ = 10.0


def stem(path: Column, suffix: str) -> Column:
    """File name without its folder and suffix, percent-escapes undone."""
    return F.url_decode(F.regexp_replace(F.element_at(F.split(path, "/"), -1), rf"{suffix}$", ""))


def _files(reader, root: str, pattern: str):
    return reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Metadata with day_str, the date of start_utc as written ('unknown' if absent)."""
    raw = _files(spark.read.format("json").schema(SESSION_SCHEMA).option("multiLine", "true"), root, "*.meta.json")
    name = stem(F.col("_metadata.file_path"), r"\.meta\.json")
    return raw.withColumn("session_id", name).withColumn(
        "day_str", F.when(F.length("start_utc") >= 10, F.substring("start_utc", 1, 10)).otherwise("unknown")
    )


def read_markers(spark: SparkSession, root: str) -> DataFrame:
    """marker_id, session_id, t, event. The id names session, time and the place among the marks of that time, so other files
    do not change it."""
    raw = _files(spark.read.format("csv").schema(MARKER_SCHEMA).option("header", "true"), root, "*.markers.csv")
    name = stem(F.col("_metadata.file_path"), r"\.markers\.csv")
    marks = raw.select(name.alias("session_id"), F.col("timestamp_ms").alias("t"), "event").where(F.col("t").isNotNull())
    place = F.row_number().over(W.partitionBy("session_id", "t").orderBy("event"))
    return marks.select(F.concat_ws("/", "session_id", F.col("t").cast("string"), place.cast("string")).alias("marker_id"), "session_id", "t", "event")


def read_intervals(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Candidate ('candidates') or label ('labels') intervals with start_t, end_t."""
    schema = {"candidates": CANDIDATE_SCHEMA, "labels": LABEL_SCHEMA}[kind]
    raw = _files(spark.read.format("csv").schema(schema).option("header", "true"), root, f"*.{kind}.csv")
    value = {"candidates": "peak_emg", "labels": "label"}[kind]
    return raw.select(
        stem(F.col("_metadata.file_path"), rf"\.{kind}\.csv").alias("session_id"),
        F.col("start_ms").alias("start_t"), F.col("end_ms").alias("end_t"), value,
    )


def write_intervals(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Intervals partitioned by session."""
    writer = df.write.mode("append").partitionBy("session_id")
    (writer.option("header", "true").csv if fmt == "csv" else writer.parquet)(path)


def read_public_stream(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """One public stream ('acc' in g or 'gyr' in deg/s): session_id (folder), t, and its three axes."""
    prefix, factor = {"acc": ("accel", 1.0 / GRAVITY), "gyr": ("gyro", 1.0)}[kind]
    raw = _files(spark.read.format("csv").schema(STREAM_SCHEMA).option("header", "true"), root, f"{kind}Labeled.csv")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return raw.select(
        folder.alias("session_id"), F.col("timestamp").alias("t"),
        *[(F.col(a) * F.lit(factor)).alias(f"{prefix}_{a}") for a in "xyz"],
    )


def read_public_events(spark: SparkSession, root: str) -> DataFrame:
    """Valid events per participant: session_id, t, event, recording_start.

    A file's first row holds the recording start; its other rows hold MM.SS event times.
    """
    raw = _files(spark.read.format("csv").schema(EVENT_SCHEMA).option("header", "true"), root, "timestamps.csv")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = raw.select(folder.alias("source"), F.monotonically_increasing_id().alias("line"), "start", "label", "stage")
    first = rows.groupBy("source").agg(F.min("line").alias("head"), F.min_by("start", "line").cast("long").alias("recording_start"))
    people = rows.select(F.col("source").alias("session_id")).distinct()
    mapping = spark.createDataFrame(list(TIMESTAMP_SOURCES.items()), "session_id string, source string")
    sources = coalesce_override(people, mapping, "session_id")
    events = rows.join(first, "source").where(F.col("line") > F.col("head"))
    timed = sources.join(events, "source").withColumn("t", minutes_seconds(F.col("start"), F.col("recording_start")))
    kept = F.col("label").isNotNull() & (F.col("label") != "") & (F.coalesce("stage", F.lit(-1)) != EXCLUDED_STAGE)
    return timed.where(kept & (F.col("t") - PUBLIC_WINDOW_MS >= F.col("recording_start"))).select(
        F.concat_ws(":", "session_id", F.col("line").cast("string")).alias("marker_id"), "session_id", "t", F.col("label").alias("event"), "recording_start"
    )
