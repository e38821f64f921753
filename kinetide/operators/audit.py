"""Integrity checks of raw recordings."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from kinetide.operators.ordered import previous, time_bucket

# The device clock is an unsigned 32-bit millisecond counter.
CLOCK_WRAP = 2**32
WRAP_TOLERANCE = 60_000
PAYLOAD = ["accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z", "ppg_ir", "ppg_red"]
NAME_PATTERN = r"^(\d{4}-\d{2}-\d{2})-(\d{1,2})-(\d+)(am|pm)"


def first_per_key(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], k: int) -> DataFrame:
    """First k rows per key: k per bucket first, then k of those, so no key is ranked whole in one task."""
    for part in ([*keys, bucket], list(keys)):
        df = df.withColumn("__row", F.row_number().over(W.partitionBy(*part).orderBy(*order))).where(F.col("__row") <= k)
    return df.drop("__row")


def backward_jumps(packets: DataFrame, order: str, width: int, wrap: int = CLOCK_WRAP, tolerance: int = WRAP_TOLERANCE) -> DataFrame:
    """Every place where time runs backwards in file order, told apart as counter wrap or anomaly."""
    rows = packets.select("session_id", "t", order).withColumn("__bucket", time_bucket(order, width))
    linked = previous(rows, ["session_id"], "__bucket", [order], {"prev_t": F.col("t")})
    wrapped = (F.col("prev_t") > wrap - tolerance) & (F.col("t") < tolerance)
    return linked.where(F.col("t") < F.col("prev_t")).select(
        "session_id", order, "__bucket", "prev_t", F.col("t").alias("next_t"),
        (F.col("prev_t") - F.col("t")).alias("drop"), wrapped.alias("is_wrap"),
    )


def monotonic_audit(packets: DataFrame, order: str, width: int, wrap: int = CLOCK_WRAP, tolerance: int = WRAP_TOLERANCE) -> DataFrame:
    """Per session: backward jumps, wraps, anomalies and the covered span (last minus first in file order)."""
    span = packets.groupBy("session_id").agg((F.max_by("t", order) - F.min_by("t", order)).alias("span"))
    jumps = backward_jumps(packets, order, width, wrap, tolerance).groupBy("session_id").agg(
        F.count("*").alias("n_backward"), F.count(F.when(F.col("is_wrap"), 1)).alias("n_wraps")
    )
    zero = F.lit(0).cast("long")
    return span.join(jumps, "session_id", "left").select(
        "session_id", F.coalesce("n_backward", zero).alias("n_backward"), F.coalesce("n_wraps", zero).alias("n_wraps"),
        (F.coalesce("n_backward", zero) - F.coalesce("n_wraps", zero)).alias("n_anomalies"), "span",
    )


def anomaly_sample(packets: DataFrame, order: str, width: int, k: int = 20) -> DataFrame:
    jumps = backward_jumps(packets, order, width).where(~F.col("is_wrap"))
    return first_per_key(jumps, ["session_id"], "__bucket", [order], k).drop("__bucket", "is_wrap")


def duplicate_audit(packets: DataFrame, order: str, width: int, payload: Sequence[str] = PAYLOAD) -> DataFrame:
    """Per session: consecutive packets with equal time, split by equal or different payload."""
    rows = packets.select("session_id", "t", order, *payload).withColumn("__bucket", time_bucket(order, width))
    wanted = {"__pt": F.col("t")} | {f"__p_{c}": F.col(c) for c in payload}
    linked = previous(rows, ["session_id"], "__bucket", [order], wanted)
    same = F.lit(True)
    for c in payload:
        same = same & F.col(c).eqNullSafe(F.col(f"__p_{c}"))
    twin = F.col("t") == F.col("__pt")
    return linked.groupBy("session_id").agg(
        F.count(F.when(twin & same, 1)).alias("n_exact"), F.count(F.when(twin & ~same, 1)).alias("n_conflicting")
    )


def marker_density(packets: DataFrame, markers: DataFrame, order: str, bucket_len: int) -> DataFrame:
    """Markers per bucket from each session's start, zero filled; late markers count in the last bucket."""
    ends = packets.groupBy("session_id").agg(F.min_by("t", order).alias("t0"), F.max_by("t", order).alias("t1"))
    sized = ends.withColumn("n", F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) / F.lit(bucket_len))).cast("long"))
    grid = sized.select("session_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bucket"))
    offset = ((F.col("t") - F.col("t0")) / F.lit(bucket_len)).cast("long")  # cast drops the fraction toward zero
    placed = markers.join(sized, "session_id").withColumn("bucket", F.least(offset, F.col("n") - 1)).where(F.col("bucket") >= 0)
    counts = placed.groupBy("session_id", "bucket").agg(F.count("*").alias("n_markers"))
    return grid.join(counts, ["session_id", "bucket"], "left").withColumn("n_markers", F.coalesce("n_markers", F.lit(0).cast("long")))


def name_clock_check(names: DataFrame, column: str = "session_id") -> DataFrame:
    """Does a name begin with <date>-<hour>-<minute>(am|pm), and is that a clock time?"""
    part = lambda i: F.regexp_extract(column, NAME_PATTERN, i)
    hit = part(0) != ""
    hour, minute = F.when(hit, part(2)), F.when(hit, part(3))
    valid = (minute.cast("decimal(38,0)") <= 59) & hour.cast("int").between(1, 12)
    return names.select(
        column, hit.alias("pattern_match"), hour.alias("parsed_hour"), minute.alias("parsed_minute"),
        F.when(hit, F.coalesce(valid, F.lit(False))).alias("valid_clock_time"),
    )


def frame_audit(frames: DataFrame) -> DataFrame:
    """Counts per session of a mixed frame scan (kind in imu, emg, unclassified) and the unclassified rate."""
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    return frames.groupBy("session_id").agg(
        n("imu").alias("n_imu"), n("emg").alias("n_emg"), n("unclassified").alias("n_unclassified")
    ).withColumn(
        "unclassified_rate",
        F.col("n_unclassified") / F.greatest(F.lit(1), F.col("n_imu") + F.col("n_emg") + F.col("n_unclassified")),
    )


def bad_positions(frames: DataFrame, width: int, k: int = 20) -> DataFrame:
    bad = frames.where(F.col("kind") == "unclassified").select("session_id", "file_offset").withColumn(
        "__bucket", time_bucket("file_offset", width)
    )
    return first_per_key(bad, ["session_id"], "__bucket", ["file_offset"], k).drop("__bucket")


def session_manifest(packets: DataFrame, kinds: Sequence[str], kind: str = "kind") -> DataFrame:
    """Packets per kind with first and last time of each session."""
    return packets.groupBy("session_id").agg(
        *[F.count(F.when(F.col(kind) == k, 1)).alias(f"n_{k}") for k in kinds],
        F.min("t").alias("first_t"), F.max("t").alias("last_t"),
    )


def integrity_report(frames: DataFrame, packets: DataFrame, markers: DataFrame, order: str, width: int, bucket_len: int) -> DataFrame:
    """One row per session: frame audit, clock audit, duplicates, marker density and the name check."""
    density = marker_density(packets, markers, order, bucket_len).groupBy("session_id").agg(
        F.sum("n_markers").alias("n_markers"),
        F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n_markers"))), lambda s: s["n_markers"]).alias("markers_per_bucket"),
    )
    audit = frame_audit(frames)
    return (
        audit.join(monotonic_audit(packets, order, width), "session_id", "left")
        .join(duplicate_audit(packets, order, width), "session_id", "left")
        .join(density, "session_id", "left")
        .join(name_clock_check(audit.select("session_id")), "session_id", "left")
    )
