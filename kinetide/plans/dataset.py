"""From recordings to feature tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinetide.functions import dsp
from kinetide.operators import augment, cardiac, cleaning, features, spectral, windows
from kinetide.session import cut_lineage
from kinetide.sources import packets, recordings

# Fixed defaults of the data set.
BUFFER_MS = 7_000
WINDOW_MS = 60_000
HORIZONS_MS = {30_000: "w30", 60_000: "w60", 180_000: "w180"}
EARLY_MS = 90_000
IDS = ["window_id", "session_id", "day_str", "label", "end_t"]


class Recordings:
    """Decoded packets, markers and metadata of a folder of recordings.

    With `decoded`, packets are written there as Parquet once, under a name for the files and lengths they came from, and
    read back with only the columns a step needs; otherwise the decoded packets are checkpointed.
    """

    def __init__(self, spark: SparkSession, root: str, decoded: str | None = None):
        self.spark, self.root = spark, root
        self.markers = recordings.read_markers(spark, root)
        self.sessions = recordings.read_sessions(spark, root)
        if decoded is None:
            self.samples = cut_lineage(packets.read_samples(spark, root))
        else:
            decoded = f"{decoded}/of={packets.listing(spark, root)}"
            try:
                self.samples = spark.read.parquet(decoded)
            except Exception as error:
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                packets.read_samples(spark, root).write.parquet(decoded)
                self.samples = spark.read.parquet(decoded)
        self.order = ("t", "file_offset")

    def windows(self, length: int = WINDOW_MS, buffer: int = BUFFER_MS, neg_step: int | None = None, **options) -> DataFrame:
        return windows.labelled_windows(self.samples, self.markers, length, buffer, neg_step or length, **options)

    def dated(self, df: DataFrame) -> DataFrame:
        return windows.with_day(df, self.sessions)


def build_dataset(
    rec: Recordings, buffer_ms: int = BUFFER_MS, x_window_ms: int = WINDOW_MS, neg_step_ms: int = WINDOW_MS,
    n_lookback_shifts: int = 1, shift_step_ms: int | None = None, all_negatives: bool = False,
) -> tuple[DataFrame, list[str]]:
    """The standard feature table: 59 features, coverage filter, all-missing columns dropped, medians filled in."""
    found = rec.windows(x_window_ms, buffer_ms, neg_step_ms, shifts=n_lookback_shifts, shift_step=shift_step_ms, all_negatives=all_negatives)
    least = windows.min_samples(x_window_ms)
    table = rec.dated(spectral.compute_features(rec.samples, found, x_window_ms, least, ["horizon"], rec.order))
    names = sorted(c for c in table.columns if c not in {*IDS, "start_t", "n_samples", "horizon"})
    return cleaning.clean(cut_lineage(table), names)


def imu_table(rec: Recordings, jerk: bool = False, buffer_ms: int = BUFFER_MS, all_negatives: bool = False,
              window_rows: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Feature set A (54 IMU features of 60 s) or, with jerk, C (72)."""
    found = window_rows if window_rows is not None else rec.windows(WINDOW_MS, buffer_ms, all_negatives=all_negatives)
    arrays = spectral.window_arrays(rec.samples, found, features.IMU, WINDOW_MS, windows.min_samples(WINDOW_MS), order=rec.order)
    table = spectral.array_features(arrays, features.IMU, dsp.PULSE_HZ, spectral.IMU_SCALES, with_time_stats=True,
                                    jerk_of=features.ACCEL if jerk else ())
    names = sorted(c for c in table.columns if c.startswith(("accel_", "gyro_", "jerk_")))
    return cleaning.clean(cut_lineage(rec.dated(table)), names)


def horizon_anchors(rec: Recordings, buffer_ms: int = BUFFER_MS, lengths: Sequence[int] = tuple(HORIZONS_MS),
                    needed: dict[int, int] | None = None) -> DataFrame:
    """Anchors vetted at the largest length and exploded by length."""
    largest = max(lengths)
    vetted = rec.windows(largest, buffer_ms)
    return windows.anchored_windows(rec.samples, vetted, list(lengths), needed or {n: windows.min_samples(n) for n in lengths})


def horizon_table(rec: Recordings, jerk: bool = False, buffer_ms: int = BUFFER_MS) -> tuple[DataFrame, list[str]]:
    """Feature set B (IMU features at 30, 60 and 180 s) or, with jerk, D."""
    anchors = cut_lineage(horizon_anchors(rec, buffer_ms))
    arrays = spectral.window_arrays(rec.samples, anchors, features.IMU, max(HORIZONS_MS), keep=["length", "anchor_end"], order=rec.order)
    per_length = spectral.array_features(arrays, features.IMU, dsp.PULSE_HZ, spectral.IMU_SCALES, with_time_stats=True,
                                         jerk_of=features.ACCEL if jerk else ())
    single = sorted(c for c in per_length.columns if c.startswith(("accel_", "gyro_", "jerk_")))
    wide = features.multi_horizon(per_length, single, HORIZONS_MS).withColumn("end_t", F.col("anchor_end"))
    names = sorted(f"{p}_{n}" for p in HORIZONS_MS.values() for n in single)
    return cleaning.clean(cut_lineage(rec.dated(wide)), names)


FEATURE_SETS = {
    "A": lambda rec, **o: imu_table(rec, False, **o), "B": lambda rec, **o: horizon_table(rec, False, **o),
    "C": lambda rec, **o: imu_table(rec, True, **o), "D": lambda rec, **o: horizon_table(rec, True, **o),
}


def thermal_table(rec: Recordings, buffer_ms: int = BUFFER_MS) -> tuple[DataFrame, list[str]]:
    """14 thermal features per 60 s window."""
    found = rec.windows(WINDOW_MS, buffer_ms)
    table = features.window_features(rec.samples, found, features.THERMAL, WINDOW_MS, windows.min_samples(WINDOW_MS),
                                     trend_of=features.THERMAL, order=rec.order)
    names = sorted(c for c in table.columns if c.startswith(("ambient_c_", "object_c_")))
    return cleaning.clean(cut_lineage(rec.dated(table)), names)


def heart_table(rec: Recordings, buffer_ms: int = BUFFER_MS) -> DataFrame:
    """Cardiac quality record of the early segment of every 180 s anchor."""
    large = max(HORIZONS_MS)
    anchors = horizon_anchors(rec, buffer_ms, (WINDOW_MS, large), {WINDOW_MS: windows.min_samples(WINDOW_MS)})
    whole = cut_lineage(anchors.where(F.col("length") == large))
    early = windows.early_segment(whole, large, EARLY_MS)
    arrays = cut_lineage(spectral.window_arrays(rec.samples, early, ["ppg_ir"], EARLY_MS, order=rec.order))
    record = cardiac.quality_record(arrays.select("window_id", "n_samples"), spectral.beats(arrays, cardiac.MIN_SEGMENT_SAMPLES))
    return rec.dated(whole.select("window_id", "session_id", "label", "end_t")).join(record, "window_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("plausible_hr", "trend_ok", "hrv_ok")})


def dual_window_table(rec: Recordings, buffer_ms: int = BUFFER_MS) -> tuple[DataFrame, list[str]]:
    """60 s IMU features joined with the cardiac record on the same anchors."""
    large = max(HORIZONS_MS)
    anchors = horizon_anchors(rec, buffer_ms, (WINDOW_MS, large), {WINDOW_MS: windows.min_samples(WINDOW_MS)})
    small = cut_lineage(anchors.where(F.col("length") == WINDOW_MS).select("window_id", "session_id", "start_t", "end_t", "label", "horizon"))
    table, names = imu_table(rec, window_rows=small)
    record = heart_table(rec, buffer_ms).drop("session_id", "day_str", "label", "end_t")
    return cut_lineage(table.join(record, "window_id")), names


def dirty_table(rec: Recordings, buffer_ms: int = BUFFER_MS, tolerance: int = 1_000) -> tuple[DataFrame, list[str]]:
    """Feature set A with the weight of windows that hold another marker."""
    table, names = imu_table(rec, buffer_ms=buffer_ms)
    found = rec.windows(WINDOW_MS, buffer_ms)
    sliced = windows.slice_samples(rec.samples.select("session_id", "t"), found, WINDOW_MS)
    extents = sliced.groupBy("window_id", "session_id", "label").agg(F.min("t").alias("first_t"), (F.max("t") + 1).alias("stop_t"))
    tagged = windows.dirty_windows(extents, rec.markers, buffer_ms, tolerance, WINDOW_MS)
    weights = tagged.select("window_id", "dirty", windows.dirty_weight(F.col("label"), F.col("dirty")).alias("weight"))
    return cut_lineage(table.join(weights, "window_id")), names


def public_table(spark: SparkSession, root: str, flip: bool = False, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """54 features of the public recordings at 10 Hz: events against count-matched anchors, participants as groups.

    Both streams are sliced on their own, put side by side by position and cut to the shorter; `flip` negates two axes.
    """
    width = recordings.PUBLIC_WINDOW_MS
    acc = cut_lineage(recordings.read_public_stream(spark, root, "acc"))
    gyr = cut_lineage(recordings.read_public_stream(spark, root, "gyr"))
    if flip:
        acc = features.negate_axes(acc)
    events = cut_lineage(recordings.read_public_events(spark, root))
    a, g = windows.session_bounds(acc), windows.session_bounds(gyr)
    bounds = a.alias("a").join(g.alias("g"), "session_id").select(
        "session_id", F.greatest("a.t_min", "g.t_min").alias("t_min"), F.least("a.t_max", "g.t_max").alias("t_max"))
    positives = windows.lookback_intervals(events, width, 0)
    candidates = windows.anchor_points(bounds, events, width, 5_000)

    def sides(found: DataFrame) -> DataFrame:
        left = spectral.window_arrays(acc, found, features.ACCEL, width)
        right = spectral.window_arrays(gyr, found, features.GYRO, width)
        n = F.least(F.size("accel_x"), F.size("gyro_x"))
        both = left.drop("n_samples").join(right.select("window_id", *features.GYRO), "window_id").withColumn("n_samples", n.cast("long"))
        cut = both.withColumns({c: F.slice(c, F.lit(1), F.col("n_samples").cast("int")) for c in features.IMU})
        return cut.where(F.col("n_samples") >= int(width / 1000 * recordings.PUBLIC_HZ * 0.5)).drop("t")

    good = cut_lineage(sides(positives))
    negatives = sides(windows.sample_negatives(candidates, good, seed))
    table = spectral.array_features(good.unionByName(negatives), features.IMU, recordings.PUBLIC_HZ, with_time_stats=True)
    names = sorted(c for c in table.columns if c.startswith(("accel_", "gyro_")))
    return cut_lineage(table.withColumn("day_str", F.col("session_id"))), names


def augmented_table(rec: Recordings, names: Sequence[str], copies: int = 1, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """Feature set A with altered copies; `augmentation` tells originals ('none') from copies."""
    found = rec.windows(WINDOW_MS)
    arrays = spectral.window_arrays(rec.samples, found, features.IMU, WINDOW_MS, windows.min_samples(WINDOW_MS), order=rec.order).drop("t")
    copied = augment.augment(arrays, features.IMU, names, copies, seed)
    table = spectral.array_features(copied, features.IMU, dsp.PULSE_HZ, spectral.IMU_SCALES, with_time_stats=True)
    return cut_lineage(rec.dated(table)), sorted(c for c in table.columns if c.startswith(("accel_", "gyro_")))
