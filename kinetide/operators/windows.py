"""Event windows: lookbacks before markers, matched negatives and the sample/interval range join."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kinetide.operators.ordered import time_bucket

WINDOW_COLUMNS = ["window_id", "session_id", "start_t", "end_t", "label", "horizon"]
TILES_PER_BLOCK = 4096


def with_day(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Left join of the session's day; sessions without metadata get 'unknown'."""
    days = sessions.select("session_id", "day_str")
    return df.join(days, "session_id", "left").withColumn("day_str", F.coalesce("day_str", F.lit("unknown")))


def lookback_intervals(
    markers: DataFrame, length: int, buffer: int, shifts: int = 1, shift_step: int | None = None
) -> DataFrame:
    """One interval [t - buffer - k*step - length, t - buffer - k*step) per marker and shift k."""
    step = length // 3 if shift_step is None else shift_step
    if shifts < 1:
        raise ValueError("shifts must be at least 1")
    end = F.col("t") - F.lit(buffer) - F.col("horizon") * F.lit(step)
    return (
        markers.select("*", F.explode(F.sequence(F.lit(0), F.lit(shifts - 1))).alias("horizon"))
        .select(
            F.concat_ws(":", F.lit("p"), F.col("marker_id").cast("string"), F.col("horizon").cast("string")).alias("window_id"),
            "session_id",
            (end - F.lit(length)).cast("long").alias("start_t"),
            end.cast("long").alias("end_t"),
            F.lit(1).alias("label"),
            "horizon",
        )
    )


def bucket_intervals(windows: DataFrame, width: int, bucket: str = "__bucket") -> DataFrame:
    """One row per (interval, time bucket) so that a band join becomes an equi join."""
    first, last = time_bucket("start_t", width), time_bucket(F.col("end_t") - 1, width)
    return windows.where(F.col("end_t") > F.col("start_t")).withColumn(bucket, F.explode(F.sequence(first, last)))


def slice_samples(samples: DataFrame, windows: DataFrame, width: int, closed_end: bool = False) -> DataFrame:
    """Samples with start_t <= t < end_t (or <= end_t) per window, joined on (session, time bucket)."""
    spans = windows.withColumn("__stop", F.col("end_t") + 1) if closed_end else windows.withColumn("__stop", F.col("end_t"))
    first, last = time_bucket("start_t", width), time_bucket(F.col("__stop") - 1, width)
    spread = spans.where(F.col("__stop") > F.col("start_t")).withColumn("__bucket", F.explode(F.sequence(first, last)))
    keyed = samples if "__bucket" in samples.columns else samples.withColumn("__bucket", time_bucket("t", width))
    return (
        keyed.join(spread, ["session_id", "__bucket"])
        .where((F.col("t") >= F.col("start_t")) & (F.col("t") < F.col("__stop")))
        .drop("__bucket", "__stop")
    )


def non_empty(windows: DataFrame, samples: DataFrame, width: int) -> DataFrame:
    """Windows that hold at least one sample."""
    hits = slice_samples(samples.select("session_id", "t"), windows.select("window_id", "session_id", "start_t", "end_t"), width)
    return windows.join(hits.select("window_id").distinct(), "window_id", "left_semi")


def session_bounds(samples: DataFrame) -> DataFrame:
    return samples.groupBy("session_id").agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"))


def tile_sessions(bounds: DataFrame, length: int, step: int) -> DataFrame:
    """Candidate starts t_min, t_min+step, ... while start + length <= t_max.

    Tiles are generated in blocks, so the tiles of a very long session come from many tasks.
    """
    tiles = F.floor((F.col("t_max") - F.lit(length) - F.col("t_min")) / F.lit(step))
    blocks = (
        bounds.withColumn("__last", tiles)
        .where(F.col("__last") >= 0)
        .withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__last") / TILES_PER_BLOCK))))
        .repartition("session_id", "__block")
    )
    low = F.col("__block") * F.lit(TILES_PER_BLOCK)
    high = F.least(low + F.lit(TILES_PER_BLOCK - 1), F.col("__last"))
    start = (F.col("t_min") + F.col("__k") * F.lit(step)).cast("long")
    return blocks.withColumn("__k", F.explode(F.sequence(low, high))).select(
        "session_id", start.alias("start_t"), (start + F.lit(length)).alias("end_t")
    )


def without_overlap(candidates: DataFrame, intervals: DataFrame, width: int) -> DataFrame:
    """Candidates [start, end) that touch none of the intervals: anti join on (session, bucket) plus the overlap test.

    Only the intervals are spread; a candidate of length L can touch an interval only from a start in
    (interval start - L, interval end), hence it needs its start bucket alone.
    """
    spread = (
        intervals.select("session_id", F.col("start_t").alias("__s"), F.col("end_t").alias("__e"))
        .withColumn(
            "__bucket",
            F.explode(F.sequence(time_bucket(F.col("__s") - F.lit(width) + 1, width), time_bucket(F.col("__e") - 1, width))),
        )
        .distinct()
    )
    tagged = candidates.withColumn("__bucket", time_bucket("start_t", width))
    c, p = tagged.alias("c"), spread.alias("p")
    same = (F.col("c.session_id") == F.col("p.session_id")) & (F.col("c.__bucket") == F.col("p.__bucket"))
    overlap = (F.col("c.end_t") > F.col("p.__s")) & (F.col("c.start_t") < F.col("p.__e"))
    return c.join(p, same & overlap, "left_anti").drop("__bucket")


def negative_candidates(samples: DataFrame, positives: DataFrame, length: int, step: int) -> DataFrame:
    """Tiled windows of each session that avoid every positive interval."""
    tiles = tile_sessions(session_bounds(samples), length, step)
    return without_overlap(tiles, positives, length)


def hash_order(*parts: Column) -> Column:
    """Reproducible random order: the md5 hex text of the joined parts."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def smallest_per_key(df: DataFrame, keys: Sequence[str], order: str, limit: str) -> DataFrame:
    """Rows among the `limit` (a column) smallest md5 texts per key.

    The text's first three hex digits split each key into 4,096 even parts; only a part's own rows are sorted.
    """
    keys = list(keys)
    parted = df.withColumn("__part", F.conv(F.substring(order, 1, 3), 16, 10).cast("int"))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sizes = parted.groupBy(*keys, "__part").agg(F.count("*").alias("__n")).select(
        *keys, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = W.partitionBy(*keys, "__part").orderBy(order)
    return (
        parted.join(sizes, [*keys, "__part"])
        .where(F.col("__before") < F.col(limit))
        .withColumn("__row", F.row_number().over(inside))
        .where(F.col("__before") + F.col("__row") <= F.col(limit))
        .drop("__part", "__before", "__row")
    )


def as_negatives(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        F.concat_ws(":", F.lit("n"), F.col("session_id").cast("string"), F.col("start_t").cast("string")).alias("window_id"),
        "session_id", "start_t", "end_t", F.lit(0).alias("label"), F.lit(0).alias("horizon"),
    )


def sample_negatives(candidates: DataFrame, positives: DataFrame, seed: int = 42) -> DataFrame:
    """As many candidates per session as there are (non-empty) positives, without replacement."""
    wanted = positives.groupBy("session_id").agg(F.count("*").alias("__wanted"))
    drawn = candidates.join(wanted, "session_id").withColumn(
        "__order", hash_order(F.lit(seed), F.col("session_id"), F.col("start_t"))
    )
    return as_negatives(smallest_per_key(drawn, ["session_id"], "__order", "__wanted").drop("__order", "__wanted"))


def labelled_windows(
    samples: DataFrame,
    markers: DataFrame,
    length: int,
    buffer: int,
    neg_step: int | None = None,
    shifts: int = 1,
    shift_step: int | None = None,
    seed: int = 42,
    all_negatives: bool = False,
) -> DataFrame:
    """Positives and negatives of every session with samples; windows without a sample are left out.

    Negatives avoid the lookback intervals (also the empty ones), not the buffer or the event itself. As many are drawn as
    there are non-empty positives, before any coverage filter; those drawn that turn out empty are not replaced.
    """
    intervals = lookback_intervals(markers, length, buffer, shifts, shift_step)
    positives = non_empty(intervals, samples, length)
    candidates = negative_candidates(samples, intervals, length, neg_step or length)
    if all_negatives:
        negatives = as_negatives(candidates)
    else:
        negatives = sample_negatives(candidates, positives, seed)
    return positives.select(*WINDOW_COLUMNS).unionByName(non_empty(negatives, samples, length).select(*WINDOW_COLUMNS))


def min_samples(length_ms: int, rate_hz: float = 50.0, coverage: float = 0.5) -> int:
    """Least number of samples a window needs to be kept."""
    return int(length_ms / 1000.0 * rate_hz * coverage)


def anchored_windows(
    samples: DataFrame, windows: DataFrame, lengths: Sequence[int], needed: dict[int, int], vet_length: int | None = None
) -> DataFrame:
    """Re-slice vetted windows at several lengths, all ending one past the last sample of the largest.

    Returns anchors exploded by length; an anchor stays only if every length in `needed` reaches its sample count.
    """
    width = vet_length or max(lengths)
    light = samples.select("session_id", "t")
    last = slice_samples(light, windows, width).groupBy(*WINDOW_COLUMNS).agg((F.max("t") + 1).alias("anchor_end"))
    counts = [
        F.count(F.when(F.col("t") >= F.col("anchor_end") - F.lit(n), 1)).alias(f"__n{n}") for n in lengths
    ]
    span = last.select(
        "window_id", "session_id", "label", "horizon", "anchor_end",
        (F.col("anchor_end") - F.lit(max(lengths))).alias("start_t"), F.col("anchor_end").alias("end_t"),
    )
    covered = slice_samples(light, span, width).groupBy("window_id", "session_id", "label", "horizon", "anchor_end").agg(*counts)
    for n, least in needed.items():
        covered = covered.where(F.col(f"__n{n}") >= least)
    return covered.select(
        "window_id", "session_id", "label", "horizon", "anchor_end",
        F.explode(F.array(*[F.lit(n).cast("long") for n in lengths])).alias("length"),
    ).select("*", (F.col("anchor_end") - F.col("length")).alias("start_t"), F.col("anchor_end").alias("end_t"))


def early_segment(windows: DataFrame, window_length: int, segment_length: int) -> DataFrame:
    """[end - window_length, end - window_length + segment_length) of each window."""
    start = F.col("end_t") - F.lit(window_length)
    return windows.withColumn("start_t", start).withColumn("end_t", start + F.lit(segment_length))


def context_windows(candidates: DataFrame, margin: int) -> DataFrame:
    """Candidate intervals widened on both sides; slice them with closed_end=True."""
    return candidates.withColumn("start_t", F.col("start_t") - F.lit(margin)).withColumn("end_t", F.col("end_t") + F.lit(margin))


def dirty_windows(extents: DataFrame, markers: DataFrame, buffer: int, tolerance: int, width: int) -> DataFrame:
    """Positive windows holding a marker other than their own.

    `extents` has first_t and stop_t (last sample + 1) per window; the own marker sits near stop_t + buffer.
    """
    spread = bucket_intervals(
        extents.where(F.col("label") == 1).select(
            "window_id", "session_id", F.col("first_t").alias("start_t"), F.col("stop_t").alias("end_t")
        ),
        width,
    )
    points = markers.select("session_id", F.col("t").alias("__m"), time_bucket("t", width).alias("__bucket")).distinct()
    foreign = F.abs(F.col("__m") - (F.col("end_t") + F.lit(buffer))) > F.lit(tolerance)
    inside = (F.col("__m") >= F.col("start_t")) & (F.col("__m") < F.col("end_t"))
    hit = spread.join(points, ["session_id", "__bucket"]).where(inside & foreign).select("window_id").distinct()
    return extents.join(hit.withColumn("__hit", F.lit(True)), "window_id", "left").withColumn(
        "dirty", F.coalesce("__hit", F.lit(False))
    ).drop("__hit")


def dirty_weight(label: Column, dirty: Column, weight: float = 0.5) -> Column:
    return F.when((label == 1) & dirty, F.lit(weight)).otherwise(F.lit(1.0))


def anchor_points(bounds: DataFrame, events: DataFrame, length: int, step: int) -> DataFrame:
    """Window ends every `step` from t_min + length to t_max inclusive, at least `length` away from each event."""
    tiles = tile_sessions(bounds.withColumn("t_max", F.col("t_max") + F.lit(length)).withColumn("t_min", F.col("t_min") + F.lit(length)),
                          length, step)
    # |end - event| < length is an overlap of [end, end+1) with (event - length, event + length)
    zones = events.select("session_id", (F.col("t") - F.lit(length) + 1).alias("start_t"), (F.col("t") + F.lit(length)).alias("end_t"))
    points = tiles.select("session_id", "start_t", (F.col("start_t") + 1).alias("end_t"))
    free = without_overlap(points, zones, length)
    return free.select("session_id", (F.col("start_t") - F.lit(length)).alias("start_t"), F.col("start_t").alias("end_t"))
