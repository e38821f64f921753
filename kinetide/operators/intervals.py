"""Activity intervals from muscle signals: envelope, threshold, runs, merging and the duration filter."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kinetide.operators.ordered import Running, exact_percentiles, islands, running, time_bucket, trailing_halo
from kinetide.operators.recurrence import Filter, butterworth_low, zero_phase
from kinetide.session import cut_lineage

CHUNK_ROWS = 100_000
LOWPASS_HZ, LOWPASS_ORDER, SAMPLE_HZ = 10.0, 4, 500.0


def envelope(
    samples: DataFrame, channel: str, width: int, order: Sequence[str] = ("t",), chunk: int = CHUNK_ROWS,
    lowpass_hz: float = LOWPASS_HZ, lowpass_order: int = LOWPASS_ORDER, sample_hz: float = SAMPLE_HZ,
) -> DataFrame:
    """Rectified, zero-phase low-passed signal as column `envelope`; a series too short for the filter's edges yields no rows."""
    low = Filter(butterworth_low(lowpass_order, lowpass_hz, sample_hz))
    rectified = samples.withColumn("__size", F.abs(F.col(channel).cast("double")))
    return zero_phase(rectified, "__size", low, width, order, chunk, "envelope").drop("__size")


def flag_above(series: DataFrame, value: str, factor: float = 3.0) -> DataFrame:
    """`above` where the value exceeds `factor` x the exact median of its series."""
    medians = exact_percentiles(series, ["session_id"], value, {"__median": 0.5})
    return series.join(medians, "session_id").withColumn("above", F.col(value) > F.lit(factor) * F.col("__median")).drop("__median")


def runs(flagged: DataFrame, peak: Column, width: int, order: Sequence[str] = ("t",)) -> DataFrame:
    """Contiguous stretches of `above` rows: session_id, start_t, end_t, peak."""
    rows = flagged.select("session_id", *dict.fromkeys([*order, "t"]), "above", peak.alias("peak")).withColumn(
        "__bucket", time_bucket("t", width)
    )
    numbered = islands(rows, ["session_id"], "__bucket", order, F.col("above"), "run")
    position = F.struct(*order)
    return numbered.where("above").groupBy("session_id", "run").agg(
        F.min_by("t", position).alias("start_t"), F.max_by("t", position).alias("end_t"), F.max("peak").alias("peak")
    ).drop("run")


def merge_close(intervals: DataFrame, gap: int, width: int) -> DataFrame:
    """Join intervals whose start lies at most `gap` after the furthest end so far."""
    rows = intervals.select("session_id", "start_t", "end_t", "peak").withColumn("__bucket", time_bucket("start_t", width))
    order = ["start_t", "end_t", "peak"]
    reach = running(rows, ["session_id"], "__bucket", order, {"__reach": Running("max", F.col("end_t"), inclusive=False)})
    fresh = F.when(F.col("__reach").isNull() | (F.col("start_t") - F.col("__reach") > F.lit(gap)), 1).otherwise(0).cast("long")
    grouped = running(reach, ["session_id"], "__bucket", order, {"__group": Running("sum", fresh)})
    return grouped.groupBy("session_id", "__group").agg(
        F.min("start_t").alias("start_t"), F.max("end_t").alias("end_t"), F.max("peak").alias("peak")
    ).drop("__group")


def at_least(intervals: DataFrame, duration: int) -> DataFrame:
    return intervals.where(F.col("end_t") - F.col("start_t") >= duration)


def find_candidates(
    packets: DataFrame, channel: str = "emg_raw", factor: float = 3.0, min_gap: int = 200, min_duration: int = 50,
    width: int = 600_000, order: Sequence[str] = ("t",), chunk: int = CHUNK_ROWS, lowpass_hz: float = LOWPASS_HZ,
) -> DataFrame:
    """Candidate intervals (start_t, end_t, peak) of every session's muscle signal."""
    smooth = cut_lineage(envelope(packets.select("session_id", *dict.fromkeys([*order, "t", channel])), channel, width, order, chunk, lowpass_hz))
    flagged = flag_above(smooth, "envelope", factor)  # reads the envelope several times, hence the written copy
    found = cut_lineage(runs(flagged, F.abs(F.col(channel).cast("int")), width, order))
    return at_least(merge_close(found, min_gap, width), min_duration)


def rolling_lookback(samples: DataFrame, lookback: int, aggs: dict[str, Column], width: int | None = None) -> DataFrame:
    """Aggregates over [t - lookback, t], both ends closed, for every sample.

    Rows are copied into the buckets that look back to them, so a series is windowed bucket by bucket.
    """
    halo = trailing_halo(samples, "t", width or lookback, lookback)
    w = W.partitionBy("session_id", "__bucket").orderBy("t").rangeBetween(-lookback, 0)
    return halo.select(*samples.columns, "__core", *[a.over(w).alias(n) for n, a in aggs.items()]).where("__core").drop("__core")
