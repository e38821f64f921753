"""Inter-beat intervals, ectopic rejection, heart-rate trend and variability with their quality gates.

Beat tables hold window_id, session_id, t. All frames are per window (at most a few hundred beats).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

# Fixed values of the quality gates.
NEIGHBOURS = 5
REJECT_FRACTION = 0.20
MIN_TREND_IBIS = 5
MIN_HRV_IBIS = 10
MIN_SEGMENT_SAMPLES = 10
PLAUSIBLE_BPM = (40.0, 180.0)


def inter_beat_intervals(beats: DataFrame, unit_ms: float = 1.0) -> DataFrame:
    """Positive differences of beat times in ms, each carrying the time of its closing beat."""
    w = W.partitionBy("window_id").orderBy("t")
    gap = (F.col("t") - F.lag("t").over(w)) * F.lit(unit_ms)
    return beats.withColumn("ibi", gap.cast("double")).where(F.col("ibi") > 0)


def reject_ectopic(ibis: DataFrame, neighbours: int = NEIGHBOURS, fraction: float = REJECT_FRACTION) -> DataFrame:
    """`valid` is false where an interval is off the median of its neighbours (itself left out) by more than `fraction`."""
    w = W.partitionBy("window_id").orderBy("t")
    around = F.array_sort(F.concat(
        F.collect_list("ibi").over(w.rowsBetween(-neighbours, -1)), F.collect_list("ibi").over(w.rowsBetween(1, neighbours))
    ))
    n = F.size("around")
    lower = F.element_at("around", ((n + 1) / 2).cast("int"))
    upper = F.element_at("around", (n / 2).cast("int") + 1)
    local = F.when(n > 0, (lower + upper) / 2)
    off = F.abs(F.col("ibi") - F.col("local_median")) / F.col("local_median") > F.lit(fraction)
    return ibis.withColumn("around", around).withColumn("local_median", local).drop("around").withColumn(
        "valid", ~F.coalesce((F.col("local_median") > 0) & off, F.lit(False))
    )


def heart_features(checked: DataFrame) -> DataFrame:
    """Per window: plain heart rate, trend and variability; NULL where too few valid intervals remain.

    `checked` needs seg_start_s (start of the segment in seconds of t's clock is not needed: slopes do not depend on it).
    """
    w = W.partitionBy("window_id").orderBy("t")
    rows = checked.select(
        "window_id", "t", "ibi", "valid",
        F.lag("ibi").over(w).alias("ibi_before"), F.lag("valid").over(w).alias("valid_before"),
        F.min("t").over(W.partitionBy("window_id")).alias("t0"),
    )
    ok = F.col("valid")
    rate = F.when(ok, F.lit(60000.0) / F.col("ibi"))
    seconds = F.when(ok, (F.col("t") - F.col("t0")) / F.lit(1000.0))
    step = F.when(ok & F.col("valid_before"), F.col("ibi") - F.col("ibi_before"))
    sums = rows.groupBy("window_id").agg(
        F.count("*").alias("n_ibis"),
        F.avg(F.lit(60000.0) / F.col("ibi")).alias("raw_hr_mean"),
        F.count(F.when(ok, 1)).alias("n_valid"),
        F.avg(rate).alias("trend_mean"),
        F.regr_slope(rate, seconds).alias("slope"),
        F.count(step).alias("n_steps"),
        F.sqrt(F.avg(step * step)).alias("rmssd"),
        F.stddev_pop(F.when(ok, F.col("ibi"))).alias("sdnn"),
    )
    plausible = (F.col("n_ibis") >= 2) & F.col("raw_hr_mean").between(*PLAUSIBLE_BPM)
    trend = plausible & (F.col("n_valid") >= MIN_TREND_IBIS)
    hrv = plausible & (F.col("n_valid") >= MIN_HRV_IBIS)
    return sums.select(
        "window_id", "n_ibis",
        F.when(F.col("n_ibis") >= 2, F.col("raw_hr_mean")).alias("raw_hr_mean"),
        F.coalesce(plausible, F.lit(False)).alias("plausible_hr"),
        F.when(plausible, F.col("n_valid")).otherwise(0).alias("n_valid"),
        F.when(trend, F.col("trend_mean")).alias("hr_trend_mean"),
        F.when(trend, F.col("slope") * 60.0).alias("hr_trend_slope"),
        F.when(hrv & (F.col("n_steps") >= MIN_HRV_IBIS - 1), F.col("rmssd")).alias("rmssd_clean"),
        F.when(hrv, F.col("sdnn")).alias("sdnn_clean"),
    )


def quality_record(segments: DataFrame, beats: DataFrame, unit_ms: float = 1.0) -> DataFrame:
    """Cardiac features and gate outcomes for every segment (window_id, n_samples), also those without beats."""
    measured = heart_features(reject_ectopic(inter_beat_intervals(beats, unit_ms)))
    counts = beats.groupBy("window_id").agg(F.count("*").alias("n_peaks"))
    out = segments.select("window_id", "n_samples").join(counts, "window_id", "left").join(measured, "window_id", "left")
    enough = (F.col("n_samples") >= MIN_SEGMENT_SAMPLES) & (F.coalesce("n_peaks", F.lit(0)) >= 2)
    values = ["raw_hr_mean", "hr_trend_mean", "hr_trend_slope", "rmssd_clean", "sdnn_clean"]
    return out.select(
        "window_id", F.col("n_samples").alias("n_samples_in_segment"),
        F.when(F.col("n_samples") >= MIN_SEGMENT_SAMPLES, F.coalesce("n_peaks", F.lit(0))).otherwise(0).alias("n_raw_peaks"),
        *[F.when(enough, F.col(v)).alias(v) for v in values],
        (enough & F.coalesce("plausible_hr", F.lit(False))).alias("plausible_hr"),
        F.when(enough, F.coalesce("n_valid", F.lit(0))).otherwise(0).alias("n_valid_ibis"),
        (enough & F.col("hr_trend_slope").isNotNull()).alias("trend_ok"),
        (enough & F.col("rmssd_clean").isNotNull() & F.col("sdnn_clean").isNotNull()).alias("hrv_ok"),
    )


def quality_funnel(records: DataFrame) -> DataFrame:
    both = F.col("trend_ok") & F.col("hrv_ok")
    flag = lambda c: F.count(F.when(c, 1))
    return records.agg(
        F.count("*").alias("n_anchors"), flag(F.col("plausible_hr")).alias("n_plausible"),
        flag(F.col("trend_ok")).alias("n_trend_ok"), flag(F.col("hrv_ok")).alias("n_hrv_ok"), flag(both).alias("n_both_ok"),
    )


def heart_configurations(joined: DataFrame, base: list[str], ids: list[str]) -> dict[str, DataFrame]:
    """The four feature tables on the rows that pass both gates."""
    common = joined.where(F.col("trend_ok") & F.col("hrv_ok"))
    trend, hrv = ["hr_trend_mean", "hr_trend_slope"], ["rmssd_clean", "sdnn_clean"]
    extra = {"A_only": [], "A_plus_hr_trend": trend, "A_plus_hrv": hrv, "A_plus_both": trend + hrv}
    return {name: common.select(*ids, *base, *more) for name, more in extra.items()}


def variability_pair(joined: DataFrame, base: list[str], ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that pass the variability gate, without and with the two variability columns."""
    common = joined.where(F.col("hrv_ok"))
    return common.select(*ids, *base), common.select(*ids, *base, "rmssd_clean", "sdnn_clean")
