"""Window features that need the whole ordered signal of one window: spectra, pulse rate and beats.

A window holds at most length x sampling rate samples, so one row with sorted arrays per window is small; the
numpy work runs in Arrow batches over those rows.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kinetide.functions import dsp
from kinetide.operators.features import ACCEL, ACCEL_LSB_PER_G, GYRO, GYRO_LSB_PER_DPS, SPECTRAL_STATS, TIME_STATS
from kinetide.operators.windows import slice_samples

PULSE_STATS = ["ppg_hr_mean", "ppg_hr_std", "ppg_hr_min", "ppg_hr_max", "ppg_rmssd"]
RMSSD_MIN_SPAN_MS = 300_000
IMU_SCALES = {c: 1 / ACCEL_LSB_PER_G for c in ACCEL} | {c: 1 / GYRO_LSB_PER_DPS for c in GYRO}


def window_arrays(
    samples: DataFrame, windows: DataFrame, channels: Sequence[str], width: int, least: int = 1,
    keep: Sequence[str] = (), order: Sequence[str] = ("t",),
) -> DataFrame:
    """One row per window: parallel arrays t and channels in time order."""
    ids = ["window_id", "session_id", "start_t", "end_t", "label", *keep]
    columns = list(dict.fromkeys([*order, "t", *channels]))
    sliced = slice_samples(samples.select("session_id", *columns), windows.select(*ids), width)
    packed = sliced.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("s"))
    return packed.where(F.size("s") >= least).select(
        *ids, F.size("s").cast("long").alias("n_samples"), *[F.col(f"s.{c}").alias(c) for c in dict.fromkeys(["t", *channels])]
    )


def _time_row(x: np.ndarray) -> list[float]:
    return [x.mean(), x.std(), x.min(), x.max(), np.sqrt(np.mean(x * x)), dsp.zero_crossing_rate(x)]


def _pulse_row(ppg: np.ndarray, t: np.ndarray) -> list[float | None]:
    peaks = dsp.beat_positions(ppg)
    if len(peaks) < 2:
        return [None] * 5
    gaps = np.diff(peaks) / dsp.PULSE_HZ * 1000.0
    rate = 60000.0 / gaps
    enough = t[-1] - t[0] >= RMSSD_MIN_SPAN_MS and len(gaps) >= 2
    rmssd = float(np.sqrt(np.mean(np.diff(gaps) ** 2))) if enough else None
    return [float(rate.mean()), float(rate.std()), float(rate.min()), float(rate.max()), rmssd]


def array_features(
    arrays: DataFrame, channels: Sequence[str], fs: float, scales: dict[str, float] | None = None,
    pulse: bool = False, with_time_stats: bool = False, jerk_of: Sequence[str] = (),
) -> DataFrame:
    """Spectral (and on request pulse, time-domain and jerk) features from window arrays.

    Arrays may be in raw counts; `scales` gives the factor per channel.
    """
    scales = scales or {}
    channels = list(channels)
    stats = (TIME_STATS if with_time_stats else []) + SPECTRAL_STATS
    jerk_names = [f"{c.replace('accel_', 'jerk_')}_{s}" for c in jerk_of for s in TIME_STATS]
    names = [f"{c}_{s}" for c in channels for s in stats] + jerk_names + (PULSE_STATS if pulse else [])
    ids = [c for c in arrays.columns if c not in {*channels, "t", "ppg_ir"}]
    fields = arrays.select(*ids).schema.simpleString()[len("struct<"):-1]
    schema = ", ".join([fields.replace(":", " "), *[f"{n} double" for n in names]])
    used = [*ids, *channels] + (["t", "ppg_ir"] if pulse else [])

    def one(row) -> list:
        out: list[float | None] = []
        for c in channels:
            x = np.asarray(getattr(row, c), dtype=float) * scales.get(c, 1.0)
            if with_time_stats:
                out += _time_row(x)
            out += dsp.spectrum_stats(x, fs)
        for c in jerk_of:
            x = np.asarray(getattr(row, c), dtype=float) * scales.get(c, 1.0)
            out += _time_row(np.diff(x) * fs if len(x) > 1 else np.zeros(1))
        if pulse:
            out += _pulse_row(np.asarray(row.ppg_ir, dtype=float), np.asarray(row.t, dtype=float))
        return out

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = pd.DataFrame([one(r) for r in frame.itertuples(index=False)], columns=names, index=frame.index, dtype=float)
            yield pd.concat([frame[ids], values.astype(object).where(values.notna(), None)], axis=1)

    return arrays.select(*used).mapInPandas(batches, schema)


def compute_features(samples: DataFrame, windows: DataFrame, width: int, least: int = 1, keep: Sequence[str] = (),
                     order: Sequence[str] = ("t",)) -> DataFrame:
    """The 59 standard features of IMU and pulse windows, from raw packet columns; `order` tells packets of one time apart."""
    channels = ACCEL + GYRO
    arrays = window_arrays(samples, windows, [*channels, "ppg_ir"], width, least, keep, order)
    return array_features(arrays, channels, dsp.PULSE_HZ, IMU_SCALES, pulse=True, with_time_stats=True)


def beats(arrays: DataFrame, least: int = 10) -> DataFrame:
    """Beat times of each window: window_id, session_id, beat (1-based), t. `arrays` carries t and ppg_ir."""

    @F.pandas_udf("array<bigint>")
    def positions(ppg: pd.Series) -> pd.Series:
        return ppg.map(lambda x: dsp.beat_positions(np.asarray(x, dtype=float)) if len(x) >= least else np.zeros(0, dtype=np.int64))

    found = arrays.select("window_id", "session_id", "t", positions("ppg_ir").alias("p"))
    return found.select(
        "window_id", "session_id",
        F.posexplode(F.transform("p", lambda i: F.element_at("t", (i + 1).cast("int")))).alias("beat", "t"),
    ).withColumn("beat", F.col("beat") + 1)
