"""Live scoring of packet streams: rolling window, evaluation cadence, cool-down and outcome matching."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinetide.functions import dsp
from kinetide.operators.features import ACCEL, GYRO, IMU, TIME_STATS
from kinetide.operators.spectral import IMU_SCALES

OUTCOMES = ["confirmed_pick", "false_alarm", "missed_pick"]  # fixed vocabulary
OUTPUT = (
    "session_id string, kind string, eval_idx long, t long, n_samples long, probability double, alert_fired boolean, "
    "suppressed_by_cooldown boolean, event string, matched_alert_idx long, since_alert long, n_late long"
)
STATE = (
    "t array<bigint>, v array<array<double>>, last_eval bigint, last_fired bigint, last_alert bigint, next_idx bigint, "
    "newest bigint, n_late bigint, seen bigint, held_t array<bigint>, held_v array<array<double>>, held_event array<string>"
)
Vectoriser = Callable[[np.ndarray, dict[str, np.ndarray], int], dict[str, float]]


def check_model(model: dict, window: int, training_window: int) -> list[str]:
    """A stored model must be complete; a window other than the training window is only warned about."""
    sizes = {len(model[k]) for k in ("names", "mean", "scale", "coef")}
    if len(sizes) != 1:
        raise ValueError(f"model parts differ in length: { {k: len(model[k]) for k in ('names', 'mean', 'scale', 'coef')} }")
    if window != training_window:
        return [f"window {window} differs from the training window {training_window}: spectral features will shift"]
    return []


def _stats(x: np.ndarray, name: str) -> dict[str, float]:
    values = [x.mean(), x.std(), x.min(), x.max(), np.sqrt(np.mean(x * x)), dsp.zero_crossing_rate(x)]
    return {f"{name}_{s}": float(v) for s, v in zip(TIME_STATS, values)}


def imu_vector(t: np.ndarray, v: dict[str, np.ndarray], end: int, jerk: bool = False) -> dict[str, float]:
    """The 54 IMU features of one window (and the 18 of its jerk)."""
    out: dict[str, float] = {}
    for c in IMU:
        x = v[c] * IMU_SCALES[c]
        out |= _stats(x, c)
        out |= {f"{c}_{s}": f for s, f in zip(("dominant_freq", "power_0_5hz", "power_5_15hz"), dsp.spectrum_stats(x, dsp.PULSE_HZ))}
        if jerk and c in ACCEL:
            out |= _stats(np.diff(x) * dsp.PULSE_HZ if len(x) > 1 else np.zeros(1), c.replace("accel_", "jerk_"))
    return out


def multi_horizon_vector(lengths: dict[int, str], extra: Vectoriser | None = None) -> Vectoriser:
    """IMU and jerk features at several lengths ending at `end`, e.g. {30000: 'w30', ...}."""
    def run(t: np.ndarray, v: dict[str, np.ndarray], end: int) -> dict[str, float]:
        out: dict[str, float] = {}
        for length, prefix in lengths.items():
            part = (t >= end - length) & (t < end)
            if part.any():
                cut = {c: x[part] for c, x in v.items()}
                out |= {f"{prefix}_{k}": f for k, f in imu_vector(t[part], cut, end, jerk=True).items()}
        return out | (extra(t, v, end) if extra else {})
    return run


def probability(vector: dict[str, float], model: dict) -> float:
    """Aligned, imputed, scaled and scored."""
    z = model["intercept"]
    for name, mean, scale, coef in zip(model["names"], model["mean"], model["scale"], model["coef"]):
        x = vector.get(name)
        if x is None or np.isnan(x):
            x = model["medians"][name]
        z += (x - mean) / scale * coef
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def live_alerts(
    packets: DataFrame, model: dict, vectorise: Vectoriser, channels: Sequence[str] = tuple(ACCEL + GYRO), window: int = 60_000,
    interval: int = 5_000, least: int = 1500, threshold: float = 0.5, cooldown: int = 30_000, grace: int = 300_000,
    lateness: int = 0,
) -> DataFrame:
    """Score each session's stream and match outcome marks.

    `packets` holds samples and marks: session_id, t, event (NULL for a sample), channels. Time is event time. A row waits
    until its session has shown one that is `lateness` newer, and rows are then taken in order, so files may come out of
    order by that much without a change of the result. Rows older than what was taken already are counted (n_late) and not
    used. State per session is the rolling window and what waits, at most (window + lateness) x sampling rate rows.
    """
    channels = list(channels)
    names = [part.split()[0] for part in OUTPUT.split(", ")]

    def table(rows: Sequence) -> np.ndarray:
        return np.array([list(r) for r in rows], dtype=float).reshape(-1, len(channels))

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # plain arrays: a session has few rows a batch, and a frame costs more than they do
        parts = [(f[channels].to_numpy(float), f["t"].to_numpy(np.int64), f["event"].to_numpy(object)) for f in frames]
        if state.exists:
            t, v, last_eval, last_fired, last_alert, next_idx, newest, n_late, seen, *held = state.get
            if len(held[0]):
                parts.insert(0, (table(held[1]), np.array(held[0], np.int64), np.array(list(held[2]), object)))
        else:
            t, v, last_eval, last_fired, last_alert, next_idx, newest, n_late, seen = [], [], None, None, None, 0, None, 0, None
        values, times, events = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(times, kind="stable")
        values, times, events = values[order], times[order], events[order]
        seen = int(times[-1]) if seen is None else max(seen, int(times[-1]))
        taken = int(np.searchsorted(times, seen - lateness, side="right")) if lateness else len(times)
        kept_t, kept_v = np.concatenate([np.array(t, np.int64), times[:taken]]), np.concatenate([table(v), values[:taken]])
        low, size = 0, len(t)
        out = []
        for i, now in enumerate(times[:taken].tolist()):
            if newest is not None and now < newest:
                n_late += 1
                continue
            newest = now
            if events[i] is not None and events[i] == events[i]:
                since = None if last_fired is None else now - last_fired
                matched = last_alert if since is not None and since <= grace else None
                out.append((key[0], "outcome", None, now, None, None, None, None, events[i], matched, since, n_late))
                continue
            kept_t[size], kept_v[size] = now, values[i]
            size += 1
            while kept_t[low] < now - window:
                low += 1
            if last_eval is not None and now - last_eval < interval:
                continue
            last_eval = now
            if size - low < least:
                continue
            now_t, now_v = kept_t[low:size], kept_v[low:size]
            p = probability(vectorise(now_t, {c: now_v[:, j] for j, c in enumerate(channels)}, now + 1), model)
            hot = p >= threshold
            quiet = hot and last_fired is not None and now - last_fired < cooldown
            if hot and not quiet:
                last_fired, last_alert = now, next_idx
            out.append((key[0], "eval", next_idx, now, len(now_t), None if np.isnan(p) else p, hot and not quiet, quiet, None, None, None, n_late))
            next_idx += 1
        waiting = (times[taken:].tolist(), values[taken:].tolist(), [e if isinstance(e, str) else None for e in events[taken:]])
        state.update((kept_t[low:size].tolist(), kept_v[low:size].tolist(), last_eval, last_fired, last_alert, next_idx, newest, n_late, seen, *waiting))
        yield pd.DataFrame(out, columns=names, dtype=object)

    return packets.groupBy("session_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def sliding_features(packets: DataFrame, ts: str, channels: Sequence[str], window: str = "60 seconds", slide: str = "5 seconds",
                     watermark: str = "10 seconds", least: int = 1) -> DataFrame:
    """Time-domain features of sliding windows as a native streaming aggregate (no order inside a window needed)."""
    aggs = [F.count("*").alias("n_samples")]
    for c in channels:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_std"), F.min(x).alias(f"{c}_min"),
                 F.max(x).alias(f"{c}_max"), F.sqrt(F.avg(x * x)).alias(f"{c}_rms")]
    grouped = packets.withWatermark(ts, watermark).groupBy("session_id", F.window(ts, window, slide).alias("w"))
    return grouped.agg(*aggs).where(F.col("n_samples") >= least).withColumn("window_end", F.col("w.end")).drop("w")


def score_rows(features: DataFrame, model: dict) -> DataFrame:
    """Probability of a linear model as one native expression."""
    z = F.lit(float(model["intercept"]))
    for name, mean, scale, coef in zip(model["names"], model["mean"], model["scale"], model["coef"]):
        x = F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")), F.lit(model["medians"].get(name)))
        z = z + (x - F.lit(mean)) / F.lit(scale) * F.lit(coef)
    clipped = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))
    return features.withColumn("probability", F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped)))


def write_logs(alerts: DataFrame, out: str, checkpoint: str, available_now: bool = False):
    """Append the evaluation and outcome logs; a replayed batch overwrites its own folder, so rows appear once."""
    def save(batch: DataFrame, number: int) -> None:
        batch.persist()
        evals = batch.where(F.col("kind") == "eval").select(
            "session_id", "eval_idx", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("utc_iso"), F.col("t").alias("timestamp_ms"),
            F.col("n_samples").alias("n_samples_in_window"), "probability", "alert_fired", "suppressed_by_cooldown", "n_late")
        outcomes = batch.where(F.col("kind") == "outcome").select(
            "session_id", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("utc_iso"), F.col("t").alias("timestamp_ms"), "event",
            "matched_alert_idx", (F.col("since_alert") / 1000.0).alias("seconds_since_alert"), "n_late")
        evals.write.mode("overwrite").parquet(f"{out}/eval_log/batch={number}")
        outcomes.write.mode("overwrite").parquet(f"{out}/outcomes/batch={number}")
        batch.unpersist()

    writer = alerts.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()
