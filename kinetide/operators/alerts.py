"""Alerts with a cool-down over recorded evaluations.

An evaluation at or above the threshold fires unless the last *fired* alert is less than the cool-down ago. That is a
chain along the session. Each session is cut into chunks of many cool-downs; a chunk is summarised as "first alert ->
last alert" for every alert it could begin with (those within one cool-down of its start), and only the summaries are
chained.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kinetide.operators.ordered import time_bucket

COOLDOWNS_PER_CHUNK = 1000
NEVER = -(2**63)  # marks a chunk without an alert


def _last_alert(t: np.ndarray, cooldown: int) -> np.ndarray:
    """Index of the last alert of the chain that begins at each position."""
    following = np.searchsorted(t, t + cooldown, side="left")
    last = np.arange(len(t))
    for i in range(len(t) - 1, -1, -1):
        if following[i] < len(t):
            last[i] = last[following[i]]
    return last


def _chain(t: np.ndarray, entry: int, cooldown: int) -> np.ndarray:
    fired = np.zeros(len(t), dtype=bool)
    i = int(np.searchsorted(t, entry, side="left"))
    while i < len(t):
        fired[i] = True
        i = int(np.searchsorted(t, t[i] + cooldown, side="left"))
    return fired


def cooldown_alerts(evals: DataFrame, cooldown: int, threshold: float = 0.5, chunk: int = COOLDOWNS_PER_CHUNK,
                    probability: str = "probability") -> DataFrame:
    """Add alert_fired and suppressed_by_cooldown. evals: session_id, eval_id (unique), t, probability."""
    span = chunk * cooldown
    hot = evals.where(F.col(probability) >= threshold).select(
        "session_id", F.col("eval_id").cast("long").alias("eval_id"), F.col("t").cast("long").alias("t"), time_bucket("t", span).alias("chunk")
    )
    chunks = hot.groupBy("session_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("t", "eval_id"))).alias("e")).select(
        "session_id", "chunk", F.col("e.t").alias("t"), F.col("e.eval_id").alias("eval_id"))

    @F.pandas_udf("entry array<bigint>, exit array<bigint>")
    def summarise(number: pd.Series, times: pd.Series) -> pd.DataFrame:
        out = []
        for c, x in zip(number, times):
            t = np.unique(x)
            last = _last_alert(t, cooldown)
            first = np.arange(min(int(np.searchsorted(t, c * span + cooldown, side="left")) + 1, len(t)))
            out.append((t[first], t[last[first]]))
        return pd.DataFrame(out, columns=["entry", "exit"])

    @F.pandas_udf("array<bigint>")
    def connect(entries: pd.Series, exits: pd.Series) -> pd.Series:
        """First alert of every chunk in turn."""
        out = []
        for starts, ends in zip(entries, exits):
            picked, ready = [], None
            for entry, last in zip(starts, ends):
                i = 0 if ready is None else int(np.searchsorted(entry, ready, side="left"))
                picked.append(int(entry[i]) if i < len(entry) else NEVER)
                ready = int(last[i]) + cooldown if i < len(entry) else ready
            out.append(picked)
        return pd.Series(out)

    @F.pandas_udf("array<boolean>")
    def mark(times: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([_chain(np.asarray(x), int(first), cooldown) if first != NEVER else np.zeros(len(x), bool) for x, first in zip(times, entry)])

    maps = chunks.select("session_id", "chunk", summarise("chunk", "t").alias("m"))
    ordered = maps.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "m.entry", "m.exit"))).alias("s"))
    entries = ordered.select("session_id", F.explode(F.arrays_zip(
        F.col("s.chunk").alias("chunk"), connect("s.entry", "s.exit").alias("first"))).alias("z")).select("session_id", "z.chunk", "z.first")
    marked = chunks.join(entries, ["session_id", "chunk"]).select("session_id", F.explode(F.arrays_zip(
        F.col("eval_id"), mark("t", "first").alias("fired"))).alias("z"))
    fired = marked.select("session_id", "z.eval_id", "z.fired")
    joined = evals.join(fired, ["session_id", "eval_id"], "left")
    return joined.withColumn("alert_fired", F.coalesce("fired", F.lit(False))).withColumn(
        "suppressed_by_cooldown", F.col("fired").isNotNull() & ~F.col("alert_fired")
    ).drop("fired")


def evaluation_ticks(samples: DataFrame, interval: int) -> DataFrame:
    """First sample of every interval of each session: where a recorded feed is evaluated."""
    return samples.groupBy("session_id", time_bucket("t", interval).alias("tick")).agg(F.min("t").alias("t"))


def live_windows(ticks: DataFrame, lookback: int) -> DataFrame:
    """Window [t - lookback, t], closed at both ends, of every tick."""
    return ticks.select(
        F.concat_ws(":", F.lit("e"), F.col("session_id").cast("string"), F.col("t").cast("string")).alias("window_id"),
        "session_id", (F.col("t") - F.lit(lookback)).alias("start_t"), (F.col("t") + 1).alias("end_t"),
        F.lit(0).alias("label"), F.lit(0).alias("horizon"),
    )
