"""Nearest, as-of and positional joins without pairing whole groups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kinetide.operators.ordered import Running, running, time_bucket


def nearest_controls(rows: DataFrame, width: int, group: str = "day_str") -> DataFrame:
    """Pair each positive with the nearest negative of its group; ties go to the lowest idx, controls are reused.

    Two running scans (last negative before, next negative after) replace the join of all pairs.
    Input: group, idx, t, label. Output: group, case_idx, control_idx, distance.
    """
    base = rows.select(
        group, "idx", "t", "label", (-F.col("idx")).alias("__minus"), F.col("label").alias("__pos"),
        (1 - F.col("label")).alias("__neg"), time_bucket("t", width).alias("__bucket"),
    )
    control = F.when(F.col("label") == 0, F.struct(F.col("t").alias("t"), F.col("idx").alias("idx")))
    specs = {"__before": Running("last", control), "__after": Running("last", control, reverse=True)}
    both = running(base, [group], "__bucket", ["t", "__pos", "__minus"], specs, ["t", "__neg", "idx"])
    offer = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.t") - F.col("t")).alias("d"), F.col(f"{c}.idx").alias("i")))
    best = F.least(offer("__before"), offer("__after"))
    return both.where(F.col("label") == 1).withColumn("__best", best).where(F.col("__best").isNotNull()).select(
        group, F.col("idx").alias("case_idx"), F.col("__best.i").alias("control_idx"), F.col("__best.d").alias("distance")
    )


def match_outcomes(alerts: DataFrame, outcomes: DataFrame, grace: int, width: int) -> DataFrame:
    """Last alert at or before each outcome mark; matched only within `grace`, the delay is reported regardless.

    alerts: session_id, t, alert_idx. outcomes: session_id, t, outcome_id, event.
    """
    a = alerts.select("session_id", "t", F.lit(0).alias("__mark"), F.col("alert_idx").cast("long").alias("__id"),
                      F.lit(None).cast("string").alias("event"))
    o = outcomes.select("session_id", "t", F.lit(1).alias("__mark"), F.col("outcome_id").cast("long").alias("__id"), "event")
    both = a.unionByName(o).withColumn("__bucket", time_bucket("t", width))
    alert = F.when(F.col("__mark") == 0, F.struct(F.col("t").alias("t"), F.col("__id").alias("idx")))
    seen = running(both, ["session_id"], "__bucket", ["t", "__mark", "__id"], {"__last": Running("last", alert)})
    since = F.col("t") - F.col("__last.t")
    return seen.where(F.col("__mark") == 1).select(
        "session_id", F.col("__id").alias("outcome_id"), "t", "event",
        F.when(since <= grace, F.col("__last.idx")).alias("matched_alert_idx"), since.alias("since_alert"),
    )


def positional_zip(left: DataFrame, right: DataFrame, key: str = "window_id", order: str = "t", least: int = 0) -> DataFrame:
    """Pair the i-th row of each window in both streams, cut to the shorter; short windows are dropped."""
    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn("row_no", F.row_number().over(W.partitionBy(key).orderBy(order)))

    zipped = numbered(left).join(numbered(right).drop(order), [key, "row_no"])
    if least <= 1:
        return zipped
    return zipped.withColumn("__n", F.count("*").over(W.partitionBy(key))).where(F.col("__n") >= least).drop("__n")


def coalesce_override(names: DataFrame, mapping: DataFrame, name: str, source: str = "source") -> DataFrame:
    """Replace a name by its mapped source where the (small, fixed) mapping has one."""
    return names.join(F.broadcast(mapping), name, "left").withColumn(source, F.coalesce(source, name))


def minutes_seconds(value: Column, start: Column) -> Column:
    """Clock of an event written as MM.SS decimal minutes after `start`, in ms, cut to whole ms."""
    whole = F.floor(value)
    return (start + whole * 60 * 1000 + (value - whole) * 100 * 1000).cast("long")
