"""Outcome marks matched with alerts while both still arrive."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_outcomes(alerts: DataFrame, outcomes: DataFrame, grace: int, horizon: int, lateness: int, per_second: int = 1000) -> DataFrame:
    """Last alert at or before each outcome mark of two streams, for any order of arrival within `lateness`.

    alerts: session_id, t, alert_idx. outcomes: session_id, t, outcome_id, event. Times are whole numbers, `per_second` to
    the second, as are grace, horizon and lateness. An interval join keeps the alerts of one horizon as state; a mark leaves
    once, when the watermark has passed it, so with an alert or without one. The alert is matched within `grace`; the delay
    is reported up to `horizon` (matching.match_outcomes has no such bound, as a table needs no expiry). Of alerts at one
    time the largest alert_idx counts. Later rows than `lateness` allows are dropped. Marks alike in all columns are one.
    """
    def at(column):
        return F.timestamp_micros((F.col(column) * F.lit(1_000_000 // per_second)).cast("long"))

    def span(value):
        return f"{value * (1_000_000 // per_second)} microseconds"

    a = alerts.select(F.col("session_id").alias("a_session"), F.col("t").cast("long").alias("a_t"), F.col("alert_idx").cast("long").alias("a_idx"))
    a = a.withColumn("a_at", at("a_t")).withWatermark("a_at", span(lateness))
    o = outcomes.select("session_id", F.col("t").cast("long").alias("t"), F.col("outcome_id").cast("long").alias("outcome_id"), "event")
    o = o.withColumn("at", at("t")).withWatermark("at", span(lateness))
    near = F.expr(f"session_id = a_session and a_at <= at and a_at >= at - interval {span(horizon)}")
    last = F.max(F.when(F.col("a_t").isNotNull(), F.struct("a_t", "a_idx"))).alias("last")
    found = o.join(a, near, "left_outer").groupBy("at", "session_id", "outcome_id", "t", "event").agg(last)
    since = F.col("t") - F.col("last.a_t")
    return found.select("session_id", "outcome_id", "t", "event", F.when(since <= grace, F.col("last.a_idx")).alias("matched_alert_idx"), since.alias("since_alert"))
