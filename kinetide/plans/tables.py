"""The driver's tables seen as sensor data: sessions are users, time is microseconds, markers are 'error' events."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR
BUFFER = HOUR
LOOKBACK = 72 * HOUR
LEAST = 3
SHORT = 24 * HOUR  # lookback of the labelled data set, short enough to leave room for negatives
SHORT_LEAST = 2
SHIPMENT_BUCKET = 1 << 27
BEAT_SPAN = 240 * HOUR
BEAT_UNIT = 2e-8  # scales gaps between events to the size of heart beats in ms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds of a zone-less timestamp, whatever the session's time zone."""
    return F.expr(f"cast(cast(cast({ts} - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20,6)) * 1000000 as bigint)")


def day_of(t: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t / F.lit(DAY)).cast("int")).cast("string")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    return raw.select(
        F.col("user_id").alias("session_id"), micros("ts").alias("t"), "event_id", "event_type", "value",
        (F.col("value") - F.lit(50.0)).alias("x"), "props", F.col("ts").cast("date").cast("string").alias("day_str"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("session_id", "t", "x")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("event_type") == "error").select(
        F.col("event_id").alias("marker_id"), "session_id", "t", F.col("event_type").alias("event")
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a long series per supplier: file order is (order, line, day, flags), the clock is days since 1992."""
    raw = table(spark, sf_dir, "lineitem")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    flags = F.ascii("l_returnflag") % 4 * 2 + F.ascii("l_linestatus") % 2
    return raw.select(
        F.col("l_suppkey").alias("session_id"),
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4096 + days) * 8 + flags).alias("file_offset"),
        days.alias("t"),
        "l_returnflag", "l_linestatus",
    )


def embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """All 64 dimensions as features, label >= 5 as class, vec_id % 5 as day."""
    raw = table(spark, sf_dir, "embeddings")
    names = [f"e{i:02d}" for i in range(64)]
    return raw.select(
        "vec_id", F.concat(F.lit("d"), (F.col("vec_id") % 5).cast("string")).alias("day_str"),
        (F.col("label") >= 5).cast("int").alias("label"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
    ), names
