"""Streaming counterparts of the time windows: the same functions take batch and streaming tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hourly_from_segments(segments: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Hours (station_id, hour, value) with all four quarter-hour segments known; segments: (station_id, ts, value)."""
    return (
        segments.withWatermark("ts", delay)
        .groupBy("station_id", F.window("ts", "1 hour").alias("w"))
        .agg(F.sum("value").alias("value"), F.approx_count_distinct(F.minute("ts")).alias("quarters"), F.count("value").alias("known"))
        .filter("quarters = 4 AND known = 4")
        .select("station_id", F.col("w.start").alias("hour"), "value")
    )


def met_days(hours: DataFrame, delay: str = "1 day", start: str = "9 hours") -> DataFrame:
    """Totals of days that start at 9; days without 24 known hours give NULL."""
    return (
        hours.withWatermark("time", delay)
        .groupBy("station_id", F.window("time", "1 day", "1 day", start).alias("w"))
        .agg(F.count("value").alias("known"), F.sum("value").alias("sum"))
        .select("station_id", F.col("w.start").alias("day_start"), F.when(F.col("known") == 24, F.col("sum")).alias("total"), "known")
    )


def rain_events(hours: DataFrame, wet: float = 0.1, gap: str = "3 hours", delay: str = "6 hours") -> DataFrame:
    """Wet hours less than the gap apart as sessions."""
    return (
        hours.filter(F.col("value") >= wet)
        .withWatermark("time", delay)
        .groupBy("station_id", F.session_window("time", gap).alias("w"))
        .agg(F.sum("value").alias("total"), F.max("value").alias("peak"), F.count("*").alias("wet_hours"))
        .select("station_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "peak", "wet_hours")
    )


def first_of_each(rows: DataFrame, keys: list[str], time: str = "time", delay: str = "1 hour", order: list[str] | None = None) -> DataFrame:
    """A stream's first row that comes for each key within the watermark; of a batch, the first by ``order`` (then by time)."""
    if rows.isStreaming:
        return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or []), time, *(c for c in rows.columns if c not in keys and c != time)))
    return rows.withColumn("__first", first).filter("__first = 1").drop("__first")


def whole_blocks(hours: DataFrame, width: int, delay: str = "1 day") -> DataFrame:
    """Sums of blocks of ``width`` hours (1, 3, 24 ...) by station; NULL where an hour is missing."""
    out = hours.withWatermark("time", delay).groupBy("station_id", F.window("time", f"{width} hours").alias("w")).agg(F.count("value").alias("known"), F.sum("value").alias("sum"))
    return out.select("station_id", F.col("w.start").alias("start"), F.when(F.col("known") == width, F.col("sum")).alias("total"), "known")
