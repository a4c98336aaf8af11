"""Live monitoring of runs: windows over measurement time with late rows dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(rows: DataFrame, time: str, value: str, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean and range of a value for each run and window; batch or stream alike."""
    at = F.col(time).cast("timestamp")  # a watermark needs a timestamp with a zone
    w = F.window("at", size, slide) if slide else F.window("at", size)
    got = rows.withColumn("at", at).withWatermark("at", late).groupBy("run_id", w.alias("w")).agg(F.count(F.lit(1)).alias("rows"), F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("range"))
    return got.select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "mean", "range")


def sessions(rows: DataFrame, time: str, value: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """The same for each run and session: rows less than `gap` apart; batch or stream alike."""
    at = F.col(time).cast("timestamp")
    got = rows.withColumn("at", at).withWatermark("at", late).groupBy("run_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("rows"), F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("range"))
    return got.select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "mean", "range")
