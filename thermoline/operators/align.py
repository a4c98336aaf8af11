"""Temperature onto a measurement series: by frame, or by time with linear interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_frame(series: DataFrame, log: DataFrame) -> DataFrame:
    """Left join on run and frame. Only the temperature is taken, so other columns may share names; a log with a frame twice gives two rows."""
    return series.join(log.select("run_id", "frame", "temperature_c"), ["run_id", "frame"], "left")


#: Seconds of a run that one window holds.
BUCKET_SEC = 600.0


def by_time(series: DataFrame, log: DataFrame, offset_sec: float = 0.0, bucket_sec: float = BUCKET_SEC) -> DataFrame:
    """Piecewise-linear temperature at each row's time; NULL before the first and after the last entry of the log.

    Entries and rows are ordered together in buckets of time, so no window holds more of a run
    than a bucket. The entries next to a bucket, over any number of buckets without one, come
    from windows over one row a bucket.
    """
    knots = log.where("time_sec IS NOT NULL AND temperature_c IS NOT NULL").groupBy("run_id", (F.col("time_sec") + F.lit(offset_sec)).alias("at")).agg(F.avg("temperature_c").alias("knot"))
    rows = series.withColumn("at", F.col("time_sec").cast("double")).withColumn("knot", F.lit(None).cast("double"))
    both = rows.withColumn("is_row", F.lit(True)).unionByName(knots.withColumn("is_row", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("bucket", F.floor(F.col("at") / bucket_sec))
    point = F.when(~F.col("is_row"), F.struct("at", "knot"))
    run = Window.partitionBy("run_id").orderBy("bucket")
    ends = both.groupBy("run_id", "bucket").agg(F.min(point).alias("first"), F.max(point).alias("last"))
    ends = ends.select(F.col("run_id").alias("end_run"), F.col("bucket").alias("end_bucket"), F.last("last", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("first", ignorenulls=True).over(run.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    w = Window.partitionBy("run_id", "bucket").orderBy("at", "is_row")
    both = both.withColumn("before", F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("after", F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("is_row")
    both = both.join(ends, F.col("run_id").eqNullSafe(F.col("end_run")) & (F.col("bucket") == F.col("end_bucket")), "left")
    b, a, t = F.coalesce("before", "earlier"), F.coalesce("after", "later"), F.col("at")
    value = F.when(b["at"] == t, b["knot"]).when(b.isNotNull() & a.isNotNull(), b["knot"] + (a["knot"] - b["knot"]) * (t - b["at"]) / (a["at"] - b["at"]))
    return both.withColumn("temperature_c", value).select(*series.columns, "temperature_c")
