"""Measurement runs made from the event table, for queries over tables that hold no recordings.

A user's events are a run: their order is the frame, the running sum of values is progress
from 0 to 1, and an `error` event is a frame whose extraction failed. Sums are decimals, so
they are exact whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thermoline.operators.dealing import dealt


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, frame, n, time_sec, temperature_c, k, event_type and p, the share of the run's total value so far."""
    e = events(spark, sf_dir)
    e = dealt(e.select(F.col("user_id").alias("run_id"), "ts", "event_id", "event_type", F.col("value").cast("decimal(18,4)").alias("v"), F.get_json_object("props", "$.k").cast("int").alias("k")), "run_id", rows=e.count())
    run = Window.partitionBy("run_id")
    w = run.orderBy("ts", "event_id")
    e = e.select("run_id", "event_type", "k", (F.row_number().over(w) - 1).cast("long").alias("frame"), F.count(F.lit(1)).over(run).alias("n"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("cum"), F.sum("v").over(run).cast("double").alias("total"))
    return e.select("run_id", "frame", "n", "event_type", "k", (F.col("frame") / 20.0).alias("time_sec"), (20.0 + 45.0 * F.col("frame") / F.greatest(F.col("n") - 1, F.lit(1))).alias("temperature_c"), F.round(F.col("cum") / F.col("total"), 9).alias("p"))


def wire_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wire series. Runs differ: a third never reaches the plateau, a fifth has a jumping tip, a seventh poor quality."""
    rows = progress(spark, sf_dir)
    p = F.least(F.lit(1.0), F.col("p") * F.when(F.col("run_id") % 3 == 0, 0.85).otherwise(1.15))
    rows = rows.withColumn("q", p)
    ok = F.col("event_type") != "error"
    jump = F.when((F.col("run_id") % 5 == 1) & (F.col("k") % 40 == 7), 30.0).otherwise(0.0)
    x = 55.0 + 45.0 * F.col("q")
    kappa = 0.08 - 0.07 * F.col("q")
    shown = {
        "route_a_anchor_x": 10.0 + (F.col("k") % 7) * 0.25, "route_a_anchor_y": F.lit(15.0), "route_a_tip_x": 10.0 + x + jump, "route_a_tip_y": 15.0 + (F.col("k") % 5) * 0.5,
        "x_route_a_px": x, "anchor_x": 11.0 + (F.col("k") % 3) * 0.5, "anchor_y": 15.0 + (F.col("k") % 2) * 0.5, "tip_x": 9.0 + x, "tip_y": 14.0 + (F.col("k") % 4) * 0.5,
        "x_fit_px": 50.0 + 40.0 * F.col("q") + (F.col("k") % 3) * 0.2, "kappa_fit_px_inv": kappa + (F.col("k") % 4) * 0.0005, "kappa_route_c_px_inv": kappa + F.when(F.col("run_id") % 11 == 2, 0.05).otherwise(0.0002),
        "quality": F.when(F.col("run_id") % 7 == 0, 0.02).otherwise(0.05) + (F.col("k") % 10) * F.when(F.col("run_id") % 7 == 0, 0.01).otherwise(0.1),
        "x_route_a_recovery": F.col("q"), "x_fit_recovery": F.col("q"), "kappa_fit_recovery": F.col("q"), "kappa_route_c_recovery": F.col("q"), "centerline_points": (100 + F.col("k")).cast("double"),
    }
    out = rows.select("run_id", "frame", "time_sec", "temperature_c", "k", "p", "q", *(F.when(ok, c).alias(name) for name, c in shown.items()), F.when(~ok, "failed").when(F.col("k") % 3 == 0, "circle").otherwise("quadratic").alias("model_name"))
    return out


def braided_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A braided series before its quality columns are added."""
    rows = progress(spark, sf_dir)
    q = F.least(F.lit(1.0), F.col("p") * F.when(F.col("run_id") % 4 == 0, 0.85).otherwise(1.15))
    rows = rows.withColumn("q", q)
    ok = F.col("event_type") != "error"
    length = 120.0 - 30.0 * F.col("q")
    shown = {
        "length_axis_px": length, "length_axis_disagreement_px": (F.col("k") % 10) * F.when(F.col("run_id") % 9 == 1, 3.0).otherwise(0.5), "length_env_px": length + 4.0,
        "diameter_max_px": 20.0 + 20.0 * F.col("q") + (F.col("k") % 3) * 0.1, "area_proj_px2": 500.0 + 220.0 * F.col("q"), "area_proj_definition_gap_px2": (F.col("k") % 20) * F.when(F.col("run_id") % 8 == 3, 9.0).otherwise(2.0),
        "anchor_x": 10.0 + (F.col("k") % 3) * 0.5, "anchor_y": 20.0 + (F.col("k") % 2) * 0.5, "tip_x": 10.0 + length, "tip_y": 20.0 + (F.col("k") % 5) * F.when(F.col("run_id") % 10 == 3, 4.0).otherwise(0.5),
        "endpoint_gap_alt_centerline_px": (F.col("k") % 8) * F.when(F.col("run_id") % 13 == 5, 3.0).otherwise(0.5), "diameter_peak_pos_norm": 0.5 + (F.col("k") % 6) * 0.01, "axis_peak_position_stability": (F.col("k") % 4) * 0.01,
        "quality": 0.5 + (F.col("k") % 10) * F.when(F.col("run_id") % 6 == 1, -0.05).otherwise(0.04), "body_mask_attachment_leak_fraction": (F.col("k") % 10) * F.when(F.col("run_id") % 12 == 2, 0.01).otherwise(0.002),
        "excluded_attachment_area_px2": (F.col("k") % 10) * 8.0, "component_area_px2": F.lit(1000.0), "body_mask_area_px2": 700.0 + (F.col("k") % 10) * 10.0, "branch_component_count_after_pruning": (F.col("k") % 3).cast("double"), "attachment_border_touch_count": (F.col("k") % 2).cast("double"),
        "length_axis_recovery": F.col("q"), "diameter_max_recovery": F.col("q"), "area_proj_recovery": F.col("q"), "direction_span_px": 100.0 + 12.0 * F.col("q"),
    }
    return rows.select("run_id", "frame", "time_sec", "temperature_c", "k", "q", *(F.when(ok, c).alias(name) for name, c in shown.items()))


def temperature_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signup event is an entry of the run's temperature log."""
    rows = progress(spark, sf_dir).where("event_type = 'signup'")
    return rows.select("run_id", "frame", "time_sec", (20.0 + F.col("k") * 0.5).alias("temperature_c"))


def centerlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points along a line for every event, by turns a parabola, a part of a circle and a bend with a straight end; none for an `error`."""
    e = events(spark, sf_dir)
    # Dealt before each becomes forty rows.
    e = dealt(e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("frame"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")), "run_id", "frame", rows=e.count(), width=10)
    rows = e.withColumn("place", F.explode(F.when(F.col("event_type") == "error", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(40)))))
    t = F.col("place") / 40.0
    v, s, radius = 80.0 * t, 0.6 * t, 60.0 + F.col("k") % 5 * 5.0
    bend = 0.004 * F.least(90.0 * t, F.lit(40.0)) * F.least(90.0 * t, F.lit(40.0)) + 0.32 * F.greatest(90.0 * t - 40.0, F.lit(0.0))
    shapes = [((0.002 + 0.0001 * (F.col("k") % 7)) * v * v, v), (radius * 2.0 * s * s / (1.0 + s * s), radius * 2.0 * s / (1.0 + s * s)), (bend, 90.0 * t)]
    shape = F.col("k") % 3
    u, v = (F.when(F.col("event_type") != "error", F.when(shape == 0, shapes[0][c]).when(shape == 1, shapes[1][c]).otherwise(shapes[2][c])) for c in (0, 1))
    return rows.select("run_id", "frame", "place", u.alias("u"), v.alias("v"))


#: Metrics of a wire and a braided series, whether they grow.
WIRE_METRICS = {"x_route_a": ("x_route_a_px", True), "x_fit": ("x_fit_px", True), "kappa_fit": ("kappa_fit_px_inv", False), "kappa_route_c": ("kappa_route_c_px_inv", False)}
BRAIDED_METRICS = {"length_axis": ("length_axis_formal_px", False), "diameter_max": ("diameter_max_px", True), "area_proj": ("area_proj_formal_px2", True)}


def long_metrics(series: DataFrame, metrics: dict[str, tuple[str, bool]]) -> DataFrame:
    """One row for each run, metric and frame."""
    entries = F.array(*(F.struct(F.lit(m).alias("metric_key"), F.lit(up).alias("increasing"), F.col(c).alias("value")) for m, (c, up) in metrics.items()))
    return series.select("run_id", "frame", "temperature_c", F.inline(entries))


def reference_report(series: DataFrame, metrics: dict[str, tuple[str, bool]]) -> DataFrame:
    """Reports with the extremes of the values in place of a fit: everything but t0 and width."""
    long = long_metrics(series, metrics).where("temperature_c IS NOT NULL AND value IS NOT NULL")
    w = Window.partitionBy("run_id", "metric_key").orderBy("temperature_c", "frame")
    step = F.col("value") - F.lag("value").over(w)
    ref = Window.partitionBy("run_id", "metric_key")
    long = long.withColumn("step", step).withColumn("share", (F.col("value") - F.min("value").over(ref)) / F.greatest(F.max("value").over(ref) - F.min("value").over(ref), F.lit(1e-9)))
    line = F.when(F.col("increasing"), (F.col("temperature_c") - 20.0) / 45.0).otherwise(1.0 - (F.col("temperature_c") - 20.0) / 45.0)
    wrong = F.when(F.col("increasing"), F.col("step") < 0).otherwise(F.col("step") > 0)
    got = long.groupBy("run_id", "metric_key", "increasing").agg(
        F.count(F.lit(1)).alias("points"), F.min("value").alias("x_m"), F.max("value").alias("x_a"), F.round(F.sqrt(F.avg((F.col("share") - line) * (F.col("share") - line))) * (F.max("value") - F.min("value")), 9).alias("fit_rmse"),
        F.coalesce(F.avg(F.when(F.col("step").isNotNull(), wrong.cast("double"))), F.lit(0.0)).alias("monotonic_violation_fraction"), F.round(F.max("value") - F.min("value"), 9).alias("dynamic_range"),
        F.round(F.min(F.when(F.col("share") >= 0.95, F.col("temperature_c"))), 9).alias("af95_c"), F.round(F.max("temperature_c"), 9).alias("aftan_c"),
    )
    return got.where("points >= 4")
