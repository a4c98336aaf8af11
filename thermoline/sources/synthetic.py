"""Synthetic schedules and recovery models, as expressions over generated rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thermoline.functions.scalar import sigmoid


def schedule(spark: SparkSession, fps: float, seconds: float, start_c: float, end_c: float, run_id: int = 0) -> DataFrame:
    """Frames at an even pace with an even rise of temperature."""
    n = round(fps * seconds)
    rows = spark.range(n).withColumnRenamed("id", "frame")
    return rows.select(F.lit(run_id).cast("long").alias("run_id"), "frame", (F.col("frame") / float(fps)).alias("time_sec"), (F.lit(float(start_c)) + F.col("frame") * ((end_c - start_c) / max(n - 1, 1))).alias("temperature_c"))


@dataclass(frozen=True)
class WireModel:
    """One bend of constant curvature along an inextensible needle. The published demonstration."""

    length_px: float = 400.0
    anchor_x: float = 585.0
    anchor_y: float = 32.0
    anchor_angle_deg: float = 90.0
    kappa_m: float = 0.0045
    kappa_a: float = 0.00005
    centre_c: float = 47.0
    width_c: float = 2.0
    samples: int = 160


def wire_truth(rows: DataFrame, m: WireModel = WireModel()) -> DataFrame:
    """Curvature and chord of each row; the tip is the sum of unit steps along the needle."""
    step = m.length_px / (m.samples - 1)
    kappa = sigmoid(F.col("temperature_c"), F.lit(m.kappa_m), F.lit(m.kappa_a), F.lit(m.centre_c), F.lit(m.width_c))
    rows = rows.withColumn("kappa_true_px_inv", kappa)

    def total(trig) -> F.Column:  # noqa: ANN001
        at = F.sequence(F.lit(0), F.lit(m.samples - 1))
        return F.aggregate(at, F.lit(0.0), lambda s, i: s + trig(F.lit(math.radians(m.anchor_angle_deg)) + F.col("kappa_true_px_inv") * step * i) * step)

    rows = rows.withColumns({"tip_x": F.lit(m.anchor_x) + total(F.cos), "tip_y": F.lit(m.anchor_y) + total(F.sin), "anchor_x": F.lit(m.anchor_x), "anchor_y": F.lit(m.anchor_y)})
    return rows.withColumn("x_true_px", F.sqrt(F.pow(F.col("tip_x") - m.anchor_x, 2) + F.pow(F.col("tip_y") - m.anchor_y, 2)))


def with_true_recovery(truth: DataFrame) -> DataFrame:
    """Recovery between the first and the last frame."""
    w = Window.partitionBy("run_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x0, x1, k0, k1 = (f(c).over(w) for c in ("x_true_px", "kappa_true_px_inv") for f in (F.first, F.last))
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return truth.withColumns({"x_recovery_true": inside((F.col("x_true_px") - x0) / (x1 - x0)), "kappa_recovery_true": inside((k0 - F.col("kappa_true_px_inv")) / F.greatest(k0 - k1, F.lit(1e-9)))})


@dataclass(frozen=True)
class BraidedModel:
    """A braid that shortens and widens. The published demonstration, at low and high temperature."""

    length_m_px: float = 520.0
    length_a_px: float = 410.0
    diameter_m_px: float = 120.0
    diameter_a_px: float = 220.0
    bow_m_px: float = 14.0
    bow_a_px: float = 8.0
    angle_m_deg: float = -1.5
    angle_a_deg: float = 2.0
    center_x: float = 640.0
    center_y: float = 260.0
    shift_x: float = 10.0
    shift_y: float = -6.0
    peak: float = 0.56
    left_power: float = 0.88
    right_power: float = 1.06
    centre_c: float = 47.0
    width_c: float = 2.0
    samples: int = 240


def braided_truth(rows: DataFrame, m: BraidedModel = BraidedModel()) -> DataFrame:
    """Nominal sizes and pose of each row."""
    share = sigmoid(F.col("temperature_c"), F.lit(0.0), F.lit(1.0), F.lit(m.centre_c), F.lit(m.width_c))
    mixed = lambda a, b: F.lit(a) + F.col("share") * (b - a)
    rows = rows.withColumn("share", share)
    return rows.withColumns({"length_true_px": mixed(m.length_m_px, m.length_a_px), "diameter_true_px": mixed(m.diameter_m_px, m.diameter_a_px), "bow_true_px": mixed(m.bow_m_px, m.bow_a_px), "axis_theta_true_rad": F.radians(mixed(m.angle_m_deg, m.angle_a_deg)), "center_x_true": F.lit(m.center_x) + F.col("share") * m.shift_x, "center_y_true": F.lit(m.center_y) + F.col("share") * m.shift_y})


def braided_profile(truth: DataFrame, m: BraidedModel = BraidedModel()) -> DataFrame:
    """Points of each row's centreline with their widths: one row a sample."""
    peak = min(0.8, max(0.2, m.peak))
    points = truth.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(m.samples - 1)))).withColumn("u", F.col("sample") / (m.samples - 1))
    left = F.pow(F.sin(math.pi / 2 * F.least(F.lit(1.0), F.col("u") / peak)), m.left_power)
    right = F.pow(F.sin(math.pi / 2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1.0 - F.col("u")) / (1.0 - peak)))), m.right_power)
    x, y = (F.col("u") - 0.5) * F.col("length_true_px"), F.col("bow_true_px") * F.sin(math.pi * F.col("u"))
    c, s = F.cos("axis_theta_true_rad"), F.sin("axis_theta_true_rad")
    return points.withColumns({"width_px": F.col("diameter_true_px") * F.when(F.col("u") <= peak, left).otherwise(right), "x": F.col("center_x_true") + x * c - y * s, "y": F.col("center_y_true") + x * s + y * c})
