"""Quality aggregates of a run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermoline.functions.scalar import safe_fraction
from thermoline.operators.ordered import RUN, by_temperature, in_frames, jump, rolling_median


def median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def p90(c: Column) -> Column:
    return F.percentile(c, F.lit(0.9))


def p95(c: Column) -> Column:
    return F.percentile(c, F.lit(0.95))


def share(predicate: Column) -> Column:
    """Share of rows for which it holds; NULL counts as no."""
    return F.avg(F.when(predicate, F.lit(1.0)).otherwise(F.lit(0.0)))


def mean_absolute_error(a: Column, b: Column) -> Column:
    """Over rows that have both."""
    return F.avg(F.abs(a - b))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(F.avg((a - b) * (a - b)))


def dynamic_range(c: Column) -> Column:
    return F.max(c) - F.min(c)


def direction(df: DataFrame, value: str, default: bool = True, keys: tuple[str, ...] = (RUN,)) -> DataFrame:
    """Whether a metric grows over the run, in frame order: medians of the first and last tenth.

    Under four rows, or where the two differ by less than 2 % of the scale, the default holds.
    """
    rows = df.where(F.col(value).isNotNull())
    run = Window.partitionBy(*keys)
    rows = rows.select(*keys, F.col(value).alias("v"), F.row_number().over(run.orderBy("frame")).alias("nth"), F.count(F.lit(1)).over(run).alias("n"))
    edge = F.greatest(F.lit(2), F.ceil(F.col("n") * 0.1))
    got = rows.groupBy(*keys).agg(F.max("n").alias("n"), median(F.when(F.col("nth") <= edge, F.col("v"))).alias("head"), median(F.when(F.col("nth") > F.col("n") - edge, F.col("v"))).alias("tail"), dynamic_range(F.col("v")).alias("range"))
    scale = F.greatest("range", F.abs("head"), F.abs("tail"), F.lit(1e-9))
    told = (F.col("n") >= 4) & (F.abs(F.col("tail") - F.col("head")) >= 0.02 * scale)
    return got.select(*keys, F.when(told, F.col("tail") > F.col("head")).otherwise(F.lit(default)).alias("increasing"))


def raw_violation(df: DataFrame, value: str, increasing: bool) -> DataFrame:
    """Share of steps, in order of temperature, that go the wrong way; 0 for a single row."""
    step = F.col("v") - F.lag("v").over(by_temperature())
    rows = df.where(F.col(value).isNotNull() & F.col("temperature_c").isNotNull()).withColumn("v", F.col(value)).withColumn("step", step)
    wrong = F.col("step") < 0 if increasing else F.col("step") > 0
    return rows.groupBy(RUN).agg(F.coalesce(F.avg(F.when(F.col("step").isNotNull(), wrong.cast("double"))), F.lit(0.0)).alias("violation"))


@dataclass(frozen=True)
class Trend:
    """A rolling median's window and the tolerance of its steps: `floor`, or a part of the smoothed range."""

    window: int
    floor: float
    part: float
    least_range: float = 0.0

    def violation(self, up: Column) -> Column:
        """Share of a group's `step`s that go against `up` by more than the tolerance; NULL for under four rows."""
        tolerance = F.greatest(F.lit(self.floor), self.part * F.greatest(F.col("range"), F.lit(self.least_range)))
        wrong = F.when(up, F.col("step") < -tolerance).otherwise(F.col("step") > tolerance)
        return F.when(F.count(F.lit(1)) >= 4, F.avg(F.when(F.col("step").isNotNull(), wrong.cast("double"))))

    def both_violations(self) -> list[Column]:
        """`violation_up` and `violation_down` of a group. Which of them holds is told by its report, which meets one row a group so, and not all rows of a series."""
        return [self.violation(F.lit(up)).alias(name) for up, name in ((True, "violation_up"), (False, "violation_down"))]


def violation(up: Column) -> Column:
    """That of the two which a metric growing or not is judged by."""
    return F.when(up, F.col("violation_up")).otherwise(F.col("violation_down"))


# Trends of the two kinds of objects.
WIRE_TREND, BRAIDED_TREND = Trend(7, 1e-4, 0.01, 1e-6), Trend(9, 0.5, 0.005)


def trend_steps(rows: DataFrame, trend: Trend, keys: tuple[str, ...] = (RUN,)) -> DataFrame:
    """Rows (keys, frame, temperature_c, v) with the `step` and `range` of their rolling median."""
    part = Window.partitionBy(*keys)
    w = part.orderBy("temperature_c", "frame")
    rows = rows.where("v IS NOT NULL AND temperature_c IS NOT NULL").withColumn("n", F.count(F.lit(1)).over(part))
    rows = rows.withColumn("smooth", rolling_median("v", w, trend.window, F.col("n")))
    return rows.withColumn("step", F.col("smooth") - F.lag("smooth").over(w)).withColumn("range", F.max("smooth").over(part) - F.min("smooth").over(part))


def trend_violation(df: DataFrame, value: str, increasing: Column, trend: Trend) -> DataFrame:
    """As raw_violation after a rolling median, with a tolerance; NULL for under four rows."""
    rows = df.select(RUN, "frame", "temperature_c", F.col(value).alias("v"), increasing.alias("up"))
    return trend_steps(rows, trend).groupBy(RUN).agg(trend.violation(F.col("up")).alias("violation"))


def trend_violations(long: DataFrame, trend: Trend, keys: tuple[str, ...] = (RUN, "metric_key")) -> DataFrame:
    """As trend_violation for rows (keys, frame, temperature_c, v) of many metrics, in one aggregate and both ways; with the number of rows."""
    return trend_steps(long, trend, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *trend.both_violations())


def wire_violation(df: DataFrame, value: str, increasing: Column) -> DataFrame:
    return trend_violation(df, value, increasing, WIRE_TREND)


def braided_violation(df: DataFrame, value: str, increasing: Column) -> DataFrame:
    return trend_violation(df, value, increasing, BRAIDED_TREND)


def tail_median(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Median of the last tenth of the rows, five at least."""
    w, run = Window.partitionBy(RUN).orderBy(*(F.col(c).desc() for c in order)), Window.partitionBy(RUN)
    rows = df.where(F.col(value).isNotNull()).select(RUN, F.col(value).alias("v"), F.row_number().over(w).alias("back"), F.count(F.lit(1)).over(run).alias("n"))
    return rows.where(F.col("back") <= F.greatest(F.lit(5), F.ceil(F.col("n") * 0.1))).groupBy(RUN).agg(median(F.col("v")).alias("tail_median"))


def endpoint_jumps(df: DataFrame, x: str, y: str) -> DataFrame:
    """Largest and 95th percentile jump between neighbouring valid rows; NULL for under two."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("jump", jump(x, y, in_frames()))
    return rows.groupBy(RUN).agg(F.max("jump").alias("jump_max"), p95(F.col("jump")).alias("jump_p95"))


def braided_columns(series: DataFrame) -> DataFrame:
    """The series with its quality columns: formal values, jumps between frames, and fractions of the length."""
    w = in_frames()
    have, number = set(series.columns), F.lit(None).cast("double")
    # A name of the past stands in for a column that is not there.
    for name, old in (("branch_component_count_after_pruning", "branch_count_after_pruning"), ("branch_count_after_pruning", "branch_component_count_after_pruning"), ("endpoint_gap_alt_centerline_px", "endpoint_jump_px"), ("length_axis_disagreement_px", None)):
        if name not in have and (old is None or old in have):
            series = series.withColumn(name, F.col(old) if old else number)
    rows = series.withColumns({"length_axis_formal_px": F.col("length_axis_px"), "area_proj_formal_px2": F.col("area_proj_px2"), "centerline_disagreement": F.col("length_axis_disagreement_px") / F.greatest(F.col("length_axis_px"), F.lit(1e-9))})
    rows = rows.withColumns({"anchor_jump_px": jump("anchor_x", "anchor_y", w), "tip_jump_px": jump("tip_x", "tip_y", w), "peak_step": F.abs(F.col("diameter_peak_pos_norm") - F.lag("diameter_peak_pos_norm").over(w))})
    rows = rows.withColumn("endpoint_frame_jump_px", F.greatest("anchor_jump_px", "tip_jump_px"))
    return rows.withColumns(
        {
            "endpoint_gap_alt_centerline_fraction": safe_fraction(F.col("endpoint_gap_alt_centerline_px"), F.col("length_axis_formal_px")),
            "endpoint_jump_px": F.col("endpoint_gap_alt_centerline_px"),
            "endpoint_jump_fraction": safe_fraction(F.col("endpoint_gap_alt_centerline_px"), F.col("length_axis_formal_px")),
            "endpoint_frame_jump_fraction": safe_fraction(F.col("endpoint_frame_jump_px"), F.col("length_axis_formal_px")),
            "axis_peak_position_stability": F.greatest("axis_peak_position_stability", "peak_step"),
        }
    ).drop("peak_step")


#: What a braided run must meet; a synthetic one may jump further between frames.
ACCEPTANCE = {
    "real_video": {"frames": 10, "quality": 0.45, "low_quality": 0.20, "violation": 0.20, "disagreement": 0.08, "gap_fraction": 0.08, "gap_px": 12.0, "frame_fraction": 0.08, "frame_px": 12.0, "stability": 0.18, "leak": 0.03, "excluded": 0.12, "body": 0.55, "area_gap": 0.18},
}
ACCEPTANCE["synthetic"] = ACCEPTANCE["real_video"] | {"frame_fraction": 0.12, "frame_px": 20.0}


#: Columns that an acceptance looks at.
ACCEPTANCE_COLUMNS = ("quality", "length_axis_formal_px", "centerline_disagreement", "endpoint_gap_alt_centerline_px", "endpoint_gap_alt_centerline_fraction", "endpoint_frame_jump_px", "endpoint_frame_jump_fraction", "branch_component_count_after_pruning", "axis_peak_position_stability", "body_mask_attachment_leak_fraction", "excluded_attachment_area_px2", "component_area_px2", "body_mask_area_px2", "attachment_border_touch_count")


def acceptance_measures() -> dict[str, tuple[Callable[[Column], Column], Column]]:
    """Aggregates of an acceptance by name: how, and of what."""
    c = F.col
    return {
        "quality_median": (median, c("quality")),
        "centerline_disagreement_median": (median, c("centerline_disagreement")),
        "endpoint_gap_alt_centerline_p95_px": (p95, c("endpoint_gap_alt_centerline_px")),
        "endpoint_gap_alt_centerline_fraction_p95": (p95, c("endpoint_gap_alt_centerline_fraction")),
        "endpoint_frame_jump_p95_px": (p95, c("endpoint_frame_jump_px")),
        "endpoint_frame_jump_fraction_p95": (p95, c("endpoint_frame_jump_fraction")),
        "axis_median": (median, c("length_axis_formal_px")),
        "branch_component_count_after_pruning_p95": (p95, c("branch_component_count_after_pruning")),
        "axis_peak_position_stability_p95": (p95, c("axis_peak_position_stability")),
        "body_mask_attachment_leak_fraction_p90": (p90, c("body_mask_attachment_leak_fraction")),
        "excluded_attachment_area_fraction_median": (median, safe_fraction(c("excluded_attachment_area_px2"), c("component_area_px2"))),
        "body_mask_area_fraction_median": (median, safe_fraction(c("body_mask_area_px2"), c("component_area_px2"))),
        "attachment_border_touch_count_p90": (p90, c("attachment_border_touch_count")),
    }


def with_acceptance_limits(rows: DataFrame, limit: dict[str, float]) -> DataFrame:
    """Limits in pixels, which follow the length."""
    axis = F.col("axis_median")
    both = {f"endpoint_{name}_limit_px": F.when(axis.isNotNull(), F.greatest(F.lit(limit[f"{key}_px"]), limit[f"{key}_fraction"] * axis)) for name, key in (("gap_alt_centerline", "gap"), ("frame_jump", "frame"))}
    return rows.withColumns(both)


def acceptance(series: DataFrame, profile: str = "real_video") -> DataFrame:
    """One row a run: the acceptance metrics, all reasons against it in order, and the verdict. One pass of aggregation besides the trend."""
    limit = ACCEPTANCE[profile]
    valid = series.where("length_axis_formal_px IS NOT NULL AND quality IS NOT NULL")
    c = F.col
    got = valid.groupBy(RUN).agg(F.count(F.lit(1)).alias("valid_frames"), share(c("quality") < 0.5).alias("quality_lt_0_5_fraction"), *(f(x).alias(name) for name, (f, x) in acceptance_measures().items()))
    trend = braided_violation(valid, "length_axis_formal_px", F.lit(False)).withColumnRenamed("violation", "axis_monotonic_violation_fraction")
    got = series.select(RUN).distinct().join(got, RUN, "left").join(trend, RUN, "left").withColumn("valid_frames", F.coalesce("valid_frames", F.lit(0)))
    got = with_acceptance_limits(got, limit)
    reasons = [
        (c("valid_frames") < limit["frames"], "insufficient_axis_points"),
        (c("quality_median") < limit["quality"], "unstable_axis_extraction"),
        (c("quality_lt_0_5_fraction") > limit["low_quality"], "quality_low_fraction"),
        (c("axis_monotonic_violation_fraction") > limit["violation"], "length_axis_not_monotonic_enough"),
        (c("centerline_disagreement_median") > limit["disagreement"], "centerline_disagreement"),
        (gap_fails(limit), "endpoint_jump"),
        (frame_jump_fails(limit), "endpoint_frame_jump"),
        (c("axis_peak_position_stability_p95") > limit["stability"], "axis_peak_position_stability"),
        (c("body_mask_attachment_leak_fraction_p90") > limit["leak"], "body_mask_attachment_leak_fraction"),
        (c("excluded_attachment_area_fraction_median") > limit["excluded"], "excluded_attachment_area_fraction"),
        (c("body_mask_area_fraction_median") < limit["body"], "body_mask_area_fraction"),
    ]
    # The gap's metrics by their former names too.
    former = {f"endpoint_jump_{part}": f"endpoint_gap_alt_centerline_{part}" for part in ("p95_px", "fraction_p95", "limit_px")}
    got = got.withColumns({"axis_eval_col": F.lit("length_axis_formal_px"), **{name: c(now) for name, now in former.items()}})
    got = got.withColumn("reasons", F.array_distinct(F.array_compact(F.array(*(F.when(p, F.lit(r)) for p, r in reasons)))))
    return got.withColumn("accepted", F.size("reasons") == 0).drop("axis_median")


def gap_fails(limit: dict[str, float]) -> Column:
    over = F.col("endpoint_gap_alt_centerline_fraction_p95") > limit["gap_fraction"]
    return F.coalesce(over, F.lit(False)) | F.coalesce(F.col("endpoint_gap_alt_centerline_p95_px") > F.col("endpoint_gap_alt_centerline_limit_px"), F.lit(False))


def frame_jump_fails(limit: dict[str, float]) -> Column:
    over = F.col("endpoint_frame_jump_fraction_p95") > limit["frame_fraction"]
    return F.coalesce(over, F.lit(False)) | F.coalesce(F.col("endpoint_frame_jump_p95_px") > F.col("endpoint_frame_jump_limit_px"), F.lit(False))


def run_summary(series: DataFrame) -> DataFrame:
    """Temperatures and medians of a run's series, in one aggregation."""
    medians = [x for x in ("quality", "x_route_a_px", "x_fit_px", "kappa_fit_px_inv", "length_axis_formal_px", "diameter_max_px", "area_proj_formal_px2") if x in series.columns]
    return series.groupBy(RUN).agg(F.count(F.lit(1)).alias("frames"), F.min("temperature_c").alias("temperature_min_c"), F.max("temperature_c").alias("temperature_max_c"), *(median(F.col(x)).alias(f"{x}_median") for x in medians))


# Columns of a braided series and the names of their medians and 95th percentiles.
BRAIDED_MEDIANS = {
    "length_axis_px": "length_axis_median_px",
    "length_axis_body_bins_px": "length_axis_body_bins_median_px",
    "diameter_max_px": "diameter_max_median_px",
    "diameter_p95_px": "diameter_p95_median_px",
    "diameter_mid_median_px": "diameter_mid_median_px",
    "diameter_mid_p90_px": "diameter_mid_p90_median_px",
    "area_proj_px2": "area_proj_median_px2",
    "body_mask_area_px2": "body_mask_area_median_px2",
    "length_axis_disagreement_px": "length_axis_definition_gap_median_px",
    "body_mask_attachment_leak_fraction": "body_mask_attachment_leak_fraction_median",
}
BRAIDED_P95S = {"endpoint_jump_px": "endpoint_jump_p95_px", "endpoint_frame_jump_px": "endpoint_frame_jump_p95_px", "axis_peak_position_stability": "axis_peak_position_stability_p95"}


def braided_summary(series: DataFrame) -> DataFrame:
    """Temperatures, medians and 95th percentiles of a braided run's series, of the columns that it has, in one aggregation."""
    have = [(median, BRAIDED_MEDIANS), (p95, BRAIDED_P95S)]
    stats = [f(F.col(c)).alias(name) for f, names in have for c, name in names.items() if c in series.columns]
    return series.groupBy(RUN).agg(F.min("temperature_c").alias("temperature_c_min"), F.max("temperature_c").alias("temperature_c_max"), *stats)


def wire_summary(series: DataFrame) -> DataFrame:
    """Quality, endpoint jumps and model choice of a wire run."""
    anchor = endpoint_jumps(series, "anchor_x", "anchor_y").select(RUN, F.col("jump_p95").alias("anchor"))
    tip = endpoint_jumps(series, "tip_x", "tip_y").select(RUN, F.col("jump_p95").alias("tip"))
    got = series.groupBy(RUN).agg(median(F.col("quality")).alias("quality_median"), share(F.col("quality") < 0.1).alias("quality_lt_0_1_fraction"), median(F.col("centerline_points")).alias("centerline_points_median"), share(F.col("model_name") == "quadratic").alias("quadratic_fraction"))
    return got.join(anchor, RUN, "left").join(tip, RUN, "left").withColumn("endpoint_jump_p95_px", F.greatest("anchor", "tip")).drop("anchor", "tip")
