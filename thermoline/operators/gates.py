"""Quality gates of routes: the first check that fails gives the reason, NULL means passed.

All metrics of a kind are rows of one aggregate by run and metric, and a gate is a CASE over its row. `report` has one row for each
run and metric: increasing, fit_rmse, monotonic_violation_fraction, dynamic_range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermoline.functions.scalar import safe_fraction
from thermoline.operators import qc
from thermoline.operators.ordered import RUN, jump, rolling_median

#: Value and recovery column of each metric.
COLUMNS = {
    "x_route_a": ("x_route_a_px", "x_route_a_recovery"),
    "x_fit": ("x_fit_px", "x_fit_recovery"),
    "x_route_c": ("x_route_c_px", "x_route_c_recovery"),
    "kappa_fit": ("kappa_fit_px_inv", "kappa_fit_recovery"),
    "kappa_route_c": ("kappa_route_c_px_inv", "kappa_route_c_recovery"),
    "length_axis": ("length_axis_formal_px", "length_axis_recovery"),
    "diameter_max": ("diameter_max_px", "diameter_max_recovery"),
    "area_proj": ("area_proj_formal_px2", "area_proj_recovery"),
}
ENDPOINTS = ("route_a_anchor_x", "route_a_anchor_y", "route_a_tip_x", "route_a_tip_y")
LEAST_POINTS = 15
PLATEAU = "missing_high_temp_plateau"


def _first(*checks: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for failed, reason in reversed(checks):
        out = F.when(failed, F.lit(reason)).otherwise(out)
    return out


KEY = [RUN, "metric_key"]
# Limits of the wire's gates.
LEAST_QUALITY, LEAST_RANGE, MOST_VIOLATION, LEAST_TAIL = 0.10, 5.0, 0.25, 0.90
ROUTE_C = {"range": 0.005, "violation": 0.20, "deviation": 0.35, "tail": 0.92}
JUMP_PX, JUMP_PART = 8.0, 0.10
#: What a row must have besides temperature, value and recovery to count for a metric.
NEEDS = {"x_route_a": ENDPOINTS, "kappa_route_c": ("kappa_fit_px_inv", "kappa_fit_recovery")}
#: Metrics whose last tenth of rows is told by temperature, not by frame.
BY_TEMPERATURE = ("x_route_a", "kappa_route_c")


def _long(series: DataFrame, metrics: list[str], needs: dict[str, tuple[str, ...]], columns: list[str], extra: dict[str, Column]) -> DataFrame:
    """Valid rows of every metric in one read of the series: (run, metric_key, frame, temperature_c, value, recovery, by_temperature) and `columns`."""

    def entry(metric: str) -> Column:
        value, recovery = COLUMNS[metric]
        valid = reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in (value, recovery, *needs.get(metric, ("quality",)))))
        return F.struct(F.lit(metric).alias("metric_key"), F.col(value).cast("double").alias("value"), F.col(recovery).alias("recovery"), F.lit(metric in BY_TEMPERATURE).alias("by_temperature"), extra.get(metric, F.lit(None).cast("double")).alias("extra"), valid.alias("valid"))

    rows = series.where("temperature_c IS NOT NULL").select(RUN, "frame", "temperature_c", *columns, F.inline(F.array(*map(entry, metrics))))
    return rows.where("valid").drop("valid")


def _measured(rows: DataFrame, trend: qc.Trend, stats: dict[str, Column]) -> DataFrame:
    """One row for each run and metric: points, violations both ways, tail_median and `stats`. All windows are over the rows of a run and metric, in two orders.

    Nothing is joined to the rows, so they stay in the tasks that their runs were dealt to.
    """
    part = Window.partitionBy(*KEY)
    warm, frames = part.orderBy("temperature_c", "frame"), part.orderBy("frame")
    n = F.count(F.lit(1)).over(part)
    rows = rows.withColumn("n", n)
    rows = rows.withColumns({"smooth": rolling_median("value", warm, trend.window, F.col("n")), "back": F.col("n") + 1 - F.when(F.col("by_temperature"), F.row_number().over(warm)).otherwise(F.row_number().over(frames))})
    rows = rows.withColumns({"step": F.col("smooth") - F.lag("smooth").over(warm), "range": F.max("smooth").over(part) - F.min("smooth").over(part)})
    last = F.col("back") <= F.greatest(F.lit(5), F.ceil(F.col("n") * 0.1))
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("points"), *trend.both_violations(), qc.median(F.when(last, F.col("recovery"))).alias("tail_median"), *(x.alias(c) for c, x in stats.items()))


def _judged(series: DataFrame, report: DataFrame, metrics: list[str], measured: DataFrame) -> DataFrame:
    """One row for each run of the series and metric, with its report and what was measured."""
    own = report.where(F.col("metric_key").isin(metrics)).select(*KEY, "increasing", "monotonic_violation_fraction", "dynamic_range", F.lit(True).alias("reported"))
    every = series.select(RUN).distinct().withColumn("metric_key", F.explode(F.array(*map(F.lit, metrics))))
    return every.join(own, KEY, "left").join(measured, KEY, "left")


def _few() -> Column:
    return F.col("reported").isNull() | (F.coalesce("points", F.lit(0)) < LEAST_POINTS)


def _reasons(checks: dict[str, list[tuple[Column, str]]]) -> Column:
    """The first failed check of a row's own metric."""
    return F.coalesce(*(F.when(F.col("metric_key") == metric, _first(*own)) for metric, own in checks.items()))


def route_c_deviation(series: DataFrame, report: DataFrame) -> DataFrame:
    """Median distance of routes C and B as a share of B's range."""
    b = report.where("metric_key = 'kappa_fit'").select(RUN, F.greatest("dynamic_range", F.lit(1e-6)).alias("b_range"))
    gap = series.groupBy(RUN).agg(qc.median(F.abs(F.col("kappa_route_c_px_inv") - F.col("kappa_fit_px_inv"))).alias("gap"))
    return gap.join(b, RUN).select(RUN, (F.col("gap") / F.col("b_range")).alias("deviation"))


def wire_gates(series: DataFrame, report: DataFrame, metrics: list[str]) -> DataFrame:
    """Gate reasons of wire metrics: route B by quality and trend, route A by jumps of its end points, route C by trend and distance to B, others by quality."""
    have = set(series.columns)
    columns = [c for c in ("quality", *ENDPOINTS) if c in have]
    extra = {"kappa_route_c": F.abs(F.col("kappa_route_c_px_inv") - F.col("kappa_fit_px_inv"))} if "kappa_route_c" in metrics else {}
    rows = _long(series, metrics, NEEDS, columns, extra)
    stats = {"quality_median": qc.median(F.col("quality") if "quality" in have else F.lit(None).cast("double")), "length": qc.median(F.col("value")), "gap": qc.median(F.col("extra"))}
    if "x_route_a" in metrics:
        frames = Window.partitionBy(*KEY).orderBy("frame")
        rows = rows.withColumns({"anchor_step": jump(*ENDPOINTS[:2], frames), "tip_step": jump(*ENDPOINTS[2:], frames)})
        stats |= {"jump": F.greatest(F.max("anchor_step"), F.max("tip_step"))}
    b = report.where("metric_key = 'kappa_fit'").select(RUN, F.greatest("dynamic_range", F.lit(1e-6)).alias("b_range"))
    rows = _judged(series, report, metrics, _measured(rows, qc.WIRE_TREND, stats)).join(b, RUN, "left").withColumn("violation", F.col("violation_down"))
    c, tail = F.col, (F.col("tail_median") < LEAST_TAIL, PLATEAU)

    def plain(metric: str) -> list[tuple[Column, str]]:
        return [(_few(), f"{metric}_insufficient_points"), (c("quality_median") < LEAST_QUALITY, f"{metric}_unstable_extraction"), (c("dynamic_range") < LEAST_RANGE, f"{metric}_dynamic_range_too_small"), (c("monotonic_violation_fraction") > MOST_VIOLATION, f"{metric}_not_monotonic_enough"), tail]

    def own(metric: str) -> list[tuple[Column, str]]:
        if metric == "kappa_fit":
            return [(_few(), "insufficient_kappa_points"), (c("quality_median") < LEAST_QUALITY, "unstable_kappa_extraction"), (F.coalesce("violation", "monotonic_violation_fraction") > MOST_VIOLATION, "kappa_fit_not_monotonic_enough"), tail]
        if metric == "x_route_a":
            few, _, small, shaky, _ = plain(metric)
            return [few, small, (c("jump") > F.greatest(F.lit(JUMP_PX), JUMP_PART * c("length")), "x_route_a_endpoint_instability"), shaky, tail]
        if metric == "kappa_route_c":
            return [(_few(), "kappa_route_c_insufficient_points"), (c("dynamic_range") < ROUTE_C["range"], "kappa_route_c_dynamic_range_too_small"), (c("violation") > ROUTE_C["violation"], "kappa_route_c_not_monotonic_after_smoothing"), (c("gap") / c("b_range") > ROUTE_C["deviation"], "kappa_route_c_route_b_deviation_too_large"), (c("tail_median") < ROUTE_C["tail"], PLATEAU)]
        return plain(metric)

    return rows.select(*KEY, _reasons({m: own(m) for m in metrics}).alias("gate_reason"))


def wire_gate(series: DataFrame, report: DataFrame, metric: str) -> DataFrame:
    return wire_gates(series, report, [metric]).select(RUN, "gate_reason")


#: Names of the length's reasons.
_AXIS_REASONS = {"insufficient_points": "insufficient_axis_points", "unstable_extraction": "unstable_axis_extraction", "dynamic_range_too_small": "axis_dynamic_range_too_small", "not_monotonic_enough": "length_axis_not_monotonic_enough"}


def braided_reason(metric: str, suffix: str) -> str:
    return _AXIS_REASONS.get(suffix, suffix) if metric == "length_axis" else f"{metric}_{suffix}"


def braided_gates(series: DataFrame, report: DataFrame, metrics: list[str], profile: str = "real_video") -> DataFrame:
    """Formal gate reasons of braided metrics. What an acceptance measures is measured over each metric's own valid rows, in the same aggregate."""
    limit = qc.ACCEPTANCE[profile]
    measures = qc.acceptance_measures()
    area = "area_proj" in metrics and "area_proj_definition_gap_px2" in series.columns
    extra = {"area_proj": safe_fraction(F.abs("area_proj_definition_gap_px2"), F.abs(COLUMNS["area_proj"][0]))} if area else {}
    columns = ["quality", *(c for c in qc.ACCEPTANCE_COLUMNS if c != "quality")]
    rows = _long(series, metrics, {}, columns, extra)
    stats = {c: f(F.when(F.col("length_axis_formal_px").isNotNull(), x)) for c, (f, x) in measures.items() if c != "quality_median"}
    stats |= {"quality_median": qc.median(F.col("quality")), "area_gap": qc.p95(F.col("extra"))}
    # Without a report too few points is the reason, whatever was measured.
    got = qc.with_acceptance_limits(_judged(series, report, metrics, _measured(rows, qc.BRAIDED_TREND, stats)), limit).withColumn("violation", qc.violation(F.col("increasing")))
    frame_jump = qc.frame_jump_fails(limit) if profile == "real_video" else F.lit(False)
    c = F.col

    def own(metric: str) -> list[tuple[Column, str]]:
        return [
            (_few(), braided_reason(metric, "insufficient_points")),
            (c("quality_median") < LEAST_QUALITY, braided_reason(metric, "unstable_extraction")),
            (c("dynamic_range") < LEAST_RANGE, braided_reason(metric, "dynamic_range_too_small")),
            (c("violation") > limit["violation"], braided_reason(metric, "not_monotonic_enough")),
            (c("centerline_disagreement_median") > limit["disagreement"], "centerline_disagreement"),
            (qc.gap_fails(limit), "endpoint_jump"),
            (frame_jump, "endpoint_frame_jump"),
            (c("axis_peak_position_stability_p95") > limit["stability"], "axis_peak_position_stability"),
            (c("body_mask_attachment_leak_fraction_p90") > limit["leak"], "body_mask_attachment_leak_fraction"),
            (c("excluded_attachment_area_fraction_median") > limit["excluded"], "excluded_attachment_area_fraction"),
            (c("body_mask_area_fraction_median") < limit["body"], "body_mask_area_fraction"),
            (c("area_gap") > limit["area_gap"], "area_proj_definition_gap_instability"),
            (c("tail_median") < LEAST_TAIL, PLATEAU),
        ]

    return got.select(*KEY, _reasons({m: own(m) for m in metrics}).alias("gate_reason"))


def braided_gate(series: DataFrame, report: DataFrame, metric: str, profile: str = "real_video") -> DataFrame:
    return braided_gates(series, report, [metric], profile).select(RUN, "gate_reason")


def route_status(gate_reason: Column, has_temperature: Column, has_report: Column, candidate: Column, missing_reason: Column) -> tuple[Column, Column]:
    """Status of a route and the reason that goes with it."""
    status = F.when(~has_temperature, "quicklook_only").when(~has_report | gate_reason.isNotNull(), "formal_blocked").when(candidate, "formal_passed").otherwise("provisional")
    reason = F.when(~has_temperature, F.lit("temperature_sync_missing")).when(~has_report, missing_reason).otherwise(gate_reason)
    return status, reason
