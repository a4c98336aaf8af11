"""Whole analyses: from a measured series and a temperature log to route results and the object's result."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoline.functions.scalar import recovery_from_fit
from thermoline.operators import align, fit, qc, routes, suite, temporal, vision
from thermoline.operators.dealing import dealt
from thermoline.operators.ordered import RUN
from thermoline.sources import synthetic
from thermoline.sources.staging import stored

# Metrics with value and recovery column, and whether they grow; None is inferred from the run.
WIRE = {
    "x_route_a": ("x_route_a_px", "x_route_a_recovery", True),
    "x_fit": ("x_fit_px", "x_fit_recovery", True),
    "x_route_c": ("x_route_c_px", "x_route_c_recovery", True),
    "kappa_fit": ("kappa_fit_px_inv", "kappa_fit_recovery", False),
    "kappa_route_c": ("kappa_route_c_px_inv", "kappa_route_c_recovery", False),
    "direction_centerline_span": ("direction_centerline_span_px", "direction_centerline_recovery", None),
    "direction_mask_span": ("direction_mask_span_px", "direction_mask_recovery", None),
}
BRAIDED = {
    "length_env": ("length_env_px", "length_env_recovery", False),
    "length_axis": ("length_axis_formal_px", "length_axis_recovery", False),
    "diameter_max": ("diameter_max_px", "diameter_max_recovery", True),
    "area_proj": ("area_proj_formal_px2", "area_proj_recovery", None),
    "direction_span": ("direction_span_px", "direction_recovery", None),
}


@dataclass
class Analysis:
    series: DataFrame
    reports: DataFrame
    gates: DataFrame
    chosen: DataFrame
    route_results: DataFrame
    object_result: DataFrame


def with_temperature(series: DataFrame, log: DataFrame | None, by: str = "frame", offset_sec: float = 0.0) -> DataFrame:
    """`by` is frame or time; without a log the temperature is NULL."""
    plain = series.drop("temperature_c")
    if log is None:
        return plain.withColumn("temperature_c", F.lit(None).cast("double"))
    return align.by_time(plain, log, offset_sec) if by == "time" else align.by_frame(plain, log)


def evaluated(series: DataFrame, metrics: dict) -> tuple[DataFrame, DataFrame]:
    """The series with recovery columns, and the reports of the metrics that it has columns for."""
    have = {m: v for m, v in metrics.items() if v[0] in series.columns}

    def long(rows: DataFrame, ups: dict[str, Column]) -> DataFrame:
        """One row for each run, frame and metric of `ups` that has a value."""
        entries = F.array(*(F.struct(F.lit(m).alias("metric_key"), up.cast("boolean").alias("increasing"), F.col(have[m][0]).cast("double").alias("value")) for m, up in ups.items()))
        return rows.select(RUN, "frame", "temperature_c", F.inline(entries)).where("temperature_c IS NOT NULL AND value IS NOT NULL")

    rows, ups = series, {m: F.lit(up) for m, (_, _, up) in have.items()}
    unknown = [m for m, (_, _, up) in have.items() if up is None]
    if unknown:
        told = qc.direction(long(series, {m: ups[m] for m in unknown}), "value", keys=(RUN, "metric_key"))
        # One row a run, joined before each row becomes many: both sides lie as the series was dealt.
        told = told.groupBy(RUN).agg(*(F.max(F.when(F.col("metric_key") == m, F.col("increasing"))).alias(f"told_{m}") for m in unknown))
        rows = series.select(RUN, "frame", "temperature_c", *dict.fromkeys(value for value, _, _ in have.values())).join(told, RUN, "left")
        ups |= {m: F.coalesce(f"told_{m}", F.lit(True)) for m in unknown}
    reports = fit.reports(long(rows, ups)).where("x_m IS NOT NULL")
    reports = stored(reports, "reports")  # one row for each run and metric, used by every gate
    wide = reports.groupBy(RUN).agg(*(F.max(F.when(F.col("metric_key") == m, F.struct("increasing", "x_m", "x_a"))).alias(f"ref_{m}") for m in have))
    out = series.join(wide, RUN, "left")
    for metric, (value, recovery, _) in have.items():
        ref = F.col(f"ref_{metric}")
        out = out.withColumn(recovery, recovery_from_fit(F.col(value), ref["x_m"], ref["x_a"], ref["increasing"]))
    return out.drop(*(f"ref_{m}" for m in have)), reports


def _finish(kind: str, series: DataFrame, reports: DataFrame, profile: str, preset: str) -> Analysis:
    series = dealt(stored(series, "series"), RUN, width=3)  # every gate and summary reads it
    gate = stored(routes.gate_table(kind, series, reports, profile), "gates")
    chosen = stored(routes.select(kind, series, reports, gate), "chosen")
    results = routes.route_results(kind, series, reports, gate, chosen)
    results = results.join(routes.qc_summary(kind, series, reports, profile), [RUN, "metric_key"], "left")
    return Analysis(series, reports, gate, chosen, results, routes.object_result(chosen, reports, F.lit(preset)))


def analyze_wire(series: DataFrame, log: DataFrame | None, by: str = "frame", offset_sec: float = 0.0, smoothing: temporal.RouteC = temporal.RouteC()) -> Analysis:
    rows = with_temperature(temporal.route_c(series.drop(*temporal.ROUTE_C_COLUMNS), smoothing), log, by, offset_sec)
    rows, reports = evaluated(dealt(stored(rows, "series"), RUN, width=len(WIRE)), WIRE)
    return _finish("wire", rows, reports, "real_video", "wire_like")


def analyze_braided(series: DataFrame, log: DataFrame | None, by: str = "frame", offset_sec: float = 0.0, profile: str = "real_video") -> Analysis:
    rows = with_temperature(qc.braided_columns(series), log, by, offset_sec)
    rows, reports = evaluated(dealt(stored(rows, "series"), RUN, width=len(BRAIDED)), BRAIDED)
    return _finish("braided", rows, reports, profile, "braided_like")


@dataclass(frozen=True)
class WireScenario:
    """A synthetic wire, how it is drawn, and how it is measured and smoothed."""

    model: synthetic.WireModel = synthetic.WireModel()
    thickness: float = 5.0
    noise: float = 2.0
    blur: float = 0.8
    threshold: int = 145
    smoothing: temporal.RouteC = temporal.RouteC(0.25, 0.25, 0.08)


#: The published benchmark. A run's id is its place here.
WIRE_SCENARIOS = {
    "wire_demo": WireScenario(),
    "wire_demo_high_noise": WireScenario(thickness=4.0, noise=4.5, blur=1.4, threshold=152, smoothing=temporal.RouteC(0.25, 0.22, 0.07)),
    "wire_demo_low_dynamic": WireScenario(synthetic.WireModel(kappa_m=0.0038, kappa_a=0.00055, width_c=3.1), smoothing=temporal.RouteC(0.25, 0.28, 0.09)),
}
#: The part of the frame that is looked at (x0, y0, x1, y1), and the place near which the anchor lies.
WIRE_ROI, WIRE_ANCHOR = (180, 0, 760, 520), (575.0, 13.0)
FPS, SECONDS, START_C, END_C = 20.0, 24.0, 20.0, 65.0


def wire_recording(spark: SparkSession, run_id: int, scenario: WireScenario) -> tuple[DataFrame, DataFrame]:
    """Truth and measured series of one scenario: every frame is drawn and measured."""
    m, (x0, y0, x1, y1) = scenario.model, WIRE_ROI
    truth = synthetic.with_true_recovery(synthetic.wire_truth(synthetic.schedule(spark, FPS, SECONDS, START_C, END_C, run_id), m))
    step, angle = m.length_px / (m.samples - 1), F.radians(F.lit(m.anchor_angle_deg))
    turn = F.col("kappa_true_px_inv") * step
    # The sum of unit steps up to the i-th, in closed form; the first point is the anchor itself.
    reach = lambda i: step * F.sin((i + 1) * turn / 2) / F.sin(turn / 2)
    walk = lambda trig, start: F.transform(F.sequence(F.lit(0), F.lit(m.samples - 1)), lambda i: F.when(i == 0, start).otherwise(start + reach(i) * trig(angle + i * turn / 2)))
    lines = truth.select(RUN, "frame", walk(F.cos, F.lit(m.anchor_x - x0)).alias("xs"), walk(F.sin, F.lit(m.anchor_y - y0)).alias("ys"), F.array_repeat(F.lit(scenario.thickness), m.samples).alias("thickness"))
    found = vision.drawn_objects(lines, x1 - x0, y1 - y0, blur=scenario.blur, noise=scenario.noise, threshold=scenario.threshold, sums=vision.LINE)
    got = vision.wire_measures(stored(found, "objects"))
    # The axis points to the right; the end nearer to the anchor's place is the anchor.
    far = lambda e: F.pow(F.col(f"{e}_x") + x0 - WIRE_ANCHOR[0], 2) + F.pow(F.col(f"{e}_y") + y0 - WIRE_ANCHOR[1], 2)
    turned = far("tip") < far("anchor")
    ends = {f"{e}_{c}": F.when(turned, F.col(f"{o}_{c}")).otherwise(F.col(f"{e}_{c}")) + off for e, o in (("anchor", "tip"), ("tip", "anchor")) for c, off in (("x", x0), ("y", y0))}
    series = got.withColumns(ends).withColumnRenamed("x_px", "x_route_a_px")
    series = series.withColumns({f"route_a_{e}": F.col(e) for e in ("anchor_x", "anchor_y", "tip_x", "tip_y")}).join(truth.select(RUN, "frame", "time_sec"), [RUN, "frame"])
    return truth, stored(series, "measured")


def _against_truth(spark: SparkSession, name: str, done: Analysis, truth: DataFrame, truth_of: dict[str, tuple[str, bool]], errors: dict[str, str]) -> DataFrame:
    """One row for each route of a scenario: its result, the truth's transition temperatures, and the errors of the measured columns."""
    parts = [truth.select(RUN, F.lit(alias).alias("metric_key"), F.lit(up).alias("increasing"), "frame", "temperature_c", F.col(column).alias("value")) for alias, (column, up) in truth_of.items()]
    real = fit.reports(reduce(DataFrame.unionByName, parts)).select(RUN, F.col("metric_key").alias("alias"), F.col("af95_c").alias("truth_af95_c"), F.col("aftan_c").alias("truth_aftan_c"))
    measured = done.series.select(RUN, "frame", *errors)
    rows = routes.flattened(done.route_results).join(real, [RUN, "alias"], "left").join(done.object_result.drop("object_result_schema_version"), RUN, "left")
    rows = rows.join(suite.truth_error(measured, truth.select(RUN, "frame", *set(errors.values())), [RUN], errors), RUN, "left").join(done.series.groupBy(RUN).agg(F.count(F.lit(1)).alias("frames")), RUN)
    return rows.select(F.lit(name).alias("benchmark_name"), "*", (F.col("af95_c") - F.col("truth_af95_c")).alias("af95_error_c"), (F.col("aftan_c") - F.col("truth_aftan_c")).alias("aftan_error_c"))


def wire_benchmark(spark: SparkSession) -> DataFrame:
    """Each scenario's routes against the truth, from drawn frames through measurement, smoothing, fits, gates and selection."""
    parts = []
    for run_id, (name, scenario) in enumerate(WIRE_SCENARIOS.items()):
        truth, series = wire_recording(spark, run_id, scenario)
        done = analyze_wire(series, truth.select(RUN, "frame", "temperature_c"), smoothing=scenario.smoothing)
        kappa = ("kappa_true_px_inv", False)
        errors = {c: "x_true_px" if c.startswith("x_") else kappa[0] for c in ("x_route_a_px", "x_fit_px", "x_route_c_px", "kappa_fit_px_inv", "kappa_route_c_px_inv")}
        rows = _against_truth(spark, name, done, truth, {"A": ("x_true_px", True), "B": kappa, "C": kappa}, errors)
        parts.append(rows.join(qc.wire_summary(done.series).drop("quality_median"), RUN, "left"))
    return stored(reduce(DataFrame.unionByName, parts), "benchmark")
