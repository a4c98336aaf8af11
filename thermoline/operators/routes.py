"""Route results, selection of the reportable route, and the summary contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoline.functions.scalar import BRAIDED_ROUTES, WIRE_ROUTES, route_alias
from thermoline.operators import gates, qc
from thermoline.operators.ordered import RUN

ROUTE_SCHEMA_VERSION, OBJECT_SCHEMA_VERSION = 5, 2
CANDIDATES = {"wire": ("kappa_fit",), "braided": ("length_axis", "diameter_max")}
ROUTES = {"wire": WIRE_ROUTES, "braided": BRAIDED_ROUTES}
_PREFERENCE = {"wire": {"kappa_fit": 0.0, "kappa_route_c": 1.0, "x_route_a": 2.0}, "braided": {"length_axis": 1.0, "diameter_max": 0.0}}


def gate_table(kind: str, series: DataFrame, report: DataFrame, profile: str = "real_video") -> DataFrame:
    """Gate reason of each run and route."""
    metrics = list(ROUTES[kind].values())
    got = gates.wire_gates(series, report, metrics) if kind == "wire" else gates.braided_gates(series, report, metrics, profile)
    alias = F.create_map(*(F.lit(x) for a, m in ROUTES[kind].items() for x in (m, a)))
    return got.select(RUN, alias[F.col("metric_key")].alias("alias"), "metric_key", "gate_reason")


def scores(kind: str, series: DataFrame, report: DataFrame) -> DataFrame:
    """Scores by which metrics are ranked, for those with four valid rows: how monotone, how well fitted, and preference."""
    preference = _PREFERENCE[kind]
    own = report.where(F.col("metric_key").isin(list(preference))).select(*gates.KEY, F.col("increasing").alias("up"), "fit_rmse", "dynamic_range", "monotonic_violation_fraction")
    values = F.array(*(F.struct(F.lit(m).alias("metric_key"), F.col(gates.COLUMNS[m][0]).cast("double").alias("v")) for m in preference))
    long = series.select(RUN, "frame", "temperature_c", F.inline(values))
    rows = own.join(qc.trend_violations(long, qc.WIRE_TREND if kind == "wire" else qc.BRAIDED_TREND).where("n >= 4"), gates.KEY)
    ranks = F.create_map(*(F.lit(x) for pair in preference.items() for x in pair))
    return rows.select(*gates.KEY, ranks[F.col("metric_key")].alias("preference"), F.coalesce(qc.violation(F.col("up")), "monotonic_violation_fraction").alias("monotonic_score"), (F.col("fit_rmse") / F.greatest("dynamic_range", F.lit(1e-9))).alias("fit_score"))


def select(kind: str, series: DataFrame, report: DataFrame, gate: DataFrame) -> DataFrame:
    """One row a run: primary and formal metric, status, mode and the reason against a formal one.

    A wire object prefers routes in a fixed order; a braided one the most monotone. Scores are made once for both
    choices: a run's few metrics are an array, best first.
    """
    order = ("preference", "monotonic_score", "fit_score") if kind == "wire" else ("monotonic_score", "fit_score", "preference")
    candidates, metric, reason = CANDIDATES[kind], F.col("metric_key"), F.col("gate_reason")
    ranked = scores(kind, series, report).groupBy(RUN).agg(F.sort_array(F.collect_list(F.struct(*order, "metric_key")))["metric_key"].alias("ranked"))
    judged = gate.groupBy(RUN).agg(F.collect_set(F.when(reason.isNull() & metric.isin(list(candidates)), metric)).alias("passed"), F.max(F.when(metric == candidates[0], reason)).alias("fallback_reason"))
    rows = series.select(RUN).distinct().join(ranked, RUN, "left").join(judged, RUN, "left")
    primary = F.filter("ranked", lambda m: m.isin(list(candidates))) if kind == "braided" else F.col("ranked")
    rows = rows.withColumns({"primary_metric_key": F.get(primary, 0), "formal_metric_key": F.get(F.filter("ranked", lambda m: F.array_contains("passed", m)), 0)})
    is_formal = F.col("formal_metric_key").isNotNull()
    status = F.when(is_formal, "formal").when(F.col("primary_metric_key").isNotNull(), "reportable_with_warning").otherwise("quicklook_only")
    return rows.select(RUN, "primary_metric_key", "formal_metric_key", F.when(~is_formal, F.col("fallback_reason")).alias("formal_gate_reason"), status.alias("reportability_status"), F.when(is_formal, "formal_af").otherwise("quicklook").alias("mode"))


def route_results(kind: str, series: DataFrame, report: DataFrame, gate: DataFrame, chosen: DataFrame, auxiliary: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each run and route A, B, C, as the route contract has it."""
    auxiliary = auxiliary or ({"kappa_fit": ["x_fit"], "kappa_route_c": ["x_route_c"]} if kind == "wire" else {})
    temperature = series.groupBy(RUN).agg((F.count("temperature_c") > 0).alias("has_temperature"))
    numbers = report.select(RUN, "metric_key", "af95_c", "aftan_c", "fit_rmse", "monotonic_violation_fraction", "dynamic_range", F.lit(True).alias("reported"))
    rows = gate.join(numbers, [RUN, "metric_key"], "left").join(temperature, RUN).join(chosen.select(RUN, "primary_metric_key", "formal_metric_key"), RUN, "left")
    names = {m: (f"{a}:{m}", *gates.COLUMNS[m]) for a, m in ROUTES[kind].items()}
    spec = F.create_map(*(x for m, (label, value, recovery) in names.items() for x in (F.lit(m), F.struct(F.lit(label).alias("label"), F.lit(value).alias("value"), F.lit(recovery).alias("recovery"), F.array(*(F.lit(k) for k in auxiliary.get(m, []))).cast("array<string>").alias("auxiliary")))))
    own = spec[F.col("metric_key")]
    candidate = F.col("metric_key").isin(list(CANDIDATES[kind]))
    missing = F.when(F.col("metric_key") == "length_axis", F.lit("insufficient_axis_points")).otherwise(F.concat("metric_key", F.lit("_insufficient_points")))
    status, reason = gates.route_status(F.col("gate_reason"), F.col("has_temperature"), F.col("reported").isNotNull(), candidate, missing)
    is_primary = F.coalesce(F.col("primary_metric_key") == F.col("metric_key"), F.lit(False))
    is_formal = F.coalesce(F.col("formal_metric_key") == F.col("metric_key"), F.lit(False))
    role = F.when(is_formal, "object_formal").when(is_primary, "object_primary").when(candidate, "formal_candidate").otherwise("route_result")
    rows = rows.withColumns({"status": status, "reason": reason})
    return rows.select(
        RUN, "alias", "metric_key", own["label"].alias("display_label"), own["value"].alias("value_series_col"), own["recovery"].alias("recovery_series_col"),
        "af95_c", "aftan_c", "fit_rmse", "monotonic_violation_fraction", "dynamic_range",
        F.col("status").alias("reportability_status"), F.col("reason").alias("gate_reason"), F.array_compact(F.array("reason")).alias("warning_codes"),
        candidate.alias("formal_candidate"), (candidate & (F.col("status") == "formal_passed")).alias("accepted_as_formal_candidate"),
        is_primary.alias("selected_as_primary"), is_formal.alias("selected_as_formal"), role.alias("formal_role"), own["auxiliary"].alias("auxiliary_metric_keys"),
    )


def qc_summary(kind: str, series: DataFrame, report: DataFrame, profile: str = "real_video") -> DataFrame:
    """The quality summary struct of each run and route."""
    parts = []
    accepted = qc.acceptance(series, profile).select(RUN, F.col("quality_median").alias("accepted_quality"), "centerline_disagreement_median", "axis_peak_position_stability_p95") if kind == "braided" else None
    for metric in ROUTES[kind].values():
        value, recovery = gates.COLUMNS[metric]
        own = report.where(F.col("metric_key") == metric).select(RUN, "increasing", "fit_rmse", F.col("monotonic_violation_fraction").alias("violation_raw"), F.lit(True).alias("reported"))
        valid = series.dropna(subset=["temperature_c", value])
        got = series.groupBy(RUN).agg(F.count(F.when(F.col("temperature_c").isNotNull() & F.col(value).isNotNull(), 1)).alias("valid_points"), qc.median(F.when(F.col(value).isNotNull(), F.col("quality"))).alias("quality_median"))
        got = got.join(own, RUN, "left").join(qc.tail_median(series, recovery, ["frame"]), RUN, "left")
        violation, key, number = F.col("violation_raw"), F.lit("fit_rmse"), F.col("fit_rmse")
        if metric == "x_route_a":
            full = series.dropna(subset=list(gates.ENDPOINTS))
            a, t = (qc.endpoint_jumps(full, *gates.ENDPOINTS[s : s + 2]).select(RUN, F.col("jump_max").alias(n)) for s, n in ((0, "a_jump"), (2, "t_jump")))
            got = got.join(a, RUN, "left").join(t, RUN, "left")
            key, number = F.lit("endpoint_jump_max_px"), F.greatest("a_jump", "t_jump")
        elif metric == "kappa_route_c":
            both = valid.dropna(subset=["kappa_fit_px_inv"])
            got = got.join(gates.route_c_deviation(both, report), RUN, "left").join(qc.wire_violation(both, value, F.lit(False)), RUN, "left")
            violation, key, number = F.coalesce("violation", "violation_raw"), F.lit("route_b_deviation_fraction"), F.col("deviation")
        elif kind == "braided":
            got = got.join(accepted, RUN, "left").withColumn("quality_median", F.col("accepted_quality"))
            if metric == "length_axis":
                key, number = F.lit("centerline_disagreement_median"), F.col("centerline_disagreement_median")
            elif metric == "diameter_max":
                key, number = F.lit("axis_peak_position_stability_p95"), F.col("axis_peak_position_stability_p95")
            else:
                gap = series.dropna(subset=[value, "area_proj_definition_gap_px2"]).groupBy(RUN).agg(qc.p95(F.abs("area_proj_definition_gap_px2") / F.greatest(F.abs(value), F.lit(1e-9))).alias("area_gap"))
                trend = qc.trend_violations(valid.select(RUN, "frame", "temperature_c", F.col(value).alias("v")), qc.BRAIDED_TREND, (RUN,)).drop("n")
                got = got.join(gap, RUN, "left").join(trend, RUN, "left")
                # A run without a report has none.
                violation, key, number = F.when(F.col("reported"), qc.violation(F.col("increasing"))), F.lit("area_definition_gap_fraction_p95"), F.col("area_gap")
        stability = F.struct(key.alias("key"), number.alias("value"))
        parts.append(got.select(RUN, F.lit(metric).alias("metric_key"), F.struct("valid_points", "quality_median", violation.alias("monotonic_violation_fraction"), F.col("tail_median").alias("tail_recovery_median"), stability.alias("stability_metric")).alias("route_qc_summary")))
    return reduce(DataFrame.unionByName, parts)


def flattened(results: DataFrame) -> DataFrame:
    """Route results without the nested summary: its fields as qc_ columns."""
    q = F.col("route_qc_summary")
    plain = [c for c in results.columns if c != "route_qc_summary"]
    fields = [q[f].alias(f"qc_{f}") for f in ("valid_points", "quality_median", "monotonic_violation_fraction", "tail_recovery_median")]
    return results.select(*plain, *fields, q["stability_metric"]["key"].alias("qc_stability_metric_key"), q["stability_metric"]["value"].alias("qc_stability_metric_value"))


def object_result(chosen: DataFrame, report: DataFrame, preset: Column) -> DataFrame:
    """The thirteen object fields of a run, one row each."""
    numbers = report.select(RUN, "metric_key", "af95_c", "aftan_c")
    formal = numbers.toDF(RUN, "formal_metric_key", "formal_af95", "formal_aftan")
    primary = numbers.toDF(RUN, "primary_metric_key", "primary_af95", "primary_aftan")
    rows = chosen.join(formal, [RUN, "formal_metric_key"], "left").join(primary, [RUN, "primary_metric_key"], "left")
    best = F.coalesce("formal_metric_key", "primary_metric_key")
    return rows.select(
        RUN, F.lit(OBJECT_SCHEMA_VERSION).alias("object_result_schema_version"), F.col("reportability_status").alias("object_reportability_status"),
        F.col("formal_metric_key").alias("object_formal_metric_key"), route_alias(preset, F.col("formal_metric_key")).alias("object_formal_route_alias"), F.col("formal_gate_reason").alias("object_formal_gate_reason"),
        F.col("formal_af95").alias("object_formal_af95_c"), F.col("formal_aftan").alias("object_formal_aftan_c"),
        F.col("primary_metric_key").alias("object_provisional_metric_key"), route_alias(preset, F.col("primary_metric_key")).alias("object_provisional_route_alias"),
        F.col("primary_af95").alias("object_provisional_af95_c"), F.col("primary_aftan").alias("object_provisional_aftan_c"),
        best.alias("object_recommended_metric_key"), route_alias(preset, best).alias("object_recommended_route_alias"),
    )


def direction_result(report: DataFrame, runs: DataFrame, metric_key: str = "direction_span") -> DataFrame:
    """Direction metrics are never gated: any report passes. `runs` has angle_deg and has_temperature."""
    own = report.where(F.col("metric_key") == metric_key).select(RUN, "af95_c", "aftan_c", "fit_rmse", "monotonic_violation_fraction", "dynamic_range", F.lit(True).alias("reported"))
    rows = runs.join(own, RUN, "left")
    on, warm, told = F.col("angle_deg").isNotNull(), F.col("has_temperature"), F.col("reported").isNotNull()
    status = F.when(~on | ~warm, "quicklook_only").when(~told, "formal_blocked").otherwise("formal_passed")
    reason = F.when(~on, F.lit("direction_metric_disabled")).when(~warm, F.lit("temperature_sync_missing")).when(~told, F.lit(f"{metric_key}_insufficient_points"))
    shown = on & warm & told
    return rows.select(RUN, on.alias("enabled"), "angle_deg", F.lit(metric_key).alias("metric_key"), *(F.when(shown, F.col(c)).alias(c) for c in ("af95_c", "aftan_c", "fit_rmse", "monotonic_violation_fraction", "dynamic_range")), status.alias("reportability_status"), reason.alias("gate_reason"))


def reported_value(formal: Column, provisional: Column, smoothed: Column, route: Column, route_smoothed: Column) -> Column:
    """The first that there is."""
    return F.coalesce(formal, provisional, smoothed, route, route_smoothed)


def fallback_status(status: Column, gate_reason: Column, selected_as_formal: Column) -> Column:
    """Status of a route of an older summary, from its reason and selection where it has none."""
    return F.coalesce(status, F.when(gate_reason == "temperature_sync_missing", F.lit("quicklook_only")).when(gate_reason.isNotNull(), "formal_blocked").when(selected_as_formal, "formal_passed").otherwise("provisional"))


def complete(results: DataFrame, kind: str) -> DataFrame:
    """Routes A, B and C of every run, those that an older summary lacks as NULLs."""
    every = results.select(RUN).distinct().withColumn("alias", F.explode(F.array(*(F.lit(a) for a in ROUTES[kind]))))
    return every.join(results, [RUN, "alias"], "left")
