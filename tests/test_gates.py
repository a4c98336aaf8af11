"""Gates on runs of twenty rows with one column disturbed: every case is a run of one table."""

import numpy as np
import pandas as pd
import pytest

from thermoline.operators import gates, qc, routes

N = 20
PLATEAU = np.concatenate([np.linspace(0, 0.88, 15), np.linspace(0.92, 1, 5)])
SHAKY = np.concatenate([np.linspace(0.08, 0.03, 10), np.linspace(0.031, 0.05, 10)])


def wire(**changes):
    frame, kappa = np.arange(N), np.linspace(0.08, 0.01, N)
    row = {"frame": frame, "temperature_c": np.linspace(20, 80, N), "x_route_a_px": np.linspace(55, 90, N), "x_route_a_recovery": PLATEAU, "route_a_anchor_x": np.full(N, 10.0), "route_a_anchor_y": np.full(N, 15.0), "route_a_tip_x": np.linspace(65, 100, N), "route_a_tip_y": np.full(N, 15.0), "kappa_fit_px_inv": kappa, "kappa_fit_recovery": PLATEAU, "kappa_route_c_px_inv": kappa + 0.001 * np.sin(np.linspace(0, 5, N)), "kappa_route_c_recovery": np.concatenate([np.linspace(0, 0.9, 15), np.linspace(0.94, 1, 5)]), "quality": np.full(N, 0.9)}
    return row | changes


def report(metric, up, spread, violation=0.0, rmse=0.8):
    return {"metric_key": metric, "increasing": up, "fit_rmse": rmse, "monotonic_violation_fraction": violation, "dynamic_range": spread, "af95_c": 61.0, "aftan_c": 58.0}


def tables(spark, cases):
    """One run a case; the reports of each."""
    series = pd.concat([pd.DataFrame({"run_id": k} | c[0]) for k, c in enumerate(cases)])
    reports = pd.DataFrame([{"run_id": k} | r for k, c in enumerate(cases) for r in c[1]])
    return spark.createDataFrame(series), spark.createDataFrame(reports)


def of(metric):
    return lambda series, report: gates.wire_gate(series, report, metric)


def reasons(gate, spark, cases, *args):
    s, r = tables(spark, cases)
    got = {x.run_id: x.gate_reason for x in gate(s, r, *args).collect()}
    assert [got[k] for k in range(len(cases))] == [c[2] for c in cases]


def test_wire_a(spark):
    good = [report("x_route_a", True, 35.0)]
    jumped = wire()
    jumped["route_a_tip_x"] = jumped["route_a_tip_x"] + np.where(np.arange(N) >= 10, 18.0, 0.0)
    low = wire(x_route_a_recovery=np.linspace(0, 0.85, N))
    reasons(of("x_route_a"), spark, [(wire(), good, None), (jumped, good, "x_route_a_endpoint_instability"), (wire(), [report("x_route_a", True, 4.9)], "x_route_a_dynamic_range_too_small"), (wire(), [report("x_route_a", True, 35.0, 0.3)], "x_route_a_not_monotonic_enough"), (low, good, "missing_high_temp_plateau"), (wire(), [report("other", True, 1.0)], "x_route_a_insufficient_points")])


def test_wire_b(spark):
    good, shaky = [report("kappa_fit", False, 0.07)], [report("kappa_fit", False, 0.07, 0.4)]
    noisy = wire(kappa_fit_px_inv=np.linspace(0.08, 0.01, N) + 0.002 * np.where(np.arange(N) % 2, -1, 1))
    reasons(of("kappa_fit"), spark, [(wire(), good, None), (wire(), [report("other", True, 1.0)], "insufficient_kappa_points"), (wire(kappa_fit_px_inv=SHAKY), shaky, "kappa_fit_not_monotonic_enough"), (noisy, shaky, None), (wire(quality=np.full(N, 0.05)), good, "unstable_kappa_extraction")])


def test_wire_c(spark):
    both = lambda spread: [report("kappa_route_c", False, spread), report("kappa_fit", False, 0.07)]
    far = wire(kappa_route_c_px_inv=np.linspace(0.18, 0.11, N))
    reasons(of("kappa_route_c"), spark, [(wire(), both(0.07), None), (far, both(0.07), "kappa_route_c_route_b_deviation_too_large"), (wire(), both(0.001), "kappa_route_c_dynamic_range_too_small")])


def braided(**changes):
    row = {"frame": np.arange(N), "temperature_c": np.linspace(20, 80, N), "length_axis_formal_px": np.linspace(120, 90, N), "length_axis_recovery": PLATEAU, "quality": np.full(N, 0.9), "centerline_disagreement": np.full(N, 0.01), "endpoint_gap_alt_centerline_px": np.full(N, 2.0), "endpoint_frame_jump_px": np.full(N, 2.0), "branch_component_count_after_pruning": np.zeros(N), "axis_peak_position_stability": np.full(N, 0.02), "body_mask_attachment_leak_fraction": np.zeros(N), "excluded_attachment_area_px2": np.zeros(N), "component_area_px2": np.full(N, 1000.0), "body_mask_area_px2": np.full(N, 800.0), "attachment_border_touch_count": np.zeros(N), "diameter_max_px": np.linspace(20, 40, N), "diameter_max_recovery": PLATEAU, "area_proj_formal_px2": np.linspace(500, 720, N), "area_proj_recovery": PLATEAU, "area_proj_definition_gap_px2": np.zeros(N)}
    row |= {k: np.asarray(v, float) + np.zeros(N) for k, v in changes.items()}
    row["endpoint_gap_alt_centerline_fraction"] = row["endpoint_gap_alt_centerline_px"] / row["length_axis_formal_px"]
    row["endpoint_frame_jump_fraction"] = row["endpoint_frame_jump_px"] / row["length_axis_formal_px"]
    return row


LENGTH = [report("length_axis", False, 30.0)]
BRAIDED_CASES = [
    ({}, None), ({"body_mask_attachment_leak_fraction": 0.06}, "body_mask_attachment_leak_fraction"), ({"branch_component_count_after_pruning": 42}, None), ({"attachment_border_touch_count": 1}, None), ({"body_mask_area_px2": 400}, "body_mask_area_fraction"),
    ({"length_axis_formal_px": 100.0, "endpoint_gap_alt_centerline_px": 10.5}, "endpoint_jump"), ({"endpoint_frame_jump_px": 10.5}, "endpoint_frame_jump"), ({"excluded_attachment_area_px2": 160}, "excluded_attachment_area_fraction"), ({"centerline_disagreement": 0.2}, "centerline_disagreement"), ({"quality": 0.05}, "unstable_axis_extraction"),
]


def test_braided_length(spark):
    reasons(gates.braided_gate, spark, [(braided(**c), LENGTH, want) for c, want in BRAIDED_CASES], "length_axis")


def test_synthetic_runs_may_jump_between_frames(spark):
    reasons(gates.braided_gate, spark, [(braided(endpoint_frame_jump_px=10.5), LENGTH, None)], "length_axis", "synthetic")


def test_braided_trend_tolerates_half_a_pixel(spark):
    wavy = braided()
    wavy["length_axis_formal_px"] = np.linspace(120, 90, N) + 0.2 * np.sin(np.arange(N) * 3.0)
    reasons(gates.braided_gate, spark, [(wavy, [report("length_axis", False, 30.0, 0.55)], None)], "length_axis")


def test_other_braided_metrics(spark):
    reasons(gates.braided_gate, spark, [(braided(), [report("diameter_max", True, 20.0)], None)], "diameter_max")
    area = [report("area_proj", True, 220.0)]
    reasons(gates.braided_gate, spark, [(braided(), area, None), (braided(area_proj_definition_gap_px2=140.0), area, "area_proj_definition_gap_instability")], "area_proj")


def test_acceptance(spark):
    s, _ = tables(spark, [(braided(), LENGTH, None), (braided(quality=0.3, body_mask_area_px2=400), LENGTH, None)])
    got = {r.run_id: r for r in qc.acceptance(s).collect()}
    assert got[0].accepted and got[0].reasons == [] and got[0].valid_frames == 20
    assert got[0].endpoint_gap_alt_centerline_limit_px == 12.0 and got[0].endpoint_frame_jump_limit_px == 12.0
    assert got[1].reasons == ["unstable_axis_extraction", "quality_low_fraction", "body_mask_area_fraction"]


def test_selection(spark):
    all_wire = [report("x_route_a", True, 35.0), report("kappa_fit", False, 0.07), report("kappa_route_c", False, 0.07)]
    low = wire(kappa_fit_recovery=np.linspace(0, 0.82, N))
    s, r = tables(spark, [(wire(), all_wire, None), (low, all_wire, None), (low, all_wire[:1], None)])
    chosen = {x.run_id: x for x in routes.select("wire", s, r, routes.gate_table("wire", s, r)).collect()}
    assert (chosen[0].formal_metric_key, chosen[0].mode, chosen[0].reportability_status) == ("kappa_fit", "formal_af", "formal")
    assert (chosen[1].formal_metric_key, chosen[1].primary_metric_key, chosen[1].formal_gate_reason) == (None, "kappa_fit", "missing_high_temp_plateau")
    assert (chosen[2].primary_metric_key, chosen[2].reportability_status) == ("x_route_a", "reportable_with_warning")


def test_braided_selection_prefers_the_diameter_on_a_tie(spark):
    both = [report("length_axis", False, 30.0, rmse=0.0), report("diameter_max", True, 20.0, rmse=0.0)]
    s, r = tables(spark, [(braided(), both, None), (braided(), both[:1], None)])
    chosen = {x.run_id: x for x in routes.select("braided", s, r, routes.gate_table("braided", s, r)).collect()}
    assert chosen[0].formal_metric_key == "diameter_max" and chosen[1].formal_metric_key == "length_axis"


def test_no_temperature(spark):
    cold = wire()
    cold["temperature_c"] = np.full(N, np.nan)
    s, r = tables(spark, [(cold, [report("kappa_fit", False, 0.07)], None)])
    s = s.replace(float("nan"), None)
    gate = routes.gate_table("wire", s, r)
    got = routes.route_results("wire", s, r, gate, routes.select("wire", s, r, gate)).collect()
    assert {x.reportability_status for x in got} == {"quicklook_only"} and {x.gate_reason for x in got} == {"temperature_sync_missing"}
    assert sorted(x.alias for x in got) == ["A", "B", "C"]


@pytest.mark.parametrize(("reason", "label"), [("temperature_sync_missing", "temperature"), ("body_mask_attachment_leak_fraction", "attachment"), ("insufficient_kappa_points", "points"), ("missing_high_temp_plateau", "other"), (None, None)])
def test_labels(spark, reason, label):
    from pyspark.sql import functions as F

    from thermoline.functions.scalar import reason_label

    assert spark.range(1).select(reason_label(F.lit(reason).cast("string"))).first()[0] == label
