"""Published transition temperatures of the demonstration wire, 480 frames from 20 to 65 degrees."""

import pytest

from thermoline.operators import fit, ordered
from thermoline.sources import synthetic


@pytest.fixture(scope="module")
def truth(spark):
    return synthetic.with_true_recovery(synthetic.wire_truth(synthetic.schedule(spark, 20, 24.0, 20.0, 65.0))).cache()


def test_published_values(truth):
    got = {}
    for m in ("x", "kappa"):
        got[f"{m}_af95"] = ordered.af_95(truth, f"{m}_recovery_true").first()["af95_c"]
        got[f"{m}_aftan"] = ordered.af_tan(truth, f"{m}_recovery_true").first()["aftan_c"]
    assert got == pytest.approx({"x_af95": 49.641124, "x_aftan": 48.719700, "kappa_af95": 52.884011, "kappa_aftan": 50.995924}, abs=1e-6)


def test_fit_recovers_the_model(truth):
    from pyspark.sql import functions as F

    long = truth.select("run_id", F.lit("kappa").alias("metric_key"), F.lit(False).alias("increasing"), "frame", "temperature_c", (F.col("kappa_true_px_inv") * 1000).alias("value"))
    r = fit.reports(long).first()
    assert (r.x_m, r.x_a, r.t0, r.width) == pytest.approx((-4.5, -0.05, 47.0, 2.0), abs=1e-3)
    assert r.fit_rmse < 1e-5 and r.monotonic_violation_fraction == 0 and r.dynamic_range == pytest.approx(4.45, abs=2e-3)
    assert r.af95_c == pytest.approx(47.0 + 2.0 * 2.944439, abs=1e-2)


def test_constant_temperature_and_short_runs_have_a_reason(spark):
    rows = [(1, "m", True, k, 20.0, float(k)) for k in range(9)] + [(2, "m", True, k, 20.0 + k, float(k)) for k in range(3)]
    got = {r.run_id: r for r in fit.reports(spark.createDataFrame(rows, "run_id long, metric_key string, increasing boolean, frame long, temperature_c double, value double")).collect()}
    assert got[1].reason == "constant_temperature" and got[2].reason == "insufficient_points" and got[1].x_m is None


def test_wire_benchmark_runs_every_scenario_whole(spark):
    from thermoline.plans import analysis

    got = {(r.benchmark_name, r.alias): r for r in analysis.wire_benchmark(spark).collect()}
    assert set(got) == {(name, alias) for name in ("wire_demo", "wire_demo_high_noise", "wire_demo_low_dynamic") for alias in "ABC"}
    assert all(r.frames == 480 for r in got.values())
    for name, x, kappa in (("wire_demo", 48.719700, 50.995924), ("wire_demo_high_noise", 48.719700, 50.995924), ("wire_demo_low_dynamic", 50.467121, 53.092273)):
        assert [got[name, a].truth_aftan_c for a in "ABC"] == pytest.approx([x, kappa, kappa], abs=1e-6)
        assert abs(got[name, "B"].af95_error_c) < 1 and got[name, "B"].object_formal_metric_key == "kappa_fit"
        assert got[name, "A"].x_route_a_px_mae < 5
