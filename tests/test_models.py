"""Sampling, arc and model of centerlines against numpy, point by point."""

import numpy as np
import pandas as pd
import pytest

from thermoline.operators import models


def brute(u, v):
    """Model, curvature, reached arc, points and both errors of one path."""
    arc = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(u), np.diff(v)))])
    total = arc[-1]
    if total < 10:
        return None
    full = np.linspace(0, total, max(int(np.ceil(total / 3)) + 1, 16))
    x, y = np.interp(full, arc, u), np.interp(full, arc, v)
    dx, dy = np.gradient(x, full), np.gradient(y, full)
    ddx, ddy = np.gradient(dx, full), np.gradient(dy, full)
    bend = np.convolve(np.abs(dx * ddy - dy * ddx) / np.maximum((dx * dx + dy * dy) ** 1.5, 1e-9), np.ones(7) / 7, "same")
    reach = 0.72 * total
    if bend.max() > 1e-9:
        reach = full[min(np.flatnonzero(bend >= 0.28 * bend.max())[-1] + 2, len(full) - 1)]
    reach = min(max(float(np.clip(reach, 0.42 * total, 0.72 * total)), 30.0), total)
    at = np.linspace(0, reach, max(int(np.ceil(reach / 3)) + 1, 10))
    x, y = np.interp(at, arc, u), np.interp(at, arc, v)
    near = np.abs(x - np.polyval(np.polyfit(y, x, 2), y)) <= 2.5
    if near.sum() >= 6:
        x, y = x[near], y[near]
    c = np.polyfit(y, x, 2)
    q = np.sqrt(np.mean((x - np.polyval(c, y)) ** 2))
    grid = np.linspace(y.min(), y.max(), 120)
    kappa = np.mean(np.abs(2 * c[0]) / (1 + (2 * c[0] * grid + c[1]) ** 2) ** 1.5)
    (cx, cy, k), *_ = np.linalg.lstsq(np.column_stack([2 * x, 2 * y, np.ones(len(x))]), x * x + y * y, rcond=None)
    radius = np.sqrt(k + cx * cx + cy * cy)
    round_off = np.sqrt(np.mean((np.hypot(x - cx, y - cy) - radius) ** 2))
    quadratic = q <= 1.05 * round_off
    return ("quadratic", kappa, reach, len(x), q, round_off) if quadratic else ("circle", 1 / radius, reach, len(x), q, round_off)


def paths():
    rng = np.random.default_rng(4)
    for k in range(40):
        n = int(rng.integers(5, 80))
        s = np.sort(rng.uniform(0, 1, n))
        s[0] = 0
        if k % 4 == 0:
            v, u = 120 * s, rng.uniform(-0.004, 0.004) * (120 * s) ** 2
        elif k % 4 == 1:
            a, r = 1.6 * s, rng.uniform(40, 150)
            v, u = r * np.sin(a), r * (1 - np.cos(a))
        elif k % 4 == 2:
            v, u = 150 * s, np.where(s < 0.3, 0.006 * (150 * s) ** 2, 0)
            u[s >= 0.3] = 0.006 * 45**2 + 0.54 * (150 * s[s >= 0.3] - 45)
        else:
            v, u = 100 * s, 0.003 * (100 * s) ** 2 + rng.normal(size=n) * 0.3
        yield k, u, v


def test_paths(spark):
    rows = [pd.DataFrame({"run_id": 1, "frame": k, "place": range(len(u)), "u": u, "v": v}) for k, u, v in paths()]
    rows += [pd.DataFrame({"run_id": 2, "frame": 1, "place": range(3), "u": [0.0, 0.0, 0.0], "v": [0.0, 2.0, 4.0]}), pd.DataFrame({"run_id": 2, "frame": 2, "place": [0], "u": [None], "v": [None]}), pd.DataFrame({"run_id": 2, "frame": 3, "place": [0], "u": [1.0], "v": [1.0]})]
    df = spark.createDataFrame([tuple(None if pd.isna(x) else x for x in r) for r in pd.concat(rows).itertuples(index=False)], "run_id long, frame long, place long, u double, v double")
    got = {(r.run_id, r.frame): r for r in models.chosen_models(df).collect()}
    for k, u, v in paths():
        r, want = got[1, k], brute(u, v)
        assert r.model_name == want[0], k
        assert (r.kappa_fit_px_inv, r.fit_arc_px) == pytest.approx(want[1:3], rel=1e-5)
        assert r.fit_points == want[3]
        assert (r.quadratic_rmse_px, r.circle_rmse_px) == pytest.approx(want[4:6], rel=1e-4, abs=1e-6)
    assert {r.model_name for (run, _), r in got.items() if run == 1} == {"quadratic", "circle"}
    assert [got[2, f].model_name for f in (1, 2, 3)] == ["failed"] * 3 and got[2, 1].quality == 0.0


def test_a_straight_line_is_a_parabola(spark):
    df = spark.createDataFrame([(1, 1, k, 0.5 * k, 3.0 * k) for k in range(30)], "run_id long, frame long, place long, u double, v double")
    r = models.chosen_models(df).first()
    assert r.model_name == "quadratic" and r.circle_rmse_px is None and r.kappa_fit_px_inv == pytest.approx(0, abs=1e-9)


def test_points_are_dealt_once(spark):
    df = spark.range(100).selectExpr("id % 5 AS run_id", "id % 7 AS frame", "id AS place", "id * 1.0D AS u", "id * 2.0D AS v")
    plan = models.chosen_models(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan


def test_points_stay_with_their_event(spark):
    """Events are dealt before each becomes a path; windows and joins of its points need no other shuffle."""
    from thermoline.plans import virtual

    plan = models.chosen_models(virtual.centerlines(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" in plan and "ENSURE_REQUIREMENTS" not in plan
