"""Interpolation in buckets against one over the whole run, and regions by the frame before."""

import numpy as np
import pandas as pd
import pytest

from thermoline.operators import align
from thermoline.streaming import tracking


@pytest.mark.parametrize("bucket", [0.7, 5.0, 600.0])
def test_buckets_carry_entries(spark, bucket):
    rng = np.random.default_rng(3)
    rows, logs, want = [], [], {}
    for run, n in ((1, 60), (2, 3), (3, 0), (-4, 25)):
        at = np.unique(np.round(rng.uniform(-20, 80, n), 2))
        knots = rng.normal(40, 10, len(at))
        times = np.concatenate([np.round(rng.uniform(-40, 100, 50), 2), at[:5]])
        rows += [(run, k, float(t)) for k, t in enumerate(times)] + [(run, 1000, None)]
        logs += [(run, float(t), float(v)) for t, v in zip(at, knots, strict=True)] + [(run, 3.0, None), (run, None, 5.0)]
        for k, t in enumerate(times):
            want[run, k] = float(np.interp(t, at, knots)) if n and at[0] <= t <= at[-1] else None
        want[run, 1000] = None
    series = spark.createDataFrame(rows, "run_id long, frame long, time_sec double").selectExpr("*", "'x' AS note")
    log = spark.createDataFrame(logs, "run_id long, time_sec double, temperature_c double")
    got = align.by_time(series, log, 0.0, bucket)
    assert got.columns == ["run_id", "frame", "time_sec", "note", "temperature_c"]
    got = {(r.run_id, r.frame): r.temperature_c for r in got.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v)), k


def test_no_window_holds_a_run(spark):
    series = spark.range(100).selectExpr("1L AS run_id", "id AS frame", "id * 1.0D AS time_sec")
    plan = align.by_time(series, series.selectExpr("run_id", "time_sec", "20.0D AS temperature_c"))._jdf.queryExecution().optimizedPlan().toString()
    assert all("bucket" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window") and "is_row" in line)


def test_regions_follow_the_frame_before(spark):
    rng = np.random.default_rng(8)
    rows, want = [], set()
    for run in range(4):
        roi = (0, 0, 100, 60)
        for frame in sorted(rng.choice(500, 40, replace=False).tolist()):
            box = None if rng.random() < 0.2 else tuple(np.round(rng.uniform([0, 0, 50, 30], [40, 25, 99, 59]), 2).tolist())
            rows.append((run, frame, *(box or (None, 1.0, 2.0, 3.0))))
            want.add((run, frame, *roi, roi == (0, 0, 100, 60)))
            roi = tracking.followed(None if box is None else tuple(int(v) for v in box), 100, 60, 0.25)
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["run_id", "frame", "x0", "y0", "x1", "y1"]).sample(frac=1, random_state=1))
    assert set(map(tuple, tracking.tracked(df, 100, 60).collect())) == want
