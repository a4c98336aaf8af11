"""Temporal kernels, alignment and geometry on small inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermoline.operators import align, geometry, ordered, suite, temporal
from thermoline.sources import files
from thermoline.streaming import tracking

LOG = [(0, 20), (5, 28), (10, 36), (15, 44), (20, 51), (25, 58), (30, 64)]


def test_temperature_by_time(spark):
    log = spark.createDataFrame([(1, float(t), float(c)) for t, c in LOG], "run_id long, time_sec double, temperature_c double")
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate((-1.0, 2.5, 7.0, 10.0, 31.0))], "run_id long, frame long, time_sec double")
    assert [r.temperature_c for r in align.by_time(rows, log).orderBy("frame").collect()] == [None, 24.0, pytest.approx(31.2), 36.0, None]


def test_log_file(spark, tmp_path):
    (tmp_path / "log.csv").write_text("time_sec,temperature_c\n0,20\n5,nan\nx,28\n")
    assert [(r.time_sec, r.temperature_c) for r in files.temperature_log(spark, str(tmp_path / "log.csv"), 3).collect()] == [(0.0, 20.0), (5.0, None), (None, 28.0)]
    (tmp_path / "bad.csv").write_text("time_sec\n0\n")
    with pytest.raises(ValueError, match="temperature_c"):
        files.temperature_log(spark, str(tmp_path / "bad.csv"), 3)


def test_route_c_without_noise_keeps_the_tip(spark):
    n = 30
    df = pd.DataFrame({"run_id": 1, "frame": range(n), "quality": 1.0, "kappa_fit_px_inv": 0.05, **{f"{r}{e}_{c}": v for r in ("", "route_a_") for e, c, v in (("anchor", "x", 10.0), ("anchor", "y", 5.0), ("tip", "x", 40.0), ("tip", "y", 5.0))}})
    out = temporal.route_c(spark.createDataFrame(df)).toPandas()
    assert out[temporal.ROUTE_C_COLUMNS].to_numpy() == pytest.approx(np.tile([10, 5, 40, 5, 0, 30, 0.05], (n, 1)))


def test_rolling_median_fits_short_runs(spark):
    rows = [(n, k, float(v)) for n in (1, 2, 3, 5, 8) for k, v in enumerate(np.random.default_rng(n).permutation(n))]
    df = spark.createDataFrame(rows, "run_id long, frame long, v double")
    got = df.select("run_id", "frame", ordered.rolling_median("v", ordered.in_frames(), 7).alias("m")).toPandas()
    for n in (1, 2, 3, 5, 8):
        v = pd.Series([x[2] for x in rows if x[0] == n])
        window = min(7, n) - (min(7, n) % 2 == 0)
        want = v.rolling(window, center=True, min_periods=1).median() if window >= 3 else v
        assert got[got.run_id == n].sort_values("frame").m.tolist() == want.tolist()


def test_spans_and_areas(spark):
    mask = [(1, x, y) for y in range(1, 5) for x in range(2, 10)]
    df = spark.createDataFrame(mask, "run_id long, x int, y int")
    assert geometry.directional_span(df, ["run_id"], "x", "y", 0.0).first()[1] == 7.0
    assert geometry.directional_span(df, ["run_id"], "x", "y", 90.0).first()[1] == pytest.approx(3.0)
    profile = spark.createDataFrame([(1, 10.0 * k, float(w)) for k, w in enumerate((4, 9, 18, 24, 18, 9, 4))], "run_id long, s double, w double")
    assert geometry.trapezoid_area(profile, ["run_id"], "s", "w").first()[1] == 820.0


def test_sweep(spark):
    rows = [("137", 0.80, 3.2, "58.0", 1.0), ("145", 0.85, 2.5, "59.2", float("nan")), ("153", 0.83, 1.9, "text", 2.0)]
    got = {r.field: r for r in suite.sweep_summary(spark.createDataFrame(rows, "k string, quality double, mae double, af95 string, other double"), "k", ["quality", "mae", "af95", "other"], "145").collect()}
    assert got["quality"].spread == pytest.approx(0.05) and got["mae"].spread == pytest.approx(1.3)
    assert got["af95"].baseline_max_delta == pytest.approx(1.2) and got["af95"].max_abs == 59.2
    assert got["other"].baseline_max_delta is None


def test_resample_reaches_the_end(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 4.0, 8.0), (1, 11.0, 1.0)], "run_id long, s double, v double")
    got = [(r.s, r.v) for r in ordered.resample(df, ["v"], "s", 2.0).orderBy("s").collect()]
    assert got == [(0.0, 0.0), (2.0, 4.0), (4.0, 8.0), (6.0, 6.0), (8.0, 4.0), (10.0, 2.0), (11.0, 1.0)]


def test_json_sources(spark, tmp_path):
    for name, text in (("a", '{"benchmark_name": "a", "v": 1.5}'), ("b", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "analysis_metrics.json").write_text(text)
    got = files.benchmark_outputs(spark, str(tmp_path), "benchmark_name string, v double").collect()
    assert [(r.output_dir_name, r.benchmark_name, r.v) for r in got] == [("a", "a", 1.5), ("b", None, None)]


def test_sweeps_are_bounded(spark):
    series = spark.range(3)
    got = suite.sensitivity(series, spark.createDataFrame([(1, "a"), (2, None)], "threshold int, note string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, *v) for i in range(3) for v in ((1, "a"), (2, None))), key=str)
    assert suite.sensitivity(series, spark.createDataFrame([], "threshold int")).count() == 0
    with pytest.raises(ValueError, match="at most"):
        suite.sensitivity(series, spark.range(suite.MOST_VARIANTS + 1).toDF("threshold"))


def test_staging(spark):
    from thermoline.sources import staging

    rows = staging.stored(spark.range(5), "five")
    assert rows.count() == 5
    other = type("Session", (), {"conf": type("Conf", (), {"get": lambda self, k, d=None: d})(), "sparkContext": type("Context", (), {"master": "spark://far:7077", "getCheckpointDir": lambda self: None})()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(other)
