"""Choices among candidates, suite rows and their files, former column names, and windows over late rows."""

import pytest
from pyspark.sql import functions as F

from thermoline.operators import candidates, geometry, ordered, qc, suite
from thermoline.sources import files
from thermoline.streaming import monitor

PATH_SCHEMA = "frame long, candidate string, length_px double, axis_span_px double, support double"


def chosen(spark, rows):
    got = candidates.centerlines(spark.createDataFrame(rows, PATH_SCHEMA), ["frame"])
    return {r.frame: (r.primary, r.secondary) for r in got.collect()}


def test_centerlines(spark):
    rows = [
        (1, "skeleton", 100.0, 90.0, 0.9), (1, "prior", 104.0, 95.0, 0.9), (1, "body_bins", 101.0, 94.0, 0.9),
        (2, "body_bins", 60.0, 50.0, 1.0), (2, "skeleton", 100.0, 90.0, 0.8), (2, "prior", 110.0, 92.0, 0.7),  # body_bins is too short to be chosen
        (3, "body_bins", 60.0, 50.0, 1.0), (3, "prior", 100.0, 90.0, 0.8),  # but is all that is left beside prior
        (4, "prior", 100.0, 90.0, 0.8), (4, "skeleton", None, 90.0, 0.8), (4, "body_bins", 0.0, 90.0, 0.8),
        (5, "b", 10.0, 9.0, 0.5), (5, "a", 10.0, 9.0, 0.5),  # names break ties
        (6, "skeleton", float("nan"), 9.0, 0.5),
    ]
    assert chosen(spark, rows) == {1: ("body_bins", "skeleton"), 2: ("skeleton", "prior"), 3: ("prior", "body_bins"), 4: (None, None), 5: ("a", "b"), 6: (None, None)}
    assert chosen(spark, []) == {}


def test_best_extraction(spark):
    schema = "frame long, region long, quality double, length_axis_px double, area_proj_px2 double, attachment_count long, endpoint_jump_px double, centerline_disagreement double"
    rows = [(1, 0, 0.5, 100.0, 50.0, 0, 0.0, 0.0), (1, 1, 0.6, 100.0, 50.0, 3, 0.0, 0.0), (1, 2, 0.5, 100.0, 50.0, 0, 0.0, 0.0), (2, 0, None, 1.0, 1.0, 0, 0.0, 0.0)]
    got = candidates.best_extraction(spark.createDataFrame(rows, schema), ["frame"], "region").orderBy("frame").collect()
    assert [(r.frame, r.region, r.score) for r in got] == [(1, 0, pytest.approx(0.8)), (2, 0, None)]


def test_filled(spark):
    details = spark.createDataFrame([(1, "", [], {}, None), (2, "d", ["w"], {"a": 1}, 2.0), (None, "x", [], {}, 1.0)], "detail_seq long, route string, warnings array<string>, extra map<string,int>, af95_c double")
    rows = spark.createDataFrame([(1, "r", ["v"], {"b": 2}, 5.0, "out/1", "text"), (2, "r", ["v"], {"b": 2}, 5.0, "out/2", None), (9, "r", None, None, 5.0, "", "")], "detail_seq long, route string, warnings array<string>, extra map<string,int>, af95_c double, output_dir string, description string")
    got = {r.detail_seq: r for r in suite.filled(rows, details, "detail_seq").collect()}
    assert set(got) == {1, 2}
    assert (got[1].route, got[1].warnings, got[1].extra, got[1].af95_c, got[1].demo_output, got[1].benchmark_description) == ("r", ["v"], {"b": 2}, 5.0, "out/1", "text")
    assert (got[2].route, got[2].warnings, got[2].extra, got[2].af95_c, got[2].demo_output) == ("d", ["w"], {"a": 1}, 2.0, "out/2")


def test_suite_files(spark, tmp_path):
    schema = "benchmark_name string, af95_c double, warnings array<string>"
    rows = spark.createDataFrame([("wire", 49.5, ["a", "b"]), ("braided", None, [])], schema)
    files.write_suite(rows, str(tmp_path))
    assert sorted(map(tuple, files.suite(spark, str(tmp_path), schema).collect())) == sorted(map(tuple, rows.collect()))
    text = spark.read.text(f"{tmp_path}/benchmark_summary.json").collect()
    assert any('"af95_c":null' in r.value for r in text)
    flat = {r.benchmark_name: r for r in spark.read.csv(f"{tmp_path}/benchmark_summary.csv", header=True).collect()}
    assert flat["wire"].warnings == "a;b" and flat["braided"].af95_c is None


def test_former_names(spark):
    rows = spark.createDataFrame([(1, k, 100.0, 50.0, 3.0, 1.0, 0.0, 0.0, 100.0, 0.0, 0.5, 0.0) for k in range(3)], "run_id long, frame long, length_axis_px double, area_proj_px2 double, endpoint_jump_px double, branch_count_after_pruning double, anchor_x double, anchor_y double, tip_x double, tip_y double, diameter_peak_pos_norm double, axis_peak_position_stability double")
    got = qc.braided_columns(rows).orderBy("frame").first()
    assert (got.endpoint_gap_alt_centerline_px, got.branch_component_count_after_pruning, got.length_axis_disagreement_px, got.centerline_disagreement) == (3.0, 1.0, None, None)
    assert got.endpoint_jump_fraction == pytest.approx(0.03)


def test_smoothed_path(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, None, 1.0), (1, 2, 3.0, 1.0), (1, 3, 9.0, 1.0), (2, 0, 5.0, 1.0), (2, 1, 8.0, 2.0)], "run_id long, frame long, x double, y double")
    got = ordered.smoothed_path(rows, "x", "y", 3).orderBy("run_id", "frame").collect()
    assert [r.x for r in got] == [1.0, None, 4.0, 7.0, 5.0, 8.0]


def test_late_rows_of_a_stream(spark, tmp_path):
    """A row behind the watermark is left out; one within it still counts."""
    source, schema = f"{tmp_path}/in", "run_id long, ts string, v double"
    batches = [[(1, "2024-01-01 00:01:00", 1.0), (1, "2024-01-01 01:00:00", 2.0)], [(1, "2024-01-01 00:02:00", 50.0), (1, "2024-01-01 00:56:00", 4.0)], [(1, "2024-01-01 03:00:00", 0.0)], [(1, "2024-01-01 03:01:00", 0.0)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(source)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = monitor.windowed(stream.withColumn("ts", F.to_timestamp("ts")), "ts", "v").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("start").collect()
    assert [(r.start.strftime("%H:%M"), r.rows, r.mean) for r in got] == [("00:00", 1, 1.0), ("00:55", 1, 4.0), ("01:00", 1, 2.0)]


def test_profile_metrics(spark):
    """A straight path of steps of 5 along (3, 4), wide in its middle; a frame without any width has no row."""
    widths = [0.0, 4.0, 8.0, 8.0, 4.0, 0.0]
    rows = [(1, k, 3.0 * k, 4.0 * k, w) for k, w in enumerate(widths)] + [(2, 0, 0.0, 0.0, 3.0)] + [(3, k, 1.0 * k, 0.0, None) for k in range(3)]
    got = {r.frame: r for r in geometry.profile_metrics(spark.createDataFrame(rows, "frame long, sample long, x double, y double, width_px double"), ["frame"], "sample").collect()}
    assert set(got) == {1, 2}
    a = got[1]
    assert (a.length_axis_px, a.length_axis_alt_px, a.diameter_px, a.diameter_peak_span_px, a.area_proj_px2) == pytest.approx((15.0, 15.0, 8.0, 5.0, 100.0))
    assert (a.compaction_zone_length_px, a.transition_zone_left_px, a.zone_symmetry) == pytest.approx((5.0, 5.0, 1.0))
    assert (got[2].length_axis_px, got[2].area_proj_px2) == (0.0, None)
