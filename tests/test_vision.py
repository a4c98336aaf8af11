import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermoline.operators import vision


def arc(kappa, n=31, step=3.0):
    theta = 0.1 + kappa * step * np.arange(n)
    return (12 + np.cumsum(step * np.cos(theta))).tolist(), (10 + np.cumsum(step * np.sin(theta))).tolist()


def test_wire_frames(spark):
    kappas = [0.0, 0.004, 0.008, 0.012]
    rows = [(1, k, *arc(c), [4.0] * 31) for k, c in enumerate(kappas)]
    frames = vision.drawn(spark.createDataFrame(rows, "run_id long, frame long, xs array<double>, ys array<double>, thickness array<double>"), 128, 96)
    empty = frames.where("frame = 0").withColumn("frame", F.lit(9).cast("long")).withColumn("pixels", F.lit(bytes([236]) * (128 * 96)))
    got = {r.frame: r for r in vision.wire_geometry(frames.unionByName(empty)).collect()}
    assert got[9].model_name == "failed" and got[9].quality == 0 and got[9].x_px is None
    for k, c in enumerate(kappas):
        xs, ys = arc(c)
        assert got[k].x_px == pytest.approx(math.hypot(xs[-1] - xs[0], ys[-1] - ys[0]), abs=4.5)
        assert got[k].kappa_fit_px_inv == pytest.approx(c, abs=0.002)
        assert got[k].quality > 0.5
    assert got[0].x_px > got[1].x_px > got[2].x_px > got[3].x_px


def test_braided_frames(spark):
    rows = []
    for k, (length, top) in enumerate(((100.0, 14.0), (85.0, 25.0), (70.0, 36.0))):
        u = np.arange(25) / 24
        rows.append((1, k, (64 + (u - 0.5) * length).tolist(), [48.0] * 25, (4 + top * np.sin(math.pi * u)).tolist()))
    frames = vision.drawn(spark.createDataFrame(rows, "run_id long, frame long, xs array<double>, ys array<double>, thickness array<double>"), 128, 96)
    got = sorted(vision.braided_geometry(frames).collect(), key=lambda r: r.frame)
    assert [r.diameter_max_px for r in got] == pytest.approx([18, 29, 40], abs=2)
    assert got[0].length_axis_px > got[1].length_axis_px > got[2].length_axis_px
    assert all(r.x_peak_norm == pytest.approx(0.5, abs=0.15) and r.zone_symmetry > 0.85 for r in got)


def test_largest_component_is_kept_whole(spark):
    pixels = [(x, 5) for x in range(5, 30)] + [(30 + k, 6 + k) for k in range(9)] + [(60, y) for y in range(9)]
    df = spark.createDataFrame([(1, 1, x, y) for x, y in pixels], "run_id long, frame long, x int, y int")
    assert {(r.x, r.y) for r in vision.largest_component(df).collect()} == {(x, y) for x, y in pixels if x < 60}


@pytest.mark.parametrize("name", ["frame_geometry_wire", "frame_geometry_braided"])
def test_every_frame_has_geometry(spark, name):
    from thermoline.plans import catalog, virtual

    d = "/root/testdata/sf0.001"
    got = catalog.queries()[name](spark, d).select("run_id", "frame").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, virtual.progress(spark, d).select("run_id", "frame").collect()))


def test_drawn_pixels(spark):
    """Polylines of different lengths, some beyond the edge, against every pixel's distance to every span."""
    rng = np.random.default_rng(2)
    rows = [(1, k, *(rng.uniform(-8, 48, n).tolist() for _ in range(2)), rng.integers(0, 12, n).astype(float).tolist()) for k, n in enumerate((2, 9, 1, 30, 5))]
    rows.append((1, 9, [10.0, 20.0], [10.0, 10.0], [10.0, 10.0]))  # pixels lie on its border
    got = {r.frame: np.frombuffer(r.pixels, np.uint8).reshape(40, 50) for r in vision.drawn(spark.createDataFrame(rows, "run_id long, frame long, xs array<double>, ys array<double>, thickness array<double>"), 50, 40).collect()}
    gy, gx = np.mgrid[0:40, 0:50]
    for _, frame, x, y, t in rows:
        dark = np.zeros((40, 50), bool)
        for k in range(len(x) - 1):
            dx, dy, px, py = x[k + 1] - x[k], y[k + 1] - y[k], gx - x[k], gy - y[k]
            s = np.clip((px * dx + py * dy) / max(dx * dx + dy * dy, 1e-9), 0, 1)
            dark |= np.hypot(px - s * dx, py - s * dy) <= (t[k] + s * (t[k + 1] - t[k])) / 2
        assert (got[frame] == np.where(dark, 35, 236)).all(), frame


def test_frames_are_measured_where_they_are(spark):
    """A frame's slices are a row's own: none is shuffled, whatever their number."""
    frames = spark.createDataFrame([(1, 1, 2, 2, bytes(4))], "run_id long, frame long, height int, width int, pixels binary")
    for geometry_of in (vision.wire_geometry, vision.braided_geometry):
        plan = geometry_of(frames)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_profiles_as_arrays(spark):
    """The same as the aggregates over rows."""
    from thermoline.operators import geometry

    rng = np.random.default_rng(3)
    rows = [(k, [(float(s), float(w)) for s, w in zip(np.sort(rng.uniform(0, 50, n)), rng.integers(1, 9, n), strict=True)]) for k, n in enumerate((1, 2, 3, 7, 40, 41))]
    df = spark.createDataFrame(rows, "id long, body array<struct<s:double,w:double>>")
    got = {r.id: r for r in geometry.array_profile(df, "body", "s", "w").collect()}
    flat = df.select("id", F.inline("body"))
    for part in (geometry.trapezoid_area(flat, ["id"], "s", "w").withColumnRenamed("area", "area_proj_px2"), geometry.window_width_stats(flat, ["id"], "s", "w"), geometry.zone_metrics(flat, ["id"], "s", "w")):
        for want in part.collect():
            for c in part.columns:
                assert got[want.id][c] == pytest.approx(want[c]), (want.id, c)


def test_largest_components_of_stacked_frames():
    y, x, of = (np.array(c) for c in ([0, 0, 1, 5, 8, 8, 9], [0, 1, 5, 9, 0, 4, 4], [0, 0, 0, 0, 1, 1, 1]))
    assert vision._in_largest(y, x, of).tolist() == [True, True, False, False, False, True, True]


POINTS, PIXELS = "run_id long, frame long, xs array<double>, ys array<double>, thickness array<double>", "run_id long, frame long, height int, width int, pixels binary"


def odd_lines():
    """Upright and level spans, cones, points that coincide, and joints that are wider than both neighbours; many pixels lie on borders."""
    rng = np.random.default_rng(4)
    lines = []
    for k in range(60):
        n = int(rng.integers(1, 12))
        whole, half = lambda least, most: rng.integers(least, most, n).astype(float), lambda most: rng.integers(0, most, n) / 2
        lines.append([(np.full(n, 7.0 + k % 20), whole(0, 40), whole(0, 9)), (half(90), np.full(n, 20.0), half(30)), (whole(-8, 60), whole(-8, 60), whole(-3, 20)), (20 + 1e-3 * whole(0, 3), 20 + 1e-5 * whole(0, 3), whole(0, 30)), (half(90), half(70), np.full(n, 5.0)), (np.arange(n) * 4.0, np.full(n, 20.0), 2 + 9 * np.sin(np.arange(n)))][k % 6])
    return [(1, k, *(v.tolist() for v in line)) for k, line in enumerate(lines)]


def test_odd_lines_are_drawn_by_their_distances(spark):
    rows = odd_lines()
    got = {r.frame: np.frombuffer(r.pixels, np.uint8).reshape(40, 50) for r in vision.drawn(spark.createDataFrame(rows, POINTS), 50, 40).collect()}
    gy, gx = np.mgrid[0:40, 0:50]
    for _, frame, x, y, t in rows:
        dark = np.zeros((40, 50), bool)
        for k in range(len(x) - 1):
            dx, dy, px, py = x[k + 1] - x[k], y[k + 1] - y[k], gx - x[k], gy - y[k]
            s = np.clip((px * dx + py * dy) / max(dx * dx + dy * dy, 1e-9), 0, 1)
            dark |= np.hypot(px - s * dx, py - s * dy) <= (t[k] + s * (t[k + 1] - t[k])) / 2
        assert (got[frame] == np.where(dark, 35, 236)).all(), frame


def test_frames_are_measured_by_the_worker_that_draws_them(spark):
    """As frames that were drawn before; no pixel leaves a worker and no row's slices are walked one by one outside of it."""
    points = spark.createDataFrame(odd_lines(), POINTS)
    for sums, measures in ((None, None), (vision.LINE, vision.wire_measures), (vision.BODY, vision.braided_measures)):
        at_once = vision.drawn_objects(points, 50, 40, sums=sums)
        assert sorted(map(str, at_once.collect())) == sorted(map(str, vision.objects(vision.drawn(points, 50, 40), sums=sums).collect()))
        if measures:
            plan = measures(at_once)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("MapInArrow") == 1 and "pixels" not in plan and "lambda" not in plan


def test_braided_frames_need_one_worker_step(spark):
    from thermoline.plans import catalog

    plan = catalog.queries()["frame_geometry_braided"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "pixels" not in plan


def test_slices_against_pixels(spark):
    """Means, widths and counts of each slice from all of its pixels, of a tilted and an upright object."""
    gy, gx = np.mgrid[0:60, 0:70]
    shapes = [np.abs((gx - 30) * 0.4 - (gy - 25)) + np.abs(gx - 30) * 0.1 < 6, (np.abs(gx - 20) < 4) & (gy > 5) & (gy < 55), (gx + gy) % 7 < 3]
    frames = [(1, k, 60, 70, bytes(np.where(dark, 35, 236).astype(np.uint8).tobytes())) for k, dark in enumerate(shapes)]
    for row in vision.objects(spark.createDataFrame(frames, PIXELS), step=1.5).collect():
        y, x = (c.astype(float) for c in np.nonzero(shapes[row.frame]))
        inside = vision._in_largest(y.astype(int), x.astype(int))
        y, x = y[inside], x[inside]
        dx, dy = x - x.mean(), y - y.mean()
        theta = 0.5 * np.arctan2(2 * (dx * dy).mean(), (dx * dx).mean() - (dy * dy).mean())
        s, t = dx * np.cos(theta) + dy * np.sin(theta), dy * np.cos(theta) - dx * np.sin(theta)
        bins = np.floor(s / 1.5)
        assert row.area_px2 == len(x) and [p.bin for p in row.slices] == sorted(set(bins))
        for p in row.slices:
            own = bins == p.bin
            assert (p.x, p.y, p.s, p.t, p.width_px, p.n) == pytest.approx((x[own].mean(), y[own].mean(), s[own].mean(), t[own].mean(), np.ptp(t[own]) + 1, own.sum()), abs=1e-9)


def test_first_of_equal_components_is_by_line(spark):
    gray = np.full((30, 30), 236, np.uint8)
    gray[20:27, 2:8], gray[4:10, 15:22] = 35, 35
    frame = spark.createDataFrame([(1, 1, 30, 30, gray.tobytes())], PIXELS)
    found = vision.objects(frame).first()
    assert found.area_px2 == 42 and {p.y for p in found.slices} == {6.5}


def test_wire_frames_need_one_worker_step(spark):
    """Nor are a needle's points made of ever longer arrays."""
    from thermoline.plans import catalog

    plan = catalog.queries()["frame_geometry_wire"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "pixels" not in plan and "aggregate(" not in plan


def test_lines_by_steps(spark):
    steps = [[3.0, 2.0, -1.0], [0.5], [], [4.0] * 9]
    frames = {}
    for start in (None, (12.0, 10.0)):
        walk = lambda v, at: v if start else [at + sum(v[: k + 1]) for k in range(len(v))]  # noqa: B023, E731
        rows = [(1, k, walk(v, 12.0), walk([c / 2 for c in v], 10.0), [3.0] * len(v)) for k, v in enumerate(steps)]
        frames[start] = sorted(map(str, vision.drawn(spark.createDataFrame(rows, POINTS), 50, 40, start=start).collect()))
    assert frames[None] == frames[12.0, 10.0] and len(frames[None]) == 4
