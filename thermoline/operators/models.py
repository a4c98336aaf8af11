"""What curve a centerline is: how far along it bends, and whether a parabola or a circle fits it.

All is windows and sums over the points of a frame, which lie together once they are dealt by
run and frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermoline.functions.scalar import distance
from thermoline.operators.ordered import RUN

FRAME = [RUN, "frame"]


# How a centerline is sampled and how its model is chosen.
@dataclass(frozen=True)
class Choice:
    step: float = 3.0
    least_arc: float = 10.0
    fit_arc: float = 30.0
    part: float = 0.72
    least_part: float = 0.42
    curvature_part: float = 0.28
    far: float = 2.5
    prefer_quadratic: float = 0.05
    full_points: int = 16
    fit_points: int = 10


def _of_frame() -> Window:
    return Window.partitionBy(*FRAME)


def spaced(points: DataFrame, total: str, least: int, step: float) -> DataFrame:
    """Each path at evenly spaced places from 0 to `total` along `arc`: rows of (run, frame, place, at, u, v, gap).

    There are as many places as make the gap between them at most `step`, and `least` of them.
    """
    w = Window.partitionBy(*FRAME).orderBy("place")
    n = F.greatest(F.ceil(F.col(total) / step) + 1, F.lit(least)).cast("long")
    ahead = points.select(*FRAME, "arc", "u", "v", F.col(total).alias("total"), n.alias("n"), *(F.lead(c).over(w).alias(f"{c}_to") for c in ("arc", "u", "v")))
    ahead = ahead.where("arc_to > arc AND arc <= total").withColumn("gap", F.col("total") / (F.col("n") - 1))
    # The last place is the end itself, which lies in the span that reaches it.
    first = F.ceil(F.col("arc") / F.col("gap"))
    last = F.when(F.col("arc_to") >= F.col("total"), F.col("n") - 1).otherwise(F.least(F.ceil(F.col("arc_to") / F.col("gap")) - 1, F.col("n") - 2))
    inside = ahead.withColumn("place", F.explode(F.when(first <= last, F.sequence(first, last))))
    at = F.when(F.col("place") == F.col("n") - 1, F.col("total")).otherwise(F.col("place") * F.col("gap"))
    share = (F.col("at") - F.col("arc")) / (F.col("arc_to") - F.col("arc"))
    return inside.withColumn("at", at).select(*FRAME, "place", "at", "gap", "n", *((F.col(c) + (F.col(f"{c}_to") - F.col(c)) * share).alias(c) for c in ("u", "v")))


def gradient(c: str, w: Window, gap: str = "gap") -> Column:
    """Of evenly spaced values; one-sided at both ends."""
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return F.coalesce((after - before) / (2.0 * F.col(gap)), (after - F.col(c)) / F.col(gap), (F.col(c) - before) / F.col(gap))


def bent_arc(path: DataFrame, config: Choice = Choice()) -> DataFrame:
    """How far along each evenly spaced path its fit should reach: two places beyond the last whose smoothed curvature is a part of the largest."""
    w = Window.partitionBy(*FRAME).orderBy("place")
    rows = path.withColumns({"du": gradient("u", w), "dv": gradient("v", w)})
    rows = rows.withColumns({"ddu": gradient("du", w), "ddv": gradient("dv", w)})
    speed = F.col("du") * F.col("du") + F.col("dv") * F.col("dv")
    rows = rows.withColumn("curvature", F.abs(F.col("du") * F.col("ddv") - F.col("dv") * F.col("ddu")) / F.greatest(speed * F.sqrt(speed), F.lit(1e-9)))
    rows = rows.withColumn("curvature", F.sum("curvature").over(w.rowsBetween(-3, 3)) / 7.0)
    rows = rows.withColumn("most", F.max("curvature").over(_of_frame()))
    got = rows.groupBy(*FRAME).agg(F.max("most").alias("most"), F.max("at").alias("total"), F.max("n").alias("n"), F.max("gap").alias("gap"), F.max(F.when(F.col("curvature") >= config.curvature_part * F.col("most"), F.col("place"))).alias("last"))
    reach = F.least(F.col("last") + 2, F.col("n") - 1)
    adaptive = F.when(F.col("most") > 1e-9, F.when(reach == F.col("n") - 1, F.col("total")).otherwise(reach * F.col("gap"))).otherwise(config.part * F.col("total"))
    arc = F.least(F.greatest(adaptive, config.least_part * F.col("total")), config.part * F.col("total"))
    return got.select(*FRAME, F.least(F.greatest(arc, F.lit(config.fit_arc)), F.col("total")).alias("fit_arc"))


def _parabola(rows: DataFrame, which: Column, name: str) -> DataFrame:
    """With the coefficients of u = a y**2 + b y + c, y being v less its mean, over the rows of each frame for which `which` holds."""
    w = _of_frame()
    mean = lambda c: F.avg(F.when(which, c)).over(w)
    rows = rows.withColumn(f"{name}_v", mean(F.col("v"))).withColumn("y", F.col("v") - F.col(f"{name}_v"))
    y, u = F.col("y"), F.col("u")
    rows = rows.withColumns({"m2": mean(y * y), "m3": mean(y * y * y), "m4": mean(y * y * y * y), "p0": mean(u), "p1": mean(u * y), "p2": mean(u * y * y)})
    det = F.col("m2") * F.col("m4") - F.col("m3") * F.col("m3") - F.col("m2") * F.col("m2") * F.col("m2")
    a = (F.col("m2") * F.col("p2") - F.col("m3") * F.col("p1") - F.col("m2") * F.col("m2") * F.col("p0")) / F.when(F.abs(det) > 1e-12, det)
    rows = rows.withColumn(f"{name}_a", a).withColumn(f"{name}_b", (F.col("p1") - F.col(f"{name}_a") * F.col("m3")) / F.when(F.col("m2") > 0, F.col("m2")))
    rows = rows.withColumn(f"{name}_off", F.col("u") - (F.col(f"{name}_a") * (y * y - F.col("m2")) + F.col(f"{name}_b") * y + F.col("p0")))
    return rows.drop("y", "m2", "m3", "m4", "p0", "p1", "p2")


def _circle(rows: DataFrame) -> DataFrame:
    """With each point's distance to the circle of least algebraic squares through its frame's points; NULL where they lie on a line."""
    w = _of_frame()
    rows = rows.withColumns({"x": F.col("u") - F.avg("u").over(w), "y": F.col("v") - F.avg("v").over(w)})
    x, y = F.col("x"), F.col("y")
    square = x * x + y * y
    rows = rows.withColumns({"xx": F.avg(x * x).over(w), "yy": F.avg(y * y).over(w), "xy": F.avg(x * y).over(w), "xs": F.avg(x * square).over(w) / 2.0, "ys": F.avg(y * square).over(w) / 2.0})
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    det = F.when(det > 1e-9 * (F.col("xx") + F.col("yy")) * (F.col("xx") + F.col("yy")), det)
    rows = rows.withColumns({"cx": (F.col("xs") * F.col("yy") - F.col("ys") * F.col("xy")) / det, "cy": (F.col("ys") * F.col("xx") - F.col("xs") * F.col("xy")) / det})
    rows = rows.withColumn("radius", F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy") + F.col("xx") + F.col("yy")))
    return rows.withColumn("circle_off", distance(x, y, F.col("cx"), F.col("cy")) - F.col("radius")).drop("x", "y", "xx", "yy", "xy", "xs", "ys", "cx", "cy")


def chosen_models(points: DataFrame, config: Choice = Choice()) -> DataFrame:
    """One row a frame of points (run, frame, place, u, v), u across and v along the line: the model that fits it, its curvature and errors.

    A parabola is taken unless a circle's error is smaller by more than the margin. Frames without
    points, or with a path that is too short, have NULLs, quality 0 and model `failed`.
    """
    w = Window.partitionBy(*FRAME).orderBy("place")
    path = points.where("u IS NOT NULL AND v IS NOT NULL")
    step = F.coalesce(distance(F.lag("u").over(w), F.lag("v").over(w), F.col("u"), F.col("v")), F.lit(0.0)).cast("decimal(30,9)")
    path = path.withColumn("step", step).withColumn("arc", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double"))
    path = path.withColumn("total", F.max("arc").over(_of_frame())).where(F.col("total") >= config.least_arc).select(*FRAME, "place", "u", "v", "arc", "total")
    reach = bent_arc(spaced(path, "total", config.full_points, config.step), config)
    line = spaced(path.join(reach, FRAME), "fit_arc", config.fit_points, config.step).drop("gap", "n")
    line = _parabola(line, F.lit(True), "first")
    near = F.abs("first_off") <= config.far
    line = line.withColumn("reached", F.max("at").over(_of_frame())).withColumn("near", near).withColumn("enough", F.count(F.when(near, 1)).over(_of_frame()) >= 6).where("near OR NOT enough")
    line = _circle(_parabola(line, F.lit(True), "quadratic"))
    ends = {"least_v": F.min("v"), "most_v": F.max("v"), "reached": F.max("reached"), "n": F.count(F.lit(1)), "a": F.max("quadratic_a"), "b": F.max("quadratic_b"), "mean_v": F.max("quadratic_v"), "radius": F.max("radius")}
    errors = {f"{m}_rmse_px": F.sqrt(F.avg(F.col(f"{m}_off") * F.col(f"{m}_off"))) for m in ("quadratic", "circle")}
    got = line.groupBy(*FRAME).agg(*(x.alias(c) for c, x in (ends | errors).items()))
    slope = "(2 * a * (least_v + (most_v - least_v) * k / 119 - mean_v) + b)"
    bend = F.expr(f"aggregate(sequence(0, 119), 0D, (s, k) -> s + abs(2 * a) / pow(1 + {slope} * {slope}, 1.5D)) / 120")
    quadratic = F.col("circle_rmse_px").isNull() | (F.col("quadratic_rmse_px") <= F.col("circle_rmse_px") * (1.0 + config.prefer_quadratic))
    got = got.where("quadratic_rmse_px IS NOT NULL").withColumn("model_name", F.when(quadratic, "quadratic").otherwise("circle"))
    rmse = F.when(quadratic, F.col("quadratic_rmse_px")).otherwise(F.col("circle_rmse_px"))
    cover = F.least(F.col("n") * config.step / F.greatest(F.col("most_v") - F.col("least_v"), F.lit(1.0)), F.lit(1.0))
    got = got.select(*FRAME, "model_name", F.when(quadratic, bend).otherwise(1.0 / F.col("radius")).alias("kappa_fit_px_inv"), "quadratic_rmse_px", "circle_rmse_px", F.col("reached").alias("fit_arc_px"), F.col("n").alias("fit_points"), (F.exp(-rmse / 4.0) * cover).alias("quality"))
    out = points.select(*FRAME).distinct().join(got, FRAME, "left")
    return out.withColumns({"model_name": F.coalesce("model_name", F.lit("failed")), "quality": F.coalesce("quality", F.lit(0.0))})
