"""Queries over drawn frames and tracked regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoline.operators import vision
from thermoline.operators.dealing import dealt
from thermoline.plans import virtual
from thermoline.plans.series_queries import PROGRESS, R6, WIRE, sql
from thermoline.streaming import monitor, tracking

TABLE: dict[str, tuple[object, str | None]] = {}
WIDTH, HEIGHT = 128, 96
WIRE_START = (12.0, 10.0)


def query(name: str, oracle: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        TABLE[name] = (f, sql(oracle) if oracle else None)
        return f

    return add


def _spread(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Frames take a task's time long before they fill its memory."""
    return dealt(rows, *vision.FRAME, rows=virtual.events(spark, d).count(), width=10)


def wire_lines(spark: SparkSession, d: str) -> DataFrame:
    """A needle that straightens as the run goes on, for each of its frames, as steps from WIRE_START."""
    rows = _spread(virtual.wire_series(spark, d).select("run_id", "frame", "q"), spark, d).withColumn("bend", 0.02 * (1.0 - F.col("q")))
    steps = lambda trig: F.transform(F.sequence(F.lit(0), F.lit(30)), lambda j: 3.0 * trig(F.lit(0.1) + F.col("bend") * 3.0 * j))
    return rows.select("run_id", "frame", steps(F.cos).alias("xs"), steps(F.sin).alias("ys"), F.array_repeat(F.lit(4.0), 31).alias("thickness"))


def braided_lines(spark: SparkSession, d: str) -> DataFrame:
    """A braid that shortens and widens as the run goes on, for each of its frames."""
    rows = _spread(virtual.braided_series(spark, d).select("run_id", "frame", "q"), spark, d)
    length, top = 100.0 - 30.0 * F.col("q"), 14.0 + 22.0 * F.col("q")
    at = F.sequence(F.lit(0), F.lit(24))
    xs = F.transform(at, lambda i: 64.0 + (i / 24.0 - 0.5) * F.col("len"))
    rows = rows.select("run_id", "frame", length.alias("len"), top.alias("top"))
    return rows.select("run_id", "frame", xs.alias("xs"), F.array_repeat(F.lit(48.0), 25).alias("ys"), F.transform(at, lambda i: 4.0 + F.col("top") * F.sin(3.141592653589793 * i / 24.0)).alias("thickness"))


@query("frame_geometry_wire")
def frame_geometry_wire(spark: SparkSession, d: str) -> DataFrame:
    return vision.wire_measures(vision.drawn_objects(wire_lines(spark, d), WIDTH, HEIGHT, start=WIRE_START, sums=vision.LINE)).drop("x_fit_px")


@query("frame_geometry_braided")
def frame_geometry_braided(spark: SparkSession, d: str) -> DataFrame:
    return vision.braided_measures(vision.drawn_objects(braided_lines(spark, d), WIDTH, HEIGHT, sums=vision.BODY))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    s = virtual.wire_series(spark, d)
    whole = lambda c: F.floor(c).cast("int")
    return s.select("run_id", "frame", whole(F.col("anchor_x")).alias("x0"), whole(F.col("anchor_y")).alias("y0"), whole(F.col("tip_x")).alias("x1"), whole(F.col("tip_y") + 40.0).alias("y1"))


@query("tracked_roi", "WITH " + WIRE + """,
bx AS (SELECT run_id, frame, CAST(floor(anchor_x) AS INT) AS x0, CAST(floor(anchor_y) AS INT) AS y0, CAST(floor(tip_x) AS INT) AS x1, CAST(floor(tip_y + 40.0) AS INT) AS y1 FROM wire),
lg AS (SELECT run_id, frame, lag(x0) OVER w AS x0, lag(y0) OVER w AS y0, lag(x1) OVER w AS x1, lag(y1) OVER w AS y1 FROM bx WINDOW w AS (PARTITION BY run_id ORDER BY frame)),
ro AS (SELECT run_id, frame, CASE WHEN x0 IS NULL THEN 0 ELSE greatest(0, CAST(floor(x0 - (x1 - x0) * 0.25) AS INT)) END AS roi_x0, CASE WHEN x0 IS NULL THEN 0 ELSE greatest(0, CAST(floor(y0 - (y1 - y0) * 0.25) AS INT)) END AS roi_y0,
  CASE WHEN x0 IS NULL THEN 160 ELSE least(160, CAST(ceil(x1 + (x1 - x0) * 0.25) AS INT)) END AS roi_x1, CASE WHEN x0 IS NULL THEN 120 ELSE least(120, CAST(ceil(y1 + (y1 - y0) * 0.25) AS INT)) END AS roi_y1 FROM lg)
SELECT *, roi_x0 = 0 AND roi_y0 = 0 AND roi_x1 = 160 AND roi_y1 = 120 AS is_reset FROM ro""")
def tracked_roi(spark: SparkSession, d: str) -> DataFrame:
    return tracking.tracked(boxes(spark, d), 160, 120)


@query("monitor_windows", "SELECT user_id AS run_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS rows, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS mean, round(CAST(max(CAST(value AS DECIMAL(18,4))) - min(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 6) AS range FROM events GROUP BY 1, 2")
def monitor_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = virtual.events(spark, d).select(F.col("user_id").alias("run_id"), "ts", F.col("value").cast("decimal(18,4)").alias("value"))
    got = monitor.windowed(rows, "ts", "value", "1 hour")
    return got.select("run_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "rows", R6(F.col("mean").cast("double")).alias("mean"), R6(F.col("range").cast("double")).alias("range"))


@query("expanded_roi", "WITH " + PROGRESS + " SELECT run_id, frame, greatest(0, CAST(floor(k - 30 * 0.2) AS INT)) AS x0, greatest(0, CAST(floor(5 - 40 * 0.2) AS INT)) AS y0, least(120, CAST(ceil(k + 30 + 30 * 0.2) AS INT)) AS x1, least(90, CAST(ceil(45 + 40 * 0.2) AS INT)) AS y1 FROM prog")
def expanded_roi(spark: SparkSession, d: str) -> DataFrame:
    from thermoline.functions.scalar import expand_roi

    p = virtual.progress(spark, d)
    roi = F.struct(F.col("k").alias("x0"), F.lit(5).alias("y0"), (F.col("k") + 30).alias("x1"), F.lit(45).alias("y1"))
    return p.withColumn("roi", roi).withColumn("out", expand_roi(F.col("roi"), 0.2, 120, 90)).select("run_id", "frame", "out.*")


@query("analyze_wire")
def analyze_wire(spark: SparkSession, d: str) -> DataFrame:
    from thermoline.operators import routes
    from thermoline.plans import analysis

    s = virtual.wire_series(spark, d).drop("kappa_route_c_px_inv", "x_route_a_recovery", "x_fit_recovery", "kappa_fit_recovery", "kappa_route_c_recovery")
    log = virtual.progress(spark, d).select("run_id", "frame", "temperature_c")
    return routes.flattened(analysis.analyze_wire(s, log).route_results)


@query("analyze_braided")
def analyze_braided(spark: SparkSession, d: str) -> DataFrame:
    from thermoline.plans import analysis

    s = virtual.braided_series(spark, d).drop("length_axis_recovery", "diameter_max_recovery", "area_proj_recovery")
    log = virtual.progress(spark, d).select("run_id", "time_sec", "temperature_c")
    return analysis.analyze_braided(s, log, by="time").object_result


@query("wire_benchmark")
def wire_benchmark(spark: SparkSession, d: str) -> DataFrame:
    from thermoline.plans import analysis

    return analysis.wire_benchmark(spark)
