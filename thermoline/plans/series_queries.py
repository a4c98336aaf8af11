"""Queries over measurement runs, and the same in DuckDB SQL."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoline.functions import scalar
from thermoline.operators import align, fit, gates, geometry, ordered, qc, routes, temporal
from thermoline.operators.dealing import dealt
from thermoline.operators.ordered import in_frames
from thermoline.plans import virtual
from thermoline.sources import files
from thermoline.sources.staging import shared_folder, stored

R6 = lambda c: F.round(c, 6)


def single(c) -> F.Column:  # noqa: ANN001
    """In single precision: values of few decimals lie on no border of its rounding, as they do of decimal places."""
    return (F.col(c) if isinstance(c, str) else c).cast("float").cast("double")


def single_sql(c: str) -> str:
    return f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"

PROGRESS = """
ev AS (SELECT user_id AS run_id, ts, event_id, event_type, CAST(value AS DECIMAL(18,4)) AS v, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
pr0 AS (SELECT run_id, event_type, k, row_number() OVER w - 1 AS frame, count(*) OVER (PARTITION BY run_id) AS n,
        CAST(sum(v) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum, CAST(sum(v) OVER (PARTITION BY run_id) AS DOUBLE) AS total
        FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)),
prog AS (SELECT run_id, frame, n, event_type, k, frame / 20.0 AS time_sec, 20.0 + 45.0 * frame / greatest(n - 1, 1) AS temperature_c, round(cum / total, 9) AS p FROM pr0)
"""
WIRE = PROGRESS + """,
wq AS (SELECT *, least(1.0, p * CASE WHEN run_id % 3 = 0 THEN 0.85 ELSE 1.15 END) AS q, event_type <> 'error' AS ok FROM prog),
wire AS (SELECT run_id, frame, time_sec, temperature_c, k, p, q,
  CASE WHEN ok THEN 10.0 + (k % 7) * 0.25 END AS route_a_anchor_x, CASE WHEN ok THEN 15.0 END AS route_a_anchor_y,
  CASE WHEN ok THEN 10.0 + (55.0 + 45.0 * q) + CASE WHEN run_id % 5 = 1 AND k % 40 = 7 THEN 30.0 ELSE 0.0 END END AS route_a_tip_x, CASE WHEN ok THEN 15.0 + (k % 5) * 0.5 END AS route_a_tip_y,
  CASE WHEN ok THEN 55.0 + 45.0 * q END AS x_route_a_px, CASE WHEN ok THEN 11.0 + (k % 3) * 0.5 END AS anchor_x, CASE WHEN ok THEN 15.0 + (k % 2) * 0.5 END AS anchor_y,
  CASE WHEN ok THEN 9.0 + (55.0 + 45.0 * q) END AS tip_x, CASE WHEN ok THEN 14.0 + (k % 4) * 0.5 END AS tip_y,
  CASE WHEN ok THEN 50.0 + 40.0 * q + (k % 3) * 0.2 END AS x_fit_px, CASE WHEN ok THEN 0.08 - 0.07 * q + (k % 4) * 0.0005 END AS kappa_fit_px_inv,
  CASE WHEN ok THEN 0.08 - 0.07 * q + CASE WHEN run_id % 11 = 2 THEN 0.05 ELSE 0.0002 END END AS kappa_route_c_px_inv,
  CASE WHEN ok THEN CASE WHEN run_id % 7 = 0 THEN 0.02 ELSE 0.05 END + (k % 10) * CASE WHEN run_id % 7 = 0 THEN 0.01 ELSE 0.1 END END AS quality,
  CASE WHEN ok THEN q END AS x_route_a_recovery, CASE WHEN ok THEN q END AS x_fit_recovery, CASE WHEN ok THEN q END AS kappa_fit_recovery, CASE WHEN ok THEN q END AS kappa_route_c_recovery,
  CASE WHEN ok THEN CAST(100 + k AS DOUBLE) END AS centerline_points, CASE WHEN NOT ok THEN 'failed' WHEN k % 3 = 0 THEN 'circle' ELSE 'quadratic' END AS model_name FROM wq)
"""
BRAIDED = PROGRESS + """,
bq AS (SELECT *, least(1.0, p * CASE WHEN run_id % 4 = 0 THEN 0.85 ELSE 1.15 END) AS q, event_type <> 'error' AS ok FROM prog),
b0 AS (SELECT run_id, frame, temperature_c, k, q, CASE WHEN ok THEN 120.0 - 30.0 * q END AS length_axis_px,
  CASE WHEN ok THEN (k % 10) * CASE WHEN run_id % 9 = 1 THEN 3.0 ELSE 0.5 END END AS length_axis_disagreement_px, CASE WHEN ok THEN 20.0 + 20.0 * q + (k % 3) * 0.1 END AS diameter_max_px,
  CASE WHEN ok THEN 500.0 + 220.0 * q END AS area_proj_px2, CASE WHEN ok THEN (k % 20) * CASE WHEN run_id % 8 = 3 THEN 9.0 ELSE 2.0 END END AS area_proj_definition_gap_px2,
  CASE WHEN ok THEN 10.0 + (k % 3) * 0.5 END AS anchor_x, CASE WHEN ok THEN 20.0 + (k % 2) * 0.5 END AS anchor_y, CASE WHEN ok THEN 10.0 + (120.0 - 30.0 * q) END AS tip_x,
  CASE WHEN ok THEN 20.0 + (k % 5) * CASE WHEN run_id % 10 = 3 THEN 4.0 ELSE 0.5 END END AS tip_y, CASE WHEN ok THEN (k % 8) * CASE WHEN run_id % 13 = 5 THEN 3.0 ELSE 0.5 END END AS gap_px,
  CASE WHEN ok THEN 0.5 + (k % 6) * 0.01 END AS peak_norm, CASE WHEN ok THEN (k % 4) * 0.01 END AS peak_stability,
  CASE WHEN ok THEN 0.5 + (k % 10) * CASE WHEN run_id % 6 = 1 THEN -0.05 ELSE 0.04 END END AS quality, CASE WHEN ok THEN (k % 10) * CASE WHEN run_id % 12 = 2 THEN 0.01 ELSE 0.002 END END AS leak,
  CASE WHEN ok THEN (k % 10) * 8.0 END AS excluded, CASE WHEN ok THEN 1000.0 END AS component, CASE WHEN ok THEN 700.0 + (k % 10) * 10.0 END AS body,
  CASE WHEN ok THEN CAST(k % 3 AS DOUBLE) END AS branches, CASE WHEN ok THEN CAST(k % 2 AS DOUBLE) END AS touches, CASE WHEN ok THEN q END AS recovery FROM bq),
b1 AS (SELECT *, sqrt((anchor_x - lag(anchor_x) OVER w) ** 2 + (anchor_y - lag(anchor_y) OVER w) ** 2) AS a_jump, sqrt((tip_x - lag(tip_x) OVER w) ** 2 + (tip_y - lag(tip_y) OVER w) ** 2) AS t_jump,
  abs(peak_norm - lag(peak_norm) OVER w) AS peak_step FROM b0 WINDOW w AS (PARTITION BY run_id ORDER BY frame)),
braided AS (SELECT *, length_axis_disagreement_px / greatest(length_axis_px, 0.000000001) AS disagreement, greatest(a_jump, t_jump) AS frame_px, gap_px / greatest(length_axis_px, 0.000000001) AS gap_fraction,
  greatest(a_jump, t_jump) / CASE WHEN length_axis_px IS NOT NULL THEN greatest(length_axis_px, 0.000000001) END AS frame_fraction, greatest(peak_stability, peak_step) AS stability FROM b1)
"""


def sql(text: str) -> str:
    """Decimal literals as doubles."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", text)


def _median_sql(c: str, half: int) -> str:
    return f"quantile_cont({c}, 0.5) OVER (PARTITION BY run_id ORDER BY {{order}} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"


def rolling_sql(c: str, order: str, window: int) -> str:
    """A rolling median whose window fits the n rows of a run."""
    cases = " ".join(f"WHEN n < {2 * h + 3} THEN {_median_sql(c, h)}" for h in range(1, window // 2))
    return f"CASE WHEN n < 3 THEN {c} {cases} ELSE {_median_sql(c, window // 2)} END".format(order=order)


def violation_sql(source: str, c: str, up: str, window: int, floor: str, part: str, least: str, name: str) -> str:
    return f"""
{name}_v AS (SELECT run_id, frame, temperature_c, {c} AS v, {up} AS up, count(*) OVER (PARTITION BY run_id) AS n FROM {source} WHERE {c} IS NOT NULL AND temperature_c IS NOT NULL),
{name}_s AS (SELECT *, {rolling_sql("v", "temperature_c, frame", window)} AS smooth FROM {name}_v),
{name}_d AS (SELECT *, smooth - lag(smooth) OVER (PARTITION BY run_id ORDER BY temperature_c, frame) AS step, max(smooth) OVER (PARTITION BY run_id) - min(smooth) OVER (PARTITION BY run_id) AS rng FROM {name}_s),
{name} AS (SELECT run_id, CASE WHEN max(n) >= 4 THEN avg(CASE WHEN step IS NULL THEN NULL WHEN (up AND step < -greatest({floor}, {part} * greatest(rng, {least}))) OR (NOT up AND step > greatest({floor}, {part} * greatest(rng, {least}))) THEN 1.0 ELSE 0.0 END) END AS violation FROM {name}_d GROUP BY run_id)"""


def wire_violation_sql(source: str, c: str, name: str, up: str = "false") -> str:
    return violation_sql(source, c, up, 7, "0.0001", "0.01", "0.000001", name)


def braided_violation_sql(source: str, c: str, name: str, up: str = "false") -> str:
    return violation_sql(source, c, up, 9, "0.5", "0.005", "0.0", name)


def tail_sql(source: str, c: str, order: str, name: str) -> str:
    back = ", ".join(f"{x} DESC" for x in order.split(", "))
    return f"""
{name}_t AS (SELECT run_id, {c} AS v, row_number() OVER (PARTITION BY run_id ORDER BY {back}) AS back, count(*) OVER (PARTITION BY run_id) AS n FROM {source} WHERE {c} IS NOT NULL),
{name} AS (SELECT run_id, median(v) AS tail_median FROM {name}_t WHERE back <= greatest(5, ceil(n * 0.1)) GROUP BY run_id)"""


def jumps_sql(source: str, x: str, y: str, name: str) -> str:
    return f"""
{name}_j AS (SELECT run_id, sqrt(({x} - lag({x}) OVER w) ** 2 + ({y} - lag({y}) OVER w) ** 2) AS jump FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY frame)),
{name} AS (SELECT run_id, max(jump) AS jump_max, quantile_cont(jump, 0.95) AS jump_p95 FROM {name}_j GROUP BY run_id)"""


def report_sql(source: str, metrics: dict[str, tuple[str, bool]], rename: dict[str, str] | None = None) -> str:
    rename = rename or {}
    union = " UNION ALL ".join(f"SELECT run_id, frame, temperature_c, '{m}' AS metric_key, {str(up).lower()} AS increasing, {rename.get(c, c)} AS value FROM {source}" for m, (c, up) in metrics.items())
    return f"""
lm0 AS ({union}),
lm1 AS (SELECT *, value - lag(value) OVER (PARTITION BY run_id, metric_key ORDER BY temperature_c, frame) AS step, (value - min(value) OVER g) / greatest(max(value) OVER g - min(value) OVER g, 0.000000001) AS share,
  CASE WHEN increasing THEN (temperature_c - 20.0) / 45.0 ELSE 1.0 - (temperature_c - 20.0) / 45.0 END AS line FROM lm0 WHERE value IS NOT NULL WINDOW g AS (PARTITION BY run_id, metric_key)),
report AS (SELECT run_id, metric_key, increasing, min(value) AS x_m, max(value) AS x_a, round(sqrt(avg((share - line) * (share - line))) * (max(value) - min(value)), 9) AS fit_rmse,
  coalesce(avg(CASE WHEN step IS NULL THEN NULL WHEN (increasing AND step < 0) OR (NOT increasing AND step > 0) THEN 1.0 ELSE 0.0 END), 0.0) AS monotonic_violation_fraction, round(max(value) - min(value), 9) AS dynamic_range,
  round(min(CASE WHEN share >= 0.95 THEN temperature_c END), 9) AS af95_c, round(max(temperature_c), 9) AS aftan_c FROM lm1 GROUP BY ALL HAVING count(*) >= 4)"""


Query = dict[str, tuple[object, str | None]]
TABLE: Query = {}


def query(name: str, oracle: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        TABLE[name] = (f, sql(oracle) if oracle else None)
        return f

    return add


AF95 = """
{name}_r AS (SELECT run_id, temperature_c AS t, r, row_number() OVER w AS nth, lag(r) OVER w AS r0, lag(temperature_c) OVER w AS t0 FROM {source} WHERE r IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY temperature_c, frame)),
{name} AS (SELECT run_id, arg_min(CASE WHEN nth = 1 THEN t ELSE t0 + (0.95 - r0) / greatest(r - r0, 0.000000001) * (t - t0) END, nth) FILTER (r >= 0.95) AS af95_c FROM {name}_r GROUP BY run_id)
"""
TAN = """
{name}_a AS (SELECT run_id, list(temperature_c ORDER BY temperature_c, frame) AS t, list(r ORDER BY temperature_c, frame) AS v, count(*)::INT AS n FROM {source} WHERE r IS NOT NULL GROUP BY run_id HAVING count(*) >= 7),
{name}_m AS (SELECT *, ((least(n - 1 + n % 2, 11) - 1) // 2)::INT AS m FROM {name}_a),
{name}_i AS (SELECT run_id, t, v, n, m, unnest(range(0, n)) AS i FROM {name}_m),
{name}_c AS (SELECT *, least(greatest(i, m), n - 1 - m) AS c FROM {name}_i),
{name}_w AS (SELECT *, i - c AS u, 2.0 * m + 1 AS kk, m * (m + 1.0) * (2 * m + 1) / 3 AS s2, m * (m + 1.0) * (2 * m + 1) * (3 * m * m + 3 * m - 1) / 15 AS s4 FROM {name}_c),
{name}_s AS (SELECT run_id, i, n, t[i + 1] AS temp, list_sum(list_transform(range(-m, m + 1), lambda j: v[c + j + 1] * ((s4 - s2 * j * j + (kk * j * j - s2) * u * u) / (kk * s4 - s2 * s2) + j * u / s2))) AS smooth FROM {name}_w),
{name}_d AS (SELECT *, smooth - lag(smooth) OVER w AS df, lead(smooth) OVER w - smooth AS dl, temp - lag(temp) OVER w AS hs, lead(temp) OVER w - temp AS hd FROM {name}_s WINDOW w AS (PARTITION BY run_id ORDER BY i)),
{name}_g AS (SELECT *, CASE WHEN hs IS NULL THEN dl / nullif(hd, 0) WHEN hd IS NULL THEN df / nullif(hs, 0) ELSE (hs * hs * dl + hd * hd * df) / nullif(hs * hd * (hd + hs), 0) END AS slope FROM {name}_d),
{name}_b AS (SELECT run_id, arg_max(struct_pack(temp := temp, smooth := smooth, slope := slope), struct_pack(s := round(slope, 10), place := -i)) FILTER (slope IS NOT NULL) AS best FROM {name}_g GROUP BY run_id),
{name}_u AS (SELECT run_id, median(smooth) AS upper FROM {name}_g WHERE i >= floor(0.85 * n) GROUP BY run_id),
{name} AS (SELECT r.run_id, CASE WHEN best.slope > 0.000000001 THEN best.temp + (upper - best.smooth) / best.slope END AS aftan_c FROM (SELECT DISTINCT run_id FROM {source}) r LEFT JOIN {name}_b USING (run_id) LEFT JOIN {name}_u USING (run_id))
"""


@query("recovery_af95_by_run", "WITH " + PROGRESS + ", rec AS (SELECT run_id, frame, temperature_c, greatest(0.0, least(1.0, (p - first_value(p) OVER w) / nullif(last_value(p) OVER w - first_value(p) OVER w, 0))) AS r FROM prog WINDOW w AS (PARTITION BY run_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))," + AF95.format(name="af", source="rec") + "SELECT run_id, round(af95_c, 6) AS af95_c FROM af")
def recovery_af95_by_run(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.first_last_recovery(virtual.progress(spark, d), "p", "r")
    return ordered.af_95(rows, "r").select("run_id", R6("af95_c").alias("af95_c"))


@query("af_tan_by_run", "WITH " + PROGRESS + ", rec AS (SELECT run_id, frame, temperature_c, p AS r FROM prog)," + TAN.format(name="tg", source="rec") + "SELECT run_id, round(aftan_c, 5) AS aftan_c FROM tg")
def af_tan_by_run(spark: SparkSession, d: str) -> DataFrame:
    return ordered.af_tan(virtual.progress(spark, d), "p").select("run_id", F.round("aftan_c", 5).alias("aftan_c"))


@query("savgol_gradient", "WITH " + PROGRESS + ", rec AS (SELECT run_id, frame, temperature_c, p AS r FROM prog)," + TAN.format(name="tg", source="rec") + "SELECT run_id, i AS place, round(smooth, 6) AS smooth, round(slope, 6) AS slope FROM tg_g")
def savgol_gradient(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.with_slope(ordered.smoothed(virtual.progress(spark, d), "p"))
    return rows.select("run_id", F.col("i").cast("long").alias("place"), R6("smooth").alias("smooth"), R6("slope").alias("slope"))


LOG = ", log AS (SELECT run_id, frame, time_sec, 20.0 + k * 0.5 AS temperature_c FROM prog WHERE event_type = 'signup')"


@query("temperature_join_frame", "WITH " + PROGRESS + LOG + " SELECT p.run_id, p.frame, round(l.temperature_c, 6) AS temperature_c FROM prog p LEFT JOIN log l USING (run_id, frame)")
def temperature_join_frame(spark: SparkSession, d: str) -> DataFrame:
    rows = virtual.progress(spark, d).select("run_id", "frame", "time_sec")
    return align.by_frame(rows, virtual.temperature_log(spark, d)).select("run_id", "frame", R6("temperature_c").alias("temperature_c"))


@query("temperature_interp", "WITH " + PROGRESS + LOG + """,
both_rows AS (SELECT run_id, frame, time_sec AS pos, NULL::DOUBLE AS knot, 1 AS is_row FROM prog UNION ALL SELECT run_id, NULL, time_sec + 0.025, temperature_c, 0 FROM log),
near AS (SELECT *, last_value(CASE WHEN is_row = 0 THEN pos END IGNORE NULLS) OVER b AS b_at, last_value(knot IGNORE NULLS) OVER b AS b_knot,
  first_value(CASE WHEN is_row = 0 THEN pos END IGNORE NULLS) OVER a AS a_at, first_value(knot IGNORE NULLS) OVER a AS a_knot FROM both_rows
  WINDOW b AS (PARTITION BY run_id ORDER BY pos, is_row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY run_id ORDER BY pos, is_row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT run_id, frame, round(CASE WHEN b_at = pos THEN b_knot ELSE b_knot + (a_knot - b_knot) * (pos - b_at) / (a_at - b_at) END, 6) AS temperature_c FROM near WHERE is_row = 1""")
def temperature_interp(spark: SparkSession, d: str) -> DataFrame:
    rows = virtual.progress(spark, d).select("run_id", "frame", "time_sec")
    return align.by_time(rows, virtual.temperature_log(spark, d), 0.025).select("run_id", "frame", R6("temperature_c").alias("temperature_c"))


@query("rolling_median_7", "WITH " + PROGRESS + f" SELECT run_id, frame, round({rolling_sql('k', 'frame', 7)}, 6) AS smooth FROM prog")
def rolling_median_7(spark: SparkSession, d: str) -> DataFrame:
    return virtual.progress(spark, d).select("run_id", "frame", R6(ordered.rolling_median("k", in_frames(), 7)).alias("smooth"))


@query("smoothed_af", "WITH " + WIRE + f", vs AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM wire WHERE kappa_fit_recovery IS NOT NULL), sm AS (SELECT run_id, frame, temperature_c, {rolling_sql('kappa_fit_recovery', 'frame', 7)} AS r FROM vs)," + AF95.format(name="af", source="sm") + "," + TAN.format(name="tg", source="sm") + "SELECT tg.run_id, round(af95_c, 6) AS af95_c, round(aftan_c, 5) AS aftan_c FROM tg LEFT JOIN af USING (run_id)")
def smoothed_af(spark: SparkSession, d: str) -> DataFrame:
    rows = virtual.wire_series(spark, d).where("kappa_fit_recovery IS NOT NULL").withColumn("r", ordered.rolling_median("kappa_fit_recovery", in_frames(), 7))
    return ordered.af_tan(rows, "r").join(ordered.af_95(rows, "r"), "run_id", "left").select("run_id", R6("af95_c").alias("af95_c"), F.round("aftan_c", 5).alias("aftan_c"))


def _raw_sql(c: str, sign: str, name: str) -> str:
    return f"{name}_r AS (SELECT run_id, {c} - lag({c}) OVER (PARTITION BY run_id ORDER BY temperature_c, frame) AS step FROM wire WHERE {c} IS NOT NULL), {name} AS (SELECT run_id, coalesce(avg(CASE WHEN step IS NULL THEN NULL WHEN step {sign} 0 THEN 1.0 ELSE 0.0 END), 0.0) AS violation FROM {name}_r GROUP BY run_id)"


@query("monotonic_violation", "WITH " + WIRE + "," + _raw_sql("x_fit_px", "<", "a") + "," + _raw_sql("kappa_fit_px_inv", ">", "b") + " SELECT a.run_id, round(a.violation, 6) AS x_violation, round(b.violation, 6) AS kappa_violation FROM a JOIN b USING (run_id)")
def monotonic_violation(spark: SparkSession, d: str) -> DataFrame:
    s = virtual.wire_series(spark, d)
    x, k = qc.raw_violation(s, "x_fit_px", True), qc.raw_violation(s, "kappa_fit_px_inv", False)
    return x.select("run_id", R6("violation").alias("x_violation")).join(k.select("run_id", R6("violation").alias("kappa_violation")), "run_id")


@query("smoothed_violation_wire", "WITH " + WIRE + "," + wire_violation_sql("wire", "kappa_fit_px_inv", "t") + " SELECT run_id, round(violation, 6) AS violation FROM t")
def smoothed_violation_wire(spark: SparkSession, d: str) -> DataFrame:
    return qc.wire_violation(virtual.wire_series(spark, d), "kappa_fit_px_inv", F.lit(False)).select("run_id", R6("violation").alias("violation"))


@query("smoothed_violation_braided", "WITH " + BRAIDED + "," + braided_violation_sql("braided", "length_axis_px", "t") + " SELECT run_id, round(violation, 6) AS violation FROM t")
def smoothed_violation_braided(spark: SparkSession, d: str) -> DataFrame:
    return qc.braided_violation(virtual.braided_series(spark, d), "length_axis_px", F.lit(False)).select("run_id", R6("violation").alias("violation"))


@query("direction_inference", "WITH " + BRAIDED + """,
dv AS (SELECT run_id, area_proj_px2 - 300.0 * (CASE WHEN run_id % 2 = 0 THEN q ELSE 0 END) AS v, row_number() OVER (PARTITION BY run_id ORDER BY frame) AS nth, count(*) OVER (PARTITION BY run_id) AS n FROM braided WHERE area_proj_px2 IS NOT NULL),
de AS (SELECT *, greatest(2, ceil(n * 0.1)) AS edge FROM dv),
dg AS (SELECT run_id, max(n) AS n, median(v) FILTER (nth <= edge) AS head, median(v) FILTER (nth > n - edge) AS tail, max(v) - min(v) AS rng FROM de GROUP BY run_id)
SELECT run_id, CASE WHEN n >= 4 AND abs(tail - head) >= 0.02 * greatest(rng, abs(head), abs(tail), 0.000000001) THEN tail > head ELSE true END AS increasing FROM dg""")
def direction_inference(spark: SparkSession, d: str) -> DataFrame:
    s = virtual.braided_series(spark, d).withColumn("v", F.col("area_proj_px2") - 300.0 * F.when(F.col("run_id") % 2 == 0, F.col("q")).otherwise(0.0))
    return qc.direction(s, "v")


@query("endpoint_jump_p95_max", "WITH " + WIRE + "," + jumps_sql("wire", "route_a_tip_x", "route_a_tip_y", "j") + " SELECT run_id, round(jump_max, 6) AS jump_max, round(jump_p95, 6) AS jump_p95 FROM j")
def endpoint_jump_p95_max(spark: SparkSession, d: str) -> DataFrame:
    return qc.endpoint_jumps(virtual.wire_series(spark, d), "route_a_tip_x", "route_a_tip_y").select("run_id", R6("jump_max").alias("jump_max"), R6("jump_p95").alias("jump_p95"))


@query("tail_recovery_median", "WITH " + WIRE + "," + tail_sql("wire", "kappa_fit_recovery", "frame", "t") + " SELECT run_id, round(tail_median, 6) AS tail_median FROM t")
def tail_recovery_median(spark: SparkSession, d: str) -> DataFrame:
    return qc.tail_median(virtual.wire_series(spark, d), "kappa_fit_recovery", ["frame"]).select("run_id", R6("tail_median").alias("tail_median"))


@query("foreshortening", "WITH " + BRAIDED + " SELECT run_id, frame, round(CASE WHEN max(length_axis_px) OVER w > 0.000000001 THEN 1.0 - length_axis_px / max(length_axis_px) OVER w END, 6) AS foreshortening FROM braided WINDOW w AS (PARTITION BY run_id)")
def foreshortening(spark: SparkSession, d: str) -> DataFrame:
    return virtual.braided_series(spark, d).select("run_id", "frame", R6(ordered.foreshortening("length_axis_px")).alias("foreshortening"))


ALPHA = "0.08 + (0.35 - 0.08) * greatest(0.0, least(1.0, (k % 10) * 0.1))"


def _alpha() -> F.Column:
    return scalar.quality_alpha((F.col("k") % 10) * 0.1)


@query("ema_bidirectional", "WITH RECURSIVE " + PROGRESS + f""",
src AS (SELECT run_id, frame, n, CAST(k AS DOUBLE) AS v, {ALPHA} AS a FROM prog),
fwd AS (SELECT run_id, frame, v AS e FROM src WHERE frame = 0 UNION ALL SELECT s.run_id, s.frame, s.a * s.v + (1.0 - s.a) * f.e FROM fwd f JOIN src s ON s.run_id = f.run_id AND s.frame = f.frame + 1),
bwd AS (SELECT run_id, frame, v AS e FROM src WHERE frame = n - 1 UNION ALL SELECT s.run_id, s.frame, s.a * s.v + (1.0 - s.a) * f.e FROM bwd f JOIN src s ON s.run_id = f.run_id AND s.frame = f.frame - 1)
SELECT f.run_id, f.frame, {single_sql("(f.e + b.e) / 2")} AS smooth FROM fwd f JOIN bwd b USING (run_id, frame)""")
def ema_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    rows = virtual.progress(spark, d).select("run_id", "frame", F.col("k").cast("double").alias("v"), _alpha().alias("a"))
    return temporal.bidirectional_ema(rows, "v", "a", "smooth").select("run_id", "frame", single("smooth").alias("smooth"))


@query("isotonic_pava", "WITH " + PROGRESS + """,
cs AS (SELECT run_id, frame, sum(k) OVER (PARTITION BY run_id ORDER BY frame) AS c, k FROM prog),
means AS (SELECT a.run_id, a.frame AS j, b.frame AS m, (b.c - a.c + a.k) / (b.frame - a.frame + 1.0) AS mean FROM cs a JOIN cs b ON a.run_id = b.run_id AND a.frame <= b.frame),
low AS (SELECT run_id, j, m, min(mean) OVER (PARTITION BY run_id, j ORDER BY m DESC ROWS UNBOUNDED PRECEDING) AS least_mean FROM means),
top AS (SELECT run_id, m AS frame, max(least_mean) OVER (PARTITION BY run_id, m) AS fitted, j FROM low)
SELECT run_id, frame, """ + single_sql("max(fitted)") + " AS fitted FROM top GROUP BY run_id, frame")
def isotonic_pava(spark: SparkSession, d: str) -> DataFrame:
    rows = virtual.progress(spark, d).select("run_id", "frame", F.col("k").cast("double").alias("v"))
    return temporal.isotonic(rows, "v", "fitted").select("run_id", "frame", single("fitted").alias("fitted"))


TAU = repr(2 * math.pi)


@query("unwrap_angle", "WITH " + PROGRESS + f""",
an AS (SELECT run_id, frame, (k % 64) * 0.1 - 3.1 AS a, ((k % 64) * 0.1 - 3.1) - lag((k % 64) * 0.1 - 3.1) OVER (PARTITION BY run_id ORDER BY frame) AS d FROM prog WHERE event_type <> 'error'),
fx AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < {math.pi!r} THEN 0.0 ELSE d + {math.pi!r} - {TAU} * floor((d + {math.pi!r}) / {TAU}) - {math.pi!r} - d END AS fix FROM an)
SELECT run_id, frame, {single_sql("a + sum(fix) OVER (PARTITION BY run_id ORDER BY frame ROWS UNBOUNDED PRECEDING)")} AS unwrapped FROM fx""")
def unwrap_angle(spark: SparkSession, d: str) -> DataFrame:
    rows = virtual.progress(spark, d).select("run_id", "frame", F.when(F.col("event_type") != "error", (F.col("k") % 64) * 0.1 - 3.1).alias("a"))
    return ordered.unwrapped(rows, "a", "unwrapped").select("run_id", "frame", single("unwrapped").alias("unwrapped"))


@query("nan_fill", "WITH " + WIRE + """,
nf AS (SELECT run_id, frame, x_fit_px AS v, CASE WHEN x_fit_px IS NOT NULL THEN frame END AS pos FROM wire),
nb AS (SELECT *, last_value(pos IGNORE NULLS) OVER b AS b_at, last_value(v IGNORE NULLS) OVER b AS b_v, first_value(pos IGNORE NULLS) OVER a AS a_at, first_value(v IGNORE NULLS) OVER a AS a_v FROM nf
  WINDOW b AS (PARTITION BY run_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY run_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT run_id, frame, round(coalesce(v, b_v + (a_v - b_v) * (frame - b_at) / nullif(a_at - b_at, 0), b_v, a_v), 6) AS x_filled FROM nb""")
def nan_fill(spark: SparkSession, d: str) -> DataFrame:
    return ordered.filled(virtual.wire_series(spark, d), "x_fit_px", "x_filled").select("run_id", "frame", R6("x_filled").alias("x_filled"))


@query("moving_average_5", "WITH " + PROGRESS + ", pad AS (SELECT run_id, frame, n, k, unnest([-2, -1, 0, 1, 2]) AS j FROM prog) SELECT a.run_id, a.frame, round(avg(b.k), 6) AS smooth FROM pad a JOIN prog b ON a.run_id = b.run_id AND b.frame = least(greatest(a.frame + a.j, 0), a.n - 1) GROUP BY a.run_id, a.frame")
def moving_average_5(spark: SparkSession, d: str) -> DataFrame:
    return virtual.progress(spark, d).select("run_id", "frame", R6(ordered.moving_average("k", in_frames(), 5)).alias("smooth"))


def _smoothed_sql(name: str, c: str, angle: bool = False, up: bool | None = None) -> str:
    """CTEs that fill, unwrap, average and make monotone the column c of src (run_id, i, n, a); the last has (run_id, i, fitted)."""
    turned = f"""
{name}_d AS (SELECT run_id, i, {c} AS v, {c} - lag({c}) OVER (PARTITION BY run_id ORDER BY i) AS d FROM src WHERE {c} IS NOT NULL),
{name}_u AS (SELECT run_id, i, v + sum(CASE WHEN d IS NULL OR abs(d) < {math.pi!r} THEN 0.0 ELSE CASE WHEN d + {math.pi!r} - {TAU} * floor((d + {math.pi!r}) / {TAU}) - {math.pi!r} = -{math.pi!r} AND d > 0 THEN {math.pi!r} ELSE d + {math.pi!r} - {TAU} * floor((d + {math.pi!r}) / {TAU}) - {math.pi!r} END - d END) OVER (PARTITION BY run_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS v FROM {name}_d),
{name}_v AS (SELECT src.run_id, src.i, n, a, v FROM src LEFT JOIN {name}_u USING (run_id, i)),"""
    plain = f"""
{name}_v AS (SELECT run_id, i, n, a, {c} AS v FROM src),"""
    sign = "-" if up is False else ""
    monotone = f"""
{name}_cs AS (SELECT *, sum(y) OVER (PARTITION BY run_id ORDER BY i) AS c FROM {name}_y),
{name}_ms AS (SELECT p.run_id, p.i AS j, q.i AS m, (q.c - p.c + p.y) / (q.i - p.i + 1.0) AS mean FROM {name}_cs p JOIN {name}_cs q ON p.run_id = q.run_id AND p.i <= q.i),
{name}_l AS (SELECT run_id, j, m, min(mean) OVER (PARTITION BY run_id, j ORDER BY m DESC ROWS UNBOUNDED PRECEDING) AS least_mean FROM {name}_ms),
{name} AS (SELECT run_id, m AS i, {sign}max(least_mean) AS fitted FROM {name}_l GROUP BY run_id, m)"""
    return (turned if angle else plain) + f"""
{name}_n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS b_at, last_value(v IGNORE NULLS) OVER b AS b_v, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS f_at, first_value(v IGNORE NULLS) OVER f AS f_v FROM {name}_v
  WINDOW b AS (PARTITION BY run_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY run_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name}_f AS (SELECT run_id, i, n, a, coalesce(v, b_v + (f_v - b_v) * (i - b_at) / nullif(f_at - b_at, 0), b_v, f_v) AS v FROM {name}_n),
{name}_a AS (SELECT run_id, i, v AS e FROM {name}_f WHERE i = 0 UNION ALL SELECT s.run_id, s.i, s.a * s.v + (1.0 - s.a) * p.e FROM {name}_a p JOIN {name}_f s ON s.run_id = p.run_id AND s.i = p.i + 1),
{name}_b AS (SELECT run_id, i, v AS e FROM {name}_f WHERE i = n - 1 UNION ALL SELECT s.run_id, s.i, s.a * s.v + (1.0 - s.a) * p.e FROM {name}_b p JOIN {name}_f s ON s.run_id = p.run_id AND s.i = p.i - 1),
{name}_y AS (SELECT run_id, i, {sign}(p.e + q.e) / 2 AS y FROM {name}_a p JOIN {name}_b q USING (run_id, i)),""" + (f"""
{name} AS (SELECT run_id, i, y AS fitted FROM {name}_y)""" if up is None else monotone)


_MIX = ", ".join(f"0.8 * {e}_{x} + 0.2 * route_a_{e}_{x} AS m_{e}_{x}" for e in ("anchor", "tip") for x in "xy")
ROUTE_C_SQL = "WITH RECURSIVE " + WIRE + f""",
mix AS (SELECT run_id, frame, kappa_fit_px_inv AS kappa, 0.08 + (0.35 - 0.08) * greatest(0.0, least(1.0, coalesce(quality, 0.0))) AS a, {_MIX} FROM wire),
src AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n, sqrt((m_tip_x - m_anchor_x) * (m_tip_x - m_anchor_x) + (m_tip_y - m_anchor_y) * (m_tip_y - m_anchor_y)) AS len, atan2(m_tip_y - m_anchor_y, m_tip_x - m_anchor_x) AS theta FROM mix),
""" + ",".join((_smoothed_sql("x0", "m_anchor_x"), _smoothed_sql("y0", "m_anchor_y"), _smoothed_sql("far", "len", up=True), _smoothed_sql("turn", "theta", angle=True), _smoothed_sql("bent", "kappa", up=False))) + """,
got AS (SELECT s.run_id, s.frame, s.len IS NULL AS gone, s.kappa IS NULL AS flat, x0.fitted AS ax, y0.fitted AS ay, far.fitted AS r, turn.fitted AS t, bent.fitted AS k FROM src s JOIN x0 USING (run_id, i) JOIN y0 USING (run_id, i) JOIN far USING (run_id, i) JOIN turn USING (run_id, i) JOIN bent USING (run_id, i))
SELECT run_id, frame, """ + ", ".join(f"CASE WHEN NOT {gone} THEN {single_sql(x)} END AS {c}" for x, gone, c in zip(("ax", "ay", "ax + r * cos(t)", "ay + r * sin(t)", "t", "r", "k"), ("gone",) * 6 + ("flat",), temporal.ROUTE_C_COLUMNS, strict=True)) + " FROM got"


@query("route_c", ROUTE_C_SQL)
def route_c(spark: SparkSession, d: str) -> DataFrame:
    got = temporal.route_c(virtual.wire_series(spark, d).drop("kappa_route_c_px_inv"))
    return got.select("run_id", "frame", *(single(c).alias(c) for c in temporal.ROUTE_C_COLUMNS))


@query("regularized_series", "WITH RECURSIVE " + WIRE + f""",
nf AS (SELECT run_id, frame, k, x_fit_px AS v, row_number() OVER (PARTITION BY run_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n, CASE WHEN x_fit_px IS NOT NULL THEN frame END AS pos FROM wire),
nb AS (SELECT *, last_value(pos IGNORE NULLS) OVER b AS b_at, last_value(v IGNORE NULLS) OVER b AS b_v, first_value(pos IGNORE NULLS) OVER a AS a_at, first_value(v IGNORE NULLS) OVER a AS a_v FROM nf
  WINDOW b AS (PARTITION BY run_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY run_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
src AS (SELECT run_id, frame, i, n, v IS NULL AS gone, {ALPHA} AS a, coalesce(v, b_v + (a_v - b_v) * (frame - b_at) / nullif(a_at - b_at, 0), b_v, a_v) AS v FROM nb),
fwd AS (SELECT run_id, i, v AS e FROM src WHERE i = 0 UNION ALL SELECT s.run_id, s.i, s.a * s.v + (1.0 - s.a) * f.e FROM fwd f JOIN src s ON s.run_id = f.run_id AND s.i = f.i + 1),
bwd AS (SELECT run_id, i, v AS e FROM src WHERE i = n - 1 UNION ALL SELECT s.run_id, s.i, s.a * s.v + (1.0 - s.a) * f.e FROM bwd f JOIN src s ON s.run_id = f.run_id AND s.i = f.i - 1),
cs AS (SELECT run_id, i, (f.e + b.e) / 2 AS y, sum((f.e + b.e) / 2) OVER (PARTITION BY run_id ORDER BY i) AS c FROM fwd f JOIN bwd b USING (run_id, i)),
means AS (SELECT p.run_id, p.i AS j, q.i AS m, (q.c - p.c + p.y) / (q.i - p.i + 1.0) AS mean FROM cs p JOIN cs q ON p.run_id = q.run_id AND p.i <= q.i),
low AS (SELECT run_id, j, m, min(mean) OVER (PARTITION BY run_id, j ORDER BY m DESC ROWS UNBOUNDED PRECEDING) AS least_mean FROM means),
top AS (SELECT run_id, m AS i, max(least_mean) OVER (PARTITION BY run_id, m) AS fitted FROM low),
done AS (SELECT run_id, i, max(fitted) AS fitted FROM top GROUP BY run_id, i)
SELECT w.run_id, w.frame, w.x_fit_px, CASE WHEN NOT gone THEN {single_sql("fitted")} END AS x_regular FROM src JOIN done USING (run_id, i) JOIN wire w ON w.run_id = src.run_id AND w.frame = src.frame""")
def regularized_series(spark: SparkSession, d: str) -> DataFrame:
    rows = virtual.wire_series(spark, d).select("run_id", "frame", "x_fit_px", _alpha().alias("a"))
    return temporal.regularized(rows, "x_fit_px", "a", "x_regular", True).select("run_id", "frame", "x_fit_px", single("x_regular").alias("x_regular"))


ARC = ", st AS (SELECT run_id, frame, tip_x, tip_y, coalesce(sqrt((tip_x - lag(tip_x) OVER w) ** 2 + (tip_y - lag(tip_y) OVER w) ** 2), 0.0) AS step FROM wire WHERE tip_x IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY frame)), arc AS (SELECT *, CAST(sum(CAST(step AS DECIMAL(30,9))) OVER (PARTITION BY run_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS s FROM st)"


@query("arc_length", "WITH " + WIRE + ARC + " SELECT run_id, frame, " + single_sql("s") + " AS arc_length FROM arc")
def arc_length(spark: SparkSession, d: str) -> DataFrame:
    return ordered.with_arc_length(virtual.wire_series(spark, d), "tip_x", "tip_y").select("run_id", "frame", single("arc_length").alias("arc_length"))


@query("resample_polyline", "WITH " + WIRE + ARC + """,
ah AS (SELECT *, lead(s) OVER w AS s1, lead(tip_x) OVER w AS x1, lead(tip_y) OVER w AS y1 FROM arc WINDOW w AS (PARTITION BY run_id ORDER BY s, frame)),
sp AS (SELECT * FROM ah WHERE s1 > s OR s1 IS NULL),
pt AS (SELECT *, unnest(CASE WHEN s1 IS NULL THEN [s] ELSE list_transform(range(CAST(ceil(s / 5.0) AS BIGINT), CAST(ceil(s1 / 5.0) AS BIGINT)), lambda k: k * 5.0) END) AS pos FROM sp)
SELECT run_id, """ + f'{single_sql("pos")} AS arc_length, {single_sql("tip_x + coalesce((pos - s) / (s1 - s), 0.0) * coalesce(x1 - tip_x, 0.0)")} AS x, {single_sql("tip_y + coalesce((pos - s) / (s1 - s), 0.0) * coalesce(y1 - tip_y, 0.0)")} AS y FROM pt')
def resample_polyline(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.with_arc_length(virtual.wire_series(spark, d), "tip_x", "tip_y")
    return ordered.resample(rows, ["tip_x", "tip_y"], "arc_length", 5.0).select("run_id", single("arc_length").alias("arc_length"), single("tip_x").alias("x"), single("tip_y").alias("y"))


PROFILE = ", prof AS (SELECT run_id, CAST(frame AS DOUBLE) AS pos, CASE WHEN event_type <> 'error' THEN 10.0 + k * 0.5 END AS width FROM prog)"


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return virtual.progress(spark, d).select("run_id", F.col("frame").cast("double").alias("pos"), F.when(F.col("event_type") != "error", 10.0 + F.col("k") * 0.5).alias("width"))


@query("trapezoid_area", "WITH " + PROGRESS + PROFILE + ", pa AS (SELECT run_id, (width + lag(width) OVER w) / 2 * (pos - lag(pos) OVER w) AS part FROM prof WHERE width IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY pos)) SELECT run_id, round(CASE WHEN count(*) >= 2 THEN sum(part) END, 6) AS area FROM pa GROUP BY run_id")
def trapezoid_area(spark: SparkSession, d: str) -> DataFrame:
    return geometry.trapezoid_area(_profile(spark, d), ["run_id"], "pos", "width").select("run_id", R6("area").alias("area"))


@query("window_width_stats", "WITH " + PROGRESS + PROFILE + """,
ws AS (SELECT run_id, width, (pos - min(pos) OVER w) / greatest(max(pos) OVER w - min(pos) OVER w, 0.000000001) AS norm FROM prof WHERE width IS NOT NULL WINDOW w AS (PARTITION BY run_id))
SELECT run_id, round(CASE WHEN count(*) FILTER (norm BETWEEN 0.6 AND 0.8) >= 3 THEN median(width) FILTER (norm BETWEEN 0.6 AND 0.8) ELSE median(width) END, 6) AS width_median,
  round(CASE WHEN count(*) FILTER (norm BETWEEN 0.6 AND 0.8) >= 3 THEN quantile_cont(width, 0.9) FILTER (norm BETWEEN 0.6 AND 0.8) ELSE quantile_cont(width, 0.9) END, 6) AS width_p90 FROM ws GROUP BY run_id""")
def window_width_stats(spark: SparkSession, d: str) -> DataFrame:
    return geometry.window_width_stats(_profile(spark, d), ["run_id"], "pos", "width").select("run_id", R6("width_median").alias("width_median"), R6("width_p90").alias("width_p90"))


@query("zone_metrics", "WITH " + PROGRESS + PROFILE + """,
zt AS (SELECT *, max(width) OVER (PARTITION BY run_id) AS top FROM prof WHERE width IS NOT NULL),
zg AS (SELECT run_id, min(pos) AS a, max(pos) AS z, min(pos) FILTER (width = top) AS peak, min(pos) FILTER (width >= 0.35 * top) AS l, max(pos) FILTER (width >= 0.35 * top) AS r, min(pos) FILTER (width >= 0.9 * top) AS cl, max(pos) FILTER (width >= 0.9 * top) AS cr FROM zt GROUP BY run_id),
zz AS (SELECT *, greatest(0.0, l - a) AS ll, greatest(0.0, z - r) AS lr, greatest(0.0, cl - l) AS tl, greatest(0.0, r - cr) AS tr FROM zg)
SELECT run_id, round(CASE WHEN z - a > 0.000000001 THEN greatest(0.0, least(1.0, (peak - a) / (z - a))) ELSE 0.5 END, 6) AS x_peak_norm, ll AS taper_left_px, lr AS taper_right_px, ll AS landing_zone_left_px, lr AS landing_zone_right_px, tl AS transition_zone_left_px, tr AS transition_zone_right_px,
  greatest(0.0, cr - cl) AS compaction_zone_length_px, round(CASE WHEN z - a > 0.000000001 THEN greatest(0.0, least(1.0, 1.0 - abs(ll + tl - lr - tr) / (z - a))) END, 6) AS zone_symmetry FROM zz""")
def zone_metrics(spark: SparkSession, d: str) -> DataFrame:
    got = geometry.zone_metrics(_profile(spark, d), ["run_id"], "pos", "width")
    return got.withColumns({"x_peak_norm": R6("x_peak_norm"), "zone_symmetry": R6("zone_symmetry")})


def _points(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("label", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).cast("decimal(18,6)").cast("double").alias("x"), F.round(F.get("embedding", F.lit(1)).cast("double"), 6).cast("decimal(18,6)").cast("double").alias("y"))


POINTS = "pts AS (SELECT label, CAST(CAST(round(CAST(embedding[1] AS DOUBLE), 6) AS DECIMAL(18,6)) AS DOUBLE) AS x, CAST(CAST(round(CAST(embedding[2] AS DOUBLE), 6) AS DECIMAL(18,6)) AS DOUBLE) AS y FROM embeddings)"


@query("directional_span", "WITH " + POINTS + f" SELECT label, round(max(x * cos({math.radians(30)!r}) + y * sin({math.radians(30)!r})) - min(x * cos({math.radians(30)!r}) + y * sin({math.radians(30)!r})), 6) AS direction_span_px FROM pts GROUP BY label")
def directional_span(spark: SparkSession, d: str) -> DataFrame:
    return geometry.directional_span(_points(spark, d), ["label"], "x", "y", 30.0).select("label", R6("direction_span_px").alias("direction_span_px"))


@query("principal_axis", "WITH " + POINTS + ", pc AS (SELECT label, avg(x) AS cx, avg(y) AS cy, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS th FROM pts GROUP BY label) SELECT label, round(cx, 6) AS center_x, round(cy, 6) AS center_y, round(th, 6) AS theta_rad, round(cos(th), 6) AS axis_x, round(sin(th), 6) AS axis_y FROM pc")
def principal_axis(spark: SparkSession, d: str) -> DataFrame:
    return geometry.principal_axis(_points(spark, d), ["label"], "x", "y").select("label", *(R6(c).alias(c) for c in ("center_x", "center_y", "theta_rad", "axis_x", "axis_y")))


@query("wire_quality_summary", "WITH " + WIRE + "," + jumps_sql("wire", "anchor_x", "anchor_y", "ja") + "," + jumps_sql("wire", "tip_x", "tip_y", "jt") + """,
ws AS (SELECT run_id, round(median(quality), 6) AS quality_median, round(avg(CASE WHEN quality < 0.1 THEN 1.0 ELSE 0.0 END), 6) AS quality_lt_0_1_fraction, median(centerline_points) AS centerline_points_median, round(avg(CASE WHEN model_name = 'quadratic' THEN 1.0 ELSE 0.0 END), 6) AS quadratic_fraction FROM wire GROUP BY run_id)
SELECT ws.*, round(greatest(ja.jump_p95, jt.jump_p95), 6) AS endpoint_jump_p95_px FROM ws LEFT JOIN ja USING (run_id) LEFT JOIN jt USING (run_id)""")
def wire_quality_summary(spark: SparkSession, d: str) -> DataFrame:
    got = qc.wire_summary(virtual.wire_series(spark, d))
    return got.withColumns({c: R6(c) for c in ("quality_median", "quality_lt_0_1_fraction", "quadratic_fraction", "endpoint_jump_p95_px")})


@query("run_summary", "WITH " + WIRE + " SELECT run_id, count(*) AS frames, round(min(temperature_c), 6) AS temperature_min_c, round(max(temperature_c), 6) AS temperature_max_c, round(median(quality), 6) AS quality_median, round(median(x_route_a_px), 6) AS x_route_a_px_median, round(median(x_fit_px), 6) AS x_fit_px_median, round(median(kappa_fit_px_inv), 6) AS kappa_fit_px_inv_median FROM wire GROUP BY run_id")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    got = qc.run_summary(virtual.wire_series(spark, d))
    return got.select("run_id", "frames", *(R6(c).alias(c) for c in got.columns[2:]))


_METRICS = (
    ("quality_median", "median(quality)"), ("quality_lt_0_5_fraction", "avg(CASE WHEN quality < 0.5 THEN 1.0 ELSE 0.0 END)"), ("centerline_disagreement_median", "median(disagreement)"),
    ("endpoint_gap_alt_centerline_p95_px", "quantile_cont(gap_px, 0.95)"), ("endpoint_gap_alt_centerline_fraction_p95", "quantile_cont(gap_fraction, 0.95)"), ("endpoint_frame_jump_p95_px", "quantile_cont(frame_px, 0.95)"), ("endpoint_frame_jump_fraction_p95", "quantile_cont(frame_fraction, 0.95)"),
    ("axis_median", "median(length_axis_px)"), ("branch_component_count_after_pruning_p95", "quantile_cont(branches, 0.95)"), ("axis_peak_position_stability_p95", "quantile_cont(stability, 0.95)"), ("body_mask_attachment_leak_fraction_p90", "quantile_cont(leak, 0.9)"),
    ("excluded_attachment_area_fraction_median", "median(excluded / component)"), ("body_mask_area_fraction_median", "median(body / component)"), ("attachment_border_touch_count_p90", "quantile_cont(touches, 0.9)"),
)


def acceptance_sql(source: str, name: str, profile: str = "real_video") -> str:
    limit = qc.ACCEPTANCE[profile]
    return f"""{braided_violation_sql(source + " WHERE quality IS NOT NULL AND TRUE", "length_axis_px", name + "_trend").replace("AND TRUE WHERE", "AND")},
{name}_g AS (SELECT run_id, count(*) AS valid_frames, {", ".join(f"{e} AS {n}" for n, e in _METRICS)} FROM {source} WHERE length_axis_px IS NOT NULL AND quality IS NOT NULL GROUP BY run_id),
{name} AS (SELECT g.*, t.violation AS axis_monotonic_violation_fraction, greatest({limit["gap_px"]}, {limit["gap_fraction"]} * axis_median) AS endpoint_gap_alt_centerline_limit_px, greatest({limit["frame_px"]}, {limit["frame_fraction"]} * axis_median) AS endpoint_frame_jump_limit_px FROM {name}_g g LEFT JOIN {name}_trend t USING (run_id))"""


_GAP = "(endpoint_gap_alt_centerline_fraction_p95 > 0.08 OR endpoint_gap_alt_centerline_p95_px > endpoint_gap_alt_centerline_limit_px)"
_FRAME = "(endpoint_frame_jump_fraction_p95 > 0.08 OR endpoint_frame_jump_p95_px > endpoint_frame_jump_limit_px)"
_REASONS = (
    ("valid_frames < 10", "insufficient_axis_points"), ("quality_median < 0.45", "unstable_axis_extraction"), ("quality_lt_0_5_fraction > 0.20", "quality_low_fraction"), ("axis_monotonic_violation_fraction > 0.20", "length_axis_not_monotonic_enough"),
    ("centerline_disagreement_median > 0.08", "centerline_disagreement"), (_GAP, "endpoint_jump"), (_FRAME, "endpoint_frame_jump"), ("axis_peak_position_stability_p95 > 0.18", "axis_peak_position_stability"), ("body_mask_attachment_leak_fraction_p90 > 0.03", "body_mask_attachment_leak_fraction"),
    ("excluded_attachment_area_fraction_median > 0.12", "excluded_attachment_area_fraction"), ("body_mask_area_fraction_median < 0.55", "body_mask_area_fraction"),
)
_SHOWN = [n for n, _ in _METRICS if n != "axis_median"] + ["axis_monotonic_violation_fraction", "endpoint_gap_alt_centerline_limit_px", "endpoint_frame_jump_limit_px"]


@query("acceptance_metrics", "WITH " + BRAIDED + "," + acceptance_sql("braided", "ac") + ", ar AS (SELECT *, concat_ws(',', " + ", ".join(f"CASE WHEN {p} THEN '{r}' END" for p, r in _REASONS) + ") AS reasons FROM ac) SELECT run_id, valid_frames, " + ", ".join(f"round({n}, 6) AS {n}" for n in _SHOWN) + ", reasons, reasons = '' AS accepted FROM ar")
def acceptance_metrics(spark: SparkSession, d: str) -> DataFrame:
    got = qc.acceptance(qc.braided_columns(virtual.braided_series(spark, d)))
    return got.select("run_id", "valid_frames", *(R6(c).alias(c) for c in _SHOWN), F.concat_ws(",", "reasons").alias("reasons"), "accepted")


_RELAXED = tuple((p.replace("endpoint_frame_jump_fraction_p95 > 0.08", "endpoint_frame_jump_fraction_p95 > 0.12"), r) for p, r in _REASONS)


@query("acceptance_synthetic", "WITH " + BRAIDED + "," + acceptance_sql("braided", "ac", "synthetic") + ", ar AS (SELECT *, concat_ws(',', " + ", ".join(f"CASE WHEN {p} THEN '{r}' END" for p, r in _RELAXED) + ") AS reasons FROM ac) SELECT run_id, 'length_axis_formal_px' AS axis_eval_col, round(endpoint_gap_alt_centerline_p95_px, 6) AS endpoint_jump_p95_px, round(endpoint_gap_alt_centerline_fraction_p95, 6) AS endpoint_jump_fraction_p95, round(endpoint_gap_alt_centerline_limit_px, 6) AS endpoint_jump_limit_px, round(endpoint_frame_jump_limit_px, 6) AS endpoint_frame_jump_limit_px, reasons, reasons = '' AS accepted FROM ar")
def acceptance_synthetic(spark: SparkSession, d: str) -> DataFrame:
    got = qc.acceptance(qc.braided_columns(virtual.braided_series(spark, d)), "synthetic")
    shown = ("endpoint_jump_p95_px", "endpoint_jump_fraction_p95", "endpoint_jump_limit_px", "endpoint_frame_jump_limit_px")
    return got.select("run_id", "axis_eval_col", *(R6(c).alias(c) for c in shown), F.concat_ws(",", "reasons").alias("reasons"), "accepted")


_SUMMED = {"length_axis_median_px": "median(length_axis_px)", "diameter_max_median_px": "median(diameter_max_px)", "area_proj_median_px2": "median(area_proj_px2)", "body_mask_area_median_px2": "median(body)", "length_axis_definition_gap_median_px": "median(length_axis_disagreement_px)", "body_mask_attachment_leak_fraction_median": "median(leak)", "endpoint_jump_p95_px": "quantile_cont(gap_px, 0.95)", "endpoint_frame_jump_p95_px": "quantile_cont(frame_px, 0.95)", "axis_peak_position_stability_p95": "quantile_cont(stability, 0.95)"}


@query("braided_summary", "WITH " + BRAIDED + " SELECT run_id, min(temperature_c) AS temperature_c_min, max(temperature_c) AS temperature_c_max, " + ", ".join(f"{single_sql(e)} AS {n}" for n, e in _SUMMED.items()) + " FROM braided GROUP BY run_id")
def braided_summary(spark: SparkSession, d: str) -> DataFrame:
    got = qc.braided_summary(qc.braided_columns(virtual.braided_series(spark, d)))
    return got.select("run_id", "temperature_c_min", "temperature_c_max", *(single(c).alias(c) for c in _SUMMED))


@query("smoothed_path", "WITH " + WIRE + """,
pv AS (SELECT run_id, frame, tip_x, tip_y, row_number() OVER w AS i, count(*) OVER (PARTITION BY run_id) AS n FROM wire WHERE tip_x IS NOT NULL AND tip_y IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY frame)),
pj AS (SELECT run_id, frame, i, n, unnest([-2, -1, 0, 1, 2]) AS j FROM pv),
ps AS (SELECT a.run_id, a.frame, CASE WHEN a.n >= 3 THEN avg(b.tip_x) ELSE max(CASE WHEN a.j = 0 THEN b.tip_x END) END AS sx, CASE WHEN a.n >= 3 THEN avg(b.tip_y) ELSE max(CASE WHEN a.j = 0 THEN b.tip_y END) END AS sy FROM pj a JOIN pv b ON a.run_id = b.run_id AND b.i = least(greatest(a.i + a.j, 1), a.n) GROUP BY a.run_id, a.frame, a.n)
SELECT w.run_id, w.frame, """ + single_sql("sx") + " AS tip_x, " + single_sql("sy") + " AS tip_y FROM wire w LEFT JOIN ps ON ps.run_id = w.run_id AND ps.frame = w.frame")
def smoothed_path(spark: SparkSession, d: str) -> DataFrame:
    got = ordered.smoothed_path(virtual.wire_series(spark, d), "tip_x", "tip_y")
    return got.select("run_id", "frame", single("tip_x").alias("tip_x"), single("tip_y").alias("tip_y"))


def wire_gates_sql() -> str:
    """Gate reason of each wire route as tables gate_a, gate_b and gate_c."""
    ends = " AND ".join(f"{c} IS NOT NULL" for c in gates.ENDPOINTS)
    rep = lambda m: f"(SELECT * FROM report WHERE metric_key = '{m}')"
    runs = "(SELECT DISTINCT run_id FROM wire)"
    return (
        report_sql("wire", virtual.WIRE_METRICS)
        + f""",
va AS (SELECT * FROM wire WHERE x_route_a_px IS NOT NULL AND x_route_a_recovery IS NOT NULL AND {ends}),
vb AS (SELECT * FROM wire WHERE kappa_fit_px_inv IS NOT NULL AND kappa_fit_recovery IS NOT NULL AND quality IS NOT NULL),
vc AS (SELECT * FROM wire WHERE kappa_route_c_px_inv IS NOT NULL AND kappa_route_c_recovery IS NOT NULL AND kappa_fit_px_inv IS NOT NULL AND kappa_fit_recovery IS NOT NULL),"""
        + ",".join((jumps_sql("va", "route_a_anchor_x", "route_a_anchor_y", "aj"), jumps_sql("va", "route_a_tip_x", "route_a_tip_y", "tj"), tail_sql("va", "x_route_a_recovery", "temperature_c, frame", "ta"), tail_sql("vb", "kappa_fit_recovery", "frame", "tb"), tail_sql("vc", "kappa_route_c_recovery", "temperature_c, frame", "tc"), wire_violation_sql("vb", "kappa_fit_px_inv", "vvb"), wire_violation_sql("vc", "kappa_route_c_px_inv", "vvc")))
        + f""",
ga AS (SELECT run_id, count(*) AS points, median(x_route_a_px) AS length FROM va GROUP BY run_id),
gb AS (SELECT run_id, count(*) AS points, median(quality) AS quality_median FROM vb GROUP BY run_id),
gc AS (SELECT vc.run_id, count(*) AS points, median(abs(kappa_route_c_px_inv - kappa_fit_px_inv)) AS gap FROM vc GROUP BY run_id),
gate_a AS (SELECT r.run_id, 'A' AS alias, 'x_route_a' AS metric_key, CASE WHEN m.run_id IS NULL OR coalesce(points, 0) < 15 THEN 'x_route_a_insufficient_points' WHEN dynamic_range < 5.0 THEN 'x_route_a_dynamic_range_too_small'
  WHEN greatest(aj.jump_max, tj.jump_max) > greatest(8.0, 0.10 * length) THEN 'x_route_a_endpoint_instability' WHEN monotonic_violation_fraction > 0.25 THEN 'x_route_a_not_monotonic_enough' WHEN tail_median < 0.90 THEN 'missing_high_temp_plateau' END AS gate_reason
  FROM {runs} r LEFT JOIN {rep("x_route_a")} m USING (run_id) LEFT JOIN ga USING (run_id) LEFT JOIN aj USING (run_id) LEFT JOIN tj USING (run_id) LEFT JOIN ta USING (run_id)),
gate_b AS (SELECT r.run_id, 'B' AS alias, 'kappa_fit' AS metric_key, CASE WHEN m.run_id IS NULL OR coalesce(points, 0) < 15 THEN 'insufficient_kappa_points' WHEN quality_median < 0.10 THEN 'unstable_kappa_extraction'
  WHEN coalesce(violation, monotonic_violation_fraction) > 0.25 THEN 'kappa_fit_not_monotonic_enough' WHEN tail_median < 0.90 THEN 'missing_high_temp_plateau' END AS gate_reason
  FROM {runs} r LEFT JOIN {rep("kappa_fit")} m USING (run_id) LEFT JOIN gb USING (run_id) LEFT JOIN vvb USING (run_id) LEFT JOIN tb USING (run_id)),
gate_c AS (SELECT r.run_id, 'C' AS alias, 'kappa_route_c' AS metric_key, CASE WHEN m.run_id IS NULL OR coalesce(points, 0) < 15 THEN 'kappa_route_c_insufficient_points' WHEN m.dynamic_range < 0.005 THEN 'kappa_route_c_dynamic_range_too_small'
  WHEN violation > 0.20 THEN 'kappa_route_c_not_monotonic_after_smoothing' WHEN gap / greatest(mb.dynamic_range, 0.000001) > 0.35 THEN 'kappa_route_c_route_b_deviation_too_large' WHEN tail_median < 0.92 THEN 'missing_high_temp_plateau' END AS gate_reason
  FROM {runs} r LEFT JOIN {rep("kappa_route_c")} m USING (run_id) LEFT JOIN {rep("kappa_fit")} mb USING (run_id) LEFT JOIN gc USING (run_id) LEFT JOIN vvc USING (run_id) LEFT JOIN tc USING (run_id)),
gate AS (SELECT * FROM gate_a UNION ALL SELECT * FROM gate_b UNION ALL SELECT * FROM gate_c)"""
    )


def _wire(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = dealt(stored(virtual.wire_series(spark, d), "series"), "run_id", width=len(virtual.WIRE_METRICS))
    return s, stored(virtual.reference_report(s, virtual.WIRE_METRICS), "report")


@query("gate_wire", "WITH " + WIRE + "," + wire_gates_sql() + " SELECT run_id, alias, metric_key, gate_reason, gate_reason IS NULL AS passed FROM gate")
def gate_wire(spark: SparkSession, d: str) -> DataFrame:
    return routes.gate_table("wire", *_wire(spark, d)).withColumn("passed", F.col("gate_reason").isNull())


@query("gate_wire_auxiliary", "WITH " + WIRE + "," + report_sql("wire", virtual.WIRE_METRICS) + ", vx AS (SELECT * FROM wire WHERE x_fit_px IS NOT NULL AND x_fit_recovery IS NOT NULL AND quality IS NOT NULL)," + tail_sql("vx", "x_fit_recovery", "frame", "tx") + """,
gx AS (SELECT run_id, count(*) AS points, median(quality) AS quality_median FROM vx GROUP BY run_id)
SELECT r.run_id, CASE WHEN m.run_id IS NULL OR coalesce(points, 0) < 15 THEN 'x_fit_insufficient_points' WHEN quality_median < 0.10 THEN 'x_fit_unstable_extraction' WHEN dynamic_range < 5.0 THEN 'x_fit_dynamic_range_too_small'
  WHEN monotonic_violation_fraction > 0.25 THEN 'x_fit_not_monotonic_enough' WHEN tail_median < 0.90 THEN 'missing_high_temp_plateau' END AS gate_reason
FROM (SELECT DISTINCT run_id FROM wire) r LEFT JOIN (SELECT * FROM report WHERE metric_key = 'x_fit') m USING (run_id) LEFT JOIN gx USING (run_id) LEFT JOIN tx USING (run_id)""")
def gate_wire_auxiliary(spark: SparkSession, d: str) -> DataFrame:
    return gates.wire_gate(*_wire(spark, d), "x_fit")


_BRAIDED_RENAME = {"length_axis_formal_px": "length_axis_px", "area_proj_formal_px2": "area_proj_px2"}


def braided_gates_sql() -> str:
    runs = "(SELECT DISTINCT run_id FROM braided)"
    out = report_sql("braided", virtual.BRAIDED_METRICS, _BRAIDED_RENAME) + ", vv AS (SELECT * FROM braided WHERE length_axis_px IS NOT NULL AND recovery IS NOT NULL AND quality IS NOT NULL)," + acceptance_sql("vv", "ac") + "," + tail_sql("vv", "recovery", "frame", "tl") + ", ag AS (SELECT run_id, quantile_cont(area_proj_definition_gap_px2 / greatest(abs(area_proj_px2), 0.000000001), 0.95) AS area_gap FROM vv GROUP BY run_id)"
    parts = []
    for alias, (metric, (column, up)) in zip("ABC", virtual.BRAIDED_METRICS.items(), strict=True):
        name = f"bv{alias}"
        out += "," + braided_violation_sql("vv", _BRAIDED_RENAME.get(column, column), name, str(up).lower())
        reason = lambda x, m=metric: gates.braided_reason(m, x)
        area = "WHEN area_gap > 0.18 THEN 'area_proj_definition_gap_instability'" if metric == "area_proj" else ""
        checks = " ".join(f"WHEN {p} THEN '{r}'" for p, r in _REASONS[4:])
        parts.append(f"""SELECT r.run_id, '{alias}' AS alias, '{metric}' AS metric_key, CASE WHEN m.run_id IS NULL OR coalesce(ac.valid_frames, 0) < 15 THEN '{reason("insufficient_points")}' WHEN quality_median < 0.10 THEN '{reason("unstable_extraction")}' WHEN dynamic_range < 5.0 THEN '{reason("dynamic_range_too_small")}'
  WHEN v.violation > 0.20 THEN '{reason("not_monotonic_enough")}' {checks} {area} WHEN tail_median < 0.90 THEN 'missing_high_temp_plateau' END AS gate_reason
  FROM {runs} r LEFT JOIN (SELECT * FROM report WHERE metric_key = '{metric}') m USING (run_id) LEFT JOIN ac USING (run_id) LEFT JOIN {name} v USING (run_id) LEFT JOIN tl USING (run_id) LEFT JOIN ag USING (run_id)""")
    return out + ", gate AS (" + " UNION ALL ".join(parts) + ")"


def _braided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = dealt(stored(qc.braided_columns(virtual.braided_series(spark, d)), "series"), "run_id", width=len(virtual.BRAIDED_METRICS))
    return s, stored(virtual.reference_report(s, virtual.BRAIDED_METRICS), "report")


@query("gate_braided", "WITH " + BRAIDED + "," + braided_gates_sql() + " SELECT run_id, alias, metric_key, gate_reason, gate_reason IS NULL AS passed FROM gate")
def gate_braided(spark: SparkSession, d: str) -> DataFrame:
    return routes.gate_table("braided", *_braided(spark, d)).withColumn("passed", F.col("gate_reason").isNull())


def selection_sql(kind: str) -> str:
    source, violation = ("wire", wire_violation_sql) if kind == "wire" else ("braided", braided_violation_sql)
    metrics = [("kappa_fit", "kappa_fit_px_inv", "false", 0), ("kappa_route_c", "kappa_route_c_px_inv", "false", 1), ("x_route_a", "x_route_a_px", "true", 2)] if kind == "wire" else [("length_axis", "length_axis_px", "false", 1), ("diameter_max", "diameter_max_px", "true", 0)]
    order = "struct_pack(a := preference, b := monotonic_score, c := fit_score)" if kind == "wire" else "struct_pack(a := monotonic_score, b := fit_score, c := preference)"
    out = "".join("," + violation(source, c, f"sv_{m}", up) for m, c, up, _ in metrics)
    union = " UNION ALL ".join(f"SELECT m.run_id, m.metric_key, {p}.0 AS preference, coalesce(violation, monotonic_violation_fraction) AS monotonic_score, fit_rmse / greatest(dynamic_range, 0.000000001) AS fit_score FROM report m LEFT JOIN sv_{m} USING (run_id) WHERE m.metric_key = '{m}'" for m, _, _, p in metrics)
    first = metrics[0][0]
    candidates = "('kappa_fit')" if kind == "wire" else "('length_axis', 'diameter_max')"
    return out + f""",
scores AS ({union}),
formal AS (SELECT run_id, arg_min(s.metric_key, {order}) AS formal_metric_key FROM scores s JOIN gate g USING (run_id, metric_key) WHERE g.gate_reason IS NULL AND metric_key IN {candidates} GROUP BY run_id),
prim AS (SELECT run_id, arg_min(metric_key, {order}) AS primary_metric_key FROM scores GROUP BY run_id),
chosen AS (SELECT r.run_id, primary_metric_key, formal_metric_key, CASE WHEN formal_metric_key IS NULL THEN g.gate_reason END AS formal_gate_reason, CASE WHEN formal_metric_key IS NOT NULL THEN 'formal' WHEN primary_metric_key IS NOT NULL THEN 'reportable_with_warning' ELSE 'quicklook_only' END AS reportability_status,
  CASE WHEN formal_metric_key IS NOT NULL THEN 'formal_af' ELSE 'quicklook' END AS mode FROM (SELECT DISTINCT run_id FROM {source}) r LEFT JOIN formal USING (run_id) LEFT JOIN prim USING (run_id) LEFT JOIN (SELECT * FROM gate WHERE metric_key = '{first}') g USING (run_id))"""


def _selected(kind: str, spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    s, report = (_wire if kind == "wire" else _braided)(spark, d)
    gate = stored(routes.gate_table(kind, s, report), "gates")
    return s, report, gate, stored(routes.select(kind, s, report, gate), "chosen")


@query("object_decision_wire", "WITH " + WIRE + "," + wire_gates_sql() + selection_sql("wire") + " SELECT * FROM chosen")
def object_decision_wire(spark: SparkSession, d: str) -> DataFrame:
    return _selected("wire", spark, d)[3]


@query("object_decision_braided", "WITH " + BRAIDED + "," + braided_gates_sql() + selection_sql("braided") + " SELECT * FROM chosen")
def object_decision_braided(spark: SparkSession, d: str) -> DataFrame:
    return _selected("braided", spark, d)[3]


@query("route_results_wire", "WITH " + WIRE + "," + wire_gates_sql() + selection_sql("wire") + """
SELECT g.run_id, g.alias, g.metric_key, g.alias || ':' || g.metric_key AS display_label, CASE WHEN m.run_id IS NULL THEN 'formal_blocked' WHEN g.gate_reason IS NOT NULL THEN 'formal_blocked' WHEN g.metric_key = 'kappa_fit' THEN 'formal_passed' ELSE 'provisional' END AS reportability_status,
  CASE WHEN m.run_id IS NULL THEN g.metric_key || '_insufficient_points' ELSE g.gate_reason END AS gate_reason, round(m.af95_c, 6) AS af95_c, round(m.fit_rmse, 6) AS fit_rmse,
  CASE WHEN c.formal_metric_key = g.metric_key THEN 'object_formal' WHEN c.primary_metric_key = g.metric_key THEN 'object_primary' WHEN g.metric_key = 'kappa_fit' THEN 'formal_candidate' ELSE 'route_result' END AS formal_role,
  CASE g.metric_key WHEN 'kappa_fit' THEN 'x_fit' WHEN 'kappa_route_c' THEN 'x_route_c' ELSE '' END AS auxiliary
FROM gate g LEFT JOIN report m USING (run_id, metric_key) LEFT JOIN chosen c USING (run_id)""")
def route_results_wire(spark: SparkSession, d: str) -> DataFrame:
    got = routes.route_results("wire", *_selected("wire", spark, d))
    return got.select("run_id", "alias", "metric_key", "display_label", "reportability_status", "gate_reason", R6("af95_c").alias("af95_c"), R6("fit_rmse").alias("fit_rmse"), "formal_role", F.concat_ws(",", "auxiliary_metric_keys").alias("auxiliary"))


@query("object_result_braided", "WITH " + BRAIDED + "," + braided_gates_sql() + selection_sql("braided") + """
SELECT c.run_id, 2 AS object_result_schema_version, reportability_status AS object_reportability_status, formal_metric_key AS object_formal_metric_key, CASE formal_metric_key WHEN 'length_axis' THEN 'A' WHEN 'diameter_max' THEN 'B' WHEN 'area_proj' THEN 'C' END AS object_formal_route_alias, formal_gate_reason AS object_formal_gate_reason,
  f.af95_c AS object_formal_af95_c, f.aftan_c AS object_formal_aftan_c, primary_metric_key AS object_provisional_metric_key, CASE primary_metric_key WHEN 'length_axis' THEN 'A' WHEN 'diameter_max' THEN 'B' WHEN 'area_proj' THEN 'C' END AS object_provisional_route_alias, p.af95_c AS object_provisional_af95_c, p.aftan_c AS object_provisional_aftan_c,
  coalesce(formal_metric_key, primary_metric_key) AS object_recommended_metric_key, CASE coalesce(formal_metric_key, primary_metric_key) WHEN 'length_axis' THEN 'A' WHEN 'diameter_max' THEN 'B' WHEN 'area_proj' THEN 'C' END AS object_recommended_route_alias
FROM chosen c LEFT JOIN report f ON f.run_id = c.run_id AND f.metric_key = formal_metric_key LEFT JOIN report p ON p.run_id = c.run_id AND p.metric_key = primary_metric_key""")
def object_result_braided(spark: SparkSession, d: str) -> DataFrame:
    _, report, _, chosen = _selected("braided", spark, d)
    return routes.object_result(chosen, report, F.lit("braided_like"))


@query("flatten_route_results", "WITH " + WIRE + "," + report_sql("wire", virtual.WIRE_METRICS) + ", fv AS (SELECT * FROM wire WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in gates.ENDPOINTS) + "), both_c AS (SELECT * FROM wire WHERE kappa_route_c_px_inv IS NOT NULL AND kappa_fit_px_inv IS NOT NULL)," + ",".join((jumps_sql("fv", "route_a_anchor_x", "route_a_anchor_y", "aj"), jumps_sql("fv", "route_a_tip_x", "route_a_tip_y", "tj"), wire_violation_sql("both_c", "kappa_route_c_px_inv", "cv"), tail_sql("wire", "x_route_a_recovery", "frame", "t_a"), tail_sql("wire", "kappa_fit_recovery", "frame", "t_b"), tail_sql("wire", "kappa_route_c_recovery", "frame", "t_c"))) + """,
cd AS (SELECT b.run_id, median(abs(kappa_route_c_px_inv - kappa_fit_px_inv)) AS gap FROM both_c b GROUP BY run_id),
un AS (SELECT run_id, 'x_route_a' AS metric_key, count(x_route_a_px) AS n, median(CASE WHEN x_route_a_px IS NOT NULL THEN quality END) AS qm FROM wire GROUP BY run_id UNION ALL SELECT run_id, 'kappa_fit', count(kappa_fit_px_inv), median(CASE WHEN kappa_fit_px_inv IS NOT NULL THEN quality END) FROM wire GROUP BY run_id UNION ALL SELECT run_id, 'kappa_route_c', count(kappa_route_c_px_inv), median(CASE WHEN kappa_route_c_px_inv IS NOT NULL THEN quality END) FROM wire GROUP BY run_id)
SELECT u.run_id, u.metric_key, u.n AS qc_valid_points, round(u.qm, 6) AS qc_quality_median, round(CASE WHEN u.metric_key = 'kappa_route_c' THEN coalesce(cv.violation, m.monotonic_violation_fraction) ELSE m.monotonic_violation_fraction END, 6) AS qc_monotonic_violation_fraction,
  round(CASE u.metric_key WHEN 'x_route_a' THEN t_a.tail_median WHEN 'kappa_fit' THEN t_b.tail_median ELSE t_c.tail_median END, 6) AS qc_tail_recovery_median, CASE u.metric_key WHEN 'x_route_a' THEN 'endpoint_jump_max_px' WHEN 'kappa_fit' THEN 'fit_rmse' ELSE 'route_b_deviation_fraction' END AS qc_stability_metric_key,
  round(CASE u.metric_key WHEN 'x_route_a' THEN greatest(aj.jump_max, tj.jump_max) WHEN 'kappa_fit' THEN m.fit_rmse ELSE gap / greatest(mb.dynamic_range, 0.000001) END, 6) AS qc_stability_metric_value
FROM un u LEFT JOIN report m USING (run_id, metric_key) LEFT JOIN (SELECT * FROM report WHERE metric_key = 'kappa_fit') mb ON mb.run_id = u.run_id LEFT JOIN aj ON aj.run_id = u.run_id LEFT JOIN tj ON tj.run_id = u.run_id LEFT JOIN cv ON cv.run_id = u.run_id LEFT JOIN cd ON cd.run_id = u.run_id LEFT JOIN t_a ON t_a.run_id = u.run_id LEFT JOIN t_b ON t_b.run_id = u.run_id LEFT JOIN t_c ON t_c.run_id = u.run_id""")
def flatten_route_results(spark: SparkSession, d: str) -> DataFrame:
    flat = routes.flattened(routes.qc_summary("wire", *_wire(spark, d)))
    return flat.withColumns({c: R6(c) for c in ("qc_quality_median", "qc_monotonic_violation_fraction", "qc_tail_recovery_median", "qc_stability_metric_value")})


@query("direction_result", "WITH " + BRAIDED + "," + report_sql("braided", {"direction_span": ("(100.0 + 12.0 * recovery)", True)}) + """,
rn AS (SELECT DISTINCT run_id, CASE WHEN run_id % 3 > 0 THEN 30.0 END AS angle_deg, run_id % 4 > 0 AS warm FROM braided)
SELECT rn.run_id, angle_deg IS NOT NULL AS enabled, angle_deg, 'direction_span' AS metric_key, CASE WHEN angle_deg IS NOT NULL AND warm THEN round(fit_rmse, 6) END AS fit_rmse, CASE WHEN angle_deg IS NULL OR NOT warm THEN 'quicklook_only' WHEN m.run_id IS NULL THEN 'formal_blocked' ELSE 'formal_passed' END AS reportability_status,
  CASE WHEN angle_deg IS NULL THEN 'direction_metric_disabled' WHEN NOT warm THEN 'temperature_sync_missing' WHEN m.run_id IS NULL THEN 'direction_span_insufficient_points' END AS gate_reason FROM rn LEFT JOIN report m USING (run_id)""")
def direction_result(spark: SparkSession, d: str) -> DataFrame:
    s = virtual.braided_series(spark, d)
    report = virtual.reference_report(s, {"direction_span": ("direction_span_px", True)})
    runs = s.select("run_id").distinct().select("run_id", F.when(F.col("run_id") % 3 > 0, 30.0).alias("angle_deg"), (F.col("run_id") % 4 > 0).alias("has_temperature"))
    return routes.direction_result(report, runs).select("run_id", "enabled", "angle_deg", "metric_key", R6("fit_rmse").alias("fit_rmse"), "reportability_status", "gate_reason")


@query("directional_recovery", "WITH " + WIRE + f' SELECT run_id, frame, {single_sql("CASE WHEN x_fit_px IS NOT NULL THEN greatest(0.0, least(1.0, (x_fit_px - 52.0) / 36.0)) END")} AS up, {single_sql("CASE WHEN kappa_fit_px_inv IS NOT NULL THEN greatest(0.0, least(1.0, (0.075 - kappa_fit_px_inv) / (0.075 - 0.015))) END")} AS down FROM wire')
def directional_recovery(spark: SparkSession, d: str) -> DataFrame:
    s = virtual.wire_series(spark, d)
    up = scalar.recovery_from_fit(F.col("x_fit_px"), F.lit(52.0), F.lit(88.0), F.lit(True))
    down = scalar.recovery_from_fit(F.col("kappa_fit_px_inv"), F.lit(-0.075), F.lit(-0.015), F.lit(False))
    return s.select("run_id", "frame", single(up).alias("up"), single(down).alias("down"))


@query("stride_sample", "WITH " + PROGRESS + " SELECT run_id, frame, k FROM prog WHERE frame % 3 = 0")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return files.strided(virtual.progress(spark, d), 3).select("run_id", "frame", "k")


@query("frame_counts", "WITH " + PROGRESS + " SELECT run_id, count(*) AS original_frame_count, count(*) FILTER (frame % 3 = 0) AS analyzed_frame_count FROM prog GROUP BY run_id")
def frame_counts(spark: SparkSession, d: str) -> DataFrame:
    return files.frame_counts(virtual.progress(spark, d), 3)


@query("bucketed_lookup", "WITH " + PROGRESS + ", st AS (SELECT run_id, frame, k, k - lag(k) OVER (PARTITION BY run_id ORDER BY frame) AS step FROM prog) SELECT run_id, frame, k, step FROM st WHERE frame = run_id % 50")
def bucketed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a stored series and their steps: the table's buckets serve the window and the lookup."""
    folder = shared_folder(spark)
    table = files.store_series(virtual.progress(spark, d).select("run_id", "frame", "k"), f"series_{folder.rsplit('/', 1)[-1]}", f"{folder}/series", 16)
    rows = table.withColumn("step", F.col("k") - F.lag("k").over(in_frames()))
    wanted = table.select("run_id").distinct().select("run_id", (F.col("run_id") % 50).alias("frame"))
    return files.frames_at(rows, wanted).select("run_id", "frame", "k", "step")


@query("frame_lookup", "WITH " + PROGRESS + " SELECT run_id, frame, k FROM prog WHERE frame = run_id % 50")
def frame_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = virtual.progress(spark, d)
    wanted = p.select("run_id").distinct().select("run_id", (F.col("run_id") % 50).alias("frame"))
    return files.frames_at(p, wanted).select("run_id", "frame", "k")


@query("even_sample", "WITH " + PROGRESS + ", pick AS (SELECT DISTINCT run_id, n, unnest(list_transform(range(0, 12), lambda j: CAST(floor(j * (n - 1) / 11.0) AS BIGINT))) AS frame FROM prog) SELECT DISTINCT p.run_id, p.frame, p.k FROM prog p JOIN pick USING (run_id, frame)")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return ordered.even_sample(virtual.progress(spark, d).drop("n"), 12).select("run_id", "frame", "k")


@query("prepared_series", "WITH " + PROGRESS + """,
raw AS (SELECT run_id, CAST(floor(frame / 2.0) AS BIGINT) * 2 AS frame, frame AS seq, time_sec, k FROM prog),
one AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY run_id, frame ORDER BY seq) = 1),
dif AS (SELECT *, frame - lag(frame) OVER w AS step, time_sec - lag(time_sec) OVER w AS dt FROM one WINDOW w AS (PARTITION BY run_id ORDER BY frame)),
med AS (SELECT run_id, greatest(1.0, coalesce(median(step) FILTER (step > 0), 1.0)) AS stride, median(dt) FILTER (dt > 0) AS gap FROM dif GROUP BY run_id)
SELECT run_id, frame, k, stride, round(stride / gap, 6) AS fps FROM one JOIN med USING (run_id)""")
def prepared_series(spark: SparkSession, d: str) -> DataFrame:
    raw = virtual.progress(spark, d).select("run_id", (F.floor(F.col("frame") / 2) * 2).alias("frame"), F.col("frame").alias("seq"), "time_sec", "k")
    return ordered.prepared(raw).select("run_id", "frame", "k", "stride", R6("fps").alias("fps"))


_FIT_SQL = "WITH " + WIRE + """,
lm AS (SELECT run_id, frame, temperature_c, m.metric_key, m.up, m.v FROM (SELECT run_id, frame, temperature_c, unnest([
  {'metric_key': 'x_route_a', 'up': true, 'v': x_route_a_px}, {'metric_key': 'x_fit', 'up': true, 'v': x_fit_px}, {'metric_key': 'kappa_fit', 'up': false, 'v': kappa_fit_px_inv}, {'metric_key': 'kappa_route_c', 'up': false, 'v': kappa_route_c_px_inv}]) AS m FROM wire) WHERE m.v IS NOT NULL AND temperature_c IS NOT NULL),
st AS (SELECT *, v - lag(v) OVER (PARTITION BY run_id, metric_key ORDER BY temperature_c, frame) AS step FROM lm),
told AS (SELECT run_id, metric_key, up AS increasing, count(*) AS n, min(temperature_c) < max(temperature_c) AS spread, avg(CASE WHEN step IS NULL THEN NULL WHEN (up AND step < 0) OR (NOT up AND step > 0) THEN 1.0 ELSE 0.0 END) AS wrong, max(v) - min(v) AS rng FROM st GROUP BY ALL)
SELECT run_id, metric_key, increasing, CASE WHEN n < 4 THEN 'insufficient_points' WHEN NOT spread THEN 'constant_temperature' END AS reason,
       CASE WHEN n >= 4 AND spread THEN """ + single_sql("wrong") + """ END AS monotonic_violation_fraction, CASE WHEN n >= 4 AND spread THEN """ + single_sql("rng") + """ END AS dynamic_range,
       CASE WHEN n >= 4 AND spread THEN true END AS rmse_holds, CASE WHEN n >= 4 AND spread THEN true END AS least_squares FROM told"""


@query("sigmoid_fit_report", _FIT_SQL)
def sigmoid_fit_report(spark: SparkSession, d: str) -> DataFrame:
    """The reports with what SQL can say of a fit: that its squares are those of its parameters, and that none near them has smaller ones."""
    long = virtual.long_metrics(virtual.wire_series(spark, d), virtual.WIRE_METRICS)
    found = stored(fit.reports(long), "reports")
    rows = found.join(fit.residual_checks(long, found), ["run_id", "metric_key"], "left")
    return rows.select("run_id", "metric_key", "increasing", "reason", single("monotonic_violation_fraction").alias("monotonic_violation_fraction"), single("dynamic_range").alias("dynamic_range"), "rmse_holds", "least_squares")


@query("plot_values", "WITH " + WIRE + ", rec AS (SELECT *, CASE WHEN run_id % 2 = 0 THEN 1.0 - k / 100.0 END AS recovery FROM wire), has AS (SELECT *, count(recovery) OVER w AS n, min(x_fit_px) OVER w AS low, max(x_fit_px) OVER w AS high FROM rec WINDOW w AS (PARTITION BY run_id)) SELECT run_id, frame, round(CASE WHEN n > 0 THEN recovery WHEN x_fit_px IS NULL THEN NULL WHEN high - low > 0.000000001 THEN (x_fit_px - low) / (high - low) ELSE 0.5 END, 6) AS shown FROM has")
def plot_values(spark: SparkSession, d: str) -> DataFrame:
    rows = virtual.wire_series(spark, d).withColumn("recovery", F.when(F.col("run_id") % 2 == 0, 1.0 - F.col("k") / 100.0))
    return rows.select("run_id", "frame", R6(ordered.plot_values("x_fit_px", "recovery")).alias("shown"))
