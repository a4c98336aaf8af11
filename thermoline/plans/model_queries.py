"""Queries over centerlines, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoline.operators import models
from thermoline.plans import virtual
from thermoline.plans.series_queries import single, single_sql, sql

TABLE: dict[str, tuple[object, str | None]] = {}

POINTS = """
ev AS (SELECT user_id AS run_id, event_id AS frame, event_type = 'error' AS gone, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
tt AS (SELECT run_id, frame, gone, k, j AS place, j / 40.0 AS t FROM (SELECT *, unnest(range(0, CASE WHEN gone THEN 1 ELSE 41 END)) AS j FROM ev)),
pts AS (SELECT run_id, frame, place, CASE WHEN gone THEN NULL WHEN k % 3 = 0 THEN (0.002 + 0.0001 * (k % 7)) * (80.0 * t) * (80.0 * t)
    WHEN k % 3 = 1 THEN (60.0 + k % 5 * 5.0) * 2.0 * (0.6 * t) * (0.6 * t) / (1.0 + (0.6 * t) * (0.6 * t))
    ELSE 0.004 * least(90.0 * t, 40.0) * least(90.0 * t, 40.0) + 0.32 * greatest(90.0 * t - 40.0, 0.0) END AS u,
  CASE WHEN gone THEN NULL WHEN k % 3 = 0 THEN 80.0 * t WHEN k % 3 = 1 THEN (60.0 + k % 5 * 5.0) * 2.0 * (0.6 * t) / (1.0 + (0.6 * t) * (0.6 * t)) ELSE 90.0 * t END AS v FROM tt)
"""


def _spaced(source: str, total: str, least: int, name: str) -> str:
    """Places of each path by looking up the span that holds each of them."""
    return f"""
{name}_n AS (SELECT run_id, frame, {total} AS total, greatest(ceil({total} / 3.0) + 1, {least})::INT AS n FROM {source} WHERE place = 0),
{name}_k AS (SELECT *, total / (n - 1) AS gap, unnest(range(0, n)) AS place FROM {name}_n),
{name}_t AS (SELECT *, CASE WHEN place = n - 1 THEN total ELSE place * gap END AS pos FROM {name}_k),
{name}_s AS (SELECT run_id, frame, arc, u, v, lead(arc) OVER w AS arc_to, lead(u) OVER w AS u_to, lead(v) OVER w AS v_to FROM {source} WINDOW w AS (PARTITION BY run_id, frame ORDER BY place)),
{name} AS (SELECT t.run_id, t.frame, t.place, t.pos, t.gap, t.n, t.total, u + (u_to - u) * ((pos - arc) / (arc_to - arc)) AS u, v + (v_to - v) * ((pos - arc) / (arc_to - arc)) AS v
  FROM {name}_t t ASOF JOIN (SELECT * FROM {name}_s WHERE arc_to > arc) s ON t.run_id = s.run_id AND t.frame = s.frame AND t.pos >= s.arc)"""


def _parabola(source: str, name: str) -> str:
    return f"""
{name}_c AS (SELECT *, v - avg(v) OVER (PARTITION BY run_id, frame) AS y, avg(v) OVER (PARTITION BY run_id, frame) AS mean_v FROM {source}),
{name}_m AS (SELECT *, avg(y * y) OVER w AS m2, avg(y * y * y) OVER w AS m3, avg(y * y * y * y) OVER w AS m4, avg(u) OVER w AS p0, avg(u * y) OVER w AS p1, avg(u * y * y) OVER w AS p2 FROM {name}_c WINDOW w AS (PARTITION BY run_id, frame)),
{name}_a AS (SELECT *, (m2 * p2 - m3 * p1 - m2 * m2 * p0) / (m2 * m4 - m3 * m3 - m2 * m2 * m2) AS a FROM {name}_m),
{name} AS (SELECT run_id, frame, place, pos, u, v, mean_v, a, (p1 - a * m3) / m2 AS b, u - (a * (y * y - m2) + (p1 - a * m3) / m2 * y + p0) AS off FROM {name}_a)"""


MODELS_SQL = "WITH " + POINTS + """,
st AS (SELECT run_id, frame, place, u, v, CAST(coalesce(sqrt((u - lag(u) OVER w) ** 2 + (v - lag(v) OVER w) ** 2), 0.0) AS DECIMAL(30,9)) AS step FROM pts WHERE u IS NOT NULL WINDOW w AS (PARTITION BY run_id, frame ORDER BY place)),
path AS (SELECT *, CAST(sum(step) OVER (PARTITION BY run_id, frame ORDER BY place ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS arc, CAST(sum(step) OVER (PARTITION BY run_id, frame) AS DOUBLE) AS total FROM st),
""" + _spaced("path", "total", 16, "grid") + """,
g1 AS (SELECT *, coalesce((lead(u) OVER w - lag(u) OVER w) / (2.0 * gap), (lead(u) OVER w - u) / gap, (u - lag(u) OVER w) / gap) AS du, coalesce((lead(v) OVER w - lag(v) OVER w) / (2.0 * gap), (lead(v) OVER w - v) / gap, (v - lag(v) OVER w) / gap) AS dv FROM grid WINDOW w AS (PARTITION BY run_id, frame ORDER BY place)),
g2 AS (SELECT *, coalesce((lead(du) OVER w - lag(du) OVER w) / (2.0 * gap), (lead(du) OVER w - du) / gap, (du - lag(du) OVER w) / gap) AS ddu, coalesce((lead(dv) OVER w - lag(dv) OVER w) / (2.0 * gap), (lead(dv) OVER w - dv) / gap, (dv - lag(dv) OVER w) / gap) AS ddv FROM g1 WINDOW w AS (PARTITION BY run_id, frame ORDER BY place)),
c1 AS (SELECT *, abs(du * ddv - dv * ddu) / greatest((du * du + dv * dv) * sqrt(du * du + dv * dv), 0.000000001) AS c FROM g2),
c2 AS (SELECT *, sum(c) OVER (PARTITION BY run_id, frame ORDER BY place ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0 AS c7 FROM c1),
c3 AS (SELECT *, max(c7) OVER (PARTITION BY run_id, frame) AS most FROM c2),
c4 AS (SELECT run_id, frame, max(most) AS most, max(total) AS total, max(n) AS n, max(gap) AS gap, least(max(place) FILTER (c7 >= 0.28 * most) + 2, max(n) - 1) AS reach FROM c3 GROUP BY run_id, frame),
arcs AS (SELECT run_id, frame, least(greatest(least(greatest(CASE WHEN most > 0.000000001 THEN CASE WHEN reach = n - 1 THEN total ELSE reach * gap END ELSE 0.72 * total END, 0.42 * total), 0.72 * total), 30.0), total) AS fit_arc FROM c4),
reached AS (SELECT path.*, fit_arc FROM path JOIN arcs USING (run_id, frame)),
""" + _spaced("reached", "fit_arc", 10, "line") + "," + _parabola("line", "one") + """,
near AS (SELECT *, count(*) FILTER (abs(off) <= 2.5) OVER (PARTITION BY run_id, frame) AS many FROM one),
kept AS (SELECT run_id, frame, place, pos, u, v FROM near WHERE abs(off) <= 2.5 OR many < 6),
""" + _parabola("kept", "two") + """,
r1 AS (SELECT *, u - avg(u) OVER w AS x, v - avg(v) OVER w AS y FROM two WINDOW w AS (PARTITION BY run_id, frame)),
r2 AS (SELECT *, avg(x * x) OVER w AS xx, avg(y * y) OVER w AS yy, avg(x * y) OVER w AS xy, avg(x * (x * x + y * y)) OVER w / 2.0 AS xs, avg(y * (x * x + y * y)) OVER w / 2.0 AS ys FROM r1 WINDOW w AS (PARTITION BY run_id, frame)),
r3 AS (SELECT *, CASE WHEN xx * yy - xy * xy > 0.000000001 * (xx + yy) * (xx + yy) THEN xx * yy - xy * xy END AS det FROM r2),
r4 AS (SELECT *, (xs * yy - ys * xy) / det AS cx, (ys * xx - xs * xy) / det AS cy FROM r3),
r5 AS (SELECT *, sqrt(cx * cx + cy * cy + xx + yy) AS radius, sqrt((cx - x) ** 2 + (cy - y) ** 2) - sqrt(cx * cx + cy * cy + xx + yy) AS round_off FROM r4),
fits AS (SELECT run_id, frame, min(v) AS v0, max(v) AS v1, count(*) AS fit_points, max(a) AS a, max(b) AS b, max(mean_v) AS mean_v, max(radius) AS radius, sqrt(avg(off * off)) AS q, sqrt(avg(round_off * round_off)) AS c FROM r5 GROUP BY run_id, frame),
told AS (SELECT *, c IS NULL OR q <= c * 1.05 AS quadratic FROM fits),
bends AS (SELECT run_id, frame, avg(abs(2 * a) / pow(1 + (2 * a * (v0 + (v1 - v0) * k / 119 - mean_v) + b) ** 2, 1.5)) AS kappa FROM (SELECT *, unnest(range(0, 120)) AS k FROM told) GROUP BY run_id, frame)
SELECT f.run_id, f.frame, CASE WHEN quadratic IS NULL THEN 'failed' WHEN quadratic THEN 'quadratic' ELSE 'circle' END AS model_name, """ + ", ".join(
    f"{single_sql(x)} AS {name}"
    for x, name in (("CASE WHEN quadratic THEN kappa ELSE 1.0 / radius END", "kappa_fit_px_inv"), ("CASE WHEN quadratic IS NOT NULL THEN fit_arc END", "fit_arc_px"), ("coalesce(exp(-CASE WHEN quadratic THEN q ELSE c END / 4.0) * least(fit_points * 3.0 / greatest(v1 - v0, 1.0), 1.0), 0.0)", "quality"))
) + """, fit_points, round(q, 6) AS quadratic_rmse_px, round(c, 6) AS circle_rmse_px FROM (SELECT DISTINCT run_id, frame FROM pts) f LEFT JOIN told USING (run_id, frame) LEFT JOIN bends USING (run_id, frame) LEFT JOIN arcs USING (run_id, frame)"""


def centerline_models(spark: SparkSession, d: str) -> DataFrame:
    """Model, curvature and errors of every event's centerline."""
    got = models.chosen_models(virtual.centerlines(spark, d))
    return got.select("run_id", "frame", "model_name", *(single(c).alias(c) for c in ("kappa_fit_px_inv", "fit_arc_px", "quality")), "fit_points", *(F.round(c, 6).alias(c) for c in ("quadratic_rmse_px", "circle_rmse_px")))


TABLE["centerline_models"] = (centerline_models, sql(MODELS_SQL))
