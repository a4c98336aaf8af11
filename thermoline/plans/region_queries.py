"""Queries over regions, points, codes and windows of time, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoline.functions import scalar
from thermoline.operators import routes
from thermoline.plans import virtual
from thermoline.plans.series_queries import R6, single, single_sql, sql
from thermoline.streaming import monitor

TABLE: dict[str, tuple[object, str | None]] = {}
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER) AS k"


def query(name: str, oracle: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        TABLE[name] = (f, sql(oracle))
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return virtual.events(spark, d).select("event_id", "user_id", "event_type", "ts", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("clipped_roi", f"""
WITH bx AS (SELECT event_id, k * 2 - 40 AS x0, k - 10 AS y0, k * 2 - 40 + k % 30 AS x1, k + 50 AS y1 FROM (SELECT event_id, {_K} FROM events)),
ct AS (SELECT event_id, greatest(0, least(x0, 120)) AS x0, greatest(0, least(y0, 90)) AS y0, greatest(0, least(x1, 120)) AS x1, greatest(0, least(y1, 90)) AS y1 FROM bx),
er AS (SELECT *, CASE WHEN x1 <= x0 OR y1 <= y0 THEN 'outside_frame' WHEN x1 - x0 < 2 OR y1 - y0 < 2 THEN 'too_small' END AS error FROM ct)
SELECT event_id, CASE WHEN error IS NULL THEN x0 END AS x0, CASE WHEN error IS NULL THEN y0 END AS y0, CASE WHEN error IS NULL THEN x1 END AS x1, CASE WHEN error IS NULL THEN y1 END AS y1, error FROM er""")
def clipped_roi(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    roi = F.struct((k * 2 - 40).alias("x0"), (k - 10).alias("y0"), (k * 2 - 40 + k % 30).alias("x1"), (k + 50).alias("y1"))
    return _events(spark, d).withColumn("roi", roi).withColumn("out", scalar.clip_roi(F.col("roi"), 120, 90)).select("event_id", "out.*")


@query("rotated_points", f"SELECT vec_id, {single_sql('x * cos(a) - y * sin(a)')} AS x, {single_sql('x * sin(a) + y * cos(a)')} AS y FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label * 0.5 AS a FROM embeddings)")
def rotated_points(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    x, y = scalar.rotate(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), F.col("label") * 0.5)
    return e.select("vec_id", single(x).alias("x"), single(y).alias("y"))


@query("coerced_values", f"""
SELECT event_id, CASE k % 5 WHEN 0 THEN k WHEN 1 THEN 7 END::BIGINT AS number,
  CASE k % 5 WHEN 0 THEN 'a,b' WHEN 1 THEN 'low' WHEN 4 THEN '5' ELSE '' END AS codes FROM (SELECT event_id, {_K} FROM events)""")
def coerced_values(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers and lists of codes from texts that may hold anything."""
    which = F.col("k") % 5
    number = F.when(which == 0, F.col("k").cast("string")).when(which == 1, "7.9").when(which == 2, "NaN").when(which == 3, "x")
    codes = F.when(which == 0, '["a", null, "", "b"]').when(which == 1, '"low"').when(which == 2, '""').when(which == 3, "{broken").otherwise("5")
    return _events(spark, d).select("event_id", scalar.whole_or_null(number).alias("number"), F.array_join(scalar.warning_codes(codes), ",").alias("codes"))


@query("completed_routes", """
WITH rr AS (SELECT DISTINCT user_id AS run_id, CASE event_type WHEN 'signup' THEN 'A' WHEN 'error' THEN 'C' ELSE 'B' END AS alias FROM events WHERE user_id % 4 <> 3 OR event_type = 'error')
SELECT e.run_id, a.alias, rr.alias IS NOT NULL AS known FROM (SELECT DISTINCT run_id FROM rr) e CROSS JOIN (SELECT unnest(['A', 'B', 'C']) AS alias) a LEFT JOIN rr ON rr.run_id = e.run_id AND rr.alias = a.alias""")
def completed_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes of every run, those that are missing among them."""
    rows = _events(spark, d).where("user_id % 4 <> 3 OR event_type = 'error'")
    alias = F.when(F.col("event_type") == "signup", "A").when(F.col("event_type") == "error", "C").otherwise("B")
    known = rows.select(F.col("user_id").alias("run_id"), alias.alias("alias")).distinct().withColumn("known", F.lit(True))
    return routes.complete(known, "wire").select("run_id", "alias", F.coalesce("known", F.lit(False)).alias("known"))


@query("monitor_sliding", """
WITH wn AS (SELECT user_id AS run_id, time_bucket(INTERVAL 30 MINUTE, ts) - j * INTERVAL 30 MINUTE AS start, CAST(value AS DECIMAL(18,4)) AS v FROM events, unnest([0, 1]) AS t(j))
SELECT run_id, strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS rows, round(CAST(sum(v) AS DOUBLE) / count(*), 6) AS mean FROM wn GROUP BY ALL""")
def monitor_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Windows of an hour, one every half hour."""
    rows = _events(spark, d).select(F.col("user_id").alias("run_id"), "ts", F.col("value").cast("decimal(18,4)").alias("value"))
    got = monitor.windowed(rows, "ts", "value", "1 hour", "30 minutes")
    return got.select("run_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "rows", R6(F.col("mean").cast("double")).alias("mean"))


@query("monitor_sessions", """
WITH gp AS (SELECT user_id AS run_id, ts, CAST(value AS DECIMAL(18,4)) AS v, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
ss AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM gp)
SELECT run_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS rows, round(CAST(sum(v) AS DOUBLE) / count(*), 6) AS mean FROM ss GROUP BY run_id, nth""")
def monitor_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions: events of a run less than two hours apart."""
    rows = _events(spark, d).select(F.col("user_id").alias("run_id"), "ts", F.col("value").cast("decimal(18,4)").alias("value"))
    got = monitor.sessions(rows, "ts", "value", "2 hours")
    return got.select("run_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "rows", R6(F.col("mean").cast("double")).alias("mean"))
