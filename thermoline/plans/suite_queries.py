"""Queries over registries and benchmark suites made from the order tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoline.functions import scalar
from thermoline.operators import candidates, geometry, registry, settings, suite
from thermoline.plans.series_queries import R6, single, single_sql, sql
from thermoline.sources import synthetic

TABLE: dict[str, tuple[object, str | None]] = {}


def query(name: str, oracle: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        TABLE[name] = (f, sql(oracle) if oracle else None)
        return f

    return add


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


RUNS = """
runs AS (SELECT o_orderkey AS id, o_orderdate AS created_at, CASE o_orderkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'completed' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' END AS asset_status, o_totalprice AS af95_c,
  o_orderkey % 3 > 0 AS has_summary, o_orderkey % 7 > 1 AS has_csv, o_orderkey % 11 = 4 AS in_flight, o_orderkey % 2 = 0 AS assets_complete FROM orders)
"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as registered runs."""
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "queued").when(k % 5 == 1, "running").when(k % 5 == 2, "failed").otherwise("completed")
    asset = F.when(k % 4 == 0, "pending").when(k % 4 == 1, "running").when(k % 4 == 2, "completed")
    return _read(spark, d, "orders").select(k.alias("id"), F.col("o_orderdate").alias("created_at"), status.alias("status"), asset.alias("asset_status"), F.col("o_totalprice").alias("af95_c"), (k % 3 > 0).alias("has_summary"), (k % 7 > 1).alias("has_csv"), (k % 11 == 4).alias("in_flight"), (k % 2 == 0).alias("assets_complete"))


@query("registry_latest_n", "WITH " + RUNS + " SELECT id, created_at, status FROM runs ORDER BY created_at DESC, id DESC LIMIT 50")
def registry_latest_n(spark: SparkSession, d: str) -> DataFrame:
    return registry.latest(runs(spark, d), 50).select("id", "created_at", "status")


@query("registry_point_lookup", "WITH " + RUNS + " SELECT id, status, af95_c FROM runs WHERE id = 123")
def registry_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).where("id = 123").select("id", "status", "af95_c")


@query("history_counts", "WITH " + RUNS + ", l AS (SELECT * FROM runs ORDER BY created_at DESC, id DESC LIMIT 200) SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status IN ('queued', 'running')) AS running, count(*) FILTER (status = 'failed') AS failed FROM l")
def history_counts(spark: SparkSession, d: str) -> DataFrame:
    return registry.status_counts(runs(spark, d), 200)


@query("registry_upsert", "WITH " + RUNS + ", ch AS (SELECT id + 10 AS id, 'completed' AS status, round(af95_c / 2, 4) AS af95_c FROM runs WHERE id % 10 = 3) SELECT id, status, af95_c FROM runs WHERE id NOT IN (SELECT id FROM ch) UNION ALL SELECT id, status, af95_c FROM ch")
def registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).select("id", "status", "af95_c")
    changes = r.where("id % 10 = 3").select((F.col("id") + 10).alias("id"), F.lit("completed").alias("status"), F.round(F.col("af95_c") / 2, 4).alias("af95_c"))
    return registry.upserted(r, changes)


@query("registry_partial_update", "WITH " + RUNS + " SELECT id, CASE WHEN id % 6 = 1 THEN 'failed' ELSE status END AS status, CASE WHEN id % 6 = 1 THEN NULL ELSE af95_c END AS af95_c FROM runs")
def registry_partial_update(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).select("id", "status", "af95_c")
    changes = r.where("id % 6 = 1").select("id", F.lit("failed").alias("status"), F.lit(True).alias("set_status"), F.lit(None).cast("double").alias("af95_c"), F.lit(True).alias("set_af95_c"))
    return registry.patched(r, changes, ["status", "af95_c"])


@query("delete_availability", "WITH " + RUNS + ", b AS (SELECT id, CASE WHEN status IN ('queued', 'running') THEN status WHEN coalesce(asset_status, '') IN ('pending', 'running') THEN 'assets_in_progress' END AS block FROM runs) SELECT id, block IS NULL AS can_delete, block FROM b")
def delete_availability(spark: SparkSession, d: str) -> DataFrame:
    block = registry.delete_block(F.col("status"), F.col("asset_status"))
    return runs(spark, d).select("id", block.isNull().alias("can_delete"), block.alias("block"))


RECONCILED = RUNS + """,
r1 AS (SELECT *, status IN ('queued', 'running') AS active, has_summary AND coalesce(asset_status IN ('pending', 'running'), false) AS busy FROM runs),
r2 AS (SELECT *, CASE WHEN active AND has_summary AND has_csv THEN 'completed' WHEN active THEN 'failed' ELSE status END AS new_status FROM r1),
r3 AS (SELECT *, CASE WHEN busy AND in_flight THEN asset_status WHEN busy AND new_status = 'completed' AND assets_complete THEN 'completed' WHEN busy THEN 'failed' ELSE asset_status END AS new_asset_status,
  CASE WHEN active AND has_summary AND has_csv THEN 'run_completed' WHEN active THEN 'run_failed' END AS run_action FROM r2),
r4 AS (SELECT *, CASE WHEN busy AND in_flight THEN 'asset_skipped_in_flight' WHEN busy AND new_asset_status = 'completed' THEN 'asset_completed' WHEN busy THEN 'asset_failed' END AS asset_action FROM r3)
"""


@query("reconcile_runs", "WITH " + RECONCILED + " SELECT id, new_status, new_asset_status, run_action, asset_action FROM r4")
def reconcile_runs(spark: SparkSession, d: str) -> DataFrame:
    return registry.reconciled(runs(spark, d)).select("id", "new_status", "new_asset_status", "run_action", "asset_action")


@query("reconcile_counts", "WITH " + RECONCILED + " SELECT action, count(*) AS n FROM (SELECT run_action AS action FROM r4 UNION ALL SELECT asset_action FROM r4) WHERE action IS NOT NULL GROUP BY action")
def reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    return registry.reconcile_counts(registry.reconciled(runs(spark, d)))


REASONS = ("temperature_sync_missing", "body_mask_attachment_leak_fraction", "centerline_disagreement", "x_route_a_endpoint_instability", "axis_dynamic_range_too_small", "insufficient_kappa_points", "kappa_fit_not_monotonic_enough", "missing_high_temp_plateau")


def _reason() -> F.Column:
    out = F.lit(None).cast("string")
    for n, r in enumerate(REASONS):
        out = F.when(F.col("l_orderkey") % 11 == n, F.lit(r)).otherwise(out)
    return out


ENTRIES = """
entries AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'wire' ELSE 'braided' END AS family, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS alias,
  CASE l_suppkey % 5 WHEN 0 THEN 'formal_passed' WHEN 1 THEN 'provisional' WHEN 2 THEN 'formal_blocked' WHEN 3 THEN 'quicklook_only' END AS reportability_status,
  CASE l_orderkey % 11 """ + " ".join(f"WHEN {n} THEN '{r}'" for n, r in enumerate(REASONS)) + """ END AS gate_reason, l_orderkey * 10 + l_linenumber AS seq, l_partkey % 2 = 0 AS available, l_partkey % 3 = 0 AS selected_as_formal, l_partkey % 5 = 0 AS selected_as_primary,
  CASE WHEN l_orderkey % 4 > 0 THEN CAST(l_discount AS DECIMAL(18,4)) END AS abs_af95_error_c, CAST(l_tax AS DECIMAL(18,4)) AS abs_aftan_error_c, CAST(l_quantity AS DECIMAL(18,4)) AS fit_rmse, CAST(l_discount * l_quantity AS DECIMAL(18,4)) AS monotonic_violation_fraction FROM lineitem)
"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Line items as routes of benchmarks."""
    c = F.col
    status = F.when(c("l_suppkey") % 5 == 0, "formal_passed").when(c("l_suppkey") % 5 == 1, "provisional").when(c("l_suppkey") % 5 == 2, "formal_blocked").when(c("l_suppkey") % 5 == 3, "quicklook_only")
    number = lambda x: x.cast("decimal(18,4)")
    return _read(spark, d, "lineitem").select(
        F.when(c("l_returnflag") == "A", "wire").otherwise("braided").alias("family"), F.when(c("l_linenumber") % 3 == 0, "A").when(c("l_linenumber") % 3 == 1, "B").otherwise("C").alias("alias"), status.alias("reportability_status"), _reason().alias("gate_reason"),
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"), (c("l_partkey") % 2 == 0).alias("available"), (c("l_partkey") % 3 == 0).alias("selected_as_formal"), (c("l_partkey") % 5 == 0).alias("selected_as_primary"),
        F.when(c("l_orderkey") % 4 > 0, number(c("l_discount"))).alias("abs_af95_error_c"), number(c("l_tax")).alias("abs_aftan_error_c"), number(c("l_quantity")).alias("fit_rmse"), number(c("l_discount") * c("l_quantity")).alias("monotonic_violation_fraction"),
    )


_MEANS = ("abs_af95_error_c", "abs_aftan_error_c", "fit_rmse", "monotonic_violation_fraction")
ROLLUP = ENTRIES + """,
rc AS (SELECT family, alias, gate_reason, count(*) AS n, min(seq) AS seen FROM entries WHERE gate_reason <> '' GROUP BY ALL),
dom AS (SELECT family, alias, arg_max(gate_reason, struct_pack(n := n, s := -seen)) AS dominant_gate_reason FROM rc GROUP BY ALL),
roll AS (SELECT family, alias, count(*) AS benchmark_count, count(*) FILTER (available) AS available_count, """ + ", ".join(f"count(*) FILTER (coalesce(reportability_status, 'unrecorded') = '{s}') AS {s}_count" for s in suite.STATUSES) + ", count(*) FILTER (selected_as_formal) AS selected_as_formal_count, count(*) FILTER (selected_as_primary) AS selected_as_primary_count, " + ", ".join(f"round(CAST(sum({m}) AS DOUBLE) / count({m}), 3) AS mean_{m}" for m in _MEANS) + ", dominant_gate_reason FROM entries JOIN dom USING (family, alias) GROUP BY family, alias, dominant_gate_reason)"


def _rollup(spark: SparkSession, d: str) -> DataFrame:
    got = suite.rollup(entries(spark, d), ["family", "alias"], "seq")
    return got.withColumns({f"mean_{m}": F.round(F.col(f"mean_{m}").cast("double"), 3) for m in _MEANS})


@query("suite_rollup", "WITH " + ROLLUP + " SELECT * FROM roll")
def suite_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rollup(spark, d)


@query("family_side_by_side", "WITH " + ROLLUP + " SELECT alias, w.benchmark_count AS wire_benchmark_count, w.dominant_gate_reason AS wire_dominant_gate_reason, b.benchmark_count AS braided_benchmark_count, b.dominant_gate_reason AS braided_dominant_gate_reason FROM (SELECT * FROM roll WHERE family = 'wire') w FULL JOIN (SELECT * FROM roll WHERE family = 'braided') b USING (alias)")
def family_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    return suite.side_by_side(_rollup(spark, d), ["benchmark_count", "dominant_gate_reason"])


@query("gate_reason_label", "WITH " + ENTRIES + " SELECT gate_reason, CASE WHEN gate_reason IS NULL THEN NULL WHEN gate_reason LIKE '%temperature%' THEN 'temperature' WHEN gate_reason LIKE '%attachment%' OR gate_reason LIKE '%leak%' THEN 'attachment' WHEN gate_reason LIKE '%centerline%' THEN 'centerline' WHEN gate_reason LIKE '%endpoint%' THEN 'endpoint' WHEN gate_reason LIKE '%dynamic_range%' OR gate_reason LIKE '%too_small%' THEN 'range' WHEN gate_reason LIKE '%insufficient%' THEN 'points' WHEN gate_reason LIKE '%monotonic%' THEN 'monotonic' ELSE 'other' END AS label, count(*) AS n FROM entries GROUP BY ALL")
def gate_reason_label(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).groupBy("gate_reason", scalar.reason_label(F.col("gate_reason")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("sweep_summary", "WITH sv AS (SELECT CAST(p_size AS VARCHAR) AS variant, p_size, avg(CAST(p_retailprice AS DECIMAL(18,2))) AS price, CAST(p_size AS DOUBLE) AS size FROM part GROUP BY p_size), ln AS (SELECT variant, 'price' AS field, round(price, 4) AS value FROM sv UNION ALL SELECT variant, 'size', size FROM sv), bs AS (SELECT field, value AS base FROM ln WHERE variant = '11') SELECT field, round(max(value) - min(value), 3) AS spread, round(max(abs(value)), 3) AS max_abs, round(max(abs(value - base)), 3) AS baseline_max_delta FROM ln LEFT JOIN bs USING (field) GROUP BY field")
def sweep_summary(spark: SparkSession, d: str) -> DataFrame:
    v = _read(spark, d, "part").groupBy("p_size").agg((F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("price")).select("p_size", F.round("price", 4).alias("price"), F.col("p_size").cast("double").alias("size"), F.lit("text").alias("note"))
    got = suite.sweep_summary(v, "p_size", ["price", "size", "note"], "11")
    return got.select("field", *(F.round(c, 3).alias(c) for c in ("spread", "max_abs", "baseline_max_delta")))


MATCH = """
details AS (SELECT c_custkey AS seq, 'out/' || c_name AS output_dir, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS output_dir_name, c_mktsegment AS benchmark_name FROM customer),
srows AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'out/Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') WHEN o_orderkey % 3 = 1 THEN 'else/Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') ELSE '' END AS output_dir, CASE WHEN o_orderkey % 2 = 0 THEN 'MACHINERY' ELSE 'NONE' END AS benchmark_name FROM orders),
by1 AS (SELECT output_dir AS x, max(seq) AS s FROM details GROUP BY 1), by2 AS (SELECT output_dir_name AS x, max(seq) AS s FROM details WHERE output_dir_name IS NOT NULL GROUP BY 1), by3 AS (SELECT benchmark_name AS x, max(seq) AS s FROM details GROUP BY 1),
hits AS (SELECT r.*, coalesce(by1.s, by2.s, by3.s) AS detail_seq FROM srows r LEFT JOIN by1 ON r.output_dir <> '' AND by1.x = r.output_dir LEFT JOIN by2 ON r.output_dir <> '' AND by2.x = regexp_extract(r.output_dir, '([^/]*)/*$', 1) LEFT JOIN by3 ON by3.x = r.benchmark_name)
"""


def _matched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    details = _read(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.concat(F.lit("out/"), "c_name").alias("output_dir"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("output_dir_name"), F.col("c_mktsegment").alias("benchmark_name"))
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    k = F.col("o_orderkey")
    rows = _read(spark, d, "orders").select("o_orderkey", F.when(k % 3 == 0, F.concat(F.lit("out/"), name)).when(k % 3 == 1, F.concat(F.lit("else/"), name)).otherwise("").alias("output_dir"), F.when(k % 2 == 0, "MACHINERY").otherwise("NONE").alias("benchmark_name"))
    return suite.matched(rows, details), details


@query("fallback_lookup", "WITH " + MATCH + " SELECT o_orderkey, detail_seq FROM hits")
def fallback_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d)[0].select("o_orderkey", "detail_seq")


@query("suite_with_unused", "WITH " + MATCH + " SELECT source_kind, count(*) AS n, CAST(sum(detail_seq) AS BIGINT) AS total FROM (SELECT 'suite_summary' AS source_kind, detail_seq FROM hits UNION ALL SELECT 'analysis_metrics', seq FROM details WHERE seq NOT IN (SELECT detail_seq FROM hits WHERE detail_seq IS NOT NULL)) GROUP BY source_kind")
def suite_with_unused(spark: SparkSession, d: str) -> DataFrame:
    rows, details = _matched(spark, d)
    return suite.with_unused(rows, details).groupBy("source_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("detail_seq").alias("total"))


@query("truth_error", "WITH li AS (SELECT *, l_orderkey * 8 + l_linenumber AS frame FROM lineitem), truth AS (SELECT l_returnflag, frame, p_retailprice * l_quantity AS true_price FROM li JOIN part ON l_partkey = p_partkey) SELECT l_returnflag, round(avg(abs(l_extendedprice - true_price)), 2) AS price_mae FROM li JOIN truth USING (l_returnflag, frame) GROUP BY l_returnflag")
def truth_error(spark: SparkSession, d: str) -> DataFrame:
    li, p = _read(spark, d, "lineitem"), _read(spark, d, "part")
    frame = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("frame")
    truth = li.join(p, li.l_partkey == p.p_partkey).select("l_returnflag", frame, (F.col("p_retailprice") * F.col("l_quantity")).alias("true_price"))
    got = suite.truth_error(li.select("l_returnflag", frame, "l_extendedprice"), truth, ["l_returnflag"], {"l_extendedprice": "true_price"})
    return got.select("l_returnflag", F.round("l_extendedprice_mae", 2).alias("price_mae"))


@query("merged_routes", "WITH " + ENTRIES + ", ra AS (SELECT alias, max(fit_rmse) AS fit_rmse FROM entries WHERE family = 'wire' AND alias <> 'C' GROUP BY alias), ca AS (SELECT alias, min(fit_rmse) AS fit_rmse FROM entries WHERE family = 'braided' AND alias <> 'A' GROUP BY alias) SELECT alias, CAST(coalesce(ra.fit_rmse, ca.fit_rmse) AS DOUBLE) AS fit_rmse, ra.alias IS NOT NULL AS available FROM ra FULL JOIN ca USING (alias)")
def merged_routes(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d)
    r = e.where("family = 'wire' AND alias <> 'C'").groupBy("alias").agg(F.max("fit_rmse").cast("double").alias("fit_rmse"))
    c = e.where("family = 'braided' AND alias <> 'A'").groupBy("alias").agg(F.min("fit_rmse").cast("double").alias("fit_rmse"))
    return suite.merged_routes(r, c, ["fit_rmse"])


@query("roi_parse", """
WITH tx AS (SELECT event_id, k, CASE event_id % 5 WHEN 0 THEN '[' || k || ', 2, ' || (k + 30) || ', 40]' WHEN 1 THEN k || ',0,' || (60 - k) || ',9' WHEN 2 THEN '1,2,3' WHEN 3 THEN 'a,1,2,3' ELSE k || ',5,' || (k + 1) || ',50' END AS raw FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
sp AS (SELECT *, list_transform(string_split(regexp_replace(raw, '[\\[\\]\\s]', '', 'g'), ','), lambda x: TRY_CAST(x AS INTEGER)) AS a FROM tx),
er AS (SELECT *, CASE WHEN len(a) <> 4 THEN 'not_four_numbers' WHEN a[1] IS NULL OR a[2] IS NULL OR a[3] IS NULL OR a[4] IS NULL THEN 'not_integers' WHEN least(a[1], a[2], a[3], a[4]) < 0 THEN 'negative' WHEN a[1] >= a[3] OR a[2] >= a[4] THEN 'reversed' WHEN a[3] - a[1] < 2 OR a[4] - a[2] < 2 THEN 'too_small' END AS error FROM sp)
SELECT event_id, CASE WHEN error IS NULL THEN a[1] END AS x0, CASE WHEN error IS NULL THEN a[2] END AS y0, CASE WHEN error IS NULL THEN a[3] END AS x1, CASE WHEN error IS NULL THEN a[4] END AS y1, error FROM er""")
def roi_parse(spark: SparkSession, d: str) -> DataFrame:
    k, e = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    text = lambda *x: F.concat(*(v.cast("string") if not isinstance(v, str) else F.lit(v) for v in x))
    raw = F.when(e % 5 == 0, text("[", k, ", 2, ", k + 30, ", 40]")).when(e % 5 == 1, text(k, ",0,", 60 - k, ",9")).when(e % 5 == 2, "1,2,3").when(e % 5 == 3, "a,1,2,3").otherwise(text(k, ",5,", k + 1, ",50"))
    roi = scalar.parse_roi(F.col("raw"))
    return _read(spark, d, "events").select("event_id", raw.alias("raw")).withColumn("roi", roi).select("event_id", "roi.*")


@query("display_time", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS shown FROM orders")
def display_time(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "orders").select("o_orderkey", scalar.display_time(F.col("o_orderdate").cast("string")).alias("shown"))


@query("route_aliases", "SELECT preset, metric_key, CASE WHEN preset LIKE 'braided%' THEN CASE metric_key WHEN 'length_axis' THEN 'A' WHEN 'diameter_max' THEN 'B' WHEN 'area_proj' THEN 'C' END ELSE CASE metric_key WHEN 'x_route_a' THEN 'A' WHEN 'kappa_fit' THEN 'B' WHEN 'kappa_route_c' THEN 'C' END END AS alias, count(*) AS n FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'wire_like' WHEN 1 THEN 'demo' WHEN 2 THEN 'braided_like' ELSE 'braided_demo' END AS preset, CASE p_partkey % 7 WHEN 0 THEN 'x_route_a' WHEN 1 THEN 'kappa_fit' WHEN 2 THEN 'kappa_route_c' WHEN 3 THEN 'length_axis' WHEN 4 THEN 'diameter_max' WHEN 5 THEN 'area_proj' ELSE 'other' END AS metric_key FROM part) GROUP BY ALL")
def route_aliases(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.col("p_size") % 4, F.col("p_partkey") % 7
    preset = F.when(s == 0, "wire_like").when(s == 1, "demo").when(s == 2, "braided_like").otherwise("braided_demo")
    metric = F.when(k == 0, "x_route_a").when(k == 1, "kappa_fit").when(k == 2, "kappa_route_c").when(k == 3, "length_axis").when(k == 4, "diameter_max").when(k == 5, "area_proj").otherwise("other")
    rows = _read(spark, d, "part").select(preset.alias("preset"), metric.alias("metric_key"))
    return rows.groupBy("preset", "metric_key", scalar.route_alias(F.col("preset"), F.col("metric_key")).alias("alias")).agg(F.count(F.lit(1)).alias("n"))


@query("missing_outputs", "SELECT o_orderkey, array_to_string(list_filter(['analysis.csv', 'summary.json', 'route_results.csv'], lambda x: NOT list_contains(CASE o_orderkey % 4 WHEN 0 THEN ['analysis.csv'] WHEN 1 THEN ['summary.json', 'analysis.csv'] WHEN 2 THEN ['route_results.csv', 'summary.json', 'analysis.csv'] ELSE []::VARCHAR[] END, x)), ',') AS missing FROM orders")
def missing_outputs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    a = lambda *x: F.array(*(F.lit(v) for v in x)).cast("array<string>")
    existing = F.when(k == 0, a("analysis.csv")).when(k == 1, a("summary.json", "analysis.csv")).when(k == 2, a("route_results.csv", "summary.json", "analysis.csv")).otherwise(a())
    return _read(spark, d, "orders").select("o_orderkey", F.concat_ws(",", scalar.missing_outputs(a("analysis.csv", "summary.json", "route_results.csv"), existing)).alias("missing"))


_CURVES = ("route_recovery_vs_temperature.png", "kappa_vs_temperature.png", "quicklook_x_vs_time.png", "route_a_metric_over_time.png", "other.png")


def _curve_sql(names: tuple[str, ...]) -> str:
    return "CASE f " + " ".join(f"WHEN '{n}.png' THEN {k}" for k, n in enumerate(names)) + " ELSE 99 END"


@query("curve_priority", "SELECT p_partkey, f, CASE WHEN w THEN " + _curve_sql(registry.CURVES_WITH_TEMPERATURE) + " ELSE " + _curve_sql(registry.CURVES_WITHOUT) + " END AS rank FROM (SELECT p_partkey, p_size % 2 = 0 AS w, CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_CURVES)) + " END AS f FROM part)")
def curve_priority(spark: SparkSession, d: str) -> DataFrame:
    f = F.get(F.array(*(F.lit(c) for c in _CURVES)), (F.col("p_partkey") % 5).cast("int"))
    return _read(spark, d, "part").select("p_partkey", f.alias("f"), registry.curve_rank(f, F.col("p_size") % 2 == 0).alias("rank"))


@query("synth_schedule", "SELECT f AS frame, round(f / 20.0, 6) AS time_sec, round(20.0 + f * (45.0 / 479), 6) AS temperature_c FROM range(480) t(f)")
def synth_schedule(spark: SparkSession, d: str) -> DataFrame:
    return synthetic.schedule(spark, 20, 24.0, 20.0, 65.0).select("frame", R6("time_sec").alias("time_sec"), R6("temperature_c").alias("temperature_c"))


@query("synth_wire_truth", "WITH sc AS (SELECT f AS frame, 20.0 + f * (45.0 / 479) AS t FROM range(480) g(f)), ka AS (SELECT frame, 0.0045 + (0.00005 - 0.0045) / (1.0 + exp(-(t - 47.0) / 2.0)) AS kappa FROM sc), tp AS (SELECT frame, kappa, sum(cos(radians(90.0) + kappa * i * (400.0 / 159)) * (400.0 / 159)) AS dx, sum(sin(radians(90.0) + kappa * i * (400.0 / 159)) * (400.0 / 159)) AS dy FROM ka, range(160) s(i) GROUP BY ALL) SELECT frame, round(kappa, 8) AS kappa_true_px_inv, round(sqrt(dx * dx + dy * dy), 5) AS x_true_px FROM tp")
def synth_wire_truth(spark: SparkSession, d: str) -> DataFrame:
    got = synthetic.wire_truth(synthetic.schedule(spark, 20, 24.0, 20.0, 65.0))
    return got.select("frame", F.round("kappa_true_px_inv", 8).alias("kappa_true_px_inv"), F.round("x_true_px", 5).alias("x_true_px"))


_BRAID = "sc AS (SELECT f AS frame, 20.0 + f * (45.0 / 479) AS t FROM range(480) g(f)), sh AS (SELECT frame, 1.0 / (1.0 + exp(-(t - 47.0) / 2.0)) AS s FROM sc), pr AS (SELECT frame, i, i / 239.0 AS u, 520.0 - s * 110.0 AS len, 120.0 + s * 100.0 AS dia, 14.0 - s * 6.0 AS bow, radians(-1.5 + s * 3.5) AS th, 640.0 + s * 10.0 AS cx, 260.0 - s * 6.0 AS cy FROM sh, range(240) q(i))"


@query("synth_braided_profile", "WITH " + _BRAID + " SELECT frame, i AS sample, round(dia * CASE WHEN u <= 0.56 THEN sin(pi() / 2 * least(1.0, u / 0.56)) ** 0.88 ELSE sin(pi() / 2 * greatest(0.0, least(1.0, (1.0 - u) / (1.0 - 0.56)))) ** 1.06 END, 5) AS width_px, round(cx + (u - 0.5) * len * cos(th) - bow * sin(pi() * u) * sin(th), 5) AS x, round(cy + (u - 0.5) * len * sin(th) + bow * sin(pi() * u) * cos(th), 5) AS y FROM pr")
def synth_braided_profile(spark: SparkSession, d: str) -> DataFrame:
    got = synthetic.braided_profile(synthetic.braided_truth(synthetic.schedule(spark, 20, 24.0, 20.0, 65.0)))
    return got.select("frame", F.col("sample").cast("long").alias("sample"), *(F.round(c, 5).alias(c) for c in ("width_px", "x", "y")))


_ZONES = ("x_peak_norm", "landing_zone_left_px", "landing_zone_right_px", "transition_zone_left_px", "transition_zone_right_px", "compaction_zone_length_px", "zone_symmetry")
_PROFILE = ("length_axis_px", "length_axis_alt_px", "length_axis_definition_gap_px", "diameter_px", "diameter_p95_px", "diameter_peak_span_px", "area_proj_px2", *_ZONES)


@query("braided_truth_metrics", "WITH " + _BRAID + """,
pt AS (SELECT frame, i, dia * CASE WHEN u <= 0.56 THEN sin(pi() / 2 * least(1.0, u / 0.56)) ** 0.88 ELSE sin(pi() / 2 * greatest(0.0, least(1.0, (1.0 - u) / (1.0 - 0.56)))) ** 1.06 END AS width, cx + (u - 0.5) * len * cos(th) - bow * sin(pi() * u) * sin(th) AS x, cy + (u - 0.5) * len * sin(th) + bow * sin(pi() * u) * cos(th) AS y FROM pr),
ps AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM pt WINDOW w AS (PARTITION BY frame ORDER BY i)),
pa AS (SELECT *, sum(coalesce(step, 0.0)) OVER (PARTITION BY frame ORDER BY i ROWS UNBOUNDED PRECEDING) AS pos FROM ps),
pb AS (SELECT *, (width + lag(width) OVER w) / 2 * (pos - lag(pos) OVER w) AS part, max(width) OVER (PARTITION BY frame) AS top FROM pa WHERE width > 0.000000001 WINDOW w AS (PARTITION BY frame ORDER BY i)),
ax AS (SELECT frame, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a FROM pb GROUP BY frame),
pm AS (SELECT frame, max(pos) - min(pos) AS length_axis_px, max(x * cos(a) + y * sin(a)) - min(x * cos(a) + y * sin(a)) AS length_axis_alt_px, max(width) AS diameter_px, quantile_cont(width, 0.95) AS diameter_p95_px,
  max(pos) FILTER (width >= 0.95 * top) - min(pos) FILTER (width >= 0.95 * top) AS diameter_peak_span_px, sum(part) AS area_proj_px2,
  min(pos) AS a0, max(pos) AS a1, min(pos) FILTER (width = top) AS pk, min(pos) FILTER (width >= 0.35 * top) AS l, max(pos) FILTER (width >= 0.35 * top) AS r, min(pos) FILTER (width >= 0.9 * top) AS cl, max(pos) FILTER (width >= 0.9 * top) AS cr FROM pb JOIN ax USING (frame) GROUP BY frame),
pz AS (SELECT *, abs(length_axis_px - length_axis_alt_px) AS length_axis_definition_gap_px, (pk - a0) / (a1 - a0) AS x_peak_norm, l - a0 AS landing_zone_left_px, a1 - r AS landing_zone_right_px, cl - l AS transition_zone_left_px, r - cr AS transition_zone_right_px, cr - cl AS compaction_zone_length_px, 1.0 - abs((cl - a0) - (a1 - cr)) / (a1 - a0) AS zone_symmetry FROM pm)
SELECT frame, """ + ", ".join(f"{single_sql(c)} AS {c}" for c in _PROFILE) + " FROM pz")
def braided_truth_metrics(spark: SparkSession, d: str) -> DataFrame:
    points = synthetic.braided_profile(synthetic.braided_truth(synthetic.schedule(spark, 20, 24.0, 20.0, 65.0)))
    return geometry.profile_metrics(points, ["frame"], "sample").select("frame", *(single(c).alias(c) for c in _PROFILE))


@query("reported_value", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 END, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 2 END) AS reported FROM orders")
def reported_value(spark: SparkSession, d: str) -> DataFrame:
    from thermoline.operators.routes import reported_value as first

    k, v, none = F.col("o_orderkey"), F.col("o_totalprice"), F.lit(None).cast("double")
    return _read(spark, d, "orders").select("o_orderkey", first(F.when(k % 2 == 0, v), F.when(k % 3 == 0, v + 1), F.when(k % 5 == 0, v + 2), none, none).alias("reported"))


@query("merged_settings", "SELECT p_partkey, 'stride=' || (p_size % 3) || ';threshold=' || CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 145 END AS settings FROM part")
def merged_settings(spark: SparkSession, d: str) -> DataFrame:
    base = F.create_map(F.lit("threshold"), F.lit(145), F.lit("stride"), F.col("p_size") % 3)
    override = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("threshold"), F.col("p_size"))).otherwise(F.create_map().cast("map<string,int>"))
    merged = scalar.merge_maps(base, override)
    text = F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ";")
    return _read(spark, d, "part").select("p_partkey", text.alias("settings"))


#: Settings of an event over its own, by turns: none, one set to null, deep ones, an object in place of a text, a damaged text, new ones.
_OVERRIDES = ["'{}'", """'{"frame":{"stride":null}}'""", """'{"limits":{"high":{"b":{"c":true}}},"frame":5}'""", """concat('{"name":{"first":"', event_type, '"},"limits":{"high":{}}}')""", "'{broken'", """'{"new":{"list":[{"z":1}],"empty":{}}}'"""]
_MERGED = [
    """'{"frame":{"roi":[' || k || ',2],"stride":' || k % 7 || '},"limits":{"high":{"a":1,"b":"x"},"low":12},"name":"' || event_type || '"}'""",
    """'{"frame":{"roi":[' || k || ',2],"stride":null},"limits":{"high":{"a":1,"b":"x"},"low":12},"name":"' || event_type || '"}'""",
    """'{"frame":5,"limits":{"high":{"a":1,"b":{"c":true}},"low":12},"name":"' || event_type || '"}'""",
    """'{"frame":{"roi":[' || k || ',2],"stride":' || k % 7 || '},"limits":{"high":{"a":1,"b":"x"},"low":12},"name":{"first":"' || event_type || '"}}'""",
    """'{"frame":{"roi":[' || k || ',2],"stride":' || k % 7 || '},"limits":{"high":{"a":1,"b":"x"},"low":12},"name":"' || event_type || '"}'""",
    """'{"frame":{"roi":[' || k || ',2],"stride":' || k % 7 || '},"limits":{"high":{"a":1,"b":"x"},"low":12},"name":"' || event_type || '","new":{"empty":{},"list":[{"z":1}]}}'""",
]


@query("nested_settings", "SELECT event_id, CASE k % 6 " + " ".join(f"WHEN {n} THEN {t}" for n, t in enumerate(_MERGED)) + " END AS json FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def nested_settings(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    base = F.expr("""concat('{"name":"', event_type, '","limits":{"low":12,"high":{"b":"x","a":1}},"frame":{"stride":', k % 7, ',"roi":[', k, ',2]}}')""")
    over = F.expr("CASE k % 6 " + " ".join(f"WHEN {n} THEN {t}" for n, t in enumerate(_OVERRIDES)) + " END")
    return settings.merged_documents(rows.select("event_id", base.alias("base"), over.alias("over")), "event_id", "base", "over")


@query("safe_filenames", "SELECT p_partkey, regexp_replace('run_' || p_name || '_' || p_brand || '.mp4', '[^A-Za-z0-9._-]', '_', 'g') AS filename FROM part")
def safe_filenames(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("up/../run_"), "p_name", F.lit("_"), "p_brand", F.lit(".mp4"))
    return _read(spark, d, "part").select("p_partkey", scalar.safe_filename(name).alias("filename"))


_PATHS = ("runs/1/out.mp4", "a.PNG", "runs/../secret.csv", "/etc/x.json", "deep/a/b/c/d.png", "notes.txt", "a..b/c.jpg", "\\\\host/x.csv", "", "png", "..png/x.json", "a/b/c/d.mp4.exe")


@query("media_paths", "WITH paths AS (SELECT p_partkey, [" + ", ".join("'" + p + "'" for p in _PATHS) + "][p_partkey % 12 + 1] AS path FROM part) SELECT p_partkey, path, left(path, 1) NOT IN ('', '/', chr(92)) AND contains(path, '.') AND lower(string_split(path, '.')[-1]) IN ('mp4', 'png', 'csv', 'json', 'jpg') AND NOT list_contains(string_split(path, '/'), '..') AND len(string_split(path, '/')) <= 4 AS allowed FROM paths")
def media_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.get(F.array(*(F.lit(p) for p in _PATHS)), (F.col("p_partkey") % 12).cast("int"))
    return _read(spark, d, "part").select("p_partkey", path.alias("path"), scalar.media_path_allowed(path).alias("allowed"))


@query("quality_scores", "SELECT l_orderkey, l_linenumber, round(exp(-l_discount * 40 / 4.0) * (l_quantity / 50), 6) AS wire, round(greatest(0.0, least(1.0, 0.30 * (l_quantity / 50) + 0.25 * (1 - l_tax) + 0.20 * greatest(0.0, least(1.0, 1.0 - l_discount / 0.20)) + 0.15 * greatest(0.0, least(1.0, 1.0 - l_quantity / greatest(18.0, 0.10 * greatest(120.0, 1.0)))) + 0.10 * greatest(0.0, least(1.0, 1.0 - l_tax / 0.12)))), 6) AS braided FROM lineitem")
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    from thermoline.operators.geometry import braided_quality

    c = F.col
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R6(scalar.wire_quality(c("l_discount") * 40, c("l_quantity") / 50)).alias("wire"), R6(braided_quality(c("l_quantity") / 50, 1 - c("l_tax"), c("l_discount"), c("l_quantity"), F.lit(120.0), c("l_tax"))).alias("braided"))


@query("sweep_sensitivity", "WITH vr AS (SELECT unnest([137, 145, 153]) AS threshold) SELECT l_returnflag, threshold, count(*) FILTER (l_quantity * 4 > threshold) AS n FROM lineitem, vr GROUP BY ALL")
def sweep_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    variants = spark.createDataFrame([(137,), (145,), (153,)], "threshold int")
    rows = suite.sensitivity(_read(spark, d, "lineitem").select("l_returnflag", "l_quantity"), variants)
    return rows.groupBy("l_returnflag", "threshold").agg(F.count(F.when(F.col("l_quantity") * 4 > F.col("threshold"), 1)).alias("n"))


@query("summary_json", "SELECT id, '{\"id\":' || id || ',\"status\":\"' || status || '\"' || CASE WHEN asset_status IS NULL THEN '' ELSE ',\"asset_status\":\"' || asset_status || '\"' END || '}' AS json FROM (WITH " + RUNS + " SELECT id, status, asset_status FROM runs)")
def summary_json(spark: SparkSession, d: str) -> DataFrame:
    from thermoline.sources.files import to_json_rows

    return to_json_rows(runs(spark, d).select("id", "status", "asset_status"), "id")


@query("rounded_metrics", "SELECT o_orderkey, printf('%.6f', o_totalprice) AS o_totalprice FROM orders")
def rounded_metrics(spark: SparkSession, d: str) -> DataFrame:
    from thermoline.sources.files import rounded_metrics as texts

    return texts(_read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("fallback_statuses", "WITH " + ENTRIES + " SELECT seq, alias, CASE WHEN reportability_status IS NOT NULL THEN reportability_status WHEN gate_reason = 'temperature_sync_missing' THEN 'quicklook_only' WHEN gate_reason IS NOT NULL THEN 'formal_blocked' WHEN selected_as_formal THEN 'formal_passed' ELSE 'provisional' END AS status FROM entries")
def fallback_statuses(spark: SparkSession, d: str) -> DataFrame:
    from thermoline.operators.routes import fallback_status

    e = entries(spark, d)
    return e.select("seq", "alias", fallback_status(F.col("reportability_status"), F.col("gate_reason"), F.col("selected_as_formal")).alias("status"))


@query("filled_details", "WITH " + MATCH + ", dt AS (SELECT *, CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 3 = 1 THEN benchmark_name END AS route FROM details) SELECT o_orderkey, detail_seq, CASE WHEN coalesce(route, '') <> '' THEN route ELSE 'row ' || (o_orderkey % 5) END AS route, CASE WHEN detail_seq % 2 = 0 THEN 'detail' ELSE 'row' END AS warnings, CASE WHEN detail_seq % 4 = 0 THEN detail_seq * 1.5 ELSE o_orderkey * 0.5 END AS af95_c, h.output_dir AS demo_output FROM hits h JOIN dt ON dt.seq = h.detail_seq")
def filled_details(spark: SparkSession, d: str) -> DataFrame:
    rows, details = _matched(spark, d)
    seq, listed = F.col("detail_seq"), lambda word: F.array(F.lit(word))
    none = F.array().cast("array<string>")
    details = details.select(F.col("seq").alias("detail_seq"), F.col("benchmark_name").alias("name")).select("detail_seq", F.when(seq % 3 == 0, "").when(seq % 3 == 1, F.col("name")).alias("route"), F.when(seq % 2 == 0, listed("detail")).otherwise(none).alias("warnings"), F.when(seq % 4 == 0, seq * 1.5).alias("af95_c"))
    k = F.col("o_orderkey")
    rows = rows.select("detail_seq", "o_orderkey", "output_dir", F.concat(F.lit("row "), (k % 5).cast("string")).alias("route"), listed("row").alias("warnings"), (k * 0.5).alias("af95_c"))
    got = suite.filled(rows, details, "detail_seq")
    return got.select("o_orderkey", "detail_seq", "route", F.concat_ws(";", "warnings").alias("warnings"), "af95_c", "demo_output")


_NAMES = {1: "body_bins", 2: "skeleton", 3: "prior"}
PATHS = """
cd AS (SELECT l_orderkey AS frame, CASE l_linenumber """ + " ".join(f"WHEN {k} THEN '{n}'" for k, n in _NAMES.items()) + """ ELSE 'other ' || l_linenumber END AS candidate, CASE WHEN l_suppkey % 9 > 0 THEN l_quantity * 8 END AS length_px, (l_partkey % 40 + 60) * 0.5 AS axis_span_px, l_discount * 10 AS support FROM lineitem),
us AS (SELECT *, median(length_px) OVER (PARTITION BY frame) AS consensus, axis_span_px < 0.85 * max(axis_span_px) OVER (PARTITION BY frame) AS narrow, count(*) OVER (PARTITION BY frame) AS n FROM cd WHERE length_px > 0.000000001),
p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY narrow, CASE candidate WHEN 'body_bins' THEN 0 WHEN 'skeleton' THEN 1 WHEN 'prior' THEN 2 ELSE 99 END, abs(length_px - consensus) / greatest(consensus, 0.000000001), 1.0 - support, candidate, length_px) AS nth FROM us WHERE n >= 2) WHERE nth = 1),
p2 AS (SELECT * FROM (SELECT u.frame, u.candidate, row_number() OVER (PARTITION BY u.frame ORDER BY u.narrow, abs(u.length_px - p1.length_px) / greatest(p1.length_px, 0.000000001), 1.0 - u.support, CASE u.candidate WHEN 'skeleton' THEN 0 WHEN 'body_bins' THEN 1 WHEN 'prior' THEN 2 ELSE 99 END, u.candidate) AS nth FROM us u JOIN p1 ON p1.frame = u.frame AND p1.candidate <> u.candidate) WHERE nth = 1)
"""


@query("centerline_choice", "WITH " + PATHS + ' SELECT f.frame, p1.candidate AS "primary", p2.candidate AS secondary, p1.consensus AS consensus_length_px FROM (SELECT DISTINCT frame FROM cd) f LEFT JOIN p1 ON p1.frame = f.frame LEFT JOIN p2 ON p2.frame = f.frame')
def centerline_choice(spark: SparkSession, d: str) -> DataFrame:
    c, name = F.col, F.concat(F.lit("other "), F.col("l_linenumber").cast("string"))
    for k, n in _NAMES.items():
        name = F.when(F.col("l_linenumber") == k, n).otherwise(name)
    rows = _read(spark, d, "lineitem").select(c("l_orderkey").alias("frame"), name.alias("candidate"), F.when(c("l_suppkey") % 9 > 0, c("l_quantity") * 8).alias("length_px"), ((c("l_partkey") % 40 + 60) * 0.5).alias("axis_span_px"), (c("l_discount") * 10).alias("support"))
    return candidates.centerlines(rows, ["frame"])


@query("best_region", "WITH ex AS (SELECT l_orderkey AS frame, l_linenumber AS region, l_tax * 10 AS quality, l_quantity * 8 AS length_axis_px, l_extendedprice AS area_proj_px2, l_partkey % 5 AS attachment_count, l_quantity * l_discount AS endpoint_jump_px, l_discount AS centerline_disagreement FROM lineitem), sc AS (SELECT *, quality + 0.22 * (length_axis_px / greatest(max(length_axis_px) OVER w, 1.0)) + 0.08 * (area_proj_px2 / greatest(max(area_proj_px2) OVER w, 1.0)) - 0.05 * least(CAST(attachment_count AS DOUBLE), 3.0) - 0.08 * least(endpoint_jump_px / greatest(length_axis_px, 1.0), 1.0) - 0.05 * least(centerline_disagreement / 0.20, 1.0) AS score FROM ex WINDOW w AS (PARTITION BY frame)), rk AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, quality DESC, length_axis_px DESC, region) AS place FROM sc) SELECT frame, region, round(score, 6) AS score FROM rk WHERE place = 1")
def best_region(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = _read(spark, d, "lineitem").select(c("l_orderkey").alias("frame"), c("l_linenumber").alias("region"), (c("l_tax") * 10).alias("quality"), (c("l_quantity") * 8).alias("length_axis_px"), c("l_extendedprice").alias("area_proj_px2"), (c("l_partkey") % 5).alias("attachment_count"), (c("l_quantity") * c("l_discount")).alias("endpoint_jump_px"), c("l_discount").alias("centerline_disagreement"))
    return candidates.best_extraction(rows, ["frame"], "region").select("frame", "region", R6("score").alias("score"))
