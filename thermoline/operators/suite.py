"""Benchmark suites: matching suite rows with details, roll-ups by route, and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("formal_passed", "provisional", "formal_blocked", "quicklook_only", "unrecorded")

#: Most variants of a sweep.
MOST_VARIANTS = 1000


def _last_of(details: DataFrame, key: str) -> DataFrame:
    """Of details that share a key, the last by `seq`."""
    w = Window.partitionBy(key).orderBy(F.col("seq").desc())
    return details.where(F.col(key).isNotNull()).withColumn("back", F.row_number().over(w)).where("back = 1").drop("back")


def matched(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Each suite row with the `detail_seq` of its detail: by output folder, else folder name, else benchmark name."""
    out, found = rows, []
    for theirs, own in (("output_dir", F.col("output_dir")), ("output_dir_name", F.regexp_extract("output_dir", r"([^/]*)/*$", 1)), ("benchmark_name", F.col("benchmark_name"))):
        found.append(f"by_{theirs}")
        key = F.when(own != "", own)
        out = out.withColumn("match_key", key).join(_last_of(details, theirs).select(F.col(theirs).alias("match_key"), F.col("seq").alias(found[-1])), "match_key", "left").drop("match_key")
    return out.withColumn("detail_seq", F.coalesce(*found)).drop(*found)


def or_else(detail: Column, row: Column, kind: str = "string") -> Column:
    """The detail's value unless it is missing or an empty text, list or map."""
    if kind.startswith(("array", "map")):
        return F.when(F.size(detail) > 0, detail).otherwise(row)
    return F.coalesce(F.when(detail.cast("string") != "", detail), row)


#: Columns of a detail that fall back on one of its suite row by another name.
OTHER_NAMES = {"benchmark_description": "description", "demo_output": "output_dir"}


def filled(rows: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """One row for each suite row that has a detail: the detail, its missing or empty columns filled from the suite row."""
    kinds, own = dict(details.dtypes), [c for c in rows.columns if c != key]
    both = rows.select(key, *(F.col(c).alias(f"row_{c}") for c in own)).join(details.where(F.col(key).isNotNull()), key)
    out = {c: or_else(F.col(c), F.col(f"row_{c}"), kinds[c]) if c in kinds else F.col(f"row_{c}") for c in own}
    out |= {c: F.coalesce(out.get(c, F.col(c) if c in kinds else F.lit(None)), F.col(f"row_{other}")) for c, other in OTHER_NAMES.items() if other in own}
    return both.select(key, *(F.col(c) for c in details.columns if c != key and c not in out), *(v.alias(c) for c, v in out.items()))


def with_unused(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Suite rows, then the details that none of them uses."""
    left = details.join(rows.select(F.col("detail_seq").alias("seq")), "seq", "left_anti")
    return rows.withColumn("source_kind", F.lit("suite_summary")).unionByName(left.withColumn("source_kind", F.lit("analysis_metrics")).withColumn("detail_seq", F.col("seq")), allowMissingColumns=True)


def rollup(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Counts by status, means and the most frequent gate reason of each group; of equally frequent reasons the first seen."""
    status = F.coalesce("reportability_status", F.lit("unrecorded"))
    flag = lambda c: F.count(F.when(F.col(c), 1))
    out = entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("benchmark_count"), flag("available").alias("available_count"), *(F.count(F.when(status == s, 1)).alias(f"{s}_count") for s in STATUSES),
        flag("selected_as_formal").alias("selected_as_formal_count"), flag("selected_as_primary").alias("selected_as_primary_count"),
        F.avg("abs_af95_error_c").alias("mean_abs_af95_error_c"), F.avg("abs_aftan_error_c").alias("mean_abs_aftan_error_c"), F.avg("fit_rmse").alias("mean_fit_rmse"), F.avg("monotonic_violation_fraction").alias("mean_monotonic_violation_fraction"),
    )
    return out.join(most_common(entries, keys, "gate_reason", order).withColumnRenamed("gate_reason", "dominant_gate_reason"), keys, "left")


def most_common(entries: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group that is neither missing nor empty."""
    counts = entries.where((F.col(value).isNotNull()) & (F.col(value) != "")).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("seen"))).alias(value))


def side_by_side(rollups: DataFrame, columns: list[str]) -> DataFrame:
    """Wire and braided roll-ups of an alias in one row."""
    half = lambda kind: rollups.where(F.col("family") == kind).select("alias", *(F.col(c).alias(f"{kind}_{c}") for c in columns))
    return half("wire").join(half("braided"), "alias", "full_outer")


def sweep_summary(variants: DataFrame, key: str, fields: list[str], baseline: str) -> DataFrame:
    """Spread, largest size and largest distance from the baseline of each field, over values that are finite numbers."""
    numbers = [F.col(f).try_cast("double").alias(f) for f in fields]
    long = variants.select(F.col(key).cast("string").alias("variant"), *numbers).unpivot("variant", fields, "field", "value")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    base = long.where(F.col("variant") == baseline).groupBy("field").agg(F.max("value").alias("base"))
    out = long.join(base, "field", "left").groupBy("field")
    return out.agg((F.max("value") - F.min("value")).alias("spread"), F.max(F.abs("value")).alias("max_abs"), F.max(F.abs(F.col("value") - F.col("base"))).alias("baseline_max_delta"))


def sensitivity(series: DataFrame, variants: DataFrame) -> DataFrame:
    """The series once for each variant of a sweep; of variants, rows of settings, there may be MOST_VARIANTS, which are one literal of the plan."""
    rows = variants.limit(MOST_VARIANTS + 1).collect()
    if len(rows) > MOST_VARIANTS:
        raise ValueError(f"a sweep has {MOST_VARIANTS} variants at most")
    if not rows:
        return series.limit(0).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in variants.schema))
    each = F.array(*(F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in variants.schema)) for r in rows))
    return series.withColumn("variant_of_sweep", F.explode(each)).select(*series.columns, "variant_of_sweep.*")


def truth_error(measured: DataFrame, truth: DataFrame, keys: list[str], pairs: dict[str, str]) -> DataFrame:
    """Mean absolute error of each measured column against its truth, over frames that have both."""
    rows = measured.join(truth, [*keys, "frame"])
    return rows.groupBy(*keys).agg(*(F.avg(F.abs(F.col(m) - F.col(t))).alias(f"{m}_mae") for m, t in pairs.items()))


def merged_routes(routes: DataFrame, comparisons: DataFrame, columns: list[str]) -> DataFrame:
    """Routes and comparisons of an alias in one row, the route's value first."""
    r = routes.select("alias", *(F.col(c).alias(f"r_{c}") for c in columns), F.lit(True).alias("in_routes"))
    c = comparisons.select("alias", *(F.col(x).alias(f"c_{x}") for x in columns))
    return r.join(c, "alias", "full_outer").select("alias", *(F.coalesce(f"r_{x}", f"c_{x}").alias(x) for x in columns), F.coalesce("in_routes", F.lit(False)).alias("available"))
