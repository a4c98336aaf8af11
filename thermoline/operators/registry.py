"""The registry of runs: latest, counts, upserts, and what a restart or a delete may do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("queued", "running")
ACTIVE_ASSETS = ("pending", "running")


def latest(runs: DataFrame, n: int) -> DataFrame:
    """The n latest runs; of equal times the larger id first."""
    return runs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def status_counts(runs: DataFrame, n: int = 200) -> DataFrame:
    """Over the latest n: all, and by status; running counts queued ones too."""
    count = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return latest(runs, n).agg(F.count(F.lit(1)).alias("total"), count("completed").alias("completed"), count(*ACTIVE).alias("running"), count("failed").alias("failed"))


def upserted(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of `changes` in place of those with their id, new ones added; columns that either lacks are NULL."""
    return runs.join(changes.select("id"), "id", "left_anti").unionByName(changes, allowMissingColumns=True)


def patched(runs: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """`set_<column>` says whether a change sets the column, to NULL as well; unset ones stay."""
    c = changes.select("id", *(F.col(x).alias(f"new_{x}") for x in columns), *(F.col(f"set_{x}") for x in columns))
    rows = runs.join(c, "id", "left")
    own = {x: F.when(F.coalesce(f"set_{x}", F.lit(False)), F.col(f"new_{x}")).otherwise(F.col(x)).alias(x) for x in columns}
    return rows.select(*(own.get(x, F.col(x)) for x in runs.columns))


def delete_block(status: Column, asset_status: Column) -> Column:
    """Why a run can't be deleted, NULL if it can."""
    return F.when(status == "queued", "queued").when(status == "running", "running").when(F.coalesce(asset_status, F.lit("")).isin(*ACTIVE_ASSETS), "assets_in_progress")


def reconciled(runs: DataFrame) -> DataFrame:
    """What a restart makes of each run, from has_summary, has_csv, asset_status, in_flight, assets_complete.

    An active run whose results are there is completed, else it failed. Assets that were in
    progress are left if they still are, else completed if all are there and the run is, else failed.
    """
    active = F.col("status").isin(*ACTIVE)
    done = F.col("has_summary") & F.col("has_csv")
    status = F.when(active & done, "completed").when(active, "failed").otherwise(F.col("status"))
    busy = F.col("has_summary") & F.coalesce(F.col("asset_status").isin(*ACTIVE_ASSETS), F.lit(False))
    asset = F.when(busy & F.col("in_flight"), F.col("asset_status")).when(busy & (F.col("new_status") == "completed") & F.col("assets_complete"), "completed").when(busy, "failed").otherwise(F.col("asset_status"))
    action = F.when(busy & F.col("in_flight"), "asset_skipped_in_flight").when(busy & (F.col("new_asset_status") == "completed"), "asset_completed").when(busy, "asset_failed")
    rows = runs.withColumn("new_status", status).withColumn("new_asset_status", asset)
    return rows.withColumn("run_action", F.when(active & done, "run_completed").when(active, "run_failed")).withColumn("asset_action", action)


def reconcile_counts(rows: DataFrame) -> DataFrame:
    each = rows.select(F.explode(F.array_compact(F.array("run_action", "asset_action"))).alias("action"))
    return each.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


#: Which curves come first, with a temperature log and without.
CURVES_WITH_TEMPERATURE = ("route_recovery_vs_temperature", "recovery_vs_temperature", "kappa_vs_temperature", "route_b_metric_over_time", "route_a_metric_over_time", "route_c_metric_over_time", "direction_recovery_vs_temperature", "direction_metric_over_time", "direction_centerline_recovery_vs_temperature", "direction_centerline_metric_over_time", "direction_mask_recovery_vs_temperature", "direction_mask_metric_over_time")
CURVES_WITHOUT = ("route_b_metric_over_time", "route_a_metric_over_time", "route_c_metric_over_time", "quicklook_x_vs_time", "quicklook_kappa_vs_time", "direction_metric_over_time", "direction_centerline_metric_over_time", "direction_mask_metric_over_time")


def curve_rank(filename: Column, with_temperature: Column) -> Column:
    """Rank of a curve's file; unknown ones are last, by name."""

    def of(names: tuple[str, ...]) -> Column:
        at = F.array_position(F.array(*(F.lit(f"{n}.png") for n in names)), filename)
        return F.when(at > 0, at - 1).otherwise(F.lit(99))

    return F.when(with_temperature, of(CURVES_WITH_TEMPERATURE)).otherwise(of(CURVES_WITHOUT)).cast("int")
