"""Choosing among several extractions of one frame: rankings over candidate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermoline.operators.dealing import dealt

# Which path is preferred as a frame's centerline, and as the one beside it; the share of the widest span that one must have.
PRIMARY = ("body_bins", "skeleton", "prior")
SECONDARY = ("skeleton", "body_bins", "prior")
LEAST_SPAN = 0.85
# Weights of an extraction's score, the most attachments that count, and the disagreement that counts as a whole.
SCORE = {"length": 0.22, "area": 0.08, "attachment": 0.05, "jump": 0.08, "disagreement": 0.05}
MOST_ATTACHMENTS, WHOLE_DISAGREEMENT = 3.0, 0.20


def _preference(names: tuple[str, ...]) -> Column:
    out = F.lit(99)
    for place, name in enumerate(names):
        out = F.when(F.col("candidate") == name, F.lit(place)).otherwise(out)
    return out


def _off(length: Column, other: Column) -> Column:
    """How far two lengths are apart, as a share of the second."""
    return F.abs(length - other) / F.greatest(other, F.lit(1e-9))


def centerlines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The primary and the secondary centerline of each frame, from `candidate`, `length_px`, `axis_span_px` and `support`.

    Candidates without a length don't count, and a frame with fewer than two others gets NULLs.
    Those of too small a span are chosen only where nothing else is left, but still count in the
    median length that decides between equals. Names break the last ties, and lengths where a
    name comes twice. One shuffle by key.
    """
    rows = dealt(rows, *keys)
    whole = Window.partitionBy(*keys)
    usable = F.col("length_px") > 1e-9
    rows = rows.where(F.col("candidate").isNotNull()).withColumn("usable", F.coalesce(usable & ~F.isnan("length_px") & (F.col("length_px") != float("inf")), F.lit(False)))
    only = lambda c: F.when(F.col("usable"), F.col(c))
    rows = rows.withColumns({"usable_count": F.count(only("length_px")).over(whole), "consensus_length_px": F.percentile(only("length_px"), F.lit(0.5)).over(whole), "widest": F.max(only("axis_span_px")).over(whole)})
    rows = rows.withColumns({"narrow": F.coalesce(F.col("axis_span_px") < LEAST_SPAN * F.col("widest"), F.lit(True)), "bare": 1.0 - F.coalesce("support", F.lit(0.0))})
    first = whole.orderBy(F.desc("usable"), "narrow", _preference(PRIMARY), _off(F.col("length_px"), F.col("consensus_length_px")), "bare", "candidate", "length_px")
    rows = rows.withColumn("best", F.first(F.struct("candidate", "length_px")).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    other = F.when(F.col("usable") & (F.col("candidate") != F.col("best.candidate")), F.struct("narrow", _off(F.col("length_px"), F.col("best.length_px")).alias("off"), "bare", _preference(SECONDARY).alias("place"), "candidate"))
    got = rows.groupBy(*keys).agg(F.max("usable_count").alias("n"), F.first("best").alias("best"), F.min(other).alias("other"), F.max("consensus_length_px").alias("consensus_length_px"))
    told = F.col("n") >= 2
    return got.select(*keys, F.when(told, F.col("best.candidate")).alias("primary"), F.when(told, F.col("other.candidate")).alias("secondary"), F.when(told, F.col("consensus_length_px")).alias("consensus_length_px"))


def extraction_score(longest: Column, largest: Column) -> Column:
    """Score of an extraction beside others of its frame, whose greatest length and area are given."""
    c, one = F.col, F.lit(1.0)
    length = F.greatest(c("length_axis_px"), one)
    gains = SCORE["length"] * (c("length_axis_px") / F.greatest(longest, one)) + SCORE["area"] * (c("area_proj_px2") / F.greatest(largest, one))
    losses = SCORE["attachment"] * F.least(c("attachment_count").cast("double"), F.lit(MOST_ATTACHMENTS)) + SCORE["jump"] * F.least(c("endpoint_jump_px") / length, one) + SCORE["disagreement"] * F.least(c("centerline_disagreement") / WHOLE_DISAGREEMENT, one)
    return c("quality") + gains - losses


def best_extraction(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the extractions of each frame, one for each region tried, the best by score, quality and length; then the first in order."""
    whole = Window.partitionBy(*keys)
    scored = rows.withColumn("score", extraction_score(F.max("length_axis_px").over(whole), F.max("area_proj_px2").over(whole)))
    w = whole.orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("quality"), F.desc_nulls_last("length_axis_px"), order)
    return scored.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
