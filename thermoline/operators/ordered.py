"""Operators over a run's rows in order.

All windows are partitioned by run, so one shuffle by run serves any chain of them. Where a
step depends on the number of rows of a run, that is a count over the same window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from thermoline.functions.scalar import distance

RUN = "run_id"


def in_frames() -> WindowSpec:
    return Window.partitionBy(RUN).orderBy("frame")


def by_temperature() -> WindowSpec:
    """Ties in temperature are broken by frame."""
    return Window.partitionBy(RUN).orderBy("temperature_c", "frame")


def jump(x: str, y: str, w: WindowSpec) -> Column:
    """Distance to the row before; NULL in the first."""
    return distance(F.lag(x).over(w), F.lag(y).over(w), F.col(x), F.col(y))


def rolling_median(c: str, w: WindowSpec, window: int = 7, size: Column | None = None) -> Column:
    """Centred rolling median, cut off at the edges. A run shorter than the window uses the largest odd window that fits; under three rows nothing changes.

    A row's neighbours are fetched by their distance and sorted: one window serves all of them.
    """
    n = size if size is not None else F.count(F.lit(1)).over(Window.partitionBy(RUN))
    half, x = window // 2, F.col(c).cast("double")
    reach = F.when(n < 3, 0).otherwise(F.least(F.lit(half), F.floor((n - 1) / 2)))
    near = [x, *(F.when(reach >= k, f(x, k).over(w)) for k in range(1, half + 1) for f in (F.lag, F.lead))]
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return F.get(F.transform(F.array(F.array_sort(F.array_compact(F.array(*near)))), middle), F.lit(0))


def moving_average(c: str, w: WindowSpec, window: int) -> Column:
    """Moving average with the first and last values repeated beyond the edges."""
    half = window // 2
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank, n = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    before, after = F.greatest(F.lit(0), half + 1 - rank), F.greatest(F.lit(0), rank + half - n)
    return (F.sum(c).over(w.rowsBetween(-half, half)) + before * F.first(c).over(whole) + after * F.last(c).over(whole)) / (2 * half + 1)


def smoothed_path(df: DataFrame, x: str, y: str, window: int = 5) -> DataFrame:
    """The path of each run with its points averaged along it; rows without a point, and paths of under three, stay as they are."""
    valid = F.col(x).isNotNull() & F.col(y).isNotNull()
    part = Window.partitionBy(RUN, valid)
    enough = valid & (F.count(F.lit(1)).over(part) >= 3)
    return df.withColumns({c: F.when(enough, moving_average(c, part.orderBy("frame"), window)).otherwise(F.col(c)) for c in (x, y)})


def arc_length(x: str, y: str, w: WindowSpec) -> Column:
    """Length of the path up to each row; summed as decimals, so that it is the same in any order of merging."""
    return F.sum(F.coalesce(F.col("step"), F.lit(0.0)).cast("decimal(30,9)")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")


def with_arc_length(df: DataFrame, x: str, y: str, w: WindowSpec | None = None, name: str = "arc_length") -> DataFrame:
    """Rows without a point are passed over."""
    w = w or in_frames()
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("step", jump(x, y, w)).withColumn(name, arc_length(x, y, w)).drop("step")


def resample(df: DataFrame, columns: list[str], at: str, step: float) -> DataFrame:
    """The polyline at multiples of `step` along `at`, and at its end."""
    w = Window.partitionBy(RUN).orderBy(at)
    ahead = df.select(RUN, at, *columns, F.lead(at).over(w).alias("to"), *(F.lead(c).over(w).alias(f"{c}_to") for c in columns), F.max(at).over(Window.partitionBy(RUN)).alias("total"))
    spans = ahead.where((F.col("to") > F.col(at)) | F.col("to").isNull())
    inside = F.expr(f"CASE WHEN `to` IS NULL THEN array(`{at}`) WHEN ceil(`{at}` / {step}) * {step} < `to` THEN transform(sequence(ceil(`{at}` / {step}), ceil(`to` / {step}) - 1), k -> k * {step}D) ELSE array() END")
    points = spans.withColumn("resampled_at", F.explode(inside))
    share = F.coalesce((F.col("resampled_at") - F.col(at)) / (F.col("to") - F.col(at)), F.lit(0.0))
    return points.select(RUN, F.col("resampled_at").cast("double").alias(at), *((F.col(c) + share * F.coalesce(F.col(f"{c}_to") - F.col(c), F.lit(0.0))).alias(c) for c in columns))


def plot_values(value: str, recovery: str | None = None) -> Column:
    """What a plot shows of a run's rows: their recovery where the run has any, else the value between its least and largest; half where these are one."""
    w = Window.partitionBy(RUN)
    low, high = F.min(value).over(w), F.max(value).over(w)
    share = F.when(F.col(value).isNull(), F.lit(None)).when(high - low > 1e-9, (F.col(value) - low) / F.greatest(high - low, F.lit(1e-9))).otherwise(F.lit(0.5))
    return share if recovery is None else F.when(F.count(recovery).over(w) > 0, F.col(recovery)).otherwise(share)


def fill_linear(c: str, w: WindowSpec | None = None) -> Column:
    """Over the place `row_at` of each row. Missing values on the line between their neighbours by row; beyond the first and last value these hold."""
    w = w or in_frames()
    point = F.when(F.col(c).isNotNull(), F.struct(F.col("row_at").alias("at"), F.col(c).alias("v")))
    before = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    between = before["v"] + (after["v"] - before["v"]) * (F.col("row_at") - before["at"]) / F.when(after["at"] > before["at"], after["at"] - before["at"])
    return F.coalesce(F.col(c), between, before["v"], after["v"])


def filled(df: DataFrame, c: str, name: str, w: WindowSpec | None = None) -> DataFrame:
    w = w or in_frames()
    return df.withColumn("row_at", F.row_number().over(w)).withColumn(name, fill_linear(c, w)).drop("row_at")


def turn_fix(turn: Column) -> Column:
    """What makes a step between angles one of at most half a turn."""
    tau = 2 * math.pi
    wrapped = turn + math.pi - tau * F.floor((turn + math.pi) / tau) - math.pi
    wrapped = F.when((wrapped == -math.pi) & (turn > 0), F.lit(math.pi)).otherwise(wrapped)
    return F.when(F.abs(turn) < math.pi, F.lit(0.0)).otherwise(wrapped - turn)


def unwrapped(df: DataFrame, c: str, name: str, w: WindowSpec | None = None) -> DataFrame:
    """An angle without jumps of more than half a turn; rows without an angle are passed over."""
    w = w or in_frames()
    rows = df.where(F.col(c).isNotNull()).withColumn("turn", F.col(c) - F.lag(c).over(w))
    total = F.sum(F.coalesce(turn_fix(F.col("turn")), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.col(c) + total).drop("turn")


def first_last_recovery(df: DataFrame, c: str, name: str, w: WindowSpec | None = None) -> DataFrame:
    """Recovery between the values of the first and the last row."""
    from thermoline.functions.scalar import recovery_ratio

    whole = (w or in_frames()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(name, recovery_ratio(F.col(c), F.first(c).over(whole), F.last(c).over(whole)))


def foreshortening(c: str) -> Column:
    """1 less the share of the run's largest value; NULL where that is no more than nothing."""
    top = F.max(c).over(Window.partitionBy(RUN))
    return F.when(top > 1e-9, 1.0 - F.col(c) / top)


def af_95(df: DataFrame, recovery: str, threshold: float = 0.95) -> DataFrame:
    """Temperature at which recovery first reaches the threshold, one row a run; NULL where it never does."""
    w = by_temperature()
    rows = df.where(F.col(recovery).isNotNull() & F.col("temperature_c").isNotNull())
    rows = rows.select(RUN, "temperature_c", F.col(recovery).alias("r"), F.row_number().over(w).alias("nth"), F.lag(recovery).over(w).alias("r0"), F.lag("temperature_c").over(w).alias("t0"))
    t = F.col("temperature_c")
    cross = F.when(F.col("nth") == 1, t).otherwise(F.col("t0") + (threshold - F.col("r0")) / F.greatest(F.col("r") - F.col("r0"), F.lit(1e-9)) * (t - F.col("t0")))
    return rows.groupBy(RUN).agg(F.min(F.when(F.col("r") >= threshold, F.struct("nth", cross.alias("at"))))["at"].alias("af95_c"))


#: Runs of fewer rows have no tangent.
TANGENT_ROWS = 7


#: Largest half of a smoothing window.
SMOOTH_HALF = 5


def _weight(j: Column, at: Column, m: Column) -> Column:
    """Of the j-th of 2m + 1 places -m to m in quadratic least squares read at place `at`: from the sums of 1, j**2 and j**4."""
    k, s2 = 2.0 * m + 1.0, m * (m + 1.0) * (2.0 * m + 1.0) / 3.0
    s4 = m * (m + 1.0) * (2.0 * m + 1.0) * (3.0 * m * m + 3.0 * m - 1.0) / 15.0
    return (s4 - s2 * j * j + (k * j * j - s2) * at * at) / (k * s4 - s2 * s2) + j * at / s2


def smoothed(df: DataFrame, value: str) -> DataFrame:
    """Valid rows of runs in order of temperature with their Savitzky-Golay smoothing: (run, frame, t, v, i, n, smooth).

    Order 2, at most 11 rows; rows near an edge are read off the first and last window. A row takes its
    neighbours by their distance, each with a weight by its place, so no run is held as a whole.
    Runs of under seven rows are left out.
    """
    w, run = by_temperature(), Window.partitionBy(RUN)
    rows = df.where(F.col(value).isNotNull() & F.col("temperature_c").isNotNull()).select(RUN, "frame", "temperature_c", F.col("temperature_c").alias("t"), F.col(value).cast("double").alias("v"), (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(run).alias("n"))
    rows = rows.where(F.col("n") >= TANGENT_ROWS).withColumn("m", F.floor((F.least(F.col("n") - 1 + F.col("n") % 2, F.lit(2 * SMOOTH_HALF + 1)) - 1) / 2).cast("double"))
    rows = rows.withColumn("at", F.col("i") - F.least(F.greatest(F.col("i").cast("double"), F.col("m")), F.col("n") - 1 - F.col("m")))
    reach = 2 * SMOOTH_HALF
    rows = rows.withColumn("near", F.array(*(F.lag("v", -k).over(w) if k < 0 else F.lead("v", k).over(w) if k else F.col("v") for k in range(-reach, reach + 1))))
    term = lambda v, k: F.when(F.abs(k - reach + F.col("at")) <= F.col("m"), v * _weight(k - reach + F.col("at"), F.col("at"), F.col("m"))).otherwise(0.0)
    return rows.withColumn("smooth", F.aggregate(F.transform("near", term), F.lit(0.0), lambda s, x: s + x)).drop("near", "at", "m")


def with_slope(rows: DataFrame) -> DataFrame:
    """Second-order gradient of `smooth` on the run's own grid `t`; NULL between equal temperatures."""
    w = by_temperature()
    back, ahead = F.col("t") - F.lag("t").over(w), F.lead("t").over(w) - F.col("t")
    fall, rise = F.col("smooth") - F.lag("smooth").over(w), F.lead("smooth").over(w) - F.col("smooth")
    rows = rows.withColumns({"back": back, "ahead": ahead, "fall": fall, "rise": rise})
    inner = F.expr("try_divide(back * back * rise + ahead * ahead * fall, back * ahead * (back + ahead))")
    slope = F.when(F.col("back").isNull(), F.expr("try_divide(rise, ahead)")).when(F.col("ahead").isNull(), F.expr("try_divide(fall, back)")).otherwise(inner)
    return rows.withColumn("slope", slope).drop("back", "ahead", "fall", "rise")


def af_tan(df: DataFrame, recovery: str) -> DataFrame:
    """Where the steepest tangent of the smoothed recovery meets its plateau, one row a run.

    Slopes equal in ten digits count as ties, and the first place wins.
    """
    rows = with_slope(smoothed(df, recovery))
    steep = F.max_by(F.struct("t", "smooth", "slope"), F.when(F.col("slope").isNotNull(), F.struct(F.round("slope", 10).alias("s"), (-F.col("i")).alias("place"))))
    upper = F.percentile(F.when(F.col("i") >= F.floor(0.85 * F.col("n")), F.col("smooth")), F.lit(0.5))
    found = rows.groupBy(RUN).agg(steep.alias("best"), upper.alias("upper"))
    m = F.col("best.slope")
    found = found.select(RUN, F.when(m > 1e-9, F.col("best.t") + (F.col("upper") - F.col("best.smooth")) / m).alias("aftan_c"))
    return df.select(RUN).distinct().join(found, RUN, "left")


def prepared(df: DataFrame) -> DataFrame:
    """Frames as whole numbers from 0, one row each, the first by `seq`; with the median step and rate of the run."""
    rows = df.withColumn("frame", F.col("frame").try_cast("long")).where("frame >= 0")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(RUN, "frame").orderBy("seq"))).where("nth = 1").drop("nth")
    w = in_frames()
    rows = rows.withColumn("step", F.col("frame") - F.lag("frame").over(w)).withColumn("dt", F.col("time_sec") - F.lag("time_sec").over(w))
    run = Window.partitionBy(RUN)
    rows = rows.withColumn("stride", F.greatest(F.lit(1.0), F.coalesce(F.percentile(F.when(F.col("step") > 0, F.col("step")), F.lit(0.5)).over(run), F.lit(1.0))))
    return rows.withColumn("fps", F.col("stride") / F.percentile(F.when(F.col("dt") > 0, F.col("dt")), F.lit(0.5)).over(run)).drop("step", "dt")


def even_sample(df: DataFrame, most: int, w: WindowSpec | None = None) -> DataFrame:
    """At most `most` rows of each run, evenly spaced, the first and last among them."""
    w = w or in_frames()
    rows = df.withColumn("at", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(RUN)))
    # A row is taken if some k of 0 to most - 1 has floor(k (n - 1) / (most - 1)) = at.
    k = F.ceil(F.col("at") * (most - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    taken = (k <= most - 1) & (F.floor(k * (F.col("n") - 1) / (most - 1)) == F.col("at"))
    return rows.where((F.col("n") <= most) | taken).drop("at", "n")
