"""Sigmoid fits and metric reports: each run's metric is one array, and all arrays of a batch are fitted at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT = "run_id long, metric_key string, increasing boolean, x_m double, x_a double, t0 double, width double, af95_c double, aftan_c double, fit_rmse double, monotonic_violation_fraction double, dynamic_range double, reason string"
#: A metric needs so many valid rows to be fitted.
LEAST_ROWS = 4
#: Values that are fitted together, padding counted, unless one curve has more.
TOGETHER = 1 << 17
#: Steps of a fit that lower its loss, and trials for one of them.
STEPS, TRIALS = 400, 30
# How far references may lie beyond the values (low and high), and the bounds of the width.
LOW_MARGIN, HIGH_MARGIN, WIDTH = (20.0, 20.0), (5.0, 80.0), (0.1, 20.0)


class Curves:
    """Curves of a batch in rows, each in order of temperature, padded with what `mask` leaves out."""

    def __init__(self, t: np.ndarray, y: np.ndarray, off: np.ndarray):
        self.n = np.diff(off)
        place = np.arange(int(self.n.max()))
        self.mask = place < self.n[:, None]
        take = np.minimum(off[:-1, None] + place, off[1:, None] - 1)  # padding repeats the last row
        self.t, self.y, self.rows = t[take], y[take], np.arange(len(self.n))

    def at(self, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        return x[self.rows, k]

    def least(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.mask, x, np.inf).min(axis=1)

    def most(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.mask, x, -np.inf).max(axis=1)

    def median(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of the values from place `first` on."""
        inside = self.mask & (np.arange(x.shape[1]) >= first[:, None])
        ordered, n = np.sort(np.where(inside, x, np.inf), axis=1), self.n - first
        return (self.at(ordered, (n - 1) // 2) + self.at(ordered, n // 2)) / 2


def _rise(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip((t - p[:, 2:3]) / p[:, 3:4], -700, 700)))


def sigmoid(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p[:, :1] + (p[:, 1:2] - p[:, :1]) * _rise(t, p)


def _solved(normal: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(normal, gradient[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return (np.linalg.pinv(normal) @ gradient[..., None])[..., 0]


def bounded_fits(c: Curves, x: np.ndarray) -> np.ndarray:
    """Damped least squares for (low, high, centre, width) of every curve, each step cut back to the bounds.

    A curve takes part until none of its trials lowers its loss, or the gain is nothing to it.
    """
    least, most, cold, hot = c.least(x), c.most(x), c.least(c.t), c.most(c.t)
    ones = np.ones(len(x))
    low = np.stack([least - LOW_MARGIN[0], most - HIGH_MARGIN[0], cold, WIDTH[0] * ones], axis=1)
    high = np.stack([least + LOW_MARGIN[1], most + HIGH_MARGIN[1], hot, WIDTH[1] * ones], axis=1)
    p = np.clip(np.stack([least, most, c.median(c.t, np.zeros(len(x), np.int64)), 2.0 * ones], axis=1), low, high)
    scale = np.maximum(most - least, 1e-12)[:, None]
    weight = c.mask / scale
    rest = (x - sigmoid(c.t, p)) * weight
    loss = (rest * rest).sum(axis=1)
    gradient, normal = np.zeros((len(x), 4)), np.zeros((len(x), 4, 4))
    damping, steps, trials = 1e-3 * ones, np.zeros(len(x), int), np.zeros(len(x), int)
    active, moved = np.arange(len(x)), np.arange(len(x))
    while len(active):
        if len(moved):
            t, q = c.t[moved], p[moved]
            z = _rise(t, q)
            slope = (q[:, 1:2] - q[:, :1]) * z * (1 - z) / q[:, 3:4]
            jac = np.stack([1 - z, z, -slope, -slope * (t - q[:, 2:3]) / q[:, 3:4]], axis=1) * weight[moved][:, None]
            gradient[moved] = (jac @ rest[moved][..., None])[..., 0]
            normal[moved] = jac @ jac.transpose(0, 2, 1)
        q, g, h = p[active], gradient[active], normal[active].copy()
        free = ~(((q <= low[active]) & (g < 0)) | ((q >= high[active]) & (g > 0)))
        own = np.einsum("kii->ki", h)
        own += damping[active][:, None] * (own + 1e-12)
        h *= free[:, :, None] & free[:, None, :]
        np.einsum("kii->ki", h)[~free] = 1.0
        trial = np.clip(q + _solved(h, np.where(free, g, 0.0)), low[active], high[active])
        left = (x[active] - sigmoid(c.t[active], trial)) * weight[active]
        less = (left * left).sum(axis=1)
        better = less < loss[active]
        moved = active[better]
        gain = loss[moved] - less[better]
        p[moved], rest[moved], loss[moved] = trial[better], left[better], less[better]
        damping[moved] = np.maximum(damping[moved] / 3, 1e-12)
        damping[active[~better]] *= 4
        steps[moved] += 1
        trials[moved] = 0
        trials[active[~better]] += 1
        done = np.zeros(len(x), bool)
        done[moved] = (gain <= 1e-15 * np.maximum(loss[moved], 1e-300)) | (steps[moved] >= STEPS)
        done |= trials >= TRIALS
        active, moved = active[~done[active]], moved[~done[moved]]
    return p


def crossings(c: Curves, r: np.ndarray, threshold: float = 0.95) -> np.ndarray:
    """As ordered.af_95, for every curve."""
    over = c.mask & (r >= threshold)
    k = over.argmax(axis=1)
    before = np.maximum(k - 1, 0)
    t, t0, r1, r0 = c.at(c.t, k), c.at(c.t, before), c.at(r, k), c.at(r, before)
    between = t0 + (threshold - r0) / np.maximum(r1 - r0, 1e-9) * (t - t0)
    return np.where(over.any(axis=1), np.where(k == 0, t, between), np.nan)


def tangents(c: Curves, r: np.ndarray) -> np.ndarray:
    """As ordered.af_tan, for every curve."""
    out = np.full(len(c.n), np.nan)
    half = (np.minimum(c.n - 1 + c.n % 2, 11) - 1) // 2
    smooth, place = np.zeros(r.shape), np.arange(r.shape[1])
    for m in np.unique(half[c.n >= 7]).tolist():
        rows = np.flatnonzero((half == m) & (c.n >= 7))
        near = np.clip(place, m, (c.n[rows] - 1 - m)[:, None])
        at, k = place - near, float(2 * m + 1)
        j = np.arange(-m, m + 1)
        s2, s4 = float((j**2).sum()), float((j**4).sum())
        for x in j.tolist():
            weight = (s4 - s2 * x * x + (k * x * x - s2) * at * at) / (k * s4 - s2 * s2) + x * at / s2
            smooth[rows] += r[rows[:, None], near + x] * weight
    enough = np.flatnonzero(c.n >= 7)
    if not len(enough):
        return out
    slope = np.full(r.shape, -np.inf)
    with np.errstate(all="ignore"):
        step = np.diff(smooth, axis=1) / np.diff(c.t, axis=1)
        gap, last = np.diff(c.t, axis=1), c.n - 1
        slope[:, 1:-1] = (gap[:, 1:] * step[:, :-1] + gap[:, :-1] * step[:, 1:]) / (gap[:, 1:] + gap[:, :-1])
    slope[enough, 0] = step[enough, 0]
    slope[enough, last[enough]] = step[enough, last[enough] - 1]
    slope = np.round(np.where(c.mask & np.isfinite(slope), slope, -np.inf), 10)
    best = slope.argmax(axis=1)
    with np.errstate(all="ignore"):
        steep = c.at(slope, best)
        found = c.at(c.t, best) + (c.median(smooth, (0.85 * c.n).astype(np.int64)) - c.at(smooth, best)) / steep
    good = (c.n >= 7) & (steep > 1e-9)
    out[good] = found[good]
    return out


def evaluated(c: Curves, up: np.ndarray) -> dict[str, np.ndarray]:
    """The numbers of the report of every curve, of four rows at least and two temperatures."""
    x = np.where(up[:, None], c.y, -c.y)
    p = bounded_fits(c, x)
    span = p[:, 1:2] - p[:, :1]
    with np.errstate(all="ignore"):
        r = np.where(np.abs(span) >= 1e-9, np.clip((x - p[:, :1]) / span, 0, 1), np.nan)
    off = np.where(c.mask, x - sigmoid(c.t, p), 0.0)
    wrong = (np.diff(x, axis=1) < 0) & c.mask[:, 1:]
    numbers = {"x_m": p[:, 0], "x_a": p[:, 1], "t0": p[:, 2], "width": p[:, 3], "af95_c": crossings(c, r), "aftan_c": tangents(c, r)}
    return numbers | {"fit_rmse": np.sqrt((off * off).sum(axis=1) / c.n), "monotonic_violation_fraction": wrong.sum(axis=1) / (c.n - 1), "dynamic_range": c.most(c.y) - c.least(c.y)}


def reports(long: DataFrame) -> DataFrame:
    """A row for each run and metric of (run_id, metric_key, increasing, frame, temperature_c, value).

    A shrinking metric is fitted on its negative. With fewer than four valid rows, or one
    temperature, the row has NULLs and the reason.
    """
    numbers = ["x_m", "x_a", "t0", "width", "af95_c", "aftan_c", "fit_rmse", "monotonic_violation_fraction", "dynamic_range"]

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            off = lists.offsets.to_numpy().astype(np.int64)
            rows = lists.values.slice(off[0], off[-1] - off[0])
            off = off - off[0]
            t, y = (rows.field(f).to_numpy(zero_copy_only=False) for f in ("t", "v"))
            n, up = np.diff(off), batch.column("increasing").to_numpy(zero_copy_only=False).astype(bool)
            few = n < LEAST_ROWS
            flat = ~few & (t[off[1:] - 1] <= t[off[:-1]])
            out = {c: np.full(len(n), np.nan) for c in numbers}
            order = np.flatnonzero(~few & ~flat)
            order = order[np.argsort(n[order], kind="stable")]
            at = 0
            while at < len(order):
                to = at + 1
                while to < len(order) and (to + 1 - at) * n[order[to]] <= TOGETHER:
                    to += 1
                some = order[at:to]
                place = np.concatenate([np.arange(off[k], off[k + 1]) for k in some.tolist()])
                for c, x in evaluated(Curves(t[place], y[place], np.concatenate([[0], np.cumsum(n[some])])), up[some]).items():
                    out[c][some] = np.where(np.isfinite(x), x, np.nan)
                at = to
            reason = pa.array(np.where(few, "insufficient_points", np.where(flat, "constant_temperature", None)).tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("metric_key"), batch.column("increasing"), *(pa.array(x, pa.float64(), from_pandas=True) for x in out.values()), reason], [c.split()[0] for c in REPORT.split(", ")])

    rows = long.where("temperature_c IS NOT NULL AND value IS NOT NULL")
    curve = F.array_sort(F.collect_list(F.struct(F.col("temperature_c").cast("double").alias("t"), F.col("frame").cast("long").alias("frame"), F.col("value").cast("double").alias("v"))))
    grouped = rows.groupBy(F.col("run_id").cast("long").alias("run_id"), "metric_key").agg(F.max("increasing").alias("increasing"), curve.alias("rows"))
    return grouped.select("run_id", "metric_key", "increasing", "rows").mapInArrow(evaluate, REPORT)


def residual_checks(long: DataFrame, found: DataFrame, part: float = 1e-4) -> DataFrame:
    """Whether reports hold against the rows: rmse as it is, and no reference, centre or width nearby, within its bounds, with smaller squares.

    A parameter is moved both ways by `part` of the range of values or temperatures, or of the width.
    """
    rows = long.where("temperature_c IS NOT NULL AND value IS NOT NULL").select("run_id", "metric_key", "temperature_c", F.when(F.col("increasing"), F.col("value")).otherwise(-F.col("value")).alias("x"))
    span = rows.groupBy("run_id", "metric_key").agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "temperature_c") for n, f in (("least", F.min), ("most", F.max))))
    known = found.where("x_m IS NOT NULL").select("run_id", "metric_key", "x_m", "x_a", "t0", "width", "fit_rmse").join(span, ["run_id", "metric_key"])
    step = {"x_m": F.col("most_x") - F.col("least_x"), "x_a": F.col("most_x") - F.col("least_x"), "t0": F.col("most_temperature_c") - F.col("least_temperature_c"), "width": F.col("width")}
    bounds = {"x_m": (F.col("least_x") - LOW_MARGIN[0], F.col("least_x") + LOW_MARGIN[1]), "x_a": (F.col("most_x") - HIGH_MARGIN[0], F.col("most_x") + HIGH_MARGIN[1]), "t0": (F.col("least_temperature_c"), F.col("most_temperature_c")), "width": (F.lit(WIDTH[0]), F.lit(WIDTH[1]))}
    base = {c: F.col(c) for c in step}
    tries = [base, *(base | {c: F.least(F.greatest(F.col(c) + sign * part * step[c], bounds[c][0]), bounds[c][1])} for c in step for sign in (1, -1))]
    known = known.withColumn("tries", F.array(*(F.struct(*(q[c].alias(c) for c in step)) for q in tries)))
    off = rows.join(known, ["run_id", "metric_key"]).select("run_id", "metric_key", "fit_rmse", "x", "temperature_c", F.posexplode("tries").alias("k", "q"))
    fitted = F.col("q.x_m") + (F.col("q.x_a") - F.col("q.x_m")) / (1.0 + F.exp(-(F.col("temperature_c") - F.col("q.t0")) / F.col("q.width")))
    sums = off.groupBy("run_id", "metric_key", "k").agg(F.max("fit_rmse").alias("fit_rmse"), F.avg((F.col("x") - fitted) * (F.col("x") - fitted)).alias("mean_square"))
    own = F.max(F.when(F.col("k") == 0, F.col("mean_square")))
    return sums.groupBy("run_id", "metric_key").agg((F.abs(F.sqrt(own) - F.max("fit_rmse")) <= 1e-9 * F.greatest(F.max("fit_rmse"), F.lit(1e-3))).alias("rmse_holds"), (F.min("mean_square") >= own * (1 - 1e-6) - 1e-18).alias("least_squares"))
