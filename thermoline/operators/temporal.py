"""Smoothing of a run in time: exponential averages both ways, monotone projection, and route C.

All are folds over a run's rows in order, done block by block: knots of missing values and
turns of angles are carried by windows over one row a block, averages are affine maps that
compose, and pools of the monotone projection are joined across blocks where they meet. No
task holds more of a run than some blocks, and the rows of a batch of blocks are one array.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from thermoline.functions.scalar import blend, polar, quality_alpha
from thermoline.operators import blocks
from thermoline.operators.blocks import KEY, Segments
from thermoline.operators.ordered import RUN, turn_fix
from thermoline.sources.staging import stored


@dataclass(frozen=True)
class Line:
    """A column to smooth: an angle is unwrapped first; `increasing` makes the result monotone."""

    name: str
    column: str
    angle: bool = False
    increasing: bool | None = None


def _turns(s: Segments, y: np.ndarray) -> np.ndarray:
    """What unwrapping adds to each angle of a block behind its first."""
    good = np.isfinite(y)
    before = s.last(good)
    before = np.where(s.at > 0, np.concatenate([[-1], before[:-1]]), -1) if len(y) else before
    step = np.where(good & (before >= 0), y - y[before], 0.0)
    wrapped = np.mod(step + math.pi, 2 * math.pi) - math.pi
    wrapped[(wrapped == -math.pi) & (step > 0)] = math.pi
    return np.where(np.abs(step) < math.pi, 0.0, wrapped - step)


def _knots(lines: list[Line]) -> Callable[[Segments], dict[str, np.ndarray]]:
    """Of each block: its rows, and the first and last value of each line with their places and the turns between."""

    def kernel(s: Segments) -> dict[str, np.ndarray]:
        out = {"n": s.size}
        for k, line in enumerate(lines):
            y = s.column(line.column)
            good = np.isfinite(y)
            first, last = s.next(good), s.last(good)
            tail = np.full(len(s.size), -1)
            full = s.size > 0
            tail[full] = last[s.off[1:][full] - 1]
            out |= {f"first_{k}": s.edge(first, y), f"first_at_{k}": s.edge(first, s.at), f"last_{k}": np.where(tail >= 0, y[tail] if len(y) else np.nan, np.nan), f"last_at_{k}": np.where(tail >= 0, s.at[tail] if len(y) else np.nan, np.nan)}
            out[f"turns_{k}"] = np.bincount(s.of, _turns(s, y), minlength=len(s.size)) if line.angle else np.zeros(len(s.size))
        return out

    return kernel


def _knot_carries(knots: DataFrame, lines: list[Line]) -> DataFrame:
    """What each block has to know of the others: rows before it and in all, the knots beside it, turns so far."""
    w = Window.partitionBy(RUN).orderBy("block")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    rows = knots.withColumns({"start": F.coalesce(F.sum("n").over(before), F.lit(0)), "whole": F.sum("n").over(Window.partitionBy(RUN))})
    for k, line in enumerate(lines):
        if line.angle:
            jump = turn_fix(F.col(f"first_{k}") - F.last(f"last_{k}", ignorenulls=True).over(before))
            rows = rows.withColumn(f"jump_{k}", F.coalesce(jump, F.lit(0.0)))
            turned = F.sum(f"jump_{k}").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(f"turns_{k}").over(before), F.lit(0.0))
        else:
            turned = F.lit(0.0)
        rows = rows.withColumn(f"turned_{k}", turned)
    for k in range(len(lines)):
        left = F.when(F.col(f"last_{k}").isNotNull(), F.struct((F.col("start") + F.col(f"last_at_{k}")).alias("at"), (F.col(f"last_{k}") + F.col(f"turned_{k}") + F.col(f"turns_{k}")).alias("v")))
        right = F.when(F.col(f"first_{k}").isNotNull(), F.struct((F.col("start") + F.col(f"first_at_{k}")).alias("at"), (F.col(f"first_{k}") + F.col(f"turned_{k}")).alias("v")))
        rows = rows.withColumns({f"left_{k}": F.last(left, ignorenulls=True).over(before), f"right_{k}": F.first(right, ignorenulls=True).over(after)})
    beside = [F.col(f"{side}_{k}.{x}").cast("double").alias(f"{side}_{x}_{k}") for k in range(len(lines)) for side in ("left", "right") for x in ("at", "v")]
    return rows.select(*KEY, F.col("start").cast("double").alias("start"), F.col("whole").cast("double").alias("whole"), *beside, *(f"turned_{k}" for k in range(len(lines))))


def _filled(s: Segments, k: int, line: Line) -> np.ndarray:
    """The line with its missing values between their neighbours by row; beyond the first and last value these hold."""
    y = s.column(line.column)
    if line.angle:
        y = y + s.sums(_turns(s, y)) + s.carry(f"turned_{k}")[s.of]
    good = np.isfinite(y)
    start = s.carry("start")[s.of]
    left, right = s.last(good), s.next(good)
    at0, v0, at1, v1 = (s.carry(f"{side}_{x}_{k}")[s.of] for side in ("left", "right") for x in ("at", "v"))
    here, row = start + s.at, np.flatnonzero(~good)
    if not len(row):
        return y
    at0, v0 = np.where(left >= 0, here[left], at0)[row], np.where(left >= 0, y[left], v0)[row]
    at1, v1 = np.where(right >= 0, here[right], at1)[row], np.where(right >= 0, y[right], v1)[row]
    between = v0 + (v1 - v0) * (here[row] - at0) / (at1 - at0)
    y = y.copy()
    y[row] = np.where(np.isnan(at1), v0, np.where(np.isnan(at0), v1, between))
    return y


def _maps(s: Segments, y: np.ndarray, alpha: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Each row as a map of the average before it, and of the average behind it; the first row of a run that way is constant."""
    times, here = 1.0 - alpha, s.carry("start")[s.of] + s.at
    ahead, back = here == 0, here == s.carry("whole")[s.of] - 1
    return (np.where(ahead, 0.0, times), np.where(ahead, y, alpha * y)), (np.where(back, 0.0, times), np.where(back, y, alpha * y))


def _composed(s: Segments, y: np.ndarray, alpha: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    (a, b), (c, d) = _maps(s, y, alpha)
    ahead = blocks.scan(a, b, s.at)
    times, plus = blocks.scan(c[::-1], d[::-1], (s.size[s.of] - 1 - s.at)[::-1])
    return ahead, (times[::-1], plus[::-1])


def _alpha(s: Segments, alpha: str) -> np.ndarray:
    return np.clip(s.column(alpha), 0.0, 1.0)


def _block_maps(lines: list[Line], alpha: str) -> Callable[[Segments], dict[str, np.ndarray]]:
    """Each block as a map of the averages that enter it, both ways."""

    def kernel(s: Segments) -> dict[str, np.ndarray]:
        out, a = {}, _alpha(s, alpha)
        head, tail = s.off[:-1], s.off[1:] - 1  # a block has a row at least
        for k, line in enumerate(lines):
            ahead, back = _composed(s, _filled(s, k, line), a)
            out |= {f"ahead_times_{k}": ahead[0][tail], f"ahead_plus_{k}": ahead[1][tail], f"back_times_{k}": back[0][head], f"back_plus_{k}": back[1][head]}
        return out

    return kernel


def _doubles(names: list[str], first: list[StructField]) -> StructType:
    return StructType([*first, *(StructField(n, DoubleType()) for n in names)])


def _entering(maps: DataFrame, lines: list[Line]) -> DataFrame:
    """The averages that enter each block, both ways."""
    n = range(len(lines))
    ways = F.array(*(F.struct(F.lit(way).alias("way"), (F.col("block") * (1 - 2 * way)).alias("nth"), *(F.col(f"{name}_{x}_{k}").alias(f"{x}_{k}") for k in n for x in ("times", "plus"))) for way, name in enumerate(("ahead", "back"))))
    got = blocks.states(maps.select(RUN, "block", F.inline(ways)), [str(k) for k in n])
    return got.groupBy(*KEY).agg(*(F.max(F.when(F.col("way") == way, F.col(f"in_{k}"))).alias(f"{name}_{k}") for k in n for way, name in enumerate(("ahead", "back"))))


def smoothed(df: DataFrame, lines: list[Line], alpha: str | None, finish: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]] = lambda x: x, outputs: list[str] | None = None) -> DataFrame:
    """The rows with a smoothed column for each line.

    Missing values (NULL, NaN, infinite) are filled, the line is averaged both ways with the rows'
    weights `alpha` (left as it is where that is None) and made monotone if it says so; rows
    that had no value have none again. `finish` makes the columns `outputs` of those of the lines.
    """
    cut = blocks.blocked(df)
    key = [cut.schema[c] for c in KEY]
    n = range(len(lines))
    names = ["n", *(f"{x}_{k}" for k in n for x in ("first", "first_at", "last", "last_at", "turns"))]
    found = blocks.over_blocks(cut, lambda s: {c: x.astype(float) for c, x in _knots(lines)(s).items()}, _doubles(names, key))
    table = blocks.with_carry(cut, stored(_knot_carries(found, lines), "carries"))
    if alpha is not None:
        maps = blocks.over_blocks(table, _block_maps(lines, alpha), _doubles([f"{way}_{x}_{k}" for k in n for way in ("ahead", "back") for x in ("times", "plus")], key))
        table = blocks.with_carry(table, _entering(maps, lines))

    def averaged(s: Segments) -> list[np.ndarray]:
        out = []
        for k, line in enumerate(lines):
            y = _filled(s, k, line)
            if alpha is not None:
                ahead, back = _composed(s, y, _alpha(s, alpha))
                enters = [np.where(np.isnan(x), 0.0, x)[s.of] for x in (s.carry(f"ahead_{k}"), s.carry(f"back_{k}"))]  # the first block takes nothing up
                y = (ahead[0] * enters[0] + ahead[1] + back[0] * enters[1] + back[1]) / 2.0
            out.append(y)
        return out

    def finished(s: Segments, ys: list[np.ndarray]) -> dict[str, np.ndarray]:
        gone = [~np.isfinite(s.column(line.column)) for line in lines]
        return finish({line.name: np.where(g, np.nan, y) for line, y, g in zip(lines, ys, gone, strict=True)})

    outputs = outputs or [line.name for line in lines]
    schema = StructType([*df.schema.fields, *(StructField(c, DoubleType()) for c in outputs)])
    slopes = [(k, line.increasing) for k, line in enumerate(lines) if line.increasing is not None]
    if not slopes:
        return blocks.to_rows(table, lambda s: finished(s, averaged(s)), schema)

    def pools(s: Segments) -> dict[str, pa.Array]:
        ys = averaged(s)
        out: dict[str, pa.Array] = {f"y_{k}": s.lists(y) for k, y in enumerate(ys)}
        for k, up in slopes:
            good = np.flatnonzero(np.isfinite(ys[k]))
            total, size, _ = blocks.pooled(ys[k][good] * (1 if up else -1), np.ones(len(good)), s.of[good])
            rows = np.bincount(s.of[good], minlength=len(s.size))
            ends = np.searchsorted(np.cumsum(size), np.cumsum(np.concatenate([[0], rows])), "right" if len(size) else "left")
            off = pa.array(np.minimum(ends, len(size)), pa.int32())
            out |= {f"total_{k}": pa.ListArray.from_arrays(off, pa.array(total)), f"size_{k}": pa.ListArray.from_arrays(off, pa.array(size))}
        return {"rows": s.batch.column("rows"), **out}

    made = ", ".join([*(f"y_{k} array<double>" for k in n), *(f"{x}_{k} array<double>" for k, _ in slopes for x in ("total", "size"))])
    held = stored(blocks.over_blocks(table, pools, StructType([*key, cut.schema["rows"], *StructType.fromDDL(made).fields])), "pools")
    moved = blocks.settled(held, [str(k) for k, _ in slopes])
    moved = moved.groupBy(*KEY).agg(F.collect_list(F.struct("line", "pool", "mean")).alias("moved"))

    def monotone(s: Segments) -> dict[str, np.ndarray]:
        ys = [s.batch.column(f"y_{k}").flatten().to_numpy(zero_copy_only=False) for k in n]
        lists = s.batch.column("moved")
        of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False))
        line, pool, mean = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
        for at, (k, up) in enumerate(slopes):
            sizes = s.batch.column(f"size_{k}")
            total, size = s.batch.column(f"total_{k}").flatten().to_numpy(), sizes.flatten().to_numpy()
            first = sizes.offsets.to_numpy() - sizes.offsets.to_numpy()[0]
            means, some = total / size, line == at
            means[first[of[some]] + pool[some]] = mean[some]
            good = np.flatnonzero(np.isfinite(ys[k]))
            ys[k] = ys[k].copy()
            ys[k][good] = np.repeat(means * (1 if up else -1), size.astype(np.int64))
        return finished(s, ys)

    return blocks.to_rows(blocks.with_carry(held, moved), monotone, schema)


def bidirectional_ema(df: DataFrame, value: str, alpha: str, name: str) -> DataFrame:
    """The mean of the averages forwards and backwards, over rows that all have a value."""
    return smoothed(df, [Line(name, value)], alpha)


def isotonic(df: DataFrame, value: str, name: str, increasing: bool = True) -> DataFrame:
    """Least squares among monotone sequences."""
    return smoothed(df, [Line(name, value, increasing=increasing)], None)


def regularized(df: DataFrame, value: str, alpha: str, name: str, increasing: bool | None = None) -> DataFrame:
    """Filled, smoothed and, unless `increasing` is None, made monotone; missing rows stay missing."""
    return smoothed(df, [Line(name, value, increasing=increasing)], alpha)


def regularized_angle(df: DataFrame, value: str, alpha: str, name: str) -> DataFrame:
    return smoothed(df, [Line(name, value, angle=True)], alpha)


@dataclass(frozen=True)
class RouteC:
    blend_route_a: float = 0.2
    alpha: float = 0.35
    alpha_floor: float = 0.08
    monotone_length: bool = True
    monotone_curvature: bool = True


ROUTE_C_COLUMNS = ["route_c_anchor_x", "route_c_anchor_y", "route_c_tip_x", "route_c_tip_y", "route_c_axis_theta_rad", "x_route_c_px", "kappa_route_c_px_inv"]


def route_c(series: DataFrame, config: RouteC = RouteC()) -> DataFrame:
    """The series with the seven columns of route C.

    Endpoints of routes A and B are mixed, then the anchor, the polar length and angle of the
    tip and the curvature are smoothed with weights that follow quality.
    """
    mixed = {f"mix_{e}_{c}": blend(F.col(f"route_a_{e}_{c}"), F.col(f"{e}_{c}"), config.blend_route_a) for e in ("anchor", "tip") for c in "xy"}
    rows = series.withColumns(mixed | {"mix_alpha": quality_alpha(F.col("quality"), config.alpha, config.alpha_floor)})
    length, theta = polar(F.col("mix_tip_x") - F.col("mix_anchor_x"), F.col("mix_tip_y") - F.col("mix_anchor_y"))
    rows = rows.withColumns({"mix_length": length, "mix_theta": theta})

    lines = [Line("x0", "mix_anchor_x"), Line("y0", "mix_anchor_y"), Line("far", "mix_length", increasing=True if config.monotone_length else None), Line("angle", "mix_theta", angle=True), Line("bent", "kappa_fit_px_inv", increasing=False if config.monotone_curvature else None)]

    def finish(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        tip = x["x0"] + x["far"] * np.cos(x["angle"]), x["y0"] + x["far"] * np.sin(x["angle"])
        return dict(zip(ROUTE_C_COLUMNS, (x["x0"], x["y0"], *tip, x["angle"], x["far"], x["bent"]), strict=True))

    return smoothed(rows, lines, "mix_alpha", finish, ROUTE_C_COLUMNS).select(*series.columns, *ROUTE_C_COLUMNS)
