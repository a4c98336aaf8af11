"""Folds over runs by blocks against folds row by row."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermoline.operators import blocks, temporal
from thermoline.operators.temporal import Line


def fill(y):
    good = np.flatnonzero(np.isfinite(y))
    return y.copy() if not len(good) else np.interp(np.arange(len(y)), good, y[good])


def ema(y, alpha):
    out = []
    for v, a in zip(y, np.clip(alpha, 0, 1), strict=True):
        out.append(v if not out else a * v + (1 - a) * out[-1])
    return np.array(out)


def monotone(y, up=True):
    if not up:
        return -monotone(-y)
    pools = []
    for v in y:
        pools.append([v, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] > pools[-1][0] * pools[-2][1]:
            t, n = pools.pop()
            pools[-1] = [pools[-1][0] + t, pools[-1][1] + n]
    return np.concatenate([np.full(n, t / n) for t, n in pools]) if pools else y


def brute(y, alpha, up=None, angle=False):
    gone = ~np.isfinite(y)
    if gone.all():
        return np.full(len(y), np.nan)
    y = y.copy()
    if angle:
        y[~gone] = np.unwrap(y[~gone])
    y = fill(np.where(gone, np.nan, y))
    if alpha is not None:
        y = (ema(y, alpha) + ema(y[::-1], alpha[::-1])[::-1]) / 2
    if up is not None:
        y = monotone(y, up)
    return np.where(gone, np.nan, y)


def runs(seed=0):
    rng = np.random.default_rng(seed)
    for k, n in enumerate((1, 2, 7, 40, 200, 333)):
        y = np.linspace(0, 5, n) * (1 if k % 2 else -1) + rng.normal(size=n) * (0.05 if k % 3 else 3)
        if n > 5:
            y[rng.random(n) < 0.5] = np.nan
            y[10:60] = np.nan
        if k == 3:
            y[:] = np.nan
        frame = np.sort(rng.choice(3 * n, n, replace=False))
        yield k, frame, y, rng.uniform(-0.1, 1.1, n)


@pytest.fixture(scope="module")
def series(spark):
    parts = [pd.DataFrame({"run_id": k, "frame": f, "y": y, "angle": np.where(np.isnan(y), np.nan, np.mod(y * 3, 2 * math.pi) - math.pi), "a": a, "note": "x"}) for k, f, y, a in runs()]
    rows = spark.createDataFrame(pd.concat(parts)).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("y", "angle")})
    return rows, pd.concat(parts)


@pytest.mark.parametrize("frames", [5, 64, 4096])
@pytest.mark.parametrize("alpha", [None, "a"])
def test_lines_match_folds(series, monkeypatch, frames, alpha):
    monkeypatch.setattr(blocks, "FRAMES", frames)
    monkeypatch.setattr(blocks.blocked, "__defaults__", (frames,))
    rows, plain = series
    lines = [Line("s", "y"), Line("up", "y", increasing=True), Line("down", "y", increasing=False), Line("turned", "angle", angle=True)]
    got = temporal.smoothed(rows, lines, alpha).toPandas().sort_values(["run_id", "frame"])
    assert list(got.columns) == ["run_id", "frame", "y", "angle", "a", "note", "s", "up", "down", "turned"]
    assert len(got) == len(plain) and (got["note"] == "x").all()
    for k, part in plain.groupby("run_id"):
        mine = got[got["run_id"] == k]
        a = None if alpha is None else part["a"].to_numpy()
        for line, c, up, angle in (("s", "y", None, False), ("up", "y", True, False), ("down", "y", False, False), ("turned", "angle", None, True)):
            assert mine[line].to_numpy() == pytest.approx(brute(part[c].to_numpy(), a, up, angle), abs=1e-9, nan_ok=True), (k, line)


def test_scan():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 40, 30)
    at = np.concatenate([np.arange(n) for n in size])
    times, plus = rng.normal(size=len(at)), rng.normal(size=len(at))
    got = blocks.scan(times, plus, at)
    t = p = 0.0
    for k in range(len(at)):
        t, p = (times[k], plus[k]) if at[k] == 0 else (times[k] * t, times[k] * p + plus[k])
        assert (got[0][k], got[1][k]) == pytest.approx((t, p))


@pytest.mark.parametrize("rounds", [0, 1, 32])
def test_pools_of_segments(monkeypatch, rounds):
    monkeypatch.setattr(blocks, "ROUNDS", rounds)
    rng = np.random.default_rng(2)
    size = rng.integers(1, 60, 25)
    of = np.repeat(np.arange(25), size)
    y = rng.normal(size=len(of)) + np.where(of % 2, 1, -1) * np.arange(len(of)) * 0.01
    total, n, into = blocks.pooled(y, np.ones(len(y)), of)
    want = np.concatenate([monotone(y[of == k]) for k in range(25)])
    assert (total / n)[into] == pytest.approx(want)
    assert n.sum() == len(y)


def test_long_cascade_is_merged():
    y = np.append(np.arange(5000.0), -1e9)
    total, size, into = blocks.pooled(y, np.ones(5001), np.zeros(5001, int))
    assert len(total) == 1 and set(into) == {0}


def test_a_long_run_is_many_blocks_and_few_pools_meet(spark, monkeypatch):
    n = 20_000
    y = np.arange(n) + np.random.default_rng(3).normal(size=n) * 5
    df = spark.createDataFrame(pd.DataFrame({"run_id": 1, "frame": np.arange(n), "v": y})).repartition(7)
    monkeypatch.setattr(blocks.blocked, "__defaults__", (1000,))
    sent = []
    plain = blocks.settled
    monkeypatch.setattr(blocks, "settled", lambda *a: sent.append(plain(*a)) or sent[-1])
    got = temporal.isotonic(df, "v", "fitted").orderBy("frame").toPandas()["fitted"].to_numpy()
    assert got == pytest.approx(monotone(y))
    assert 0 < sent[0].count() < 600


def test_kernels_see_parts_of_a_batch():
    """Many short runs in one batch are many parts; a block is never cut."""
    import pyarrow as pa

    sizes = [3, 0, 5, 90, 1, 1, 60, 40]
    rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(range(sum(sizes))))
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), rows], ["run_id", "rows"]).slice(1)
    most, blocks.ROWS_AT_ONCE = blocks.ROWS_AT_ONCE, 60
    try:
        got = list(blocks.parts(batch))
    finally:
        blocks.ROWS_AT_ONCE = most
    assert [p.column("run_id").to_pylist() for p in got] == [[1, 2], [3], [4, 5], [6], [7]]
    assert sum((p.column("rows").to_pylist() for p in got), []) == batch.column("rows").to_pylist()
