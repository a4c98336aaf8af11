"""Batched fits, crossings and tangents against single curves."""

import numpy as np
import pytest

from thermoline.operators import fit


def curves(seed, runs=40):
    rng = np.random.default_rng(seed)
    ts, ys = [], []
    for k in range(runs):
        n = int(rng.integers(4, 120))
        t = np.sort(rng.uniform(20, 65, n))
        if k % 5 == 0 and n > 9:
            t[3] = t[4]  # equal temperatures
        ts.append(t)
        ys.append(rng.uniform(-5, 5) + rng.uniform(5, 60) / (1 + np.exp(-(t - rng.uniform(30, 55)) / rng.uniform(0.5, 6))) + rng.normal(size=n) * rng.choice([0, 0.1, 3]))
    off = np.concatenate([[0], np.cumsum([len(t) for t in ts])])
    return ts, ys, fit.Curves(np.concatenate(ts), np.concatenate(ys), off)


def loss(t, x, p):
    return float(((x - fit.sigmoid(t[None], p[None])[0]) ** 2).sum())


def test_a_batch_has_the_fits_of_its_curves():
    ts, ys, c = curves(1)
    p = fit.bounded_fits(c, c.y)
    for t, y, got in zip(ts, ys, p, strict=True):
        alone = fit.bounded_fits(fit.Curves(t, y, np.array([0, len(t)])), y[None])[0]
        assert loss(t, y, got) == pytest.approx(loss(t, y, alone), rel=1e-6, abs=1e-9)


def test_no_start_finds_smaller_squares_nearby():
    rng = np.random.default_rng(3)
    ts, ys, c = curves(2)
    for t, x, p in zip(ts, ys, fit.bounded_fits(c, c.y), strict=True):
        low, high = np.array([x.min() - 20, x.max() - 5, t.min(), 0.1]), np.array([x.min() + 20, x.max() + 80, t.max(), 20])
        assert (low <= p).all() and (p <= high).all()
        best = loss(t, x, p)
        for _ in range(200):
            other = np.clip(p + rng.normal(size=4) * np.array([1e-3, 1e-3, 1e-3, 1e-3]), low, high)
            assert loss(t, x, other) >= best * (1 - 1e-6) - 1e-12


def test_crossings_and_tangents():
    ts, ys, c = curves(4)
    r = np.clip(c.y / 30, 0, 1)
    af, tan = fit.crossings(c, r), fit.tangents(c, r)
    for k, t in enumerate(ts):
        y = np.clip(ys[k] / 30, 0, 1)
        over = np.flatnonzero(y >= 0.95)
        want = np.nan if not len(over) else t[0] if over[0] == 0 else t[over[0] - 1] + (0.95 - y[over[0] - 1]) / max(y[over[0]] - y[over[0] - 1], 1e-9) * (t[over[0]] - t[over[0] - 1])
        assert af[k] == pytest.approx(want, nan_ok=True)
        n = len(t)
        if n < 7:
            assert np.isnan(tan[k])
            continue
        window = min(n if n % 2 else n - 1, 11)
        half = window // 2
        smooth = np.empty(n)
        for i in range(n):
            at = min(max(i, half), n - 1 - half)
            j = np.arange(at - half, at + half + 1)
            smooth[i] = np.polyval(np.polyfit(j - at, y[j], 2), i - at)
        with np.errstate(all="ignore"):
            slope = np.gradient(smooth, t)
        slope[~np.isfinite(slope)] = -np.inf
        best = int(np.argmax(np.round(slope, 10)))
        want = t[best] + (np.median(smooth[int(0.85 * n) :]) - smooth[best]) / slope[best] if slope[best] > 1e-9 else np.nan
        assert tan[k] == pytest.approx(want, rel=1e-6, nan_ok=True)
