"""Geometry of frames: an object becomes slices across its axis, and everything after that is sums over a frame's slices.

A frame is a row with its gray pixels. Small Arrow helpers draw synthetic frames, cut a frame's
object into slices and sum them up, a few frames at once as arrays; what follows from the sums
are column expressions. A frame is drawn and measured by one worker, so frames spread over the
cluster and no pixel leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoline.operators import geometry

FRAME = ["run_id", "frame"]
#: Pixels that are at least this dark belong to the object.
THRESHOLD = 128
#: A component of fewer pixels is noise.
LEAST_PIXELS = 30
#: Pixels of frames, and columns of pixels that meet discs and spans, that are one array.
PIXELS_AT_ONCE, COLUMNS_AT_ONCE = 1 << 21, 1 << 14


def blurred(gray: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, a direction at a time; the edge is carried on."""
    reach = max(1, round(3 * sigma))
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    for axis in (0, 1):
        wide, n = np.pad(gray, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge"), gray.shape[axis]
        gray = sum(w * wide.take(range(k, k + n), axis=axis) for k, w in enumerate(weight / weight.sum()))
    return gray


def _pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of things in order, of `most` in all, or of one that is larger."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        till = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, till)
        at = till


def _each(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ranges of n from `begin`, and which range each is of."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) + np.repeat(begin - (np.cumsum(n) - n), n)


def _walked(steps: np.ndarray, size: np.ndarray, start: float) -> np.ndarray:
    """Where each step of each line leads to from `start`."""
    there = np.arange(int(size.max(initial=0))) < size[:, None]
    wide = np.zeros(there.shape)
    wide[there] = steps
    return start + np.cumsum(wide, axis=1)[there]


def _near(x: np.ndarray, y: np.ndarray, c: dict[str, np.ndarray]) -> np.ndarray:
    """Whether pixels lie within their spans, by their distances."""
    px, py = x - c["x"], y - c["y"]
    s = np.clip((px * c["dx"] + py * c["dy"]) / np.maximum(c["dx"] * c["dx"] + c["dy"] * c["dy"], 1e-9), 0, 1)
    return np.hypot(px - s * c["dx"], py - s * c["dy"]) <= (c["t"] + s * (c["t_end"] - c["t"])) / 2


def _discs(col: np.ndarray, c: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Where columns enter and leave discs, surely and perhaps."""
    px = col - c["x"]
    sure = c["r2"] - px * px
    near, far = np.sqrt(sure), np.sqrt(sure + c["more"])
    return [c["y"] - near, c["y"] + near, c["y"] - far, c["y"] + far]


def _sides(col: np.ndarray, c: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Where columns enter and leave what lies between the ends of spans, surely and perhaps. Spans go down."""
    px = col - c["x"]
    along = px * c["dx"]
    begin, end = (-c["lap"] - along) / c["dy"], (c["l2"] + c["lap"] - along) / c["dy"]
    rise, run = c["reach"] + c["grow"] * along, px * c["turn"]
    low, high = (run - rise) / c["low"], (rise + run) / c["high"]
    return [c["y"] + v for v in (np.maximum(begin, low), np.minimum(end, high), np.maximum(begin, low - c["more_low"]), np.minimum(end, high + c["more_high"]))]


def _inside(x: np.ndarray, y: np.ndarray, t: np.ndarray, size: np.ndarray, height: int, width: int) -> np.ndarray:
    """Of each polyline, of `size` points, the pixels within half its thickness, which runs evenly between its points: (line, y, x).

    It is made of discs around points and of what lies between the ends of spans. A column of pixels
    meets each in an interval, whose ends are enough to draw it. Where a hair's breadth decides
    whether a pixel lies within, its distances from the spans do.
    """
    if not len(x):
        return np.zeros((len(size), height, width), bool)
    of = np.repeat(np.arange(len(size)), size)
    joined = np.append(of[1:] == of[:-1], False)
    a = np.flatnonzero(joined)
    b = a + 1
    dx, dy, l2 = (np.zeros(len(x)) for _ in range(3))
    dx[a], dy[a] = x[b] - x[a], y[b] - y[a]
    l2[a] = dx[a] * dx[a] + dy[a] * dy[a]
    span = {"x": x, "y": y, "dx": dx, "dy": dy, "t": t, "t_end": np.append(t[1:], 0.0)}
    scale = np.abs(x) + np.abs(y) + np.abs(t)
    scale = 1 + height + width + scale + np.append(scale[1:], 0.0) + np.append(0.0, scale[:-1])
    hair = 1e-9 * scale
    # A disc lies within a span that isn't narrower at its other end, or within two that are one straight line.
    whole, long = np.zeros(len(x), bool), l2[a] >= 1e-9
    whole[a] = (t[b] >= t[a]) & long
    whole[b] |= (t[a] >= t[b]) & long
    straight = np.flatnonzero((l2[1:] >= 1e-9) & (l2[:-1] >= 1e-9)) + 1
    whole[straight] |= (dx[straight - 1] * dy[straight] == dy[straight - 1] * dx[straight]) & (dx[straight - 1] * dx[straight] + dy[straight - 1] * dy[straight] > 0)
    # By row, line and column; a row more, for intervals that end at the edge.
    most = 2 * int(size.max(initial=0))
    ends = np.zeros(len(size) * (height + 1) * width, np.int8 if most < 1 << 7 else np.int32)
    told, open_ = [], []

    def tell(k: np.ndarray, col: np.ndarray, begin: np.ndarray, n: np.ndarray) -> None:
        for piece in _pieces(n, COLUMNS_AT_ONCE):
            j, row = _each(begin[piece], n[piece])
            at, place = k[piece][j], col[piece][j]
            hit = _near(place, row, {name: v[at] for name, v in span.items()})
            told.append(((row * len(size) + of[at]) * width + place)[hit])

    def draw(parts: np.ndarray, x0: np.ndarray, x1: np.ndarray, c: dict[str, np.ndarray], meet: Callable, spans: tuple[int, ...]) -> None:
        with np.errstate(invalid="ignore"):
            x0, x1 = np.clip(np.floor(x0), 0, width), np.clip(np.ceil(x1), -1, width - 1)
            some = np.flatnonzero(x1 >= x0)
        x0, n, parts = x0[some].astype(np.int64), (x1[some] - x0[some]).astype(np.int64) + 1, parts[some]
        for piece in _pieces(n, COLUMNS_AT_ONCE):
            j, col = _each(x0[piece], n[piece])
            j += piece.start
            with np.errstate(all="ignore"):
                first, last, least, greatest = meet(col, {name: np.repeat(v[some[piece]], n[piece]) for name, v in c.items()})
            first, least = (np.maximum(np.ceil(v, out=v), 0, out=v) for v in (first, least))
            last, greatest = (np.minimum(np.floor(v, out=v), height - 1, out=v) for v in (last, greatest))
            at, sure = of[parts[j]] * width + col, first <= last
            k = np.flatnonzero(sure)
            for v, more, sign in ((first, 0, 1), (last, 1, -1)):
                np.add.at(ends, at[k] + (v[k].astype(np.int64) + more) * (len(size) * width), ends.dtype.type(sign))
            k = np.flatnonzero((least <= greatest) & ~(sure & (least == first) & (greatest == last)))
            if len(k):
                begin = np.concatenate([least[k], np.where(sure[k], last[k] + 1, 0)])
                end = np.concatenate([np.where(sure[k], first[k], greatest[k] + 1), np.where(sure[k], greatest[k] + 1, 0)])
                open_.extend((np.tile(parts[j[k]], 2) + by, np.tile(col[k], 2), begin.astype(np.int64), (end - begin).astype(np.int64)) for by in spans)

    with np.errstate(all="ignore"):
        k = np.flatnonzero(whole & (t >= 0))
        r = t[k] / 2
        near = np.maximum(r - hair[k], -1.0)
        # What of a disc lies beside a span that isn't narrower at its other end is within the span, or within what is kept of the disc there.
        left, right = -t / 2, t / 2
        for j, to_x, to_y, wide in ((a, dx[a], dy[a], t[b] >= t[a]), (b, -dx[a], -dy[a], t[a] >= t[b])):
            cut = t[j] / 2 * np.abs(to_y) / np.sqrt(l2[a])
            right[j] = np.where(wide & long & (to_x > 0), np.minimum(right[j], cut), right[j])
            left[j] = np.where(wide & long & (to_x < 0), np.maximum(left[j], -cut), left[j])
        draw(k, x[k] + left[k], x[k] + right[k], {"x": x[k], "y": y[k], "r2": near * np.abs(near), "more": 4 * np.maximum(r, hair[k]) * hair[k]}, _discs, (-1, 0))
        # Spans go down the columns; where one widens so steeply that both sides bound a column from one side, distances decide.
        up = dy < 0
        x0, y0, r0, r1 = np.where(up, x + dx, x), np.where(up, y + dy, y), t / 2, span["t_end"] / 2
        r0, r1, go, down, l = np.where(up, r1, r0), np.where(up, r0, r1), np.where(up, -dx, dx), np.abs(dy), np.sqrt(l2)
        grow, turn = (r1 - r0) / l, np.where(go < 0, -1.0, 1.0)
        low, high = np.abs(go) + grow * down, np.abs(go) - grow * down
        steep = (np.minimum(low, high) < 1e-9 * l) & (r0 != r1)
        slow = joined & ~((l >= 1e-4 * scale) & whole & np.append(whole[1:], False) & ~steep)
        k = np.flatnonzero(joined & ~slow)
        out0, out1 = (np.abs(v * dy / l) for v in (r0, r1))
        left, right = np.minimum(x0 - out0, x0 + go - out1), np.maximum(x0 + out0, x0 + go + out1)
        low, high, down = (np.maximum(v, 1e-300) for v in (low, high, down))
        c = {"x": x0, "y": y0, "dx": go, "dy": down, "lap": 1e-10 * l2, "l2": l2, "reach": l * (r0 - hair), "grow": grow, "turn": turn * np.abs(dy), "low": low, "high": high, "more_low": 2 * l * hair / low, "more_high": 2 * l * hair / high}
        draw(k, left[k], right[k], {name: v[k] for name, v in c.items()}, _sides, (0,))
        k = np.flatnonzero(slow)
        reach = np.maximum(t[k], t[k + 1]) / 2 + 1
        (x0, x1), (y0, y1) = ((np.minimum(v[k], v[k + 1]) - reach, np.maximum(v[k], v[k + 1]) + reach) for v in (x, y))
        x0, x1, y0, y1 = np.clip(np.floor(x0), 0, width), np.clip(np.ceil(x1), -1, width - 1), np.clip(np.floor(y0), 0, height), np.clip(np.ceil(y1), -1, height - 1)
        some = np.flatnonzero((x1 >= x0) & (y1 >= y0))
    x0, x1, y0, y1, k = (v[some].astype(np.int64) for v in (x0, x1, y0, y1, k))
    for piece in _pieces(x1 - x0 + 1, COLUMNS_AT_ONCE):
        j, col = _each(x0[piece], (x1 - x0 + 1)[piece])
        j += piece.start
        tell(k[j], col, y0[j], (y1 - y0 + 1)[j])
    if open_:
        k, col, begin, n = (np.concatenate(c) for c in zip(*open_, strict=True))
        own = np.flatnonzero((n > 0) & (k >= 0) & joined[k])
        tell(k[own], col[own], begin[own], n[own])
    ends = ends.reshape(height + 1, len(size), width)
    for row in range(1, height):
        ends[row] += ends[row - 1]
    dark = ends[:height] > 0
    for v in told:
        dark.reshape(-1)[v] = True
    return dark.transpose(1, 0, 2)


def _grays(batches: Iterator[pa.RecordBatch], width: int, height: int, thickness: str, blur: float, noise: float, start: tuple[float, float] | None) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Runs, frames and their gray pixels, those of a few frames at once."""
    at_once = max(1, PIXELS_AT_ONCE // (height * width))
    for whole in batches:
        for part in range(0, whole.num_rows, at_once):
            batch = whole.slice(part, at_once)
            lists = [batch.column(c) for c in ("xs", "ys", thickness)]
            size = np.diff(lists[0].offsets.to_numpy())
            x, y, t = (c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in lists)
            if start:
                x, y = _walked(x, size, start[0]), _walked(y, size, start[1])
            # Bits of a dark pixel are all set, and then those of 236 are changed to 35.
            gray = (np.negative(_inside(x, y, t, size, height, width).view(np.uint8)) & np.uint8(236 ^ 35)) ^ np.uint8(236)
            gray = gray.astype(float) if blur > 0 or noise > 0 else gray
            for k, (run, frame) in enumerate(zip(batch.column("run_id").to_pylist(), batch.column("frame").to_pylist(), strict=True) if blur > 0 or noise > 0 else ()):
                one = blurred(gray[k], blur) if blur > 0 else gray[k]
                gray[k] = np.clip(one + np.random.default_rng([7, run, frame]).normal(0.0, noise, one.shape), 0, 255) if noise > 0 else one
            yield batch.column("run_id").cast(pa.int64()), batch.column("frame").cast(pa.int64()), gray.astype(np.uint8, copy=False)


def drawn(points: DataFrame, width: int, height: int, thickness: str = "thickness", blur: float = 0.0, noise: float = 0.0, start: tuple[float, float] | None = None) -> DataFrame:
    """Gray frames from polylines: rows of (run_id, frame, xs, ys, thickness), thickness one number a point.

    With `start`, xs and ys are the steps that lead from there to each point. Noise is drawn from
    the frame's key, so a frame is the same whenever it is drawn.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, frame, gray in _grays(batches, width, height, thickness, blur, noise, start):
            n = len(gray)
            pixels = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int64) * height * width), pa.py_buffer(np.ascontiguousarray(gray))]).cast(pa.binary())
            sizes = [pa.array(np.full(n, x, np.int32)) for x in (height, width)]
            yield pa.RecordBatch.from_arrays([run, frame, *sizes, pixels], ["run_id", "frame", "height", "width", "pixels"])

    return points.select("run_id", "frame", "xs", "ys", thickness).mapInArrow(draw, "run_id long, frame long, height int, width int, pixels binary")


def _gray(height: int | None, width: int | None, pixels: bytes | None) -> np.ndarray | None:
    raw = np.frombuffer(pixels or b"", np.uint8)
    return raw.reshape(height or 0, width or 0) if len(raw) == (height or 0) * (width or 0) else None


def _in_largest(y: np.ndarray, x: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Which pixels, in order of line and place, are of the largest 8-connected component; of equal ones the first.

    With `of`, which rises, of each frame's own; lines of different frames don't touch.
    """
    if not len(y):
        return np.zeros(0, bool)
    begins = np.flatnonzero((np.diff(y, prepend=y[0] - 1) != 0) | (np.diff(x, prepend=x[0]) != 1))
    length = np.diff(np.append(begins, len(y)))
    return np.repeat(_of_largest(y[begins], x[begins], length, np.zeros(len(begins), np.int64) if of is None else of[begins], begins), length)


def _merged(line: np.ndarray, x0: np.ndarray, x1: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The first run of each run's component, from the first of a part of it."""
    low, high = np.searchsorted(line, line + 1, "left"), np.searchsorted(line, line + 1, "right")
    # Spans of the next line, which are in order of place, touch where they begin and end near.
    key = line.astype(np.int64) << 32
    first, last = np.searchsorted(key + x1, (key + (1 << 32)) + x0 - 1, "left"), np.searchsorted(key + x0, (key + (1 << 32)) + x1 + 1, "right")
    first, last = np.maximum(first, low), np.minimum(last, high)
    a, b = _each(first, np.maximum(last - first, 0))
    while len(a):
        least, new = np.minimum(name[a], name[b]), name.copy()
        for k in (a, b):
            np.minimum.at(new, k, least)
            np.minimum.at(new, name[k], least)
        new = new[new]
        if (new == name).all():
            break
        name = new
    return name


def _of_largest(line: np.ndarray, x0: np.ndarray, length: np.ndarray, of: np.ndarray, order: np.ndarray) -> np.ndarray:
    """As _in_largest, which runs of pixels are; of equal components that with the run of least `order`."""
    x1, name = x0 + length - 1, np.arange(len(line))
    # Most runs touch the one before, as an object without gaps is one run a line.
    joined = (line[1:] - line[:-1] == 1) & (x0[1:] <= x1[:-1] + 1) & (x0[:-1] <= x1[1:] + 1)
    name[1:][joined] = 0
    name = np.maximum.accumulate(name)
    apart = np.flatnonzero((name[1:] != name[:-1]) & (of[1:] == of[:-1])) + 1
    if len(apart):
        # Frames whose runs aren't one chain.
        own = np.flatnonzero(np.isin(of, of[apart]))
        first = np.searchsorted(own, name[own])
        name[own] = own[_merged(line[own], x0[own], x1[own], first)]
    size = np.bincount(name, length, minlength=len(name))
    first = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
    frame = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(of))))
    earliest = np.full(len(name), np.iinfo(np.int64).max)
    np.minimum.at(earliest, name, order)
    most = np.flatnonzero(size == np.maximum.reduceat(size, first)[frame])
    most = most[np.lexsort((earliest[most], frame[most]))]
    best = most[np.flatnonzero(np.diff(frame[most], prepend=-1))]
    return name == best[frame]


OBJECT = "run_id long, frame long, area_px2 long, direction_span_px double, slices array<struct<bin:long,x:double,y:double,s:double,t:double,width_px:double,n:long>>"
_SLICE = {"bin": pa.int64(), **dict.fromkeys(("x", "y", "s", "t", "width_px"), pa.float64()), "n": pa.int64()}

#: Columns that are made of each frame's slices, and how, of slices one behind the other and their numbers.
Sums = tuple[tuple[str, ...], Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]]


def _runs(dark: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of dark pixels (frame, y, x), runs down a column in order of frame and place: frame, x, first y, length."""
    n, height, width = dark.shape
    size = n * (height + 1) * width
    words = np.zeros(-(-size // 8), np.uint64)
    edge = words.view(bool)[:size].reshape(n, height + 1, width)
    edge[:, :height] = dark
    edge[:, 1:] ^= dark
    # Words without an edge are passed over.
    some = np.flatnonzero(words != 0)
    k = np.flatnonzero(words[some].view(bool))
    of, at = np.divmod(some[k // 8] * 8 + k % 8, (height + 1) * width)
    y, x = np.divmod(at, width)
    at = np.sort((of * width + x) * (height + 1) + y)
    # Edges of a column are by turns where a run begins and where it has ended.
    line, y = np.divmod(at[::2], height + 1)
    of, x = np.divmod(line, width)
    return of, x, y, at[1::2] - at[::2]


def _slices(x: np.ndarray, y: np.ndarray, n: np.ndarray, first: np.ndarray, step: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of each frame, whose runs of n pixels down from (x, y) begin at `first`: mean point and width of each slice across the axis of largest variance, which points to the right, and their number."""
    runs = np.diff(np.append(first, len(x)))
    each, total = lambda c: np.repeat(c, runs), lambda c: np.add.reduceat(c, first)
    sum_y = n * y + n * (n - 1) // 2
    count = total(n)
    mean_x, mean_y = (total(c) / count for c in (x * n, sum_y))
    # Sums are of whole numbers, from a point near the middle, and so exact.
    near_x, near_y = (np.rint(c).astype(np.int64) for c in (mean_x, mean_y))
    u, v = x - each(near_x), y - each(near_y)
    sum_v = n * v + n * (n - 1) // 2
    squares = n * v * v + v * n * (n - 1) + (n - 1) * n * (2 * n - 1) // 6
    mean_u, mean_v = (total(c) / count for c in (u * n, sum_v))
    cov, vx, vy = (total(c) / count - a * b for c, a, b in ((u * sum_v, mean_u, mean_v), (u * u * n, mean_u, mean_u), (squares, mean_v, mean_v)))
    theta = 0.5 * np.arctan2(2 * cov, vx - vy)
    cos, sin = np.cos(theta), np.sin(theta)

    def binned(x: np.ndarray, y: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.floor(((x - mean_x[of]) * cos[of] + (y - mean_y[of]) * sin[of]) / step)

    # Places rise or fall along a run: one whose ends are in one slice is in it, others are cut where their pixels' slices change.
    of = np.repeat(np.arange(len(first)), runs)
    bins = binned(x, y, of)
    apart = bins != binned(x, y + n - 1, of)
    cut, whole = np.flatnonzero(apart), np.flatnonzero(~apart)
    if len(cut):
        k, pixel = _each(y[cut], n[cut])
        one_x, one_of = x[cut][k], of[cut][k]
        one_bin = binned(one_x, pixel, one_of)
        begins = np.flatnonzero((np.diff(k, prepend=-1) != 0) | (np.diff(one_bin, prepend=0.0) != 0))
        pieces = (one_x[begins], pixel[begins], np.diff(np.append(begins, len(k))), one_of[begins], one_bin[begins])
        x, y, n, of, bins = (np.concatenate([c[whole], one]) for c, one in zip((x, y, n, of, bins), pieces, strict=True))
    low, high = np.full(len(first), np.inf), np.full(len(first), -np.inf)
    np.minimum.at(low, of, bins)
    np.maximum.at(high, of, bins)
    # A slice's number is its place behind all slices of frames before, unless most of those have no pixel.
    before = np.cumsum(high - low + 1) - (high + 1)
    key = (bins + before[of]).astype(np.int64)
    slots, key = (None, key) if key.max() < 8 * len(key) else np.unique(key, return_inverse=True)
    many, sum_x, sum_y = (np.bincount(key, c) for c in (n, x * n, n * y + n * (n - 1) // 2))
    a, b = cos[of], sin[of]
    across = (x - mean_x[of]) * b
    least, most = np.full(len(many), np.inf), np.full(len(many), -np.inf)
    # Cosines aren't negative, so runs are least across the axis where they begin.
    np.minimum.at(least, key, (y - mean_y[of]) * a - across)
    np.maximum.at(most, key, (y + n - 1 - mean_y[of]) * a - across)
    some = np.flatnonzero(many)
    many, sum_x, sum_y, slot = many[some], sum_x[some], sum_y[some], some if slots is None else slots[some]
    of = np.searchsorted(before + high, slot)
    a, b = cos[of], sin[of]
    off_x, off_y = sum_x - many * mean_x[of], sum_y - many * mean_y[of]
    made = [(slot - before[of]).astype(np.int64), sum_x / many, sum_y / many, (off_x * a + off_y * b) / many, (off_y * a - off_x * b) / many, (most - least)[some] + 1, many.astype(np.int64)]
    return dict(zip(_SLICE, made, strict=True)), np.bincount(of, minlength=len(first))


def _measured(run: pa.Array, frame: pa.Array, grays: np.ndarray | Sequence[np.ndarray], threshold: int, step: float, direction_deg: float, sums: Sums | None) -> pa.RecordBatch:
    """Rows of `objects`, of the frames' pixels."""
    cos, sin = np.cos(np.radians(direction_deg)), np.sin(np.radians(direction_deg))
    size = grays.shape[1:] if isinstance(grays, np.ndarray) else [max(gray.shape[axis] for gray in grays) for axis in (0, 1)]
    if isinstance(grays, np.ndarray):
        dark = grays < threshold
    else:
        dark = np.zeros((len(grays), *size), bool)
        for one, gray in zip(dark, grays, strict=True):
            np.less(gray, threshold, out=one[: gray.shape[0], : gray.shape[1]])
    of, x, y, n = _runs(dark)
    area, span, many = np.zeros(len(grays), np.int64), np.full(len(grays), np.nan), np.zeros(len(grays), np.int64)
    slices = {c: np.zeros(0, kind.to_pandas_dtype()) for c, kind in _SLICE.items()}
    if len(x):
        good = _of_largest(of * (size[1] + 1) + x, y, n, of, y * size[1] + x)
        of, x, y, n = (c[good] for c in (of, x, y, n)) if not good.all() else (of, x, y, n)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        some = of[first]
        area[some] = np.add.reduceat(n, first)
        along = [x * cos + c * sin for c in (y, y + n - 1)]
        span[some] = np.maximum.reduceat(np.maximum(*along), first) - np.minimum.reduceat(np.minimum(*along), first)
        slices, many[some] = _slices(x, y, n, first, step)
    own = {"run_id": run, "frame": frame, "area_px2": pa.array(area), "direction_span_px": pa.array(span, from_pandas=True)}
    if sums:
        own |= {name: pa.array(v.astype(float, copy=False), from_pandas=True) for name, v in sums[1](slices, many).items()}
    else:
        made = pa.StructArray.from_arrays([pa.array(slices[c], kind) for c, kind in _SLICE.items()], list(_SLICE))
        own["slices"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), made)
    return pa.RecordBatch.from_pydict(own)


def _schema(sums: Sums | None) -> str:
    return OBJECT if sums is None else ", ".join([OBJECT.split(", slices")[0], *(f"{c} double" for c in sums[0])])


def objects(frames: DataFrame, threshold: int = THRESHOLD, step: float = 2.0, direction_deg: float = 0.0, sums: Sums | None = None) -> DataFrame:
    """A row for each frame: area of its object, its largest dark component, extent along a direction, and its slices across its axis, or `sums` of them.

    All of a frame is measured inside the task that has it, and a row has a few hundred slices
    at most where it has many thousand pixels; no pixel is shuffled. A frame whose pixels don't
    fit its size has no row, one without dark pixels no slices.
    """

    def of_frames(part: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        run, frame, grays = zip(*part, strict=True)
        return _measured(pa.array(run, pa.int64()), pa.array(frame, pa.int64()), grays, threshold, step, direction_deg, sums)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, pixels = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("run_id", "frame")), map(_gray, *(batch.column(c).to_pylist() for c in ("height", "width", "pixels"))), strict=True):
                if row[2] is not None:
                    part.append(row)
                    pixels += row[2].size
                if pixels >= PIXELS_AT_ONCE:
                    yield of_frames(part)
                    part, pixels = [], 0
            if part:
                yield of_frames(part)

    return frames.select("run_id", "frame", "height", "width", "pixels").mapInArrow(measured, _schema(sums))


def drawn_objects(points: DataFrame, width: int, height: int, thickness: str = "thickness", blur: float = 0.0, noise: float = 0.0, start: tuple[float, float] | None = None, threshold: int = THRESHOLD, step: float = 2.0, direction_deg: float = 0.0, sums: Sums | None = None) -> DataFrame:
    """`objects` of `drawn` frames, each drawn and measured by the same worker, which holds a few at once; no pixel leaves it."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, frame, grays in _grays(batches, width, height, thickness, blur, noise, start):
            yield _measured(run, frame, grays, threshold, step, direction_deg, sums)

    return points.select("run_id", "frame", "xs", "ys", thickness).mapInArrow(measured, _schema(sums))


def largest_component(pixels: DataFrame) -> DataFrame:
    """Of rows of dark pixels, those of each frame's largest 8-connected component."""

    def label(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("x", "ascending")])
        return table.filter(pa.array(_in_largest(*(table.column(c).to_numpy().astype(np.int64) for c in ("y", "x")))))

    return pixels.select(*FRAME, "y", "x").groupBy(*FRAME).applyInArrow(label, "run_id long, frame long, y int, x int")


def _line(slices: dict[str, np.ndarray], size: np.ndarray) -> dict[str, np.ndarray]:
    """Ends of each frame's line, and the parabola t = level + slope u + bend u**2 over it, by its normal equations; u is the place along the axis from its mean, so that sums of u vanish."""
    x, y, s, t = (geometry.padded(slices[c], size) for c in ("x", "y", "s", "t"))
    there, end, some = np.arange(s.shape[1]) < size[:, None], np.maximum(size - 1, 0)[:, None], size > 0
    points = np.where(some, size, np.nan)
    last = lambda c: np.where(some, np.take_along_axis(c, end, axis=1)[:, 0], np.nan)
    first = lambda c: np.where(some, c[:, 0], np.nan)
    with np.errstate(all="ignore"):
        mean = geometry.in_order(s) / points
        u = np.where(there, s - mean[:, None], 0.0)
        u2, u3, u4, t0, t1, t2 = (geometry.in_order(c) for c in (u * u, u * u * u, u * u * u * u, t, t * u, t * u * u))
        det = points * (u2 * u4 - u3 * u3) - u2 * u2 * u2
        bend = (points * (u2 * t2 - u3 * t1) - u2 * u2 * t0) / np.where(np.abs(det) > 1e-9, det, np.nan)
        slope, level = (t1 - bend * u3) / np.where(u2 > 0, u2, np.nan), (t0 - bend * u2) / points
        off = np.where(there, t - (level[:, None] + slope[:, None] * u + bend[:, None] * u * u), 0.0)
        error = np.sqrt(geometry.in_order(off * off) / points)
    return dict(zip(LINE[0], (points, first(x), first(y), last(x), last(y), first(s) - mean, last(s) - mean, bend, slope, error), strict=True))


def _body(slices: dict[str, np.ndarray], size: np.ndarray) -> dict[str, np.ndarray]:
    """The width profile of each frame's body, which is where it is wider than 22 % of its largest width, eight pixels at least."""
    of, width = np.repeat(np.arange(len(size)), size), slices["width_px"]
    top = geometry.padded(width, size, -np.inf).max(axis=1)
    body = width >= np.maximum(0.22 * top, 8.0)[of]
    return geometry.profiles(slices["s"][body], width[body], np.bincount(of[body], minlength=len(size)))


#: What `wire_measures` and `braided_measures` are made of. Slices lie along the axis in order.
LINE: Sums = (("points", "anchor_x", "anchor_y", "tip_x", "tip_y", "from_u", "to_u", "bend", "slope", "quadratic_rmse_px"), _line)
BODY: Sums = (geometry.PROFILE, _body)


def wire_geometry(frames: DataFrame, direction_deg: float = 0.0, threshold: int = THRESHOLD) -> DataFrame:
    """One row a frame: end points, chord, that of a parabola over it, its curvature and error, span and quality.

    A frame without an object has NULLs, quality 0 and model `failed`.
    """
    return wire_measures(objects(frames, threshold, direction_deg=direction_deg, sums=LINE))


def wire_measures(found: DataFrame) -> DataFrame:
    """As wire_geometry, from the rows of `objects` with the sums of a LINE."""
    c = F.col
    along = c("to_u") - c("from_u")
    x_fit = F.sqrt(F.pow(along, F.lit(2)) + F.pow(along * (c("slope") + c("bend") * (c("from_u") + c("to_u"))), F.lit(2)))
    ok = F.coalesce(c("area_px2") >= LEAST_PIXELS, F.lit(False)) & c("bend").isNotNull()
    kappa = F.abs(2 * c("bend")) / F.pow(1 + c("slope") * c("slope"), F.lit(1.5))
    chord = F.sqrt(F.pow(c("tip_x") - c("anchor_x"), 2) + F.pow(c("tip_y") - c("anchor_y"), 2))
    shown = {"anchor_x": c("anchor_x"), "anchor_y": c("anchor_y"), "tip_x": c("tip_x"), "tip_y": c("tip_y"), "x_px": chord, "x_fit_px": x_fit, "kappa_fit_px_inv": kappa, "centerline_points": c("points"), "quadratic_rmse_px": c("quadratic_rmse_px"), "direction_mask_span_px": c("direction_span_px"), "area_px2": c("area_px2").cast("double")}
    quality = F.when(ok, F.exp(-c("quadratic_rmse_px") / 4.0)).otherwise(F.lit(0.0))
    return found.select(*FRAME, *(F.when(ok, v).alias(k) for k, v in shown.items()), quality.alias("quality"), F.when(ok, "quadratic").otherwise("failed").alias("model_name"))


def braided_geometry(frames: DataFrame, step: float = 2.0, threshold: int = THRESHOLD) -> DataFrame:
    """One row a frame: length, diameters, area and zones from the width profile along the axis.

    The body is where the profile is wider than 22 % of its largest width, eight pixels at least.
    """
    return braided_measures(objects(frames, threshold, step, sums=BODY))


def braided_measures(found: DataFrame) -> DataFrame:
    """As braided_geometry, from the rows of `objects` with the sums of a BODY."""
    size = F.when(F.col("area_px2") > 0, F.col("area_px2")).cast("double").alias("component_area_px2")
    return geometry.with_zones(found).select(*FRAME, size, "length_axis_px", "diameter_max_px", "area_proj_px2", *geometry.WIDTHS, *geometry.ZONES, ((F.col("peak_s") - F.col("first")) / F.when(F.col("length_axis_px") > 0, F.col("length_axis_px"))).alias("diameter_peak_pos_norm"))
