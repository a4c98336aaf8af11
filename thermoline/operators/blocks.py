"""Runs as blocks of neighbouring rows, and folds over a run that need no task to hold the run.

A block is one row of a stored table, with its rows as an array. What lies before and behind
a block enters it as a carry: a summary of each block is a small row, windows or scans over
these rows make the carries, and blocks take them up by a join. So a run of any length is
spread over tasks, and a batch of blocks is computed as one segmented array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thermoline.operators.ordered import RUN
from thermoline.sources.staging import stored

#: Frames of a block.
FRAMES = 4096
#: Rows of blocks that a kernel has at once.
ROWS_AT_ONCE = 65_536
#: Rounds in which pools of all segments are merged at once; what isn't done then is merged segment by segment.
ROUNDS = 32
KEY = [RUN, "block"]


def blocked(df: DataFrame, frames: int = FRAMES) -> DataFrame:
    """Rows of (run, block, rows), the rows in order of their frames."""
    rest = [c for c in df.columns if c not in (RUN, "frame")]
    rows = F.array_sort(F.collect_list(F.struct("frame", *rest))).alias("rows")
    return stored(df.groupBy(RUN, F.floor(F.col("frame") / frames).alias("block")).agg(rows), "blocks")


def with_carry(blocks: DataFrame, carry: DataFrame) -> DataFrame:
    """The blocks with the columns of their carries; runs and blocks may be null."""
    named = carry.select(*(F.col(c).alias(f"carry_{c}") if c in KEY else F.col(c) for c in carry.columns))
    same = F.col(RUN).eqNullSafe(F.col(f"carry_{RUN}")) & F.col("block").eqNullSafe(F.col("carry_block"))
    return blocks.join(named, same, "left").drop(*(f"carry_{c}" for c in KEY))


class Segments:
    """The blocks of an Arrow batch as one array of rows."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, lists = batch, batch.column("rows")
        ends = lists.offsets.to_numpy().astype(np.int64)
        self.rows = lists.values.slice(ends[0], ends[-1] - ends[0])
        self.off = ends - ends[0]
        self.size = np.diff(self.off)
        self.of = np.repeat(np.arange(len(self.size)), self.size)
        self.first = self.off[:-1][self.of]
        self.at = np.arange(len(self.of)) - self.first

    def column(self, name: str) -> np.ndarray:
        """A column of the rows; NULL is NaN."""
        return self.rows.field(name).cast(pa.float64()).to_numpy(zero_copy_only=False)

    def carry(self, name: str) -> np.ndarray:
        """A column of the blocks; NULL is NaN."""
        return self.batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)

    def last(self, which: np.ndarray) -> np.ndarray:
        """At each row the last row of its block so far for which `which` holds, or -1."""
        place = np.maximum.accumulate(np.where(which, np.arange(len(which)), -1)) if len(which) else np.zeros(0, np.int64)
        return np.where(place >= self.first, place, -1)

    def next(self, which: np.ndarray) -> np.ndarray:
        """At each row the first row of its block from here on for which `which` holds, or -1."""
        n = len(which)
        place = np.minimum.accumulate(np.where(which, np.arange(n), n)[::-1])[::-1] if n else np.zeros(0, np.int64)
        return np.where(place < self.first + self.size[self.of], place, -1)

    def edge(self, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        """A value at the first row of each block; NaN for a block without rows."""
        out = np.full(len(self.size), np.nan)
        full = self.size > 0
        out[full] = np.where(rows[self.off[:-1][full]] >= 0, of[rows[self.off[:-1][full]]], np.nan)
        return out

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Running sums within blocks."""
        total = np.cumsum(x)
        return total - np.concatenate([[0.0], total])[self.first] if len(x) else total

    def lists(self, x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.off, pa.int32()), pa.array(x))


def scan(times: np.ndarray, plus: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps x -> times x + plus, each composed with all before it in its segment; `at` is the place in the segment."""
    times, plus, step = times.copy(), plus.copy(), 1
    longest = int(at.max()) if len(at) else 0
    while step <= longest:
        here = np.flatnonzero(at >= step)
        plus[here], times[here] = times[here] * plus[here - step] + plus[here], times[here] * times[here - step]
        step *= 2
    return times, plus


def pooled(total: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring pools of a segment whose means fall are joined until none do: totals, sizes, and the pool that each given one is in.

    All falling stretches of all segments are joined at once, round after round.
    """
    into = np.arange(len(total))
    for _ in range(ROUNDS):
        falls = (total[:-1] * size[1:] > total[1:] * size[:-1]) & (of[:-1] == of[1:])
        if not falls.any():
            return total, size, into
        total, size, of, into = _joined(total, size, of, into, falls)
    falls = np.flatnonzero((total[:-1] * size[1:] > total[1:] * size[:-1]) & (of[:-1] == of[1:]))
    joined = np.zeros(max(0, len(total) - 1), bool)
    for segment in np.unique(of[falls]).tolist():
        s, e = np.searchsorted(of, segment), np.searchsorted(of, segment, "right")
        stack: list[list[float]] = []
        for k, t, n in zip(range(s, e), total[s:e].tolist(), size[s:e].tolist(), strict=True):
            begin = k
            while stack and stack[-1][0] * n > t * stack[-1][1]:
                t0, n0, begin = stack.pop()
                t, n = t + t0, n + n0
            stack.append([t, n, begin])
        joined[s : e - 1] = True
        joined[[int(x[2]) - 1 for x in stack if x[2] > s]] = False
    total, size, _, into = _joined(total, size, of, into, joined)
    return total, size, into


def _joined(total: np.ndarray, size: np.ndarray, of: np.ndarray, into: np.ndarray, with_next: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], ~with_next]))
    number = np.cumsum(np.concatenate([[True], ~with_next])) - 1
    return np.add.reduceat(total, first), np.add.reduceat(size, first), of[first], number[into]


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ROWS_AT_ONCE rows of blocks, a block at least: a kernel has many arrays of a part's length."""
    ends, at = batch.column("rows").offsets.to_numpy(), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + ROWS_AT_ONCE, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def over_blocks(blocks: DataFrame, kernel: Callable[[Segments], dict[str, pa.Array | np.ndarray]], schema: str | StructType, keep: list[str] = KEY) -> DataFrame:
    """One row for each block: its columns `keep`, and those that the kernel makes of a batch of blocks."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                made = kernel(Segments(part))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(x if isinstance(x, pa.Array) else pa.array(x, from_pandas=True) for x in made.values())], [*keep, *made])

    return blocks.mapInArrow(apply, schema)


def to_rows(blocks: DataFrame, kernel: Callable[[Segments], dict[str, np.ndarray]], schema: StructType) -> DataFrame:
    """The rows of all blocks, with the columns that the kernel makes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                s = Segments(part)
                made = {c: pa.array(x, pa.float64(), from_pandas=True) for c, x in kernel(s).items()}
                own = {f.name: x for f, x in zip(s.rows.type, s.rows.flatten(), strict=True)}
                table = {RUN: part.column(RUN).take(pa.array(s.of)), **own, **made}
                yield pa.RecordBatch.from_arrays([table[f.name] for f in schema], schema.names)

    return blocks.mapInArrow(apply, schema)


def states(maps: DataFrame, names: list[str]) -> DataFrame:
    """What enters each row of (run, way, nth) when the maps x -> times x + plus of the rows before it are applied in order.

    The first map of a run is constant. A run's rows are small and stream through one task, which
    holds no more of them than a batch.
    """
    out = ", ".join(["way int", "block long", *(f"in_{n} double" for n in names)])
    schema = StructType([maps.schema[RUN], *StructType.fromDDL(out).fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state = None, np.full(len(names), np.nan)
        for batch in batches:
            run, way = batch.column(RUN).to_pylist(), batch.column("way").to_numpy()
            if not run:
                continue
            new = np.array([True, *(a != b or c != d for a, b, c, d in zip(run[1:], run[:-1], way[1:].tolist(), way[:-1].tolist(), strict=True))])
            new[0] = (run[0], way[0]) != before
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            times, plus = (np.stack([batch.column(f"{x}_{n}").to_numpy(zero_copy_only=False) for n in names], axis=1) for x in ("times", "plus"))
            if not new[0]:
                plus[0], times[0] = times[0] * state + plus[0], 0.0
            _, after = scan(times, plus, np.arange(len(new)) - first)
            entering = np.concatenate([state[None], after[:-1]])
            entering[new] = np.nan
            before, state = (run[-1], way[-1]), after[-1]
            yield pa.RecordBatch.from_arrays([batch.column(RUN), batch.column("way"), batch.column("block"), *(pa.array(x, from_pandas=True) for x in entering.T)], schema.names)

    ordered = maps.repartition(RUN, "way").sortWithinPartitions(RUN, "way", "nth")
    return ordered.mapInArrow(apply, schema)


def settled(pools: DataFrame, names: list[str]) -> DataFrame:
    """Rows of (run, block, line, pool, mean): means of the pools of a run once the pools of all its blocks are joined.

    `pools` has arrays total_<name> and size_<name> of each block. Of a block, only those pools are sent that
    could meet one of another: their mean is above some later block's first mean, which is the
    least mean that any stretch of its beginning has, or below some earlier block's last one. The
    others stay as they are and are left out here. Pools that are sent meet in one task a run and name.
    """
    mean = lambda n, at: F.col(f"total_{n}")[at] / F.col(f"size_{n}")[at]
    last = lambda n: F.size(f"size_{n}") - 1
    lines = F.explode(F.array(*(F.struct(F.lit(k).alias("line"), F.when(F.size(f"size_{n}") > 0, mean(n, 0)).alias("low"), F.when(F.size(f"size_{n}") > 0, mean(n, last(n))).alias("high"), F.arrays_zip(F.col(f"total_{n}").alias("total"), F.col(f"size_{n}").alias("size")).alias("pools")) for k, n in enumerate(names)))).alias("x")
    rows = pools.select(*KEY, lines).select(*KEY, "x.*")
    w = Window.partitionBy(RUN, "line").orderBy("block")
    ends = rows.select(*KEY, "line", F.min("low").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("least"), F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("most"))
    ends = ends.where("least IS NOT NULL OR most IS NOT NULL")
    loose = with_carry(rows.withColumnRenamed("line", "own"), ends).where("own = line").select(*KEY, "line", "least", "most", F.posexplode("pools").alias("pool", "p"))
    loose = loose.select(*KEY, "line", "pool", "p.total", "p.size", "least", "most").where("total / size > least OR total / size < most").drop("least", "most")
    schema = StructType([*(loose.schema[c] for c in (*KEY, "line", "pool")), *StructType.fromDDL("mean double").fields])

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        total, size = table.column("total").to_numpy(), table.column("size").to_numpy()
        total, size, into = pooled(total, size, np.zeros(len(total), np.int64))
        got = table.select([*KEY, "line", "pool"]).append_column("mean", pa.array((total / size)[into]))
        return got.combine_chunks().to_batches()[0]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, before = [], None
        for batch in batches:
            keys = list(zip(batch.column(RUN).to_pylist(), batch.column("line").to_pylist(), strict=True))
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if s == e:
                    continue
                if parts and keys[s] != before:
                    yield joined(parts)
                    parts = []
                parts.append(batch.slice(s, e - s))
                before = keys[s]
        if parts:
            yield joined(parts)

    return loose.repartition(RUN, "line").sortWithinPartitions(RUN, "line", "block", "pool").mapInArrow(apply, schema)
