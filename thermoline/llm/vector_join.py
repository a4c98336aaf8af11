"""Exact nearest neighbours by a block matrix join.

Queries and candidates are dealt into the cells of a grid: a cell holds one group of queries
and one group of candidates, so memory is bounded and no row's partners are collected. In a
cell, tiles of queries by candidates are multiplied as 8-bit integers; what rounding took from
each vector bounds the error of every distance. Pairs that the bounds can't rule out are
recomputed from the original vectors and go into a heap for each query, which tile after tile
merges into; the heaps of all cells meet in one ranking a query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermoline.llm.workspace import stored

#: Bytes of a cell's queries as doubles, candidates of a cell, and rows of a tile of both.
QUERY_BYTES, CELL_ROWS, TILE = 64 << 20, 500_000, (1024, 4096)
#: Pairs that are recomputed together; components that are multiplied together, so that sums of products of bytes stay whole numbers in single precision.
PAIRS, COMPONENTS = 1 << 16, 1024
#: More than lengths lose where squares are too small for double precision.
TINY = 1e-150
_FOUND = "query long, vec_id long, score double"


class Quantised:
    """Vectors as rows of bytes: x = scale * q + rest, of which the length of the rest is known."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.scale = np.abs(x).max(axis=1) / 127.0 if len(x) else np.zeros(0)
        with np.errstate(all="ignore"):
            whole = np.where(self.scale[:, None] > 0, np.rint(x / self.scale[:, None]), 0.0)
            rest = x - whole * self.scale[:, None]
            self.rest = np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9)
            self.q = whole.astype(np.int8)
            self.square = self.scale**2 * (whole * whole).sum(axis=1)

    def rows(self, s: slice) -> Quantised:
        out = object.__new__(Quantised)
        out.x, out.scale, out.rest, out.q, out.square = self.x[s], self.scale[s], self.rest[s], self.q[s], self.square[s]
        return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two tables of bytes, exactly."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], COMPONENTS):
        out += a[:, k : k + COMPONENTS].astype(np.float32) @ b[:, k : k + COMPONENTS].astype(np.float32).T
    return out


def bounds(a: Quantised, b: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Between which values the distances of all pairs lie; NaN where nothing is known."""
    with np.errstate(all="ignore"):
        sums = a.square[:, None] + b.square[None, :]
        near = sums - 2.0 * a.scale[:, None] * b.scale[None, :] * products(a.q, b.q)
        slack, rest = 1e-13 * sums, a.rest[:, None] + b.rest[None, :]
        low = np.sqrt(np.maximum(near - slack, 0.0)) - rest
        high = np.sqrt(np.maximum(near, 0.0) + slack) + rest
        return low * (1 - 1e-12) - TINY, high * (1 + 1e-12) + TINY


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, in double precision, squares added in order of the components."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for x, y in zip(a.T, b.T, strict=True):
            step = x - y
            total += step * step
        return np.sqrt(total)


class Heaps:
    """The `most` nearest of each query so far, the farthest on top; of equals the larger id is farther."""

    def __init__(self, queries: int, most: int):
        self.most, self.of = most, [list[tuple[float, int]]() for _ in range(queries)]
        self.limit, self.last = np.full(queries, math.inf), np.full(queries, np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        """Merge pairs of one tile in."""
        better = (score < self.limit[query]) | ((score == self.limit[query]) & (vec_id <= self.last[query]))
        for k, s, v in zip(query[better].tolist(), score[better].tolist(), vec_id[better].tolist(), strict=True):
            heap = self.of[k]
            if len(heap) < self.most:
                heapq.heappush(heap, (-s, -v))
            else:
                heapq.heappushpop(heap, (-s, -v))
            if len(heap) == self.most:
                self.limit[k], self.last[k] = -heap[0][0], -heap[0][1]

    def add_tile(self, at: int, a: Quantised, b: Quantised, vec_id: np.ndarray) -> None:
        """The pairs of a tile whose queries begin at `at`."""
        low, high = bounds(a, b)
        limit = self.limit[at : at + len(a.q)].copy()
        fresh = ~np.isfinite(limit)
        if fresh.any() and len(b.q) > self.most:
            limit[fresh] = np.partition(high[fresh], self.most - 1, axis=1)[:, self.most - 1]  # NaN goes last: a bound of those that are known
        query, which = np.nonzero(~(low > limit[:, None]))
        for k in range(0, len(query), PAIRS):
            some, other = query[k : k + PAIRS], which[k : k + PAIRS]
            self.add(some + at, distances(a.x[some], b.x[other]), vec_id[other])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each begins."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a batch by the length of their vectors: the length, places of the rows, and the vectors."""
    values, at = _lists(batch.column("vec"))
    size = np.diff(at)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield n, rows, values[at[rows][:, None] + np.arange(n)] if len(rows) else np.zeros((0, n))


def _search(most: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells one after another, each with its queries first."""
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        ready: dict[int, tuple[np.ndarray, Quantised, Heaps]] = {}
        cell = None

        def found() -> Iterator[pa.RecordBatch]:
            for number, _, heaps in ready.values():
                for k in range(0, len(number), 1000):
                    rows = [(q, -v, -s) for q, heap in zip(number[k : k + 1000].tolist(), heaps.of[k : k + 1000], strict=True) for s, v in heap]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "vec_id", "score"])

        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(cells)], strict=True):
                if s == e:
                    continue
                some = batch.slice(s, e - s)
                if cells[s] != cell:
                    yield from found()
                    parts, ready, cell = {}, {}, cells[s]
                if kinds[s] == 0:
                    for n, rows, x in _by_length(some):
                        parts.setdefault(n, []).append((some.column("query").to_numpy()[rows], x))
                    continue
                for n, rows, x in _by_length(some):
                    if n not in parts and n not in ready:
                        continue
                    if n not in ready:
                        number, vectors = (np.concatenate(y) for y in zip(*parts.pop(n), strict=True))
                        ready[n] = number, Quantised(vectors), Heaps(len(number), most)
                    _, queries, heaps = ready[n]
                    candidates, ids = Quantised(x), some.column("vec_id").to_numpy()[rows]
                    for k in range(0, len(ids), TILE[1]):
                        for at in range(0, len(queries.q), TILE[0]):
                            heaps.add_tile(at, queries.rows(slice(at, at + TILE[0])), candidates.rows(slice(k, k + TILE[1])), ids[k : k + TILE[1]])
        yield from found()

    return searched


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows with an id and a vector of finite components that aren't all zero."""
    x = F.col(vec_col)
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)) & F.exists(x, lambda v: v != 0))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("vec"))


def nearest(vectors: DataFrame, most: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row whose id `every` divides, its `most` nearest other rows: query_id, rank, vec_id, score.

    Exact: no pair is ruled out but by bounds. Vectors that are null, empty, zero, or hold a null or
    a component that isn't finite take no part, nor do rows without an id; vectors of another length
    aren't candidates of a query. Ties go to the smaller id. Repeated rows are candidates and queries
    each: the query's own row is left out once, so its copies are found, and a query that is repeated
    has its answer as often. With fewer candidates there are fewer ranks; without any, or in an empty
    table, none. Other columns are not looked at, whatever their names. A distance beyond double
    precision is infinite.

    A candidate is sent to as many cells as there are groups of queries (64 MB of them each), a query to
    as many as there are groups of candidates; rows alike are dealt by the partition that they are read in.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "vec").agg(F.count(F.lit(1)).alias("times"))
    asked = stored(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    queries, longest = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    groups = max(1, -(-queries * longest * 8 // QUERY_BYTES))
    columns = max(-(-rows.count() // CELL_ROWS), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // groups))
    hashed = F.pmod(F.xxhash64("vec_id", "vec", F.spark_partition_id()), F.lit(columns))
    to = rows.select(hashed.alias("column"), "vec_id", "vec").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    of = asked.select(F.pmod(F.xxhash64("query"), F.lit(groups)).alias("group"), "query", "vec").withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    cell = (F.col("group") * columns + F.col("column")).cast("int").alias("cell")
    none = F.lit(None).cast("long")
    cells = of.select(cell, F.lit(0).alias("kind"), "query", none.alias("vec_id"), "vec").union(to.select(cell, F.lit(1).alias("kind"), none.alias("query"), "vec_id", "vec"))
    found = cells.repartitionById(groups * columns, "cell").sortWithinPartitions("cell", "kind").mapInArrow(_search(most + 1), _FOUND)
    w = Window.partitionBy("query").orderBy("score", "vec_id")
    ranked = found.withColumn("at", F.row_number().over(w)).where(F.col("at") <= most + 1).join(asked.select("query", F.col("vec_id").alias("query_id"), "times"), "query")
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0), F.col("at"))).over(Window.partitionBy("query"))
    ranked = ranked.withColumn("own", own).where("own IS NULL OR at != own").withColumn("rank", F.col("at") - F.when(F.col("at") > F.col("own"), 1).otherwise(0)).where(F.col("rank") <= most)
    return ranked.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select("query_id", "rank", "vec_id", "score")


_SQL = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.vec, c.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda s, x: s + x)) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank, vec_id, score FROM pairs
QUALIFY rank <= 10
"""


def oracle_sql() -> str:
    return _SQL
