"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text is cut into runs of letters and digits and runs of signs. Its features are hashed
runs, pairs of neighbouring runs, their shapes (case, digits, glued or not), pairs of
shapes, and whether a run or a three-run window was seen just before or earlier in the
text; each counts by its share of the text. A score is one sparse dot product per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoline.llm import textkit as tk

BITS = 18
#: Most labelled documents that the model is fit on: those with the least hash of their id.
SAMPLE = 8000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.3, 1.0, 0.05, 0.1
SCALE = 20.0

_U = np.uint64
_CLASS = np.full(256, 2, np.uint8)
_CLASS[tk.SPACE] = 0
for _range in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(128, 256))):
    _CLASS[list(_range)] = 1
_UPPER, _LOWER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = _LOWER[128:] = _DIGIT[48:58] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every feature, and the number of runs of each text."""
    data, off = tk.utf8(column)
    docs, n = len(off) - 1, len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(docs, np.int64)
    kind = _CLASS[data]
    first = np.ones(n, bool)
    first[1:] = kind[1:] != kind[:-1]
    first[off[:-1][off[:-1] < n]] = True
    edge = np.flatnonzero(first)
    start, end = edge, np.append(edge[1:], n)
    real = kind[start] > 0
    doc = np.searchsorted(off, start, "right") - 1
    glued = np.zeros(len(start), bool)
    glued[1:] = real[:-1] & (doc[1:] == doc[:-1])
    start, end, glued, doc = start[real], end[real], glued[real], doc[real]
    runs = np.bincount(doc, minlength=docs)
    h = tk.Words(data, off).span_hash(start, end)

    def some(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, np.int32)
        np.cumsum(table[data], out=sums[1:])
        return sums[end] - sums[start]

    upper, size = some(_UPPER), end - start
    shape = np.where(kind[start] == 2, 64 + np.minimum(size, 4), _UPPER[data[start]] + 2 * (upper > 1) + 4 * (some(_LOWER) > 0) + 8 * (some(_DIGIT) > 0) + 16 * (size > 20)).astype(_U) * _U(2) + glued.astype(_U)
    pair, inside = tk.window_hash(h, doc, 2)
    shapes, _ = tk.window_hash(tk.mix(shape + _U(7)), doc, 2)
    three, whole = tk.window_hash(h, doc, 3)
    same = np.flatnonzero(inside & (h[:-1] == h[1:]))
    if len(h) > 2:
        skipped = np.flatnonzero(whole & (h[:-2] == h[2:]))
        places = np.flatnonzero(whole)
        key = tk.per_doc(three[places], doc[places])
        order = np.argsort(key, kind="stable")
        again = places[order[1:][key[order[1:]] == key[order[:-1]]]]
    else:
        skipped = again = np.zeros(0, np.int64)
    flags = [tk.mix(np.full(len(x), k, _U)) for k, x in ((11, same), (12, skipped), (13, again))]
    hashes = np.concatenate([h, pair[inside], tk.mix(shape + _U(1_000_003)), shapes[inside], *flags])
    where = np.concatenate([doc, doc[:-1][inside] if len(doc) else doc, doc, doc[:-1][inside] if len(doc) else doc, doc[same], doc[skipped], doc[again]])
    return (hashes >> _U(64 - BITS)).astype(np.int64), where, runs


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the last for the constant, from rows of (buckets, values, label)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) > L1, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    return weights(slice(None))


def fold(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("long").cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_id_col: str | None = None) -> np.ndarray:
    """Weights from labelled documents outside the held-out fold.

    Labels that are null or have no id are passed over; of several labels of an id the
    largest counts, of several texts of an id the one that sorts first, chosen before rows
    are shuffled. So `sample` bounds the rows that the one training task and the driver hold.
    """
    id_of = F.col(label_id_col or id_col).cast("long")
    known = labels.where(id_of.isNotNull() & F.col(label_col).isNotNull() & (fold(id_of) != HELD_OUT))
    known = known.groupBy(id_of.alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.withColumn("turn", F.xxhash64("id")).orderBy("turn", "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")
    texts = texts.groupBy("turn", "id", "y").agg(F.min("text").alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                bucket, doc, runs = features(part.column("text"))
                cell, count = np.unique(doc << BITS | bucket, return_counts=True)
                at = np.searchsorted(cell >> BITS, np.arange(part.num_rows + 1)).astype(np.int32)
                value = count * SCALE / np.maximum(1, runs)[cell >> BITS]
                lists = (pa.ListArray.from_arrays(at, pa.array(x)) for x in ((cell & ((1 << BITS) - 1)).astype(np.int32), value.astype(np.float32)))
                yield pa.RecordBatch.from_arrays([part.column("turn"), part.column("id"), part.column("y"), *lists], ["turn", "id", "y", "at", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for at, x, y in zip(batch.column("at"), batch.column("x"), batch.column("y").to_pylist(), strict=True):
                rows.append((at.values.to_numpy(), x.values.to_numpy().astype(float), y))
        w = ftrl(rows)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "w": pa.array(w[at], pa.float64())})

    cells = texts.mapInArrow(featured, "turn long, id long, y int, at array<int>, x array<float>")
    found = cells.repartition(1).sortWithinPartitions("turn", "id", "at").mapInArrow(fit, "at int, w double").toPandas()  # at most 2**18 + 1 rows
    out = np.zeros((1 << BITS) + 1)
    out[found["at"].to_numpy()] = found["w"].to_numpy()
    return out


def scores(weights: np.ndarray, column: pa.Array) -> np.ndarray:
    bucket, doc, runs = features(column)
    dot = np.bincount(doc, weights[bucket], minlength=len(runs)) * SCALE / np.maximum(1, runs)
    return 1 / (1 + np.exp(-np.clip(dot + weights[-1], -35, 35)))


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_id_col: str | None = None) -> DataFrame:
    """One row for each row of `docs`: whether its id is held out, its score and prediction.

    Null and empty texts have the score of the constant alone; a null id counts as the empty
    string, which is held out; repeated rows score alike; an empty table gives no rows, and
    without labels all score alike. Only the text enters a score, so other columns don't
    matter, whatever their names. A long text is a slice of its own. Scoring needs no
    shuffle; the weights, 2 MB, are broadcast. `label_id_col` is `id_col` where it isn't given.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, label_col, sample, id_col, text_col, label_id_col))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                score = scores(model.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col)) == HELD_OUT).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
