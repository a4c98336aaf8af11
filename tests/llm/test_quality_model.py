import math
import zlib

import numpy as np
import pyarrow as pa

from thermoline.llm import quality_model as q
from thermoline.llm.queries import op5_ftrl_quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = op5_ftrl_quality(spark, d).collect()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert len(got) == docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.predicted, labels[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 50
    assert np.mean([p == y for p, y, _ in held]) >= 0.95
    good, bad = [s for _, y, s in held if y == 1], [s for _, y, s in held if y == 0]
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.98


def test_odd_rows(spark, table, odd):
    docs = table([*odd, (50, "Good words here. " * 9), (51, "BAD!! WORDS!! " * 9)])
    labels = spark.createDataFrame([(50, 1, 0), (51, 0, 0), (51, 0, 1), (2, None, 0), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = q.quality_scores(docs, labels).collect()
    assert len(got) == len(odd) + 2
    blank = {round(r.score, 12) for r, (i, t) in zip(got, [*odd, (50, "x"), (51, "x")], strict=True) if not (t or "").strip()}
    assert len(blank) == 1
    assert all(r.held_out for r in got if r.doc_id is None)
    assert q.quality_scores(table([]), labels).count() == 0
    assert q.quality_scores(docs, labels.limit(0)).where("score <> 0.5").count() == 0


def brute_ftrl(rows, epochs):
    z, n, size = {}, {}, 1 << q.BITS

    def weight(k):
        if abs(z.get(k, 0.0)) <= q.L1:
            return 0.0
        return -(z[k] - math.copysign(q.L1, z[k])) / ((q.BETA + math.sqrt(n[k])) / q.ALPHA + q.L2)

    for _ in range(epochs):
        for at, x, y in rows:
            cells = [*zip(at.tolist(), x.tolist(), strict=True), (size, 1.0)]
            p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in cells)))
            for k, v in cells:
                g, w = (p - y) * v, weight(k)
                s = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / q.ALPHA
                z[k], n[k] = z.get(k, 0.0) + g - s * w, n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z}


def test_updates_match_the_formula():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(50, 6, replace=False)), rng.random(6), int(rng.integers(2))) for _ in range(80)]
    got = q.ftrl(rows, 2)
    for k, w in brute_ftrl(rows, 2).items():
        assert abs(got[k] - w) < 1e-9


def test_features_do_not_depend_on_neighbours():
    texts = ["One two  two, three!!", "", None, "ÉÉ x_1", "One two  two, three!!"]
    bucket, doc, runs = q.features(pa.array(texts))
    for d, t in enumerate(texts):
        alone, _, n = q.features(pa.array([t], pa.string()))
        assert sorted(alone.tolist()) == sorted(bucket[doc == d].tolist()) and n[0] == runs[d]


def test_one_labelled_id_in_many_rows(table, spark):
    rows = [(1, f"repeated text {k % 10}") for k in range(10_000)] + [(k, f"clean words of text {k}") for k in range(2, 40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, quality int")
    few = [(1, "repeated text 0"), *rows[10_000:]]
    a, b = (q.train(table(x), labels) for x in (rows, few))
    assert np.array_equal(a, b) and a.any()
