import math

import numpy as np
import pytest

from thermoline.llm import queries
from thermoline.llm import vector_join as vj


def brute(rows, most=10, every=100):
    """Sorted distances of each query to all rows but its own."""
    fit = [(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for k, (q, x) in enumerate(fit):
        if q % every:
            continue
        near = []
        for j, (i, y) in enumerate(fit):
            if j != k and len(x) == len(y):
                total = 0.0
                for a, b in zip(x, y, strict=True):
                    total += (a - b) * (a - b)
                near.append((math.sqrt(total), i))
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(near)[:most])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS query", "2 AS cell", "'x' AS score", "3 AS rank", "array(1) AS vec")


def test_table_and_sql(spark):
    import duckdb

    got = sorted(map(tuple, queries.op12_block_join(spark, "/root/testdata/sf0.001").collect()))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert got == brute(rows)
    with duckdb.connect() as db:
        db.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
        assert sorted(db.sql(vj.oracle_sql()).project("query_id, rank, vec_id, score").fetchall()) == got


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(vj, "TILE", (2, 3))
        monkeypatch.setattr(vj, "PAIRS", 5)
        monkeypatch.setattr(vj, "QUERY_BYTES", 64)
    rng = np.random.default_rng(3)
    rows = [(k * 50, rng.normal(size=4).tolist()) for k in range(60)]
    rows += [(7 + k, [1.0, 2.0, 3.0, 4.0]) for k in range(30)] + [(100, [1.0, 2.0, 3.0, 4.0]), (-100, [1.0, 2.0, 3.0, 4.0])]  # ties, ids that meet others
    rows += [(300, [0.5, 0.5, 0.5, 0.5])] * 3 + [(301, [0.5, 0.5, 0.5, 0.5])] * 2  # repeated rows
    rows += [(400, [1e300, -1e300, 1.0, 0.0]), (401, [-1e300, 1e300, 1.0, 0.0]), (500, [1e-320, 0.0, 0.0, 0.0]), (501, [0.0, 1e-200, 0.0, 0.0])]
    rows += [(600, None), (700, []), (800, [0.0] * 4), (900, [1.0, None, 1.0, 1.0]), (1000, [1.0, math.nan, 1.0, 1.0]), (1100, [1.0, math.inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(1200, [1.0, 2.0]), (1201, [2.0, 2.0]), (1300, [5.0])]  # other lengths: one candidate, none
    assert sorted(map(tuple, vj.nearest(frame(spark, rows)).collect())) == brute(rows)


def test_few_and_none(spark):
    assert vj.nearest(frame(spark, [])).collect() == []
    assert vj.nearest(frame(spark, [(100, [1.0])])).collect() == []
    assert vj.nearest(frame(spark, [(1, [1.0]), (2, [1.0])])).collect() == []


def test_copies_of_the_query(spark):
    rows = [(100, [1.0, 1.0])] + [(k, [1.0, 1.0]) for k in range(1, 90)] + [(k, [1.0, 2.0]) for k in range(101, 105)]
    assert sorted(map(tuple, vj.nearest(frame(spark, rows)).collect())) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for scale in (1e-160, 1.0, 1e100):
        a, b = (rng.normal(size=(40, 1500)) * scale * 10 ** rng.uniform(-6, 6, size=(40, 1)) for _ in range(2))
        low, high = vj.bounds(vj.Quantised(a), vj.Quantised(b))
        exact = np.array([vj.distances(np.repeat(x[None], len(b), 0), b) for x in a])
        assert (low <= exact).all() and (exact <= high).all()
    a = vj.Quantised(rng.normal(size=(50, 3000)))
    assert (vj.products(a.q, a.q) == a.q.astype(np.int64) @ a.q.astype(np.int64).T).all()


def test_bounds_rule_most_pairs_out():
    rng = np.random.default_rng(6)
    a, b = vj.Quantised(rng.normal(size=(100, 64))), vj.Quantised(rng.normal(size=(4000, 64)))
    low, high = vj.bounds(a, b)
    left = low <= np.partition(high, 10, axis=1)[:, 10:11]
    assert left.sum() < 0.02 * left.size
