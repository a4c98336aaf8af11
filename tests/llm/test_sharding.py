import math
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions

from thermoline.llm import sharding as s


def spark_hash(*parts):
    h = 42
    for x in parts:
        h = xxhash.xxh64_intdigest(x.encode(), seed=h)
    return h


def draw(key, label, weight):
    return -math.log(((spark_hash(key, label) >> 11) + 0.5) / 2**53) / weight


def brute(tree, key):
    level, first = [], 0
    for r, region in enumerate(tree.regions):
        racks = []
        for k, rack in enumerate(region):
            racks.append((draw(key, f"{r}/{k}", sum(rack)), [(draw(key, f"{r}/{k}/{first + n}", w), first + n) for n, w in enumerate(rack)]))
            first += len(rack)
        level.append((draw(key, f"{r}", sum(map(sum, region))), racks))
    for epoch, added in enumerate(tree.added):
        named = [(r, k, w, first + n) for n, (r, k, w) in enumerate(added)]
        first += len(added)
        for r in {x[0] for x in named}:
            racks = [(draw(key, f"{r}/{k}+{epoch}", sum(w for r2, k2, w, _ in named if (r2, k2) == (r, k))), [(draw(key, f"{r}/{k}/{n}", w), n) for r2, k2, w, n in named if (r2, k2) == (r, k)]) for k in {x[1] for x in named if x[0] == r}]
            level.append((draw(key, f"{r}+{epoch}", sum(w for r2, _, w, _ in named if r2 == r)), racks))
    got = min(level, key=lambda x: x[0])[1]
    while isinstance(got, list):
        got = min(got, key=lambda x: x[0])[1]
    return got


WEIGHTS = (1.0, 1.5, 2.0)


def check(rows, got):
    eight, nine = s.HashTree.sized(WEIGHTS, 8), s.HashTree.sized(WEIGHTS, 9)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for r in got:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.law, r.shard, r.grown_shard) == ("key", brute(eight, key), brute(nine, key))
        assert r.grown_shard in (r.shard, 8)
    for n in range(8):
        assert sorted(r.slot for r in got if r.shard == n) == list(range(sum(r.shard == n for r in got)))


def test_matches_brute_force(real):
    rows = [(r.doc_id, r.text) for r in real.collect()]
    check(rows, s.sharded(real, s.HashTree.sized(WEIGHTS, 8), s.HashTree.sized(WEIGHTS, 9)).collect())


def test_many_small_groups(real):
    rows = [(r.doc_id, r.text) for r in real.collect()]
    check(rows, s.sharded(real, s.HashTree.sized(WEIGHTS, 8), s.HashTree.sized(WEIGHTS, 9), rows_per_group=3).collect())


def test_odd_rows(table, odd):
    check(odd, s.sharded(table(odd), s.HashTree.sized(WEIGHTS, 8), s.HashTree.sized(WEIGHTS, 9)).collect())
    assert s.sharded(table([]), s.HashTree.even(8), s.HashTree.even(9)).count() == 0


def test_growth_moves_rows_only_into_the_new_shard_at_the_right_odds(spark):
    keys = spark.range(40_000).selectExpr("cast(id AS string) AS k")
    trees = [s.HashTree.even(n) for n in range(8, 13)]
    rows = keys.select(*(t.shard(keys.k).alias(f"n{t.shards}") for t in trees)).collect()
    for n in range(8, 12):
        assert all(r[f"n{n + 1}"] in (r[f"n{n}"], n) for r in rows)
    for t in trees:
        for x in Counter(r[f"n{t.shards}"] for r in rows).values():
            assert abs(x - 40_000 / t.shards) < 5 * math.sqrt(40_000 / t.shards)


def test_weights_are_the_odds(spark):
    tree = s.HashTree((((1.0, 3.0),), ((2.0,), (2.0,))))
    got = Counter(r.n for r in spark.range(40_000).selectExpr("cast(id AS string) AS k").select(tree.shard(functions.col("k")).alias("n")).collect())
    for n, w in enumerate((1, 3, 2, 2)):
        assert abs(got[n] - 5000 * w) < 5 * math.sqrt(5000 * w)


def test_an_epoch_of_several_shards_moves_rows_only_into_them(spark):
    old = s.HashTree.sized(WEIGHTS, 8)
    new = s.HashTree(old.regions, (((0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)),))
    rows = spark.range(40_000).selectExpr("cast(id AS string) AS k").select("k", old.shard(functions.col("k")).alias("a"), new.shard(functions.col("k")).alias("b")).collect()
    assert all(r.b in (r.a, 8, 9, 10) for r in rows)
    total = sum(WEIGHTS[n % 3] for n in range(8)) + 6
    for n, w in ((8, 1), (9, 2), (10, 3)):
        assert abs(sum(r.b == n for r in rows) - 40_000 * w / total) < 5 * math.sqrt(40_000 * w / total)
    assert all(r.b == brute(new, r.k) for r in rows[:300])


def test_many_rows_of_one_id_are_numbered_in_many_groups(table):
    rows = [(None, "same")] * 5000 + [(7, f"t{k}") for k in range(5000)]
    check(rows, s.sharded(table(rows), s.HashTree.sized(WEIGHTS, 8), s.HashTree.sized(WEIGHTS, 9), rows_per_group=50).collect())
