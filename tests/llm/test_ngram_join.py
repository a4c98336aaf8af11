import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from thermoline.llm import ngram_join as n

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, threshold=0.8):
    """Class and links of each row, by comparing all pairs of different sets."""
    copies = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        copies[shingle_set(t)].append(k)
    alone = copies.pop(frozenset(), [])
    sets = list(copies)
    home, links = list(range(len(sets))), [len(copies[s]) - 1 for s in sets]

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both >= threshold * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                links[x] += len(copies[sets[y]])
                links[y] += len(copies[sets[x]])
                home[root(x)] = root(y)
    ids = lambda ks: [rows[k][0] for k in ks if rows[k][0] is not None]
    members = defaultdict(list)
    for x, s in enumerate(sets):
        members[root(x)] += copies[s]
    out = [(rows[k][0], rows[k][0], 0) for k in alone]
    for x, s in enumerate(sets):
        least = min(ids(members[root(x)]), default=None)
        out += [(rows[k][0], least, links[x]) for k in copies[s]]
    return sorted(out, key=str)


def check(docs, rows):
    assert sorted(map(tuple, n.near_duplicates(docs).collect()), key=str) == brute(rows)


def near_copies(seed, count, words=60):
    """One text and copies with one to three words changed: copies of a copy's distance may be too far for one another."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_matches_brute_force(real):
    check(real, [(r.doc_id, r.text) for r in real.collect()])


def test_odd_rows(table, odd):
    rows = [*odd, (20, "one two three"), (21, "one two"), (22, "one  two\nthree"), (23, "é a b c d e"), (24, "é a b c d e")]
    check(table(rows), rows)
    assert n.near_duplicates(table([])).count() == 0


def test_group_over_many_blocks(table, monkeypatch):
    monkeypatch.setattr(n, "BLOCK_SETS", 7)
    texts = near_copies(1, 60) + near_copies(2, 3) + ["unrelated " + " ".join(f"u{k}" for k in range(30))]
    rows = list(enumerate(texts))
    check(table(rows), rows)


def test_depth_reaches_the_target():
    for target in (0.9, 0.99, 0.999):
        d = n.depth(target=target)
        assert 1 - (1 - 0.8**d) ** n.TREES >= target
        assert d == n.LABEL or 1 - (1 - 0.8 ** (d + 1)) ** n.TREES < target
    assert n.depth(target=0.9) >= n.depth(target=0.999)


def test_recall_at_the_threshold(spark):
    """Pairs a little above 0.8 are the hardest."""
    rng = random.Random(4)
    rows = []
    for k in range(300):
        w = [f"p{k}w{j}" for j in range(84)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:40] + [f"z{rng.random()}"] + w[41:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    both = len(shingle_set(rows[0][1]) & shingle_set(rows[1][1]))
    assert 0.8 <= both / (160 - both) < 0.89
    found = n.near_duplicates(docs).where("n_links = 1").count()
    assert found >= 0.98 * 600


def test_similar_is_the_jaccard_rule():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    wanted = ~np.eye(60, dtype=bool)
    got = n._similar(sets, wanted, 0.5)
    for x in range(60):
        for y in range(60):
            a, b = set(sets[x].tolist()), set(sets[y].tolist())
            share = len(a & b) / len(a | b)
            assert got[x, y] == (share if x != y and share >= 0.5 else 0)
            assert n._similar([sets[x], sets[y]], ~np.eye(2, dtype=bool), 0.5)[0, 1] == (share if share >= 0.5 else 0)


def test_descent_goes_as_deep_as_its_links_need(table, monkeypatch):
    """Links well above the threshold are found at whole labels; links just above it need shorter prefixes."""
    monkeypatch.setattr(n, "LEAST_LINKS", 20)

    def levels(words):
        rows = []
        for k in range(150):
            w = [f"p{k}w{j}" for j in range(words)]
            rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:40] + ["z"] + w[41:]))]
        return n.measured_recall(table(rows))

    high, low = levels(400), levels(50)
    assert [d for d, *_ in high] == [n.LABEL] and high[0][1] == 150 and high[0][2] >= n.TARGET_RECALL
    assert [d for d, *_ in low] == [n.LABEL, n.LABEL - 1] and low[0][2] < n.TARGET_RECALL <= low[1][2] and low[1][1] >= 0.97 * 150


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 101), (103, 100)]
    got = dict(n.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100}


def test_one_of_each(table, odd):
    rows = [*odd, (20, "one two three"), *((30 + k, t) for k, t in enumerate(near_copies(7, 6)))]
    docs = table(rows).withColumn("thermoline_rkey", F.lit(7)).withColumn("row_key_0", F.lit(8))
    kept = n.one_of_each(docs)
    assert {(r.thermoline_rkey, r.row_key_0) for r in kept.collect()} == {(7, 8)}
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got))  # of repeated rows one
    assert {(i, t) for i, t in rows if not shingle_set(t)} <= set(got)
    worded = [(i, t) for i, t in got if shingle_set(t)]
    ranked = sorted((r for r in rows if shingle_set(r[1])), key=lambda r: (r[0] is None, r[0] or 0))
    classes = {c for _, c, _ in brute([(k, t) for k, (_, t) in enumerate(ranked)])}  # by place: two classes may share an id
    assert sorted(i for i, _ in worded) == sorted(ranked[k][0] for k in classes)


def test_rows_alike_in_id_and_text_alone(table):
    docs = table([(1, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l")]).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    other = docs.where("doc_id = 1").withColumn("source", F.lit("other"))
    kept = n.one_of_each(docs.union(other)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2]
    assert len({tuple(sorted(r.source for r in n.one_of_each(x).collect())) for x in (docs.union(other), other.union(docs))}) == 1
