import hashlib
import pickle
import random
import re

import pyarrow as pa
import pytest

from thermoline.llm import decontam as d


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "").lower().strip()


def edits(item, text):
    """Least edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edit_distance_matches_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, m))) for m in (90, 40))
        assert d.edit_distance(a, b) == edits(a, b)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def spoiled(text, n, rng):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], ["q"], [out[k], "q"]])
    return "".join(out)


def test_finds_exact_and_edited_items(spark, benchmark, table):
    rng = random.Random(2)
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    filler = " ".join(f"filler{k} words" for k in range(30))
    rows, want = [], {}
    for n, (i, t) in enumerate(items):
        share = (0, 0.02, 0.05, 0.08, 0.3)[n % 5]
        rows.append((n, f"{filler} {spoiled(t.upper() if n % 3 == 0 else t, int(share * len(t)), rng)} {filler}"))
        want[n] = {k for k, x in items if d.edit_distance(norm(x), norm(rows[-1][1])) <= len(norm(x)) * d.EDIT_PERCENT // 100}
        assert (i in want[n]) == (share < 0.3)
    got = {r.doc_id: r for r in d.contamination(table(rows), benchmark).collect()}
    for n in want:
        assert set(got[n].item_ids) == want[n] and got[n].n_items == len(want[n])
        for k, e in zip(got[n].item_ids, got[n].edits, strict=True):
            assert e == edits(norm(dict(items)[k]), norm(rows[n][1]))


def test_matches_brute_force(real, benchmark):
    items = {r.item_id: norm(r.text) for r in benchmark.collect()}
    got = d.contamination(real, benchmark).collect()
    assert len(got) == real.count()
    texts = {r.doc_id: norm(r.text) for r in real.collect()}
    for r in got:
        held = {k for k, x in items.items() if x in texts[r.doc_id]}
        assert held <= set(r.item_ids)
        for k, e in zip(r.item_ids, r.edits, strict=True):
            assert 0 < e <= len(items[k]) // 10 if k not in held else e == 0
    assert any(r.n_items for r in got)


def test_blocks_of_items_give_the_same(real, benchmark):
    key = lambda r: (r.doc_id, r.item_ids, r.edits)
    whole, parts = d.contamination(real, benchmark), d.contamination(real, benchmark, block_bytes=12_000)
    assert sorted(map(key, whole.collect())) == sorted(map(key, parts.collect()))


def test_odd_rows(spark, table, odd, benchmark):
    item = benchmark.first()
    odd_items = spark.createDataFrame([(None, "some text"), (900, None), (901, ""), (902, " \n "), (903, "short item here"), (903, "short item here"), (item.item_id, item.text)], "item_id long, text string")
    rows = [*odd, (60, f"x {item.text}"), (61, "a short  ITEM here b"), (62, "a short item heres"), (62, "a short item heres")]
    got = {(r.doc_id, tuple(r.item_ids)) for r in d.contamination(table(rows), odd_items).collect()}
    assert (60, (item.item_id,)) in got and (61, (903,)) in got and (62, (903,)) not in got
    assert d.contamination(table([]), odd_items).count() == 0
    assert d.contamination(table(rows), odd_items.limit(0)).where("n_items > 0").count() == 0
    docs = table(rows)
    kept = d.clean(docs, odd_items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id and r.doc_id >= 60) == [62, 62]


def test_recall_of_the_walks(benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    index = d.Index(items)
    assert index.recalls and all(r >= d.TARGET_RECALL for *_, r, _ in index.recalls)
    assert sum(low <= len(norm(t)) <= high for _, t in items for _, low, high, *_ in index.recalls) >= len(items)
    rng = random.Random(8)
    texts = [(k, spoiled(r.text, len(r.text) * 7 // 100, rng)) for k, r in enumerate(benchmark.collect() * 5)]
    found = index.matches(pa.array([t for _, t in texts]))
    n = len(items)
    assert sum(k % n in got for (k, _), got in zip(texts, found, strict=True)) >= 0.97 * len(texts)


def script(rng, n, first=0x4E00, many=1500):
    return "".join(chr(first + min(int(rng.paretovariate(0.4)), many)) for _ in range(n))


def test_items_without_spaces_inside_such_text(spark, table):
    rng = random.Random(12)
    items = [(k, script(rng, rng.choice((20, 60, 90)), first)) for k, first in enumerate([0x4E00] * 90 + [0x0E01] * 30)]
    rows, want = [], {}
    for n in range(240):
        k, t = items[n // 2]
        copy = t if n % 2 else spoiled(t, len(t) // 10, rng)
        rows.append((n, script(rng, 50) + copy + script(rng, 50)))
        want[n] = {x for x, i in items if d.edit_distance(i, rows[-1][1]) <= len(i) // 10}
        assert k in want[n]
    got = {r.doc_id: set(r.item_ids) for r in d.contamination(table(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(got[n] <= want[n] for n in want)
    assert all(n // 2 in got[n] for n in want if n % 2)
    assert sum(len(got[n]) for n in want) >= 0.98 * sum(map(len, want.values()))


def test_a_thousand_items_with_a_shared_line():
    rng = random.Random(13)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, f"Choose the best answer to the question that follows. {text(rng.randint(25, 60))}") for k in range(1000)]
    index = d.Index(items)
    assert all(r >= d.TARGET_RECALL for *_, r, _ in index.recalls)
    texts = [f"{text(30)} {spoiled(t, len(t) // 12, rng)} {text(30)}" for _, t in items[::5]] + ["Choose the best answer to the question that follows."] * 50
    found = index.matches(pa.array(texts))
    assert sum(5 * n in got for n, got in enumerate(found[:200])) >= 198
    assert not any(found[200:])


def test_an_index_that_was_sent_finds_the_same(benchmark, real):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    column = pa.array([r.text for r in real.collect()])
    assert d.Index(items).matches(column) == pickle.loads(pickle.dumps(d.Index(items))).matches(column)


def test_short_items_with_edits_and_punctuation(spark, table):
    items = spark.createDataFrame([(1, "Who wrote the tale of the red lamp?"), (2, "short item here"), (None, "an item without an id, but with a text")], "item_id long, text string")
    texts = ["x who wrote the tale of the rad lamp? y", "she asked (who wrrote the tle of the red lamp?).", "a “short item here”, b", "a short itm here.", "a short item heres", "unshort item here", "who sang the song of the blue lamp?", "an item without an id, but with a text"]
    want = [[1], [1], [2], [2], [], [], [], []]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in d.contamination(table(rows), items).collect()}
    assert [got[k].item_ids for k, _ in rows] == want
    assert [got[k].edits for k in range(4)] == [[1], [2], [0], [1]]
    assert sorted(r.doc_id for r in d.clean(table(rows), items).collect()) == [4, 5, 6]
    assert sorted(k for k, r in got.items() if r.n_items == 0) == [4, 5, 6]
    assert (got[7].n_items, got[7].unnamed_items, got[7].unnamed_edits) == (1, [hashlib.sha256(texts[7].encode()).hexdigest()], [0]) and got[0].unnamed_items == []


def test_items_without_an_id_in_blocks(spark, table):
    items = [(None, f"the {n} thing that has no name at all, said the {n} of them") for n in ("first", "second", "third")] + [(4, "the fourth thing that has a name, said the fourth of them")]
    rows = [(k, f"x {t} y") for k, (_, t) in enumerate(items)] + [(9, " and ".join(t for _, t in items)), (10, "nothing of it")]
    frame = spark.createDataFrame(items + items[:1], "item_id long, text string")
    whole, parts = (sorted(map(tuple, d.contamination(table(rows), frame, block_bytes=b).collect())) for b in (1 << 22, 60))
    assert whole == parts
    assert [(r[0], r[1], r[2]) for r in whole] == [(0, 1, []), (1, 1, []), (2, 1, []), (3, 1, [4]), (9, 4, [4]), (10, 0, [])]
    assert [r.doc_id for r in d.clean(table(rows), frame, block_bytes=60).collect()] == [10]


def test_items_that_walks_miss_are_found_by_pieces():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(12))
    items = [(k, " ".join(word() for _ in range(4))) for k in range(40)] + [(40 + k, " ".join(word() for _ in range(30))) for k in range(400)]
    index = d.Index(items)
    texts = [(k, spoiled(t, len(t) // 10, rng)) for k, t in items[:40] * 5]
    found = index.matches(pa.array([f"before {t} after" for _, t in texts]))
    assert all(r >= d.TARGET_RECALL for *_, r, _ in index.recalls)
    want = [edits(dict(items)[k].encode(), t.encode()) <= len(dict(items)[k]) // 10 for k, t in texts]
    assert sum(want) == len(texts) and sum(k in got for (k, _), got in zip(texts, found, strict=True)) >= 0.99 * len(texts)
