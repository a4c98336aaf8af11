import re
from collections import Counter
from itertools import permutations

import duckdb

from thermoline.llm import filter_audit as fa
from thermoline.llm import queries


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = {}
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least.get(t, i)}
        docs.setdefault(lang or "", []).append(({x for x, bad in fails.items() if bad}, i is not None and i in good, i is not None and i in toxic))
    out = []
    for part, members in docs.items():
        removed_by = Counter()
        lines = []
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                here = [m for m in members if x in m[0] and not m[0] & before]
                removed_by[x] += len(here)
                lines.append((x, part, "".join(order), k + 1, sum(not m[0] & (before | {x}) for m in members), len(here), sum(x in m[0] and bool(m[0] & before) for m in members), sum(m[0] == {x} for m in members), sum(m[1] for m in here), sum(m[2] for m in here)))
        out += [(*rest, removed_by[x]) for x, *rest in lines]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_table_and_sql(spark):
    at = "/root/testdata/sf0.001"
    df = queries.op11_word_audit(spark, at)
    assert df.columns == COLUMNS
    got = sorted(map(tuple, df.collect()))
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{at}/labels.parquet").collect()]
    assert got == brute(rows, labels)
    with duckdb.connect() as db:
        for t in ("documents", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
        assert sorted(db.sql(fa.oracle_sql()).project(", ".join(COLUMNS)).fetchall()) == got


def test_odd_rows(spark, odd):
    long = " ".join(f"w{k}" for k in range(150))
    langs = ["en", "de", None, "", "x"]
    rows = [(i, t, langs[k % 5]) for k, (i, t) in enumerate(odd)]
    rows += [(20, long, "en"), (20, long, "en"), (21, long, "de"), (None, long, "en"), (20, long, "x"), (20, long.upper(), "en"), (22, long + " #", None), (23, "é" * 9 + "A", "en"), (24, "é" * 8 + "A", "en"), (25, long.upper(), "de")]
    labels = [(20, 1, 1), (20, 0, None), (21, 0, 1), (None, 1, 1), (2, 1, 0), (24, None, None), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "'y' AS word", "2 AS digest", "3 AS part", "4 AS copies", "5 AS good", "6 AS salt")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS id", "7 AS good")
    assert sorted(map(tuple, fa.audit(docs, table).collect())) == brute(rows, labels)
    assert sorted(map(tuple, fa.audit(docs, table.limit(0)).collect())) == brute(rows, [])
    assert fa.audit(docs.limit(0), table).collect() == []


def test_many_rows_of_one_id_and_text(spark):
    rows = [(5, "Same words, same words |", "en")] * 2000 + [(k, "Same words, same words |", "en") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(20)
    assert sorted(map(tuple, fa.audit(docs, spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")).collect())) == brute(rows, [(5, 1, 0)])


def test_words_need_one_shuffle_of_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = fa.word_counts(fa._keyed(docs, "doc_id", "text", "lang"), 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("+- == Initial Plan ==")[-1].count("Exchange") == 2  # texts, then one row a key and salt
