"""Nested settings against a recursive merge in Python."""

import json
import random

import pytest

from thermoline.operators import settings


def merge(base, over):
    if not (isinstance(base, dict) and isinstance(over, dict)):
        return over
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(base[k], v) if k in base else v
    return out


def document(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([None, True, 3, -2, 0.5, "text", 'with "quotes" \\ and é', [1, {"a": 2}], [], {}])
    return {rng.choice(["a", "b", "c", "d e", 'q"x']): document(rng, depth - 1) for _ in range(rng.randint(0, 3))}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    docs = [({k: document(rng, 3) for k in "abc"}, {rng.choice("abcd"): document(rng, 3) for _ in range(rng.randint(0, 3))}) for _ in range(150)]
    return docs + [({"a": 1}, {}), ({}, {"a": {"b": None}}), ({"a": {"b": 1}}, {"a": {}}), ({"a": 5}, {"a": {}}), ({}, {}), ({"a": {}}, {"a": {"x": {"y": {"z": 1}}}})]


def test_merge(spark, rows):
    df = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, (a, b) in enumerate(rows)], "id long, base string, over string")
    got = {r.id: r.json for r in settings.merged_documents(df, "id", "base", "over").collect()}
    assert len(got) == len(rows)
    for k, (a, b) in enumerate(rows):
        assert json.loads(got[k]) == merge(a, b), (a, b)


def test_damaged_documents(spark):
    df = spark.createDataFrame([(1, '{"a": 1}', "{broken"), (2, '{"a": 1}', None), (3, "{broken", '{"a": 2}'), (4, '{"a": 1}', "7")], "id long, base string, over string")
    got = {r.id: r.json for r in settings.merged_documents(df, "id", "base", "over").collect()}
    assert got == {1: '{"a":1}', 2: '{"a":1}', 3: '{"a":2}', 4: "7"}


def test_unset_and_null_differ(spark):
    df = spark.createDataFrame([(1, '{"a": null, "b": {}}')], "id long, t string")
    assert sorted((tuple(r.path), r.value) for r in settings.leaves(df, "id", "t").collect()) == [(("a",), "null"), (("b",), "{}")]


def test_leaves_stay_with_their_document(spark):
    """Documents are dealt once; no join, group or window of their leaves needs another shuffle."""
    df = spark.createDataFrame([(1, '{"a": 1}', '{"a": 2}')], "id long, base string, over string")
    plan = settings.merged_documents(df, "id", "base", "over")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
