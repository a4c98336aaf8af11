"""Registry tables with several writers, columns of later versions, and small files that are whole or not there."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from thermoline.operators import registry
from thermoline.sources import files


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, status string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/registry"
    with pytest.raises(ValueError, match="no registry table"):
        files.registry_table(spark, path)
    files.update_table(spark, path, lambda old: table(spark, (1, "a"), (2, "b")))
    before = files.registry_table(spark, path)
    files.update_table(spark, path, lambda old: old.withColumn("status", F.upper("status")))  # from the table itself
    assert rows(before) == [(1, "a"), (2, "b")]
    assert rows(files.registry_table(spark, path)) == [(1, "A"), (2, "B")]
    assert rows(files.registry_table(spark, path, version=1)) == [(1, "a"), (2, "b")]


def test_a_late_writer_loses_no_update(spark, tmp_path):
    path = f"file://{tmp_path}/registry"
    files.update_table(spark, path, lambda old: table(spark, (1, "a"), (2, "b")))
    seen = []

    def slow(old):
        seen.append(rows(old))
        if len(seen) == 1:  # another writer comes in between
            files.update_table(spark, path, lambda x: registry.upserted(x, table(spark, (1, "first"))))
        return registry.upserted(old, table(spark, (2, "second")))

    assert files.update_table(spark, path, slow) == 3
    assert seen == [[(1, "a"), (2, "b")], [(1, "first"), (2, "b")]]
    assert rows(files.registry_table(spark, path)) == [(1, "first"), (2, "second")]
    with pytest.raises(files.Conflict):
        files.write_table(spark, table(spark, (9, "late")), path, 1)


def test_writers_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/registry"
    files.update_table(spark, path, lambda old: table(spark, (0, "base")))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: files.update_table(spark, path, lambda old: registry.upserted(old, table(spark, (k, "x")))), range(1, 5)))
    assert [i for i, _ in rows(files.registry_table(spark, path))] == [0, 1, 2, 3, 4]


def test_later_columns(spark, tmp_path):
    path = f"file://{tmp_path}/registry"
    files.update_table(spark, path, lambda old: table(spark, (1, "a")))
    later = {"frame_stride": F.lit(1), "angle": F.lit(None).cast("double"), "status": F.lit("never")}
    got = files.registry_table(spark, path, later)
    assert got.columns == ["id", "status", "frame_stride", "angle"] and rows(got) == [(1, "a", 1, None)]
    files.update_table(spark, path, lambda old: registry.upserted(old, spark.createDataFrame([(2, "b", 3)], "id long, status string, frame_stride int")))
    assert sorted(map(tuple, files.registry_table(spark, path, later).select("id", "frame_stride").collect()), key=str) == [(1, None), (2, 3)]


def test_small_files(spark, tmp_path):
    path = f"file://{tmp_path}/deep/summary.json"
    files.put_text(spark, path, '{"a": 1}')
    files.put_text(spark, path, '{"a": "é"}')
    assert (tmp_path / "deep" / "summary.json").read_text() == '{"a": "é"}'
    with pytest.raises(files.Conflict):
        files.put_text(spark, path, "x", replace=False)
    assert sorted(p.name for p in (tmp_path / "deep").iterdir() if not p.name.endswith(".crc")) == ["summary.json"]
