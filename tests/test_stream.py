"""Regions in a stream whose frames come out of order, against the same in batch."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermoline.streaming import tracking

SCHEMA = "run_id long, frame long, at timestamp, x0 int, y0 int, x1 int, y1 int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def played(spark, folder, batches, name, **options):
    """The stream's rows after all batches, a file each."""
    for rows in batches:
        spark.createDataFrame(rows, "run_id long, frame long, at double, x0 int, y0 int, x1 int, y1 int").withColumn("at", F.timestamp_millis((F.col("at") * 1000 + 1_000_000).cast("long"))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # files are read in order of time
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = tracking.tracked_stream(stream, 100, 60, **options).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").start()
    try:
        q.processAllAvailable()
        progress = q.lastProgress
    finally:
        q.stop()
    return sorted(map(tuple, spark.table(name).collect())), progress


def test_shuffled_frames_give_the_rows_of_the_batch(spark, rocks, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(r, k, k * 1.0, *((None,) * 4 if rng.random() < 0.2 else (10 + k, 12, 40 + k, 30))) for r in range(3) for k in range(30)]
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] + rng.uniform(0, 6))  # at most six seconds late
    batches = [[rows[i] for i in order[k : k + 30]] for k in range(0, 90, 30)] + [[(9, 0, 1000.0, 1, 1, 2, 2)]]
    got, progress = played(spark, tmp_path, batches, "shuffled")
    whole = spark.createDataFrame([(r[0], r[1], *r[3:]) for r in rows], "run_id long, frame long, x0 int, y0 int, x1 int, y1 int")
    assert [r for r in got if r[0] != 9] == sorted(map(tuple, tracking.tracked(whole, 100, 60).collect()))
    # Runs that are over are forgotten: all that is left is the last frame, which waits.
    assert progress.stateOperators[0].numRowsTotal <= 4


def test_a_frame_behind_the_watermark_is_left_out(spark, rocks, tmp_path):
    batches = [[(1, 0, 0.0, 1, 1, 9, 9), (1, 2, 2.0, 5, 5, 9, 9)], [(1, 3, 50.0, 6, 6, 9, 9)], [(1, 4, 60.0, 6, 6, 9, 9)], [(1, 1, 1.0, 2, 2, 9, 9)], [(1, 5, 200.0, 7, 7, 9, 9)]]
    got, _ = played(spark, tmp_path, batches, "behind", idle_sec=10_000.0)
    assert [r[1] for r in got] == [0, 2, 3, 4]
