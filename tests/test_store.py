"""Series in buckets of runs, in folders by run, and read again."""

import math
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from thermoline.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_spare_shuffles(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id % 37 AS run_id", "id DIV 37 AS frame", "id * 1.5D AS v")
    table = files.store_series(rows, "series_in_buckets", f"file://{tmp_path}/series", 8)
    try:
        assert table.count() == 1000
        w = Window.partitionBy("run_id").orderBy("frame")
        windowed = table.withColumn("step", F.col("v") - F.lag("v").over(w)).groupBy("run_id").agg(F.max("step").alias("most"))
        assert "Exchange" not in plan(windowed)
        assert {r.most for r in windowed.collect()} == {55.5}
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # with it a plan doesn't tell what it prunes
        one = table.where("run_id = 5 AND frame = 3")
        assert re.search(r"SelectedBucketsCount: 1 out of 8", plan(one))
        assert [r.v for r in one.collect()] == [(3 * 37 + 5) * 1.5]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = table.join(windowed, "run_id")
        assert "Exchange" not in plan(joined) and joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE series_in_buckets")


def test_series_by_run(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 1.0, "a"), (1, 1, math.nan, None), (2, 0, math.inf, "b")], "run_id long, frame long, v double, note string")
    files.write_series(rows, str(tmp_path / "series"))
    assert sorted(p.name for p in (tmp_path / "series").iterdir() if p.is_dir()) == ["run_id=1", "run_id=2"]
    got = files.series(spark, str(tmp_path / "series")).select("run_id", "frame", "v", "note").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1.0, "a"), (1, 1, None, None), (2, 0, None, "b")]
