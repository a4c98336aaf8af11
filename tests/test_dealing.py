from thermoline.operators import dealing
from thermoline.plans import virtual


def tasks(df):
    return df.rdd.getNumPartitions()


def test_tasks_grow_with_rows(spark):
    """Also where the shuffled rows are small, and what becomes of them is not."""
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert tasks(dealing.dealt(rows, "k")) == 1
    assert tasks(dealing.dealt(rows, "k", rows=50 * dealing.TASK_ROWS)) == 50
    assert tasks(dealing.dealt(rows, "k", rows=dealing.TASK_ROWS, width=60)) == 60


def test_runs_are_dealt_by_their_number_of_rows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    events.select("event_id", "ts", "user_id", "event_type", "value", "props").unionAll(events).write.parquet(f"{tmp_path}/events.parquet")
    least, dealing.TASK_ROWS = dealing.TASK_ROWS, 500
    try:
        assert tasks(virtual.progress(spark, str(tmp_path))) == 40
    finally:
        dealing.TASK_ROWS = least


def test_stored_series_and_candidates_are_dealt(spark):
    from thermoline.operators import candidates
    from thermoline.plans import series_queries

    paths = spark.range(4000).selectExpr("id DIV 4 AS frame", "concat('c', id) AS candidate", "id * 1.0D AS length_px", "id * 1.0D AS axis_span_px", "0.5D AS support")
    least, dealing.TASK_ROWS = dealing.TASK_ROWS, 100
    try:
        assert tasks(candidates.centerlines(paths, ["frame"])) == 40
        d = "/root/testdata/sf0.001"
        n = virtual.events(spark, d).count()
        assert tasks(series_queries._wire(spark, d)[0]) == -(-4 * n // 100)
        assert tasks(series_queries._braided(spark, d)[0]) == -(-3 * n // 100)
    finally:
        dealing.TASK_ROWS = least


def reshuffled(df):
    """Shuffles of the rows that each row of a series becomes, before they are summed up."""
    lines = [x.strip(" :+-*()0123456789") for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    passed = ("Project", "Filter", "Sort ", "Window")
    below = [next(y for y in lines[i + 1 :] if not y.startswith(passed)) for i, x in enumerate(lines) if x.startswith("Exchange")]
    return [x for x in below if x.startswith("Generate inline")]


def without_broadcast(spark, check):
    """Reports of many runs are too large to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_metrics_stay_where_their_runs_were_dealt(spark):
    from thermoline.operators import routes
    from thermoline.plans import series_queries

    d = "/root/testdata/sf0.001"

    def check():
        for kind, source in (("wire", series_queries._wire), ("braided", series_queries._braided)):
            series, report = source(spark, d)
            assert reshuffled(routes.gate_table(kind, series, report)) == []
            assert reshuffled(routes.scores(kind, series, report)) == []

    without_broadcast(spark, check)


def test_a_direction_that_is_told_by_the_run_moves_no_rows(spark, monkeypatch):
    from thermoline.operators import fit, qc
    from thermoline.plans import analysis

    monkeypatch.setattr(dealing, "TASK_ROWS", 50)
    series = dealing.dealt(qc.braided_columns(virtual.braided_series(spark, "/root/testdata/sf0.001")), "run_id")
    found = []
    monkeypatch.setattr(fit, "reports", lambda long: found.append(reshuffled(long)) or spark.createDataFrame([], fit.REPORT))
    without_broadcast(spark, lambda: analysis.evaluated(series, analysis.BRAIDED))
    assert found == [[]]


def test_both_choices_of_a_run_share_their_scores(spark):
    """A stage that makes them twice, side by side, holds twice the sorts and aggregates."""
    from thermoline.operators import routes
    from thermoline.plans import series_queries

    d = "/root/testdata/sf0.001"

    def check():
        for kind, source in (("wire", series_queries._wire), ("braided", series_queries._braided)):
            series, report = source(spark, d)
            plan = routes.select(kind, series, report, routes.gate_table(kind, series, report))._jdf.queryExecution().executedPlan().toString()
            made = [x for x in plan.splitlines() if "Generate inline" in x and "by_temperature" not in x]
            assert len(made) == 1

    without_broadcast(spark, check)


def test_choices_of_stored_gates_meet_no_rows_of_a_series(spark):
    from thermoline.plans import series_queries

    for kind in ("wire", "braided"):
        chosen = series_queries._selected(kind, spark, "/root/testdata/sf0.001")[3]
        assert "Generate" not in chosen._jdf.queryExecution().executedPlan().toString()
