"""Rows dealt by key into tasks of bounded size, for steps that hold all of a task's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task, and how few are worth a task of their own.
TASK_ROWS, LEAST_ROWS = 100_000, 2_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None, width: int = 1) -> DataFrame:
    """The rows, those of a key in one task, in as many tasks as there are `TASK_ROWS` of them.

    Windows, groups and sorts by these keys need no further shuffle, so what a task holds is told
    by its rows and not by the size of shuffled files, which may be a small part of what becomes of
    them. `rows` is their number; without it they are counted, which a stored table answers from its
    footers. `width` is how many rows each becomes later.
    """
    rows = (df.count() if rows is None else rows) * width
    least = min(df.sparkSession.sparkContext.defaultParallelism, rows // LEAST_ROWS)
    return df.repartition(max(1, least, -(-rows // TASK_ROWS)), *keys)
