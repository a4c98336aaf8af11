"""Sources and sinks: temperature logs, frames, summaries, analysis tables, schedules."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoline.functions.scalar import finite, number_or_null

#: Frames are rows: a decoder outside the engine makes them, as Parquet.
FRAME_SCHEMA = "run_id long, frame long, fps double, height int, width int, channels int, pixels binary"


def temperature_log(spark: SparkSession, path: str, run_id: int) -> DataFrame:
    """A log in CSV: temperature_c with frame or time_sec; other headers are an error, text in place of numbers NULL."""
    raw = spark.read.csv(path, header=True)
    if "temperature_c" not in raw.columns:
        raise ValueError("the log has no column temperature_c")
    if not {"frame", "time_sec"} & set(raw.columns):
        raise ValueError("the log has neither frame nor time_sec")
    frame = F.col("frame").try_cast("long") if "frame" in raw.columns else F.lit(None).cast("long")
    time = number_or_null(F.col("time_sec")) if "time_sec" in raw.columns else F.lit(None).cast("double")
    return raw.select(F.lit(run_id).cast("long").alias("run_id"), frame.alias("frame"), time.alias("time_sec"), number_or_null(F.col("temperature_c")).alias("temperature_c"))


def series(spark: SparkSession, path: str) -> DataFrame:
    """An analysis table in Parquet, NaN and infinities turned into NULL."""
    df = spark.read.parquet(path)
    return df.select(*(finite(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


def write_series(df: DataFrame, path: str) -> None:
    """A folder for each run, as other tools read it; for many runs see store_series."""
    df.write.mode("overwrite").partitionBy("run_id").parquet(path)


def store_series(df: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """A table in buckets of runs, sorted by run and frame, as an external table at `path`; returns it.

    What is partitioned by run, such as windows, gates and joins with a table of as many buckets, needs no
    shuffle of it, and a run's frames lie in one bucket.
    """
    dealt = df.repartition(buckets, "run_id")  # one file a bucket
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "run_id").sortBy("run_id", "frame").saveAsTable(table)
    return df.sparkSession.table(table)


def write_csv(df: DataFrame, path: str) -> None:
    """Flat columns; arrays are joined by `;`."""
    flat = [F.concat_ws(";", c).alias(c) if kind == "array<string>" else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def strided(frames: DataFrame, stride: int) -> DataFrame:
    """Every stride-th frame; filter before any kernel, which Spark can't move below it."""
    return frames.where(F.col("frame") % max(int(stride), 1) == 0)


def frame_counts(frames: DataFrame, stride: int) -> DataFrame:
    step = max(int(stride), 1)
    return frames.groupBy("run_id").agg(F.count(F.lit(1)).alias("original_frame_count"), F.count(F.when(F.col("frame") % step == 0, 1)).alias("analyzed_frame_count"))


def frames_at(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """The frames that (run_id, frame) rows ask for; those that aren't there are left out."""
    return frames.join(wanted.select("run_id", "frame").distinct(), ["run_id", "frame"])


def summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Summaries in JSON with the path of each; a damaged file is a row of NULLs."""
    rows = spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")
    return rows.withColumn("path", F.input_file_name())


def benchmark_outputs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All `<benchmark>/analysis_metrics.json` below a folder, in order of path."""
    rows = summaries(spark, f"{root}/*/analysis_metrics.json", schema)
    return rows.withColumn("output_dir_name", F.regexp_extract("path", r"([^/]+)/analysis_metrics\.json$", 1)).orderBy("path")


def write_suite(df: DataFrame, folder: str) -> None:
    """A suite's rows as JSON, NULL fields included, and as CSV."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/benchmark_summary.json")
    write_csv(df, f"{folder}/benchmark_summary.csv")


def suite(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A suite's rows as write_suite has left them."""
    return spark.read.schema(schema).json(f"{folder}/benchmark_summary.json")


def to_json_rows(df: DataFrame, key: str) -> DataFrame:
    """Each row as one JSON text beside its key; NULL fields are left out."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("json"))


def rounded_metrics(df: DataFrame, key: str) -> DataFrame:
    """Numbers as texts of six decimals."""
    return df.select(key, *(F.format_string("%.6f", c).alias(c) for c, kind in df.dtypes if kind == "double" and c != key))


class Conflict(Exception):
    """Another writer has made this version of a table."""


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """A small file that readers see whole or not at all: written beside its place and renamed. Without `replace` a file that is there is an error."""
    jvm, to, files = _files(spark, path)
    fs = jvm.org.apache.hadoop.fs
    beside = fs.Path(to.getParent(), f".{to.getName()}.{uuid.uuid4().hex}")
    flags = jvm.java.util.EnumSet.of(fs.CreateFlag.CREATE)
    parents = spark.sparkContext._gateway.new_array(getattr(fs, "Options$CreateOpts"), 1)
    parents[0] = getattr(fs, "Options$CreateOpts").createParent()
    out = files.create(beside, flags, parents)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(getattr(fs, "Options$Rename"), "OVERWRITE" if replace else "NONE")
    try:
        files.rename(beside, to, how)
    except Exception as error:
        files.delete(beside, False)
        if not replace and "FileAlreadyExists" in str(error):
            raise Conflict(path) from error
        raise


def _version(spark: SparkSession, path: str) -> int:
    """The newest version of a table, 0 if there is none."""
    jvm, at, files = _files(spark, f"{path}/_versions")
    if not files.util().exists(at):
        return 0
    return max((int(x.getPath().getName()) for x in files.util().listStatus(at) if x.getPath().getName().isdigit()), default=0)


def write_table(spark: SparkSession, rows: DataFrame, path: str, after: int) -> int:
    """A snapshot in a folder of its own, then the version behind `after`, which points to it; Conflict if another writer was first.

    That holds where the file system renames a file in one step only if none has the name, as HDFS does.

    `rows` may come from the table itself. Old snapshots, and those of writers that were late, stay
    until somebody deletes them.
    """
    name = f"snapshot={uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    put_text(spark, f"{path}/_versions/{after + 1:012d}", name, replace=False)
    return after + 1


def update_table(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 20) -> int:
    """What `change` makes of the newest rows, None where there is no table yet; made anew from newer rows if another writer was first."""
    for _ in range(tries):
        version = _version(spark, path)
        try:
            return write_table(spark, change(registry_table(spark, path, version=version) if version else None), path, version)
        except Conflict:
            continue
    raise Conflict(f"{path}: {tries} times another writer was first")


def registry_table(spark: SparkSession, path: str, columns: dict[str, Column] | None = None, version: int | None = None) -> DataFrame:
    """A version of a registry table, the newest if none is named; those of `columns` that it lacks have the value given there."""
    version = version or _version(spark, path)
    if not version:
        raise ValueError(f"no registry table at {path}")
    snapshot = spark.read.text(f"{path}/_versions/{version:012d}").first()["value"]
    rows = spark.read.parquet(f"{path}/{snapshot}")
    return rows.withColumns({c: x for c, x in (columns or {}).items() if c not in rows.columns})
