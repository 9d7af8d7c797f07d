"""Session set-up and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows one task may take for a single group before the ordered operators
# split the group into slices. Overridden by the session setting below.
ROWS_PER_TASK = 5_000_000
ROWS_PER_TASK_SETTING = "spark.tracewell.rowsPerTask"


def build_session(app: str = "tracewell", master: str | None = None, **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Times in the library are UTC; text conversions follow the session zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_TASK_SETTING, str(ROWS_PER_TASK)))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        if context.getCheckpointDir() is not None:
            return context.getCheckpointDir()
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tracewell-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tracewell/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, keeps iterative plans short."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_and_read(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage of a table of plain columns by writing it once; a checkpoint works it out a second time."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
