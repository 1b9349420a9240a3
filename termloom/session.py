"""Session helpers: configuration, shared scratch folder, written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_WRITTEN: list[str] = []


def build_session(
    app: str = "termloom", cpus: int | str = "*", scratch: str | None = None, **conf: str
) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster use the session you are given.

    ``scratch`` is the folder of written tables, by default what ``TERMLOOM_SCRATCH`` names.
    """
    scratch = scratch or os.environ.get("TERMLOOM_SCRATCH")
    if scratch:
        conf.setdefault("spark.checkpoint.dir", scratch)
    partitions = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``).

    Only a local session without that setting falls back to a temporary folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="termloom-"))
        base = context.getCheckpointDir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the tables that this process has written as intermediate results; for a run's end.

    Frames that still read one of them cannot be used afterwards. Returns how many there were.
    """
    paths, gone = [p for p in _WRITTEN], 0
    _WRITTEN.clear()
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        gone += bool(system.delete(hadoop, True))
    return gone


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner true sizes.
    """
    return materialize_counted(df, name)[0]


def materialize_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """As ``materialize``; the row count is taken while writing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]
