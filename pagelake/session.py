"""Spark session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What every job of this package relies on. Partition counts and memory belong to the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app_name: str = "pagelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def local_session(cpus: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    cpus = cpus or os.cpu_count() or 4
    spark = get_session(
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(cpus),
        spark__driver__memory=memory,
        spark__ui__enabled="false",
        **conf,
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster (``spark.checkpoint.dir``).

    Only a local master may fall back to a temporary folder: on a cluster a folder of
    one machine is lost with that machine, so an unset folder is an error there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="pagelake-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


# Shuffle files of a finished write are of no more use; Spark else keeps them until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str = "part") -> DataFrame:
    """Write a table once to the shared checkpoint folder and read it back.

    For results that several branches of one plan read: they are computed once, survive executor
    loss, keep columns prunable, and give the optimiser a measured size. ``clear_scratch`` removes
    what a session has written. The shuffle files of the write go with its end.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/pagelake-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove the tables this session wrote with ``materialise``."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pagelake-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
