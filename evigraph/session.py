"""A Spark session with the settings the engine is written for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "evigraph", **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; anything else as the caller says."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, ``spark.checkpoint.dir``.

    Where it is unset a temporary one is taken, but only if all tasks run on this machine:
    elsewhere each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="evigraph-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session ends."""
    path = f"{shared_folder(spark)}/evigraph/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def materialise(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write to the folder that all machines share, and go on from the files.

    Iterative operators call this each round: the plan stays small, and a lost executor
    costs a re-read only. The files go when the session ends.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
