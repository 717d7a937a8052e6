"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streaming session windows merge inside each map task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "flowlens", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the package relies on.

    ``master`` and the number of shuffle partitions are left to the cluster; for a ``local[n]`` master
    the partitions follow the cores and the UI is off.
    """
    builder = SparkSession.builder.appName(app)
    settings = dict(SETTINGS)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            cores = master[len("local["):-1] if "[" in master else "1"
            cores = str(os.cpu_count()) if cores == "*" else cores
            settings["spark.sql.shuffle.partitions"] = cores
            settings["spark.ui.enabled"] = "false"
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; every executor must see it.

    Only a local session without that setting gets a temporary folder, because there driver and
    executors are one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="flowlens-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/flowlens-{spark.sparkContext.applicationId}"


_folder: ContextVar[str] = ContextVar("folder", default="")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder; :func:`remove_scratch` removes them all."""
    return f"{scratch_root(spark)}/{_folder.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def passing_scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written meanwhile go when it ends: for the batches of a stream that runs on and on."""
    folder = f"passing-{uuid.uuid4().hex}/"
    token = _folder.set(folder)
    try:
        yield
    finally:
        _folder.reset(token)
        _remove(spark, f"{scratch_root(spark)}/{folder}")


def remove_scratch(spark: SparkSession) -> None:
    """Remove the application's intermediate tables. DataFrames that read them are of no use afterwards.

    For the end of a job, before the session is stopped, and between jobs whose results are stored elsewhere.
    """
    _remove(spark, scratch_root(spark))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts lineage, survives lost executors.

    Runs a job.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
