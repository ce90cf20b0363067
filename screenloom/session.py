"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "screenloom", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        # Small tables, costly rows: let small partitions stay apart on all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Small files, costly rows: several splits to a file.
        .config("spark.sql.files.maxPartitionBytes", "1m")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which every executor can read.

    The cluster names it in ``spark.checkpoint.dir``.  Without that setting the
    warehouse is used, which executors share as well; the session's own
    settings stay as they are.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


#: The folder that tables written now go to, below the shared one; None: the application's own.
_LEASE: ContextVar[str | None] = ContextVar("lease", default=None)
_PREFIX = "lease-"


def file_at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path) of Hadoop, which knows every store that Spark reads."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{_PREFIX}{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new, unused path inside the folder of the present lease, or else of this application.

    The application's folder goes when the driver ends, in whatever way it can still run its exit hooks.
    """
    folder = _LEASE.get()
    if folder is None:
        folder = _application_folder(spark)
        files, at = file_at(spark, folder)
        if not files.exists(at):
            files.mkdirs(at)
            files.deleteOnExit(at)
    return f"{folder}/{kind}-{uuid.uuid4().hex}"


@contextmanager
def lease(spark: SparkSession) -> Iterator[str]:
    """Tables written inside go at the end; what is still wanted must be written elsewhere before.

    Leases may be nested.  The folder lies in the application's own, so it goes with that at the latest.
    """
    folder = scratch_path(spark, "lease")
    token = _LEASE.set(folder)
    try:
        yield folder
    finally:
        _LEASE.reset(token)
        release(spark, folder)


def release(spark: SparkSession, folder: str | None = None) -> None:
    """Delete the tables of a lease, or all of this application's."""
    files, at = file_at(spark, folder or _application_folder(spark))
    files.delete(at, True)


def sweep(spark: SparkSession, hours: float) -> list[str]:
    """Delete what applications left that died without their exit hooks: folders without a change for so long.

    Only folders that leases made are looked at, never this application's.  A folder counts as changed when
    a table is added to it, so ``hours`` must be longer than any job waits between two tables.
    """
    files, at = file_at(spark, shared_folder(spark))
    if not files.exists(at):
        return []
    own, before, gone = _application_folder(spark).rsplit("/", 1)[1], (time.time() - 3600 * hours) * 1000, []
    for entry in files.listStatus(at):
        name = entry.getPath().getName()
        if entry.isDirectory() and name.startswith(_PREFIX) and name != own and entry.getModificationTime() <= before:
            files.delete(entry.getPath(), True)
            gone.append(name)
    return gone


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write a table that several later passes read, and hand back the stored copy.

    Cuts the lineage too: the copy lies in the shared folder, so losing an
    executor loses none of it.
    """
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
