"""Derived tables kept up to date file by file.

Next to the derived rows lies a manifest: every input file with its size, its time of change and the
refresh (generation) that read it.  A refresh lists the inputs without opening them, reads only files that
are new or changed, writes their rows as a generation of its own and publishes a new manifest.  Rows of
files that changed or vanished are left out by a join on the manifest; nothing is rewritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.sources import versions

#: Changed files up to which they are named in the scan's file filter; beyond, a join picks their rows.
NAMED_FILES = 1000


def list_inputs(spark: SparkSession, source: str, pattern: str = "*.parquet") -> DataFrame:
    """(file, size, modified) of every input file; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(source)
    meta = F.col("_metadata")
    return files.select(
        meta["file_path"].alias("file"),
        meta["file_size"].alias("size"),
        meta["file_modification_time"].alias("modified"),
    )


def refresh_parts(
    spark: SparkSession, path: str, source: str, build: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The derived table of all Parquet files under ``source``, kept at ``path``.

    ``build`` works row by row and keeps the column ``_file``.  A file counts as changed when its size or
    time of change differs.  Without any change nothing is written.  An empty source gives an empty table
    once a first refresh has seen files; before that it is an error, as there is no schema.
    """
    number, record = versions.latest(spark, path)
    generation = number + 1
    now = list_inputs(spark, source)
    if record is None:
        fresh, kept = now, None
    else:
        old = spark.read.parquet(f"{path}/{record['manifest']}")
        same = ["file", "size", "modified"]
        fresh = now.join(old, same, "left_anti")
        kept = old.join(now, same, "left_semi")
    found = [r.file for r in fresh.select("file").limit(NAMED_FILES + 1).collect()]
    if record is not None and not found and kept.count() == old.count():
        return read_parts(spark, path)
    made = fresh.withColumn("generation", F.lit(generation))
    manifest = f"manifest-{uuid.uuid4().hex}"
    (made if kept is None else kept.unionByName(made)).write.parquet(f"{path}/{manifest}")
    folders = dict(record["rows"]) if record else {}
    if found or record is None:
        rows = spark.read.parquet(source).withColumn("_file", F.col("_metadata.file_path"))
        if record is not None and len(found) <= NAMED_FILES:
            rows = rows.filter(F.col("_metadata.file_path").isin(found))
        elif record is not None:
            rows = rows.join(fresh.select(F.col("file").alias("_file")), "_file", "left_semi")
        folders[str(generation)] = f"rows-{uuid.uuid4().hex}"
        out = build(rows).withColumn("_generation", F.lit(generation))
        out.write.parquet(f"{path}/{folders[str(generation)]}")
    alive = spark.read.parquet(f"{path}/{manifest}").select("generation").distinct().collect()
    live = {str(r.generation) for r in alive} or set(folders)
    record = {"manifest": manifest, "rows": {g: f for g, f in folders.items() if g in live}}
    versions.publish(spark, path, generation, record)
    return read_parts(spark, path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The derived rows of the last published version, with ``_file`` and ``_generation``."""
    _, record = versions.latest(spark, path)
    if record is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    rows = spark.read.parquet(*(f"{path}/{folder}" for folder in record["rows"].values()))
    live = spark.read.parquet(f"{path}/{record['manifest']}").select(
        F.col("file").alias("_file"), F.col("generation").alias("_generation")
    )
    return rows.join(live, ["_file", "_generation"], "left_semi")
