"""Published versions of a folder: readers see one whole version or the one before, never a half.

A version is a small JSON record that names the tables it is made of.  Tables are written first, under
names of their own; creating the record's file is the switch, and fails if another writer took the number.
A record that is empty or cut off (its writer died) does not count; the version before it stays.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from screenloom.session import file_at

FOLDER = "_versions"


class VersionTaken(RuntimeError):
    """Another writer published first; read the latest version and start again."""


def _records(spark: SparkSession, path: str) -> list[tuple[int, Any]]:
    files, at = file_at(spark, f"{path}/{FOLDER}")
    if not files.exists(at):
        return []
    found = [(f.getPath().getName(), f.getPath()) for f in files.listStatus(at)]
    return sorted((int(name), where) for name, where in found if name.isdigit())


def latest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """The highest number taken (0: none) and the record of the last whole version (None: none)."""
    taken = _records(spark, path)
    top = taken[-1][0] if taken else 0
    context = spark.sparkContext
    for _, where in reversed(taken):
        stream = where.getFileSystem(context._jsc.hadoopConfiguration()).open(where)
        try:
            text = context._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return top, json.loads(text)
        except json.JSONDecodeError:
            continue
    return top, None


def publish(spark: SparkSession, path: str, number: int, record: dict) -> None:
    """Make ``record`` version ``number`` of the folder."""
    files, at = file_at(spark, f"{path}/{FOLDER}/{number:010d}")
    try:
        out = files.create(at, False)
    except Exception as error:  # the file system's own kind of "exists already"
        if files.exists(at):
            raise VersionTaken(f"version {number} of {path} is taken") from error
        raise
    try:
        out.write(bytearray(json.dumps(record), "utf-8"))
    finally:
        out.close()
