"""Scoring a file stream with the batch transform.

The transform is stateless, so a stream needs no watermark and gives the batch
result row for row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from screenloom.session import scratch_path


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 64
) -> DataFrame:
    """A stream of the Parquet files under ``path``: a folder, or a pattern of files or folders.

    A path that matches nothing is an error, as in a batch.
    """
    spark.read.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def score_stream(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    out: str,
    state: str | None = None,
) -> StreamingQuery:
    """Start a job that scores everything now available into Parquet, then stops.

    The file sink's log and the checkpoint make the output exactly-once across
    restarts: start it again with the same ``out`` and ``state`` to continue.
    """
    state = state or scratch_path(stream.sparkSession, "stream-state")
    return (
        transform(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", state)
        .option("path", out)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def score_batches(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    out: str,
    state: str,
    written: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Like ``score_stream`` for sinks that know no transactions: every micro-batch has a folder of its own.

    A batch that was written but not yet recorded in ``state`` when the job died comes again with the same
    number and the same files, and overwrites its folder: no row is lost or doubled.  ``written`` is called
    after each batch, before it is recorded.  Read the result with ``read_batches``.
    """

    def write(rows: DataFrame, batch: int) -> None:
        transform(rows).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        if written is not None:
            written(batch)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """All scored rows with the number of their batch."""
    return spark.read.parquet(out)
