"""Votes kept between deliveries: a new delivery is folded in without reading old rows.

The state holds, for every key digest and source, how many rows voted, how many for 1, and the first row
id.  These add up, so a delivery is folded by writing its own sums as a further piece; a vote is one
group-by over the pieces.  Pieces are merged into one when there are more than ``most``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom import constants as K
from screenloom.operators.voting import finish_votes, partial_votes
from screenloom.sources import versions

#: Pieces that a state may have before they are merged.
MOST_PIECES = 16


def fold_delivery(
    df: DataFrame,
    path: str,
    delivery: str,
    key: str = K.KEY,
    label: str = K.LABEL,
    source: str = K.SOURCE,
    row_id: str = K.ROW_ID,
    hashed: bool = False,
    most: int = MOST_PIECES,
) -> None:
    """Fold a delivery into the state at ``path``; one already folded under this name is left out.

    A job that dies before its end leaves the state as it was; run it again.
    """
    spark = df.sparkSession
    number, record = versions.latest(spark, path)
    record = record or {"pieces": [], "deliveries": []}
    if delivery in record["deliveries"]:
        return
    piece = f"piece-{uuid.uuid4().hex}"
    partial_votes(df, key, label, source, row_id, hashed).write.parquet(f"{path}/{piece}")
    pieces = [*record["pieces"], piece]
    if len(pieces) > most:
        merged = f"piece-{uuid.uuid4().hex}"
        _summed(_read(spark, path, pieces)).write.parquet(f"{path}/{merged}")
        pieces = [merged]
    done = [*record["deliveries"], delivery]
    versions.publish(
        spark, path, number + 1, {"pieces": pieces, "deliveries": done, "before": record["pieces"], "last": piece}
    )


def _read(spark: SparkSession, path: str, pieces: list[str]) -> DataFrame:
    return spark.read.parquet(*(f"{path}/{p}" for p in pieces))


def _summed(rows: DataFrame) -> DataFrame:
    sums = [F.sum("_ones").alias("_ones"), F.sum("_n").alias("_n"), F.min("_first").alias("_first")]
    return rows.groupBy("key_digest", "_source").agg(*sums)


def _record(spark: SparkSession, path: str) -> dict:
    _, record = versions.latest(spark, path)
    if record is None:
        raise FileNotFoundError(f"no votes are kept at {path}")
    return record


def kept_votes(spark: SparkSession, path: str) -> DataFrame:
    """The votes over all deliveries, as ``voting.vote`` gives them over all rows."""
    return finish_votes(_summed(_read(spark, path, _record(spark, path)["pieces"])))


def changed_votes(spark: SparkSession, path: str) -> DataFrame:
    """The keys of the last delivery with their votes before (null: a new key) and now."""
    record = _record(spark, path)
    touched = _read(spark, path, [record["last"]]).select("key_digest").distinct()
    now = finish_votes(_summed(_read(spark, path, record["pieces"]).join(touched, "key_digest", "left_semi")))
    now = now.select("key_digest", F.col("_vote").alias("label"), F.col("_first").alias("row_id"), "n_merged")
    if not record["before"]:
        return now.withColumn("label_before", F.lit(None).cast("int"))
    old = _read(spark, path, record["before"]).join(touched, "key_digest", "left_semi")
    before = finish_votes(_summed(old)).select("key_digest", F.col("_vote").alias("label_before"))
    return now.join(before, "key_digest", "left")
