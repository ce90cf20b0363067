"""Duplicate keys: detection, label conflicts and the conservative majority vote.

All grouping runs on the 128-bit digest of the key, so the shuffles carry narrow
fixed-width rows however long the keys are, and every aggregate is combined on
the map side: a key holding a third of the rows still reaches its reducer as at
most one row per (map task, source).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom import constants as K
from screenloom.functions.keys import key_digest


def duplicate_keys(df: DataFrame, key: str = K.KEY, hashed: bool = False) -> DataFrame:
    """Keys (as digests) that occur more than once, with their counts."""
    if not hashed:
        df = df.filter(F.col(key).isNotNull())
    digest = F.col(key) if hashed else key_digest(F.col(key))
    return (
        df.groupBy(digest.alias("key_digest"))
        .agg(F.count("*").alias("n_rows"))
        .filter("n_rows > 1")
    )


def label_conflicts(df: DataFrame, key: str = K.KEY, label: str = K.LABEL) -> DataFrame:
    """Keys seen with more than one label.  min < max needs no distinct shuffle."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key_digest(F.col(key)).alias("key_digest"))
        .agg(
            F.count("*").alias("n_rows"),
            F.min(label).alias("min_label"),
            F.max(label).alias("max_label"),
        )
        .filter("min_label < max_label")
    )


def partial_votes(
    df: DataFrame,
    key: str = K.KEY,
    label: str = K.LABEL,
    source: str = K.SOURCE,
    row_id: str = K.ROW_ID,
    hashed: bool = False,
) -> DataFrame:
    """Sums that add up over any parts of the rows: one row per key digest and source."""
    if not hashed:
        df = df.filter(F.col(key).isNotNull())
    narrow = df.select(
        (F.col(key) if hashed else key_digest(F.col(key))).alias("key_digest"),
        F.col(label).cast("bigint").alias("_label"),
        F.col(source).alias("_source"),
        F.col(row_id).alias("_row"),
    )
    return narrow.groupBy("key_digest", "_source").agg(
        F.sum("_label").alias("_ones"), F.count("*").alias("_n"), F.min("_row").alias("_first")
    )


def finish_votes(per_source: DataFrame) -> DataFrame:
    """The votes of keys from their sums per source."""
    return per_source.groupBy("key_digest").agg(
        (2 * F.sum("_ones") >= F.sum("_n")).cast("int").alias("_vote"),
        F.array_join(F.array_sort(F.collect_set("_source")), "+").alias("_sources"),
        F.sum("_n").alias("n_merged"),
        F.min("_first").alias("_first"),
    )


def vote(
    df: DataFrame,
    key: str = K.KEY,
    label: str = K.LABEL,
    source: str = K.SOURCE,
    row_id: str = K.ROW_ID,
    hashed: bool = False,
) -> DataFrame:
    """One row per key digest: voted label (a tie gives 1), merged sources, first row id.

    ``hashed``: the key column already holds non-null digests.
    """
    return finish_votes(partial_votes(df, key, label, source, row_id, hashed))


def keep_voted(
    df: DataFrame,
    votes: DataFrame,
    label: str = K.LABEL,
    source: str = K.SOURCE,
    row_id: str = K.ROW_ID,
) -> DataFrame:
    """The first row of each key with the voted label and merged sources.

    ``row_id`` must be unique.  ``df`` may be any table of the rows: it needs
    neither key, label nor source.  Wide columns are not aggregated: the vote
    names the surviving rows and one equi-join on the row id keeps them, so wide
    values cross the network once at most.
    """
    voted = {label: F.col("_vote").alias(label), source: F.col("_sources").alias(source)}
    rest = [c for c in df.columns if c not in voted and c != "key_digest"]
    kept = df.select(*rest).join(votes, F.col(row_id) == F.col("_first"))
    shown = [c for c in df.columns if c in rest or c in voted]
    added = [c for c in (label, source) if c not in shown]
    digest = ["key_digest"] if "key_digest" in votes.columns else []
    return kept.select(*digest, *[voted.get(c, F.col(c)) for c in shown + added], "n_merged")


def resolve_labels(
    df: DataFrame,
    key: str = K.KEY,
    label: str = K.LABEL,
    source: str = K.SOURCE,
    row_id: str = K.ROW_ID,
) -> DataFrame:
    """One row per key: its first row with voted label and merged sources.

    Rows whose key is null vanish.
    """
    votes = vote(df, key, label, source, row_id).drop("key_digest")
    return keep_voted(df, votes, label, source, row_id)
