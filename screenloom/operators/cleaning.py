"""Validity tagging, row filters and the whole cleaning chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom import constants as K
from screenloom.functions.keys import TEXT, KeyRule, key_digest
from screenloom.operators.voting import keep_voted, vote


class TooFewRows(ValueError):
    """A gate found fewer rows than the job needs."""


def tag_valid(df: DataFrame, key: str = K.KEY, rule: KeyRule = TEXT) -> DataFrame:
    """Replace the key by its canonical form (null if invalid) and add ``_valid``."""
    ok = rule.is_valid(F.col(key))
    return df.select(
        *[
            F.when(ok, rule.canonical(F.col(c))).alias(c) if c == key else F.col(c)
            for c in df.columns
        ],
        ok.alias("_valid"),
    )


def drop_invalid(df: DataFrame, key: str = K.KEY) -> DataFrame:
    if "_valid" in df.columns:
        return df.filter("_valid").drop("_valid")
    return df.dropna(subset=[key])


def drop_unlabelled(df: DataFrame, label: str = K.LABEL) -> DataFrame:
    return df.filter(F.col(label).isNotNull() & ~F.isnan(F.col(label).try_cast("double")))


def binary_labels(df: DataFrame, label: str = K.LABEL, strict: bool = False) -> DataFrame:
    """Keep 0/1 labels as INT.

    By default the label is truncated first, so 0.7 counts as 0 and 1.9 as 1;
    ``strict`` tests the value as it came.
    """
    raw = F.col(label).try_cast("double")
    if strict:
        df = df.filter(raw.isin(0.0, 1.0))
    return df.withColumn(label, raw.try_cast("int")).filter(F.col(label).isin(0, 1))


def require_rows(df: DataFrame, least: int, what: str = "dataset") -> DataFrame:
    """Raise unless ``df`` has at least ``least`` rows; reads no more than that."""
    found = df.limit(least).count()
    if found < least:
        raise TooFewRows(f"{what} has only {found} rows, at least {least} are needed")
    return df


def valid_rows(
    df: DataFrame,
    key: str = K.KEY,
    label: str = K.LABEL,
    rule: KeyRule = TEXT,
    strict: bool = False,
) -> DataFrame:
    """Rows with a valid key, still as it came, and a 0/1 label."""
    return binary_labels(drop_unlabelled(df.filter(rule.is_valid(F.col(key))), label), label, strict)


def clean(
    df: DataFrame,
    key: str = K.KEY,
    label: str = K.LABEL,
    source: str = K.SOURCE,
    row_id: str = K.ROW_ID,
    rule: KeyRule = TEXT,
    strict: bool = False,
    min_rows: int | None = None,
) -> DataFrame:
    """Validate, filter and resolve duplicates; one lazy plan unless ``min_rows`` is set.

    The canonical key is computed once for the vote, where only its digest goes
    on, and once more for the rows that survive.
    """
    digests = valid_rows(df, key, label, rule, strict).select(
        key_digest(rule.canonical(F.col(key))).alias("key_digest"), label, source, row_id
    )
    votes = vote(digests, "key_digest", label, source, row_id, hashed=True)
    # Rows that had no vote need not travel to the join.
    voted = drop_unlabelled(df.filter(rule.is_valid(F.col(key))), label)
    out = keep_voted(voted, votes.drop("key_digest"), label, source, row_id)
    out = out.withColumn(key, rule.canonical(F.col(key)))
    return out if min_rows is None else require_rows(out, min_rows, "cleaned dataset")
