"""Exact running totals over any number of distinct scores.

A window over the whole table would put every row into one task.  Here the rows
are cut into RANGES ranges at their own approximate quantiles, wherever the scores
lie.  Rows are totalled inside their range, and the totals of the ranges before it
are handed down by an equi-join.  The cuts only balance the ranges; the totals are
exact whatever the cuts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenloom.session import stored

RANGES = 1024
#: A quantile is off by at most one part in this many of the rows.
ACCURACY = 10_000


def ranged(hist: DataFrame, order_col: str) -> DataFrame:
    """Add ``_range``: ranges of about equally many rows that follow the order of ``order_col``."""
    value = F.col(order_col).cast("double") + 0.0  # one zero, not two
    shares = [i / RANGES for i in range(1, RANGES)]
    found = hist.agg(F.percentile_approx(value, shares, ACCURACY).alias("cuts")).first()["cuts"]
    cuts = sorted({c for c in found or [] if math.isfinite(c)} or {0.0})
    splits = [-math.inf, *cuts, math.inf]
    buckets = Bucketizer(splits=splits, inputCol="_value", outputCol="_range", handleInvalid="keep")
    return buckets.transform(hist.withColumn("_value", value)).withColumn("_range", F.col("_range").cast("int"))


def running_totals(
    hist: DataFrame,
    order_col: str,
    values: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    with_total: bool = False,
) -> DataFrame:
    """Add ``cum_<v>`` (inclusive) for every value column; ``total_<v>`` if asked.

    ``hist`` holds one row per (by, order value); it is stored, as its cuts are
    found before its totals.  NaN comes after all numbers; rows without an order
    value are left out.
    """
    by = list(by)
    order = F.desc if descending else F.asc
    cut = ranged(stored(hist, "hist"), order_col)
    upto = (Window.unboundedPreceding, Window.currentRow)
    series = Window.partitionBy(*(by or [F.lit(0)]))
    before = series.orderBy(order("_range")).rowsBetween(*upto)
    # At most RANGES + 1 rows to a series.
    sums = cut.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    offsets = sums.select(
        *by,
        "_range",
        *[(F.sum(f"_s_{v}").over(before) - F.col(f"_s_{v}")).alias(f"_before_{v}") for v in values],
        *([F.sum(f"_s_{v}").over(series).alias(f"total_{v}") for v in values] if with_total else []),
    )
    inside = Window.partitionBy(*by, "_range").orderBy(order("_value")).rowsBetween(*upto)
    local = cut.withColumns({f"_inside_{v}": F.sum(v).over(inside) for v in values})
    return local.join(offsets, [*by, "_range"]).select(
        *hist.columns,
        *[(F.col(f"_before_{v}") + F.col(f"_inside_{v}")).alias(f"cum_{v}") for v in values],
        *([f"total_{v}" for v in values] if with_total else []),
    )


def exact_quantile(df: DataFrame, col: str, q: float) -> float:
    """Linearly interpolated quantile of a column, exact at any size.

    The two neighbouring order statistics come back to the driver, nothing else.
    """
    hist = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    ranked = running_totals(hist, col, ["n"], with_total=True)
    place = F.lit(q) * (F.col("total_n") - 1)
    low, high = F.floor(place), F.ceil(place)
    row = ranked.agg(
        F.min(F.when(F.col("cum_n") > low, F.col(col))).alias("a"),
        F.min(F.when(F.col("cum_n") > high, F.col(col))).alias("b"),
        F.min(place - low).alias("share"),
    ).first()
    if row["a"] is None:
        raise ValueError(f"no values in column '{col}'")
    return row["a"] + (row["b"] - row["a"]) * row["share"]
