"""Exact stratified splits, folds and samples without shuffling the table.

Rows are ordered inside their class by a seeded hash of a unique id.  A part is
the set of rows between two cut positions of that order, so all a row needs to
know is the hash at each cut.  The cuts come from

1. a map-side combined histogram of (class, hash prefix),
2. running totals over the histogram (its size is fixed by the prefix length),
3. the exact rank inside the few prefixes a cut falls into.

What comes back to the driver is one hash per class and cut.  Placing a row is
then a plain column expression: the table is never shuffled, and reading the
result again costs no more than reading the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenloom import constants as K
from screenloom.functions.keys import seeded_hash

# 16**4 prefixes: the histogram has at most 65,536 narrow rows per class, and one
# prefix of a class of 10**11 rows holds about 1.5 million hashes to order.
PREFIX_DIGITS = 4


def apportion(part_size: Column, count: str, label: str) -> Column:
    """Largest-remainder share of ``part_size`` for each class (ties: lower label).

    Window functions over the class table, which has a row per class.
    """
    everything = Window.partitionBy(F.lit(0))
    exact = part_size * F.col(count) / F.sum(count).over(everything)
    base = F.floor(exact)
    missing = part_size - F.sum(base).over(everything)
    order = everything.orderBy(F.desc(exact - base), F.asc(label))
    return (base + F.when(F.row_number().over(order) <= missing, 1).otherwise(0)).cast("bigint")


def _cut_positions(hist: DataFrame, cuts: DataFrame, label: str) -> DataFrame:
    """Prefix and position inside it for every cut rank > 0."""
    running = Window.partitionBy(label).orderBy("_prefix")
    totals = hist.withColumn("_upto", F.sum("_n").over(running))
    return (
        totals.join(F.broadcast(cuts), label)
        .filter((F.col("_upto") - F.col("_n") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto")))
        .select(
            label, "_part", "_prefix", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_place")
        )
    )


def assign_by_cuts(
    df: DataFrame,
    cuts: DataFrame,
    hist: DataFrame,
    id_col: str,
    label: str,
    out: str,
    seed: int,
    prefix_digits: int,
    last_part: str | int,
) -> DataFrame:
    """Name the part of each row.

    ``cuts``: (label, _part, _rank) with the last rank of each part.  A row
    beyond every cut gets ``last_part``.
    """
    hash_of = seeded_hash(seed, F.col(id_col))
    at = F.broadcast(_cut_positions(hist, cuts.select(label, "_part", "_rank"), label))
    hashed = df.select(label, hash_of.alias("_hash"))
    ranked = (
        hashed.withColumn("_prefix", F.substring("_hash", 1, prefix_digits))
        .join(F.broadcast(at.select(label, "_prefix").distinct()), [label, "_prefix"])
        .withColumn(
            "_seen", F.row_number().over(Window.partitionBy(label, "_prefix").orderBy("_hash"))
        )
    )
    # One row per class and non-empty part: its last hash.
    found = (
        ranked.join(at, [label, "_prefix"])
        .filter(F.col("_seen") == F.col("_place"))
        .select(label, "_part", "_hash")
        .collect()
    )
    part = F.lit(last_part)
    # From the last cut to the first, so that the first one a row is under wins.
    for row in sorted(found, key=lambda r: (str(r[label]), r["_hash"]), reverse=True):
        inside = (F.col(label) == row[label]) & (hash_of <= row["_hash"])
        part = F.when(inside, F.lit(row["_part"])).otherwise(part)
    return df.withColumn(out, part)


def class_histogram(
    df: DataFrame, id_col: str, label: str, seed: int, prefix_digits: int
) -> DataFrame:
    prefix = F.substring(seeded_hash(seed, F.col(id_col)), 1, prefix_digits)
    return df.groupBy(label, prefix.alias("_prefix")).agg(F.count("*").alias("_n"))


def _check_ratios(train: float, val: float, test: float) -> None:
    total = train + val + test
    if abs(total - 1.0) > K.RATIO_TOLERANCE:
        raise ValueError(f"split ratios must sum to 1.0, got {total:.3f}")


def split_quotas(
    counts: DataFrame, label: str, train: float, val: float, test: float
) -> DataFrame:
    """Rows of each class that go to test and to val, from the class counts."""
    everything = Window.partitionBy(F.lit(0))
    n = F.sum("_count").over(everything)
    first = counts.withColumn("_n_test", F.ceil(F.lit(test) * n)).withColumn(
        "_test", apportion(F.col("_n_test"), "_count", label)
    )
    rest = first.withColumn("_rest", F.col("_count") - F.col("_test"))
    n_rest = F.sum("_rest").over(everything)
    val_share = val / (train + val)
    return rest.withColumn("_n_val", F.ceil(F.lit(val_share) * n_rest)).withColumn(
        "_val", apportion(F.col("_n_val"), "_rest", label)
    )


def stratified_split(
    df: DataFrame,
    id_col: str = K.KEY,
    label: str = K.LABEL,
    ratios: tuple[float, float, float] = (K.TRAIN_RATIO, K.VAL_RATIO, K.TEST_RATIO),
    seed: int = K.SEED,
    min_rows: int | None = None,
    prefix_digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Add ``split`` in {train, val, test} with exact per-class quotas.

    Sizes are ceil(test * n) and ceil(val / (train + val) * rest).  ``id_col``
    must be unique (it is, after duplicates are resolved).  ``df`` is scanned
    to find the cuts and again by whoever reads the result, so hand in a stored
    table, not a long plan.
    """
    _check_ratios(*ratios)
    if min_rows is not None:
        found = df.limit(min_rows).count()
        if found < min_rows:
            raise ValueError(f"{found} rows are too few to split, at least {min_rows} are needed")
    hist = class_histogram(df, id_col, label, seed, prefix_digits)
    counts = hist.groupBy(label).agg(F.sum("_n").alias("_count"))
    quotas = split_quotas(counts, label, *ratios)
    cuts = quotas.select(
        label,
        F.inline(
            F.array(
                F.struct(F.lit("test").alias("_part"), F.col("_test").alias("_rank")),
                F.struct(
                    F.lit("val").alias("_part"), (F.col("_test") + F.col("_val")).alias("_rank")
                ),
            )
        ),
        "_test",
    ).filter((F.col("_rank") > 0) & ~((F.col("_part") == "val") & (F.col("_rank") == F.col("_test"))))
    return assign_by_cuts(df, cuts, hist, id_col, label, "split", seed, prefix_digits, "train")


def stratified_folds(
    df: DataFrame,
    folds: int = K.CV_FOLDS,
    id_col: str = K.KEY,
    label: str = K.LABEL,
    seed: int = K.SEED,
    prefix_digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Add ``fold`` in 0..folds-1; per class the fold sizes differ by one at most."""
    hist = class_histogram(df, id_col, label, seed, prefix_digits)
    counts = hist.groupBy(label).agg(F.sum("_n").alias("_count"))
    small = F.floor(F.col("_count") / folds)
    extra = F.col("_count") % folds
    cuts = (
        counts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(folds - 2))))
        .withColumn("_size", small + F.when(F.col("_part") < extra, 1).otherwise(0))
        .withColumn(
            "_rank", small * (F.col("_part") + 1) + F.least(F.col("_part") + 1, extra)
        )
        .filter("_size > 0")
    )
    return assign_by_cuts(df, cuts, hist, id_col, label, "fold", seed, prefix_digits, folds - 1)


def sample_rows(
    df: DataFrame, n: int = K.SAMPLE_ROWS, id_col: str = K.ROW_ID, seed: int = K.SEED
) -> DataFrame:
    """Seeded sample of ``n`` rows without replacement (per-task top-n, then merge)."""
    return df.orderBy(seeded_hash(seed, F.col(id_col)), id_col).limit(n)


def split_overlap(df: DataFrame, key: str = K.KEY, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split; empty for a sound split."""
    return (
        df.groupBy(F.md5(F.col(key).cast("string")).alias("key_digest"))
        .agg(F.min(split).alias("_low"), F.max(split).alias("_high"))
        .filter("_low < _high")
        .select("key_digest")
    )
