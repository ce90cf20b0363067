"""One-pass summaries: class balance, dataset, sources, splits, weights, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom import constants as K


def _count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def class_balance(df: DataFrame, label: str = K.LABEL) -> DataFrame:
    counts = df.agg(
        F.count("*").alias("total"),
        _count_where(F.col(label) == 1).alias("toxic"),
        _count_where(F.col(label) == 0).alias("nontoxic"),
    )
    high, low = F.greatest("toxic", "nontoxic"), F.least("toxic", "nontoxic")
    ratio = F.when(low > 0, high / low).otherwise(F.lit(float("inf")))
    return counts.select(
        "total",
        "toxic",
        "nontoxic",
        F.coalesce(F.try_divide("toxic", "total"), F.lit(0.0)).alias("toxic_ratio"),
        ratio.alias("imbalance_ratio"),
        (ratio > K.IMBALANCE_WARNING).alias("imbalanced"),
    )


def dataset_summary(df: DataFrame, key: str = K.KEY, label: str = K.LABEL) -> DataFrame:
    """Counts and shares of the raw table; a null label counts in the denominator."""
    counts = df.agg(
        F.count("*").alias("total_compounds"),
        _count_where(F.col(label) == 1).alias("toxic_count"),
        _count_where(F.col(label) == 0).alias("nontoxic_count"),
        _count_where(F.col(key).isNull()).alias("missing_smiles"),
        _count_where(F.col(label).isNull()).alias("missing_labels"),
    )
    return counts.withColumn("toxic_ratio", F.try_divide("toxic_count", "total_compounds"))


def validity_summary(tagged: DataFrame) -> DataFrame:
    """Valid and invalid rows of a tagged table, and the invalid share."""
    counts = tagged.agg(
        F.count("*").alias("n_rows"),
        _count_where(F.col("_valid")).alias("n_valid"),
        _count_where(~F.col("_valid")).alias("n_invalid"),
    )
    return counts.withColumn("invalid_share", F.try_divide("n_invalid", "n_rows"))


def source_counts(df: DataFrame, source: str = K.SOURCE) -> DataFrame:
    return (
        df.filter(F.col(source).isNotNull())
        .groupBy(source)
        .agg(F.count("*").alias("n_rows"))
        .orderBy(F.desc("n_rows"), source)
    )


def split_stats(df: DataFrame, split: str = "split", label: str = K.LABEL) -> DataFrame:
    return (
        df.groupBy(split)
        .agg(
            F.count("*").alias("size"),
            _count_where(F.col(label) == 1).alias("toxic"),
            _count_where(F.col(label) == 0).alias("nontoxic"),
        )
        .withColumn("toxic_ratio", F.try_divide("toxic", "size"))
    )


def class_weights(df: DataFrame, label: str = K.LABEL) -> DataFrame:
    """Positive-class weight (1.0 without positives) and the two balanced weights."""
    counts = df.agg(
        _count_where(F.col(label) == 1).alias("n_pos"),
        _count_where(F.col(label) == 0).alias("n_neg"),
    )
    n = F.col("n_pos") + F.col("n_neg")
    return counts.select(
        "n_pos",
        "n_neg",
        F.coalesce(F.try_divide("n_neg", "n_pos"), F.lit(1.0)).alias("scale_pos_weight"),
        F.try_divide(n, 2 * F.col("n_pos")).alias("balanced_pos"),
        F.try_divide(n, 2 * F.col("n_neg")).alias("balanced_neg"),
    )


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of each fold metric, a row per model.

    A model with a failed fold keeps its row: mean AUC 0.0, the other numbers
    null, and the message in ``error``.
    """
    out = []
    for metric in ("roc_auc", "accuracy", "f1", "precision", "recall"):
        out.append(F.avg(metric).alias(f"cv_{metric}_mean"))
        out.append(F.stddev_pop(metric).alias(f"cv_{metric}_std"))
    out.append(F.avg("train_roc_auc").alias("train_roc_auc_mean"))
    if "error" not in folds.columns:
        folds = folds.withColumn("error", F.lit(None).cast("string"))
    table = folds.groupBy("model").agg(*out, F.min("error").alias("error"))
    failed = F.col("error").isNotNull()
    cells = []
    for name in table.columns:
        if name == "cv_roc_auc_mean":
            cells.append(F.when(failed, 0.0).otherwise(F.col(name)).alias(name))
        elif name in ("model", "error"):
            cells.append(F.col(name))
        else:
            cells.append(F.when(~failed, F.col(name)).alias(name))
    return table.select(*cells)


def comparison_long(comparison: DataFrame) -> DataFrame:
    """Wide comparison table to (model, metric, value) for the metrics present."""
    present = [m for m in K.COMPARISON_METRICS if m in comparison.columns]
    if not present:
        raise ValueError("none of the comparison metrics is present")
    title = F.regexp_replace(F.regexp_replace("metric", "cv_", ""), "_mean", "")
    return comparison.unpivot(["model"], present, "metric", "value").select(
        "model", F.initcap(F.replace(title, F.lit("_"), F.lit(" "))).alias("metric"), "value"
    )


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total"),
        _count_where(F.col("is_valid")).alias("valid"),
        _count_where(F.col("prediction") == K.TOXIC).alias("toxic"),
        _count_where(F.col("prediction") == K.NON_TOXIC).alias("nontoxic"),
        _count_where(F.col("ad_status") == K.OUT_OF_DOMAIN).alias("out_of_domain"),
    )
