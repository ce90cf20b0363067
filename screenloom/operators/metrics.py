"""Ranking, threshold and reliability metrics from a score histogram.

Scores and labels are first reduced to (score, n_pos, n_neg) with a map-side
combined aggregation.  Everything below reads that histogram, so ties are handled
exactly and no metric needs a sort of the raw rows.  ``by`` columns (model, fold,
...) compute many series in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom import constants as K
from screenloom.operators.running import running_totals


def score_histogram(
    df: DataFrame, score: str = "score", label: str = K.LABEL, by: Sequence[str] = ()
) -> DataFrame:
    """Positives and negatives per distinct score.

    Rows without a score (null or NaN) or with a label other than 0 and 1 are left out.
    """
    scored = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    return (
        df.filter(scored & F.col(label).isin(0, 1))
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("n_pos"),
            F.count_if(F.col(label) == 0).alias("n_neg"),
        )
    )


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """The threshold metrics from the four counts (counts as DOUBLE)."""
    pos, neg = tp + fn, fp + tn
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, pos)
    # Mean recall over the classes that occur.
    balanced = (
        F.when((pos > 0) & (neg > 0), (_ratio(tp, pos) + _ratio(tn, neg)) / 2)
        .when(pos > 0, _ratio(tp, pos))
        .when(neg > 0, _ratio(tn, neg))
    )
    spread = F.sqrt(tp + fp) * F.sqrt(pos) * F.sqrt(neg) * F.sqrt(tn + fn)
    return {
        "accuracy": F.try_divide(tp + tn, pos + neg),
        "balanced_accuracy": balanced,
        "precision": precision,
        "recall": recall,
        "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": _ratio(tp * tn - fp * fn, spread),
    }


def _sum_where(condition: Column, value: str) -> Column:
    return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("double")


def metrics_at_threshold(
    hist: DataFrame, threshold: float = K.DEFAULT_THRESHOLD, by: Sequence[str] = ()
) -> DataFrame:
    """Brier score and the confusion metrics at one threshold, in one pass."""
    s = F.col("score")
    n = F.sum(F.col("n_pos") + F.col("n_neg"))
    loss = F.sum(F.col("n_pos") * (s - 1) * (s - 1) + F.col("n_neg") * s * s)
    counts = hist.groupBy(*by).agg(
        _sum_where(s >= threshold, "n_pos").alias("tp"),
        _sum_where(s >= threshold, "n_neg").alias("fp"),
        _sum_where(s < threshold, "n_pos").alias("fn"),
        _sum_where(s < threshold, "n_neg").alias("tn"),
        F.try_divide(loss, n).alias("brier_score"),
        n.alias("n_samples"),
        F.sum("n_pos").alias("n_positive"),
        F.sum("n_neg").alias("n_negative"),
    )
    metrics = confusion_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return counts.select(
        *by,
        "brier_score",
        *[c.alias(name) for name, c in metrics.items()],
        F.lit(float(threshold)).alias("threshold"),
        "n_samples",
        "n_positive",
        "n_negative",
    )


def confusion_matrix(
    hist: DataFrame, threshold: float = K.DEFAULT_THRESHOLD, by: Sequence[str] = ()
) -> DataFrame:
    """Always four cells per series: (label, predicted, n)."""
    s = F.col("score")

    def cell(label: int, predicted: int) -> Column:
        hit = s >= threshold if predicted else s < threshold
        n = F.sum(F.when(hit, F.col("n_pos" if label else "n_neg")).otherwise(0))
        return F.struct(F.lit(label).alias("label"), F.lit(predicted).alias("predicted"), n.alias("n"))

    cells = hist.groupBy(*by).agg(
        F.array(*[cell(a, b) for a in (0, 1) for b in (0, 1)]).alias("_cells")
    )
    return cells.select(*by, F.inline("_cells"))


def ranking_metrics(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step sum), null without both classes."""
    walked = running_totals(hist, "score", ["n_pos", "n_neg"], by, descending=True)
    pos, neg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    tp, fp = F.col("cum_n_pos").cast("double"), F.col("cum_n_neg").cast("double")
    sums = walked.groupBy(*by).agg(
        F.sum(neg * (tp - pos / 2)).alias("_concordant"),
        F.sum(pos * tp / (tp + fp)).alias("_steps"),
        F.sum(pos).alias("_p"),
        F.sum(neg).alias("_n"),
    )
    p, n = F.col("_p"), F.col("_n")
    return sums.select(
        *by,
        F.when(n > 0, F.try_divide("_concordant", p * n)).alias("roc_auc"),
        F.try_divide("_steps", p).alias("pr_auc"),
    )


def _start_rows(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    return hist.groupBy(*by).agg(F.count("*").alias("_any"))


def roc_points(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score plus the origin (threshold infinity).

    Collinear points are kept.
    """
    walked = running_totals(
        hist, "score", ["n_pos", "n_neg"], by, descending=True, with_total=True
    )
    points = walked.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide("cum_n_neg", "total_n_neg").alias("fpr"),
        F.try_divide("cum_n_pos", "total_n_pos").alias("tpr"),
    )
    origin = _start_rows(hist, by).select(
        *by,
        F.lit(float("inf")).alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(origin)


def pr_points(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at each distinct score, with the prevalence baseline."""
    walked = running_totals(
        hist, "score", ["n_pos", "n_neg"], by, descending=True, with_total=True
    )
    tp, fp = F.col("cum_n_pos"), F.col("cum_n_neg")
    total = F.col("total_n_pos") + F.col("total_n_neg")
    points = walked.select(
        *by,
        F.col("score").alias("threshold"),
        (tp / (tp + fp)).alias("precision"),
        F.try_divide(tp, F.col("total_n_pos")).alias("recall"),
        F.try_divide(F.col("total_n_pos"), total).alias("baseline"),
    )
    end = hist.groupBy(*by).agg(F.sum("n_pos").alias("_p"), F.sum("n_neg").alias("_n"))
    end = end.select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        F.try_divide(F.col("_p"), F.col("_p") + F.col("_n")).alias("baseline"),
    )
    return points.unionByName(end)


def calibration_bin(score: Column, bins: int = K.CALIBRATION_BINS) -> Column:
    """Index of the uniform bin, edges belonging to the lower bin."""
    index = F.lit(0)
    for i in range(1, bins):
        index = index + F.when(score > i * (1.0 / bins), 1).otherwise(0)
    return index


def calibration_bins(
    hist: DataFrame, by: Sequence[str] = (), bins: int = K.CALIBRATION_BINS
) -> DataFrame:
    """Mean score and positive share of every non-empty bin."""
    n = F.sum(F.col("n_pos") + F.col("n_neg"))
    return hist.groupBy(*by, calibration_bin(F.col("score"), bins).alias("bin")).agg(
        n.alias("n_rows"),
        (F.sum(F.col("score") * (F.col("n_pos") + F.col("n_neg"))) / n).alias("mean_predicted"),
        (F.sum("n_pos") / n).alias("positive_share"),
    )


# --- threshold search ---------------------------------------------------------


def grid_value(i: Column) -> Column:
    return F.lit(K.GRID_START) + i * F.lit(K.GRID_STEP)


def grid_index(score: Column) -> Column:
    """Highest grid position not above the score; -1 below the grid."""
    guess = F.floor((score - K.GRID_START) / K.GRID_STEP)
    fixed = (
        F.when(score >= grid_value(guess + 1), guess + 1)
        .when(score < grid_value(guess), guess - 1)
        .otherwise(guess)
    )
    return F.least(F.greatest(fixed, F.lit(-1)), F.lit(K.GRID_SIZE - 1)).cast("int")


_SWEEP_SCORES = ("f1", "balanced_accuracy", "youden")


def _sweep_score(metric: str, tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    m = confusion_metrics(tp, fp, fn, tn)
    if metric == "f1":
        return m["f1_score"]
    if metric == "balanced_accuracy":
        return m["balanced_accuracy"]
    if metric == "youden":
        return _ratio(tp, tp + fn) + _ratio(tn, tn + fp) - 1
    raise ValueError(f"unknown metric: {metric}")


def _sweep_array(steps: Column, metric: str) -> Column:
    """Scores of all grid positions from the 81-entry array of (idx, n_pos, n_neg)."""

    def total(field: str, keep=None) -> Column:
        rows = F.filter(steps, keep) if keep is not None else steps
        return F.aggregate(rows, F.lit(0.0), lambda a, r: a + r[field])

    def at(i: Column) -> Column:
        tp, fp = total("n_pos", lambda r: r["idx"] >= i), total("n_neg", lambda r: r["idx"] >= i)
        fn, tn = total("n_pos", lambda r: r["idx"] < i), total("n_neg", lambda r: r["idx"] < i)
        return F.struct(
            _sweep_score(metric, tp, fp, fn, tn).alias("score"),
            (-i).alias("neg_i"),
            grid_value(i).alias("threshold"),
            tp.alias("tp"),
            fp.alias("fp"),
            fn.alias("fn"),
            tn.alias("tn"),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(K.GRID_SIZE - 1)), at)


def grid_steps(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """At most 81 rows per series: positives and negatives by grid position."""
    return hist.groupBy(*by, grid_index(F.col("score")).alias("idx")).agg(
        F.sum("n_pos").cast("double").alias("n_pos"), F.sum("n_neg").cast("double").alias("n_neg")
    )


def threshold_sweep(hist: DataFrame, metric: str = "f1", by: Sequence[str] = ()) -> DataFrame:
    """All 80 grid thresholds with their counts and score: one scan, not eighty."""
    if metric not in _SWEEP_SCORES:
        raise ValueError(f"unknown metric: {metric}")
    packed = grid_steps(hist, by).groupBy(*by).agg(
        F.collect_list(F.struct("idx", "n_pos", "n_neg")).alias("_steps")
    )
    return packed.select(*by, F.inline(_sweep_array(F.col("_steps"), metric))).select(
        *by, "threshold", "score", *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")]
    )


def best_threshold(hist: DataFrame, metric: str = "f1", by: Sequence[str] = ()) -> DataFrame:
    """First grid threshold with the highest score; 0.5 if none beats -1."""
    sweep = threshold_sweep(hist, metric, by)
    best = sweep.groupBy(*by).agg(
        F.max("score").alias("_score"),
        F.max_by("threshold", F.struct(F.col("score"), -F.col("threshold"))).alias("_at"),
    )
    beats = F.col("_score") > -1
    return best.select(
        *by,
        F.when(beats, F.col("_at")).otherwise(F.lit(K.DEFAULT_THRESHOLD)).alias("threshold"),
        F.when(beats, F.col("_score")).otherwise(F.lit(-1.0)).alias("score"),
    )


def classification_report(
    hist: DataFrame, threshold: float = K.DEFAULT_THRESHOLD, by: Sequence[str] = ()
) -> DataFrame:
    """Per-class precision, recall, F1 and support; accuracy; macro and weighted means."""
    s = F.col("score")
    counts = hist.groupBy(*by).agg(
        _sum_where(s >= threshold, "n_pos").alias("tp"),
        _sum_where(s >= threshold, "n_neg").alias("fp"),
        _sum_where(s < threshold, "n_pos").alias("fn"),
        _sum_where(s < threshold, "n_neg").alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    pos, neg, n = tp + fn, tn + fp, tp + fn + tn + fp
    per_class = {
        K.NON_TOXIC: (_ratio(tn, tn + fn), _ratio(tn, neg), _ratio(2 * tn, 2 * tn + fn + fp), neg),
        K.TOXIC: (_ratio(tp, tp + fp), _ratio(tp, pos), _ratio(2 * tp, 2 * tp + fp + fn), pos),
    }
    zero, one = per_class[K.NON_TOXIC], per_class[K.TOXIC]
    accuracy = _ratio(tp + tn, n)
    lines = {
        **per_class,
        "accuracy": (accuracy, accuracy, accuracy, n),
        "macro avg": (*[(a + b) / 2 for a, b in zip(zero[:3], one[:3])], n),
        "weighted avg": (*[_ratio(a * neg + b * pos, n) for a, b in zip(zero[:3], one[:3])], n),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("class_name"),
                p.alias("precision"),
                r.alias("recall"),
                f.alias("f1_score"),
                support.cast("bigint").alias("support"),
            )
            for name, (p, r, f, support) in lines.items()
        ]
    )
    return counts.select(*by, F.inline(rows))


def evaluate_all(
    hist: DataFrame,
    metric: str = "f1",
    by: Sequence[str] = (),
    threshold: float = K.DEFAULT_THRESHOLD,
) -> DataFrame:
    """The whole metrics record at the default and at the best grid threshold.

    One walk over the histogram yields the ranking sums and the 81 grid steps;
    everything after that is arithmetic inside one row per series.
    """
    if metric not in _SWEEP_SCORES:
        raise ValueError(f"unknown metric: {metric}")
    walked = running_totals(hist, "score", ["n_pos", "n_neg"], by, descending=True)
    s = F.col("score")
    pos, neg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    tp, fp = F.col("cum_n_pos").cast("double"), F.col("cum_n_neg").cast("double")
    steps = walked.groupBy(*by, grid_index(s).alias("idx")).agg(
        F.sum(neg * (tp - pos / 2)).alias("concordant"),
        F.sum(pos * tp / (tp + fp)).alias("ap_steps"),
        F.sum(pos * (s - 1) * (s - 1) + neg * s * s).alias("loss"),
        F.sum(pos).alias("n_pos"),
        F.sum(neg).alias("n_neg"),
        F.sum(F.when(s >= threshold, pos).otherwise(0.0)).alias("tp"),
        F.sum(F.when(s >= threshold, neg).otherwise(0.0)).alias("fp"),
    )
    one = steps.groupBy(*by).agg(
        *[F.sum(c).alias(f"_{c}") for c in ("concordant", "ap_steps", "loss", "n_pos", "n_neg", "tp", "fp")],
        F.collect_list(F.struct("idx", "n_pos", "n_neg")).alias("_grid"),
    )
    best = F.array_max(
        F.filter(_sweep_array(F.col("_grid"), metric), lambda r: r["score"] > -1)
    )
    one = one.withColumn("_best", best)
    p, n = F.col("_n_pos"), F.col("_n_neg")

    def record(name: str, at: Column, tp: Column, fp: Column) -> Column:
        metrics = confusion_metrics(tp, fp, p - tp, n - fp)
        return F.struct(
            F.lit(name).alias("kind"),
            F.when(n > 0, F.try_divide("_concordant", p * n)).alias("roc_auc"),
            F.try_divide("_ap_steps", p).alias("pr_auc"),
            F.try_divide(F.col("_loss"), p + n).alias("brier_score"),
            *[c.alias(k) for k, c in metrics.items()],
            at.alias("threshold"),
            (p + n).cast("bigint").alias("n_samples"),
            p.cast("bigint").alias("n_positive"),
            n.cast("bigint").alias("n_negative"),
        )

    default = record("default", F.lit(float(threshold)), F.col("_tp"), F.col("_fp"))
    found = F.coalesce(F.col("_best.threshold"), F.lit(float(threshold)))
    optimal = record(
        "optimal",
        found,
        F.coalesce(F.col("_best.tp"), F.col("_tp")),
        F.coalesce(F.col("_best.fp"), F.col("_fp")),
    )
    return one.select(*by, F.inline(F.array(default, optimal)))
