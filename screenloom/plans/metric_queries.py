"""Queries on ranking, threshold and reliability metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.operators import metrics, running
from screenloom.plans import inputs as I
from screenloom.plans.registry import query

_DIGITS = 9


def _hist(spark: SparkSession, sf: str, by: tuple[str, ...] = ()) -> DataFrame:
    return metrics.score_histogram(I.scored_events(spark, sf), by=by)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, _DIGITS) for n in names})


_WITH = f"WITH {I.SQL_HIST}"

_SQL_RANKING = """
ranking AS (
  SELECT sum(n_neg * (tp - n_pos / 2)) / (max(p)::DOUBLE * max(n)) AS roc_auc,
         sum(n_pos * (tp / (tp + fp))) / max(p) AS pr_auc
  FROM walked
)
"""

_SQL_RATES = """
  (tp + tn) / (tp + tn + fp + fn) AS accuracy,
  (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy,
  coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
  tp / (tp + fn) AS recall,
  2 * tp / (2 * tp + fp + fn) AS f1_score,
  coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn)
    / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0) AS mcc
"""

_SQL_AT = """
at_half AS (
  SELECT count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp,
         count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 0 AND score < 0.5) AS tn,
         avg((score - label) * (score - label)) AS brier_score, count(*) AS n_samples,
         count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative
  FROM scored
)
"""

_SQL_SWEEP = """
grid AS (SELECT i, 0.1::DOUBLE + i * 0.009999999999999995::DOUBLE AS t FROM range(80) r(i)),
swept AS (
  SELECT i, t AS threshold, count(*) FILTER (label = 1 AND score >= t) AS tp,
         count(*) FILTER (label = 0 AND score >= t) AS fp, count(*) FILTER (label = 1 AND score < t) AS fn,
         count(*) FILTER (label = 0 AND score < t) AS tn
  FROM grid, scored GROUP BY ALL
)
"""


@query("roc_auc", f"{_WITH}, {_SQL_RANKING} SELECT round(roc_auc, {_DIGITS}) AS roc_auc FROM ranking")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.ranking_metrics(_hist(spark, sf)).select("roc_auc"), "roc_auc")


@query("average_precision", f"{_WITH}, {_SQL_RANKING} SELECT round(pr_auc, {_DIGITS}) AS pr_auc FROM ranking")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.ranking_metrics(_hist(spark, sf)).select("pr_auc"), "pr_auc")


@query(
    "ranking_by_series",
    f"""WITH {I.SQL_SCORED},
    hist AS (SELECT series, score, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg
             FROM scored GROUP BY ALL),
    walked AS (SELECT *, sum(n_pos) OVER w AS tp, sum(n_neg) OVER w AS fp FROM hist
               WINDOW w AS (PARTITION BY series ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
    SELECT series, round(sum(n_neg * (tp - n_pos / 2)) / (sum(n_pos)::DOUBLE * sum(n_neg)), {_DIGITS}) AS roc_auc,
           round(sum(n_pos * (tp / (tp + fp))) / sum(n_pos), {_DIGITS}) AS pr_auc
    FROM walked GROUP BY series""",
)
def ranking_by_series(spark: SparkSession, sf: str) -> DataFrame:
    """Every series in one job."""
    by = ("series",)
    return _rounded(metrics.ranking_metrics(_hist(spark, sf, by), by), "roc_auc", "pr_auc")


@query(
    "metrics_at_threshold",
    f"""WITH {I.SQL_SCORED}, {_SQL_AT}, m AS (SELECT brier_score, {_SQL_RATES}, n_samples, n_positive, n_negative FROM at_half)
    SELECT round(brier_score, {_DIGITS}) AS brier_score, round(accuracy, {_DIGITS}) AS accuracy,
      round(balanced_accuracy, {_DIGITS}) AS balanced_accuracy, round(precision, {_DIGITS}) AS precision,
      round(recall, {_DIGITS}) AS recall, round(f1_score, {_DIGITS}) AS f1_score, round(mcc, {_DIGITS}) AS mcc,
      0.5::DOUBLE AS threshold, n_samples, n_positive, n_negative FROM m""",
)
def metrics_at_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(
        metrics.metrics_at_threshold(_hist(spark, sf)),
        "brier_score", "accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "mcc",
    )


@query(
    "confusion_matrix",
    f"""WITH {I.SQL_SCORED} SELECT label, CAST(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS predicted,
        count(*) AS n FROM scored GROUP BY ALL""",
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(_hist(spark, sf))


@query(
    "threshold_sweep",
    f"""WITH {I.SQL_SCORED}, {_SQL_SWEEP}
    SELECT threshold, round(2 * tp / (2 * tp + fp + fn), {_DIGITS}) AS score, tp, fp, fn, tn FROM swept""",
)
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.threshold_sweep(_hist(spark, sf)), "score")


@query(
    "best_threshold",
    f"""WITH {I.SQL_SCORED}, {_SQL_SWEEP},
    s AS (
      SELECT 'f1' AS metric, i, threshold, 2 * tp / (2 * tp + fp + fn) AS score FROM swept
      UNION ALL SELECT 'balanced_accuracy', i, threshold, (tp / (tp + fn) + tn / (tn + fp)) / 2 FROM swept
      UNION ALL SELECT 'youden', i, threshold, tp / (tp + fn) + tn / (tn + fp) - 1 FROM swept
    )
    SELECT metric, threshold, round(score, {_DIGITS}) AS score FROM s
    QUALIFY row_number() OVER (PARTITION BY metric ORDER BY score DESC, i) = 1""",
)
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    hist = _hist(spark, sf)
    found = None
    for name in ("f1", "balanced_accuracy", "youden"):
        row = metrics.best_threshold(hist, name).select(F.lit(name).alias("metric"), "threshold", "score")
        found = row if found is None else found.unionByName(row)
    return _rounded(found, "score")


@query(
    "roc_points",
    f"""{_WITH} SELECT score AS threshold, fp / n AS fpr, tp / p AS tpr FROM walked
    UNION ALL SELECT 'Infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""",
)
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.roc_points(_hist(spark, sf))


@query(
    "pr_points",
    f"""{_WITH} SELECT score AS threshold, tp / (tp + fp) AS precision, tp / p AS recall, p / (p + n) AS baseline FROM walked
    UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE, max(p) / (max(p) + max(n)) FROM walked""",
)
def pr_points(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.pr_points(_hist(spark, sf))


@query(
    "calibration_bins",
    f"""WITH {I.SQL_SCORED}
    SELECT CAST((SELECT count(*) FROM range(1, 10) e(i) WHERE score > e.i * 0.1::DOUBLE) AS INTEGER) AS bin,
           count(*) AS n_rows, round(avg(score), {_DIGITS}) AS mean_predicted, avg(label) AS positive_share
    FROM scored GROUP BY 1""",
)
def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.calibration_bins(_hist(spark, sf)), "mean_predicted")


@query(
    "classification_report",
    f"""WITH {I.SQL_SCORED}, {_SQL_AT},
    c AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0, tn + fp AS s0,
                 tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fp + fn) AS f1, tp + fn AS s1,
                 (tp + tn) / (tp + tn + fp + fn) AS acc FROM at_half),
    u AS (
      SELECT 'Non-Toxic' AS class_name, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM c
      UNION ALL SELECT 'Toxic', p1, r1, f1, s1 FROM c
      UNION ALL SELECT 'accuracy', acc, acc, acc, s0 + s1 FROM c
      UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM c
      UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
             (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM c
    )
    SELECT class_name, round(precision, {_DIGITS}) AS precision, round(recall, {_DIGITS}) AS recall,
           round(f1_score, {_DIGITS}) AS f1_score, support FROM u""",
)
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.classification_report(_hist(spark, sf)), "precision", "recall", "f1_score")


@query(
    "evaluate_all",
    f"""{_WITH}, {_SQL_RANKING}, {_SQL_AT}, {_SQL_SWEEP},
    best AS (SELECT * FROM swept ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, i LIMIT 1),
    kinds AS (
      SELECT 'default' AS kind, 0.5::DOUBLE AS threshold, tp, fp, fn, tn FROM at_half
      UNION ALL SELECT 'optimal', threshold, tp, fp, fn, tn FROM best
    ),
    m AS (SELECT kind, threshold, {_SQL_RATES} FROM kinds)
    SELECT kind, round(roc_auc, {_DIGITS}) AS roc_auc, round(pr_auc, {_DIGITS}) AS pr_auc,
      round(brier_score, {_DIGITS}) AS brier_score, round(accuracy, {_DIGITS}) AS accuracy,
      round(balanced_accuracy, {_DIGITS}) AS balanced_accuracy, round(precision, {_DIGITS}) AS precision,
      round(recall, {_DIGITS}) AS recall, round(f1_score, {_DIGITS}) AS f1_score, round(mcc, {_DIGITS}) AS mcc,
      threshold, n_samples, n_positive, n_negative
    FROM m, ranking, (SELECT brier_score, n_samples, n_positive, n_negative FROM at_half)""",
)
def evaluate_all(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(
        metrics.evaluate_all(_hist(spark, sf)),
        "roc_auc", "pr_auc", "brier_score", "accuracy", "balanced_accuracy",
        "precision", "recall", "f1_score", "mcc",
    )


@query(
    "score_quantile",
    f"""WITH {I.SQL_SCORED} SELECT count(*) AS n_below FROM scored
        WHERE score < (SELECT quantile_cont(score, 0.05) FROM scored)""",
)
def score_quantile(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.scored_events(spark, sf)
    cut = running.exact_quantile(rows, "score", 0.05)
    return rows.filter(F.col("score") < cut).agg(F.count("*").alias("n_below"))
