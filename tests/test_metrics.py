import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenloom import constants as K
from screenloom.operators import metrics, running


def brute_auc(rows):
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def brute_ap(rows):
    total, last, ap = sum(y for y, _ in rows), 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        hit = [y for y, s in rows if s >= t]
        recall = sum(hit) / total
        ap += (recall - last) * sum(hit) / len(hit)
        last = recall
    return ap


def brute_counts(rows, t):
    tp = sum(y and s >= t for y, s in rows)
    fp = sum((not y) and s >= t for y, s in rows)
    fn = sum(y and s < t for y, s in rows)
    return tp, fp, fn, len(rows) - tp - fp - fn


def sample(seed, n=300):
    rng = random.Random(seed)
    grid = [0.1 + i * K.GRID_STEP for i in range(80)] + [i / 10 for i in range(11)]
    return [(int(rng.random() < 0.3), rng.choice(grid + [rng.random()] * 40)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    return sample(1)


@pytest.fixture(scope="module")
def hist(spark, rows):
    return metrics.score_histogram(spark.createDataFrame(rows, "label INT, score DOUBLE"))


def test_ranking(hist, rows):
    row = metrics.ranking_metrics(hist).first()
    assert row.roc_auc == pytest.approx(brute_auc(rows), abs=1e-12)
    assert row.pr_auc == pytest.approx(brute_ap(rows), abs=1e-12)


def test_clustered_and_outside_scores(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.5), 0.5 + rng.randrange(50) * 2.0**-50) for _ in range(200)]
    rows += [(1, 1.0), (0, 0.0), (1, -3.0), (0, 7.5), (1, 1e-300)]
    h = metrics.score_histogram(spark.createDataFrame(rows, "label INT, score DOUBLE"))
    assert metrics.ranking_metrics(h).first().roc_auc == pytest.approx(brute_auc(rows), abs=1e-12)


def test_series(spark):
    data = [(m, *r) for m in ("a", "b") for r in sample(hash(m) % 7, 80)]
    h = metrics.score_histogram(
        spark.createDataFrame(data, "m STRING, label INT, score DOUBLE"), by=["m"]
    )
    for row in metrics.ranking_metrics(h, ["m"]).collect():
        mine = [(y, s) for m, y, s in data if m == row.m]
        assert row.roc_auc == pytest.approx(brute_auc(mine))
    assert metrics.evaluate_all(h, by=["m"]).count() == 4


def test_threshold_metrics(hist, rows):
    for t in (0.5, 0.3, 0.1 + 20 * K.GRID_STEP):
        tp, fp, fn, tn = brute_counts(rows, t)
        row = metrics.metrics_at_threshold(hist, t).first()
        assert row.accuracy == pytest.approx((tp + tn) / len(rows))
        assert row.balanced_accuracy == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)
        assert row.f1_score == pytest.approx(2 * tp / (2 * tp + fp + fn))
        want = (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        assert row.mcc == pytest.approx(want)
        assert row.brier_score == pytest.approx(np.mean([(s - y) ** 2 for y, s in rows]))
        cells = {(r.label, r.predicted): r.n for r in metrics.confusion_matrix(hist, t).collect()}
        assert cells == {(1, 1): tp, (0, 1): fp, (1, 0): fn, (0, 0): tn}


def test_published_record_shape(spark):
    """The confusion counts behind the published record give the published metrics."""
    rows = [(1, 0.9)] * 31 + [(0, 0.9)] * 20 + [(1, 0.1)] * 20 + [(0, 0.1)] * 208
    h = metrics.score_histogram(spark.createDataFrame(rows, "label INT, score DOUBLE"))
    row = metrics.metrics_at_threshold(h).first()
    assert round(row.accuracy, 4) == 0.8566 and round(row.balanced_accuracy, 4) == 0.7601
    assert round(row.precision, 4) == round(row.recall, 4) == round(row.f1_score, 4) == 0.6078
    assert round(row.mcc, 4) == 0.5201 and row.n_samples == 279


def test_zero_guards(spark):
    h = metrics.score_histogram(spark.createDataFrame([(1, 0.2), (0, 0.1)], "label INT, score DOUBLE"))
    row = metrics.metrics_at_threshold(h, 0.9).first()
    assert (row.precision, row.recall, row.f1_score, row.mcc) == (0, 0, 0, 0)
    one = metrics.score_histogram(spark.createDataFrame([(0, 0.2), (0, 0.1)], "label INT, score DOUBLE"))
    assert metrics.ranking_metrics(one).first().roc_auc is None
    assert metrics.evaluate_all(one).count() == 2


def test_threshold_search(hist, rows):
    grid = np.arange(0.1, 0.9, 0.01)
    assert len(grid) == K.GRID_SIZE
    sweep = sorted(metrics.threshold_sweep(hist).collect(), key=lambda r: r.threshold)
    assert [r.threshold for r in sweep] == list(grid)
    for r in sweep:
        assert (r.tp, r.fp, r.fn, r.tn) == brute_counts(rows, r.threshold)

    def score(metric, t):
        tp, fp, fn, tn = brute_counts(rows, t)
        if metric == "f1":
            return 2 * tp / (2 * tp + fp + fn)
        both = tp / (tp + fn) + tn / (tn + fp)
        return both / 2 if metric == "balanced_accuracy" else both - 1

    for metric in ("f1", "balanced_accuracy", "youden"):
        found = metrics.best_threshold(hist, metric).first()
        values = [score(metric, t) for t in grid]
        assert found.score == pytest.approx(max(values))
        assert values[list(grid).index(found.threshold)] == pytest.approx(max(values))
    with pytest.raises(ValueError):
        metrics.threshold_sweep(hist, "recall")


def test_first_maximum_wins(spark):
    h = metrics.score_histogram(spark.createDataFrame([(1, 0.95), (0, 0.05)], "label INT, score DOUBLE"))
    assert metrics.best_threshold(h).first().threshold == 0.1


def test_evaluate_all_agrees_with_the_parts(hist):
    both = {r.kind: r for r in metrics.evaluate_all(hist).collect()}
    rank, best = metrics.ranking_metrics(hist).first(), metrics.best_threshold(hist).first()
    assert both["default"].roc_auc == pytest.approx(rank.roc_auc)
    assert both["default"].pr_auc == pytest.approx(rank.pr_auc)
    assert both["optimal"].threshold == best.threshold
    at = metrics.metrics_at_threshold(hist, best.threshold).first()
    assert both["optimal"].mcc == pytest.approx(at.mcc)


def test_points(hist, rows):
    roc = metrics.roc_points(hist).collect()
    assert len(roc) == len({s for _, s in rows}) + 1
    xy = sorted((r.fpr, r.tpr) for r in roc)
    assert np.trapezoid([y for _, y in xy], [x for x, _ in xy]) == pytest.approx(brute_auc(rows))
    pr = metrics.pr_points(hist).collect()
    assert {round(r.baseline, 12) for r in pr} == {round(sum(y for y, _ in rows) / len(rows), 12)}


def test_calibration_edges_belong_to_the_lower_bin(spark):
    edges = [0.0, 0.1, 0.2, 0.3, 0.30000000000000004, 0.7000000000000001, 0.9, 1.0, 0.95]
    want = np.searchsorted(np.linspace(0, 1, 11)[1:-1], edges)
    df = spark.createDataFrame([(e,) for e in edges], "s DOUBLE")
    got = [r[0] for r in df.select(metrics.calibration_bin(F.col("s"))).collect()]
    assert got == list(want)


def test_report(hist, rows):
    lines = {r.class_name: r for r in metrics.classification_report(hist, 0.4).collect()}
    tp, fp, fn, tn = brute_counts(rows, 0.4)
    assert lines["Toxic"].precision == pytest.approx(tp / (tp + fp))
    assert lines["Non-Toxic"].recall == pytest.approx(tn / (tn + fp))
    assert lines["accuracy"].f1_score == pytest.approx((tp + tn) / len(rows))
    assert lines["weighted avg"].support == len(rows)


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_quantile(spark, q):
    values = [random.Random(3).random() for _ in range(1)] + [i / 97 for i in range(98)] + [0.25] * 30
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    assert running.exact_quantile(df, "v", q) == pytest.approx(np.quantile(values, q))


def test_running_totals_against_cumsum(spark):
    rng = random.Random(9)
    scores = sorted({rng.random() ** 4 for _ in range(500)})
    df = spark.createDataFrame([(s, i % 5) for i, s in enumerate(scores)], "s DOUBLE, n BIGINT")
    up = {r.s: r.cum_n for r in running.running_totals(df, "s", ["n"]).collect()}
    assert [up[s] for s in scores] == list(np.cumsum([i % 5 for i in range(len(scores))]))
    down = {r.s: r.cum_n for r in running.running_totals(df, "s", ["n"], descending=True).collect()}
    total = sum(i % 5 for i in range(len(scores)))
    assert all(up[s] + down[s] == total + i % 5 for i, s in enumerate(scores))


@pytest.mark.parametrize("values", [
    [2.5 + i for i in range(3000)],
    [1e-14 * i for i in range(3000)],
    [-5.0 - i / 7 for i in range(3000)],
    [0.5] * 10 + [float("inf"), float("-inf")],
])
def test_no_range_holds_many_rows_wherever_scores_lie(spark, values):
    rows = [(v, i % 3 + 1) for i, v in enumerate(sorted(set(values)))]
    df = spark.createDataFrame(rows, "s DOUBLE, n LONG")
    largest = running.ranged(df, "s").groupBy("_range").count().agg({"count": "max"}).first()[0]
    assert largest <= 2 + 2 * len(rows) / running.RANGES
    got = {r.s: r.cum_n for r in running.running_totals(df, "s", ["n"]).collect()}
    assert [got[s] for s, _ in rows] == np.cumsum([n for _, n in rows]).tolist()
