import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from screenloom import constants as K
from screenloom.operators import boosting, models
from screenloom.operators.boosting import Binned, BoostedModel, Setting

SETTINGS = [
    Setting.of({"n_estimators": 10, "max_depth": 3, "min_child_weight": 1}),
    Setting.of({"n_estimators": 11, "max_depth": 2, "subsample": 1.0, "colsample": 1.0, "gamma": 0}, held=1),
    Setting.of({"n_estimators": 3, "max_depth": 1}, held=0),
]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5)).round(1)
    x[:, 4] = x[:, 4] > 0
    y = (x[:, 0] * x[:, 1] + x[:, 4] + rng.normal(size=400) * 0.3 > 0.5).astype(int)
    rows = [(i, v.tolist(), int(t), 1.0 + float(t), i % 3) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, label int, w_pos double, fold int")
    return df.withColumn("features", array_to_vector("x")).cache()


def same(a, b):
    return all(
        len(p) == len(q) and all(np.array_equal(getattr(s, f), getattr(t, f)) for s, t in zip(p, q, strict=True) for f in ("feature", "bin", "value", "cover"))
        for p, q in zip(a, b, strict=True)
    )


def test_lock_step_over_many_blocks_equals_one_block(spark, table, monkeypatch):
    """The same trees and scores, however the rows are dealt."""
    one = Binned.of(table, "row_id", fold="fold")
    whole = boosting.fit_all(one, SETTINGS)
    place = lambda df: sorted((r.model, r.label, r.fold, r.score) for r in df.collect())
    scored = place(boosting.scores(one, SETTINGS))
    monkeypatch.setattr(boosting, "BLOCK_BYTES", 300)
    monkeypatch.setattr(boosting, "COMBINE_BYTES", 1 << 12)
    many = Binned.of(table.repartition(3), "row_id", fold="fold")
    assert not many.whole and many.blocks.count() > 4
    assert same(whole, boosting.fit_all(many, SETTINGS))
    again = place(boosting.scores(many, SETTINGS))
    assert [r[:3] for r in again] == [r[:3] for r in scored]
    assert [r[3] for r in again] == pytest.approx([r[3] for r in scored])


def plain_tree(x, g, h, s, columns, depth):
    """Exact greedy growth by trying every cut of every column, as nested tuples."""
    G, H = g.sum(), h.sum()
    leaf = -s.rate * G / (H + boosting.PENALTY)
    best = (max(s.gamma, 1e-12), None)
    for f in columns if depth < s.depth and H >= 2 * s.least_hessian or depth == 0 else []:
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            gl, hl = g[left].sum(), h[left].sum()
            if hl < s.least_hessian or H - hl < s.least_hessian:
                continue
            gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
            if gain > best[0] + 1e-12:
                best = (gain, (f, cut))
    if best[1] is None:
        return leaf
    f, cut = best[1]
    left = x[:, f] <= cut
    grow = lambda m: plain_tree(x[m], g[m], h[m], s, columns, depth + 1)
    return f, cut, grow(left), grow(~left)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_trees_equal_a_plain_learner(spark, table):
    binned = Binned.of(table, "row_id", fold="fold")
    block = binned.only()
    for s in SETTINGS[:2]:
        _, got = boosting.grown(block, s, binned.sizes)
        margin = np.zeros(len(block.bins))
        x = block.bins.astype(int)
        fit = np.ones(len(x), bool) if s.held is None else block.fold != s.held
        for t in range(s.trees):
            g, h = (v / boosting.QUANTUM for v in boosting.gradients(margin, block.label, block.weight))
            use = fit & boosting.drawn_rows(block.key, s, t)
            tree = plain_tree(x[use], g[use], h[use], s, boosting.drawn_columns(x.shape[1], s, t), 0)
            margin += [plain_value(tree, row) for row in x]
        assert got == pytest.approx(margin, abs=1e-9)


def test_model_scores_rows_as_the_bins_do(spark, table, tmp_path):
    binned = Binned.of(table, "row_id")
    trees, margin = boosting.grown(binned.only(), SETTINGS[0], binned.sizes)
    model = BoostedModel.of(trees, binned.edges, 3)
    out = model.transform(table.withColumn("key", F.xxhash64("row_id"))).orderBy("key").collect()
    assert [r.rawPrediction[1] for r in out] == pytest.approx(margin)
    model.save(spark, str(tmp_path / "m"))
    back = BoostedModel.load(spark, str(tmp_path / "m"))
    x = np.array([r.x for r in out])
    assert np.array_equal(back.margins(x), model.margins(x)) and back.getMaxDepth() == 3
    odd = spark.createDataFrame([([float("nan")] * 5,)], "x array<double>").withColumn("features", array_to_vector("x"))
    assert 0 < model.transform(odd).first().probability[1] < 1


def test_folds_are_measured_on_rows_left_out(spark, table):
    table = models.with_weights(table.drop("w_pos"))[0]
    named = {"a": models.boosted_trees({"n_estimators": 20, "max_depth": 3}), "b": models.boosted_trees({"n_estimators": 5, "max_depth": 9, "gamma": 0})}
    rows = models.cross_validate(table, named, folds=3).collect()
    assert sorted((r.model, r.fold) for r in rows) == [(m, f) for m in "ab" for f in range(3)]
    assert all(0.7 < r.roc_auc <= r.train_roc_auc <= 1 and r.error is None for r in rows)
    # A fit on a table without the fold's rows has other edges at most; held-out scores stay close.
    binned = Binned.of(table.filter("fold <> 2"), "row_id")
    setting = Setting.of(named["a"].params)
    alone = BoostedModel.of(boosting.fit_all(binned, [setting])[0], binned.edges, setting.depth)
    held = boosting.scores(Binned.of(table, "row_id", fold="fold"), [Setting.of(named["a"].params, 2)]).filter("fold = 2")
    mine = alone.transform(table.filter("fold = 2")).select("probability").collect()
    assert sorted(r.score for r in held.collect()) == pytest.approx(sorted(r.probability[1] for r in mine), abs=0.1)


def test_one_class_and_no_rows(spark, table):
    one = models.boosted_trees({"n_estimators": 2}).fit(table.withColumn("label", F.lit(0)))
    assert (one.feature < 0).all() and (one.margins(np.zeros((1, 5))) < 0).all()
    with pytest.raises(ValueError):
        models.boosted_trees().fit(table.limit(0))
    alone = table.withColumn("fold", F.lit(0))
    rows = models.cross_validate(models.with_weights(alone.drop("w_pos"))[0], {"a": models.boosted_trees({"n_estimators": 2})}, folds=1).collect()
    assert [r.error for r in rows] == ["ValueError: no rows to fit on"]
    assert K.BOOSTED["n_estimators"] == models.boosted_trees().getMaxIter()


def test_sums_of_flags_and_small_children_are_exact():
    """Flags, constants and wider columns: each sum is the plain one, and the larger child is the parent less the smaller."""
    rng = np.random.default_rng(7)
    sizes = np.array([2, 5, 2, 1, 2, 32, 2, 2])
    bins = np.stack([rng.integers(0, n, 900) for n in sizes], 1).astype(np.uint8)
    g, h = np.rint(rng.normal(size=900) * boosting.QUANTUM), rng.integers(1, 1 << 18, 900).astype(float)
    for columns in (np.arange(8), np.array([1, 3, 5]), np.array([0, 2, 4, 6, 7])):
        use = np.flatnonzero(rng.random(900) < 0.7)
        cells = boosting.Cells.of(bins, use, columns, sizes)
        node = rng.integers(2, 4, len(use))
        above = boosting._level_sums(cells, np.ones(len(use), int), np.ones(1, int), 8, g[use], h[use], None)
        _, below = boosting._level_sums(cells, node, np.array([2, 3]), 8, g[use], h[use], above)
        for made, value in zip(below, (g, h), strict=True):
            plain = [[value[use][(node == i) & (bins[use, c] == b)].sum() for c in columns for b in range(sizes[c])] for i in (2, 3)]
            assert np.array_equal(made, plain)


def test_growth_does_not_copy_all_flags_for_every_tree():
    rng = np.random.default_rng(8)
    bins = (rng.random((4000, 1024)) < 0.3).astype(np.uint8)
    block = boosting.Block(bins, np.arange(4000), bins[:, 3].astype(float), np.ones(4000), np.zeros(4000, np.int32))
    cells = boosting.Cells.of(bins, np.arange(0, 4000, 2), np.arange(1, 1024), np.full(1024, 2))
    assert cells.flags is block.bins


def test_sums_that_meet_at_the_driver_give_the_same_trees(spark, table, monkeypatch):
    """A table of many blocks is dealt to all cores, and its few sums come back in one step."""
    whole = boosting.fit_all(Binned.of(table, "row_id", fold="fold"), SETTINGS[2:])
    monkeypatch.setattr(boosting, "BLOCK_BYTES", 1500)
    many = Binned.of(table, "row_id", fold="fold")
    assert many.blocks.count() == boosting.LEAST_BLOCKS
    assert len(many.blocks.inputFiles()) > 1
    monkeypatch.setattr(boosting, "DIRECT_BYTES", 0)
    assert same(whole, boosting.fit_all(many, SETTINGS[2:]))
    monkeypatch.setattr(boosting, "DIRECT_BYTES", 1 << 20)
    monkeypatch.setattr(boosting, "_split_row", None)
    assert same(whole, boosting.fit_all(many, SETTINGS[2:]))
