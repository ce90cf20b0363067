import numpy as np
from pyspark.sql import functions as F

from screenloom.operators import boosting, features, models


def test_fits_take_no_more_tasks_than_cores_can_use(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    assert [features.fit_tasks(spark, n) for n in (0, 1, 2_500, 2_501)] == [1, 1, 1, 2]
    assert features.fit_tasks(spark, 1_000_000 * cores) == 20 * cores
    assert features.fit_tasks(spark, 50_000 * cores) == 2 * cores
    seen = []

    class Watched:
        def copy(self):
            return self

        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))
            raise ValueError("seen")

    monkeypatch.setattr(features, "MOST_FIT_ROWS", 1)
    rows = spark.range(0, 300, 1, 12).select((F.col("id") % 2).alias("label"), (F.col("id") % 3).cast("int").alias("fold"))
    rows = rows.withColumns({c: F.lit(1.0) for c in ("features", "w_pos", "w_balanced")})
    table = models.cross_validate(rows, {"watched": Watched()}, folds=3)
    assert seen == [(1, 200)] * 3 and table.filter("error like '%seen'").count() == 3


def test_rows_find_their_leaves():
    rng = np.random.default_rng(3)
    for depth in (1, 4):
        tree = boosting.Tree.blank(depth)
        tree.feature[1 : 1 << depth] = rng.integers(-1, 5, (1 << depth) - 1)
        tree.bin[:] = rng.integers(0, 32, len(tree.bin))
        bins = rng.integers(0, 32, (200, 5)).astype(np.uint8)
        bins[0] = 255
        node = boosting.leaves(tree, bins, depth)
        column, cut, left = boosting.routes(tree)
        assert (cut[tree.feature < 0] == 255).all() and (left >= np.arange(len(left))).all()
        for row, got in zip(bins, node.tolist(), strict=True):
            at = 1
            while at < 1 << depth and tree.feature[at] >= 0:
                at = 2 * at + int(row[tree.feature[at]] > tree.bin[at])
            assert at == got
        assert len(boosting.leaves(tree, bins[:0], depth)) == 0
