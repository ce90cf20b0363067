import hashlib
import math

import pytest
from pyspark.sql import functions as F

from screenloom.operators import splitting, summaries


def labelled(spark, n, share=3):
    return spark.range(n).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("smiles"),
        (F.pmod(F.xxhash64("id"), F.lit(10)) < share).cast("int").alias("label"),
    )


@pytest.mark.parametrize("n", [30, 100, 1860, 5001])
def test_split_sizes_and_shares(spark, n):
    df = labelled(spark, n)
    rows = splitting.stratified_split(df).collect()
    sizes = {s: sum(r.split == s for r in rows) for s in ("train", "val", "test")}
    n_test = math.ceil(0.15 * n)
    n_val = math.ceil(0.15 / 0.85 * (n - n_test))
    assert sizes == {"test": n_test, "val": n_val, "train": n - n_test - n_val}
    share = sum(r.label for r in rows) / n
    for s, size in sizes.items():
        inside = sum(r.label for r in rows if r.split == s)
        assert abs(inside - share * size) <= 2
    assert len({r.smiles for r in rows}) == n


def test_published_sizes(spark):
    df = spark.range(1860).select(
        F.col("id").cast("string").alias("smiles"), (F.col("id") < 338).cast("int").alias("label")
    )
    stats = {r.split: r for r in summaries.split_stats(splitting.stratified_split(df)).collect()}
    assert (stats["train"]["size"], stats["val"]["size"], stats["test"]["size"]) == (1302, 279, 279)
    assert (stats["val"].toxic, stats["test"].toxic) == (51, 51)


def test_split_follows_hash_order_and_ignores_partitioning(spark):
    df = labelled(spark, 400)
    first = {r.smiles: r.split for r in splitting.stratified_split(df.repartition(1)).collect()}
    again = {r.smiles: r.split for r in splitting.stratified_split(df.repartition(13)).collect()}
    other = {r.smiles: r.split for r in splitting.stratified_split(df, seed=7).collect()}
    assert first == again and first != other
    for label in (0, 1):
        keys = [r.smiles for r in df.filter(F.col("label") == label).collect()]
        keys.sort(key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
        order = [first[k] for k in keys]
        assert order == sorted(order, key=["test", "val", "train"].index)
    assert splitting.split_overlap(splitting.stratified_split(df)).count() == 0


def test_short_prefix_gives_the_same_split(spark):
    df = labelled(spark, 500)
    a = {r.smiles: r.split for r in splitting.stratified_split(df, prefix_digits=1).collect()}
    b = {r.smiles: r.split for r in splitting.stratified_split(df, prefix_digits=6).collect()}
    assert a == b


def test_split_guards(spark):
    with pytest.raises(ValueError):
        splitting.stratified_split(labelled(spark, 40), ratios=(0.5, 0.2, 0.1))
    with pytest.raises(ValueError):
        splitting.stratified_split(labelled(spark, 20), min_rows=30)


@pytest.mark.parametrize("n, k", [(103, 5), (7, 5), (64, 2)])
def test_folds(spark, n, k):
    rows = splitting.stratified_folds(labelled(spark, n), k).collect()
    assert len(rows) == n and {r.fold for r in rows} <= set(range(k))
    for label in (0, 1):
        sizes = [sum(r.fold == f and r.label == label for r in rows) for f in range(k)]
        assert max(sizes) - min(sizes) <= 1


def test_sample(spark):
    df = labelled(spark, 300)
    a = [r.smiles for r in splitting.sample_rows(df, 20, "smiles").collect()]
    b = [r.smiles for r in splitting.sample_rows(df.repartition(7), 20, "smiles").collect()]
    assert a == b and len(set(a)) == 20
    assert splitting.sample_rows(df, 1000, "smiles").count() == 300
