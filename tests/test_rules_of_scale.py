"""One path at every size, folder tables, and rules for odd values."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from screenloom.operators import metrics, models, outliers, scoring
from screenloom.sources import delimited
from screenloom.streaming.scoring import file_stream


@pytest.mark.parametrize("n", [300, 60_000])
def test_trees_draw_independently_at_every_size(spark, n):
    """Both sides of trees * sample = 51,200 rows: full, distinct and overlapping as independent draws are."""
    trees, sample = 200, 256
    drawn = outliers.tree_samples(spark.range(n), "id", trees, sample, 7, n)
    per_tree = drawn.groupBy("tree_id").agg(F.count("*").alias("n"), F.countDistinct("_id").alias("d")).collect()
    assert len(per_tree) == trees and all(r.n == r.d == sample for r in per_tree)
    rows = drawn.select("_id").distinct().count()
    expected = n * (1 - (1 - sample / n) ** trees)
    assert abs(rows - expected) <= max(6 * math.sqrt(expected), 1)


def test_stream_reads_folder_tables(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    streamed = entry.queries()["stream_score"](spark, str(tmp_path))
    batch = entry.queries()["score_batch"](spark, "/root/testdata/sf0.001")
    shared = [c for c in batch.columns if c in streamed.columns]
    key = lambda df: sorted(map(str, df.select(*shared).collect()))
    assert streamed.count() == orders.count() and key(streamed) == key(batch)


def test_stream_without_files_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        file_stream(spark, f"{tmp_path}/nothing*", spark.range(1).schema)


def test_nan_scores_are_left_out(spark):
    rows = [(0.9, 1), (0.1, 0), (math.nan, 0), (None, 1)]
    got = metrics.score_histogram(spark.createDataFrame(rows, "score double, label int")).collect()
    assert sorted((r.score, r.n_pos, r.n_neg) for r in got) == [(0.1, 0, 1), (0.9, 1, 0)]


def test_draws_end(spark):
    with pytest.raises(ValueError):
        models.draw_parameters(10**9)
    assert len(models.draw_parameters(20)) == 20


def test_quoted_headers_agree(spark, tmp_path):
    (tmp_path / "x.csv").write_text('"a ""b""",c\n1,2\n')
    path = str(tmp_path / "x.csv")
    header = delimited.read_header(spark, path)
    assert header == ['a "b"', "c"]
    read = delimited.read_delimited(spark, path, '`a "b"` STRING, c INT')
    assert read.collect()[0].c == 2


def test_carried_columns(spark):
    from screenloom.plans import inputs as I
    from screenloom.plans import rule_queries as R

    rows = I.screen_notation(I.describe(spark.read.parquet("/root/testdata/sf0.001/orders.parquet")))
    rows = rows.withColumn("a.b", F.lit(1)).withColumn("warnings", F.lit("mine"))
    out = scoring.score_batch(rows, R._COLUMNS, R._THRESHOLD, carry=["a.b", "warnings", "row_id"])
    assert out.columns.count("warnings") == 1 and out.columns[-2:] == ["a.b", "row_id"]
    assert out.filter("warnings = 'mine'").count() == 0 and out.filter("`a.b` = 1").count() == rows.count()
