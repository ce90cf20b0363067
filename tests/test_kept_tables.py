"""Tables kept between jobs: folded votes, refreshed parts, published versions, restarted streams, leases."""

import itertools
import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from screenloom import session
from screenloom.operators import outliers, vote_state, voting
from screenloom.operators.cleaning import TooFewRows
from screenloom.plans import training
from screenloom.sources import parts, versions
from screenloom.streaming.scoring import file_stream, read_batches, score_batches

SF = "/root/testdata/sf0.001"
VOTES = "smiles STRING, label INT, source STRING, row_id BIGINT"


def plain(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


# --- votes -------------------------------------------------------------------------


def test_folded_votes_equal_one_vote(spark, tmp_path):
    """Any cut into deliveries gives the vote over all rows; one key holds a third of them."""
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", (i * 7) % 2, "ab"[i % 2], i) for i in range(60)]
    rows += [(None, 1, "a", 60), ("k1", None, "a", 61), ("k2", 1, None, 62), ("late", 1, "c", 63)]
    whole = spark.createDataFrame(rows, VOTES)
    for most in (1, 3, 16):
        path = str(tmp_path / f"votes{most}")
        for k, part in enumerate(itertools.batched(rows, 13)):
            vote_state.fold_delivery(spark.createDataFrame(list(part), VOTES), path, f"d{k}", most=most)
        assert plain(vote_state.kept_votes(spark, path)) == plain(voting.vote(whole))
        assert len(versions.latest(spark, path)[1]["pieces"]) <= most


def test_a_delivery_counts_once_and_empty_ones_do_no_harm(spark, tmp_path):
    path = str(tmp_path / "votes")
    rows = spark.createDataFrame([("x", 0, "a", 1), ("x", 0, "b", 2)], VOTES)
    vote_state.fold_delivery(rows, path, "one")
    vote_state.fold_delivery(rows, path, "one")
    assert vote_state.kept_votes(spark, path).first().n_merged == 2
    first = vote_state.changed_votes(spark, path).first()
    assert (first.label, first.label_before) == (0, None)
    more = spark.createDataFrame([("x", 1, "a", 3), ("x", 1, "a", 4), ("new", 1, "a", 5)], VOTES)
    vote_state.fold_delivery(more, path, "two", most=1)
    got = {r.row_id: (r.label_before, r.label, r.n_merged) for r in vote_state.changed_votes(spark, path).collect()}
    assert got == {1: (0, 1, 4), 5: (None, 1, 1)}
    vote_state.fold_delivery(rows.limit(0), path, "three")
    assert vote_state.changed_votes(spark, path).count() == 0 and vote_state.kept_votes(spark, path).count() == 2
    with pytest.raises(FileNotFoundError):
        vote_state.kept_votes(spark, str(tmp_path / "nothing"))


# --- versions ----------------------------------------------------------------------


def test_versions_switch_whole(spark, tmp_path):
    path = str(tmp_path)
    assert versions.latest(spark, path) == (0, None)
    versions.publish(spark, path, 1, {"a": "ä"})
    with pytest.raises(versions.VersionTaken):
        versions.publish(spark, path, 1, {"a": 2})
    # A writer that died while it published: its number is taken, the version before it stays.
    (tmp_path / versions.FOLDER / "0000000002").write_text('{"a"')
    assert versions.latest(spark, path) == (2, {"a": "ä"})


# --- parts -------------------------------------------------------------------------


def test_only_changed_files_are_read(spark, tmp_path):
    source, path, read = tmp_path / "in", str(tmp_path / "kept"), []

    def put(name, values):
        out = tmp_path / f"new-{name}-{len(read)}"
        spark.createDataFrame([(v,) for v in values], "v INT").coalesce(1).write.parquet(str(out))
        source.mkdir(exist_ok=True)
        [made] = out.glob("part-*.parquet")
        os.replace(made, source / f"{name}.parquet")

    def build(rows):
        read.append(sorted(r.v for r in rows.select("v").collect()))
        return rows.withColumn("twice", 2 * F.col("v"))

    def refresh():
        rows = parts.refresh_parts(spark, path, str(source), build)
        return sorted((r.v, r.twice, r._generation) for r in rows.collect())

    put("a b", [1, 2])
    put("c", [3])
    put("d", [4])
    assert refresh() == [(1, 2, 1), (2, 4, 1), (3, 6, 1), (4, 8, 1)]
    assert refresh() == [(1, 2, 1), (2, 4, 1), (3, 6, 1), (4, 8, 1)] and len(read) == 1
    put("c", [30, 31])
    assert refresh() == [(1, 2, 1), (2, 4, 1), (4, 8, 1), (30, 60, 2), (31, 62, 2)] and read[1] == [30, 31]
    (source / "d.parquet").unlink()
    assert refresh() == [(1, 2, 1), (2, 4, 1), (30, 60, 2), (31, 62, 2)] and len(read) == 2
    put("a b", [7])
    put("c", [])
    assert refresh() == [(7, 14, 4)] and read[2] == [7]
    assert list(versions.latest(spark, path)[1]["rows"]) == ["4"]


def test_a_refresh_that_dies_leaves_the_old_version(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "kept")
    spark.range(3).write.parquet(source)
    parts.refresh_parts(spark, path, source, lambda rows: rows)
    spark.range(3, 5).write.mode("append").parquet(source)

    def dies(rows):
        raise RuntimeError("dies")

    with pytest.raises(RuntimeError):
        parts.refresh_parts(spark, path, source, dies)
    assert parts.read_parts(spark, path).count() == 3
    assert parts.refresh_parts(spark, path, source, lambda rows: rows).count() == 5


def test_many_changed_files_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parts, "NAMED_FILES", 1)
    source, path = str(tmp_path / "in"), str(tmp_path / "kept")
    spark.range(0, 4, numPartitions=2).write.parquet(source)
    parts.refresh_parts(spark, path, source, lambda rows: rows)
    spark.range(4, 10, numPartitions=3).write.mode("append").parquet(source)
    rows = parts.refresh_parts(spark, path, source, lambda rows: rows)
    assert sorted((r.id, r._generation) for r in rows.collect()) == [(i, 1 + (i > 3)) for i in range(10)]


# --- streams -----------------------------------------------------------------------


@pytest.mark.parametrize("dies_at", [0, 1, 2])
def test_restarted_stream_loses_and_doubles_nothing(spark, tmp_path, dies_at):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(30, numPartitions=3).write.parquet(source)
    double = lambda rows: rows.select("id", (2 * F.col("id")).alias("twice"))
    seen = []

    def dies(batch):
        seen.append(batch)
        if batch == dies_at:
            raise RuntimeError("dies")

    def job(written=None):
        score_batches(file_stream(spark, source, spark.range(1).schema, 1), double, out, state, written).awaitTermination()

    with pytest.raises(StreamingQueryException):
        job(dies)
    job(seen.append)
    assert seen.count(dies_at) == 2
    assert sorted((r.id, r.twice) for r in read_batches(spark, out).collect()) == [(i, 2 * i) for i in range(30)]
    job()
    assert read_batches(spark, out).count() == 30


# --- leases ------------------------------------------------------------------------


def test_leases_leave_nothing(spark):
    with session.lease(spark) as folder:
        for name in ("resolve_labels_delta", "snapshot_refresh", "stream_restart", "calibrate"):
            assert entry.queries()[name](spark, SF).count() > 0
        assert os.listdir(folder)
        with session.lease(spark) as inner:
            assert inner.startswith(folder) and session.stored(spark.range(2)).count() == 2
        assert not os.path.exists(inner)
    assert not os.path.exists(folder)
    with pytest.raises(ValueError), session.lease(spark) as folder:
        session.stored(spark.range(2))
        raise ValueError
    assert not os.path.exists(folder)


def test_sweep_takes_only_old_folders_of_leases(spark):
    shared = session.shared_folder(spark)
    own = session.scratch_path(spark, "x").rsplit("/", 2)[1]
    for name, age in (("lease-dead", 10), ("lease-alive", 1), ("other", 10)):
        os.makedirs(f"{shared}/{name}/table", exist_ok=True)
        os.utime(f"{shared}/{name}", (time.time() - 3600 * age,) * 2)
    os.utime(f"{shared}/{own}", (time.time() - 36000,) * 2)
    assert session.sweep(spark, 5) == ["lease-dead"]
    assert {"lease-alive", "other", own} <= set(os.listdir(shared))


# --- the gate before training --------------------------------------------------------


@pytest.mark.parametrize("rows", [99, 100])
def test_training_needs_a_hundred_cleaned_rows(spark, rows):
    raw = [("C" * (i + 1), i % 2, "s", i) for i in range(rows)] + [("C", 0, "t", 500), ("C(", 1, "s", 501), ("CC", None, "s", 502)]
    table = spark.createDataFrame(raw, VOTES)
    if rows < 100:
        with pytest.raises(TooFewRows):
            training.training_table(table)
    else:
        assert training.training_table(table).count() == 100


# --- skip sampling -----------------------------------------------------------------


def test_draws_do_not_depend_on_partitions_and_are_fair(spark):
    draw = lambda df: outliers.tree_samples(df, "id", 300, 16, 3, 4000)
    a = plain(draw(spark.range(4000)))
    assert a == plain(draw(spark.range(4000).repartition(9)))
    counts = draw(spark.range(4000)).groupBy((F.col("_id") % 10).alias("d")).count().collect()
    # 4,800 draws fall evenly on ten tenths of the rows: 480 each, standard deviation about 21.
    assert all(abs(r["count"] - 480) < 110 for r in counts)
