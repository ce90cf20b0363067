import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "resolve_labels",
    "clean_chain",
    "stratified_split",
    "evaluate_all",
    "score_batch",
    "shingle_fp",
    "combined_features",
    "motif_alerts",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_flagship(spark):
    df = entry.entry(spark)
    assert "label" in df.columns and df.count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_same_rows_as_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    got = table(df.columns, df.collect())
    result = db.execute(entry.oracle_sql()[name])
    assert got == table([d[0] for d in result.description], result.fetchall())
