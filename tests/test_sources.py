import gzip

import pytest
from pyspark.sql import functions as F

from screenloom.session import scratch_path, stored
from screenloom.sources import delimited, records


def test_csv_missing_cells_and_types(spark, tmp_path):
    path = tmp_path / "batch.csv"
    path.write_text('name,smiles,Y\nA,CC(=O)O,1.0\nB,,0.0\nNA,"x,""y""",nan\n')
    rows = delimited.read_delimited(spark, str(path), "smiles STRING, name STRING, Y DOUBLE").collect()
    assert [r.smiles for r in rows] == ["CC(=O)O", None, 'x,"y"']
    assert [r.name for r in rows] == ["A", "B", None] and rows[2].Y is None
    keep = delimited.read_delimited(spark, str(path), "name STRING", null_tokens=False).collect()
    assert keep[2].name == "NA"
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, str(path), "label INT")


def test_gzip_and_tsv(spark, tmp_path):
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("smiles,CT_TOX\nCCO,0\nCCN,1\n")
    assert delimited.read_delimited(spark, str(tmp_path / "c.csv.gz"), "smiles STRING, CT_TOX INT").count() == 2
    (tmp_path / "d.tab").write_text('Drug_ID\tDrug\tY\n187.0\t"CC(=O)OCC[N+](C)(C)C"\t0.0\n')
    row = delimited.read_delimited(spark, str(tmp_path / "d.tab"), "Drug STRING, Y DOUBLE", sep="\t").first()
    assert row.Drug == "CC(=O)OCC[N+](C)(C)C" and row.Y == 0.0
    assert delimited.read_header(spark, str(tmp_path / "d.tab"), "\t") == ["Drug_ID", "Drug", "Y"]


def test_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None), (3, "line\nbreak")], "id INT, t STRING")
    out = str(tmp_path / "out")
    delimited.write_delimited(df, out)
    back = delimited.read_delimited(spark, out, "id INT, t STRING", multiline=True)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_json_splits_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 2.0], "train"), (2, None, "test")], "id INT, v ARRAY<DOUBLE>, split STRING")
    records.write_json(df, str(tmp_path / "j"))
    assert sorted(map(str, records.read_json(spark, str(tmp_path / "j"), df.schema).collect())) == sorted(map(str, df.collect()))
    records.write_splits(df, str(tmp_path / "s"))
    assert [r.id for r in records.read_split(spark, str(tmp_path / "s"), "test").collect()] == [2]
    built = []

    def build():
        built.append(1)
        return df

    path = str(tmp_path / "snap")
    for need, refresh in ((["id"], False), (["id"], False), (["id", "other"], False), (["id"], True)):
        assert records.snapshot(spark, path, need, build, refresh).count() == 2
    assert len(built) == 3


def test_scratch(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    df = spark.range(10).withColumn("t", F.col("id") * 2)
    assert stored(df).count() == 10
