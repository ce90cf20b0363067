import pytest
from pyspark.sql import functions as F

from screenloom import constants as K
from screenloom.functions import tiers
from screenloom.functions.keys import notation_key
from screenloom.operators import scoring, summaries
from screenloom.streaming.scoring import file_stream, score_stream

PROPS = "MolWt DOUBLE, LogP DOUBLE, HBD INT, HBA INT, TPSA DOUBLE, RotatableBonds INT, heavy INT"
FINE = (250.0, 2.0, 1, 3, 60.0, 3, 15)


def alerts_of(spark, **change):
    row = dict(zip([c.split()[0] for c in PROPS.split(", ")], FINE)) | change
    df = spark.createDataFrame([tuple(row.values())], PROPS)
    cols = [F.col(c) for c in ("MolWt", "LogP", "HBD", "HBA", "TPSA", "RotatableBonds")]
    return df.select(tiers.rule_alerts(*cols)).first()[0]


def test_rule_edges(spark):
    assert alerts_of(spark) == []
    assert alerts_of(spark, LogP=3.0) == [] and len(alerts_of(spark, LogP=3.01)) == 1
    assert alerts_of(spark, TPSA=140.0) == [] and alerts_of(spark, TPSA=20.0) == []
    assert alerts_of(spark, TPSA=140.5) == [K.ALERT_HIGH_TPSA]
    assert alerts_of(spark, TPSA=19.9) == [K.ALERT_LOW_TPSA]
    assert alerts_of(spark, RotatableBonds=10) == [] and len(alerts_of(spark, RotatableBonds=11)) == 1
    assert alerts_of(spark, MolWt=500.1) == []
    two = alerts_of(spark, MolWt=500.1, HBD=6)
    assert two == ["Lipinski Rule of 5: 2 violations (Potential poor oral bioavailability)"]
    assert alerts_of(spark, MolWt=501.0, LogP=5.5)[1] == K.ALERT_HIGH_LOGP


def test_range_warnings(spark):
    df = spark.createDataFrame([(16.04, 1), (100.0, 7), (900.5, 60), (None, None)], "w DOUBLE, h INT")
    rows = [r[0] for r in df.select(tiers.range_check(F.col("w"), F.col("h"))).collect()]
    assert rows[0].ood_mw and len(rows[0].warnings) == 2
    assert rows[0].warnings[0].startswith("Molecular weight (16.0 Da) is below typical drug range (100.0–900.0 Da)")
    assert rows[0].warnings[1] == "Very small molecule (1 heavy atoms). Prediction confidence may be low."
    assert not rows[1].ood_mw and rows[1].warnings == []
    assert rows[2].ood_mw and "above" in rows[2].warnings[0]
    assert not rows[3].ood_mw and rows[3].warnings == [K.MSG_UNPARSED]


def test_tiers(spark):
    df = spark.createDataFrame([(0.7,), (0.4,), (0.39,), (0.5,), (0.81,), (0.66,), (None,)], "p DOUBLE")
    t = F.lit(0.5)
    rows = df.select(tiers.decision(F.col("p"), t), tiers.risk_level(F.col("p")), tiers.confidence(F.col("p"), t)).collect()
    assert tuple(rows[0]) == ("Toxic", "High Risk", "Moderate")
    assert tuple(rows[1]) == ("Non-Toxic", "Moderate Risk", "Low")
    assert rows[2][1] == "Low Risk" and rows[3][0] == "Toxic" and rows[4][2] == "High"
    assert tuple(rows[6]) == (None, None, None)


@pytest.fixture(scope="module")
def batch(spark):
    rows = [
        (0, "CCO", "first", *FINE, False, 0.2),
        (1, "c1ccccc1", "second", *FINE, True, 0.9),
        (2, "INVALID", "third", *[None] * 7, None, None),
        (3, "CC(=O)O", "fourth", *FINE, False, None),
        (4, "", "fifth", *[None] * 7, None, None),
    ]
    schema = f"row_id INT, input_smiles STRING, name STRING, {PROPS}, outlier BOOLEAN, score DOUBLE"
    return spark.createDataFrame(rows, schema).withColumn("canonical_smiles", notation_key(F.col("input_smiles")))


COLUMNS = scoring.ScoringColumns(outlier="outlier")


def test_batch_rows(spark, batch):
    out = scoring.score_batch(batch, COLUMNS, 0.25, carry=["row_id", "name"])
    assert out.columns[:10] == K.BATCH_COLUMNS
    rows = {r.name: r for r in out.collect()}
    assert rows["first"].prediction == "Non-Toxic" and rows["first"].confidence == "Low"
    assert rows["first"].warnings == K.MSG_BOUNDARY and rows["first"].ad_status == "In-Domain"
    assert rows["second"].ad_status == "Out-of-Domain" and K.MSG_DOMAIN in rows["second"].warnings
    assert rows["third"].warnings == K.MSG_INVALID and rows["third"].alerts == 0 and not rows["third"].is_valid
    assert rows["fourth"].warnings == K.MSG_FEATURES and rows["fourth"].ad_status == "Unknown"
    # Sorting by risk keeps every name with its key; unscored rows come last.
    ranked = scoring.by_risk(out, "row_id").collect()
    assert [r.name for r in ranked] == ["second", "first", "third", "fourth", "fifth"]
    assert all(dict(zip([r.name for r in batch.collect()], [r.input_smiles for r in batch.collect()]))[r.name] == r.input_smiles for r in ranked)
    summary = summaries.batch_summary(out).first()
    assert tuple(summary) == (5, 3, 1, 1, 1)


def test_record_fields(batch):
    rows = scoring.prediction_record(batch, COLUMNS).orderBy("input_smiles").collect()
    assert set(rows[0].asDict()) == {
        "input_smiles", "is_valid", "smiles_canonical", "prediction", "probability", "confidence",
        "risk_level", "threshold", "warnings", "ood_check", "ad_status", "chem_insights",
    }
    ok = [r for r in rows if r.input_smiles == "CCO"][0]
    assert ok.chem_insights.summary == "Medicinal chemistry profile looks standard."
    assert ok.chem_insights.properties["Molecular Weight"] == 250.0 and ok.ood_check.mw_value == 250.0


def test_calibrated_score_is_preferred(batch):
    both = batch.withColumn("calibrated", F.when(F.col("row_id") == 0, 0.95))
    cols = scoring.ScoringColumns(calibrated="calibrated")
    rows = {r.input_smiles: r.probability for r in scoring.score_batch(both, cols).collect()}
    assert rows["CCO"] == 0.95 and rows["c1ccccc1"] == 0.9


def test_compare(spark, batch):
    out = scoring.score_batch(batch, COLUMNS, carry=["row_id"])
    pairs = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 0, 0), (4, 0, 2)], "pair_id INT, a_id INT, b_id INT")
    rows = {r.pair_id: r for r in scoring.compare_pairs(pairs, out, "row_id").collect()}
    assert [rows[i].winner for i in (1, 2, 3, 4)] == ["A", "B", None, None]
    assert [rows[i].comparable for i in (1, 4)] == [True, False]
    props = scoring.compare_properties(pairs, batch, "row_id", ["MolWt", "LogP"])
    assert props.count() == 8


def test_stream_equals_batch(spark, batch, tmp_path):
    folder = str(tmp_path / "in")
    batch.repartition(3).write.parquet(folder)
    transform = lambda df: scoring.score_batch(df, COLUMNS, carry=["row_id"])
    stream = file_stream(spark, folder, batch.schema, per_trigger=1)
    score_stream(stream, transform, str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, transform(batch).collect()))
