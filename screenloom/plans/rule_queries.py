"""Queries on rules, tiers, batch scoring, comparison and stream scoring."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.functions import tiers
from screenloom.operators import merging, scoring, summaries
from screenloom.plans import inputs as I
from screenloom.plans.registry import query
from screenloom.session import scratch_path
from screenloom.sources import delimited
from screenloom.sources.tables import read_table
from screenloom.streaming.scoring import file_stream, read_batches, score_batches, score_stream

_COLUMNS = scoring.ScoringColumns(
    nitro="nitro", ring_amine="ring_amine", outlier="outlier", calibrated="calibrated"
)
_THRESHOLD = 0.35
_PROPERTIES = ("MolWt", "LogP", "HBD", "HBA", "TPSA", "RotatableBonds")

_SQL_ALERTS = """
  list_filter([
    CASE WHEN violations > 1 THEN 'Lipinski Rule of 5: ' || violations || ' violations (Potential poor oral bioavailability)' END,
    CASE WHEN "LogP" > 3 THEN 'High Lipophilicity: LogP > 3 (Commonly associated with metabolic instability and off-target toxicity)' END,
    CASE WHEN "TPSA" > 140 THEN 'High TPSA: > 140 Å² (Likely poor membrane permeability)'
         WHEN "TPSA" < 20 THEN 'Low TPSA: < 20 Å² (May correlate with high blood-brain barrier penetration or non-specific binding)' END,
    CASE WHEN "RotatableBonds" > 10 THEN 'High Flexibility: > 10 rotatable bonds (Veber''s Rule: may impact oral bioavailability)' END,
    CASE WHEN nitro THEN 'Structural Alert: Nitro group detected (Potential mutagenicity/toxicity risk)' END,
    CASE WHEN ring_amine THEN 'Structural Alert: Primary aromatic amine detected (Potential metabolic activation to reactive intermediates)' END
  ], lambda x: x IS NOT NULL)
"""

_SQL_RANGE = """
  list_filter([
    CASE WHEN "MolWt" < 100 THEN printf('Molecular weight (%.1f Da) is below typical drug range (100.0–900.0 Da). Prediction may be less reliable.', "MolWt")
         WHEN "MolWt" > 900 THEN printf('Molecular weight (%.1f Da) is above typical drug range (100.0–900.0 Da). Prediction may be less reliable.', "MolWt") END,
    CASE WHEN heavy < 5 THEN 'Very small molecule (' || heavy || ' heavy atoms). Prediction confidence may be low.' END
  ], lambda x: x IS NOT NULL)
"""

_SQL_RULES = (
    "WITH "
    + I.SQL_DESCRIBED
    + f""",
counted AS (
  SELECT *, CAST(("MolWt" > 500)::INT + ("LogP" > 5)::INT + ("HBD" > 5)::INT + ("HBA" > 10)::INT AS INTEGER) AS violations
  FROM screened
),
ruled AS (SELECT *, {_SQL_ALERTS} AS alert_list, {_SQL_RANGE} AS range_list FROM counted),
judged AS (
  SELECT *, CASE WHEN canonical_smiles IS NOT NULL THEN coalesce(calibrated, score) END AS prob FROM ruled
),
tiered AS (
  SELECT *,
    canonical_smiles IS NOT NULL AS is_valid,
    CASE WHEN prob >= {_THRESHOLD}::DOUBLE THEN 'Toxic' WHEN prob IS NOT NULL THEN 'Non-Toxic' END AS prediction,
    round(prob, 4) AS probability,
    CASE WHEN prob >= 0.7::DOUBLE THEN 'High Risk' WHEN prob >= 0.4::DOUBLE THEN 'Moderate Risk'
         WHEN prob IS NOT NULL THEN 'Low Risk' END AS risk_level,
    CASE WHEN abs(prob - {_THRESHOLD}::DOUBLE) > 0.3::DOUBLE THEN 'High'
         WHEN abs(prob - {_THRESHOLD}::DOUBLE) > 0.15::DOUBLE THEN 'Moderate'
         WHEN prob IS NOT NULL THEN 'Low' END AS confidence,
    CASE WHEN canonical_smiles IS NULL THEN 'Unknown' WHEN outlier THEN 'Out-of-Domain' ELSE 'In-Domain' END AS ad_status
  FROM judged
),
results AS (
  SELECT row_id, name, input_smiles, canonical_smiles, is_valid, prediction, probability, risk_level, confidence, ad_status,
    CAST(CASE WHEN is_valid THEN len(alert_list) ELSE 0 END AS INTEGER) AS alerts,
    CASE WHEN NOT is_valid THEN 'Invalid SMILES string. Cannot make prediction.'
         ELSE array_to_string(list_concat(list_concat(range_list, alert_list), list_filter([
           CASE WHEN ad_status = 'Out-of-Domain' THEN 'Structure is distant from the training distribution. Prediction confidence may be lower.' END,
           CASE WHEN confidence = 'Low' THEN 'Prediction is near the decision boundary. Experimental validation is recommended.' END
         ], lambda x: x IS NOT NULL)), '; ') END AS warnings
  FROM tiered
)
"""
)


def _props(df: DataFrame):
    return [F.col(c) for c in _PROPERTIES]


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_batch(
        I.screened_orders(spark, sf), _COLUMNS, _THRESHOLD, carry=["row_id", "name"]
    )


@query(
    "property_panel",
    f"""WITH {I.SQL_DESCRIBED} SELECT row_id, round("MolWt", 2) AS weight, round("LogP", 2) AS logp, "HBD" AS hbd,
        "HBA" AS hba, round("TPSA", 2) AS tpsa, "RotatableBonds" AS rotatable FROM described""",
)
def property_panel(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.described_orders(spark, sf)
    panel = rows.select("row_id", tiers.property_panel(*_props(rows)).alias("p"))
    return panel.select("row_id", "p.*").toDF("row_id", "weight", "logp", "hbd", "hba", "tpsa", "rotatable")


@query("rule_violations", _SQL_RULES + "SELECT row_id, violations FROM counted")
def rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.described_orders(spark, sf)
    return rows.select("row_id", tiers.violation_count(*_props(rows)[:4]).alias("violations"))


@query(
    "rule_alerts",
    _SQL_RULES
    + """SELECT row_id, CAST(len(alert_list) AS INTEGER) AS n_alerts, array_to_string(alert_list, ' | ') AS alerts,
         CASE WHEN len(alert_list) = 0 THEN 'Medicinal chemistry profile looks standard.'
              ELSE 'Detected ' || len(alert_list) || ' medicinal chemistry alerts.' END AS summary FROM ruled""",
)
def rule_alerts(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.described_orders(spark, sf)
    alerts = tiers.rule_alerts(*_props(rows), F.col("nitro"), F.col("ring_amine"))
    return rows.select("row_id", alerts.alias("a")).select(
        "row_id",
        F.size("a").alias("n_alerts"),
        F.array_join("a", " | ").alias("alerts"),
        tiers.alert_summary(F.col("a")).alias("summary"),
    )


@query(
    "range_domain",
    _SQL_RULES
    + """SELECT row_id, "MolWt" < 100 OR "MolWt" > 900 AS ood_mw, round("MolWt", 2) AS mw_value,
         array_to_string(range_list, ' | ') AS warnings FROM ruled""",
)
def range_domain(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.described_orders(spark, sf)
    check = rows.select("row_id", tiers.range_check(F.col("MolWt"), F.col("heavy")).alias("c"))
    return check.select(
        "row_id", "c.ood_mw", "c.mw_value", F.array_join("c.warnings", " | ").alias("warnings")
    )


@query("risk_tiers", _SQL_RULES + "SELECT row_id, prediction, probability, risk_level, confidence FROM tiered")
def risk_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("row_id", "prediction", "probability", "risk_level", "confidence")


@query("warnings_text", _SQL_RULES + "SELECT row_id, alerts, warnings FROM results")
def warnings_text(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("row_id", "alerts", "warnings")


@query("score_batch", _SQL_RULES + "SELECT * FROM results")
def score_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf)


@query(
    "prediction_record",
    _SQL_RULES
    + f"""SELECT row_id, r.input_smiles, is_valid, canonical_smiles AS smiles_canonical, prediction, probability, confidence,
          risk_level, {_THRESHOLD}::DOUBLE AS threshold, warnings, ad_status,
          CASE WHEN is_valid THEN t.violations END AS violations,
          CASE WHEN is_valid THEN round(t."MolWt", 2) END AS mw_value
          FROM results r JOIN (SELECT row_id, violations, "MolWt" FROM counted) t USING (row_id)""",
)
def prediction_record(spark: SparkSession, sf: str) -> DataFrame:
    """The nested record, shown with its parts unpacked."""
    record = scoring.prediction_record(
        I.screened_orders(spark, sf), _COLUMNS, _THRESHOLD, carry=["row_id"]
    )
    return record.select(
        "row_id",
        "input_smiles",
        "is_valid",
        "smiles_canonical",
        "prediction",
        "probability",
        "confidence",
        "risk_level",
        "threshold",
        F.array_join("warnings", "; ").alias("warnings"),
        "ad_status",
        F.col("chem_insights.violations").alias("violations"),
        F.col("ood_check.mw_value").alias("mw_value"),
    )


@query("score_passthrough", _SQL_RULES + "SELECT input_smiles, probability, name FROM results")
def score_passthrough(spark: SparkSession, sf: str) -> DataFrame:
    """CSV in, key column found whatever its case, extra columns kept in their rows, CSV out."""
    source, target = scratch_path(spark, "batch-in"), scratch_path(spark, "batch-out")
    rows = I.described_orders(spark, sf).withColumnRenamed("input_smiles", "SMILES")
    wanted = ["row_id", "SMILES", "name"]
    delimited.write_delimited(rows.select(*wanted), source)
    schema = "row_id BIGINT, SMILES STRING, name STRING"
    read = delimited.read_delimited(spark, source, schema, null_tokens=False)
    key = merging.resolve_column(read.columns, "smiles")
    features = I.screened_orders(spark, sf).drop("input_smiles", "name")
    scored = scoring.score_batch(
        read.withColumnRenamed(key, "input_smiles").join(features, "row_id"),
        _COLUMNS,
        _THRESHOLD,
        carry=["name"],
    )
    delimited.write_delimited(scored, target)
    back = delimited.read_delimited(
        spark, target, "input_smiles STRING, probability DOUBLE, name STRING", null_tokens=False
    )
    return back


@query(
    "top_risk",
    _SQL_RULES
    + "SELECT row_id, input_smiles, probability, risk_level FROM results ORDER BY probability DESC NULLS LAST, row_id LIMIT 50",
)
def top_risk(spark: SparkSession, sf: str) -> DataFrame:
    top = scoring.by_risk(_scored(spark, sf), "row_id", 50)
    return top.select("row_id", "input_smiles", "probability", "risk_level")


@query(
    "batch_summary",
    _SQL_RULES
    + """SELECT count(*) AS total, count(*) FILTER (is_valid) AS valid, count(*) FILTER (prediction = 'Toxic') AS toxic,
         count(*) FILTER (prediction = 'Non-Toxic') AS nontoxic, count(*) FILTER (ad_status = 'Out-of-Domain') AS out_of_domain
         FROM results""",
)
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.batch_summary(_scored(spark, sf))


_SQL_PAIRS = """
pairs AS (SELECT o_orderkey AS pair_id, o_orderkey AS a_id, o_custkey AS b_id FROM orders)
"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return read_table(spark, sf, "orders").select(
        key.alias("pair_id"), key.alias("a_id"), F.col("o_custkey").alias("b_id")
    )


@query(
    "compare_pairs",
    _SQL_RULES
    + f""", {_SQL_PAIRS}
    SELECT pair_id, a_id, b_id,
      a.is_valid AS a_is_valid, a.prediction AS a_prediction, a.probability AS a_probability, a.risk_level AS a_risk_level, a.alerts AS a_alerts,
      b.is_valid AS b_is_valid, b.prediction AS b_prediction, b.probability AS b_probability, b.risk_level AS b_risk_level, b.alerts AS b_alerts,
      coalesce(a.is_valid AND b.is_valid, false) AS comparable,
      CASE WHEN a.is_valid AND b.is_valid THEN CASE WHEN a.probability < b.probability THEN 'A'
           WHEN b.probability < a.probability THEN 'B' END END AS winner
    FROM pairs LEFT JOIN results a ON a.row_id = a_id LEFT JOIN results b ON b.row_id = b_id""",
)
def compare_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.compare_pairs(_pairs(spark, sf), _scored(spark, sf), "row_id", ["alerts"])


@query(
    "compare_properties",
    f"""WITH {I.SQL_DESCRIBED}, {_SQL_PAIRS},
    sides AS (
      SELECT pair_id, a."MolWt" AS aw, b."MolWt" AS bw, a."LogP" AS al, b."LogP" AS bl, a."TPSA" AS tpsa_a, b."TPSA" AS tpsa_b
      FROM pairs JOIN described a ON a.row_id = a_id JOIN described b ON b.row_id = b_id
    )
    SELECT pair_id, 'MolWt' AS property, aw AS a_value, bw AS b_value FROM sides
    UNION ALL SELECT pair_id, 'LogP', al, bl FROM sides
    UNION ALL SELECT pair_id, 'TPSA', tpsa_a, tpsa_b FROM sides""",
)
def compare_properties(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.compare_properties(
        _pairs(spark, sf), I.described_orders(spark, sf), "row_id", ["MolWt", "LogP", "TPSA"]
    )


@query("stream_score", _SQL_RULES + "SELECT * FROM results")
def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    """The batch transform over a file stream; the result must equal ``score_batch``."""
    schema = read_table(spark, sf, "orders").schema
    stream = file_stream(spark, f"{sf}/orders.parquet*", schema)
    out = scratch_path(spark, "stream-out")

    def transform(rows: DataFrame) -> DataFrame:
        keyed = I.screen_notation(I.describe(rows))
        return scoring.score_batch(keyed, _COLUMNS, _THRESHOLD, carry=["row_id", "name"])

    score_stream(stream, transform, out).awaitTermination()
    return spark.read.parquet(out)


@query("stream_restart", _SQL_RULES + "SELECT * FROM results")
def stream_restart(spark: SparkSession, sf: str) -> DataFrame:
    """A scoring job that dies after writing its second batch, before that is recorded; a second job goes on."""
    source, out, state = (scratch_path(spark, kind) for kind in ("orders-in", "restart-out", "restart-state"))
    read_table(spark, sf, "orders").repartition(4, "o_custkey").write.parquet(source)
    files = max(1, spark.read.format("binaryFile").load(f"{source}/*.parquet").select("path").count())
    schema = spark.read.parquet(source).schema

    def transform(rows: DataFrame) -> DataFrame:
        keyed = I.screen_notation(I.describe(rows))
        return scoring.score_batch(keyed, _COLUMNS, _THRESHOLD, carry=["row_id", "name"])

    def die(batch: int) -> None:
        if batch == 1:
            raise RuntimeError("the job dies here")

    def job(written=None):
        stream = file_stream(spark, source, schema, per_trigger=-(-files // 3))
        return score_batches(stream, transform, out, state, written)

    try:
        job(die).awaitTermination()
    except StreamingQueryException as error:
        if "the job dies here" not in str(error):
            raise
    job().awaitTermination()
    return read_batches(spark, out).drop("batch")
