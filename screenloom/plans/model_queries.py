"""Queries on training, comparison, calibration, outliers and attributions.

All fits have the settings of the constants, over the whole table: 300 boosted trees of
depth 6, 200 forest trees of depth 10, 1000 iterations, SEARCH_DRAWS settings on CV_FOLDS folds.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom import constants as K
from screenloom.functions.keys import notation_key
from screenloom.operators import attribution, features, models, outliers, scoring, summaries
from screenloom.operators.splitting import stratified_folds, stratified_split
from screenloom.plans import training
from screenloom.plans import inputs as I
from screenloom.plans.registry import query
from screenloom.plans.split_queries import SQL_SPLIT_OF
from screenloom.session import scratch_path, stored
from screenloom.sources import delimited
from screenloom.sources.tables import read_table

_SQL_SPLIT = f"""WITH base AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label >= 5 AS INTEGER) AS label FROM embeddings),
{SQL_SPLIT_OF} SELECT CAST(id AS BIGINT) AS row_id, label, split, true AS recomputed FROM split WHERE split <> 'train'"""


#: Rows of a file that the fits read, at least.
FIT_ROWS = 2_500


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as labelled feature rows."""
    return read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") >= 5).cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def _split_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    """Split and weighted rows (stored once), and the models for them.

    Fits read the stored files, each by its own tasks, so rows are dealt before they are stored.
    """
    rows = _rows(spark, sf)
    tasks = features.fit_tasks(spark, rows.count(), FIT_ROWS)
    rows = rows.repartition(tasks, "row_id").withColumn("features", array_to_vector("x")).drop("x")
    rows = stored(rows, "rows").coalesce(tasks)
    split = stratified_split(rows, "row_id")
    weighted, n = models.with_weights(split, counted=split.filter("split = 'train'"))
    return weighted, models.build_models(n)


def _from_leaves(model, rows: DataFrame, classes: bool) -> DataFrame:
    """(row_id, total): the base value and all attributions of a row, from the exported nodes."""
    leaves = attribution.leaf_paths(attribution.read_nodes(rows.sparkSession, model), classes=classes)
    sums = attribution.attributions(rows, leaves).groupBy("row_id").agg(F.sum("shap").alias("sum"))
    total = F.lit(attribution.base_value(leaves)) + F.coalesce("sum", F.lit(0.0))
    return rows.select("row_id").join(sums, "row_id", "left").select("row_id", total.alias("total"))


def _score_test(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Rows outside the training split, and whether their score follows from the exported model."""
    rows, candidates = _split_rows(spark, sf)
    model = candidates[name].fit(rows.filter("split = 'train'"))
    tested = rows.filter("split <> 'train'")
    scored = models.add_score(model, tested).select("row_id", "label", "split", "score", vector_to_array("features").alias("x"))
    if name == models.LOGISTIC:
        weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
        dot = F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(float(model.intercept)), lambda s, t: s + t)
        scored, own = scored.withColumn("total", dot), 1 / (1 + F.exp(-F.col("total")))
    else:
        scored = scored.join(_from_leaves(model, tested, name == models.FOREST), "row_id")
        own = F.col("total") if name == models.FOREST else 1 / (1 + F.exp(-F.col("total")))
    return scored.select("row_id", "label", "split", (F.abs(F.col("score") - own) < 1e-9).alias("recomputed"))


@query("train_score", _SQL_SPLIT)
def train_score(spark: SparkSession, sf: str) -> DataFrame:
    return _score_test(spark, sf, models.BOOSTED)


@query("train_score_lr", _SQL_SPLIT)
def train_score_lr(spark: SparkSession, sf: str) -> DataFrame:
    return _score_test(spark, sf, models.LOGISTIC)


@query("train_score_rf", _SQL_SPLIT)
def train_score_rf(spark: SparkSession, sf: str) -> DataFrame:
    return _score_test(spark, sf, models.FOREST)


@query("cv_compare")
def cv_compare(spark: SparkSession, sf: str) -> DataFrame:
    rows, candidates = _split_rows(spark, sf)
    train = stratified_folds(rows.filter("split = 'train'"), id_col="row_id")
    return summaries.cv_summary(models.cross_validate(train, candidates))


@query("tune_search")
def tune_search(spark: SparkSession, sf: str) -> DataFrame:
    """All drawn settings on all folds."""
    rows, _ = _split_rows(spark, sf)
    train = stratified_folds(rows.filter("split = 'train'"), id_col="row_id")
    return models.search(train, models.draw_parameters())


@query(
    "calibrate",
    f"""WITH {I.SQL_HIST},
    summed AS (SELECT score, row_number() OVER o AS k, n_pos, n_neg + n_pos AS n, sum(n_pos) OVER o AS cp, sum(n_pos + n_neg) OVER o AS cn
               FROM hist WINDOW o AS (ORDER BY score)),
    -- Value of a score: the greatest, over starts a at or before it, of the least mean a .. b over ends b at or after it.
    means AS (SELECT a.k AS a, b.k AS i, (b.cp - a.cp + a.n_pos)::DOUBLE / (b.cn - a.cn + a.n) AS mean
              FROM summed a JOIN summed b ON b.k >= a.k),
    lows AS (SELECT i, min(mean) OVER (PARTITION BY a ORDER BY i DESC) AS low FROM means),
    fitted AS (SELECT i, max(low) AS value FROM lows GROUP BY i)
    SELECT score, round(value, 9) AS calibrated FROM fitted JOIN summed ON k = i""",
)
def calibrate(spark: SparkSession, sf: str) -> DataFrame:
    """The isotonic map fitted on every distinct event score, at each of them."""
    rows = I.scored_events(spark, sf)
    each = rows.select("score").distinct()
    return models.add_calibrated(models.calibrate(rows), each).select("score", F.round("calibrated", 9).alias("calibrated"))


@query(
    "anomaly_fit",
    f"""SELECT CAST(i AS INTEGER) AS tree_id, CAST(least({K.FOREST_SAMPLE}, (SELECT count(*) FROM embeddings)) AS INTEGER) AS n_rows,
    true AS whole FROM range({K.FOREST_TREES}) r(i)""",
)
def anomaly_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Every tree: its sample, and whether its leaves share the sample out and its nodes make a tree."""
    forest = outliers.OutlierForest.fit(_rows(spark, sf), "x", "row_id")
    path = scratch_path(spark, "forest")
    forest.save(spark, path)
    leaf = F.col("feature") < 0
    n = F.max("n_rows")
    whole = (F.sum(F.when(leaf, F.col("n_rows"))) == n) & (F.count("*") == 2 * F.count_if(leaf) - 1)
    deep = F.max("depth") <= F.ceil(F.log2(n))
    return spark.read.parquet(path).groupBy("tree_id").agg(n.alias("n_rows"), (whole & deep).alias("whole"))


@query("anomaly_score", "SELECT vec_id AS row_id, true AS consistent, true AS share_right FROM embeddings")
def anomaly_score(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each status is the sign of its score, and the rows out of domain are the share asked for."""
    rows = _rows(spark, sf)
    forest = outliers.OutlierForest.fit(rows, "x", "row_id")
    scored = stored(forest.apply(rows, "x").select("row_id", "domain_score", "domain_status"), "domain")
    out, n = scored.agg(F.count_if(F.col("domain_status") == -1), F.count("*")).first()
    more = outliers.domain_columns(F.col("domain_status"))
    sign = F.when(F.col("domain_score") < 0, -1).otherwise(1) == F.col("domain_status")
    same = sign & (more["is_ood"] == (F.col("domain_score") < 0))
    right = abs(out - K.FOREST_CONTAMINATION * n) <= 1 + 0.01 * n
    return scored.select("row_id", same.alias("consistent"), F.lit(right).alias("share_right"))


@query("attributions")
def attributions(spark: SparkSession, sf: str) -> DataFrame:
    rows, candidates = _split_rows(spark, sf)
    model = candidates[models.BOOSTED].fit(rows.filter("split = 'train'"))
    leaves = attribution.leaf_paths(attribution.read_nodes(spark, model), classes=False)
    return attribution.attributions(rows, leaves)


# Additivity: base value plus all attributions of a row is the model's raw margin.
@query("attribution_additive", "SELECT vec_id AS row_id, true AS additive FROM embeddings")
def attribution_additive(spark: SparkSession, sf: str) -> DataFrame:
    rows, candidates = _split_rows(spark, sf)
    model = candidates[models.BOOSTED].fit(rows.filter("split = 'train'"))
    margin = model.transform(rows).select(
        "row_id", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("margin")
    )
    gap = F.col("margin") - F.col("total")
    return margin.join(_from_leaves(model, rows, False), "row_id").select("row_id", (F.abs(gap) < 1e-9).alias("additive"))


@query("attribution_forest", "SELECT vec_id AS row_id, true AS additive FROM embeddings")
def attribution_forest(spark: SparkSession, sf: str) -> DataFrame:
    """The same of a random forest, whose attributions add up to its probability."""
    rows, candidates = _split_rows(spark, sf)
    model = candidates[models.FOREST].fit(rows.filter("split = 'train'"))
    scored = models.add_score(model, rows).select("row_id", "score")
    gap = F.col("score") - F.col("total")
    return scored.join(_from_leaves(model, rows, True), "row_id").select("row_id", (F.abs(gap) < 1e-9).alias("additive"))


_SQL_ATTR = """
attr AS (
  SELECT vec_id AS row_id, CAST(i - 1 AS INTEGER) AS feature_index, CAST(embedding[i] AS DOUBLE) AS value,
         CAST(embedding[i] AS DOUBLE) * ((i - 1) % 7 - 3) AS shap
  FROM embeddings, range(1, 65) r(i)
)
"""


def _linear_attributions(spark: SparkSession, sf: str) -> DataFrame:
    """Attributions of a linear score: value times weight."""
    long = _rows(spark, sf).select("row_id", F.posexplode("x").alias("feature_index", "value"))
    return long.withColumn("shap", F.col("value") * (F.col("feature_index") % 7 - 3)).filter("shap <> 0")


@query(
    "global_importance",
    f"""WITH {_SQL_ATTR} SELECT feature_index, round(avg(abs(shap)), 9) AS mean_abs_shap FROM attr
        WHERE shap <> 0 GROUP BY feature_index ORDER BY mean_abs_shap DESC, feature_index LIMIT 20""",
)
def global_importance(spark: SparkSession, sf: str) -> DataFrame:
    n = read_table(spark, sf, "embeddings").count()
    top = attribution.global_importance(_linear_attributions(spark, sf), n, top=K.GLOBAL_TOP)
    return top.withColumn("mean_abs_shap", F.round("mean_abs_shap", 9))


@query(
    "local_top_features",
    f"""WITH {_SQL_ATTR}
    SELECT row_id, 'f' || feature_index AS feature, feature_index, value, shap, rank,
           CASE WHEN shap > 0 THEN 'toxic' ELSE 'non-toxic' END AS direction
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY abs(shap) DESC, feature_index) AS INTEGER) AS rank
          FROM attr WHERE shap <> 0) WHERE rank <= 15""",
)
def local_top_features(spark: SparkSession, sf: str) -> DataFrame:
    top = attribution.local_top(_linear_attributions(spark, sf))
    return attribution.name_features(top, [f"f{i}" for i in range(64)]).select(
        "row_id", "feature", "feature_index", "value", "shap", "rank", "direction"
    )


@query("screen_end_to_end")
def screen_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Documents: shingle bits and lengths, the whole training job with tuning, metrics on the test rows."""
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = (
        features.dealt(read_table(spark, sf, "documents").join(labels, "doc_id"), "doc_id")
        .select(
            F.col("doc_id").alias("row_id"),
            "label",
            F.log1p(F.col("n_chars")).alias("log_chars"),
            F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
            features.shingle_bits(F.col("text")).alias("bits"),
        )
    )
    result = training.train(
        stored(docs, "docs"),
        descriptors=["log_chars", "n_lines"],
        draws=models.draw_parameters(),
    )
    return training.evaluate(result)


_DESCRIPTORS = ["MolWt", "LogP", "HBD", "HBA", "TPSA", "RotatableBonds"]


@query(
    "model_roundtrip",
    f"""WITH {I.SQL_DESCRIBED}
    SELECT row_id, name, canonical_smiles IS NOT NULL AS is_valid, canonical_smiles IS NOT NULL AS scored, true AS same FROM screened""",
)
def model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Orders: the training job, its model saved and loaded, a CSV scored into a CSV by the loaded one.

    ``same``: the loaded model gives the row of the file all that the fitted model gives the row of the table.
    """
    given = I.screened_orders(spark, sf)
    labelled = given.withColumn("label", F.col("nitro").cast("int")).select("row_id", "label", *_DESCRIPTORS)
    model = training.train(labelled, "descriptors", _DESCRIPTORS, compare=False).model
    path, source, target = (scratch_path(spark, kind) for kind in ("model", "file-in", "file-out"))
    model.save(spark, path)
    delimited.write_delimited(given.select("row_id", F.col("input_smiles").alias("SMILES"), "name", *_DESCRIPTORS, "heavy"), source)

    def describe(rows: DataFrame) -> DataFrame:
        numbers = {c: F.col(c).cast("double") for c in [*_DESCRIPTORS, "heavy"]}
        return rows.withColumns({**numbers, "canonical_smiles": notation_key(F.col("input_smiles"))})

    loaded = training.ScreenModel.load(spark, path)
    training.score_file(spark, loaded, describe, source, target, key="smiles")
    names = ["row_id", "name", "is_valid", "prediction", "probability", "risk_level", "ad_status"]
    kinds = ["BIGINT", "STRING", "BOOLEAN", "STRING", "DOUBLE", "STRING", "STRING"]
    schema = ", ".join(map(" ".join, zip(names, kinds, strict=True)))
    back = delimited.read_delimited(spark, target, schema, null_tokens=False)
    columns = scoring.ScoringColumns(score="_score", calibrated="_calibrated", outlier="_outlier")
    kept = given.select("row_id", "input_smiles", "canonical_smiles", *_DESCRIPTORS, "heavy")
    own = scoring.score_batch(model.score_rows(kept), columns, model.threshold, carry=["row_id"])
    own = own.select("row_id", F.struct(*names[2:]).alias("own"))
    both = back.select("row_id", "name", "is_valid", "probability", F.struct(*names[2:]).alias("read")).join(own, "row_id")
    return both.select(
        "row_id", "name", "is_valid", F.col("probability").isNotNull().alias("scored"), F.col("read").eqNullSafe(F.col("own")).alias("same")
    )
