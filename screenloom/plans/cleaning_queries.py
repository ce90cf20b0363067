"""Queries on sources, cleaning, voting and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom import constants as K
from screenloom.functions.keys import key_digest, notation_depth, notation_is_valid
from screenloom.operators import cleaning, merging, summaries, vote_state, voting
from screenloom.plans import inputs as I
from screenloom.plans.registry import query
from screenloom.session import scratch_path
from screenloom.sources import delimited, parts, records
from screenloom.sources.tables import read_table


# --- sources and sinks --------------------------------------------------------


@query(
    "scan_csv",
    "SELECT p_partkey, p_name, p_size, p_retailprice, nullif(p_type, 'PROMO') AS p_type FROM part",
)
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "parts-csv")
    kind = F.when(F.col("p_type") == "PROMO", "N/A").otherwise(F.col("p_type"))
    delimited.write_delimited(
        read_table(spark, sf, "part").withColumn("p_type", kind), path, compression="gzip"
    )
    schema = "p_partkey BIGINT, p_name STRING, p_size INT, p_retailprice DOUBLE, p_type STRING"
    return delimited.read_delimited(spark, path, schema)


@query(
    "scan_tsv_text",
    """SELECT conv_id, turn, nullif(trim(role), '') AS role, md5(text) AS text_digest
       FROM conversations""",
)
def scan_tsv_text(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted texts with line breaks, tab separated."""
    path = scratch_path(spark, "conversations-tsv")
    delimited.write_delimited(read_table(spark, sf, "conversations"), path, sep="\t")
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    rows = delimited.read_delimited(spark, path, schema, sep="\t", multiline=True)
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("text_digest"))


@query("json_roundtrip", "SELECT vec_id, label, len(embedding) AS width FROM embeddings")
def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "embeddings-json")
    table = read_table(spark, sf, "embeddings")
    records.write_json(table, path)
    back = records.read_json(spark, path, table.schema)
    return back.select("vec_id", "label", F.size("embedding").cast("bigint").alias("width"))


@query(
    "snapshot_reuse",
    "SELECT c_mktsegment AS source, count(*) AS n_rows FROM customer GROUP BY 1",
)
def snapshot_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """The second call finds the stored table and reads it."""
    path = scratch_path(spark, "customers")
    build = lambda: read_table(spark, sf, "customer")
    need = ["c_custkey", "c_mktsegment"]
    records.snapshot(spark, path, need, build)
    stored = records.snapshot(spark, path, need, build)
    return summaries.source_counts(stored.withColumnRenamed("c_mktsegment", "source"))


@query(
    "snapshot_refresh",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity + 1 ELSE l_quantity END AS BIGINT) AS quantity,
              CAST(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS INTEGER) AS generation FROM lineitem""",
)
def snapshot_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """The files of one return flag are replaced after the first refresh; the second reads only the new ones."""
    source, path = scratch_path(spark, "lines-in"), scratch_path(spark, "lines-kept")
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    build = lambda rows: rows.withColumn("quantity", F.col("l_quantity").cast("bigint"))
    lines.write.partitionBy("l_returnflag").parquet(source)
    parts.refresh_parts(spark, path, source, build)
    more = lines.filter("l_returnflag = 'R'").withColumn("l_quantity", F.col("l_quantity") + 1)
    more.drop("l_returnflag").write.mode("overwrite").parquet(f"{source}/l_returnflag=R")
    rows = parts.refresh_parts(spark, path, source, build)
    return rows.select("l_orderkey", "l_linenumber", "quantity", F.col("_generation").alias("generation"))


@query(
    "standardize_source",
    """SELECT c_name AS smiles, CAST(trunc(c_acctbal / 5000.0::DOUBLE) AS INTEGER) AS label,
              'customers' AS source, c_custkey AS row_id FROM customer""",
)
def standardize_source(spark: SparkSession, sf: str) -> DataFrame:
    raw = read_table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("Drug"), (F.col("c_acctbal") / 5000.0).alias("Y")
    )
    return merging.standardize_source(raw, "customers", key="Drug", label="Y", row_id="c_custkey")


_SQL_UNION = """
SELECT c_name AS smiles, CAST(trunc(c_acctbal / 5000.0::DOUBLE) AS INTEGER) AS label, 'customers' AS source FROM customer
UNION ALL SELECT s_name, CAST(trunc(s_acctbal / 5000.0::DOUBLE) AS INTEGER), 'suppliers' FROM supplier
"""


def _two_sources(spark: SparkSession, sf: str) -> DataFrame:
    customers = read_table(spark, sf, "customer").select(
        F.col("c_name").alias("smiles"), (F.col("c_acctbal") / 5000.0).alias("Y")
    )
    suppliers = read_table(spark, sf, "supplier").select(
        "s_name", (F.col("s_acctbal") / 5000.0).alias("CT_TOX")
    )
    return merging.union_sources(
        [
            merging.standardize_source(customers, "customers", "Drug", "Y"),
            merging.standardize_source(suppliers, "suppliers", "smiles", "CT_TOX"),
            merging.standardize_source(suppliers.limit(0), "nobody", "smiles", "CT_TOX"),
        ]
    )


@query("union_sources", _SQL_UNION)
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    return _two_sources(spark, sf)


# --- validity and filters -----------------------------------------------------


@query(
    "canonicalize",
    f"WITH {I.SQL_LABELLED} SELECT row_id, md5(smiles) AS key_digest, smiles IS NOT NULL AS valid FROM keyed",
)
def canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    tagged = cleaning.tag_valid(I.labelled_documents(spark, sf))
    return tagged.select(
        "row_id", key_digest(F.col(K.KEY)).alias("key_digest"), F.col("_valid").alias("valid")
    )


@query(
    "lexical_screen",
    f"WITH {I.SQL_DESCRIBED} SELECT row_id, input_smiles, canonical_smiles IS NOT NULL AS valid FROM screened",
)
def lexical_screen(spark: SparkSession, sf: str) -> DataFrame:
    return I.described_orders(spark, sf).select(
        "row_id", "input_smiles", notation_is_valid(F.col("input_smiles")).alias("valid")
    )


@query(
    "lexical_depth",
    f"""WITH {I.SQL_DESCRIBED}
    SELECT row_id, CAST(list_reduce(list_prepend(0, list_transform(str_split(input_smiles, ''),
            lambda c: CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)),
            lambda a, b: CASE WHEN a < 0 THEN a ELSE a + b END) AS INTEGER) AS depth
    FROM described""",
)
def lexical_depth(spark: SparkSession, sf: str) -> DataFrame:
    return I.described_orders(spark, sf).select(
        "row_id", notation_depth(F.col("input_smiles")).alias("depth")
    )


@query(
    "drop_invalid",
    f"""WITH {I.SQL_LABELLED} SELECT row_id, source, label FROM keyed
        WHERE smiles IS NOT NULL AND label IS NOT NULL""",
)
def drop_invalid(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.drop_invalid(cleaning.tag_valid(I.labelled_documents(spark, sf)))
    return cleaning.drop_unlabelled(rows).select("row_id", "source", "label")


@query(
    "binary_labels",
    """SELECT o_orderkey, CAST(trunc(o_totalprice / 100000.0::DOUBLE) AS INTEGER) AS label FROM orders
       WHERE trunc(o_totalprice / 100000.0::DOUBLE) IN (0, 1)""",
)
def binary_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 100000.0).alias("label")
    )
    return cleaning.binary_labels(rows)


@query(
    "binary_labels_strict",
    """SELECT l_orderkey, l_linenumber, CAST(l_quantity - 10 AS INTEGER) AS label FROM lineitem
       WHERE l_quantity - 10 IN (0, 1)""",
)
def binary_labels_strict(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") - 10).alias("label")
    )
    return cleaning.binary_labels(rows, strict=True)


# --- duplicates and votes -----------------------------------------------------


@query(
    "duplicate_keys",
    f"""WITH {I.SQL_LABELLED} SELECT md5(smiles) AS key_digest, count(*) AS n_rows FROM keyed
        WHERE smiles IS NOT NULL GROUP BY smiles HAVING count(*) > 1""",
)
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return voting.duplicate_keys(I.digest_documents(spark, sf), "key_digest", hashed=True)


_SQL_LINE_LABELS = """
SELECT CAST(l_partkey AS VARCHAR) AS smiles, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS label,
       l_linestatus AS source FROM lineitem
"""


@query(
    "label_conflicts",
    f"""SELECT md5(smiles) AS key_digest, count(*) AS n_rows, min(label) AS min_label, max(label) AS max_label
        FROM ({_SQL_LINE_LABELS}) GROUP BY smiles HAVING count(DISTINCT label) > 1""",
)
def label_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return voting.label_conflicts(I.labelled_lineitems(spark, sf))


@query(
    "resolve_labels",
    f"WITH {I.SQL_LABELLED} SELECT key_digest, label, source, row_id, lang, n_chars, n_merged FROM resolved",
)
def resolve_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Digests stand for the texts: texts are read once and never shuffled."""
    rows = cleaning.binary_labels(cleaning.drop_unlabelled(I.digest_documents(spark, sf)))
    votes = voting.vote(rows, key="key_digest", hashed=True)
    about = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), "lang", "n_chars"
    )
    return voting.keep_voted(about, votes)


@query(
    "resolve_labels_parts",
    f"""SELECT md5(smiles) AS key_digest, CAST(CASE WHEN 2 * sum(label) >= count(*) THEN 1 ELSE 0 END AS INTEGER) AS label,
               string_agg(DISTINCT source, '+' ORDER BY source) AS source, count(*) AS n_merged
        FROM ({_SQL_LINE_LABELS}) GROUP BY smiles""",
)
def resolve_labels_parts(spark: SparkSession, sf: str) -> DataFrame:
    return voting.vote(I.labelled_lineitems(spark, sf)).select(
        "key_digest",
        F.col("_vote").alias("label"),
        F.col("_sources").alias("source"),
        "n_merged",
    )


@query(
    "resolve_labels_events",
    """SELECT concat_ws(':', CAST(user_id AS VARCHAR), event_type) AS smiles,
              CAST(CASE WHEN 2 * count(*) FILTER (value > 10) >= count(*) THEN 1 ELSE 0 END AS INTEGER) AS label,
              string_agg(DISTINCT json_extract_string(props, '$.k'), '+' ORDER BY json_extract_string(props, '$.k')) AS source,
              min(event_id) AS row_id, count(*) AS n_merged
       FROM events GROUP BY user_id, event_type""",
)
def resolve_labels_events(spark: SparkSession, sf: str) -> DataFrame:
    return voting.resolve_labels(I.labelled_events(spark, sf))


#: Line items come in two deliveries: shipped before this day, and all others.
_DELIVERY = "1995-01-01"


def _fold_lineitems(spark: SparkSession, sf: str) -> str:
    """The state after both deliveries; the second arrives twice and counts once."""
    path = scratch_path(spark, "votes")
    rows = I.labelled_lineitems(spark, sf).withColumn("early", F.coalesce(F.col("l_shipdate") < F.lit(_DELIVERY).cast("date"), F.lit(False)))
    vote_state.fold_delivery(rows.filter("early"), path, "early")
    for _ in range(2):
        vote_state.fold_delivery(rows.filter("NOT early"), path, "late")
    return path


@query(
    "resolve_labels_delta",
    """SELECT md5(CAST(l_partkey AS VARCHAR)) AS key_digest,
              CAST(CASE WHEN 2 * count(*) FILTER (l_returnflag = 'R') >= count(*) THEN 1 ELSE 0 END AS INTEGER) AS label,
              string_agg(DISTINCT l_linestatus, '+' ORDER BY l_linestatus) AS source, min(l_orderkey) AS row_id, count(*) AS n_merged
       FROM lineitem GROUP BY l_partkey""",
)
def resolve_labels_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Votes folded delivery by delivery; they must equal the vote over all rows."""
    return vote_state.kept_votes(spark, _fold_lineitems(spark, sf)).select(
        "key_digest",
        F.col("_vote").alias("label"),
        F.col("_sources").alias("source"),
        F.col("_first").alias("row_id"),
        "n_merged",
    )


@query(
    "changed_labels",
    f"""WITH rows AS (SELECT l_partkey, l_orderkey, l_returnflag = 'R' AS one,
                             coalesce(l_shipdate < DATE '{_DELIVERY}', false) AS early FROM lineitem)
        SELECT md5(CAST(l_partkey AS VARCHAR)) AS key_digest,
               CAST(CASE WHEN 2 * count(*) FILTER (one) >= count(*) THEN 1 ELSE 0 END AS INTEGER) AS label,
               CAST(CASE WHEN count(*) FILTER (early) = 0 THEN NULL
                    WHEN 2 * count(*) FILTER (one AND early) >= count(*) FILTER (early) THEN 1 ELSE 0 END AS INTEGER) AS label_before,
               min(l_orderkey) AS row_id, count(*) AS n_merged
        FROM rows GROUP BY l_partkey HAVING count(*) FILTER (NOT early) > 0""",
)
def changed_labels(spark: SparkSession, sf: str) -> DataFrame:
    """What the last delivery did to the votes of its keys."""
    return vote_state.changed_votes(spark, _fold_lineitems(spark, sf))


@query(
    "clean_chain",
    f"""WITH {I.SQL_LABELLED}, texts AS (SELECT row_id AS rid, smiles AS text_key FROM keyed)
        SELECT text_key AS smiles, label, source, row_id, lang, n_chars, n_merged
        FROM resolved JOIN texts ON rid = row_id""",
)
def clean_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain, keys kept as full texts."""
    return cleaning.clean(I.labelled_documents(spark, sf))


# --- summaries ----------------------------------------------------------------


@query(
    "class_balance",
    f"""WITH {I.SQL_LABELLED}, c AS (
          SELECT count(*) AS total, count(*) FILTER (label = 1) AS toxic, count(*) FILTER (label = 0) AS nontoxic FROM cleaned)
        SELECT total, toxic, nontoxic, toxic / total AS toxic_ratio,
               CASE WHEN least(toxic, nontoxic) > 0 THEN greatest(toxic, nontoxic) / least(toxic, nontoxic)
                    ELSE 'Infinity'::DOUBLE END AS imbalance_ratio,
               CASE WHEN least(toxic, nontoxic) > 0 THEN greatest(toxic, nontoxic) / least(toxic, nontoxic)
                    ELSE 'Infinity'::DOUBLE END > 3 AS imbalanced
        FROM c""",
)
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.class_balance(cleaning.valid_rows(I.labelled_documents(spark, sf)))


@query(
    "dataset_summary",
    f"""WITH {I.SQL_LABELLED}
        SELECT count(*) AS total_compounds, count(*) FILTER (label = 1) AS toxic_count,
               count(*) FILTER (label = 0) AS nontoxic_count, count(*) FILTER (smiles IS NULL) AS missing_smiles,
               count(*) FILTER (label IS NULL) AS missing_labels, count(*) FILTER (label = 1) / count(*) AS toxic_ratio
        FROM labelled""",
)
def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.dataset_summary(I.labelled_documents(spark, sf))


@query(
    "validity_summary",
    f"""WITH {I.SQL_DESCRIBED}
        SELECT count(*) AS n_rows, count(canonical_smiles) AS n_valid, count(*) - count(canonical_smiles) AS n_invalid,
               (count(*) - count(canonical_smiles)) / count(*) AS invalid_share FROM screened""",
)
def validity_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.screened_orders(spark, sf)
    return summaries.validity_summary(rows.withColumn("_valid", F.col("canonical_smiles").isNotNull()))


@query("source_counts", "SELECT source, count(*) AS n_rows FROM documents GROUP BY source")
def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.source_counts(I.labelled_documents(spark, sf))


@query(
    "class_weights",
    f"""WITH {I.SQL_LABELLED}, c AS (
          SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM cleaned)
        SELECT n_pos, n_neg, n_neg / n_pos AS scale_pos_weight, (n_pos + n_neg) / (2 * n_pos) AS balanced_pos,
               (n_pos + n_neg) / (2 * n_neg) AS balanced_neg FROM c""",
)
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.class_weights(cleaning.valid_rows(I.labelled_documents(spark, sf)))


_SQL_FOLDS = """
folds AS (
  SELECT 'model_' || (o_custkey % 3) AS model, o_orderkey % 5 AS fold,
         round(avg(o_totalprice) / 500000.0::DOUBLE, 6) AS roc_auc,
         round(avg(o_orderkey % 97) / 97.0::DOUBLE, 6) AS accuracy,
         round(avg(o_orderkey % 89) / 89.0::DOUBLE, 6) AS f1,
         round(avg(o_orderkey % 83) / 83.0::DOUBLE, 6) AS precision,
         round(avg(o_orderkey % 79) / 79.0::DOUBLE, 6) AS recall,
         round(avg(o_orderkey % 73) / 73.0::DOUBLE, 6) AS train_roc_auc
  FROM orders GROUP BY 1, 2
),
summed AS (
  SELECT model,
    round(avg(roc_auc), 6) AS cv_roc_auc_mean, round(stddev_pop(roc_auc), 6) AS cv_roc_auc_std,
    round(avg(accuracy), 6) AS cv_accuracy_mean, round(stddev_pop(accuracy), 6) AS cv_accuracy_std,
    round(avg(f1), 6) AS cv_f1_mean, round(stddev_pop(f1), 6) AS cv_f1_std,
    round(avg(precision), 6) AS cv_precision_mean, round(stddev_pop(precision), 6) AS cv_precision_std,
    round(avg(recall), 6) AS cv_recall_mean, round(stddev_pop(recall), 6) AS cv_recall_std,
    round(avg(train_roc_auc), 6) AS train_roc_auc_mean
  FROM folds GROUP BY model
)
"""


def _fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    mean = lambda m: F.round(F.avg(key % m) / float(m), 6)
    return (
        read_table(spark, sf, "orders")
        .groupBy(
            F.concat(F.lit("model_"), (F.col("o_custkey") % 3).cast("string")).alias("model"),
            (key % 5).alias("fold"),
        )
        .agg(
            F.round(F.avg("o_totalprice") / 500000.0, 6).alias("roc_auc"),
            mean(97).alias("accuracy"),
            mean(89).alias("f1"),
            mean(83).alias("precision"),
            mean(79).alias("recall"),
            mean(73).alias("train_roc_auc"),
        )
    )


def _rounded_summary(spark: SparkSession, sf: str) -> DataFrame:
    table = summaries.cv_summary(_fold_metrics(spark, sf)).drop("error")
    return table.select("model", *[F.round(c, 6).alias(c) for c in table.columns if c != "model"])


@query("cv_summary", f"WITH {_SQL_FOLDS} SELECT * FROM summed")
def cv_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_summary(spark, sf)


@query(
    "comparison_long",
    f"""WITH {_SQL_FOLDS}
        SELECT model, 'Roc Auc' AS metric, cv_roc_auc_mean AS value FROM summed
        UNION ALL SELECT model, 'F1', cv_f1_mean FROM summed
        UNION ALL SELECT model, 'Precision', cv_precision_mean FROM summed
        UNION ALL SELECT model, 'Recall', cv_recall_mean FROM summed""",
)
def comparison_long(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.comparison_long(_rounded_summary(spark, sf))
