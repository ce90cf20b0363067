"""A corpus pipeline of five stages over ``documents``; each works on all that the one before kept.

Every stage takes (spark, docs, folder) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from itertools import accumulate

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.llm import bpe_tree, language_id, pfair_mix, pii_boost, simhash
from screenloom.session import stored

#: Posterior probability under which a language counts as not recognised.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised, under that language; without a letter or any confidence they go."""
    taught = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    guess = language_id.predicted(docs, language_id.fit(taught))
    row = docs.select(F.struct("*").alias("row"), guess.alias("guess"))
    kept = (F.col("guess.lang_pred") != language_id.UNKNOWN) & (F.col("guess.score") >= LEAST_SCORE)
    known = row.filter(kept).select(F.col("row").withField("lang", F.col("guess.lang_pred")).alias("row"))
    return known.select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    An id with several texts loses only those whose own group has a smaller id.  Identical rows
    become one row; a null id is in no group and stays.
    """
    found = stored(simhash.near_duplicates(docs), "groups")
    gone = found.filter("doc_id != component_id").select(F.struct("doc_id", "fp").alias("gone"))
    marked = docs.select(F.struct("*").alias("row"), simhash.fingerprint("text").alias("fp"))
    own = F.struct(F.col("row.doc_id").alias("doc_id"), F.col("fp"))
    kept = marked.join(gone, own == F.col("gone"), "left_anti").select("row")
    apart = F.when(F.col("row.doc_id").isNull(), F.monotonically_increasing_id())
    return kept.withColumn("apart", apart).dropDuplicates().select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by their kinds."""
    clean = pii_boost.redacted(docs, pii_boost.fit(docs))
    out = docs.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all documents in the order of the mixture; part files hold it one after the other."""
    return pfair_mix.mixed(docs)


def with_position(docs: DataFrame) -> DataFrame:
    """Adds ``position``, from 0, to rows read from part files that hold them in order; only counts by file are moved."""
    placed = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = sorted(placed.groupBy("_file").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_file"])
    before = dict(zip([r["_file"] for r in files], accumulate([0] + [r["n"] for r in files])))
    found = docs.sparkSession.createDataFrame(list(before.items()), "_file string, _before long")
    rows = placed.join(F.broadcast(found), "_file")
    return rows.select(*docs.columns, (F.col("_before") + F.col("_row")).alias("position"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, whether they decode to its text, and its position in the mixture."""
    docs = with_position(docs)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = bpe_tree.round_trip(docs, path, public_tokenizers.PATTERN)
    out = docs.select("doc_id", "lang", "source", "position", made.alias("made"))
    return out.select("doc_id", "lang", "source", "position", "made.ids", F.size("made.ids").cast("long").alias("n_tokens"), "made.exact")


STAGES = [
    ("language_id", identify_language),
    ("simhash", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("pfair_mix", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the fingerprints nor the trees nor the merges; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
