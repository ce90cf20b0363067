"""One query per operator over its whole table, with the columns asked for."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.llm import (
    ann_scan,
    bpe_tree,
    chat_format,
    cover_tree,
    edit_prints,
    filter_audit,
    language_id,
    lbl_lm,
    ns_clusters,
    pfair_mix,
    pii_boost,
    simhash,
    suffix_dedup,
)
from screenloom.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


def remainder(parts: int):
    """The fold of a document: crc32 of its id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = remainder(5) == 0
    model = language_id.fit(docs.filter(~held_out))
    guess = language_id.predicted(docs, model)
    return docs.select("doc_id", held_out.alias("held_out"), guess.alias("guess")).select("doc_id", "held_out", "guess.*")


@query("op6_bpe_tree")
def op6_bpe_tree(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = docs.select("doc_id", bpe_tree.there_and_back(docs, path, public_tokenizers.PATTERN).alias("made"))
    return made.select(
        "doc_id",
        F.size("made.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("made.ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("made.body", 256).alias("decoded_sha256"),
    )


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def listed(spans):
    """kind:start:end, comma-joined, of spans in order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


@query("op5_pii_boost")
def op5_pii_boost(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = pii_boost.fit(docs)
    found = docs.select("doc_id", pii_boost.spans(docs, model).alias("spans"))
    base = F.filter("spans", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii_boost.KINDS]
    digest = F.sha2(listed(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, listed("spans").alias("spans"))


@query("op10_pfair_mix")
def op10_pfair_mix(spark: SparkSession, sf: str) -> DataFrame:
    placed = pfair_mix.placements(table(spark, sf, "documents"))
    return placed.select(F.col("key").alias("doc_id"), "source", "block", "phase", "slot", "place")


@query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


@query("op1_chat_format", chat_format.SQL)
def op1_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    return chat_format.rendered(table(spark, sf, "conversations"))


@query("op3_ann_scan")
def op3_ann_scan(spark: SparkSession, sf: str) -> DataFrame:
    return ann_scan.neighbours(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op8_cover_tree")
def op8_cover_tree(spark: SparkSession, sf: str) -> DataFrame:
    found = cover_tree.near_duplicates(table(spark, sf, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query("op9_lbl_lm")
def op9_lbl_lm(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = lbl_lm.scores(docs, remainder(7) != 2)
    return scored.select("doc_id", (remainder(7) == 2).alias("held_out"), *scored.columns[1:])


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf, "documents"), with_kept=False).drop("kept")


@query("op12_filter_audit", filter_audit.SQL)
def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op13_ns_clusters", ns_clusters.SQL)
def op13_ns_clusters(spark: SparkSession, sf: str) -> DataFrame:
    found, centroids, _ = ns_clusters.clustered(table(spark, sf, "embeddings"))
    return ns_clusters.with_digests(found, centroids)


@query("op11_edit_prints")
def op11_edit_prints(spark: SparkSession, sf: str) -> DataFrame:
    return edit_prints.with_edits(table(spark, sf, "documents"))
