"""The registered queries of this folder, each over its whole table, with the SQL that checks it where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import bitmask_codes, licenses
from flowlens.llm.common import crc32_mod, read_table
from flowlens.llm.embedding_cells import near_embeddings
from flowlens.llm.fingerprints import edited_fingerprints, with_neighbours
from flowlens.llm.hard_negatives import SQL as MINING_SQL
from flowlens.llm.hard_negatives import hard_negatives
from flowlens.llm.langid import learn, predict
from flowlens.llm.line_templates import SQL as LINE_SQL
from flowlens.llm.line_templates import without_recurring_lines
from flowlens.llm.mixing import mix
from flowlens.llm.packing import pack
from flowlens.llm.quality import fit, label_rows, quality_scores
from flowlens.llm.simhash_pivots import near_duplicates
from flowlens.llm.suffix_dedup import without_repeats
from flowlens.llm.tokens import token_counts
from flowlens.session import written


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(read_table(spark, sf_dir, "embeddings"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False))
    known = learn(docs, ~held_out & F.col("doc_id").isNotNull())
    return predict(docs.select("doc_id", "text"), known).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(edited_fingerprints(read_table(spark, sf_dir, "documents")), "fingerprints")
    return with_neighbours(found).drop("hi", "lo")


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, keep=["doc_id"])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False))
    model = fit(label_rows(read_table(spark, sf_dir, "labels"), docs, ~held_out))
    return quality_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans", "whole")


def op13_bitmask_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmask_codes.compressed(read_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the corpus pipeline ends with."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir).withColumn("ids", F.sha2("ids", 256))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_near_dedup, op2_suffix_dedup, op3_embedding_near_dedup, op4_source_mix, op5_language_id, op6_fingerprints,
                              op7_line_templates, op8_curve_packing, op9_token_counts, op10_quality, op11_hard_negatives,
                              op12_license_scan, op13_bitmask_codes, pipeline)
}

SQL: dict[str, str] = {"op7_line_templates": LINE_SQL, "op11_hard_negatives": MINING_SQL,
                        "op12_license_scan": licenses.sql(), "op13_bitmask_codes": bitmask_codes.sql()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
