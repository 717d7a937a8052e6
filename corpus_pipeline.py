"""The training-corpus pipeline: quality filter, line dedup, near-dedup, source mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read back as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.common import crc32_mod, read_table
from flowlens.llm.line_templates import without_recurring_lines
from flowlens.llm.mixing import mix
from flowlens.llm.packing import pack
from flowlens.llm.quality import fit, label_rows, quality_scores
from flowlens.llm.simhash_pivots import one_of_each
from flowlens.session import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.7 or more); trained on the labels outside the held-out quarter."""
    in_fold = F.coalesce(crc32_mod("doc_id", 4) != 2, F.lit(False))
    model = fit(label_rows(read_table(spark, sf_dir, "labels"), docs.select("doc_id", "text"), in_fold))
    return quality_scores(docs, model).filter("predicted = 1").select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; n_chars follows the text, and documents that were nothing else go."""
    found = without_recurring_lines(docs)
    found = found.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", size).select(*docs.columns)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints: shingles of three words, three bits or fewer apart."""
    return one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 rows each."""
    own = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    taken = mix(own, id_col="_row").groupBy("_row").agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows"))
    # Rows that repeat share what was taken of them: any assignment among equal rows is the same.
    found = own.join(taken.filter("_all > 0"), "_row").withColumn(
        "_nth", F.row_number().over(Window.partitionBy("_row").orderBy("_row")))
    copies = F.floor(F.col("_all") / F.col("_rows")) + (F.col("_nth") <= F.col("_all") % F.col("_rows")).cast("int")
    found = found.withColumn("_copies", copies.cast("int")).filter("_copies > 0")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_boilerplate),
    ("near_dedup", one_of_similar),
    ("source_mix", mixed_sources),
    ("packing", packed),
]

#: Training, fingerprints and draws are not SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
