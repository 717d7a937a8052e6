"""The last record per key, and upsert by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], tie: Sequence[str] | None = None
) -> DataFrame:
    """One row per key, the largest in ``order``; ties go to the largest remaining columns.

    The filter on the row number cuts each key to one row per map task before the shuffle, so a hot key
    stays small.
    """
    rest = [c for c in df.columns if c not in keys and c not in order] if tie is None else list(tie)
    window = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in [*order, *rest]])
    return df.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") == 1).drop("_n")


def upsert(current: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V5: rows of ``updates`` replace those of ``current`` with the same key; new keys are added."""
    both = current.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return last_per_key(both, keys, ["_new"], tie=[]).drop("_new")
